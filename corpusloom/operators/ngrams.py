"""Finding, counting and applying n-grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.automaton import AUTOMATON_BYTES, folded_column, hits, spaced_column, windows_found
from corpusloom.operators.ranking import global_rank
from corpusloom.options import Options
from corpusloom.sources.tables import ngram_list
from corpusloom.staging import bounded_batches, staged

def ngram_candidates(pairs: DataFrame) -> DataFrame:
    """Both orders of each correlated pair, distinct."""
    both = F.array(F.concat_ws(" ", "token1", "token2"), F.concat_ws(" ", "token2", "token1"))
    return pairs.select(F.explode(both).alias("ngram")).distinct()


def fits(ngrams: DataFrame) -> bool:
    """Whether a list is short enough to travel with the tasks."""
    return ngrams.agg(F.coalesce(F.sum(F.octet_length("ngram")), F.lit(0))).first()[0] <= AUTOMATON_BYTES


def _row_key(articles: DataFrame) -> list[str]:
    return ["batch", "id"] if "batch" in articles.columns else ["id"]


def match_ngrams(texts: DataFrame, candidates: DataFrame, strategy: str = "auto") -> DataFrame:
    """(id, ngram), with the batch where there is one: one row for each row of `texts` whose `text` contains the n-gram.

    Rows with the same id stay rows of their own. `inline` finds all candidates in one pass of an automaton over each text,
    without a shuffle; `equi` hashes the windows of the text, filters them and joins what is left; `loop` tests every
    article against every candidate. All give the same rows, for candidates of any number of parts. `auto` sums the bytes of the
    candidates and takes `inline` up to a fixed size, `equi` beyond it.
    """
    bounded_batches(texts.sparkSession)
    key = _row_key(texts)
    wanted = candidates.select("ngram").where("ngram IS NOT NULL").distinct()
    if strategy == "loop":
        return texts.select(*key, "text").join(wanted, F.contains("text", "ngram")).select(*key, "ngram")
    if strategy == "auto":
        strategy = "inline" if fits(wanted) else "equi"
    if strategy == "equi":
        return windows_found(texts, key, wanted)
    listed = [row.ngram for row in wanted.collect()]
    found = texts.select(*key, hits(F.col("text"), listed).alias("found"))
    return found.select(*key, F.explode("found").alias("ngram"))


def ngram_document_frequency(texts: DataFrame, candidates: DataFrame, strategy: str = "auto") -> DataFrame:
    """(ngram, freq): rows of `texts` with the n-gram, zero for candidates without any."""
    found = match_ngrams(texts, candidates, strategy).groupBy("ngram").agg(F.count("*").alias("freq"))
    return candidates.select("ngram").join(found, "ngram", "left").fillna(0, ["freq"])


def detect_ngrams(
    articles: DataFrame, pairs: DataFrame, opts: Options = Options(), strategy: str = "auto"
) -> DataFrame:
    """Document frequency of every candidate that the correlated pairs suggest."""
    candidates = staged(ngram_candidates(pairs), "candidates")
    return ngram_document_frequency(X.with_text(articles, opts.text_source), candidates, strategy)


def sum_ngrams(counts: DataFrame) -> DataFrame:
    return counts.groupBy("ngram").agg(F.sum("freq").alias("freq"))


def add_counts(*counts: DataFrame) -> DataFrame:
    """Counts of several batches added up per n-gram."""
    first, *rest = counts
    for other in rest:
        first = first.unionByName(other)
    return sum_ngrams(first)


def extend_ngrams(detected: DataFrame, known: DataFrame) -> DataFrame:
    return detected.select("ngram").union(known.select("ngram")).distinct()


def order_ngrams(ngrams: DataFrame) -> DataFrame:
    """(ngram, size), longest first so that longer n-grams are collapsed before their parts."""
    return ngrams.select("ngram", X.part_count(F.col("ngram")).alias("size")).orderBy(F.col("size").desc(), "ngram")


def frequent_ngrams(counts: DataFrame, min_freq: int) -> DataFrame:
    return counts.filter(F.col("freq") >= min_freq)


def combine_ngrams(
    counts: DataFrame | Sequence[DataFrame], known: DataFrame, min_freq: int = 100
) -> tuple[DataFrame, DataFrame]:
    """Total counts, and the known list extended by the frequent ones in order of application."""
    total = add_counts(*([counts] if isinstance(counts, DataFrame) else counts))
    return total, order_ngrams(extend_ngrams(frequent_ngrams(total, min_freq), known))


def by_frequency(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.col("freq").desc(), "ngram")


def replace_ngrams(articles: DataFrame, counts: DataFrame, min_freq: int = 100) -> DataFrame:
    """Articles with the parts of frequent n-grams joined by underscores, in title and abstract.

    N-grams of two parts are joined, as their expression has one gap.
    """
    bounded_batches(articles.sparkSession)
    frequent = frequent_ngrams(counts, min_freq).select("ngram", "freq")
    if fits(frequent):
        listed = [row.ngram for row in by_frequency(frequent).select("ngram").collect()]
        return articles.withColumns({c: X.join_parts(F.col(c), listed) for c in ("title", "abstract")})
    ranked = global_rank(frequent, [F.col("freq").desc(), F.col("ngram")], "pos")
    pattern = F.udf(lambda ngram: X.joining_pattern(ngram), "string")
    for c in ("title", "abstract"):
        articles = with_found(articles, c, ranked.withColumn("value", pattern("ngram")), folded_column)
        articles = articles.withColumn(c, F.when(F.col(c).isNotNull(), X.join_found(F.col(c), F.col("_found")))).drop("_found")
    return articles


def collapse_ngrams(texts: DataFrame, ngrams: DataFrame | Sequence[str], text: str = "text") -> DataFrame:
    """Join the parts of listed n-grams in the text column with underscores, in list order.

    A table (pos, ngram) of any size: one that fits travels with the tasks, a longer one is looked up by `windows_found`.
    """
    bounded_batches(texts.sparkSession)
    if not isinstance(ngrams, DataFrame) or fits(ngrams):
        return texts.withColumn(text, X.collapse(F.col(text), ngram_list(ngrams)))
    useful = ngrams.where(F.contains("ngram", F.lit(" "))).select("pos", "ngram", F.col("ngram").alias("value"))
    found = with_found(texts, text, useful, spaced_column)
    return found.withColumn(text, X.collapse_found(F.col(text), F.col("_found"))).drop("_found")


def with_found(rows: DataFrame, column: str, listed: DataFrame, same) -> DataFrame:
    """Adds `_found`, the values of the listed (pos, ngram, value) that the column contains, in list order.

    Rows are numbered and written once, so that what is found comes back to them.
    """
    numbered = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    strings = listed.select("pos", "value", same("ngram").alias("_same"))
    texts = numbered.select("_row", same(column).alias("text"))
    met = windows_found(texts, ["_row"], strings, column="_same").join(strings, "_same")
    per_row = met.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("_found"))
    none = F.array().cast("array<string>")
    return numbered.join(per_row, "_row", "left").withColumn("_found", F.coalesce("_found.value", none)).drop("_row")
