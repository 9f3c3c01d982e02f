"""From article text to counted tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.ngrams import collapse_ngrams
from corpusloom.operators.stopwords import inline_fits, word_list
from corpusloom.options import Options


article_text = X.with_text


def fill_text(articles: DataFrame) -> DataFrame:
    return articles.fillna("", ["title", "abstract"])


def exclude_articles(articles: DataFrame, missing_abstract: bool = True, missing_title: bool = True) -> DataFrame:
    if missing_abstract:
        articles = articles.filter(F.col("abstract").isNotNull())
    if missing_title:
        articles = articles.filter(F.col("title").isNotNull())
    return articles


def encoder_text(articles: DataFrame, source: str = "both", lowercase: bool = False) -> DataFrame:
    return articles.withColumn("text", X.encoder_text(source, lowercase))


def sentences(texts: DataFrame) -> DataFrame:
    """One row (id, sent, sentence) per sentence of `text`."""
    return texts.select("id", F.posexplode(X.sentences(F.col("text"))).alias("sent", "sentence"))


def tokens(texts: DataFrame) -> DataFrame:
    """One row (id, token) per token occurrence in `text`.

    The outer explode keeps Spark from running the expression a second time just to see whether the
    array is empty.
    """
    return texts.select("id", F.explode_outer(X.words(F.col("text"))).alias("token")).filter("token is not null")


def drop_stop_words(tokens_: DataFrame, stop: DataFrame | Sequence[str]) -> DataFrame:
    """Token occurrences that are not stop words; a table of any size is joined, a list is inlined."""
    if isinstance(stop, DataFrame):
        return tokens_.join(stop.select(F.col("word").alias("token")), "token", "left_anti").select(*tokens_.columns)
    return tokens_.filter(~F.col("token").isin(list(stop))) if stop else tokens_


def min_length(tokens_: DataFrame, length: int) -> DataFrame:
    return tokens_.filter(F.length("token") >= length)


def count_tokens(tokens_: DataFrame) -> DataFrame:
    """(id, token, n) from token occurrences."""
    return tokens_.groupBy("id", "token").agg(F.count("*").alias("n"))


def article_totals(counts: DataFrame) -> DataFrame:
    """Adds `num_tokens`, the kept tokens of the article."""
    return counts.withColumn("num_tokens", F.sum("n").over(W.partitionBy("id")))


def term_frequency(counts: DataFrame) -> DataFrame:
    """Adds `tf` to counts that carry `num_tokens`."""
    return counts.withColumn("tf", F.col("n") / F.col("num_tokens"))


def kept_words(articles: DataFrame, ngrams, stop, opts: Options, keep: Sequence[str] = ()) -> DataFrame:
    """(id, words): the sorted kept tokens of each article, one row per article."""
    texts = articles.select(cast_id(opts), *keep, F.lower(X.source_text(opts.text_source)).alias("text"))
    words = collapse_ngrams(texts, ngrams).select("id", *keep, X.words(F.col("text"), opts.min_length).alias("words"))
    return words.withColumn("words", F.sort_array(X.without("words", word_list(stop))))


def cast_id(opts: Options, name: str = "id"):
    return F.col(name).cast(opts.id_type).alias(name) if opts.id_type else F.col(name)


def article_stats(
    articles: DataFrame,
    ngrams: DataFrame | Sequence[str] = (),
    stop: DataFrame | Sequence[str] = (),
    opts: Options = Options(),
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, token, n, tf) per article and distinct kept token.

    All tokens of an article sit in its own row, so the count is a run length over the sorted word
    array: one narrow pass over the text with no shuffle. `keep` names further article columns, such
    as the batch, to carry along. A stop list too long for an expression is joined to the counted tokens instead; the rows
    of an article then meet again for its total.
    """
    if isinstance(stop, DataFrame) and not inline_fits(stop):
        counted = _counted_words(kept_words(articles, ngrams, (), opts, keep).withColumn("_row", F.monotonically_increasing_id()), [*keep, "_row"])
        kept = counted.join(stop.select(F.col("word").alias("token")).distinct(), "token", "left_anti")
        kept = kept.withColumn("num_tokens", F.sum("n").over(W.partitionBy("_row")))
    else:
        kept = _counted_words(kept_words(articles, ngrams, stop, opts, keep), keep)
    return kept.select("id", "token", "n", (F.col("n") / F.col("num_tokens")).alias("tf"), *keep)


def _counted_words(words: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(id, keep, num_tokens, token, n) from the sorted words of each row."""
    column = F.col("words")
    return (
        words.withColumn("starts", X.run_starts(column))
        .select("id", *keep, F.size(column).alias("num_tokens"), X.run_counts(column, F.col("starts")).alias("runs"))
        .select("id", *keep, "num_tokens", F.explode_outer("runs").alias("run"))
        .filter("run is not null")
        .select("id", *keep, "num_tokens", "run.token", "run.n")
    )


def union_batches(*article_stats_: DataFrame) -> DataFrame:
    """Article statistics of several batches below each other, duplicates kept."""
    first, *rest = article_stats_
    for other in rest:
        first = first.unionByName(other)
    return first


combine_article_stats = union_batches


def token_set(article_stats_: DataFrame) -> DataFrame:
    return article_stats_.select("token").distinct()
