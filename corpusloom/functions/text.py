"""Column expressions on article text; all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.automaton import joined, rewritten, spaced

WORD_CHAR = r"[\p{L}\p{N}_]"
UNROLL_LIMIT = 50


def source_text(source: str, title: str = "title", abstract: str = "abstract") -> Column:
    """Title, abstract, or both joined by one space; missing parts count as empty."""
    parts = {"title": F.coalesce(F.col(title), F.lit("")), "abstract": F.coalesce(F.col(abstract), F.lit(""))}
    if source == "both":
        return F.concat(parts["title"], F.lit(" "), parts["abstract"])
    return parts[source]


def with_text(articles: DataFrame, source: str = "both", lowercase: bool = True) -> DataFrame:
    """Adds `text`: title, abstract or both, nulls as empty, lower case for tokens."""
    text = source_text(source)
    return articles.withColumn("text", F.lower(text) if lowercase else text)


def words(text: Column, min_length: int = 1) -> Column:
    """All maximal runs of Unicode word characters of at least `min_length` code points."""
    return F.regexp_extract_all(text, F.lit(f"{WORD_CHAR}{{{max(1, min_length)},}}"), F.lit(0))


def sql_list(values: Iterable[str]) -> str:
    """String literals for an IN list, which Spark evaluates as one hash set.

    The list is parsed as text because building thousands of literal columns one by one is slow.
    """
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def without(words_: str, stop: Sequence[str]) -> Column:
    """The array column `words_` without stop words; repeats of the other words stay."""
    return F.expr(f"filter({words_}, w -> w NOT IN ({sql_list(stop)}))") if stop else F.col(words_)


def run_starts(sorted_words: Column) -> Column:
    """Positions (from 0) in a sorted array at which a new value starts."""
    return F.when(
        F.size(sorted_words) > 0,
        F.filter(
            F.sequence(F.lit(0), F.size(sorted_words) - 1),
            lambda i: (i == 0) | (F.get(sorted_words, i) != F.get(sorted_words, i - 1)),
        ),
    )


def run_counts(sorted_words: Column, starts: Column) -> Column:
    """(token, n) for each run of equal values in a sorted array."""
    return F.transform(
        starts,
        lambda start, i: F.struct(
            F.get(sorted_words, start).alias("token"),
            (F.coalesce(F.get(starts, i + 1), F.size(sorted_words)) - start).cast("bigint").alias("n"),
        ),
    )


def collapse(text: Column, ngrams: Sequence[str]) -> Column:
    """Replace each listed n-gram, in list order, by itself with underscores for spaces.

    Of a long list only those n-grams are replaced that one pass over the text finds. A replacement never makes an
    n-gram appear that the text, spaces and underscores taken for one sign, did not have.
    """
    useful = [g for g in ngrams if " " in g]
    if len(useful) <= UNROLL_LIMIT:
        return reduce(lambda acc, g: F.replace(acc, F.lit(g), F.lit(g.replace(" ", "_"))), useful, text)
    return rewritten(text, useful, [g.replace(" ", "_") for g in useful], spaced)


def collapse_found(text: Column, found: Column) -> Column:
    return F.aggregate(found, text, lambda acc, g: F.replace(acc, g, F.replace(g, F.lit(" "), F.lit("_"))))


def quoted(part: str) -> str:
    """A regular expression that matches `part` literally."""
    return "\\Q" + part.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def joining_pattern(ngram: str) -> str:
    left, right = ngram.split()
    return rf"(?iU)(?<!{WORD_CHAR})({quoted(left)})\s+({quoted(right)})"


def join_parts(text: Column, ngrams: Sequence[str]) -> Column:
    """Rewrite `lhs <spaces> rhs` to `lhs_rhs` for each two-part n-gram, ignoring and keeping case.

    The left part must start at a word boundary; the right part may be the start of a longer word. A long list is
    looked up piece by piece, which gives the same text.
    """
    if len(ngrams) <= UNROLL_LIMIT:
        return reduce(lambda acc, p: F.regexp_replace(acc, p, "$1_$2"), map(joining_pattern, ngrams), text)
    return joined(text, [tuple(g.split()) for g in ngrams])


def join_found(text: Column, patterns: Column) -> Column:
    return F.aggregate(patterns, text, lambda acc, p: F.regexp_replace(acc, p, F.lit("$1_$2")))


def encoder_text(source: str, lowercase: bool) -> Column:
    """Text as the encoder sees it: optional lower case, line breaks as spaces."""
    text = source_text(source)
    return F.replace(F.lower(text) if lowercase else text, F.lit("\n"), F.lit(" "))


def sentences(text: Column) -> Column:
    """Split after `.`, `!` or `?` followed by white space."""
    mark = "\u0001"
    return F.split(F.regexp_replace(text, r"([.!?])\s+", "$1" + mark), mark)


def part_count(ngram: Column) -> Column:
    """Number of spaces, that is of parts minus one."""
    return F.length(ngram) - F.length(F.replace(ngram, F.lit(" "), F.lit("")))


def zero_pad(number: Column, width: int) -> Column:
    """Decimal digits padded to `width`; longer numbers keep all their digits."""
    digits = number.cast("string")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def cluster_label(number: Column, k: int) -> Column:
    """`cluster_` and the number, padded to the digits that `k` clusters need."""
    digits = 0
    while 10**digits < k + 1:
        digits += 1
    return F.concat(F.lit("cluster_"), zero_pad(number, digits))
