"""Stop word lists.

The list joins general function words, which are a parameter, with generated numbers, letters and
years and with a fixed list of frequent words that say little about an article.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_INLINE_WORDS = 100_000

# Frequent words in articles that carry little information.
FREQUENT_WORDS = """
ability able accuracy access according account achieve administration
add addition additional affect affected affects
aim aimed aims allow
analysis analyze applications approach approaches article
assess assessed associated based best better
challenge challenging characterized characterization com common
commonly compared consider corrigendum crucial
current currently demonstrate described design
determine different discuss discussed effect effective
effects erratum especially evaluate evidence
examined existing experience finally findings focus
following furthermore given healthy http https
identified implications important improve included including
induced introduce introduced investigate investigated key known left
like main materials mathbb mathcal mathrm method methods
need needs new non novel objective observed
obtain obtained org outcome overview paper
particular performance performed possible presence
present problem problems properties propose
proposed prove provide purpose range recent
related relationship report research respectively
result results resulting revealed review role set showed
shown significant significantly solution solutions
studies study technique test theory thing try
type use useful value values way work www
year
""".split()


def stop_list(general: Iterable[str] | None = None) -> list[str]:
    """The distinct stop words in order, as Python strings.

    `general` names the function words to use; by default the English list that Spark ships.
    """
    words = set(StopWordsRemover.loadDefaultStopWords("english") if general is None else general)
    words.update(str(n).zfill(2) for n in range(101))
    words.update(string.digits, string.ascii_lowercase)
    words.update(str(year) for year in range(2000, 2030))
    words.update(FREQUENT_WORDS)
    return sorted(words)


def stop_words(spark: SparkSession, general: DataFrame | Iterable[str] | None = None) -> DataFrame:
    """The same list as a table (word); `general` may be a table with a `word` column, too."""
    if isinstance(general, DataFrame):
        return general.select("word").unionByName(stop_words(spark, ())).distinct()
    return spark.createDataFrame([(w,) for w in stop_list(general)], "word string")


def lemmatized_stop_words(stop: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Each stop word replaced by its lemma where (word, lemma) has one, plus `https`."""
    replaced = stop.join(lemmas, "word", "left").select(F.coalesce("lemma", "word").alias("word"))
    extra = stop.sparkSession.createDataFrame([("https",)], "word string")
    return replaced.unionByName(extra).distinct()


def inline_fits(stop: DataFrame) -> bool:
    """Whether a table of stop words is short enough for an expression."""
    return stop.select("word").distinct().count() <= MAX_INLINE_WORDS


def word_list(stop: DataFrame | Sequence[str]) -> list[str]:
    """Stop words as a sorted Python list, for use inside an expression; longer tables are joined (`article_stats`, `drop_stop_words`)."""
    if not isinstance(stop, DataFrame):
        return sorted(set(stop))
    found = [row.word for row in stop.select("word").distinct().take(MAX_INLINE_WORDS + 1)]
    if len(found) > MAX_INLINE_WORDS:
        raise ValueError("stop list too long for an expression; use drop_stop_words on the token table")
    return sorted(found)
