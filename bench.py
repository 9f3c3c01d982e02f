"""Time the headline steps on one folder of data and print one JSON line.

Each step reads the written tables of the steps before it, as in a real run, and is computed in full
into a sink that keeps nothing. The time of a step is the median of RUNS runs, after one that warms up if it is
short; long steps are run fewer times.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from corpusloom.operators import clusters, cooccurrence, dense, neighbours, ngrams, projection, raster, tokens, vocabulary  # noqa: E402
from corpusloom.operators.token_stats import token_stats  # noqa: E402
from corpusloom.plans.queries import ENCODER_DIM, Inputs, flagship  # noqa: E402


def frequent_pairs(i: Inputs, n: int) -> list[str]:
    """The `n` most frequent pairs of neighbouring words, as an n-gram list."""
    words = F.split("text", r"\s+")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    counted = i.texts.select(F.explode(pairs).alias("ngram")).where("ngram RLIKE '^[a-z]+ [a-z]+$'").groupBy("ngram").count()
    return [r.ngram for r in counted.orderBy(F.col("count").desc(), "ngram").limit(n).collect()]


def steps(i: Inputs) -> dict[str, Callable[[], DataFrame]]:
    lists = {n: frequent_pairs(i, n) for n in (10, 2000)}
    counts = i.spark.createDataFrame([(g, 1000 - k // 4) for k, g in enumerate(lists[2000])], "ngram string, freq bigint")
    with_list = {
        f"r01_with_{n}_ngrams": lambda listed=listed: tokens.article_stats(i.articles, listed, i.stop_list) for n, listed in lists.items()
    }
    return {
        "r01_article_stats": i.fresh_stats,
        **with_list,
        "r09_replace_2000_ngrams": lambda: ngrams.replace_ngrams(i.articles, counts, 1),
        "r03_token_stats": lambda: token_stats(i.article_stats),
        "r04_token_cooccurrence": lambda: cooccurrence.token_cooccurrence(i.article_stats, i.token_stats, i.opts),
        "j05_token_pairs": lambda: cooccurrence.token_pairs(i.presence),
        "r05_token_correlations": lambda: cooccurrence.token_correlations(i.presence),
        "r06_correlated_token_pairs": lambda: i.pairs,
        "r07_detect_ngrams_inline": lambda: ngrams.ngram_document_frequency(i.texts, i.candidates, "inline"),
        "r07_detect_ngrams_equi": lambda: ngrams.ngram_document_frequency(i.texts, i.candidates, "equi"),
        "r10_stat_embeddings": lambda: vocabulary.stat_embeddings(i.articles, i.article_stats, i.token_stats, i.opts)[0],
        "r11_encode_articles": lambda: dense.encode_articles(i.articles, dense.hash_encoder(ENCODER_DIM)),
        "v02_kmeans": lambda: clusters.cluster_articles(i.embeddings, 10),
        "v05_project": lambda: projection.project_2d(i.embeddings),
        "v06_knn": lambda: neighbours.knn_graph(i.embeddings, 15),
        "e01_jaccard_neighbours": lambda: neighbours.term_neighbours(i.article_stats, i.articles, 15, "jaccard"),
        "e02_cosine_neighbours": lambda: neighbours.term_neighbours(i.tfidf, i.articles, 15),
        "r15_visualize": lambda: raster.visualize_embeddings(i.points, i.clusters, i.opts),
    }


RUNS = 3
LONG_S = 6.0


def compute(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(step: Callable[[], DataFrame]) -> float:
    found = []
    while len(found) < RUNS + 1 and sum(found) < LONG_S * 2:
        start = time.perf_counter()
        compute(step())
        found.append(time.perf_counter() - start)
    return round(median(found[1:] or found), 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    inputs = Inputs(spark, folder)
    inputs.articles.count()  # start-up and file listing are not part of any step
    times: dict[str, float] = {}
    for name, step in steps(inputs).items():
        for needed in NEEDS.get(name, ()):
            getattr(inputs, needed)
        times[name] = timed(step)
    times["flagship_from_text"] = timed(lambda: flagship(spark, folder))
    total = round(sum(times.values()), 3)
    sf = Path(folder).name.removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": float(sf)}))
    spark.stop()


# tables that must be on disk before the step is timed
NEEDS = {
    "r03_token_stats": ["article_stats"],
    "r04_token_cooccurrence": ["token_stats", "opts"],
    "j05_token_pairs": ["presence"],
    "e02_cosine_neighbours": ["tfidf"],
    "r06_correlated_token_pairs": ["correlations"],
    "r07_detect_ngrams_inline": ["candidates"],
}

if __name__ == "__main__":
    main()
