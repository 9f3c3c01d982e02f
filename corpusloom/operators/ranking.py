"""Global ranks, top lists and exact order statistics that never pass through one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.staging import staged

SKETCH_ACCURACY = 100_000
HASH_BUCKET_DIGITS = 4


def global_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds the position 1..n in a total order.

    Rows are range-partitioned and written once; each partition numbers its own rows and adds the
    sizes of the partitions before it. `order` must be unique, so end it with a key.
    """
    parts = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # one row per partition of the range exchange, so one task and a broadcast are enough
    offsets = (
        parts.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return (
        parts.withColumn("_within", within)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_within") + F.col("_offset"))
        .drop("_part", "_within", "_offset")
    )


def rank_by(tokens: DataFrame, score: str) -> DataFrame:
    """Adds the rank 1..n by falling `score`, ties by token. Scores rest on exact sums, so equal ones are equal."""
    names = {"mean_tfidf": "tfidf_rank", "adj_ridf": "ridf_rank"}
    order = [F.col(score).desc_nulls_last(), F.col("token")]
    return global_rank(tokens, order, names.get(score, f"{score}_rank"))


def min_rank(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("min_rank", F.least("tfidf_rank", "ridf_rank"))


def top_tokens(tokens: DataFrame, score: str, dim: int, ascending: bool = False) -> DataFrame:
    """(rank, token) of the `dim` best tokens; ties go to the smaller token."""
    key = F.col(score)
    order = [key.asc_nulls_last() if ascending else key.desc_nulls_last(), F.col("token")]
    top = tokens.select("token", score).orderBy(*order).limit(dim)
    # at most `dim` rows are left here
    return top.select(F.row_number().over(W.orderBy(*order)).alias("rank"), "token")


def index_tokens(article_stats: DataFrame) -> DataFrame:
    """(token, code): position of each distinct token in code-point order, from 0."""
    ranked = global_rank(article_stats.select("token").distinct(), [F.col("token")], "_rank")
    return ranked.select("token", (F.col("_rank") - 1).alias("code"))


def sample_articles(df: DataFrame, k: int | None, seed: int, key: str = "id") -> DataFrame:
    """All rows of `k` pseudo-random ids, or everything when there are no more than `k` or `k` is None.

    Ids are ordered by a seeded hash. A histogram over the first hash digits finds the bucket with
    the k-th id, only that bucket is sorted, and the rows are then filtered where they are: no task
    sees more than one bucket, and repeats of one id cost nothing.
    """
    if k is None:
        return df
    digest = F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))
    bucket = F.conv(F.substring(digest, 1, HASH_BUCKET_DIGITS), 16, 10).cast("int")
    ids = df.select(key).distinct().select(bucket.alias("bucket"), F.struct(digest.alias("h"), F.col(key)).alias("at"))
    up_to = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    # at most 16^HASH_BUCKET_DIGITS rows
    running = (
        ids.groupBy("bucket")
        .agg(F.count("*").alias("rows"))
        .select("bucket", "rows", F.sum("rows").over(up_to).alias("running"))
    )
    cut = running.filter(F.col("running") >= k).orderBy("bucket").limit(1).first()
    if cut is None:
        return df
    take = k - cut.running + cut.rows
    place = F.row_number().over(W.orderBy("at"))
    last = (
        ids.filter(F.col("bucket") == cut.bucket)
        .withColumn("place", place)
        .filter(F.col("place") == take)
        .select("at.h", F.col(f"at.{key}").alias("id"))
        .first()
    )
    earlier = (bucket < cut.bucket) | (digest < last.h) | ((digest == last.h) & (F.col(key) <= last.id))
    return df.filter(earlier)


def exact_quantiles(df: DataFrame, at: Mapping[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of several columns, as numbers.

    A mergeable sketch brackets each quantile within a few 1e-5 of all rows. A second pass counts
    what lies below each bracket and orders only the distinct values inside it. Each pass takes all
    columns at once and returns one row per quantile.
    """
    wanted = [(column, q) for column, qs in at.items() for q in qs]
    slack = 3.0 / SKETCH_ACCURACY

    def probe(column: str, q: float, side: int) -> Column:
        x = F.col(column).cast("double")
        edge = F.min(x) if side < 0 else F.max(x)
        if not 0 < q + side * slack < 1:
            return edge
        # with few rows the sketch has no advantage and the bracket is everything
        few = F.count(x) <= SKETCH_ACCURACY
        return F.when(few, edge).otherwise(F.approx_percentile(x, q + side * slack, SKETCH_ACCURACY))

    sketch = df.agg(
        *(F.count(column).alias(f"n{i}") for i, (column, _) in enumerate(wanted)),
        *(probe(column, q, -1).alias(f"low{i}") for i, (column, q) in enumerate(wanted)),
        *(probe(column, q, 1).alias(f"high{i}") for i, (column, q) in enumerate(wanted)),
    ).first()

    def placed(i: int, column: str) -> Column:
        x = F.col(column).cast("double")
        inside = F.when(x >= F.lit(sketch[f"low{i}"]), x)
        return F.when(x <= F.lit(sketch[f"high{i}"]), F.struct(F.lit(i).alias("i"), inside.alias("x")))

    marks = df.select(F.explode(F.array(*(placed(i, column) for i, (column, _) in enumerate(wanted)))).alias("m"))
    counts = marks.filter("m is not null").groupBy("m.i", "m.x").agg(F.count("*").alias("n"))
    order = W.partitionBy("i").orderBy(F.col("x").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    target = F.get(F.array(*(F.lit(q * (sketch[f"n{i}"] - 1)) for i, (_, q) in enumerate(wanted))), F.col("i"))
    found = (
        counts.withColumn("upto", F.sum("n").over(order))
        .withColumn("target", target)
        .groupBy("i")
        .agg(
            F.min(F.when(F.col("upto") > F.floor("target"), F.col("x"))).alias("lower"),
            F.min(F.when(F.col("upto") > F.ceil("target"), F.col("x"))).alias("upper"),
            F.max(F.col("target") - F.floor("target")).alias("share"),
        )
    )
    result: dict[str, list[float | None]] = {column: [] for column in at}
    rows = {row.i: row for row in found.collect()}
    for i, (column, _) in enumerate(wanted):
        row = rows.get(i)
        result[column].append(None if row is None else row.lower + (row.upper - row.lower) * row.share)
    return result
