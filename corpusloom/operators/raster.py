"""From projected points to a table of coloured pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.palette import MAX_CLUSTERS, colours, rgb
from corpusloom.operators.ranking import exact_quantiles, sample_articles
from corpusloom.options import Options
from corpusloom.staging import staged


def with_cluster(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """Points with their cluster; a point without one is an error."""
    missing = F.raise_error(F.concat(F.lit("no cluster for article "), F.col("article_id").cast("string")))
    joined = points.join(clusters.select("article_id", "cluster"), "article_id", "left")
    return joined.withColumn("cluster", F.coalesce("cluster", missing.cast("string")))


def check_cluster_limit(clusters: DataFrame, limit: int = MAX_CLUSTERS) -> DataFrame:
    """One row (n_clusters); more than `limit` clusters are an error."""
    n = clusters.agg(F.countDistinct("cluster").alias("n"))
    error = F.raise_error(F.lit(f"pictures are limited to {limit} clusters")).cast("bigint")
    return n.select(F.when(F.col("n") > limit, error).otherwise(F.col("n")).alias("n_clusters"))


def palette(clusters: DataFrame) -> DataFrame:
    """(cluster, colour, r, g, b): clusters in label order take the colours in list order."""
    n = check_cluster_limit(clusters).scalar()
    # at most MAX_CLUSTERS labels pass the check
    labels = clusters.select("cluster").distinct().withColumn("n", n)
    place = F.row_number().over(W.orderBy("cluster"))
    coloured = labels.withColumn("colour", F.get(colours(F.col("n").cast("int")), place - 1))
    return coloured.select("cluster", "colour", *rgb(F.col("colour")))


def clip_bounds(points: DataFrame, q: float = 0.995) -> DataFrame:
    """One row (min_x, max_x, min_y, max_y) at the quantiles 1-q and q."""
    ends = exact_quantiles(points, {"x1": [1 - q, q], "x2": [1 - q, q]})
    row = (*ends["x1"], *ends["x2"])
    return points.sparkSession.createDataFrame([row], "min_x double, max_x double, min_y double, max_y double")


def _numbers(bounds: DataFrame) -> dict[str, Column]:
    """The four bounds as literals, so that the filter on them reaches the scan."""
    row = bounds.select("min_x", "max_x", "min_y", "max_y").first()
    return {name: F.lit(value).cast("double") for name, value in row.asDict().items()}


def clip_points(points: DataFrame, q: float = 0.995, bounds: DataFrame | None = None) -> DataFrame:
    """Points inside the quantile box, edges included."""
    b = _numbers(clip_bounds(points, q) if bounds is None else bounds)
    return points.filter(F.col("x1").between(b["min_x"], b["max_x"]) & F.col("x2").between(b["min_y"], b["max_y"]))


def _pixel(x: Column, low: Column, high: Column, size: int) -> Column:
    """Pixel 0..size-1; the upper edge belongs to the last pixel."""
    place = F.floor(F.coalesce(F.try_divide((x - low) * size, high - low), F.lit(0.0)))
    return F.least(place, F.lit(size - 1)).cast("int")


def bin_points(points: DataFrame, width: int, height: int, bounds: DataFrame) -> DataFrame:
    """(px, py, cluster, n): points per pixel and cluster inside the bounds."""
    b = _numbers(bounds)
    inside = clip_points(points, bounds=bounds)
    px = _pixel(F.col("x1"), b["min_x"], b["max_x"], width)
    py = _pixel(F.col("x2"), b["min_y"], b["max_y"], height)
    return inside.groupBy(px.alias("px"), py.alias("py"), "cluster").agg(F.count("*").alias("n"))


def _equalized(pixels: DataFrame, name: str) -> DataFrame:
    """Adds the share of non-empty pixels whose `total` is not higher."""
    # one row per distinct total, so at most one per pixel of the canvas
    levels = pixels.groupBy("total").agg(F.count("*").alias("pixels"))
    upto = F.sum("pixels").over(W.orderBy("total").rowsBetween(W.unboundedPreceding, 0))
    everything = F.sum("pixels").over(W.partitionBy())
    shades = levels.select("total", (upto / everything).alias(name))
    return pixels.join(shades, "total")


def equalize(raster: DataFrame) -> DataFrame:
    """(px, py, total, shade): histogram-equalised brightness of the non-empty pixels."""
    pixels = raster.groupBy("px", "py").agg(F.sum("n").alias("total"))
    return _equalized(pixels, "shade").select("px", "py", "total", "shade")


def shade(raster: DataFrame, palette_: DataFrame) -> DataFrame:
    """(px, py, r, g, b, alpha): colours mixed by count, opacity by histogram equalisation."""
    mixed = [(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in "rgb"]
    # the palette has at most MAX_CLUSTERS rows
    pixels = raster.join(F.broadcast(palette_), "cluster").groupBy("px", "py").agg(F.sum("n").alias("total"), *mixed)
    return _equalized(pixels, "alpha").select("px", "py", *"rgb", "alpha")


def visualize_embeddings(projection: DataFrame, clusters: DataFrame, opts: Options = Options()) -> DataFrame:
    """The picture of a projection as a pixel table."""
    sample = sample_articles(projection, opts.raster_max_articles, opts.random_seed, key="article_id")
    # read by the quantiles and by the raster
    points = staged(with_cluster(sample, clusters), "points")
    raster = bin_points(points, opts.raster_width, opts.raster_height, clip_bounds(points, opts.clip_quantile))
    return shade(raster, palette(clusters))
