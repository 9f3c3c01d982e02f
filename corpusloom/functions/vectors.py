"""Array expressions for embeddings."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def as_arrays(emb: DataFrame) -> DataFrame:
    """`embedding` as array<double>, whether it came as an array or as an ML vector."""
    if emb.schema["embedding"].dataType.typeName() == "array":
        return emb.withColumn("embedding", doubles(F.col("embedding")))
    return emb.withColumn("embedding", vector_to_array("embedding"))


def as_vectors(emb: DataFrame) -> DataFrame:
    if emb.schema["embedding"].dataType.typeName() == "array":
        return emb.withColumn("embedding", array_to_vector(doubles(F.col("embedding"))))
    return emb


def is_constant(vector: Column) -> Column:
    """True when all entries are equal, which is exactly when the variance is zero."""
    return F.array_max(vector) == F.array_min(vector)


def dense(entries: Column, dim: int) -> Column:
    """Entries (dim, n) sorted by dim -> array of `dim` doubles, gaps filled with zeros."""
    filled = F.flatten(
        F.transform(
            entries,
            lambda e, i: F.concat(
                F.array_repeat(F.lit(0.0), e["dim"] - F.coalesce(F.get(entries, i - 1)["dim"], F.lit(-1)) - 1),
                F.array(e["n"].cast("double")),
            ),
        )
    )
    return F.concat(filled, F.array_repeat(F.lit(0.0), F.lit(dim) - F.size(filled)))


def to_wide(emb: DataFrame, dim: int, prefix: str = "dim_", key: str = "article_id") -> DataFrame:
    return emb.select(key, *(F.get("embedding", F.lit(i)).alias(f"{prefix}{i}") for i in range(dim)))


def from_wide(wide: DataFrame, key: str = "article_id", prefix: str = "dim_") -> DataFrame:
    columns = [c for c in wide.columns if c.startswith(prefix)]
    columns.sort(key=lambda c: int(c[len(prefix):]))
    return wide.select(F.col(key).alias("article_id"), F.array(*(F.col(c) for c in columns)).alias("embedding"))
