"""The score formulas as functions for `spark.sql`."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFINITIONS = {
    "idf": ("num_articles DOUBLE, n_articles DOUBLE", "ln((1 + n_articles) / (1 + num_articles))"),
    "ridf": (
        "cf DOUBLE, df DOUBLE, n_articles DOUBLE",
        "log2(n_articles / df) + log2(1 - exp(-cf / n_articles))",
    ),
    "phi": (
        "n DOUBLE, both DOUBLE, count1 DOUBLE, count2 DOUBLE",
        "try_divide(n * both - count1 * count2,"
        " sqrt(count1 * (n - count1)) * sqrt(count2 * (n - count2)))",
    ),
}


def register_functions(spark: SparkSession) -> None:
    """Make `idf`, `ridf` and `phi` callable in SQL; they are inlined into the plan."""
    for name, (parameters, body) in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS DOUBLE RETURN {body}")
