"""Corpus-level token statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import scores as S
from corpusloom.staging import staged


def num_articles(article_stats: DataFrame) -> DataFrame:
    """One row (n_articles): articles with at least one kept token."""
    return article_stats.agg(F.countDistinct("id").alias("n_articles"))


def token_totals(article_stats: DataFrame) -> DataFrame:
    """(token, n, tf, num_articles) in one aggregate, combined before the shuffle.

    `tf` is summed without rounding, so that scores and ranks do not depend on how the rows are partitioned.
    """
    return article_stats.groupBy("token").agg(
        F.sum("n").alias("n"), S.exact_sum(F.col("tf")).alias("tf"), F.count("*").alias("num_articles")
    )


def document_frequency(article_stats: DataFrame) -> DataFrame:
    return article_stats.groupBy("token").agg(F.count("*").alias("num_articles"))


def with_idf(article_stats: DataFrame, token_stats_: DataFrame) -> DataFrame:
    """Adds the token's IDF to every article-token row."""
    return article_stats.join(token_stats_.select("token", "idf"), "token").select(*article_stats.columns, "idf")


def mean_tfidf(totals: DataFrame, n_articles: Column) -> DataFrame:
    """(token, mean_tfidf): the IDF is constant per token, so the summed tf is all it takes."""
    weight = S.tfidf(F.col("tf"), S.idf(F.col("num_articles"), n_articles))
    return totals.select("token", (weight / n_articles).alias("mean_tfidf"))


def minmax(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"))


def token_stats(article_stats: DataFrame) -> DataFrame:
    """(token, n, tf, num_articles, idf, mean_tfidf, ridf, adj_ridf), not ordered.

    The totals are written once, so the article table is read once for them and once, ids only, for
    the corpus size. The normalising constants are scalar subqueries over the much smaller totals.
    """
    n = F.col("n_articles")
    df = F.col("num_articles")
    scored = (
        staged(token_totals(article_stats), "token-totals")
        .withColumn("n_articles", num_articles(article_stats).scalar())
        .withColumn("idf", S.idf(df, n))
        .withColumn("mean_tfidf", S.tfidf(F.col("tf"), F.col("idf")) / n)
        .withColumn("ridf", S.ridf(F.col("n"), df, n))
        .drop("n_articles")
    )
    ends = scored.agg(
        F.struct(
            F.min("ridf").alias("low"), F.max("ridf").alias("high"), F.max("num_articles").alias("articles")
        ).alias("ends")
    ).scalar()
    weighed = scored.withColumn(
        "weighed",
        S.weigh_by_articles(S.scale_ridf(F.col("ridf"), ends["low"], ends["high"]), df, ends["articles"]),
    )
    top = weighed.agg(F.max("weighed").alias("top")).scalar()
    return weighed.withColumn("adj_ridf", F.try_divide(F.col("weighed"), top)).drop("weighed")


def sort_tokens(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.col("n").desc(), "token")
