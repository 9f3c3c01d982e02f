"""Compact vocabularies and the count embeddings built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.vectors import dense
from corpusloom.operators.ranking import top_tokens
from corpusloom.options import Options
from corpusloom.staging import staged

KINDS = ("frequency", "tfidf", "ridf", "ensemble")


def corpus_size(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count("*").alias("n_articles"))


def filter_vocab(tokens: DataFrame, n_articles: Column | int, low: float, high: float) -> DataFrame:
    """Tokens found in at least `low` and at most `high` of all articles, both included."""
    n = F.lit(n_articles) if isinstance(n_articles, int) else n_articles
    return tokens.filter(F.col("num_articles").between(F.lit(low) * n, F.lit(high) * n))


def ensemble_tokens(tokens: DataFrame, dim: int) -> DataFrame:
    """(rank, token) of the `dim` tokens with the best of their two ranks.

    A token this good is in the first `dim` of one of the two lists, so the two top lists suffice.
    """
    lists = top_tokens(tokens, "mean_tfidf", dim).unionByName(top_tokens(tokens, "adj_ridf", dim))
    best = lists.groupBy("token").agg(F.min("rank").alias("min_rank"))
    return top_tokens(best, "min_rank", dim, ascending=True)


def vocabulary(tokens: DataFrame, opts: Options = Options()) -> DataFrame:
    """(embedding, token, dim): the tokens behind each kind of count embedding, dim from 0."""
    d = opts.embedding_dim
    lists = {
        "frequency": top_tokens(tokens, "n", d),
        "tfidf": top_tokens(tokens, "mean_tfidf", d),
        "ridf": top_tokens(tokens, "adj_ridf", d),
        "ensemble": ensemble_tokens(tokens, d),
    }
    parts = [
        top.select(F.lit(kind).alias("embedding"), "token", (F.col("rank") - 1).alias("dim"))
        for kind, top in lists.items()
    ]
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def zip_ranked(vocab: DataFrame, dim: int) -> DataFrame:
    """(rank, frequency, tfidf, ridf, ensemble), null where a list is shorter than `dim`."""
    by_kind = [F.max(F.when(F.col("embedding") == kind, F.col("token"))).alias(kind) for kind in KINDS]
    filled = vocab.groupBy((F.col("dim") + 1).alias("rank")).agg(*by_kind)
    ranks = vocab.sparkSession.range(1, dim + 1).select(F.col("id").cast("int").alias("rank"))
    return ranks.join(filled, "rank", "left").orderBy("rank")


def listed_tokens(listed: DataFrame) -> DataFrame:
    """(embedding, token, dim) from the table of ranks that `zip_ranked` gives."""
    long = listed.unpivot("rank", list(KINDS), "embedding", "token").filter("token is not null")
    return long.select("embedding", "token", (F.col("rank") - 1).alias("dim"))


def vocab_counts(article_stats: DataFrame, vocab: DataFrame) -> DataFrame:
    """(embedding, article_id, dim, n) for the selected tokens; all kinds in one join.

    The vocabulary has at most four times `embedding_dim` rows, so it is broadcast.
    """
    return article_stats.join(F.broadcast(vocab), "token").select(
        "embedding", F.col("id").alias("article_id"), "dim", "n"
    )


def missed_articles(articles: DataFrame, counts: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """(embedding, missed): articles in which no selected token occurs."""
    kept = counts.groupBy("embedding").agg(F.countDistinct("article_id").alias("kept"))
    names = articles.sparkSession.createDataFrame([(k,) for k in kinds], "embedding string")
    total = articles.agg(F.countDistinct("id").alias("n")).scalar()
    return names.join(kept, "embedding", "left").select(
        "embedding", (total - F.coalesce("kept", F.lit(0))).alias("missed")
    )


def count_vectors(words: DataFrame, vocab: DataFrame, kind: str) -> DataFrame:
    """(article_id, embedding) as sparse vectors straight from (id, words), zero rows included.

    The vocabulary is one short list, and each article is vectorised in its own row.
    """
    listed = [r.token for r in vocab.filter(F.col("embedding") == kind).orderBy("dim").select("token").collect()]
    model = CountVectorizerModel.from_vocabulary(listed, inputCol="words", outputCol="embedding")
    return model.transform(words).select(F.col("id").alias("article_id"), "embedding")


def dense_counts(articles: DataFrame, counts: DataFrame, kind: str, dim: int) -> DataFrame:
    """(article_id, embedding array<double>) from the coordinate form, zero rows included."""
    rows = (
        counts.filter(F.col("embedding") == kind)
        .groupBy("article_id", "dim")
        .agg(F.sum("n").alias("n"))  # an article in several batches has a token several times
        .groupBy("article_id")
        .agg(F.sort_array(F.collect_list(F.struct("dim", "n"))).alias("entries"))
    )
    none = F.array().cast("array<struct<dim:int,n:bigint>>")
    return (
        articles.select(F.col("id").alias("article_id"))
        .join(rows, "article_id", "left")
        .select("article_id", dense(F.coalesce("entries", none), dim).alias("embedding"))
    )


def stat_embeddings(
    articles: DataFrame, article_stats: DataFrame, token_stats: DataFrame, opts: Options = Options()
) -> tuple[DataFrame, DataFrame]:
    """The four count embeddings in coordinate form, and the table of their tokens."""
    n = corpus_size(articles).scalar()
    selected = filter_vocab(token_stats, n, opts.min_article_ratio, opts.max_article_ratio)
    vocab = staged(vocabulary(selected, opts), "vocabulary")
    return vocab_counts(article_stats, vocab), zip_ranked(vocab, opts.embedding_dim)
