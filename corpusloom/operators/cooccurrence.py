"""Which tokens occur in the same articles, and how strongly they are correlated."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scores import phi
from corpusloom.operators.ranking import index_tokens, sample_articles
from corpusloom.options import Options
from corpusloom.staging import staged

PAIR_SCHEMA = "token1 string, token2 string, k bigint"
BLOCK_ARTICLES = 4096
BLOCK_TOKENS = 1024
BLOCK_CELLS = 1 << 25
TILE_TOKENS = 1024

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def target_tokens(token_stats: DataFrame, min_freq: int) -> DataFrame:
    return token_stats.filter(F.col("n") >= min_freq).select("token")


def semi_join_tokens(article_stats: DataFrame, targets: DataFrame) -> DataFrame:
    return article_stats.select("id", "token").join(targets.select("token"), "token", "left_semi").select("id", "token")


def semi_join_articles(article_stats: DataFrame, sample: DataFrame) -> DataFrame:
    return article_stats.select("id", "token").join(sample.select("id"), "id", "left_semi").select("id", "token")


def presence(article_stats: DataFrame, targets: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct (id, token) of the target tokens; one boolean column per token for those a caller lists as `columns`."""
    long = semi_join_tokens(article_stats, targets).distinct()
    if columns is None:
        return long
    return long.groupBy("id").pivot("token", list(columns)).agg(F.lit(True)).fillna(False)


def presence_codes(presence_: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, codes): a row's tokens as rising codes of the dictionary (token, code), the sparse form of the wide table for any number of tokens."""
    coded = presence_.join(dictionary.select("token", "code"), "token")
    return coded.groupBy("id").agg(F.sort_array(F.collect_set("code")).alias("codes"))


def token_cooccurrence(article_stats: DataFrame, token_stats: DataFrame, opts: Options = Options()) -> DataFrame:
    """Presence of frequent tokens, in a seeded sample of the articles that have any if the options ask for one.

    The targets are written first: their true size decides whether the big table has to move. The
    presence rows are written because a sample reads them three times.
    """
    targets = staged(target_tokens(token_stats, opts.token_min_freq), "targets")
    long = staged(presence(article_stats, targets), "presence")
    return sample_articles(long, opts.subsample_num_articles, opts.random_seed)


def _block_pairs(batches: Iterator) -> Iterator:
    """Pair counts of bounded blocks of articles, as a product of presence matrices."""
    import numpy as np
    import pyarrow as pa

    def counted(lists):
        codes = lists.flatten().dictionary_encode()
        names = np.array(codes.dictionary.to_pylist(), dtype=object)
        order = np.argsort(names)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        # columns in token order, so the upper triangle holds the pairs with token1 <= token2
        seen = np.zeros((len(lists), len(names)), dtype=np.float32)
        seen[rows, place[codes.indices.to_numpy()]] = 1
        names = pa.array(names[order].tolist(), type=pa.string())
        for a in range(0, len(names), BLOCK_TOKENS):
            left = seen[:, a : a + BLOCK_TOKENS].T
            for b in range(a, len(names), BLOCK_TOKENS):
                both = left @ seen[:, b : b + BLOCK_TOKENS]
                i, j = np.nonzero(both)
                upper = i + a < j + b
                i, j = i[upper], j[upper]
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(i + a)), names.take(pa.array(j + b)), pa.array(both[i, j].astype(np.int64))],
                    names=["token1", "token2", "k"],
                )

    def blocks():
        kept, n = [], 0
        for batch in batches:
            kept.append(batch.column(0))
            n += batch.num_rows
            if n >= BLOCK_ARTICLES:
                yield pa.chunked_array(kept).combine_chunks()
                kept, n = [], 0
        if kept:
            yield pa.chunked_array(kept).combine_chunks()

    for lists in blocks():
        distinct = max(1, len(lists.flatten().unique()))
        step = max(1, BLOCK_CELLS // distinct)
        for start in range(0, len(lists), step):
            yield from counted(lists.slice(start, step))


def token_pairs(presence_: DataFrame) -> DataFrame:
    """(token1, token2, k): articles that have both tokens, for token1 < token2 and k > 0.

    An article's tokens are gathered once (they are target tokens, so the set is bounded); blocks of
    articles are multiplied out in Arrow batches and their counts summed on both sides of the
    shuffle. Pairs are never listed per article.
    """
    baskets = presence_.groupBy("id").agg(F.collect_set("token").alias("tokens"))
    partial = baskets.select("tokens").mapInArrow(_block_pairs, PAIR_SCHEMA)
    return partial.groupBy("token1", "token2").agg(F.sum("k").alias("k"))


def all_token_pairs(counts: DataFrame) -> DataFrame:
    """(token1, token2) with token1 < token2 of all tokens, from triangular tiles over their codes.

    A tile pair is one group of at most `TILE_TOKENS` squared pairs; a token is copied once per tile, never gathered with all others.
    """
    coded = staged(index_tokens(counts).withColumn("tile", F.floor(F.col("code") / TILE_TOKENS).cast("int")), "coded-tokens")
    last = coded.agg(F.coalesce(F.max("tile"), F.lit(0))).first()[0]
    rows = coded.select(F.col("token").alias("token1"), F.col("code").alias("code1"), F.col("tile").alias("row"), F.explode(F.sequence("tile", F.lit(last))).alias("column"))
    columns = coded.select(F.col("token").alias("token2"), F.col("code").alias("code2"), F.col("tile").alias("column"), F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("row"))
    return rows.join(columns, ["row", "column"]).where("code1 < code2").select("token1", "token2")


def token_correlations(presence_: DataFrame, all_pairs: bool = False) -> DataFrame:
    """(token1, token2, cor) for token1 < token2, null when a token is in every article.

    Pairs that never meet have a correlation of at most 0; `all_pairs` lists them as well. The counts
    per token are written first, so that Spark knows how small they are next to the pairs.
    """
    counts = staged(presence_.groupBy("token").agg(F.count("*").alias("c")), "token-counts")
    pairs = token_pairs(presence_)
    if all_pairs:
        pairs = all_token_pairs(counts).join(pairs, ["token1", "token2"], "left").fillna(0, ["k"])
    n_articles = presence_.agg(F.countDistinct("id").alias("n_articles")).scalar()
    first = counts.select(F.col("token").alias("token1"), F.col("c").alias("c1"))
    second = counts.select(F.col("token").alias("token2"), F.col("c").alias("c2"))
    cor = phi(n_articles, F.col("k"), F.col("c1"), F.col("c2"))
    return pairs.join(first, "token1").join(second, "token2").select("token1", "token2", cor.alias("cor"))


def upper_triangle(correlations: DataFrame, tokens: Sequence[str] | None = None) -> DataFrame:
    """(token1, token2, cor) with token1 < token2, from a wide matrix (`token` + columns) or a long one."""
    if "token" in correlations.columns:
        columns = list(tokens) if tokens is not None else [c for c in correlations.columns if c != "token"]
        correlations = correlations.unpivot("token", columns, "token2", "cor").withColumnRenamed("token", "token1")
    return correlations.filter("token1 < token2").select("token1", "token2", "cor")


def correlated_token_pairs(correlations: DataFrame, min_cor: float = 0.15) -> DataFrame:
    """Pairs at or above the cutoff; undefined correlations do not pass."""
    return upper_triangle(correlations).filter(F.col("cor") >= min_cor)
