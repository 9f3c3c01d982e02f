import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ranking, token_stats, vocabulary
from corpusloom.options import Options


def test_global_rank_over_many_partitions(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("v"))
    ranked = ranking.global_rank(df, [F.col("v").desc()], "place")
    assert ranked.filter(F.col("place") + F.col("v") != 5000).isEmpty() and ranked.count() == 5000


def test_ranks_do_not_depend_on_partitions_or_scale(spark):
    """Scores of tokens whose shares are equal in other orders are equal to the last digit, however small they are."""
    shares = [n / d for d in range(3, 60) for n in range(1, 4)]
    rows = [(a, f"t{k:02}", 1, shares[(7 * a + k // 5) % len(shares)]) for k in range(40) for a in range(170)]
    stats = spark.createDataFrame(rows, "id long, token string, n long, tf double")

    def ranks(df, factor=1.0):
        totals = token_stats.token_totals(df).select("token", (F.col("tf") * factor).alias("mean_tfidf"))
        return {r.token: r.tfidf_rank for r in ranking.rank_by(totals, "mean_tfidf").collect()}

    want = ranks(stats.coalesce(1))
    for parts in (2, 7, 40):
        assert ranks(stats.repartition(parts, F.rand(parts))) == want
    assert ranks(stats.repartition(5), 1e-9) == want
    exact = {}
    for _, token, _, tf in rows:
        exact[token] = exact.get(token, 0) + int(tf * (1 << 60))
    sums = {r.token: r.tf for r in token_stats.token_totals(stats).collect()}
    assert all(sums[t] == pytest.approx(v / (1 << 60), rel=1e-15) for t, v in exact.items())


def test_index_tokens_follow_code_points(spark):
    stats = spark.createDataFrame([("b",), ("Z",), ("é",), ("a",), ("b",)], "token string")
    codes = {r.token: r.code for r in ranking.index_tokens(stats).collect()}
    assert codes == {"Z": 0, "a": 1, "b": 2, "é": 3}


@pytest.mark.parametrize("k", [1, 37, 300, 301])
def test_sample_is_exact_and_reproducible(spark, k):
    # one id holds a third of all rows
    rows = [(i,) for i in range(300)] + [(5,)] * 150
    df = spark.createDataFrame(rows, "id bigint")
    order = sorted(range(300), key=lambda i: (hashlib.md5(f"9-{i}".encode()).hexdigest(), i))
    want = set(order[:k])
    for parts in (1, 7):
        found = ranking.sample_articles(df.repartition(parts), k, 9).collect()
        assert {r.id for r in found} == want
        assert len(found) == len(want) + (150 if 5 in want else 0)


@pytest.mark.parametrize("accuracy", [5, 100_000])
def test_exact_quantiles(spark, monkeypatch, accuracy):
    pd = pytest.importorskip("pandas")
    monkeypatch.setattr(ranking, "SKETCH_ACCURACY", accuracy)
    values = [((i * 7919) % 1009) / 7 for i in range(3000)] + [50.0] * 1500
    other = [float(i % 3) for i in range(4500)]
    df = spark.createDataFrame(list(zip(values, other)), "x double, y double")
    at = [0.0, 0.01, 0.25, 0.5, 0.995, 1.0]
    found = ranking.exact_quantiles(df, {"x": at, "y": at})
    assert found["x"] == pytest.approx([pd.Series(values).quantile(q) for q in at])
    assert found["y"] == pytest.approx([pd.Series(other).quantile(q) for q in at])


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "x double")
    assert ranking.exact_quantiles(df, {"x": [0.5]}) == {"x": [None]}


def tokens_table(spark, n):
    rows = [(f"t{i:03}", i % 17 + 1, (i * 31 % 101) / 101, (i * 57 % 97) / 97, i % 11 + 1) for i in range(n)]
    return spark.createDataFrame(
        rows, "token string, n bigint, mean_tfidf double, adj_ridf double, num_articles bigint"
    )


@pytest.mark.parametrize("n,dim", [(200, 20), (10, 20)])
def test_ensemble_equals_full_ranking(spark, n, dim):
    table = tokens_table(spark, n)
    rows = table.collect()
    best = {}
    for score in ("mean_tfidf", "adj_ridf"):
        for place, row in enumerate(sorted(rows, key=lambda r: (-r[score], r.token)), 1):
            best[row.token] = min(best.get(row.token, place), place)
    want = sorted(best, key=lambda t: (best[t], t))[:dim]
    found = vocabulary.ensemble_tokens(table, dim).orderBy("rank").collect()
    assert [r.token for r in found] == want
    ranked = ranking.min_rank(ranking.rank_by(ranking.rank_by(table, "mean_tfidf"), "adj_ridf"))
    assert {r.token: r.min_rank for r in ranked.collect()} == best


def test_short_vocabulary_gives_nulls(spark):
    opts = Options(embedding_dim=4, min_article_ratio=0.0, max_article_ratio=1.0)
    vocab = vocabulary.vocabulary(tokens_table(spark, 2), opts)
    listed = vocabulary.zip_ranked(vocab, 4).collect()
    assert [r.rank for r in listed] == [1, 2, 3, 4] and listed[2].ensemble is None


def test_count_vectors_agree(spark):
    words = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["x"]), (3, [])], "id bigint, words array<string>")
    vocab = spark.createDataFrame([("ridf", "b", 0), ("ridf", "a", 1)], "embedding string, token string, dim int")
    sparse = vocabulary.count_vectors(words, vocab, "ridf").orderBy("article_id").collect()
    assert [r.embedding.toArray().tolist() for r in sparse] == [[2, 1], [0, 0], [0, 0]]
    stats = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1)], "id bigint, token string, n bigint")
    counts = vocabulary.vocab_counts(stats, vocab)
    dense = vocabulary.dense_counts(words, counts, "ridf", 2).orderBy("article_id").collect()
    assert [r.embedding for r in dense] == [[2, 1], [0, 0], [0, 0]]
    missed = vocabulary.missed_articles(words, counts, ["ridf", "tfidf"])
    assert {r.embedding: r.missed for r in missed.collect()} == {"ridf": 2, "tfidf": 3}
