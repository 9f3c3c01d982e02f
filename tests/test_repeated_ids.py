"""Repeated article ids and long sentences through n-grams, count vectors, encodings and clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import clusters, dense, ngrams, vocabulary
from corpusloom.options import Options


@pytest.mark.parametrize("strategy", ["inline", "equi", "loop", "auto"])
def test_frequency_counts_rows(spark, strategy):
    texts = spark.createDataFrame([(1, "gene map here"), (1, "a gene map"), (2, "xgene mapping of"), (3, "gene-map")], "id long, text string")
    candidates = spark.createDataFrame([("gene map",), ("gene map here",), ("ene mapping o",), ("-",), ("map gene",), ("gene map",)], "ngram string")
    found = ngrams.match_ngrams(texts, candidates, strategy)
    assert sorted(map(tuple, found.collect())) == [
        (1, "gene map"), (1, "gene map"), (1, "gene map here"), (2, "ene mapping o"), (2, "gene map"), (3, "-"),
    ]
    freq = {r.ngram: r.freq for r in ngrams.ngram_document_frequency(texts, candidates.distinct(), strategy).collect()}
    assert freq == {"gene map": 3, "gene map here": 1, "ene mapping o": 1, "-": 1, "map gene": 0}


def test_odd_candidates_do_not_put_pairs_into_a_loop(spark):
    texts = spark.createDataFrame([(1, "gene map here")], "id long, text string")
    candidates = spark.createDataFrame([("gene map",), ("gene map here",)], "ngram string")
    plan = ngrams.match_ngrams(texts, candidates, "equi").filter(F.size(F.split("ngram", " ")) == 2)
    assert "Cartesian" not in plan._jdf.queryExecution().executedPlan().toString()


def test_count_vectors_of_repeated_ids_keep_their_length(spark):
    articles = spark.createDataFrame([(1, "0001"), (1, "0002"), (2, "0001")], "id long, batch string")
    counts = spark.createDataFrame(
        [("tfidf", 1, 0, 1), ("tfidf", 1, 0, 2), ("tfidf", 1, 2, 1), ("tfidf", 2, 1, 5)], "embedding string, article_id long, dim int, n long"
    )
    got = sorted((r.article_id, r.embedding) for r in vocabulary.dense_counts(articles, counts, "tfidf", 3).collect())
    assert got == [(1, [3.0, 0.0, 1.0]), (1, [3.0, 0.0, 1.0]), (2, [0.0, 5.0, 0.0])]


def test_the_last_batch_wins_however_rows_are_dealt(spark):
    rows = [(i, f"{b:04d}", f"Title {i} {b}", "One. Two.") for i in range(40) for b in (2, 10, 1)]
    articles = spark.createDataFrame(rows, "id long, batch string, title string, abstract string")
    want = {r.article_id: r.embedding for r in dense.encode_articles(articles.where("batch = '0010'"), dense.hash_encoder(4)).collect()}
    for parts in (1, 5):
        encoded = dense.encode_articles(articles.repartition(parts, "title"), dense.hash_encoder(4))
        combined = dense.combine_embeddings(encoded, order=["batch"])
        assert combined.columns == ["article_id", "embedding"]
        assert {r.article_id: r.embedding for r in combined.collect()} == want


def test_windows_pool_every_token(spark):
    texts = spark.createDataFrame([(1, "a b c d e f g. h i"), (2, ""), (3, "x " * 600)], "id long, text string")
    whole = {r.article_id: r.embedding for r in dense.encode_texts(texts, dense.hash_encoder(4), 10_000).collect()}
    for length in (1, 3, 512):
        cut = {r.article_id: r.embedding for r in dense.encode_texts(texts, dense.hash_encoder(4), length).collect()}
        assert all(np.allclose(cut[i], whole[i]) for i in whole)
    limited = dense.encode_articles(
        texts.select("id", F.col("text").alias("title"), F.col("text").alias("abstract")), dense.hash_encoder(4), Options(encoder_max_length=2)
    )
    assert limited.count() == 3


def test_clusters_do_not_depend_on_the_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(3 * (i % 4), 1.5, 5).tolist()) for i in range(300)]
    emb = spark.createDataFrame(rows, "article_id long, embedding array<double>")
    found = []
    for parts in (1, 3, 8):
        got = clusters.cluster_articles(emb.repartition(parts), 4, seed=5).collect()
        found.append(sorted((r.article_id, r.cluster) for r in got))
    assert found[0] == found[1] == found[2]
    first = {}
    for i, c in found[0]:
        first.setdefault(c, i)
    assert [c for c, _ in sorted(first.items(), key=lambda p: p[1])] == sorted(first)
