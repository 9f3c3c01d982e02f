"""Token counts and statistics on a corpus small enough to check by hand."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import DATA, plan
from corpusloom.operators import stopwords, tokens
from corpusloom.operators.token_stats import num_articles, token_stats
from corpusloom.options import Options
from corpusloom.sources.articles import read_documents

ARTICLE_STATS = [
    (1, "gene", 3, 0.6), (1, "network", 2, 0.4), (2, "cell", 1, 0.25), (2, "gene", 1, 0.25),
    (2, "map", 2, 0.5), (3, "cell", 2, 0.666667), (3, "wall", 1, 0.333333),
]
TOKEN_STATS = [
    ("cell", 3, 2, 0.916667, 0.287682, 0.087903, -0.076766, 0.319252),
    ("gene", 4, 2, 0.850000, 0.287682, 0.081510, 0.143530, 0.767182),
    ("map", 2, 1, 0.500000, 0.693147, 0.115525, 0.545720, 1.0),
    ("network", 2, 1, 0.400000, 0.693147, 0.092420, 0.545720, 1.0),
    ("wall", 1, 1, 0.333333, 0.693147, 0.077016, -0.233776, 0.0),
]


def test_article_stats(micro):
    found = tokens.article_stats(micro, (), ["the"]).orderBy("id", "token").collect()
    assert [(r.id, r.token, r.n, round(r.tf, 6)) for r in found] == ARTICLE_STATS


def test_token_stats(micro):
    found = token_stats(tokens.article_stats(micro, (), ["the"])).orderBy("token").collect()
    for row, want in zip(found, TOKEN_STATS, strict=True):
        got = (row.token, row.n, row.num_articles, row.tf, row.idf, row.mean_tfidf, row.ridf, row.adj_ridf)
        assert got[:3] == want[:3]
        assert got[3:] == pytest.approx(want[3:], abs=1e-6)


def test_counting_by_row_equals_counting_by_group(spark):
    articles = read_documents(spark, DATA)
    stop = stopwords.stop_list()
    fused = tokens.article_stats(articles, (), stop)
    long = tokens.min_length(tokens.drop_stop_words(tokens.tokens(tokens.article_text(articles)), stop), 3)
    grouped = tokens.term_frequency(tokens.article_totals(tokens.count_tokens(long))).select("id", "token", "n", "tf")
    assert fused.exceptAll(grouped).isEmpty() and grouped.exceptAll(fused).isEmpty()


def test_article_stats_is_narrow(micro):
    assert "Exchange" not in plan(tokens.article_stats(micro, ["gene network"], ["the"]))


def test_repeated_articles_stay_separate_rows(micro):
    doubled = tokens.article_stats(micro.union(micro), (), ["the"])
    assert doubled.count() == 2 * len(ARTICLE_STATS)
    assert num_articles(doubled).first().n_articles == 3


def test_articles_without_tokens_have_no_rows(spark):
    df = spark.createDataFrame([(1, "the", None), (2, None, "a gene")], "id bigint, title string, abstract string")
    assert [r.id for r in tokens.article_stats(df, (), ["the"]).collect()] == [2]


def test_degenerate_scores_are_null(spark):
    same = spark.createDataFrame([(1, "a", 1, 1.0)], "id bigint, token string, n bigint, tf double")
    row = token_stats(same).first()
    assert row.ridf == pytest.approx(math.log2(1 - math.exp(-1)))
    assert row.adj_ridf is None
    empty = same.filter("n > 5")
    assert token_stats(empty).count() == 0


def test_unicode_tokens(spark):
    df = spark.createDataFrame([(1, "Naïve a² ½x_1 ΑΣ", "éte don't")], "id bigint, title string, abstract string")
    words = tokens.tokens(tokens.article_text(df)).collect()
    assert [r.token for r in words] == ["naïve", "a²", "½x_1", "ας", "e", "te", "don", "t"]


def test_stop_words(spark):
    words = stopwords.stop_list()
    assert len(words) == len(set(words))
    assert {"the", "00", "07", "100", "7", "q", "2029", "https", "study"} <= set(words)
    own = stopwords.stop_words(spark, spark.createDataFrame([("foo",), ("study",)], "word string"))
    assert own.count() == own.distinct().count() and own.filter("word = 'foo'").count() == 1
    lemmas = spark.createDataFrame([("studies", "study"), ("used", "use")], "word string, lemma string")
    lemmatized = {r.word for r in stopwords.lemmatized_stop_words(stopwords.stop_words(spark), lemmas).collect()}
    assert "studies" not in lemmatized and {"study", "https"} <= lemmatized


def test_stop_word_table_and_list_agree(spark, micro):
    long = tokens.tokens(tokens.article_text(micro))
    table = spark.createDataFrame([("the",), ("it's",)], "word string")
    by_join = tokens.drop_stop_words(long, table)
    by_list = tokens.drop_stop_words(long, ["the", "it's"])
    assert sorted(by_join.collect()) == sorted(by_list.collect())


def test_options():
    opts = Options.from_config({"corpus": "pubmed", "batches": {"start": 1000, "end": 1283}, "umap": {"n_neighbors": 7}})
    assert (opts.id_type, opts.batch_start, opts.batch_end, opts.n_neighbors) == ("bigint", 1000, 1283, 7)
    with pytest.raises(ValueError):
        Options(text_source="body")


def test_id_cast(micro):
    named = micro.withColumn("id", F.col("id").cast("string"))
    found = tokens.article_stats(named, (), ["the"], Options(id_type="bigint"))
    assert found.schema["id"].dataType.simpleString() == "bigint"
