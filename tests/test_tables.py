"""Sources, sinks, the whole run and arriving batches."""

from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import DATA, plan
from corpusloom import staging
from corpusloom.operators import dense, stopwords, tokens, vocabulary
from corpusloom.options import Options
from corpusloom.plans.run_all import run_all, run_corpus
from corpusloom.sources import articles as A
from corpusloom.sources import feather, tables
from corpusloom.sources.feather import register_feather
from corpusloom.staging import stage_folder
from corpusloom.streaming.arrivals import append_article_stats


def test_batches_are_pruned(spark, micro, tmp_path):
    rows = micro.withColumn("batch", F.lpad(F.col("id").cast("string"), 4, "0"))
    rows = rows.union(micro.withColumn("batch", F.lit("12345")))
    A.write_batches(rows, f"{tmp_path}/b")
    found = A.read_batches(spark, f"{tmp_path}/b", 1, 2, "bigint")
    assert sorted(r.id for r in found.collect()) == [1, 2]
    assert "PartitionFilters: [isnotnull(batch" in plan(found)
    with pytest.raises(ValueError):
        A.require_rows(A.read_batches(spark, f"{tmp_path}/b", 7, 9, "bigint"))


def test_feather_round_trip(spark, tmp_path):
    import pandas as pd

    register_feather(spark)
    df = spark.range(1000).select("id", F.concat(F.lit("é"), "id").alias("s"), F.array(F.lit(1.5)).alias("v"))
    path = f"{tmp_path}/f"
    df.repartition(5).write.format("feather").mode("append").save(path)
    back = spark.read.format("feather").load(path)
    assert back.exceptAll(df).isEmpty() and back.count() == 1000
    df.limit(3).write.format("feather").mode("overwrite").save(path)
    assert spark.read.format("feather").load(path).count() == 3
    pd.DataFrame({"id": [1, 2], "c": pd.Categorical(["a", "b"])}).to_feather(f"{tmp_path}/one.feather")
    one = spark.read.format("feather").load(f"{tmp_path}/one.feather")
    assert sorted(tuple(r) for r in one.collect()) == [(1, "a"), (2, "b")]


def test_feather_on_the_default_file_system(spark, tmp_path, monkeypatch):
    """A path without a scheme, several files a task, append and overwrite, files of other columns."""
    monkeypatch.setattr(feather, "FILE_BYTES", 2000)
    df = spark.range(70_000).select("id", F.concat(F.lit("é"), "id").alias("s"), F.array(F.lit(1.5), F.lit(None)).alias("v"), F.struct(F.col("id").alias("k")).alias("t"))
    path = str(tmp_path / "f")
    feather.write_feather(df.repartition(3), path)
    names = sorted(f.name for f in (tmp_path / "f").iterdir() if not f.name.startswith("."))
    assert len(names) > 3 and all(n.endswith(".feather") for n in names)
    back = feather.read_feather(spark, path)
    assert back.exceptAll(df).isEmpty() and back.count() == 70_000
    with pytest.raises(ValueError, match="exists"):
        feather.write_feather(df, path)
    feather.write_feather(df.limit(5), path, "append")
    assert feather.read_feather(spark, path).count() == 70_005
    feather.write_feather(df.limit(7), path, "overwrite")
    assert feather.read_feather(spark, path).count() == 7
    pd.DataFrame({"id": [1, 2], "c": pd.Categorical(["a", "b"])}).to_feather(f"{tmp_path}/one.feather")
    assert sorted(tuple(r) for r in feather.read_feather(spark, f"{tmp_path}/one.feather").collect()) == [(1, "a"), (2, "b")]
    pd.DataFrame({"id": [1, 2], "c": ["a", "b"], "more": [1, 2]}).to_feather(f"{path}/two.feather")
    with pytest.raises(Exception, match="has other columns than"):
        feather.read_feather(spark, path).collect()
    failing = df.select(F.when(F.col("id") == 999, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        feather.write_feather(failing, str(tmp_path / "g"))
    assert not (tmp_path / "g").exists() or not [f for f in (tmp_path / "g").iterdir() if not f.name.startswith(".")]
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no feather files"):
        feather.read_feather(spark, str(tmp_path / "empty"))


def test_ngram_list_order(spark, tmp_path):
    (tmp_path / "n.txt").write_text("b c d\na b\n\nz z\n", encoding="utf-8")
    found = tables.read_ngrams(spark, str(tmp_path / "n.txt"))
    assert tables.ngram_list(found) == ["b c d", "a b", "z z"]


def test_lines_of_many_splits_are_numbered_in_order(spark, tmp_path):
    """Several files of several splits each, with empty lines and carriage returns."""
    values = [f"n-gram {k}" + ("\r" if k % 50 == 0 else "") if k % 11 else "" for k in range(4000)]
    for part in range(4):
        (tmp_path / f"part-{part:05}.txt").write_bytes("".join(v + "\n" for v in values[part * 1000 : part * 1000 + 1000]).encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "2k")
    try:
        lines = tables.read_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 12
        assert [r.value for r in lines.orderBy("pos").collect()] == values
        assert sorted(r.pos for r in lines.collect()) == list(range(4000))
        listed = tables.read_ngrams(spark, str(tmp_path)).orderBy("pos").collect()
        assert [(r.pos, r.ngram) for r in listed] == [(k, v) for k, v in enumerate(values) if v]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_lines_keep_their_order(spark, tmp_path):
    df = spark.range(500).select(F.format_string("%04d", "id").alias("v")).repartition(9)
    tables.write_lines(df, f"{tmp_path}/l", ["v"], one_file=True)
    assert [r.value for r in spark.read.text(f"{tmp_path}/l").collect()] == [f"{i:04}" for i in range(500)]


def test_stage_folder_is_the_shared_one(spark, monkeypatch):
    assert spark.sparkContext.applicationId in stage_folder(spark) or "corpusloom-" in stage_folder(spark)


def test_staged_tables_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "stage_folder", lambda _: str(tmp_path / "app"))
    assert staging.staged(spark.range(5), "five").count() == 5 and len(list((tmp_path / "app").iterdir())) == 1
    staging.clear_stage(spark)
    assert not (tmp_path / "app").exists()
    assert staging.staged(spark.range(3), "three").count() == 3


def test_run_all_and_arrivals(spark, tmp_path):
    articles = A.read_documents(spark, DATA)
    stop = stopwords.stop_list()
    opts = Options(
        token_min_freq=20, subsample_num_articles=150, token_min_cor=0.5, ngram_min_freq=3, min_article_ratio=0.01,
        embedding_dim=16, num_clusters=4, raster_width=20, raster_height=20, id_type="bigint",
    )
    known = spark.createDataFrame([(0, "der die")], "pos int, ngram string")
    made = run_all(spark, articles, known, stop, dense.hash_encoder(4), f"{tmp_path}/run", opts)
    assert made["stats/articles"].count() == tokens.article_stats(articles, ["der die"], stop, opts).count()
    for kind in ("frequency", "tfidf", "ridf", "ensemble", "encoded"):
        assert made[f"clusters/{kind}"].count() in (200, made["embeddings/encoded"].count())
        assert made[f"figures/{kind}"].count() > 0
    listed = tables.read_ngrams(spark, f"{tmp_path}/run/ngrams/ngrams")
    assert "der die" in tables.ngram_list(listed)
    dense_rows = vocabulary.dense_counts(articles, made["embeddings/counts"], "ensemble", 16).collect()
    sparse_rows = {r.article_id: list(r.embedding.toArray()) for r in made["embeddings/vectors/ensemble"].collect()}
    assert {r.article_id: list(r.embedding) for r in dense_rows} == sparse_rows
    assert made["neighbours/encoded"].count() == 15 * made["embeddings/encoded"].count()

    A.write_batches(articles, f"{tmp_path}/corpus/lemmatized")
    some = replace(opts, processing="lemmatized", batch_start=2, batch_end=2, n_neighbors=3, metric="jaccard", token_min_freq=5)
    part = run_corpus(spark, f"{tmp_path}/corpus", known, stop, dense.hash_encoder(4), f"{tmp_path}/part", some)
    n = articles.filter("batch = '0002'").count()
    assert 0 < n < 200 and part["clusters/tfidf"].count() == n and part["neighbours/encoded"].count() == 3 * n

    A.write_batches(articles, f"{tmp_path}/in")
    for _ in range(2):
        query = append_article_stats(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", (), stop, opts)
        query.awaitTermination()
    stats = tokens.article_stats(articles, (), stop, opts)
    found = spark.read.parquet(f"{tmp_path}/out").select("id", "token", "n", "tf")
    assert found.count() == stats.count() and found.exceptAll(stats).isEmpty()


def test_feather_files_and_batches_are_small(spark, tmp_path):
    """A reading task holds a whole file, so files are small however much a task writes."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.range(0, 60, 1, 1).select("id", F.repeat(F.lit("x"), 1 << 20).alias("s"))
    feather.write_feather(df, str(tmp_path / "f"))
    sizes = [f.stat().st_size for f in (tmp_path / "f").glob("*.feather")]
    assert len(sizes) >= 3 and max(sizes) < 32 << 20
    assert feather.read_feather(spark, str(tmp_path / "f")).agg(F.sum("id"), F.sum(F.length("s"))).first()[:] == (1770, 60 << 20)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20


def test_counts_are_written_by_rows(spark, tmp_path, monkeypatch):
    """One kind of embedding, whose rows compress well, is not one task's."""
    monkeypatch.setattr(tables, "COUNT_ROWS", 100)
    counts = spark.range(1000).select(F.lit("tfidf").alias("embedding"), F.col("id").alias("article_id"), F.lit(1).alias("dim"), F.lit(2).cast("bigint").alias("n"))
    tables.write_counts(counts, str(tmp_path / "c"))
    assert len(list((tmp_path / "c" / "embedding=tfidf").glob("*.parquet"))) >= 5
    assert tables.read_counts(spark, str(tmp_path / "c"), "bigint").select(counts.columns).exceptAll(counts).isEmpty()
