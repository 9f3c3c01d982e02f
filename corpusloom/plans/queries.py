"""One query per operator over the provided tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import scores as S
from corpusloom.functions import text as X
from corpusloom.functions import vectors as V
from corpusloom.functions.sql import register_functions
from corpusloom.operators import (
    clusters,
    cooccurrence,
    dense,
    keys,
    neighbours,
    ngrams,
    projection,
    ranking,
    raster,
    stopwords,
    tokens,
    vocabulary,
)
from corpusloom.operators import token_stats as stats
from corpusloom.options import Options
from corpusloom.plans.run_all import run_all
from corpusloom.sources import articles as A
from corpusloom.sources import feather, tables
from corpusloom.staging import spread, stage_path, staged

Query = Callable[[SparkSession, str], DataFrame]

# n-grams of the provided texts; the first is longer than its parts, the last two overlap
NGRAMS = ["der die das", "eriner thanea", "der die", "sch der", "der ein", "of the", "the of"]
LEMMAS = [("studies", "study"), ("used", "use"), ("using", "use"), ("values", "value"), ("has", "have"),
          ("had", "have"), ("was", "be"), ("were", "be"), ("is", "be"), ("are", "be"), ("its", "it"), ("methods", "method")]
WIDE_TOKENS = ["der", "die", "sch", "les", "que"]
ENCODER_DIM = 8
VECTOR_DIM = 64
CLIP = 0.99


def r6(column: str | F.Column) -> F.Column:
    name = column if isinstance(column, str) else None
    rounded = F.round(F.col(column) if name else column, 6)
    return rounded.alias(name) if name else rounded


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(c) if t == "double" else F.col(c) for c, t in df.dtypes))


class Inputs:
    """The pipeline's tables, derived from one folder of the provided data."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def opts(self) -> Options:
        n = self.table("documents").count()
        return Options(
            token_min_freq=n // 10,
            token_min_cor=0.5,
            ngram_min_freq=n // 100,
            min_article_ratio=0.01,
            embedding_dim=64,
            raster_width=50,
            raster_height=50,
            clip_quantile=CLIP,
        )

    @cached_property
    def sample_size(self) -> int:
        """Half of the articles, for the two queries that show the sample itself."""
        return self.table("documents").count() // 2

    @cached_property
    def articles(self) -> DataFrame:
        return A.read_documents(self.spark, self.folder)

    @cached_property
    def gaps(self) -> DataFrame:
        """Articles with missing parts: empty abstracts and one-word titles become null."""
        return self.articles.withColumns(
            {
                "abstract": F.nullif("abstract", F.lit("")),
                "title": F.when(F.contains("title", F.lit(" ")), F.col("title")),
            }
        )

    @cached_property
    def texts(self) -> DataFrame:
        return tokens.article_text(self.articles).select("id", "batch", "text")

    @cached_property
    def stop(self) -> DataFrame:
        return stopwords.stop_words(self.spark)

    @cached_property
    def stop_list(self) -> list[str]:
        return stopwords.stop_list()

    def fresh_stats(self, opts: Options = Options(), keep=()) -> DataFrame:
        return tokens.article_stats(self.articles, (), self.stop_list, opts, keep)

    @cached_property
    def article_stats(self) -> DataFrame:
        return staged(self.fresh_stats(), "article-stats")

    @cached_property
    def batch_stats(self) -> DataFrame:
        return staged(self.fresh_stats(keep=["batch"]), "batch-stats")

    @cached_property
    def token_stats(self) -> DataFrame:
        return staged(stats.token_stats(self.article_stats), "token-stats")

    @cached_property
    def tfidf(self) -> DataFrame:
        """(id, token, weight) of all terms of the articles."""
        idf = staged(self.token_stats.select("token", "idf"), "idf")
        return staged(self.article_stats.join(idf, "token").select("id", "token", (F.col("tf") * F.col("idf")).alias("weight")), "tfidf")

    @cached_property
    def n_articles(self) -> F.Column:
        return stats.num_articles(self.article_stats).scalar()

    @cached_property
    def targets(self) -> DataFrame:
        found = cooccurrence.target_tokens(stats.token_totals(self.article_stats), self.opts.token_min_freq)
        return staged(found, "targets")

    @cached_property
    def presence(self) -> DataFrame:
        return staged(cooccurrence.presence(self.article_stats, self.targets), "presence")

    @cached_property
    def correlations(self) -> DataFrame:
        return staged(cooccurrence.token_correlations(self.presence), "correlations")

    @cached_property
    def pairs(self) -> DataFrame:
        return cooccurrence.correlated_token_pairs(self.correlations, self.opts.token_min_cor)

    @cached_property
    def candidates(self) -> DataFrame:
        return staged(ngrams.ngram_candidates(self.pairs), "candidates")

    @cached_property
    def ngram_counts(self) -> DataFrame:
        return staged(ngrams.ngram_document_frequency(self.texts, self.candidates), "ngram-counts")

    @cached_property
    def known(self) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(NGRAMS)), "pos int, ngram string")

    @cached_property
    def vocab_tokens(self) -> DataFrame:
        n = vocabulary.corpus_size(self.articles).scalar()
        return vocabulary.filter_vocab(self.token_stats, n, self.opts.min_article_ratio, self.opts.max_article_ratio)

    @cached_property
    def vocab(self) -> DataFrame:
        return staged(vocabulary.vocabulary(self.vocab_tokens, self.opts), "vocabulary")

    @cached_property
    def counts(self) -> DataFrame:
        return vocabulary.vocab_counts(self.article_stats, self.vocab)

    @cached_property
    def embeddings(self) -> DataFrame:
        e = spread(self.table("embeddings"))
        return e.select(F.col("vec_id").alias("article_id"), V.doubles(F.col("embedding")).alias("embedding"), "label")

    @cached_property
    def flat_embeddings(self) -> DataFrame:
        """Embeddings in which the articles of label 0 have constant vectors."""
        flat = F.transform("embedding", lambda _: F.get("embedding", F.lit(0)))
        return self.embeddings.withColumn("embedding", F.when(F.col("label") == 0, flat).otherwise(F.col("embedding")))

    @cached_property
    def points(self) -> DataFrame:
        xy = [F.get("embedding", F.lit(i)).alias(f"x{i + 1}") for i in (0, 1)]
        return self.embeddings.select("article_id", *xy)

    @cached_property
    def clusters(self) -> DataFrame:
        return self.embeddings.select("article_id", X.cluster_label(F.col("label"), 10).alias("cluster"))

    @cached_property
    def clustered(self) -> DataFrame:
        return raster.with_cluster(self.points, self.clusters)

    @cached_property
    def bounds(self) -> DataFrame:
        return raster.clip_bounds(self.points, CLIP)

    @cached_property
    def raster(self) -> DataFrame:
        return raster.bin_points(self.clustered, self.opts.raster_width, self.opts.raster_height, self.bounds)

    @cached_property
    def token_vectors(self) -> DataFrame:
        i = F.col("article_id")
        return self.embeddings.select(
            F.floor(i / 25).alias("article_id"),
            F.floor(i / 5).cast("int").alias("sent"),
            (i % 5).cast("int").alias("pos"),
            (i % 7 != 0).cast("int").alias("mask"),
            F.col("embedding").alias("vec"),
        )

    def lines(self, df: DataFrame, order=(), one_file: bool = False) -> str:
        path = stage_path(self.spark, "lines")
        tables.write_lines(df, path, order, one_file)
        return path


REGISTRY: dict[str, Query] = {}


def query(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    REGISTRY[fn.__name__] = lambda spark, folder: fn(Inputs(spark, folder))
    return fn


def entries(emb: DataFrame, *keys_: str) -> DataFrame:
    """Vectors as one row per entry, for comparison."""
    long = emb.select(*keys_, F.posexplode("embedding").alias("dim", "value"))
    return long.withColumn("value", F.round("value", 6))


# sources and sinks


@query
def s01_batch_scan(i: Inputs):
    path = stage_path(i.spark, "batches")
    A.write_batches(i.articles, path)
    found = A.read_batches(i.spark, path, 3, 7, "bigint")
    return found.select("id", "title", F.length("abstract").alias("abstract_chars"), "batch")


@query
def s02_corpus_scan(i: Inputs):
    path = stage_path(i.spark, "corpus")
    tables.write_table(i.articles.drop("batch").withColumn("processing", F.lit("raw")), path, by="processing")
    found = A.read_corpus(i.spark, path, "raw", "bigint")
    return found.select("id", "title", F.length("abstract").alias("abstract_chars"))


@query
def s03_processing_choice(i: Inputs):
    path = stage_path(i.spark, "corpus")
    raw = i.articles.drop("batch").withColumn("processing", F.lit("raw"))
    other = raw.withColumns({c: F.lower(c) for c in ("title", "abstract")}).withColumn("processing", F.lit("lemmatized"))
    for level in (raw, other):
        tables.write_table(level, path, mode="append", by="processing")
    return A.read_corpus(i.spark, path, "lemmatized", "bigint").select("id", "title")


@query
def s04_feather_source(i: Inputs):
    path = stage_path(i.spark, "feather")
    feather.write_feather(i.articles, path)
    found = feather.read_feather(i.spark, path)
    return found.select("id", "title", F.length("abstract").alias("abstract_chars"), "batch")


@query
def s05_parquet_source(i: Inputs):
    return tables.read_table(i.spark, f"{i.folder}/documents.parquet").select("doc_id", "lang", "n_chars")


@query
def s06_ngram_list(i: Inputs):
    titles = i.articles.select(F.lower("title").alias("ngram")).filter(F.contains("ngram", F.lit(" "))).distinct()
    return tables.read_ngrams(i.spark, i.lines(titles, ["ngram"]))


@query
def s07_count_source(i: Inputs):
    path = stage_path(i.spark, "counts")
    tables.write_counts(i.counts, path)
    sizes = tables.read_counts(i.spark, path, "bigint").groupBy("article_id", "embedding").agg(F.sum("n").alias("n"))
    listed = i.articles.select(F.col("id").alias("article_id"), F.explode(F.lit(list(vocabulary.KINDS))).alias("embedding"))
    return listed.join(sizes, ["article_id", "embedding"], "left").fillna(0, ["n"])


@query
def s08_parquet_sink(i: Inputs):
    path = stage_path(i.spark, "table")
    tables.write_table(i.fresh_stats(), path)
    return rounded(tables.read_table(i.spark, path))


@query
def s09_append_sink(i: Inputs):
    path = stage_path(i.spark, "appended")
    first = F.col("batch") <= "0005"
    for part in (first, ~first):
        batch = tokens.article_stats(i.articles.filter(part), (), i.stop_list, keep=["batch"])
        tables.write_table(batch, path, mode="append", by="batch")
    schema = "id bigint, token string, n bigint, tf double, batch string"
    found = tables.read_table(i.spark, path, schema)
    return found.groupBy("batch").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))


@query
def s10_feather_sink(i: Inputs):
    path = stage_path(i.spark, "feather")
    feather.write_feather(stats.token_totals(i.article_stats), path)
    return feather.read_feather(i.spark, path).select("token", "n", "num_articles")


@query
def s11_text_sink(i: Inputs):
    path = i.lines(i.articles.select("id"), ["id"])
    return i.spark.read.text(path).select(F.col("value").alias("article_id"))


@query
def s12_count_sink(i: Inputs):
    path = stage_path(i.spark, "counts")
    tables.write_counts(i.counts, path)
    return tables.read_counts(i.spark, path, "bigint").select("embedding", "article_id", "dim", "n")


@query
def s13_require_rows(i: Inputs):
    return A.require_rows(i.articles).groupBy("batch").agg(F.count("*").alias("rows"))


# projections, filters and text


@query
def p01_article_text(i: Inputs):
    texts = [X.source_text(s).alias(s) for s in ("title", "abstract", "both")]
    return i.articles.select("id", *texts).select("id", "title", F.md5("abstract").alias("abstract"), F.md5("both").alias("both"))


@query
def p02_lowercase(i: Inputs):
    return tokens.article_text(i.articles).select("id", F.md5("text").alias("text"))


@query
def p03_null_to_empty(i: Inputs):
    return tokens.fill_text(i.gaps).select("id", "title", F.length("abstract").alias("abstract_chars"))


@query
def p04_exclude_articles(i: Inputs):
    flags = [(True, True), (True, False), (False, True), (False, False)]
    parts = [
        tokens.exclude_articles(i.gaps, a, t).select(F.lit(a).alias("abstract"), F.lit(t).alias("title"), "id")
        for a, t in flags
    ]
    return tokens.union_batches(*parts)


@query
def p05_encoder_text(i: Inputs):
    return tokens.encoder_text(i.gaps).select("id", F.md5("text").alias("text"))


@query
def p06_collapse_ngrams(i: Inputs):
    return tokens.collapse_ngrams(i.texts, NGRAMS).select(
        "id", F.md5("text").alias("text"), F.regexp_count("text", F.lit("_")).alias("marks")
    )


@query
def p07_tokens(i: Inputs):
    words = X.words(F.col("text"))
    return i.texts.select("id", words.alias("w")).select(
        "id", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("tokens")
    )


@query
def p08_stop_words(i: Inputs):
    return tokens.drop_stop_words(tokens.tokens(i.texts), i.stop).groupBy("token").agg(F.count("*").alias("n"))


@query
def p09_min_length(i: Inputs):
    return tokens.min_length(tokens.tokens(i.texts), 5).groupBy("token").agg(F.count("*").alias("n"))


def word_use(i: Inputs, words: DataFrame) -> DataFrame:
    used = tokens.tokens(i.texts).groupBy("token").agg(F.count("*").alias("n"))
    return words.join(used.withColumnRenamed("token", "word"), "word", "left").fillna(0, ["n"])


@query
def p10_stop_list(i: Inputs):
    return word_use(i, i.stop)


@query
def p11_lemmatized_stop_list(i: Inputs):
    lemmas = i.spark.createDataFrame(LEMMAS, "word string, lemma string")
    return word_use(i, stopwords.lemmatized_stop_words(i.stop, lemmas))


@query
def p12_min_frequency(i: Inputs):
    return cooccurrence.target_tokens(stats.token_totals(i.article_stats), i.opts.token_min_freq)


@query
def p13_document_ratio(i: Inputs):
    n = vocabulary.corpus_size(i.articles).scalar()
    found = vocabulary.filter_vocab(stats.token_totals(i.article_stats), n, 0.01, 0.5)
    return found.select("token", "num_articles")


@query
def p14_min_correlation(i: Inputs):
    return rounded(cooccurrence.correlated_token_pairs(i.correlations, 0.15))


@query
def p15_ngram_frequency(i: Inputs):
    return ngrams.frequent_ngrams(i.ngram_counts, i.opts.ngram_min_freq)


@query
def p16_zero_variance(i: Inputs):
    return projection.drop_constant_vectors(i.flat_embeddings).select("article_id", "label")


@query
def p17_clip(i: Inputs):
    return rounded(raster.clip_points(i.points, CLIP))


@query
def p18_column_pruning(i: Inputs):
    return i.fresh_stats().select("id", "token").groupBy("id").agg(F.count("*").alias("tokens"))


@query
def p19_id_cast(i: Inputs):
    named = i.articles.withColumn("id", F.col("id").cast("string"))
    found = tokens.article_stats(named, (), i.stop_list, Options(id_type="bigint"))
    return found.groupBy("id").agg(F.sum("n").alias("n"))


@query
def p20_dictionary(i: Inputs):
    return ranking.index_tokens(i.article_stats)


@query
def p21_replace_ngrams(i: Inputs):
    pairs = [g for g in NGRAMS if g.count(" ") == 1]
    rewritten = i.articles.withColumns({c: X.join_parts(F.col(c), pairs) for c in ("title", "abstract")})
    marks = F.regexp_count("abstract", F.lit("_")).alias("marks")
    return rewritten.select("id", F.md5("title").alias("title"), F.md5("abstract").alias("abstract"), marks)


@query
def p22_sentences(i: Inputs):
    return tokens.sentences(tokens.encoder_text(i.articles)).select(
        "id", "sent", F.length("sentence").alias("chars"), F.md5("sentence").alias("sentence")
    )


@query
def p23_rename(i: Inputs):
    wide = V.to_wide(i.embeddings, VECTOR_DIM)
    narrow = V.from_wide(wide)
    return narrow.select("article_id", r6(F.get("embedding", F.lit(63))).alias("dim_63")).join(
        wide.select("article_id", r6("dim_0")), "article_id"
    )


@query
def p24_cluster_label(i: Inputs):
    return i.embeddings.select(
        "article_id", *(X.cluster_label(F.col("label"), k).alias(f"cluster{k}") for k in (9, 10, 99, 100))
    )


# joins


@query
def j01_semi_join_tokens(i: Inputs):
    return cooccurrence.semi_join_tokens(i.article_stats, i.targets)


@query
def j02_semi_join_articles(i: Inputs):
    sample = ranking.sample_articles(i.articles.select("id"), i.sample_size, i.opts.random_seed)
    return cooccurrence.semi_join_articles(i.article_stats, sample)


@query
def j03_with_idf(i: Inputs):
    return rounded(stats.with_idf(i.article_stats, i.token_stats))


@query
def j04_match_ngrams(i: Inputs):
    return ngrams.match_ngrams(i.texts, i.candidates, "equi").select("id", "ngram")


@query
def j05_token_pairs(i: Inputs):
    return cooccurrence.token_pairs(i.presence)


@query
def j06_vocab_counts(i: Inputs):
    return i.counts


@query
def j07_ids_with_rows(i: Inputs):
    return V.from_wide(V.to_wide(i.embeddings, VECTOR_DIM)).select(
        "article_id", r6(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("total")
    )


@query
def j08_with_cluster(i: Inputs):
    return rounded(i.clustered)


@query
def j09_add_counts(i: Inputs):
    early = F.col("batch") <= "0005"
    parts = [i.texts.filter(c) for c in (early, ~early)]
    return ngrams.add_counts(*(ngrams.ngram_document_frequency(t, i.candidates) for t in parts))


@query
def j10_zip_ranked(i: Inputs):
    return vocabulary.zip_ranked(i.vocab, i.opts.embedding_dim)


# aggregations


@query
def a01_count_tokens(i: Inputs):
    return tokens.count_tokens(tokens.tokens(i.texts))


@query
def a02_article_totals(i: Inputs):
    return tokens.article_totals(tokens.count_tokens(tokens.tokens(i.texts))).select("id", "num_tokens").distinct()


@query
def a03_term_frequency(i: Inputs):
    return rounded(tokens.term_frequency(tokens.article_totals(tokens.count_tokens(tokens.tokens(i.texts)))))


@query
def a04_num_articles(i: Inputs):
    return stats.num_articles(i.article_stats)


@query
def a05_token_totals(i: Inputs):
    return rounded(stats.token_totals(i.article_stats).select("token", "n", "tf"))


@query
def a06_document_frequency(i: Inputs):
    return stats.document_frequency(i.article_stats)


@query
def a07_mean_tfidf(i: Inputs):
    return rounded(stats.mean_tfidf(stats.token_totals(i.article_stats), i.n_articles))


@query
def a08_minmax(i: Inputs):
    return rounded(stats.minmax(i.token_stats, "ridf"))


@query
def a09_presence_wide(i: Inputs):
    listed = i.spark.createDataFrame([(t,) for t in WIDE_TOKENS], "token string")
    return cooccurrence.presence(i.article_stats, listed, WIDE_TOKENS)


@query
def a10_pair_correlation(i: Inputs):
    return rounded(i.correlations)


@query
def a11_ngram_document_frequency(i: Inputs):
    return ngrams.ngram_document_frequency(i.texts, i.candidates, "inline")


@query
def a12_ngram_totals(i: Inputs):
    by_batch = (
        ngrams.match_ngrams(i.texts, i.candidates).groupBy("batch", "ngram").agg(F.count("*").alias("freq"))
    )
    return ngrams.sum_ngrams(by_batch)


@query
def a13_missed_articles(i: Inputs):
    return vocabulary.missed_articles(i.articles, i.counts)


@query
def a14_corpus_size(i: Inputs):
    return vocabulary.corpus_size(i.articles)


@query
def a15_pool_sentences(i: Inputs):
    return entries(dense.pool_sentences(i.token_vectors), "article_id", "sent")


@query
def a16_pool_articles(i: Inputs):
    return entries(dense.pool_articles(dense.pool_sentences(i.token_vectors)), "article_id")


@query
def a17_quantiles(i: Inputs):
    return rounded(i.bounds)


@query
def a18_bin_points(i: Inputs):
    return i.raster


@query
def a19_cluster_limit(i: Inputs):
    return raster.check_cluster_limit(i.clusters)


def repeated(i: Inputs) -> DataFrame:
    """Embedding batches in which the articles of label 1 come back with doubled vectors."""
    again = i.embeddings.filter("label = 1").withColumn("embedding", F.transform("embedding", lambda v: v * 2))
    return dense.union_embeddings(i.embeddings.withColumn("version", F.lit(1)), again.withColumn("version", F.lit(2)))


@query
def a20_duplicate_report(i: Inputs):
    return keys.duplicate_report(repeated(i))


@query
def a21_zero_variance_report(i: Inputs):
    return projection.constant_vector_report(i.flat_embeddings)


@query
def a22_unique_key(i: Inputs):
    keys.require_unique(i.clusters)
    return keys.repeated_keys(repeated(i), "article_id")


@query
def a23_two_level(i: Inputs):
    by_batch = i.batch_stats.groupBy("batch", "token").agg(F.sum("n").alias("n"), F.count("*").alias("num_articles"))
    return by_batch.groupBy("token").agg(F.sum("n").alias("n"), F.sum("num_articles").alias("num_articles"))


# ranks


@query
def w01_tfidf_rank(i: Inputs):
    return ranking.rank_by(i.vocab_tokens.select("token", "mean_tfidf"), "mean_tfidf").select("token", "tfidf_rank")


@query
def w02_ridf_rank(i: Inputs):
    return ranking.rank_by(i.vocab_tokens.select("token", "adj_ridf"), "adj_ridf").select("token", "ridf_rank")


@query
def w03_min_rank(i: Inputs):
    scored = i.vocab_tokens.select("token", "mean_tfidf", "adj_ridf")
    both = ranking.rank_by(ranking.rank_by(scored, "mean_tfidf"), "adj_ridf")
    return ranking.min_rank(both).select("token", "min_rank")


@query
def w04_keep_last(i: Inputs):
    last = keys.keep_last(repeated(i), "article_id", ["version"])
    return last.select("article_id", "version", r6(F.get("embedding", F.lit(0))).alias("first"))


@query
def w05_equalize(i: Inputs):
    return rounded(raster.equalize(i.raster))


# sorts, top lists and samples


@query
def t01_sort_tokens(i: Inputs):
    return stats.sort_tokens(stats.token_totals(i.article_stats).select("token", "n", "num_articles"))


@query
def t02_top_frequency(i: Inputs):
    return ranking.top_tokens(i.vocab_tokens, "n", i.opts.embedding_dim)


@query
def t03_top_tfidf(i: Inputs):
    return ranking.top_tokens(i.vocab_tokens, "mean_tfidf", i.opts.embedding_dim)


@query
def t04_top_ridf(i: Inputs):
    return ranking.top_tokens(i.vocab_tokens, "adj_ridf", i.opts.embedding_dim)


@query
def t05_top_ensemble(i: Inputs):
    return vocabulary.ensemble_tokens(i.vocab_tokens, i.opts.embedding_dim)


@query
def t06_order_ngrams(i: Inputs):
    return ngrams.order_ngrams(ngrams.extend_ngrams(i.ngram_counts, i.known))


@query
def t07_sorted_candidates(i: Inputs):
    return i.candidates.orderBy("ngram")


@query
def t08_ngrams_by_frequency(i: Inputs):
    return ngrams.by_frequency(i.ngram_counts)


@query
def t09_tokens_in_order(i: Inputs):
    return i.fresh_stats().sortWithinPartitions("id", "token").select("id", "token", "n")


@query
def t10_sample_articles(i: Inputs):
    return ranking.sample_articles(i.articles.select("id", "batch"), i.sample_size, 321)


# set operations


@query
def u01_union_batches(i: Inputs):
    parts = [i.batch_stats.filter(c) for c in (F.col("batch") <= "0005", F.col("batch") > "0005")]
    return rounded(tokens.union_batches(*parts).select("id", "token", "n", "tf"))


@query
def u02_token_set(i: Inputs):
    return tokens.token_set(i.article_stats)


@query
def u03_union_embeddings(i: Inputs):
    return repeated(i).select("article_id", "version", r6(F.get("embedding", F.lit(0))).alias("first"))


@query
def u04_extend_ngrams(i: Inputs):
    return ngrams.extend_ngrams(ngrams.frequent_ngrams(i.ngram_counts, i.opts.ngram_min_freq), i.known)


@query
def u05_ngram_candidates(i: Inputs):
    return ngrams.ngram_candidates(i.pairs)


@query
def u06_upper_triangle(i: Inputs):
    return rounded(cooccurrence.upper_triangle(cooccurrence.token_correlations(i.presence, all_pairs=True)))


# formulas


def scored(i: Inputs) -> DataFrame:
    return stats.token_totals(i.article_stats).withColumn("n_articles", i.n_articles)


@query
def m01_idf(i: Inputs):
    return scored(i).select("token", r6(S.idf(F.col("num_articles"), F.col("n_articles"))).alias("idf"))


@query
def m02_tfidf(i: Inputs):
    joined = stats.with_idf(i.article_stats, i.token_stats)
    return joined.select("id", "token", r6(S.tfidf(F.col("tf"), F.col("idf"))).alias("tfidf"))


@query
def m03_ridf(i: Inputs):
    return scored(i).select("token", r6(S.ridf(F.col("n"), F.col("num_articles"), F.col("n_articles"))).alias("ridf"))


@query
def m04_scaled_ridf(i: Inputs):
    ends = stats.minmax(i.token_stats, "ridf").select(F.struct("min", "max").alias("e")).scalar()
    return i.token_stats.select("token", r6(S.scale_ridf(F.col("ridf"), ends["min"], ends["max"])).alias("scaled"))


@query
def m05_adj_ridf(i: Inputs):
    return i.token_stats.select("token", r6("adj_ridf"))


@query
def m06_phi(i: Inputs):
    pairs = cooccurrence.token_pairs(i.presence)
    counts = i.presence.groupBy("token").agg(F.count("*").alias("c"))
    both = pairs.join(counts.toDF("token1", "c1"), "token1").join(counts.toDF("token2", "c2"), "token2")
    n = i.presence.agg(F.countDistinct("id").alias("n")).scalar()
    return both.select("token1", "token2", r6(S.phi(n, F.col("k"), F.col("c1"), F.col("c2"))).alias("cor"))


@query
def m07_string_functions(i: Inputs):
    return i.texts.select(
        "id",
        F.contains("text", F.lit("der ein")).alias("found"),
        F.md5(F.replace("text", F.lit("der ein"), F.lit("der_ein"))).alias("replaced"),
        X.part_count(F.col("text")).alias("spaces"),
        F.size(F.split(F.trim("text"), r"\s+")).alias("parts"),
    )


@query
def m08_zero_pad(i: Inputs):
    return i.articles.select("id", *(X.zero_pad(F.col("id"), w).alias(f"pad{w}") for w in (2, 4)))


@query
def m09_palette(i: Inputs):
    return raster.palette(i.clusters)


@query
def m10_shade(i: Inputs):
    return rounded(raster.shade(i.raster, raster.palette(i.clusters)))


# vectors


@query
def v01_count_embedding(i: Inputs):
    sums = i.counts.groupBy("embedding", "article_id").agg(F.sum("n").alias("total"), F.count("*").alias("tokens"))
    kinds = i.articles.select(
        F.explode(F.lit(list(vocabulary.KINDS))).alias("embedding"), F.col("id").alias("article_id")
    )
    return kinds.join(sums, ["embedding", "article_id"], "left").fillna(0, ["total", "tokens"])


def clustering_facts(emb: DataFrame, found: DataFrame) -> DataFrame:
    """(article_id, labels, nearest): how many labels an article has, and whether its cluster's mean is the nearest of all means."""
    labelled = staged(emb.select("article_id", "embedding").join(found, "article_id"), "labelled")
    means = staged(clusters.centroids(labelled), "means")
    nearest = clusters.assign_clusters(labelled, means).withColumnRenamed("cluster", "mean")
    same = found.join(nearest, "article_id").select("article_id", (F.col("cluster") == F.col("mean")).alias("nearest"))
    return same.groupBy("article_id").agg(F.count("*").alias("labels"), F.bool_and("nearest").alias("nearest"))


def projection_facts(emb: DataFrame, placed: DataFrame) -> DataFrame:
    """One row: the projected articles, and whether their columns are centred, uncorrelated, in order, and no narrower than any two entries."""
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = V.as_vectors(projection.drop_constant_vectors(emb.select("article_id", "embedding")))
    unit = Normalizer(inputCol="embedding", outputCol="unit").transform(rows)
    spread_ = F.sort_array(vector_to_array(Summarizer.variance(F.col("unit"))), asc=False)
    wide = unit.agg(F.slice(spread_, 1, 2).alias("v")).scalar()  # one row
    x = placed.agg(
        F.count("*").alias("articles"), F.avg("x1").alias("m1"), F.avg("x2").alias("m2"),
        F.var_samp("x1").alias("v1"), F.var_samp("x2").alias("v2"), F.covar_samp("x1", "x2").alias("c"),
    )
    near = 1e-8
    return x.withColumns({"w1": F.get(wide, F.lit(0)), "w2": F.get(wide, F.lit(1))}).select(
        "articles",
        ((F.abs("m1") < near) & (F.abs("m2") < near)).alias("centred"),
        (F.abs("c") < near).alias("uncorrelated"),
        (F.col("v1") + near >= F.col("v2")).alias("in_order"),
        ((F.col("v1") + near >= F.col("w1")) & (F.col("v1") + F.col("v2") + near >= F.col("w1") + F.col("w2"))).alias("widest"),
    )


@query
def v02_kmeans(i: Inputs):
    return clustering_facts(i.embeddings, staged(clusters.cluster_articles(i.embeddings, 10, i.opts.random_seed, 200), "clusters"))


@query
def v03_assign_clusters(i: Inputs):
    return clusters.assign_clusters(i.embeddings, clusters.centroids(i.embeddings, "label"))


@query
def v04_encode(i: Inputs):
    texts = i.articles.select("id", X.encoder_text("both", False).alias("text"))
    return entries(dense.encode_texts(texts, dense.hash_encoder(ENCODER_DIM)), "article_id")


@query
def v05_project(i: Inputs):
    return projection_facts(i.flat_embeddings, staged(projection.project_2d(i.flat_embeddings), "projected"))


@query
def v06_knn(i: Inputs):
    return neighbours.knn_graph(i.embeddings, 5)


@query
def v07_neighbour_weights(i: Inputs):
    return rounded(neighbours.neighbor_weights(neighbours.knn_graph(i.embeddings, 5)))


@query
def v08_rasterize(i: Inputs):
    return rounded(raster.visualize_embeddings(i.points, i.clusters, i.opts))


# whole steps


@query
def r01_article_stats(i: Inputs):
    return rounded(tokens.article_stats(i.articles, NGRAMS, i.stop_list))


@query
def r02_combine_article_stats(i: Inputs):
    parts = [i.batch_stats.filter(c) for c in (F.col("batch") <= "0005", F.col("batch") > "0005")]
    combined = tokens.combine_article_stats(*parts).drop("batch")
    codes = ranking.index_tokens(combined)
    return rounded(combined.join(codes, "token").select("id", "token", "code", "n", "tf"))


@query
def r03_token_stats(i: Inputs):
    return rounded(stats.token_stats(i.article_stats))


@query
def r04_token_cooccurrence(i: Inputs):
    return cooccurrence.token_cooccurrence(i.article_stats, i.token_stats, i.opts)


@query
def r05_token_correlations(i: Inputs):
    presence = staged(cooccurrence.token_cooccurrence(i.article_stats, i.token_stats, i.opts), "presence")
    return rounded(cooccurrence.token_correlations(presence, all_pairs=True))


@query
def r06_correlated_token_pairs(i: Inputs):
    return rounded(i.pairs)


@query
def r07_detect_ngrams(i: Inputs):
    return ngrams.detect_ngrams(i.articles, i.pairs, i.opts)


@query
def r08_combine_ngrams(i: Inputs):
    counts, listed = ngrams.combine_ngrams(i.ngram_counts, i.known, i.opts.ngram_min_freq)
    return listed.join(counts, "ngram", "left")


@query
def r09_replace_ngrams(i: Inputs):
    counts = ngrams.ngram_document_frequency(
        i.texts, i.known.filter(X.part_count(F.col("ngram")) == 1).select("ngram")
    )
    done = ngrams.replace_ngrams(i.articles, counts, 1)
    return done.select("id", F.md5("title").alias("title"), F.md5("abstract").alias("abstract"))


@query
def r10_stat_embeddings(i: Inputs):
    return vocabulary.stat_embeddings(i.articles, i.article_stats, i.token_stats, i.opts)[0]


@query
def r11_encode_articles(i: Inputs):
    return entries(dense.encode_articles(i.gaps, dense.hash_encoder(ENCODER_DIM)), "article_id")


@query
def r12_combine_embeddings(i: Inputs):
    batches = [repeated(i).filter(F.col("version") == v).select("article_id", "embedding") for v in (1, 2)]
    named = [b.withColumn("article_id", F.col("article_id").cast("string")) for b in batches]
    return entries(dense.combine_embeddings(*named, id_type="bigint"), "article_id")


@query
def r13_cluster_counts(i: Inputs):
    words = tokens.kept_words(i.articles, (), i.stop_list, Options())
    emb = staged(vocabulary.count_vectors(words, i.vocab, "ensemble"), "count-vectors")
    return clustering_facts(emb, staged(clusters.cluster_articles(emb, i.opts.num_clusters, i.opts.random_seed, 200), "clusters"))


@query
def r14_project_counts(i: Inputs):
    words = tokens.kept_words(i.articles, (), i.stop_list, Options())
    emb = staged(vocabulary.count_vectors(words, i.vocab, "ensemble"), "count-vectors")
    return projection_facts(emb, staged(projection.project_articles(emb, i.opts), "projected"))


@query
def r15_visualize(i: Inputs):
    return rounded(raster.visualize_embeddings(i.points, i.clusters, i.opts))


@query
def r16_run_all(i: Inputs):
    """The rows of every table that a run leaves, pictures aside, whose pixels follow the projection."""
    out = stage_path(i.spark, "run")
    made = run_all(i.spark, i.articles, i.known, i.stop_list, dense.hash_encoder(ENCODER_DIM), out, i.opts)
    tables_ = {name: df for name, df in made.items() if not name.startswith(("figures/", "neighbours/weights"))}
    return tokens.union_batches(*(df.agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name, df in tables_.items()))


# functions


@query
def f01_regex_rewrite(i: Inputs):
    pairs = ["der die", "of the"]
    return i.articles.select("id", *(F.md5(X.join_parts(F.col(c), pairs)).alias(c) for c in ("title", "abstract")))


@query
def f02_variance_test(i: Inputs):
    return i.flat_embeddings.select("article_id", V.is_constant(F.col("embedding")).alias("constant"))


@query
def f03_sql_functions(i: Inputs):
    register_functions(i.spark)
    return scored(i).select(
        "token",
        F.expr("round(ridf(n, num_articles, n_articles), 6)").alias("ridf"),
        F.expr("round(idf(num_articles, n_articles), 6)").alias("idf"),
    )


@query
def f04_batch_inference(i: Inputs):
    texts = i.articles.select("id", X.encoder_text("both", False).alias("text"))
    return entries(dense.encode_texts(texts, dense.hash_encoder(ENCODER_DIM), max_length=3), "article_id")


# goals beyond the steps


@query
def e01_jaccard_neighbours(i: Inputs):
    return neighbours.term_neighbours(i.article_stats, i.articles, 5, "jaccard")


@query
def e02_cosine_neighbours(i: Inputs):
    return neighbours.term_neighbours(i.tfidf, i.articles, 5)


@query
def e03_neighbourhood_overlap(i: Inputs):
    """Neighbours that stay when all terms give way to a vocabulary of 64."""
    full = neighbours.term_neighbours(i.tfidf, i.articles, 5)
    few = i.tfidf.join(i.vocab.filter("embedding = 'ensemble'").select("token"), "token", "left_semi")
    return neighbours.neighbourhood_overlap(full, neighbours.term_neighbours(few, i.articles, 5))


@query
def e04_term_network(i: Inputs):
    return rounded(neighbours.term_network(i.pairs))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 most informative terms of the corpus by adjusted residual IDF."""
    i = Inputs(spark, folder)
    top = ranking.top_tokens(i.token_stats, "adj_ridf", 20)
    return top.join(rounded(i.token_stats), "token").orderBy("rank")
