"""One query per operator of this package over the provided tables, and their SQL where it has a form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, decontaminate, dialogue, html_text, line_dedup, packing, passages, quality_rules, simhash, spelling, suffix_dedup, toxicity, url_rules
from corpusloom.llm.common import read_table

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.fit_rules(docs, read_table(spark, sf_dir, "labels")))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.without_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_digest(packing.pack(read_table(spark, sf_dir, "documents")))


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


@query
def op7_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(read_table(spark, sf_dir, "pages"), url_rules.RULES)


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    return out.select(
        "doc_id",
        F.coalesce(F.size("lines_gone"), F.lit(0)).alias("n_removed"),
        F.coalesce("lines_gone", F.array().cast("array<int>")).alias("removed_lines"),
        n_lines.alias("n_lines_left"),
        F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256).alias("kept_sha256"),
    )


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return passages.score_quality(docs, passages.fit_classifier(docs, read_table(spark, sf_dir, "labels")))


@query
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = byte_bpe.decode(byte_bpe.encode(read_table(spark, sf_dir, "documents")), byte_bpe.token_bytes(spark))
    n_tokens = F.expr("octet_length(ids) div 4")
    return decoded.select("doc_id", n_tokens.cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair_conversations(dialogue.damaged(read_table(spark, sf_dir, "conversations")))


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_forms(read_table(spark, sf_dir, "documents"))


_HOST = (
    r"translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)
_PATH = r"regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's')"

ORACLES = {
    "op8_url_filter": f"""
WITH parts AS (
  SELECT page_id, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path FROM pages),
fits AS (
  SELECT *, host = 'net' OR host LIKE '%.net' AS in_net, host = 'org' OR host LIKE '%.org' AS in_org,
         host = 'example.net' OR host LIKE '%.example.net' AS in_example_net,
         host = 'example.com' OR host LIKE '%.example.com' AS in_example_com
  FROM parts),
ruled AS (
  SELECT page_id, host, path,
         CASE WHEN in_example_net AND path LIKE '/en/%' THEN 'example.net/en/'
              WHEN in_net AND path LIKE '/%' THEN 'net/'
              WHEN in_example_com AND path LIKE '/de/%' THEN 'example.com/de/'
              WHEN in_org AND path LIKE '/fr/%' THEN 'org/fr/' END AS rule
  FROM fits)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
""",
}
