"""The query catalogue against its SQL twins on the smallest data."""

import duckdb
import pytest

from conftest import DATA
from __spark_entry__ import entry, oracle_sql, queries

TABLES = "documents embeddings labels benchmark pages conversations events".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
# one query per family here; the whole catalogue is compared at the next scale outside pytest
CHECKED = """s01_batch_scan s06_ngram_list p06_collapse_ngrams p10_stop_list p21_replace_ngrams p22_sentences
j04_match_ngrams a05_token_totals a10_pair_correlation a15_pool_sentences a18_bin_points w03_min_rank t05_top_ensemble
t10_sample_articles u04_extend_ngrams m05_adj_ridf v03_assign_clusters v06_knn v08_rasterize r03_token_stats
r10_stat_embeddings""".split()


def plain(rows):
    return sorted(tuple(repr(v + 0.0 if isinstance(v, float) else v) for v in row) for row in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({oracle_sql()[name]})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(want)
    types = {row[0]: row[1] for row in con.execute(f"DESCRIBE {oracle_sql()[name]}").fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == types


def test_every_sql_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 20
