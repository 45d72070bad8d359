"""The registered text queries on the smallest tables."""

import duckdb
import pytest

import check
from ringfold.llm.queries import LLM_REGISTRY

FOLDER = "/root/testdata/sf0.001"
CHECKED = [n for n, (_, sql) in LLM_REGISTRY.items() if sql]
PER_DOCUMENT = ["op1_toxicity", "op4_near_dedup", "op5_language_id", "op6_bpe_chunks", "op8_token_files", "op11_period_runs"]


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in LLM_REGISTRY)
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    run, sql = LLM_REGISTRY[name]
    df = run(spark, FOLDER)
    got = check.rows_of(df.columns, df.collect())
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == check.rows_of(columns, found.fetchall())


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_per_document(spark, name):
    ids = [r[0] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()]
    out = LLM_REGISTRY[name][0](spark, FOLDER)
    assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted(ids)
