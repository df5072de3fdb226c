import duckdb
import pytest

from check_queries import TABLES, compare
from tidemark.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    assert compare(spark, con, name, FOLDER).startswith("ok")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_a_row_per_document(spark, name):
    rows = QUERIES[name](spark, FOLDER).select("doc_id").distinct().count()
    assert rows == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
