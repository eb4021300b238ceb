"""Queries with an SQL twin equal it on the smallest generated tables."""

import os

import pytest
from comparing import compare, connect

from argentum.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no generated tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    equal, why = compare(spark, connect(SF_DIR), QUERIES[name], ORACLE_SQL[name], SF_DIR)
    assert equal, why


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_covers_its_table(spark, name):
    table = {"op7": "pages", "op9": "pages", "op10": "embeddings"}.get(name.split("_")[0], "documents")
    n = spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
    rows = QUERIES[name](spark, SF_DIR).count()
    assert rows >= n if name.startswith("op6") else rows == 5 * -(-n // 50) if name.startswith("op10") else rows == n
