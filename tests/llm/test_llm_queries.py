"""Registered queries with SQL against DuckDB, on the test table."""

import pytest
from oracle import check, duck

queries = pytest.importorskip("vitalspark.llm.queries")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf_dir, name):
    check(queries.QUERIES[name](spark, sf_dir).toPandas(), duck(queries.ORACLE_SQL[name], sf_dir))
