"""Every registered query that has SQL gives the same rows as DuckDB on the smallest test tables."""

import os

import duckdb
import pytest

from tools.check_oracle import TABLES, compare

DATA = os.environ.get("CASELENS_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_keys_match():
    import __spark_entry__ as contract

    own = set(contract.queries()) - set(contract.LLM_QUERIES)
    without = own - set(contract.oracle_sql())
    assert without == {"theme_model", "theme_model_distilled", "theme_model_cv"}
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_all_queries_equal_their_sql(spark, duck):
    import __spark_entry__ as contract

    sql, run = contract.oracle_sql(), contract.queries()
    own = [k for k in sql if k not in contract.LLM_QUERIES]
    problems = {k: compare(run[k](spark, DATA), duck, sql[k])[1] for k in own}
    assert {k: p for k, p in problems.items() if p} == {}


def test_entry(spark):
    import __spark_entry__ as contract

    df = contract.entry(spark)
    assert df.columns[:3] == ["issuer", "issue", "sub_issue"] and df.count() > 0
