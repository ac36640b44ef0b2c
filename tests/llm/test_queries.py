"""The registered queries: names, SQL, and the pipeline against brute force."""

import os

import duckdb
import pytest

from caselens.llm import oracle, queries
from tools.check_oracle import TABLES, compare

DATA = os.environ.get("CASELENS_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")


def test_one_query_for_each_operator():
    import __spark_entry__ as contract

    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(queries.QUERIES) | {"pipeline"} == set(contract.LLM_QUERIES) <= set(contract.queries())
    assert set(oracle.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert compare(queries.QUERIES[name](spark, DATA), con, oracle.SQL[name])[1] == []


def test_pipeline(spark):
    import corpus_pipeline as p
    from llm_fixtures import shingles

    from caselens.llm.common import stored, table

    docs = table(spark, DATA, "documents")
    columns, before = docs.columns, docs.count()
    seen = {}
    for name, stage in p.STAGES:
        docs = stored(stage(spark, docs, DATA), "test-stage")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns and docs.count() <= before
            before = docs.count()
    items = [r.text.lower() for r in table(spark, DATA, "benchmark").collect()]
    kept = {r.doc_id: r.text for r in seen["benchmark decontamination"].collect()}
    assert kept and not any(i in t.lower() for t in kept.values() for i in items)
    sets = [shingles(t, 5) for t in kept.values()]
    assert not any(100 * len(a & b) >= 80 * len(a | b) for k, a in enumerate(sets) for b in sets[:k] if a and b)
    lines = [x for t in kept.values() for x in t.split("\n") if any(c.isalnum() for c in x)]
    assert len(lines) == len({x.strip().lower() for x in lines})
    pieces = seen["packing"].collect()
    assert {r.doc_id for r in pieces} == set(kept)
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())


def test_stages_keep_the_columns_and_take_awkward_tables(spark):
    import random

    import corpus_pipeline as p
    from llm_fixtures import documents, prose

    rnd = random.Random(6)
    text = "the old house and the garden of " + " ".join(prose(rnd, 12, 300) + " and the" for _ in range(6)) + "."
    docs = documents(spark, [text, text, None, "", " ", "?!", prose(rnd, 3000)], [3, 3, None, 5, None, 6, 7])
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        found = out.collect()
        assert all(r[c] == "x" for r in found for c in ("kept", "component_id", "score", "row", "dropped", "n_words")), name
        texts = [r.text for r in found if r.text is None or not r.text.strip()]
        assert len(texts) == (0 if name == "quality rules" else 3), name
        if name != "quality rules":
            assert sum(r.doc_id == 3 for r in found) == 2, name
        assert stage(spark, documents(spark, []), DATA).collect() == [], name
    pieces = p.packing_stage(spark, docs, DATA).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in pieces if r.doc_tokens == 1) == [(False, 5), (True, 0)]
    assert p.packing_stage(spark, documents(spark, []), DATA).collect() == []
