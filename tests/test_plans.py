"""Plan properties that decide whether an operator holds at a thousand times the data."""

import os

import pytest
from pyspark.sql import functions as F

from caselens.functions.frames import first_ranks, small_or_plain
from caselens.operators import benchmark, profile, themes
from caselens.sources.tables import complaint_view

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def complaints(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "complaints")
    names = "issuer issue sub_issue narrative company company_response timely_response state".split()
    rows = spark.range(100).select(
        F.col("id").alias("complaint_id"), F.date_add(F.lit("2023-01-01").cast("date"), F.col("id").cast("int")).alias("date_received"),
        *[F.concat(F.lit(n), (F.col("id") % 3).cast("string")).alias(n) for n in names],
    )
    rows.write.parquet(path)
    return complaint_view(spark.read.parquet(path))


def test_only_needed_columns_are_read_and_filters_reach_the_scan(complaints):
    text = plan(benchmark.response_outcomes(complaints))
    assert "ReadSchema: struct<issuer:string,company_response:string>" in text
    assert "PushedFilters: [IsNotNull(company_response), Not(EqualTo(company_response,In progress))]" in text
    mixed = plan(benchmark.sub_issue_mix(complaints, ["issuer0", "issuer1"]))
    assert "narrative" not in mixed.split("ReadSchema:")[1].splitlines()[0]


def test_mix_scans_once_and_needs_no_join(complaints):
    text = plan(benchmark.issue_mix(complaints, ["issuer0", "issuer1"]))
    assert text.count("FileScan") == 1 and "Join" not in text and "Cartesian" not in text
    assert "partial_count" in text


def test_completeness_is_one_scan(complaints):
    assert plan(profile.profile_completeness(complaints)).count("FileScan") == 1


@pytest.mark.parametrize("up_to, limited", [(5, True), (1000, True), (1001, False)])
def test_draws_limit_hot_groups_before_the_shuffle_or_slice_them(spark, complaints, up_to, limited):
    drawn = first_ranks(complaints.select("complaint_id", "issuer"), "complaint_id", 1, ["issuer"], up_to)
    text = plan(drawn)
    assert text.count("WindowGroupLimit") == (2 if limited else 0)
    if not limited:
        assert "hashpartitioning(issuer#" in text and "_slice#" in text
    assert drawn.count() == (15 if up_to == 5 else 100)


def test_top_named_limits_before_the_shuffle(spark):
    df = spark.range(9).selectExpr("id AS complaint_id", "concat('i', id % 2) AS issuer", "array('a', 'b') AS named")
    assert plan(themes.top_named(df, "named", "i0")).count("WindowGroupLimit") == 2


def test_broadcast_only_below_the_bound(spark):
    small, big = spark.range(10), spark.range(10)
    joined = lambda side: plan(spark.range(50).join(side, "id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in joined(small_or_plain(small, max_rows=10))
        assert "SortMergeJoin" in joined(small_or_plain(big, max_rows=9))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")
def test_no_query_pairs_rows_or_leaves_the_jvm(spark):
    from caselens.plans.queries import REGISTRY

    fitted = {"theme_model", "theme_model_distilled", "theme_model_cv"}
    for key, run in REGISTRY.items():
        if key not in fitted:
            text = plan(run(spark, DATA))
            bad = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas", "InArrow") if w in text]
            assert not bad, (key, bad)
