import datetime as dt

import pytest
from pyspark.sql import functions as F

from caselens.operators import benchmark, profile
from caselens.sources.tables import complaint_view


@pytest.fixture(scope="module")
def c(spark):
    rows = []
    n = 0
    for issuer, issue, sub, k in [
        ("A", "fees", "Problem with fees", 3), ("A", "fees", None, 1), ("A", None, None, 2), ("B", "fees", "Problem with fees", 1),
        ("B", "other", "x", 3), ("C", "other", "x", 4),
    ]:
        for _ in range(k):
            rows.append((n, issuer, issue, sub, dt.date(2023, 1 + n % 12, 3), None if n % 2 else "late fee refund", "Yes"))
            n += 1
    df = spark.createDataFrame(
        rows,
        "complaint_id bigint, issuer string, issue string, sub_issue string, date_received date, narrative string, timely_response string",
    )
    response = (
        F.when(F.col("complaint_id") % 4 == 0, "In progress").when(F.col("complaint_id") % 4 == 1, F.lit(None))
        .when(F.col("complaint_id") % 4 == 2, "Closed with monetary relief").otherwise("Closed with explanation")
    )
    return complaint_view(df.withColumn("company_response", response))


def test_issue_mix_fills_the_grid_and_null_issue_counts_only_in_totals(spark, c):
    got = {(r.issuer, r.issue): r for r in benchmark.issue_mix(c, ["A", "B", "C", "absent"]).collect()}
    assert len(got) == 9
    a = got["A", "fees"]
    assert (a.complaints, a.share_pct, a.peers_share_pct) == (4, 66.67, 12.5)
    assert a.diff_vs_peers_pts == pytest.approx(54.17) and a.index_vs_peers == pytest.approx(5.33)
    assert got["C", "fees"].complaints == 0
    assert {got[i, None].complaints for i in "ABC"} == {0}
    assert got["A", "other"].index_vs_peers == 0.0


def test_sub_issue_mix_drops_empty_cells_after_peers(spark, c):
    rows = benchmark.sub_issue_mix(c, ["A", "B", "C"]).collect()
    assert min(r.complaints for r in rows) > 0
    # The two complaints without an issue count in A's total but have no cell of their own.
    assert {(r.issuer, r.issue, r.sub_issue, r.complaints) for r in rows} == {
        ("A", "fees", "Problem with fees", 3), ("A", "fees", "(none)", 1), ("B", "fees", "Problem with fees", 1),
        ("B", "other", "x", 3), ("C", "other", "x", 4),
    }


def test_index_is_null_when_no_peer_has_the_category(spark, c):
    only = benchmark.sub_issue_mix(c, ["A", "B", "C"]).filter("sub_issue = '(none)'").first()
    assert only.peers_share_pct == 0.0 and only.index_vs_peers is None


def test_closed_drops_missing_responses(spark, c):
    total = sum(r.closed_complaints for r in benchmark.response_outcomes(c).collect())
    assert total == c.filter("company_response IN ('Closed with monetary relief', 'Closed with explanation')").count()


def test_trend_rolls_over_rows_seen_and_drops_issuers_without_a_base(spark):
    months = [("A", "2023-01-05", 2), ("A", "2023-05-05", 4), ("A", "2023-06-05", 6), ("A", "2024-01-01", 8), ("B", "2024-01-01", 1)]
    rows = [(i, d) for i, d, n in months for _ in range(n)]
    df = complaint_view(
        spark.createDataFrame(rows, "issuer string, d string").select(
            "issuer", F.to_date("d").alias("date_received"), F.lit("x").alias("sub_issue"), F.lit("x").alias("narrative")
        )
    )
    got = [tuple(r) for r in benchmark.monthly_trend(df, df, 2023).orderBy("month").collect()]
    assert [(r[2], r[3], r[4], r[5]) for r in got] == [
        (2, 100.0, 50.0, 2.0), (4, 100.0, 100.0, 3.0), (6, 100.0, 150.0, 4.0), (8, 88.89, 200.0, 6.0),
    ]


def test_rate_excludes_issuer_years_and_survives_zero_volume(spark):
    df = spark.createDataFrame([("A", 2023), ("A", 2024), ("B", 2024), ("C", 2024), ("A", 2024)], "issuer string, year int")
    volume = spark.createDataFrame([("A", 2023, 2.0), ("A", 2024, 0.0), ("B", 2024, 4.0), ("C", 2024, 1.0)], "issuer string, year int, purchase_volume double")
    got = benchmark.rate_per_volume(df, volume, [2023, 2024], [("C", 2024)]).collect()
    assert sorted((r.issuer, r.year, r.complaints, r.complaints_per_unit) for r in got) == [
        ("A", 2023, 1, 0.5), ("A", 2024, 2, None), ("B", 2024, 1, 0.25),
    ]


def test_relief_keeps_missing_sub_issues_as_a_group(spark, c):
    got = benchmark.relief_by_sub_issue(c, "A", min_focus=1).collect()
    assert any(r.sub_issue is None for r in got)
    assert all(r.focus_complaints >= 1 for r in got)


def test_completeness_counts_exact_distinct_values(spark):
    long_a, long_b = "x" * 70, "x" * 69 + "y"
    df = spark.createDataFrame([(1, long_a), (2, long_b), (2, long_a), (3, None), (None, "")], "a int, b string")
    got = {r.field: (r.non_null_pct, r.distinct_values) for r in profile.profile_completeness(df).collect()}
    assert got == {"a": (80.0, 3), "b": (80.0, 3)}
    assert {r.field for r in profile.profile_completeness(df, approximate=True).collect()} == {"a", "b"}


def test_text_length_quantiles_interpolate(spark):
    sizes = [10, 20, 30, 40, 7000]
    df = spark.createDataFrame([("x" * n,) for n in sizes] + [(None,)], "narrative string")
    r = profile.profile_text_length(df).first()
    assert (r.p50, r.p10, r.max_chars, r.over_limit_pct, r.short_pct) == (30.0, 14.0, 7000, 20.0, 80.0)


def test_reconciliation_keeps_keys_missing_on_the_right(spark):
    left = spark.createDataFrame([("A", 2023)] * 3 + [("B", 2023)], "issuer string, year int")
    right = spark.createDataFrame([("A", 2023, 4)], "issuer string, year int, right_n bigint")
    got = sorted(tuple(r) for r in profile.reconcile_counts(left, right).collect())
    assert got == [("A", 2023, 3, 4, 75.0), ("B", 2023, 1, 0, None)]
