import pytest

from caselens.operators import findings


def test_rank_of_tied_issuers_is_averaged_and_cut(spark):
    outcomes = spark.createDataFrame([("A", 5.0), ("B", 9.0), ("C", 5.0), ("D", 1.0)], "issuer string, monetary_relief_pct double")
    timely = spark.createDataFrame([("A", 99.0), ("A", 98.5), ("B", 90.0)], "issuer string, timely_pct double")
    got = {(r.key, r.subkey): r.value for r in findings.facts_response(outcomes, timely, "A").collect()}
    assert got["focus_relief_rank", None] == 2 and got["focus_relief_pct", None] == 5.0
    assert (got["timely_pct_min", None], got["timely_pct_focus_min", None]) == (90.0, 98.5)
    assert got["relief_by_issuer", "D"] == 1.0


def test_volume_facts(spark):
    rates = spark.createDataFrame([("A", 2024, 3.0), ("B", 2024, 1.0), ("C", 2024, 7.5), ("A", 2023, 0.1)], "issuer string, year int, complaints_per_unit double")
    got = {r.key: (r.value, r.text) for r in findings.facts_volume(rates, 2024, "A").collect()}
    assert got["focus_rank_lowest_first"] == (2.0, None)
    assert got["lowest"] == (1.0, "B") and got["highest"] == (7.5, "C")


@pytest.mark.parametrize("n, rows", [(20, 13), (5, 10)])
def test_extremes(spark, n, rows):
    mix = spark.createDataFrame(
        [("A", "i", f"s{k:02}", 200, float(k)) for k in range(n)] + [("A", "i", "small", 10, 99.0), ("B", "i", "s", 900, 99.0)],
        "issuer string, issue string, sub_issue string, complaints int, diff_vs_peers_pts double",
    )
    got = findings.chart_extremes(mix, "A").collect()
    assert len(got) == rows
    assert {r.diff_vs_peers_pts for r in got if r.part == "tail"} == set(map(float, range(min(n, 6))))


def test_heat_matrix_fills_zeros(spark):
    heat = spark.createDataFrame([("A", "x", 1.5), ("B", "y", 2.5)], "issuer string, theme string, share_pct double")
    got = {r.issuer: (r.y, r.x) for r in findings.heat_matrix(heat, "theme", ["y", "x"]).collect()}
    assert got == {"A": (0.0, 1.5), "B": (2.5, 0.0)}
