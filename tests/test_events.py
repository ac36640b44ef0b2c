import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from caselens.operators import events

EVENT = [("e", "T", "2024-04-01", "mentions_x", "X")]
PANEL = "lens string, metric string, issuer string, month date, k bigint, n bigint"


def month(i):
    return dt.date(2024 + (i - 1) // 12, (i - 1) % 12 + 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    rows = []
    for issuer, before, after, n in [("T", 10, 30, 100), ("C1", 10, 10, 50), ("C2", 10, 12, 50)]:
        for i in range(1, 7):
            rows.append(("l", "m", issuer, month(i), before if i < 4 else after, n))
    return spark.createDataFrame(rows, PANEL)


def test_did_and_placebo(spark, panel):
    r = events.event_study(panel, EVENT, ["C1", "C2"], [3]).first()
    assert (r.n_treated_pre, r.n_treated_post, r.n_control_pre, r.n_control_post) == (300, 300, 300, 300)
    assert (r.treated_change_pts, r.control_change_pts, r.did_pts) == (20.0, 2.0, 18.0)
    assert (r.placebo_did_min_pts, r.placebo_did_max_pts, r.outside_placebo_range) == (-4.0, 4.0, True)
    se = (0.1 * 0.9 / 300 + 0.3 * 0.7 / 300 + 0.2 * 0.8 / 300 + 0.22 * 0.78 / 300) ** 0.5
    assert r.did_ci_low_pts == pytest.approx(18 - 196 * se, abs=0.006)
    assert (r.post_months_observed, r.valid) == (3, True)


def test_a_common_shift_is_no_effect(spark, panel):
    same = panel.withColumn("k", F.when(F.col("month") < "2024-04-01", 10).otherwise(20).cast("bigint")).withColumn("n", F.lit(100).cast("bigint"))
    r = events.event_study(same, EVENT, ["C1", "C2"], [3]).first()
    assert r.did_pts == 0.0 and not r.outside_placebo_range


def test_an_empty_cell_gives_nulls_or_an_error(spark, panel):
    early = panel.filter(~((F.col("issuer") == "T") & (F.col("month") < "2024-04-01")))
    r = events.event_study(early, EVENT, ["C1", "C2"], [3]).first()
    assert (r.did_pts, r.treated_pre_pct, r.valid, r.outside_placebo_range) == (None, None, False, False)
    assert r.placebo_did_max_pts == 4.0
    with pytest.raises(events.EmptyCell):
        events.event_study(early, EVENT, ["C1", "C2"], [3], strict=True)


def test_placebo_equals_a_loop_over_controls(spark):
    rnd = random.Random(4)
    controls = ["C1", "C2", "C3", "C4"]
    cells = {(i, m): (rnd.randint(0, 20), rnd.randint(20, 40)) for i in ["T", *controls] for m in range(1, 13)}
    rows = [("l", "m", i, month(m), k, n) for (i, m), (k, n) in cells.items()]
    r = events.event_study(spark.createDataFrame(rows, PANEL), [("e", "T", "2024-07-01", "c", "X")], controls, [2, 5]).collect()

    def rate(who, months):
        picked = [cells[i, m] for i in who for m in months]
        return sum(k for k, _ in picked) / sum(n for _, n in picked)

    for got in r:
        w = got.window_months
        pre, post = range(7 - w, 7), range(7, 7 + w)
        change = lambda who: rate(who, post) - rate(who, pre)
        placebo = [100 * (change([c]) - change([x for x in controls if x != c])) for c in controls]
        assert got.placebo_did_min_pts == pytest.approx(min(placebo), abs=0.006)
        assert got.placebo_did_max_pts == pytest.approx(max(placebo), abs=0.006)
        assert got.did_pts == pytest.approx(100 * (change(["T"]) - change(controls)), abs=0.006)


def test_rolling_share_precedes_the_cut_and_uses_rows_seen(spark, panel):
    seen = panel.filter(F.col("month") != "2024-03-01")
    got = events.event_monthly(seen, EVENT, ["C1", "C2"], lo=0, hi=2).filter("group = 'treated'").orderBy("month").collect()
    assert [(r.rel_month, r.share_pct, r.share_pct_3m) for r in got] == [(0, 30.0, 16.67), (1, 30.0, 23.33), (2, 30.0, 30.0)]
    pooled = events.event_monthly(panel, EVENT, ["C1", "C2"]).filter("group = 'comparison' AND rel_month = 0").first()
    assert (pooled.k, pooled.n) == (22, 100)


def test_named_product_levels(spark):
    rows = [("T", month(i), 10 if i < 4 else 15, 100) for i in range(1, 7)] + [("C1", month(2), 99, 100)]
    mentions = spark.createDataFrame(rows, "issuer string, month date, mentions_x bigint, narratives bigint")
    r = events.event_named_product(mentions, EVENT, [2]).first()
    assert (r.treated_pre_pct, r.treated_post_pct, r.treated_change_pts) == (10.0, 15.0, 5.0)
    assert (r.k_treated_pre, r.k_treated_post, r.n_treated_pre, r.post_months_observed) == (20, 30, 200, 2)
    assert r.did_pts is None and r.control_pre_pct is None
    assert events.named_product_monthly(mentions, EVENT).count() == 6


def test_panels(spark):
    value = spark.createDataFrame([("A", month(1), 9, 4, 3, 1)], "issuer string, month date, complaints bigint, value_complaints bigint, fees bigint, rewards bigint")
    mentions = spark.createDataFrame([("A", month(1), 7, 2, 1)], "issuer string, month date, narratives bigint, mentions_annual_fee bigint, mentions_statement_credit bigint")
    themed = spark.createDataFrame([("A", dt.date(2024, 1, 9), t) for t in ("annual_fee", "billing", "rewards_points")], "issuer string, date_received date, primary_theme string")
    got = {(r.lens, r.metric): (r.k, r.n) for r in events.event_panels(value, mentions, themed).collect()}
    assert got == {
        ("sub_issue", "fees_rewards_promo"): (4, 9), ("sub_issue", "fees"): (3, 9), ("sub_issue", "rewards"): (1, 9),
        ("mention", "annual_fee"): (2, 7), ("mention", "statement_credit"): (1, 7),
        ("theme", "membership_value"): (2, 3), ("theme", "annual_fee"): (1, 3),
    }
