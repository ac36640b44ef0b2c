import pytest
from pyspark.sql import functions as F

from caselens.operators import costs, themes
from caselens.sources.tables import PRICE_SCHEMA


@pytest.fixture(scope="module")
def s(spark):
    rows = [
        (1, "A", "billing", 1.0, "In progress"), (2, "A", "billing", 1.0, None), (3, "A", "annual_fee", 2.0, "Closed with monetary relief"),
        (4, "B", "annual_fee", 1.0, "Closed with monetary relief"), (5, "B", "billing", 3.0, "Closed with explanation"),
    ]
    return spark.createDataFrame(rows, "complaint_id bigint, issuer string, primary_theme string, weight double, company_response string")


def test_mix_sums_to_one_hundred_and_fills_zero_themes(spark, s):
    rows = themes.theme_mix(s).collect()
    got = {(r.issuer, r.theme): r for r in rows}
    assert len(rows) == 20
    assert (got["A", "annual_fee"].share_pct, got["B", "billing"].share_pct) == (50.0, 75.0)
    for issuer in "AB":
        assert sum(r.share_pct for r in rows if r.issuer == issuer) == pytest.approx(100)
    # A has 16/6 effective rows, so 3 and, for the half, 1 of them.
    a = got["A", "annual_fee"]
    assert (a.sample_rows, a.issuer_sample_rows) == (1, 3)
    assert a.ci_low_pct == pytest.approx(6.15, abs=0.01) and a.ci_high_pct == pytest.approx(79.23, abs=0.01)


def test_focus_against_peers(spark, s):
    got = {r.theme: r for r in themes.theme_vs_peers(s, "A").collect()}
    assert got["annual_fee"].diff_pts == 25.0 and got["annual_fee"].index_vs_peers == 2.0
    assert got["annual_fee"].membership_value_theme and not got["billing"].membership_value_theme
    assert got["other"].index_vs_peers is None and got["other"].focus_sample_rows == 0


def test_focus_that_is_absent_gives_nulls(spark, s):
    got = themes.theme_vs_peers(s, "nobody").first()
    assert got.focus_share_pct is None and got.diff_pts is None


def test_relief_counts_missing_responses_as_closed(spark, s):
    got = {r.theme: r for r in themes.theme_relief(s, "A").collect()}
    assert (got["billing"].focus_sample_rows, got["billing"].focus_relief_pct) == (1, 0.0)
    assert (got["annual_fee"].focus_relief_pct, got["other"].focus_relief_pct) == (100.0, None)


def test_sentiment_shares_count_missing_sentiment_below_the_line(spark):
    rows = [("A", "billing", "negative", 1.0), ("A", "billing", None, 3.0), ("B", "billing", "negative", 9.0)]
    df = spark.createDataFrame(rows, "issuer string, primary_theme string, sentiment string, weight double")
    assert [(r.sentiment, r.share_pct, r.theme_label) for r in themes.theme_sentiment(df, "A").collect()] == [("negative", 25.0, "Billing")]


def test_top_named_counts_spellings_together(spark):
    rows = [(2, "A", ["lounge ", "Credit"]), (1, "A", ["Credit", " LOUNGE"]), (3, "B", ["", None, "lounge"]), (4, "B", None)]
    df = spark.createDataFrame(rows, "complaint_id bigint, issuer string, named array<string>")
    got = {(r.group, r.name, r.mentions) for r in themes.top_named(df, "named", "A", top=2).collect()}
    assert got == {("A", "Credit", 2), ("A", "LOUNGE", 2), ("Other issuers", "lounge", 1)}


def test_weighted_shares_and_timely_rate(spark):
    rows = [("A", "x", 500.0), ("A", "x", 500.0), ("A", "y", 50.0), ("A", "y", 50.0)]
    df = spark.createDataFrame(rows, "issuer string, theme string, weight double")
    got = {r.theme: (r.n, r.share) for r in themes.weighted_shares(df, ["issuer"], "theme").collect()}
    assert got["x"] == (2, pytest.approx(1000 / 1100)) and sum(v[1] for v in got.values()) == pytest.approx(1)
    flags = spark.createDataFrame([("a", f) for f in ("Yes", "Yes", "No", None, "Yes")] + [("b", None)], "k string, timely_response string")
    assert {r.k: r.rate for r in themes.timely_rate(flags, ["k"]).collect()} == {"a": 0.75, "b": None}


# --- quotes ------------------------------------------------------------------------------
def quote(spark, text, theme):
    return spark.createDataFrame([(text, theme)], "t string, k string").select(themes.pick_quote("t", "k")).first()[0]


def test_quotes_are_short_on_theme_and_readable(spark):
    wanted = "The bank kept the annual fee although the card was closed within a single week."
    told = f"On XX/XX/2024 I wrote to XXXX about the annual fee and to XXXX about the refund of it. Hi.  {wanted}\n\nBye."
    assert quote(spark, told, "annual_fee") == wanted
    assert quote(spark, "Too short. Also short.", "annual_fee") is None
    assert quote(spark, wanted, "lounge_travel_benefit") is None
    assert quote(spark, "The annual fee of {$95.00} was taken from my account on the very first day of it.", "annual_fee") is None
    assert quote(spark, "annual fee " * 60 + ".", "annual_fee") is None


def test_quotes_take_one_per_issuer_before_repeats(spark):
    text = "They have now charged me the annual fee twice in the same year without any notice."
    rows = [(i, issuer, "annual_fee", text) for i, issuer in [(1, "B"), (2, "A"), (3, "A"), (4, "Z"), (5, "B")]]
    rows += [(9, "A", "other", text)]
    df = spark.createDataFrame(rows, "complaint_id bigint, issuer string, primary_theme string, narrative string").withColumn("quarter", F.lit("q"))
    pick = lambda d, n: sorted(r.complaint_id for r in themes.example_quotes(d, ["A", "B"], n).collect())
    assert pick(df, 3) == [1, 2, 4]
    assert pick(df, 4) == [1, 2, 3, 4]
    assert pick(df.filter("issuer <> 'Z'"), 3) == [1, 2, 3]


def test_summary_has_a_total(spark, s):
    got = {r.issuer: (r.sample_rows, r.narratives_represented) for r in themes.theme_summary(s).collect()}
    assert got == {"A": (3, 4), "B": (2, 4), None: (5, 8)}


# --- costs -------------------------------------------------------------------------------
PRICES = [("big", 4.0, 20.0, 0.2, 512, True, "p", 2.0, True), ("small", 1.0, 5.0, 0.1, 4096, False, "p", 1.0, False)]


def test_usage_costs(spark):
    prices = spark.createDataFrame(PRICES, PRICE_SCHEMA)
    m, zero = F.lit(1e6), F.lit(0.0)
    r = prices.filter("model = 'big'").select(
        costs.usage_cost(m, m, zero, zero, F.lit(False)), costs.usage_cost(m, m, zero, zero, F.lit(True)),
        costs.usage_cost(zero, zero, m, zero, F.lit(False)), costs.usage_cost(zero, zero, zero, m, F.lit(False)),
    ).first()
    assert tuple(r) == pytest.approx((24, 12, 0.2, 8))


def test_projection_ignores_the_cache_for_short_prompts(spark):
    prices = spark.createDataFrame(PRICES, PRICE_SCHEMA)
    sample = spark.createDataFrame([(i, "y" * 100) for i in range(20)], "complaint_id bigint, narrative string")
    ledger = spark.createDataFrame([("small", 3, "v1", "ok"), ("small", 99, "v1", "ok"), ("small", 4, "v1", "api_error")], "model string, complaint_id bigint, prompt_version string, status string")
    scenarios = [("none", 60, 300, 0.0), ("all", 60, 300, 1.0)]
    got = {(r.model, r.scenario): r for r in costs.cost_projection(sample, ledger, prices, 2_000_000, "v1", scenarios, budget=20).collect()}
    assert got["big", "none"].cost_usd > got["big", "all"].cost_usd
    assert got["big", "none"].requests == 3 and not got["big", "none"].within_budget
    got = {(r.model, r.scenario): r for r in costs.cost_projection(sample, ledger, prices, 4000, "v1", scenarios).collect()}
    assert got["small", "none"].cost_usd == got["small", "all"].cost_usd
    assert (got["small", "all"].rows_not_in_cache, got["big", "all"].rows_not_in_cache) == (19, 20)
    assert got["big", "all"].prompt_cacheable and not got["small", "all"].prompt_cacheable


def test_request_size_matches_the_packs(spark):
    from caselens.operators.sampling import request_packs

    sample = spark.createDataFrame([(i, "z" * (i * 37 % 90)) for i in range(1, 22)], "complaint_id bigint, narrative string")
    packs = request_packs(sample).select(F.length("text")).collect()
    assert costs.request_sizes(sample).first().avg_chars == pytest.approx(sum(p[0] for p in packs) / 3)


def test_measured_cost_needs_enough_rows(spark):
    prices = spark.createDataFrame(PRICES, PRICE_SCHEMA)
    rows = [("big", "v1", "ok", 1e6, 0.0, 0.0, 0.0)] * 3 + [("big", "v1", "api_error", 1e9, 0.0, 0.0, 0.0)]
    ledger = spark.createDataFrame(rows, "model string, prompt_version string, status string, " + ", ".join(f"{c} double" for c in costs.USAGE))
    assert costs.measured_cost(ledger, prices, "v1").first().cost_per_row_usd is None
    assert costs.measured_cost(ledger, prices, "v1", min_rows=3).first().cost_per_row_usd == pytest.approx(2.0)
