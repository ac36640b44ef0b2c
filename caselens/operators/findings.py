"""One number per headline, computed once: fact tables and chart feeds over the other operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions import rules
from caselens.functions.exprs import lookup, n_rows, percent, round_even, share
from caselens.operators.costs import spend_rollup

CHART_METRICS = [
    ("sub_issue", "fees_rewards_promo"),
    ("sub_issue", "rewards"),
    ("sub_issue", "fees"),
    ("mention", "annual_fee"),
    ("mention", "statement_credit"),
    ("mention", "refreshed_card_named"),
    ("theme", "membership_value"),
]


def _long(df: DataFrame, section: str, facts: Sequence[tuple[str, Column | None, Column | None]]) -> DataFrame:
    """(section, key, subkey, value, text) rows from a one-row frame."""
    none = F.lit(None)
    rows = [
        F.struct(
            F.lit(section).alias("section"),
            F.lit(key).alias("key"),
            none.cast("string").alias("subkey"),
            (none if value is None else value).cast("double").alias("value"),
            (none if text is None else text).cast("string").alias("text"),
        )
        for key, value, text in facts
    ]
    return df.select(F.inline(F.array(*rows)))


# --- facts -------------------------------------------------------------------------------
def facts_data(c: DataFrame, cards: DataFrame, focus: str) -> DataFrame:
    """Counts and dates of the data set, with the focus issuer's part."""
    own, told = F.col("issuer") == focus, F.col("narrative").isNotNull()
    all_cards = cards.agg(n_rows().alias("n")).scalar()
    one = c.agg(
        n_rows().alias("complaints"),
        F.count("narrative").alias("narratives"),
        F.min("date_received").alias("first_date"),
        F.max("date_received").alias("last_date"),
        F.max(F.when(told, F.col("date_received"))).alias("last_narrative_date"),
        F.count_if(own).alias("focus_complaints"),
        F.count_if(own & told).alias("focus_narratives"),
        F.count_distinct("issuer").alias("issuers"),
    ).withColumn("all_card_complaints", all_cards)
    dates = ["first_date", "last_date", "last_narrative_date"]
    return _long(
        one, "data", [(k, None, F.col(k)) if k in dates else (k, F.col(k), None) for k in one.columns]
    )


def facts_sub_issue(
    mix: DataFrame,
    relief: DataFrame,
    evidence: DataFrame,
    focus: str,
    sub_issues: dict[str, str] = rules.HEADLINE_SUB_ISSUES,
    patterns: Sequence[str] = tuple(rules.EVIDENCE_PATTERNS),
) -> DataFrame:
    """Mix, relief and keyword rates side by side for the headline sub-issues of the focus issuer."""
    own = mix.filter((F.col("issuer") == focus) & F.col("sub_issue").isin(list(sub_issues.values())))
    is_focus = F.col("issuer_group") == focus

    def side(name: str, who: Column, column: str) -> Column:
        return F.max(F.when(who, F.col(column))).alias(name)

    rates = evidence.groupBy("sub_issue").agg(
        side("focus_narratives", is_focus, "narratives"),
        *[side(f"focus_{p}_pct", is_focus, f"{p}_pct") for p in patterns],
        *[side(f"peers_{p}_pct", ~is_focus, f"{p}_pct") for p in patterns],
    )
    key_of = lookup(F.col("sub_issue"), {v: k for k, v in sub_issues.items()})
    return (
        own.join(relief.drop("focus_complaints", "peers_complaints"), ["issue", "sub_issue"], "left")
        .join(rates, "sub_issue", "left")
        .withColumn("key", key_of)
        .drop("issuer")
    )


def facts_response(outcomes: DataFrame, timely: DataFrame, focus: str) -> DataFrame:
    """Relief rate per issuer, the focus issuer's place (tied places averaged, cut to whole), worst timeliness."""
    relief = F.col("monetary_relief_pct")
    own = outcomes.filter(F.col("issuer") == focus).agg(F.max("monetary_relief_pct").alias("own")).scalar()
    average_place = F.count_if(relief > F.col("own")) + (F.count_if(relief == F.col("own")) + 1) / 2
    placed = outcomes.withColumn("own", own).agg(
        F.max("own").alias("own"), F.floor(average_place).alias("place")
    )
    worst = timely.agg(
        F.min("timely_pct").alias("everyone"),
        F.min(F.when(F.col("issuer") == focus, F.col("timely_pct"))).alias("own"),
    )
    headline = _long(
        placed, "response", [("focus_relief_pct", F.col("own"), None), ("focus_relief_rank", F.col("place"), None)]
    ).unionByName(
        _long(worst, "response", [("timely_pct_min", F.col("everyone"), None), ("timely_pct_focus_min", F.col("own"), None)])
    )
    each = outcomes.select(
        F.lit("response").alias("section"),
        F.lit("relief_by_issuer").alias("key"),
        F.col("issuer").alias("subkey"),
        relief.alias("value"),
        F.lit(None).cast("string").alias("text"),
    )
    return headline.unionByName(each)


def facts_volume(rates: DataFrame, year: int, focus: str) -> DataFrame:
    """The focus issuer's rate and place in one year, and the issuers with the lowest and highest rate."""
    pair = F.struct("complaints_per_unit", "issuer")
    in_year = rates.filter(F.col("year") == year)
    own = in_year.filter(F.col("issuer") == focus).agg(F.max(pair).alias("own")).scalar()
    one = in_year.withColumn("own", own).agg(
        F.max("own.complaints_per_unit").alias("rate"),
        (F.count_if(pair < F.col("own")) + 1).alias("place"),
        F.min(pair).alias("low"),
        F.max(pair).alias("high"),
    )
    return _long(
        one,
        "volume",
        [
            ("year", F.lit(year), None),
            ("focus_rate", F.col("rate"), None),
            ("focus_rank_lowest_first", F.col("place"), None),
            ("lowest", F.col("low.complaints_per_unit"), F.col("low.issuer")),
            ("highest", F.col("high.complaints_per_unit"), F.col("high.issuer")),
        ],
    )


def facts_events(study: DataFrame) -> DataFrame:
    """Every number of the event study as (event, lens:metric, window, measure, value)."""
    keys = ["event", "treated_issuer", "lens", "metric", "window_months"]
    measures = [c for c in study.columns if c not in keys]
    numeric = study.select(
        "event",
        F.concat_ws(":", "lens", "metric").alias("key"),
        "window_months",
        *[F.col(c).cast("double").alias(c) for c in measures],
    )
    return numeric.unpivot(["event", "key", "window_months"], measures, "measure", "value")


def facts_themes(summary: DataFrame, vs_peers: DataFrame) -> DataFrame:
    """Sample size, narratives represented and the focus-against-peers numbers per theme."""
    counts = summary.select(
        F.lit("themes").alias("section"),
        F.inline(
            F.array(
                F.struct(F.lit("sample_rows").alias("key"), F.col("sample_rows").cast("double").alias("value")),
                F.struct(
                    F.lit("narratives_represented").alias("key"),
                    F.col("narratives_represented").cast("double").alias("value"),
                ),
            )
        ),
        F.col("issuer").alias("subkey"),
    )
    measures = [c for c in vs_peers.columns if c not in ("theme", "theme_label", "membership_value_theme")]
    each = vs_peers.select("theme", *[F.col(c).cast("double").alias(c) for c in measures]).unpivot(
        ["theme"], measures, "key", "value"
    )
    return counts.select("section", "key", "subkey", "value").unionByName(
        each.select(F.lit("themes").alias("section"), "key", F.col("theme").alias("subkey"), "value")
    )


def facts_label_run(ledger: DataFrame, model: str) -> DataFrame:
    """Requests, failures, output size, cache use and cut texts of one model, and attempts by status."""
    used = ledger.filter((F.col("model") == model) & (F.col("status") != "api_error")).agg(
        F.count_distinct("pack_id").alias("requests_sent"),
        F.count_if(F.col("status") != "ok").alias("rows_without_valid_label"),
        round_even(share(F.sum("output_tokens"), F.count("output_tokens")), 1).alias("avg_output_tokens_per_row"),
        round_even(
            percent(F.sum("cache_read_tokens"), F.sum("input_tokens") + F.sum("cache_read_tokens")), 1
        ).alias("cache_read_share_of_input_pct"),
        F.count_if("narrative_truncated").alias("narratives_cut_for_length"),
    )
    by_status = ledger.groupBy("status").agg(n_rows().alias("n"))
    return _long(used, "label_run", [(c, F.col(c), None) for c in used.columns]).unionByName(
        by_status.select(
            F.lit("label_run").alias("section"),
            F.lit("rows_by_status").alias("key"),
            F.col("status").alias("subkey"),
            F.col("n").cast("double").alias("value"),
            F.lit(None).cast("string").alias("text"),
        )
    )


def facts_label_totals(
    sample: DataFrame, labelled: DataFrame, ledger: DataFrame, prices: DataFrame, budget: float = rules.BUDGET_USD
) -> DataFrame:
    """Rows sampled and labelled, and what all attempts have cost against the budget."""
    sampled = sample.agg(n_rows().alias("sample_rows"))
    done = labelled.filter(F.col("label_source") == rules.FROM_LABELS).agg(n_rows().alias("rows_labelled"))
    spent = spend_rollup(ledger, prices).agg(round_even(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("spend_usd"))
    spent = spent.withColumn("budget_usd", F.lit(float(budget)))
    out = _long(sampled, "label_run", [("sample_rows", F.col("sample_rows"), None)])
    for df in (done, spent):
        out = out.unionByName(_long(df, "label_run", [(c, F.col(c), None) for c in df.columns]))
    return out


# --- chart feeds -------------------------------------------------------------------------
def chart_extremes(mix: DataFrame, focus: str, floor: int = 150, head: int = 7, tail: int = 6) -> DataFrame:
    """Sub-issues with the largest positive and negative difference, above a size floor.

    With fewer than head + tail sub-issues some are in both parts, once each.
    """
    own = mix.filter((F.col("issuer") == focus) & (F.col("complaints") >= floor)).drop("issuer")
    down = [F.desc("diff_vs_peers_pts"), F.asc("issue"), F.asc("sub_issue")]
    back = [F.asc("diff_vs_peers_pts"), F.desc("issue"), F.desc("sub_issue")]
    first = own.orderBy(*down).limit(head).withColumn("part", F.lit("head"))
    return first.unionByName(own.orderBy(*back).limit(tail).withColumn("part", F.lit("tail")))


def chart_issue_heat(mix: DataFrame, top: int = 9) -> DataFrame:
    """Share of the `top` largest issues for every issuer, one decimal, missing cells as zero."""
    largest = (
        mix.groupBy("issue")
        .agg(F.sum("complaints").alias("all_complaints"))
        .orderBy(F.desc("all_complaints"), "issue")
        .limit(top)
    )
    return mix.join(largest, "issue").select(
        "issuer",
        "issue",
        "all_complaints",
        round_even(F.coalesce("share_pct", F.lit(0.0)), 1).alias("share_pct"),
    )


def heat_matrix(heat: DataFrame, column: str, columns: Sequence[str], value: str = "share_pct") -> DataFrame:
    """A heat feed as a matrix: one row per issuer, the given columns in their order, zero filled."""
    return heat.groupBy("issuer").pivot(column, list(columns)).agg(F.max(value)).na.fill(0.0)


def issue_matrix(heat: DataFrame, issuers: Sequence[str]) -> DataFrame:
    """The issue heat as a matrix: issuers in the given order (`row`), issues by falling size as an array of names and
    one of shares, zero filled."""
    # One entry per issue kept.
    names = heat.select("issue", "all_complaints").distinct().agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("all_complaints")).alias("n"), "issue"))), lambda x: x["issue"]).alias("issues")
    )
    cells = heat.groupBy("issuer").agg(F.map_from_entries(F.collect_list(F.struct("issue", "share_pct"))).alias("cells"))
    place = F.array_position(F.array(*[F.lit(i) for i in issuers]), F.col("issuer")).cast("int")
    share = F.transform("issues", lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(0.0)))
    return cells.withColumn("issues", names.scalar()).select(
        place.alias("row"), "issuer", F.array_join("issues", ";").alias("issues"), F.array_join(share.cast("array<string>"), ";").alias("shares")
    )


def chart_theme_heat(mix: DataFrame, themes: Sequence[str] = rules.THEMES) -> DataFrame:
    """Theme share per issuer as a matrix, one decimal."""
    short = mix.withColumn("share_pct", round_even(F.col("share_pct"), 1))
    return heat_matrix(short, "theme", themes)


def chart_trend_index(trend: DataFrame, base_year: int = 2023) -> DataFrame:
    """Smoothed complaints against the issuer's own base-year mean, one decimal."""
    base = trend.filter(F.year("month") == base_year).groupBy("issuer").agg(F.avg("complaints").alias("base"))
    return trend.join(base, "issuer", "left").select(
        "issuer", "month", round_even(percent("complaints_3m_avg", "base"), 1).alias("index")
    )


def chart_relief(outcomes: DataFrame) -> DataFrame:
    return outcomes.select("issuer", "monetary_relief_pct", "closed_complaints")


def chart_relief_by_sub_issue(
    facts: DataFrame, keys: Sequence[str] = ("fees", "promo_terms", "rewards")
) -> DataFrame:
    """Relief rate of the focus issuer and its peers for the value sub-issues among the headline facts."""
    return facts.filter(F.col("key").isin(list(keys))).select(
        "issue", "sub_issue", "focus_relief_pct", "peers_relief_pct"
    )


def chart_per_volume(rates: DataFrame, year: int) -> DataFrame:
    """Complaints per unit of volume in one year."""
    return rates.filter(F.col("year") == year)


def chart_top_benefits(named: DataFrame, focus: str, top: int = 12) -> DataFrame:
    own = named.filter(F.col("group") == focus)
    return own.orderBy(F.desc("mentions"), F.lower("name")).limit(top).select("name", "mentions")


def chart_very_negative(sentiment: DataFrame) -> DataFrame:
    return sentiment.filter(F.col("sentiment") == "very_negative").select("theme_label", "share_pct")


def _charted(df: DataFrame, metrics: Sequence[tuple[str, str]]) -> DataFrame:
    return df.filter(F.struct("lens", "metric").isin([F.struct(F.lit(a), F.lit(b)) for a, b in metrics]))


def chart_event_summary(study: DataFrame, metrics: Sequence[tuple[str, str]] = CHART_METRICS) -> DataFrame:
    """Levels, effect, interval and placebo range of the charted metrics for every window."""
    return _charted(study, metrics).select(
        "event", "lens", "metric", "window_months", "treated_pre_pct", "treated_post_pct", "control_pre_pct",
        "control_post_pct", "did_pts", "did_ci_low_pts", "did_ci_high_pts", "placebo_did_min_pts",
        "placebo_did_max_pts",
    )


def chart_event_series(
    monthly: DataFrame,
    study: DataFrame,
    metrics: Sequence[tuple[str, str]] = CHART_METRICS,
) -> DataFrame:
    """Smoothed series of the charted metrics, each month with the numbers of the shortest window."""
    numbers = ["treated_pre_pct", "treated_post_pct", "control_pre_pct", "control_post_pct", "did_pts"]
    shortest = study.groupBy("event", "lens", "metric").agg(
        F.min_by(F.struct("window_months", *numbers), "window_months").alias("s")
    )
    return (
        _charted(monthly, metrics)
        .join(shortest, ["event", "lens", "metric"], "left")
        .select("event", "lens", "metric", "group", "month", "share_pct_3m", "s.*")
    )

