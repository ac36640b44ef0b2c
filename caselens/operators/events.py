"""Event study on shares: windows around an event, difference in differences, placebo range, series.

Everything runs over one long monthly panel (lens, metric, issuer, month, k, n). Events and windows
are short lists, so they are exploded onto the panel rows they touch; all placebo comparisons come
from one leave-one-out subtraction over the controls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions import rules
from caselens.functions.exprs import (
    Z_95,
    month_start,
    months_from,
    percent,
    round_even,
    share,
    share_change_variance,
)

CELL = ["k_pre", "n_pre", "k_post", "n_post"]


class EmptyCell(ValueError):
    """A difference in differences lacks rows in one of its four cells."""


# --- panels ------------------------------------------------------------------------------
def event_panels(value_panel: DataFrame, mentions: DataFrame, model_labels: DataFrame) -> DataFrame:
    """The seven monthly series as one long panel."""
    def long(df: DataFrame, lens: str, n: str, series: dict[str, str]) -> DataFrame:
        each = [
            F.struct(
                F.lit(lens).alias("lens"),
                F.lit(metric).alias("metric"),
                F.col(k).cast("bigint").alias("k"),
                F.col(n).cast("bigint").alias("n"),
            )
            for metric, k in series.items()
        ]
        return df.select("issuer", "month", F.inline(F.array(*each))).select(
            "lens", "metric", "issuer", "month", "k", "n"
        )

    theme = F.col("primary_theme")
    per_month = model_labels.groupBy("issuer", month_start("date_received").alias("month")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(theme.isin(rules.VALUE_THEMES)).alias("value"),
        F.count_if(theme == "annual_fee").alias("fee"),
    )
    sub_issues = {"fees_rewards_promo": "value_complaints", "fees": "fees", "rewards": "rewards"}
    mentioned = {"annual_fee": "mentions_annual_fee", "statement_credit": "mentions_statement_credit"}
    themed = {"membership_value": "value", "annual_fee": "fee"}
    return (
        long(value_panel, "sub_issue", "complaints", sub_issues)
        .unionByName(long(mentions, "mention", "narratives", mentioned))
        .unionByName(long(per_month, "theme", "n", themed))
    )


def _design(events: Sequence[tuple], windows: Sequence[int] | None = None) -> Column:
    """Array of (event, treated_issuer, event_month[, window_months])."""
    return F.array(
        *[
            F.struct(
                F.lit(key).alias("event"),
                F.lit(issuer).alias("treated_issuer"),
                F.lit(month).cast("date").alias("event_month"),
                *([F.lit(w).alias("window_months")] if w else []),
            )
            for key, issuer, month, *_ in events
            for w in (windows or [None])
        ]
    )


def _windowed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """k and n before and after the event per key; `months_after` counts months from the event on."""
    rel, m = F.col("rel"), F.col("window_months")
    before, after = rel.between(-m, -1), rel.between(0, m - 1)

    def total(c: str, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))

    return df.groupBy(*keys).agg(
        total("k", before).alias("k_pre"),
        total("n", before).alias("n_pre"),
        total("k", after).alias("k_post"),
        total("n", after).alias("n_post"),
        F.count_if(rel >= 0).alias("months_after"),
        F.count_if(after).alias("months_in_window"),
    )


# --- difference in differences -----------------------------------------------------------
def did(t: Sequence[Column], c: Sequence[Column], z: float = Z_95) -> dict[str, Column]:
    """Change of the treated share less change of the control share, from (k_pre, n_pre, k_post, n_post).

    Null wherever a cell has no rows.
    """
    t_pre, t_post = share(t[0], t[1]), share(t[2], t[3])
    c_pre, c_post = share(c[0], c[1]), share(c[2], c[3])
    change = (t_post - t_pre) - (c_post - c_pre)
    se = F.sqrt(share_change_variance((t[0], t[1]), (t[2], t[3]), (c[0], c[1]), (c[2], c[3])))
    valid = (F.least(t[1], t[3], c[1], c[3]) > 0)
    columns = {
        "treated_pre": t_pre,
        "treated_post": t_post,
        "control_pre": c_pre,
        "control_post": c_post,
        "treated_change": t_post - t_pre,
        "control_change": c_post - c_pre,
        "did": change,
        "se": se,
        "ci_low": change - z * se,
        "ci_high": change + z * se,
    }
    return {name: F.when(valid, x) for name, x in columns.items()} | {"valid": valid}


def event_study(
    panels: DataFrame,
    events: Sequence[tuple] = rules.EVENTS,
    controls: Sequence[str] = rules.CONTROL_ISSUERS,
    windows: Sequence[int] = rules.EVENT_WINDOWS,
    strict: bool = False,
) -> DataFrame:
    """Treated issuer against pooled controls per event, metric and window, with the placebo range.

    A comparison with an empty cell has nulls and valid = false; with `strict` it is an error.
    """
    key = ["event", "treated_issuer", "lens", "metric", "window_months"]
    is_treated = F.col("issuer") == F.col("treated_issuer")
    is_control = F.col("issuer").isin(list(controls))
    cells = _windowed(
        panels.select("*", F.inline(_design(events, windows)))
        .filter(is_treated | is_control)
        .withColumn("rel", months_from(F.col("event_month"), F.col("month"))),
        [*key, "issuer"],
    )
    pool = Window.partitionBy(*key)
    pooled = {f"pool_{c}": F.sum(F.when(is_control, F.col(c)).otherwise(0)).over(pool) for c in CELL}
    one = [F.col(c) for c in CELL]
    rest = [F.col(f"pool_{c}") - F.col(c) for c in CELL]
    study = (
        cells.withColumns(pooled)
        .withColumn("placebo", F.when(is_control, did(one, rest)["did"]))
        .groupBy(*key)
        .agg(
            *[F.coalesce(F.sum(F.when(is_treated, F.col(c))), F.lit(0)).alias(f"t_{c}") for c in CELL],
            *[F.max(f"pool_{c}").alias(f"c_{c}") for c in CELL],
            F.coalesce(F.max(F.when(is_treated, F.col("months_after"))), F.lit(0)).alias("months_after"),
            F.min("placebo").alias("placebo_min"),
            F.max("placebo").alias("placebo_max"),
        )
        .withColumns(did([F.col(f"t_{c}") for c in CELL], [F.col(f"c_{c}") for c in CELL]))
    )
    if strict and study.filter(~F.col("valid")).limit(1).count():
        raise EmptyCell("every cell needs at least one complaint")
    inside = F.col("did").between(F.col("placebo_min"), F.col("placebo_max"))

    def pct(c: str, name: str) -> Column:
        return round_even(100.0 * F.col(c), 2).alias(name)

    return study.select(
        *key,
        *[pct(c, f"{c}_pct") for c in ("treated_pre", "treated_post", "control_pre", "control_post")],
        *[pct(c, f"{c}_pts") for c in ("treated_change", "control_change", "did")],
        pct("ci_low", "did_ci_low_pts"),
        pct("ci_high", "did_ci_high_pts"),
        F.col("t_n_pre").alias("n_treated_pre"),
        F.col("t_n_post").alias("n_treated_post"),
        F.col("c_n_pre").alias("n_control_pre"),
        F.col("c_n_post").alias("n_control_post"),
        pct("placebo_min", "placebo_did_min_pts"),
        pct("placebo_max", "placebo_did_max_pts"),
        F.coalesce(~inside, F.lit(False)).alias("outside_placebo_range"),
        F.least(F.col("window_months").cast("bigint"), "months_after").alias("post_months_observed"),
        "valid",
    )


# --- monthly series ----------------------------------------------------------------------
def _series(monthly: DataFrame, keys: Sequence[str], lo: int, hi: int) -> DataFrame:
    """Share and rolling share over the last three months observed, then cut to the months shown."""
    three = Window.partitionBy(*keys).orderBy("month").rowsBetween(-2, 0)
    rel = months_from(F.col("event_month"), F.col("month"))
    return (
        monthly.withColumns(
            {
                "rel_month": rel,
                "share_pct": round_even(percent("k", "n"), 2),
                "share_pct_3m": round_even(percent(F.sum("k").over(three), F.sum("n").over(three)), 2),
            }
        )
        .filter(F.col("rel_month").between(lo, hi))
        .select("event", "lens", "metric", "group", "month", "rel_month", "k", "n", "share_pct", "share_pct_3m")
    )


def event_monthly(
    panels: DataFrame,
    events: Sequence[tuple] = rules.EVENTS,
    controls: Sequence[str] = rules.CONTROL_ISSUERS,
    lo: int = rules.SERIES_FROM_MONTH,
    hi: int = rules.SERIES_TO_MONTH,
) -> DataFrame:
    """Monthly treated and comparison shares around each event."""
    is_control = F.col("issuer").isin(list(controls))
    group = F.when(F.col("issuer") == F.col("treated_issuer"), "treated").when(is_control, "comparison")
    keys = ["event", "lens", "metric", "group"]
    monthly = (
        panels.select("*", F.inline(_design(events)))
        .withColumn("group", group)
        .filter(F.col("group").isNotNull())
        .groupBy(*keys, "month", "event_month")
        .agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    )
    return _series(monthly, keys, lo, hi)


# --- the product named -------------------------------------------------------------------
def _named(mentions: DataFrame, events: Sequence[tuple]) -> DataFrame:
    """Narratives of the treated issuer that name the event's product, by month."""
    chain = F
    for key, _, _, column, *_ in events:
        chain = chain.when(F.col("event") == key, F.col(column))
    return (
        mentions.select("*", F.inline(_design(events)))
        .filter(F.col("issuer") == F.col("treated_issuer"))
        .select(
            "event",
            "treated_issuer",
            "event_month",
            F.lit("mention").alias("lens"),
            F.lit("refreshed_card_named").alias("metric"),
            F.lit("treated").alias("group"),
            "month",
            chain.alias("k"),
            F.col("narratives").alias("n"),
        )
    )


def named_product_monthly(
    mentions: DataFrame,
    events: Sequence[tuple] = rules.EVENTS,
    lo: int = rules.SERIES_FROM_MONTH,
    hi: int = rules.SERIES_TO_MONTH,
) -> DataFrame:
    return _series(_named(mentions, events), ["event", "lens", "metric", "group"], lo, hi)


def event_named_product(
    mentions: DataFrame,
    events: Sequence[tuple] = rules.EVENTS,
    windows: Sequence[int] = rules.EVENT_WINDOWS,
    lo: int = rules.SERIES_FROM_MONTH,
    hi: int = rules.SERIES_TO_MONTH,
) -> DataFrame:
    """Levels before and after for the product named. There is no control group, so those are null."""
    key = ["event", "treated_issuer", "lens", "metric", "window_months"]
    widths = F.array(*[F.lit(w) for w in windows])
    shown = (
        _named(mentions, events)
        .withColumn("rel", months_from(F.col("event_month"), F.col("month")))
        .filter(F.col("rel").between(lo, hi))
        .select("*", F.explode(widths).alias("window_months"))
    )
    pre, post = percent("k_pre", "n_pre"), percent("k_post", "n_post")
    change = 100.0 * (share("k_post", "n_post") - share("k_pre", "n_pre"))
    no_double, no_count = F.lit(None).cast("double"), F.lit(None).cast("bigint")
    return _windowed(shown, key).select(
        *key,
        round_even(pre, 2).alias("treated_pre_pct"),
        round_even(post, 2).alias("treated_post_pct"),
        no_double.alias("control_pre_pct"),
        no_double.alias("control_post_pct"),
        round_even(change, 2).alias("treated_change_pts"),
        no_double.alias("did_pts"),
        F.col("n_pre").alias("n_treated_pre"),
        F.col("n_post").alias("n_treated_post"),
        no_count.alias("n_control_pre"),
        no_count.alias("n_control_post"),
        F.col("k_pre").alias("k_treated_pre"),
        F.col("k_post").alias("k_treated_post"),
        F.col("months_in_window").alias("post_months_observed"),
    )
