"""Weighted theme tables from a labelled sample, and example quotes.

The sample stands for all narratives through its weights. Themes are a fixed list, so each table is
one aggregate with a conditional sum per theme, which also gives the zero rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions import rules
from caselens.functions.exprs import (
    as_col,
    focus_group,
    kish_size,
    lookup,
    one_spaced,
    percent,
    round_even,
    share,
    unicode_regex,
    wilson_bounds,
)
from caselens.operators.benchmark import ALL_ISSUERS

OTHERS = "Other issuers"


def _theme_label(theme: str = "theme") -> Column:
    return lookup(F.col(theme), rules.THEME_LABELS).alias("theme_label")


def _weight_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("weight"))), F.lit(0.0))


def _two(x: Column, name: str) -> Column:
    return round_even(x, 2).alias(name)


def weighted_shares(df: DataFrame, keys: Sequence[str], category: str, weight: str = "weight") -> DataFrame:
    """Weight, rows and share of each category within its group."""
    cells = df.groupBy(*keys, category).agg(F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("n"))
    group = F.sum("weight").over(Window.partitionBy(*keys))
    return cells.withColumn("share", share("weight", group))


def timely_rate(df: DataFrame, keys: Sequence[str] = (), flag: str = "timely_response") -> DataFrame:
    """Share answered in time among rows that say Yes or No; null when none does."""
    known = F.count_if(F.col(flag).isin("Yes", "No"))
    return df.groupBy(*keys).agg(share(F.count_if(F.col(flag) == "Yes"), known).alias("rate"))


def theme_mix(s: DataFrame, themes: Sequence[str] = rules.THEMES) -> DataFrame:
    """Weighted share of every theme per issuer, with an interval on the effective sample size."""
    def cell(theme: str) -> Column:
        hit = F.col("primary_theme") == theme
        return F.struct(
            F.lit(theme).alias("theme"),
            F.count_if(hit).alias("sample_rows"),
            _weight_if(hit).alias("hit_weight"),
        )

    per_theme = s.groupBy("issuer").agg(
        F.count(F.lit(1)).alias("issuer_sample_rows"),
        F.sum("weight").alias("total"),
        kish_size("weight").alias("n_eff"),
        F.array(*[cell(t) for t in themes]).alias("cells"),
    )
    p = share("hit_weight", "total")
    low, high = wilson_bounds(F.rint(p * F.col("n_eff")), F.rint("n_eff"))
    return per_theme.select("*", F.inline("cells")).select(
        "issuer",
        "theme",
        _theme_label(),
        "sample_rows",
        "issuer_sample_rows",
        _two(100.0 * p, "share_pct"),
        _two(100.0 * low, "ci_low_pct"),
        _two(100.0 * high, "ci_high_pct"),
    )


def theme_vs_peers(
    s: DataFrame,
    focus: str,
    themes: Sequence[str] = rules.THEMES,
    value_themes: Sequence[str] = rules.VALUE_THEMES,
) -> DataFrame:
    """Weighted theme share of the focus issuer against all others pooled."""
    own = F.col("issuer") == focus

    def cell(theme: str) -> Column:
        hit = F.col("primary_theme") == theme
        return F.struct(
            F.lit(theme).alias("theme"),
            _weight_if(own & hit).alias("own_w"),
            _weight_if(~own & hit).alias("peer_w"),
            F.count_if(own & hit).alias("focus_sample_rows"),
            F.count_if(~own & hit).alias("peers_sample_rows"),
        )

    totals = s.agg(
        _weight_if(own).alias("own_total"),
        _weight_if(~own).alias("peer_total"),
        kish_size(F.when(own, F.col("weight"))).alias("n_eff"),
        F.array(*[cell(t) for t in themes]).alias("cells"),
    )
    a, p = share("own_w", "own_total"), share("peer_w", "peer_total")
    low, high = wilson_bounds(F.rint(a * F.col("n_eff")), F.rint("n_eff"))
    return totals.select("*", F.inline("cells")).select(
        "theme",
        _theme_label(),
        F.col("theme").isin(list(value_themes)).alias("membership_value_theme"),
        _two(100.0 * a, "focus_share_pct"),
        _two(100.0 * low, "focus_ci_low_pct"),
        _two(100.0 * high, "focus_ci_high_pct"),
        _two(100.0 * p, "peers_share_pct"),
        _two(100.0 * (a - p), "diff_pts"),
        _two(share(a, p), "index_vs_peers"),
        "focus_sample_rows",
        "peers_sample_rows",
    )


def theme_relief(s: DataFrame, focus: str, themes: Sequence[str] = rules.THEMES) -> DataFrame:
    """Weighted monetary relief rate per theme, focus against peers. A missing response counts as closed."""
    with_outcome = s.filter(~F.col("company_response").eqNullSafe(rules.IN_PROGRESS))
    own = F.col("issuer") == focus
    relieved = F.col("company_response").eqNullSafe(rules.MONETARY_RELIEF)

    def cell(theme: str) -> Column:
        hit = F.col("primary_theme") == theme
        sides = [("focus", own & hit), ("peers", ~own & hit)]
        return F.struct(
            F.lit(theme).alias("theme"),
            *[F.count_if(who).alias(f"{name}_sample_rows") for name, who in sides],
            *[
                percent(_weight_if(who & relieved), _weight_if(who)).alias(f"{name}_relief")
                for name, who in sides
            ],
        )

    return with_outcome.agg(F.array(*[cell(t) for t in themes]).alias("cells")).select(F.inline("cells")).select(
        "theme",
        _theme_label(),
        "focus_sample_rows",
        _two(F.col("focus_relief"), "focus_relief_pct"),
        "peers_sample_rows",
        _two(F.col("peers_relief"), "peers_relief_pct"),
    )


def theme_sentiment(s: DataFrame, focus: str) -> DataFrame:
    """Weighted sentiment share within each theme of the focus issuer."""
    cells = (
        s.filter(F.col("issuer") == focus)
        .groupBy("primary_theme", "sentiment")
        .agg(F.sum("weight").alias("w"))
    )
    theme_weight = F.sum("w").over(Window.partitionBy("primary_theme"))
    return (
        cells.withColumn("share", percent("w", theme_weight))
        .filter(F.col("sentiment").isNotNull())
        .select("primary_theme", "sentiment", _two(F.col("share"), "share_pct"), _theme_label("primary_theme"))
    )


def top_named(s: DataFrame, column: str, focus: str, top: int = 15, others: str = OTHERS) -> DataFrame:
    """Most often named values, ignoring case, for the focus issuer and for the others.

    `column` holds text or a list of text. The spelling shown is the first one by complaint id.
    """
    group = focus_group("issuer", focus, others).alias("group")
    listed = dict(s.dtypes)[column].startswith("array")
    values = F.col(column) if listed else F.array(column)
    names = (
        s.select(group, "complaint_id", F.posexplode(values).alias("pos", "name"))
        .withColumn("name", F.regexp_replace("name", r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""))
        .filter(F.col("name") != "")
    )
    counted = names.groupBy("group", F.lower("name").alias("key")).agg(
        F.count(F.lit(1)).alias("mentions"),
        F.min_by("name", F.struct("complaint_id", "pos")).alias("name"),
    )
    most = Window.partitionBy("group").orderBy(F.desc("mentions"), "key")
    return (
        counted.withColumn("_n", F.row_number().over(most))
        .filter(F.col("_n") <= top)
        .select("group", "name", "mentions")
    )


# --- quotes ------------------------------------------------------------------------------
def quotes_in(narrative: Column | str, theme: Column | str) -> Column:
    """Array with the first sentence of quotable length that is on the theme and not heavily redacted.

    Empty or null when there is none.
    """
    narrative, theme = as_col(narrative), as_col(theme)
    sentences = F.split(one_spaced(narrative), r"(?<=[.!?]) +")

    def first_on(rule: str | None) -> Column:
        def fits(x: Column) -> Column:
            size = F.length(x).between(rules.QUOTE_MIN_CHARS, rules.QUOTE_MAX_CHARS)
            readable = (F.regexp_count(x, F.lit("XX")) <= 1) & ~F.contains(x, F.lit("{$"))
            return size & readable & (x.rlike(unicode_regex(rule)) if rule else F.lit(True))

        return F.slice(F.filter(sentences, fits), 1, 1)

    chain = F
    for name, rule in rules.THEME_RULES.items():
        chain = chain.when(theme == name, first_on(rule))
    return chain.otherwise(first_on(None))


def pick_quote(narrative: Column | str, theme: Column | str) -> Column:
    """The quote of a narrative, or null."""
    return F.get(quotes_in(narrative, theme), F.lit(0))


def example_quotes(
    s: DataFrame,
    issuers: Sequence[str] = ALL_ISSUERS,
    max_per_theme: int = rules.QUOTES_PER_THEME,
) -> DataFrame:
    """Up to `max_per_theme` quotes per theme: issuers in the given order, one each before repeats."""
    place = lookup(F.col("issuer"), {i: str(n) for n, i in enumerate(issuers)}).cast("int")
    within = Window.partitionBy("theme", "issuer").orderBy("complaint_id")
    over_theme = Window.partitionBy("theme").orderBy(
        F.col("_n") > 1, F.col("_place").asc_nulls_last(), "complaint_id"
    )
    return (
        s.filter(F.col("primary_theme") != "other")
        .select(
            F.col("primary_theme").alias("theme"),
            "complaint_id",
            "issuer",
            "quarter",
            place.alias("_place"),
            F.explode(quotes_in("narrative", "primary_theme")).alias("text"),
        )
        .withColumn("_n", F.row_number().over(within))
        .filter(F.col("_n") <= max_per_theme)
        .withColumn("_m", F.row_number().over(over_theme))
        .filter(F.col("_m") <= max_per_theme)
        .select("theme", "complaint_id", "issuer", "quarter", "text")
    )


def theme_summary(s: DataFrame) -> DataFrame:
    """Sample rows and narratives represented, per issuer and (issuer null) in total."""
    return s.rollup("issuer").agg(
        F.count(F.lit(1)).alias("sample_rows"),
        F.rint(F.sum("weight")).cast("bigint").alias("narratives_represented"),
    )
