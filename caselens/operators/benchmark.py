"""Issuer against pooled peers: volume, trend, mix, outcomes, rates, keyword rates.

Every operator aggregates the rows once, with map-side partial sums, and does the rest on the small
result. Grids of issuer by category come out of that one aggregate as conditional counts per issuer.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions import rules
from caselens.functions.exprs import (
    ascii_regex,
    focus_group,
    known_fragments,
    matches,
    n_rows,
    percent,
    percent_where,
    round_up,
    share,
    with_search_columns,
)

ALL_ISSUERS = list(rules.ISSUER_BY_COMPANY.values())


def volume_by_quarter(c: DataFrame) -> DataFrame:
    return c.groupBy("issuer", "quarter").agg(
        n_rows().alias("complaints"),
        F.count_if("has_narrative").alias("with_narrative"),
        percent_where(F.col("has_narrative"), 1).alias("narrative_pct"),
    )


def monthly_trend(c: DataFrame, cards: DataFrame, base_year: int = 2023) -> DataFrame:
    """Monthly count, share of all companies' complaints, index on the base year, 3-row mean.

    An issuer without a month in the base year has nothing to be indexed on and is left out.
    """
    monthly = c.groupBy("issuer", "month").agg(n_rows().alias("complaints"))
    everyone = cards.groupBy("month").agg(n_rows().alias("everyone"))
    per_issuer = Window.partitionBy("issuer")
    last_three = per_issuer.orderBy("month").rowsBetween(-2, 0)
    in_base = F.when(F.year("month") == base_year, F.col("complaints"))
    return (
        monthly.withColumn("base", F.avg(in_base).over(per_issuer))
        .filter(F.col("base").isNotNull())
        .join(everyone, "month")
        .withColumn("recent", F.avg("complaints").over(last_three))
        .select(
            "issuer",
            "month",
            "complaints",
            round_up(percent("complaints", "everyone"), 2).alias("share_of_all_pct"),
            round_up(percent("complaints", "base"), 1).alias("index_vs_base_avg"),
            round_up(F.col("recent"), 1).alias("complaints_3m_avg"),
        )
    )


def _mix(c: DataFrame, category: Sequence[str], issuers: Sequence[str]) -> DataFrame:
    """Counts for every issuer and category, zero where there are none, with pooled-peer counts."""
    category = list(category)
    per_issuer = F.array(
        *[
            F.struct(F.lit(i).alias("issuer"), F.count_if(F.col("issuer") == i).alias("n"))
            for i in issuers
        ]
    )
    grid = c.groupBy(*category).agg(per_issuer.alias("cells")).select(*category, F.inline("cells"))
    whole = F.sum("n").over(Window.partitionBy("issuer"))
    # A null category counts in an issuer's total but never matches its own grid cell.
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in category])
    counted = (
        grid.withColumn("total", whole)
        .filter(F.col("total") > 0)
        .withColumn("n", F.when(known, F.col("n")).otherwise(F.lit(0)))
    )
    pool = Window.partitionBy(*category)
    return counted.withColumns(
        {
            "peers_n": F.sum("n").over(pool) - F.col("n"),
            "peers_total": F.sum("total").over(pool) - F.col("total"),
        }
    )


def _mix_columns() -> list[Column]:
    own, peers = percent("n", "total"), percent("peers_n", "peers_total")
    return [
        F.col("n").alias("complaints"),
        round_up(own, 2).alias("share_pct"),
        round_up(peers, 2).alias("peers_share_pct"),
        round_up(own - peers, 2).alias("diff_vs_peers_pts"),
        round_up(share(share("n", "total"), share("peers_n", "peers_total")), 2).alias("index_vs_peers"),
    ]


def issue_mix(c: DataFrame, issuers: Sequence[str] = ALL_ISSUERS) -> DataFrame:
    return _mix(c, ["issue"], issuers).select("issuer", "issue", *_mix_columns())


def sub_issue_mix(c: DataFrame, issuers: Sequence[str] = ALL_ISSUERS) -> DataFrame:
    filled = c.withColumn("sub_issue", F.coalesce("sub_issue", F.lit("(none)")))
    return (
        _mix(filled, ["issue", "sub_issue"], issuers)
        .filter(F.col("n") > 0)
        .select("issuer", "issue", "sub_issue", *_mix_columns())
    )


def closed(c: DataFrame) -> DataFrame:
    """Complaints with an outcome; a missing response counts as none."""
    return c.filter(F.col("company_response") != rules.IN_PROGRESS)


def response_outcomes(c: DataFrame) -> DataFrame:
    response = F.col("company_response")
    return closed(c).groupBy("issuer").agg(
        n_rows().alias("closed_complaints"),
        percent_where(response == rules.MONETARY_RELIEF, 1).alias("monetary_relief_pct"),
        percent_where(response == rules.NON_MONETARY_RELIEF, 1).alias("non_monetary_relief_pct"),
        percent_where(response == rules.EXPLANATION, 1).alias("explanation_only_pct"),
        percent_where(response == rules.UNTIMELY, 2).alias("untimely_pct"),
    )


def timely_response(c: DataFrame) -> DataFrame:
    timely = F.col("timely_response")
    return c.filter(timely.isin("Yes", "No")).groupBy("issuer", "year").agg(
        n_rows().alias("complaints"),
        F.count_if(timely == "No").alias("not_timely"),
        percent_where(timely == "Yes", 2).alias("timely_pct"),
    )


def value_issue_panel(c: DataFrame) -> DataFrame:
    group = F.col("value_issue")
    names = {
        "fees": "Fees",
        "rewards": "Rewards",
        "promo_terms": "Promotional terms not received",
        "confusing_advertising": "Confusing advertising",
    }
    return c.groupBy("issuer", "month").agg(
        n_rows().alias("complaints"),
        F.count("value_issue").alias("value_complaints"),
        *[F.count_if(group == label).alias(name) for name, label in names.items()],
        percent_where(group.isNotNull(), 2).alias("value_share_pct"),
    )


def rate_per_volume(
    c: DataFrame,
    volume: DataFrame,
    years: Sequence[int] = rules.VOLUME_YEARS,
    exclude: Sequence[tuple[str, int]] = rules.VOLUME_EXCLUDED,
) -> DataFrame:
    """Complaints per unit of volume. Rows are counted before the dimension is joined."""
    dropped = reduce(
        lambda a, b: a | b,
        [(F.col("issuer") == i) & (F.col("year") == y) for i, y in exclude],
        F.lit(False),
    )
    return (
        c.filter(F.col("year").isin(list(years)) & ~dropped)
        .groupBy("issuer", "year")
        .agg(n_rows().alias("complaints"))
        .join(volume, ["issuer", "year"])
        .select(
            "issuer",
            "year",
            "complaints",
            "purchase_volume",
            round_up(share("complaints", "purchase_volume"), 2).alias("complaints_per_unit"),
        )
    )


def relief_by_sub_issue(c: DataFrame, focus: str, min_focus: int = 100) -> DataFrame:
    """Relief rate of the focus issuer and of its pooled peers; a missing sub-issue is a group."""
    own = F.col("issuer") == focus
    relieved = F.col("company_response") == rules.MONETARY_RELIEF

    def relief_pct(who: Column) -> Column:
        return round_up(percent(F.count_if(who & relieved), F.count_if(who)), 1)

    return (
        closed(c)
        .groupBy("issue", "sub_issue")
        .agg(
            F.count_if(own).alias("focus_complaints"),
            relief_pct(own).alias("focus_relief_pct"),
            F.count_if(~own).alias("peers_complaints"),
            relief_pct(~own).alias("peers_relief_pct"),
        )
        .filter(F.col("focus_complaints") >= min_focus)
    )


def _flagged(
    c: DataFrame, patterns: dict[str, str], known: dict[str, str], fragments: dict[str, list[str]]
) -> DataFrame:
    """One boolean per pattern, each matched once per text; the text itself goes no further."""
    flags = [
        matches("narrative", ascii_regex(p), known_fragments(name, p, known, fragments)).alias(name)
        for name, p in patterns.items()
    ]
    return with_search_columns(c, "narrative").select("issuer", "month", "sub_issue", *flags)


def mentions_monthly(
    c: DataFrame,
    until: str = "2026-07-01",
    patterns: dict[str, str] = rules.MENTION_PATTERNS,
) -> DataFrame:
    """Monthly keyword mentions in narratives, up to and including the month given."""
    told = c.filter(F.col("has_narrative") & (F.col("month") <= F.lit(until).cast("date")))
    both = [("platinum", "annual_fee"), ("sapphire_reserve", "annual_fee")]
    return _flagged(told, patterns, rules.MENTION_PATTERNS, rules.MENTION_FRAGMENTS).groupBy("issuer", "month").agg(
        n_rows().alias("narratives"),
        *[F.count_if(name).alias(f"mentions_{name}") for name in patterns],
        *[F.count_if(F.col(a) & F.col(b)).alias(f"mentions_{a}_and_{b}") for a, b in both],
    )


def keyword_evidence(
    c: DataFrame,
    focus: str,
    patterns: dict[str, str] = rules.EVIDENCE_PATTERNS,
    other: str = "Other issuers",
) -> DataFrame:
    """Keyword rates inside the value sub-issues, focus issuer against the others."""
    told = c.filter(F.col("has_narrative") & F.col("value_issue").isNotNull())
    return (
        _flagged(told, patterns, rules.EVIDENCE_PATTERNS, rules.EVIDENCE_FRAGMENTS)
        .groupBy("sub_issue", focus_group("issuer", focus, other).alias("issuer_group"))
        .agg(
            n_rows().alias("narratives"),
            *[percent_where(F.col(name), 1).alias(f"{name}_pct") for name in patterns],
        )
    )
