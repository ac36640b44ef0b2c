"""Coverage, completeness and distributions of the ingested data, and count reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions import rules
from caselens.functions.exprs import n_rows, percent, percent_where, quarter_label, round_up
from caselens.operators.benchmark import ALL_ISSUERS


def narratives() -> Column:
    return F.count("narrative")


def narrative_pct() -> Column:
    return percent_where(F.col("narrative").isNotNull(), 1)


def profile_products(cards: DataFrame) -> DataFrame:
    return cards.groupBy("product", "sub_product").agg(
        n_rows().alias("complaints"),
        F.min("date_received").alias("first_date"),
        F.max("date_received").alias("last_date"),
    )


def profile_companies(c: DataFrame, order: Sequence[str] = ALL_ISSUERS) -> DataFrame:
    """Company strings behind each issuer; `ord` is the issuer's place in the given order."""
    ord_of = F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("issuer")).cast("int"), F.lit(0))
    return (
        c.groupBy("company", "issuer")
        .agg(
            n_rows().alias("complaints"),
            narratives().alias("with_narrative"),
            narrative_pct().alias("narrative_pct"),
            F.min("date_received").alias("first_date"),
            F.max("date_received").alias("last_date"),
        )
        .withColumn("ord", ord_of)
    )


def profile_lookalikes(cards: DataFrame, c: DataFrame, names: str = rules.LOOKALIKE_NAMES) -> DataFrame:
    """Companies whose name contains one of the names but that the exact map leaves out."""
    similar = (
        cards.filter(F.lower("company").rlike(names))
        .groupBy("company")
        .agg(n_rows().alias("complaints"))
    )
    mapped = c.select("company").distinct()
    return similar.join(mapped, "company", "left_anti")


def _with_share(counts: DataFrame, digits: int) -> DataFrame:
    """Adds each count's share of the grand total. The total is a scalar, not a one-task window."""
    total = counts.agg(F.sum("complaints").alias("total")).scalar()
    return counts.withColumn("share_pct", round_up(percent("complaints", total), digits))


def profile_top_companies(cards: DataFrame, top: int = 15) -> DataFrame:
    counts = cards.groupBy("company").agg(n_rows().alias("complaints"))
    return _with_share(counts, 1).orderBy(F.desc("complaints"), "company").limit(top)


def _by_quarter(c: DataFrame, value: Column, issuers: Sequence[str]) -> DataFrame:
    return (
        c.groupBy(quarter_label("date_received").alias("quarter"))
        .pivot("issuer", list(issuers))
        .agg(value)
    )


def profile_pivot_volume(c: DataFrame, issuers: Sequence[str] = ALL_ISSUERS) -> DataFrame:
    """Quarter by issuer complaint counts; null where an issuer has none."""
    return _by_quarter(c, n_rows(), issuers)


def profile_pivot_narrative(c: DataFrame, issuers: Sequence[str] = ALL_ISSUERS) -> DataFrame:
    """Quarter by issuer percent of complaints with a narrative."""
    cells = c.groupBy("issuer", quarter_label("date_received").alias("quarter")).agg(
        narrative_pct().alias("pct")
    )
    return cells.groupBy("quarter").pivot("issuer", list(issuers)).agg(F.max("pct"))


def profile_recent(c: DataFrame, since: str = "2025-07-01") -> DataFrame:
    recent = c.filter(F.col("date_received") >= F.lit(since).cast("date"))
    return recent.groupBy(F.date_format("date_received", "yyyy-MM").alias("month")).agg(
        n_rows().alias("complaints"),
        narratives().alias("with_narrative"),
        narrative_pct().alias("narrative_pct"),
        F.count_if(F.col("company_response") == rules.IN_PROGRESS).alias("in_progress"),
    )


def profile_completeness(c: DataFrame, approximate: bool = False) -> DataFrame:
    """Non-null percent and distinct values of every column, in one scan.

    Cells become (field, value) pairs that are counted per value before the shuffle, so a value that
    fills a third of a column travels once per task. Values over 64 characters travel as a SHA-256.
    """
    if approximate:
        each = [
            F.struct(
                F.lit(f).alias("field"),
                round_up(percent(F.count(f), n_rows()), 1).alias("non_null_pct"),
                F.approx_count_distinct(f).alias("distinct_values"),
            )
            for f in c.columns
        ]
        return c.agg(F.array(*each).alias("fields")).select(F.inline("fields"))

    def cell(field: str) -> Column:
        text = F.col(field).cast("string")
        return F.struct(
            F.lit(field).alias("field"),
            F.when(F.length(text) > 64, F.sha2(text, 256)).otherwise(text).alias("value"),
        )

    per_value = (
        c.select(F.explode(F.array(*[cell(f) for f in c.columns])).alias("cell"))
        .groupBy("cell.field", "cell.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    present = F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)
    return per_value.groupBy("field").agg(
        round_up(percent(F.sum(present), F.sum("n")), 1).alias("non_null_pct"),
        F.count("value").alias("distinct_values"),
    )


def profile_text_length(c: DataFrame, long_from: int = rules.MAX_NARRATIVE_CHARS, short_to: int = 100) -> DataFrame:
    """Exact interpolated quantiles of text length, the maximum and both tail shares.

    Lengths are counted first, so the quantile step sees one row per distinct length.
    """
    lengths = (
        c.filter(F.col("narrative").isNotNull())
        .groupBy(F.length("narrative").alias("chars"))
        .agg(n_rows().alias("n"))
    )
    cut = F.percentile("chars", F.array(*[F.lit(q) for q in (0.1, 0.5, 0.9, 0.99)]), F.col("n"))
    tail_long = F.sum(F.when(F.col("chars") > long_from, F.col("n")).otherwise(0))
    tail_short = F.sum(F.when(F.col("chars") < short_to, F.col("n")).otherwise(0))
    return lengths.agg(
        cut.alias("cut"),
        F.max("chars").alias("max_chars"),
        percent(tail_long, F.sum("n")).alias("over_limit_pct"),
        percent(tail_short, F.sum("n")).alias("short_pct"),
    ).select(
        *[F.col("cut")[i].alias(name) for i, name in enumerate(["p10", "p50", "p90", "p99"])],
        "max_chars",
        round_up(F.col("over_limit_pct"), 4).alias("over_limit_pct"),
        round_up(F.col("short_pct"), 4).alias("short_pct"),
    )


def profile_responses(c: DataFrame) -> DataFrame:
    return _with_share(c.groupBy("company_response").agg(n_rows().alias("complaints")), 1)


def profile_timely(c: DataFrame) -> DataFrame:
    return _with_share(c.groupBy("timely_response").agg(n_rows().alias("complaints")), 2)


def profile_totals(c: DataFrame, cards: DataFrame, before_dedupe: DataFrame, issuer: str) -> DataFrame:
    """Headline counts and dates in one row, with the repeats that de-duplication removed.

    Distinct ids are counted by grouping on the id, which spreads them over the cluster.
    """
    ids = before_dedupe.groupBy("complaint_id").agg(n_rows().alias("copies"))
    repeats = ids.agg(F.sum(F.col("copies") - 1).alias("repeated_rows")).scalar()
    all_ids = cards.groupBy("complaint_id").agg(n_rows().alias("copies")).agg(
        F.struct(F.sum("copies").alias("rows"), n_rows().alias("ids")).alias("s")
    )
    told = F.col("narrative").isNotNull()
    return (
        c.agg(
            n_rows().alias("complaints"),
            narratives().alias("narratives"),
            F.min("date_received").alias("first_date"),
            F.max("date_received").alias("last_date"),
            F.max(F.when(told, F.col("date_received"))).alias("last_narrative_date"),
            F.max(F.when(F.col("issuer") == issuer, F.col("date_received"))).alias("issuer_last_date"),
        )
        .withColumn("s", all_ids.scalar())
        .withColumns(
            {
                "all_card_complaints": F.col("s.rows"),
                "distinct_ids": F.col("s.ids"),
                "repeated_rows_before_dedupe": repeats,
            }
        )
        .drop("s")
    )


def reconcile_counts(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("issuer", "year")) -> DataFrame:
    """Row counts per key in two sources. Both sides are counted before they meet.

    `right` may be rows, or counts already taken elsewhere in a column `right_n`.
    """
    keys = list(keys)
    mine = left.groupBy(*keys).agg(n_rows().alias("left_n"))
    theirs = F.sum("right_n") if "right_n" in right.columns else n_rows()
    other = right.groupBy(*keys).agg(theirs.alias("right_n"))
    return (
        mine.join(other, keys, "left")
        .withColumn("right_n", F.coalesce("right_n", F.lit(0)))
        .withColumn("left_as_pct_of_right", round_up(percent("left_n", "right_n"), 1))
    )
