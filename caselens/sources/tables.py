"""Scans, views and sinks for everything that is not a bulk export."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.functions import rules
from caselens.functions.exprs import lookup, month_start, quarter_label
from caselens.functions.frames import numbered, read_if_there

DENOMINATOR_SCHEMA = (
    "issuer string, fiscal_year int, metric string, value double, scope_label string, "
    "source_title string, source_url string, quote string, notes string"
)
LEDGER_TYPES = {
    "seq": "bigint",
    "complaint_id": "bigint",
    "model": "string",
    "prompt_version": "string",
    "mode": "string",
    "pack_id": "string",
    "status": "string",
    "error": "string",
    "input_tokens": "double",
    "output_tokens": "double",
    "cache_read_tokens": "double",
    "cache_write_tokens": "double",
    "narrative_truncated": "boolean",
    "primary_theme": "string",
    "secondary_theme": "string",
    "sentiment": "string",
    "named_benefits": "array<string>",
    "card_product": "string",
}
LEDGER_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in LEDGER_TYPES.items())
PRICE_SCHEMA = (
    "model string, input double, output double, cache_read double, min_cacheable_tokens int, "
    "thinks boolean, provider string, cache_write_multiplier double, batch boolean"
)


# --- derived columns and views -----------------------------------------------------------
def with_calendar(df: DataFrame, date: str = "date_received") -> DataFrame:
    """Adds month, quarter_start, quarter (YYYY-Qn) and year."""
    return df.withColumns(
        {
            "month": month_start(date),
            "quarter_start": F.trunc(F.col(date), "quarter"),
            "quarter": quarter_label(date),
            "year": F.year(date),
        }
    )


def value_view(complaints: DataFrame, value_issues: dict[str, str] = rules.VALUE_ISSUES) -> DataFrame:
    """Calendar columns and the value group of the sub-issue: the complaint view of rows without their narratives."""
    return with_calendar(complaints).withColumn("value_issue", lookup(F.col("sub_issue"), value_issues))


def complaint_view(complaints: DataFrame, value_issues: dict[str, str] = rules.VALUE_ISSUES) -> DataFrame:
    """Calendar columns, a has-narrative flag and the value group of the sub-issue."""
    return with_calendar(complaints).withColumns(
        {
            "has_narrative": F.col("narrative").isNotNull(),
            "value_issue": lookup(F.col("sub_issue"), value_issues),
        }
    )


def register_views(
    spark: SparkSession,
    complaints_path: str,
    cards_path: str,
    denominators_path: str | None = None,
    with_texts: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Parquet and CSV locations as the SQL views complaints, cards_all and purchase_volume.

    `with_texts` joins the narratives to the complaints where they are stored apart.
    """
    stored = spark.read.parquet(complaints_path)
    complaint_view(with_texts(stored) if with_texts else stored).createOrReplaceTempView("complaints")
    with_calendar(spark.read.parquet(cards_path)).createOrReplaceTempView("cards_all")
    if denominators_path:
        purchase_volume(read_denominators(spark, denominators_path)).createOrReplaceTempView(
            "purchase_volume"
        )


def read_denominators(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DENOMINATOR_SCHEMA).csv(
        path, header=True, quote='"', escape='"', multiLine=True
    )


def purchase_volume(
    denominators: DataFrame,
    metric: str = rules.DENOMINATOR_METRIC,
    aliases: dict[str, str] = rules.DENOMINATOR_ALIASES,
) -> DataFrame:
    """Volume per issuer and year: scopes added together, renamed entities under one name."""
    issuer = lookup(F.col("issuer"), aliases, default=F.col("issuer"))
    return (
        denominators.filter(F.col("metric") == metric)
        .groupBy(issuer.alias("issuer"), F.col("fiscal_year").alias("year"))
        .agg(F.sum("value").alias("purchase_volume"))
    )


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Price table, USD per million tokens, one row per model, from CSV with a header."""
    return spark.read.schema(PRICE_SCHEMA).csv(path, header=True)


# --- label ledger ------------------------------------------------------------------------
def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Label attempts from JSON lines; no rows when nothing has been written yet."""
    return read_if_there(spark, path, f"{LEDGER_SCHEMA}, run string", "json").drop("run")


def append_ledger(records: DataFrame, path: str, run: str | None = None) -> None:
    """Adds the attempts of a run. A run that is repeated replaces its own attempts and touches no others.

    Every attempt needs its place in the order (seq). Each run is a folder of its own; a call without a name for it
    is a run by itself.
    """
    run = run or uuid.uuid4().hex
    if "seq" not in records.columns:
        raise ValueError("ledger records need a seq")
    no_order = F.raise_error(F.lit("a ledger record has no seq")).cast("bigint")
    records = records.withColumn("seq", F.coalesce(F.col("seq").cast("bigint"), no_order))
    missing = {n: F.lit(None).cast(t) for n, t in LEDGER_TYPES.items() if n not in records.columns}
    records = records.withColumns(missing).select(*LEDGER_TYPES, F.lit(run).alias("run"))
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").json(path)


# --- sinks -------------------------------------------------------------------------------
class UnorderedResult(ValueError):
    """A result read back is not in the order it was written in."""


def write_result(df: DataFrame, path: str, order: Sequence[str] = (), fmt: str = "csv") -> None:
    """A result table; ordered only on request, since ordering costs a range shuffle. Nulls come last.

    An ordered result has a column `position`, counted from 1 in that order. Places come from the sizes of the
    sorted ranges, so no task holds all rows.
    """
    out = df
    if order:
        # Rows that are equal in the order are told apart by all their columns.
        ties = F.xxhash64(*df.columns)
        keys = [F.asc_nulls_last(c) for c in order]
        out = numbered(df, [*keys, ties], "position", "result").withColumn("position", F.col("position") + 1)
        out = out.repartitionByRange("position").sortWithinPartitions("position")
    writer = out.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def read_result(spark: SparkSession, path: str, schema: str, order: Sequence[str], fmt: str = "csv") -> DataFrame:
    """An ordered result read back, with its positions, or an error if they do not follow the order.

    Neighbours are compared across the whole result: each block of positions carries the first row of the next one.
    """
    reader = spark.read.schema(f"{schema}, position bigint")
    rows = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    key = F.struct(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(f"k{i}") for i, c in enumerate(order)])
    # Each row is also sent one place back, where it meets the row before it.
    both = rows.select("position", key.alias("here"), F.lit(0).alias("side")).unionByName(
        rows.select((F.col("position") - 1).alias("position"), key.alias("here"), F.lit(1).alias("side"))
    )
    pairs = both.groupBy("position").agg(
        F.max(F.when(F.col("side") == 0, F.col("here"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("here"))).alias("b"),
        F.count_if(F.col("side") == 0).alias("n"),
    )
    wrong = pairs.filter((F.col("a") > F.col("b")) | (F.col("n") > 1) | ((F.col("n") == 0) & (F.col("position") != 0)))
    if not wrong.isEmpty():
        raise UnorderedResult(f"{path} is not ordered by {', '.join(order)}")
    return rows


def write_by_year(df: DataFrame, path: str, date: str = "date_received") -> None:
    """Parquet under one folder per year. Rebalancing splits a year that holds most of the rows."""
    df.withColumn("year", F.year(date)).hint("rebalance", "year").write.mode("overwrite").partitionBy(
        "year"
    ).parquet(path)
