"""Bulk CSV exports: scan, gate, counts, typed rows, newest row per complaint, issuer subset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.functions import rules
from caselens.functions.exprs import as_col, lookup
from caselens.functions.frames import BROADCAST_ROWS, keep, scratch_path

EXPORT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in rules.EXPORT_COLUMNS])

CSV_OPTIONS = {
    "header": True,
    "multiLine": True,
    "quote": '"',
    "escape": '"',
    "enforceSchema": False,  # a header that differs from the schema is an error, not a shift
}

CARD_COLUMNS = [
    "complaint_id", "date_received", "date_sent_to_company", "product", "sub_product", "issue",
    "sub_issue", "narrative", "company_public_response", "company", "state", "zip_code", "tags",
    "submitted_via", "company_response", "timely_response", "source_file",
]


class UncleanExport(ValueError):
    """An export has rows whose id is not all digits or whose date is not a date."""


def export_name() -> Column:
    """The export a row came from: its file, or the folder when an export is a folder of files."""
    numbered = F.regexp_extract("_metadata.file_path", f".*[/=]([^/=]*{rules.EXPORT_NUMBER}[^/]*)", 1)
    return F.coalesce(F.nullif(numbered, F.lit("")), "_metadata.file_name")


def named_columns(raw: DataFrame) -> DataFrame:
    """File column names -> names used here; quoted empty cells read as null, like bare ones."""
    return raw.select(
        *[F.nullif(F.col(f"`{src}`"), F.lit("")).alias(dst) for src, dst in rules.EXPORT_COLUMNS.items()],
        export_name().alias("source_file"),
    )


def read_exports(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All cells as text, quoted multi-line cells kept whole, with the file each row came from."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return named_columns(spark.read.schema(EXPORT_SCHEMA).options(**CSV_OPTIONS).csv(paths))


# --- gate and counts ---------------------------------------------------------------------
def text_date(c: Column | str) -> Column:
    """Text to date for year-month-day written with - or /; anything else is null."""
    c = as_col(c)
    whole = c.rlike(r"\A\d{4}([-/])\d{1,2}\1\d{1,2}\z")
    return F.when(whole, F.try_to_date(F.replace(c, F.lit("/"), F.lit("-")), "yyyy-M-d"))


def bad_rows() -> Column:
    """Aggregate: rows whose id is not all digits or whose date is not a date."""
    bad = ~F.col("complaint_id").rlike(r"\A\d+\z") | text_date("date_received").isNull()
    return F.count_if(bad).alias("bad_rows")


def raise_if_unclean(per_file: DataFrame, report: int = 20) -> None:
    """An error that names the worst exports, from (source_file, bad_rows)."""
    failed = per_file.filter(F.col("bad_rows") > 0)
    worst = failed.orderBy(F.desc("bad_rows"), "source_file").limit(report).collect()
    if worst:
        listed = ", ".join(f"{r.source_file}: {r.bad_rows} rows" for r in worst)
        raise UncleanExport(f"id or date check failed for {listed}")


def unclean_rows(raw: DataFrame) -> DataFrame:
    """Bad rows per export: source_file, bad_rows. Empty when every export is clean."""
    return raw.groupBy("source_file").agg(bad_rows()).filter(F.col("bad_rows") > 0)


def is_card(product: Column | str = "product", sub_product: Column | str = "sub_product") -> Column:
    """True for credit card complaints, before and after the product was renamed; never null."""
    product, sub_product = as_col(product), as_col(sub_product)
    renamed = product == rules.CARD_PRODUCT
    before = (product == rules.CARD_PRODUCT_BEFORE_RENAME) & sub_product.isin(
        rules.CARD_SUB_PRODUCTS_BEFORE_RENAME
    )
    return F.coalesce(renamed | before, F.lit(False))


def file_counts(raw: DataFrame, *more: Column) -> DataFrame:
    """Rows, card rows and first and last date text per export, and further aggregates if given."""
    return raw.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count_if(is_card()).alias("rows_card"),
        F.min("date_received").alias("min_date_received"),
        F.max("date_received").alias("max_date_received"),
        *more,
    )


# --- one parse per export ----------------------------------------------------------------
STAGED_ALWAYS = ["source_file", "product", "sub_product", "complaint_id", "date_received"]


def staged(raw: DataFrame, path: str) -> DataFrame:
    """The exports parsed once into Parquet at `path`, from which gate, counts and rows are read.

    Rows that are no card complaints keep only what gate and counts need. A path written before is replaced.
    """
    only_cards = [c for c in raw.columns if c not in STAGED_ALWAYS]
    narrow = raw.withColumns({c: F.when(is_card(), F.col(c)) for c in only_cards})
    narrow.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return raw.sparkSession.read.schema(narrow.schema).parquet(path)


def gated_counts(rows: DataFrame) -> DataFrame:
    """Counts per export of staged rows, or an error that names the unclean exports."""
    counts = file_counts(rows, bad_rows())
    raise_if_unclean(counts)
    return counts.drop("bad_rows")


# --- typed rows --------------------------------------------------------------------------
def clean_rows(raw: DataFrame, start: str = rules.EXPORT_START) -> DataFrame:
    """Typed card complaints from the start date on; blank narratives become null."""
    typed = {
        "complaint_id": F.col("complaint_id").cast("bigint"),
        "date_received": text_date("date_received"),
        "date_sent_to_company": text_date("date_sent_to_company"),
        "narrative": F.nullif(F.trim("narrative"), F.lit("")),
        "company": F.trim("company"),
    }
    return (
        raw.filter(is_card())
        .withColumns(typed)
        .filter(F.col("date_received") >= F.lit(start).cast("date"))
        .select(*CARD_COLUMNS)
    )


def dedupe_latest(rows: DataFrame) -> DataFrame:
    """One row per complaint, from the export with the highest number (as a number, not text).

    The rank limit is applied before the shuffle too, so an id repeated any number of times sends
    at most one row per input task.
    """
    number = F.regexp_extract("source_file", rules.EXPORT_NUMBER, 1).try_cast("int")
    newest = Window.partitionBy("complaint_id").orderBy(
        number.desc_nulls_last(), F.desc("source_file"), F.xxhash64(*rows.columns)
    )
    return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def dedupe_stored(rows: DataFrame, max_ids: int = BROADCAST_ROWS) -> DataFrame:
    """`dedupe_latest` of rows that are stored, so cheap to read twice: only rows of repeated ids are shuffled.

    Beyond `max_ids` repeated ids all rows are. Without any the rows are returned as they are.
    """
    ids = rows.groupBy(F.col("complaint_id").alias("_id")).agg(F.count(F.lit(1)).alias("_rows"))
    repeated = keep(ids.filter("_rows > 1").select("_id"), "repeated-ids")
    found = repeated.limit(max_ids + 1).count()
    if not found:
        return rows
    if found > max_ids:
        return dedupe_latest(rows)
    # Rows without an id are rows of one id, as in the window.
    same = F.col("complaint_id").eqNullSafe(F.col("_id"))
    once = rows.join(F.broadcast(repeated), same, "left_anti")
    return once.unionByName(dedupe_latest(rows.join(F.broadcast(repeated), same, "left_semi")))


def issuer_of(company: Column | str, issuers: dict[str, str] = rules.ISSUER_BY_COMPANY) -> Column:
    """Issuer of an exact company string (spaces around it ignored); null for any other company."""
    return lookup(F.trim(as_col(company)), issuers)


def restrict_to_issuers(cards: DataFrame, issuers: dict[str, str] = rules.ISSUER_BY_COMPANY) -> DataFrame:
    """Complaints against the mapped issuers, issuer column first."""
    return cards.select(issuer_of("company", issuers).alias("issuer"), "*").filter(
        F.col("issuer").isNotNull()
    )


def ingest(
    spark: SparkSession,
    paths: str | Sequence[str],
    start: str = rules.EXPORT_START,
) -> DataFrame:
    """Exports to one clean row per card complaint, all companies. Each export is parsed once."""
    rows = staged(read_exports(spark, paths), scratch_path(spark, "staged-exports"))
    gated_counts(rows)
    return dedupe_stored(clean_rows(rows, start))
