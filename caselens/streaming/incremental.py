"""Incremental ingest: every run picks up only exports it has not seen, and rewrites only the buckets they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.functions import rules
from caselens.functions.frames import read_if_there
from caselens.sources.exports import (
    CARD_COLUMNS,
    CSV_OPTIONS,
    EXPORT_SCHEMA,
    clean_rows,
    dedupe_stored,
    gated_counts,
    named_columns,
    staged,
)

IDS_PER_BUCKET = 1_000_000
_TYPES = {"complaint_id": T.LongType(), "date_received": T.DateType(), "date_sent_to_company": T.DateType()}
ROWS_SCHEMA = T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in CARD_COLUMNS] + [T.StructField("bucket", T.LongType())])
COUNTS_SCHEMA = "source_file string, rows_total bigint, rows_card bigint, min_date_received string, max_date_received string"


def merge_rows(new: DataFrame, rows: str, work: str) -> None:
    """Merges clean rows into the table at `rows`, one row per complaint, the newest export's.

    Buckets are ranges of ids, which are given out in order: a new export touches those of recent complaints and of
    the few it repeats. What the touched buckets held is written whole under `work` first, and a marker after it;
    then they are overwritten from that and the new rows, all others keep their files. A batch that is replayed after
    the marker, with the same new rows, only repeats the last step, so a driver lost between two buckets loses no
    row. Rows are written by the tasks that read them: only those of repeated ids are shuffled, and none is copied twice.
    """
    spark = new.sparkSession
    new = new.withColumn("bucket", F.floor(F.col("complaint_id") / IDS_PER_BUCKET)).select(*ROWS_SCHEMA.names)
    done = f"{work}/done"
    if read_if_there(spark, done, "id bigint").isEmpty():
        # One number per million ids.
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]
        before = read_if_there(spark, rows, ROWS_SCHEMA).filter(F.col("bucket").isin(touched))
        before.write.mode("overwrite").option("compression", "zstd").parquet(f"{work}/before")
        spark.range(1).write.mode("overwrite").parquet(done)
    before = spark.read.schema(ROWS_SCHEMA).parquet(f"{work}/before")
    merged = dedupe_stored(before.unionByName(new))
    out = merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    out.partitionBy("bucket").parquet(rows)


def process_new_files(
    spark: SparkSession,
    incoming: str,
    parts: str,
    checkpoint: str,
    start: str = rules.EXPORT_START,
) -> None:
    """Merges the new exports into `parts`; the checkpoint is the list of exports done.

    Each export is parsed once, into staged rows that gate, counts and merge read. Every step of a micro-batch may
    be repeated: staged rows and counts replace those of the same batch, and merging the same rows again changes
    nothing. An unclean export stops the run before any of the batch is published. Once all batches of a run are
    committed none is replayed, so what they wrote under `work` is emptied.
    """
    ended = []

    def one_batch(raw: DataFrame, batch_id: int) -> None:
        rows = staged(raw, f"{parts}/work/batch={batch_id}/staged")
        gated_counts(rows).write.mode("overwrite").parquet(f"{parts}/counts/batch={batch_id}")
        merge_rows(clean_rows(rows, start), f"{parts}/rows", f"{parts}/work/batch={batch_id}")
        ended.append(batch_id)

    stream = named_columns(spark.readStream.schema(EXPORT_SCHEMA).options(**CSV_OPTIONS).csv(incoming))
    query = (
        stream.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    for batch_id in ended:
        for name in ("staged", "before"):
            spark.createDataFrame([], ROWS_SCHEMA).write.mode("overwrite").parquet(f"{parts}/work/batch={batch_id}/{name}")


def ingested_counts(spark: SparkSession, parts: str) -> DataFrame:
    """Counts per export ingested so far; no rows before the first."""
    return read_if_there(spark, f"{parts}/counts", COUNTS_SCHEMA)


def ingested_cards(spark: SparkSession, parts: str) -> DataFrame:
    """One row per complaint from its newest export; no rows before the first. Nothing is de-duplicated on reading."""
    return read_if_there(spark, f"{parts}/rows", ROWS_SCHEMA).drop("bucket")
