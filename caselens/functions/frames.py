"""DataFrame helpers: exact ranking without a global sort, checked broadcasts, kept tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.functions.exprs import draw_key

# A side is broadcast only when a count has shown it to be no larger than this.
BROADCAST_ROWS = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names (spark.checkpoint.dir).

    Only where Spark itself is local and names none, a local one is made, once per session. On a cluster
    without one it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="caselens-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/kept/{name}-{uuid.uuid4().hex}"


def read_if_there(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    """What is stored at a path, or no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def keep(df: DataFrame, name: str, even_files: bool = False, compression: str | None = None, row_group: int | None = None) -> DataFrame:
    """Write the frame once to the shared folder and read it back, so lineage ends there.

    `even_files` spends a shuffle to write files of like size, for wide tables that are read often and
    come out of joins that leave a few huge partitions. `row_group`, in compressed bytes, bounds what a reader of
    long rows decodes at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = (df.hint("rebalance") if even_files else df).write
    if row_group is not None:
        writer = writer.option("parquet.block.size", row_group)
    writer.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def small_or_plain(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a kept (cheap to count) frame for broadcast if its row count allows; else leave it.

    An unmarked frame is joined by shuffle, so the result is the same at any size.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def shuffled_rank(
    df: DataFrame,
    row_id: str,
    seed: int | str,
    by: Sequence[str] = (),
    out: str = "rank",
    prefix: int = 3,
    up_to: int | None = None,
) -> DataFrame:
    """Exact 1-based rank in seeded random order, within `by` or over all rows.

    The order is that of ``draw_key(row_id)``. Rows are ranked inside 16^prefix equal slices of the
    key and shifted by the number of rows in earlier slices, so neither all rows nor a hot group
    ever sit in one task. Only the slice counts (at most 16^prefix per group) are summed up in order.
    With `up_to` only ranks up to it are returned, and slices that lie beyond are not sorted.
    The frame is read twice, so it should be cheap to read.
    """
    by = list(by)
    # A null id has a key of its own, so that its rows are ranked as well.
    key = F.coalesce(draw_key(row_id, seed), F.md5(F.lit(f"{seed}:")))
    sliced = df.withColumn("_key", key).withColumn(
        "_slice", F.substring("_key", 1, prefix)
    )
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        sliced.groupBy(*by, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*by, "_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_shift"))
    )
    if up_to is not None:
        shifts = shifts.filter(F.col("_shift") < up_to)
    inside = Window.partitionBy(*by, "_slice").orderBy("_key", row_id)
    ranked = (
        sliced.join(shifts, [*by, "_slice"])
        .withColumn(out, F.col("_shift") + F.row_number().over(inside))
        .select(*df.columns, out)
    )
    return ranked if up_to is None else ranked.filter(F.col(out) <= up_to)


def first_ranks(
    df: DataFrame, row_id: str, seed: int | str, by: Sequence[str], up_to: int, out: str = "rank"
) -> DataFrame:
    """The first `up_to` rows of every group in seeded random order, with their rank.

    For small limits Spark keeps only that many rows per group and task before it shuffles. It does
    not do so above its threshold; there the rows are ranked in slices instead.
    """
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if up_to > threshold:
        return shuffled_rank(df, row_id, seed, by, out, up_to=up_to)
    order = Window.partitionBy(*by).orderBy(draw_key(row_id, seed), row_id)
    return df.withColumn(out, F.row_number().over(order)).filter(F.col(out) <= up_to)


def numbered(df: DataFrame, order: Sequence[Column], out: str, name: str) -> DataFrame:
    """Rows with their 0-based place in a total order, without a window over all of them.

    Rows are dealt by ranges of the order, sorted, and written with their place in their range; the ranges' sizes,
    one number each, are summed up on the driver. Rows equal in the order must be equal in all columns.
    """
    spark = df.sparkSession
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    written = keep(dealt.withColumns({"_range": F.spark_partition_id(), "_place": place}), name)
    sizes = sorted((r["_range"], r["n"]) for r in written.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, at = [], 0
    for k, n in sizes:
        starts.append((k, at))
        at += n
    # One row per range of the shuffle.
    shifts = F.broadcast(spark.createDataFrame(starts, "_range int, _start bigint"))
    return written.join(shifts, "_range").select(*df.columns, (F.col("_start") + F.col("_place")).alias(out))
