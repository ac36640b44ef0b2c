"""What the operators share: tables, scratch folders, kept tables, slices of Arrow batches."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, where they would not find it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    found = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if root in (os.getcwd(), *found) or app in _SHIPPED:
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="caselens-"), "caselens"), "zip", root, "caselens")
    spark.sparkContext.addPyFile(made)
    _SHIPPED.add(app)


def arrow_map(df: DataFrame, function: Callable, schema) -> DataFrame:
    """mapInArrow with a function of this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


@contextmanager
def small_batches(spark: SparkSession, most: int = 8 << 20) -> Iterator[None]:
    """Inside, Arrow batches of large values go to Python in pieces of about `most` bytes; the session's own bound comes back after."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Where Spark is local and names none, a temporary one is made and set. On a cluster without one it
    is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="caselens-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written once as Parquet in the shared folder and read back: its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def word_array(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text in reading order."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in consecutive slices whose texts have about `max_bytes` bytes, one row at least."""
    texts = batch.column(column).cast(pa.large_string())
    offsets = pa.Array.from_buffers(pa.int64(), len(texts) + 1, [None, texts.buffers()[1]], offset=texts.offset).to_numpy()
    at = 0
    while at < len(texts):
        end = int(offsets.searchsorted(offsets[at] + max_bytes, side="right")) - 1
        end = min(max(end, at + 1), len(texts))
        yield batch.slice(at, end - at)
        at = end


def small_side(df: DataFrame, max_rows: int = 400_000) -> DataFrame:
    """A stored frame of a few narrow columns, marked for broadcast if a count shows that it is small.

    Larger ones are left as they are and joined by shuffle, with the same result.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
