"""Multi-line CSV exports read by many tasks per file.

A quoted cell may hold line ends, so a task that starts in the middle of a file does not know whether it stands
inside a cell. It follows from the number of quote characters before it: an escaped quote is two of them. Lines are
read as text, in blocks; the task that reads a block stores its lines in chunks of bounded size with the places where
records end, for either case; quotes are summed up over a file's blocks, which tells the case of each chunk. Records
that lie in one chunk are cut out and parsed where they are; only those that cross into another are put together by a
shuffle. Files may be plain or in a compression that can be split, as bzip2.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselens.functions import rules
from caselens.functions.frames import keep, small_or_plain
from caselens.sources.exports import CSV_OPTIONS, export_name

RECORD = ", ".join(f"`{c}` string" for c in rules.EXPORT_COLUMNS)
CHUNK = 256 << 10  # bytes of a chunk's lines, about; a longer line is a chunk of its own
ROW_GROUP = 4 << 20  # compressed bytes: Parquet decodes thousands of rows at once, but none beyond a row group
PARSED = {"quote": CSV_OPTIONS["quote"], "escape": CSV_OPTIONS["escape"], "multiLine": "true"}


class WrongHeader(ValueError):
    """An export's first record is not the header expected."""


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The lines of the files with file and block. Lines of a block are read in order by one task."""
    text = spark.read.option("lineSep", "\n").text([paths] if isinstance(paths, str) else list(paths))
    return text.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        export_name().alias("source_file"),
        F.col("value").cast("binary").alias("value"),
    )


def _chunks(lines: DataFrame) -> DataFrame:
    """The lines of a block put together to chunks: (path, block) and `seq` order them; `first` starts a file.

    `ends` and `ends_inside` hold the places at which records end: where the number of quotes up to a line's end is
    even, or odd for a chunk that starts inside a cell. `odd` tells whether the block has an odd number of quotes before.
    """

    def run(batches):
        seq, last, odd = 0, None, False
        for batch in batches:
            path, block, name = (batch.column(k).to_pylist() for k in range(3))
            value = batch.column(3)
            size = pc.binary_length(value).to_numpy(zero_copy_only=False).astype(np.int64)
            quotes = pc.count_substring(value, b'"').to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < len(path):
                here, end = (path[at], block[at]), at + 1
                while end < len(path) and block[end] == here[1] and path[end] == here[0]:
                    end += 1
                starts = np.cumsum(size[at:end] + 1) - size[at:end] - 1
                cuts = [0, *(np.flatnonzero(np.diff(starts // CHUNK)) + 1).tolist(), end - at]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    first = here[1] == 0 and here != last
                    if here != last:
                        odd = False
                    so_far = np.cumsum(quotes[at + a : at + b])
                    ends = (starts[a:b] - starts[a] + size[at + a : at + b]).astype(np.int32)
                    text = b"\n".join(value.slice(at + a, b - a).to_pylist())
                    row = [*here, seq, first, name[at], text, int(so_far[-1]), odd, ends[so_far % 2 == 0], ends[so_far % 2 == 1]]
                    yield pa.RecordBatch.from_arrays([pa.array([c], type=t) for c, t in zip(row, kinds, strict=True)], names)
                    seq, last, odd = seq + 1, here, odd ^ bool(so_far[-1] % 2)
                at = end

    # A block is read by one task from its start, so its first chunk is the first that the task sees of it.
    names = ["path", "block", "seq", "first", "source_file", "text", "quotes", "odd", "ends", "ends_inside"]
    places = pa.list_(pa.int32())
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.binary(), pa.int64(), pa.bool_(), places, places]
    made = (
        "path string, block long, seq long, first boolean, source_file string, text binary, quotes long, odd boolean, "
        "ends array<int>, ends_inside array<int>"
    )
    return lines.select("path", "block", "source_file", "value").mapInArrow(run, made)


def records(chunks: DataFrame, opened: DataFrame) -> DataFrame:
    """(path, source_file, first, text) of each record; `first` is true for a file's first one.

    `opened` tells by path and block whether a block starts inside a cell. A quote that is never closed takes the
    rest of its file into one record, as in any reader.
    """
    placed = chunks.join(opened, ["path", "block"]).withColumn("inside", F.col("inside") != F.col("odd"))
    placed = placed.withColumn("ends", F.when(F.col("inside"), F.col("ends_inside")).otherwise(F.col("ends")))
    size = F.octet_length("text")
    # A last piece without an end goes on in the next chunk.
    open_end = F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(-1)) != size
    stops = F.when(open_end, F.concat("ends", F.array(size))).otherwise(F.col("ends"))
    starts = F.concat(F.array(F.lit(0)), F.transform("ends", lambda e: e + 1))
    placed = placed.withColumns({"open_end": open_end, "starts": starts, "stops": stops})
    cut = F.transform("stops", lambda stop, i: F.substring("text", F.get("starts", i) + 1, stop - F.get("starts", i)).cast("string"))
    # There is a piece at least; an inner explode would cut twice, to filter out empty arrays.
    each = placed.select(
        "path", "source_file", "block", "seq", "first", "inside", "open_end", F.size("stops").alias("n"), F.posexplode_outer(cut).alias("place", "text")
    )
    at_start, at_end = F.col("place") == 0, F.col("place") == F.col("n") - 1
    pieces = each.select(
        "path", "source_file", "block", "seq", "place", "text",
        (F.col("first") & at_start).alias("first"),
        (F.col("inside") & at_start).alias("before"),
        (F.col("open_end") & at_end).alias("after"),
    )
    whole = pieces.filter("NOT before AND NOT after").select("path", "source_file", "first", "text")
    # At most two pieces of a chunk belong to records that cross its ends. They are numbered by the starts so far.
    in_file = Window.partitionBy("path").orderBy("block", "seq", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = pieces.filter("before OR after").withColumn("_record", F.sum((~F.col("before")).cast("int")).over(in_file))
    crossing = parts.groupBy("path", "source_file", "_record").agg(
        F.bool_or("first").alias("first"), F.sort_array(F.collect_list(F.struct("block", "seq", "place", "text"))).alias("pieces")
    )
    return whole.unionByName(crossing.select("path", "source_file", "first", F.array_join("pieces.text", "\n").alias("text")))


def _opened(chunks: DataFrame) -> DataFrame:
    """(path, block, inside) of stored chunks: whether the quotes before a block leave a cell open."""
    in_file = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(in_file), F.lit(0)) % 2 == 1
    blocks = chunks.groupBy("path", "block").agg(F.sum("quotes").alias("quotes"))
    return small_or_plain(keep(blocks.select("path", "block", inside.alias("inside")), "opened"))


def read_split_exports(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The same rows as `exports.read_exports`, with more than one task per large file.

    Lines are stored once, so that their places stay as they are. A first record other than the header is an error.
    """
    # A file that ends its lines with CR LF leaves the CR at the end of a record.
    cells = F.from_csv(F.regexp_replace("text", r"\r\z", ""), RECORD, PARSED)
    chunks = keep(_chunks(_lines(spark, paths)), "lines", compression="zstd", row_group=ROW_GROUP)
    opened = _opened(chunks)

    def parse(rows: DataFrame) -> DataFrame:
        # Blank lines between records are no rows.
        filled = rows.filter(F.trim(F.regexp_replace("text", r"[\r\n]", "")) != "")
        return filled.select("path", "source_file", "first", cells.alias("c"))

    # The header has no line ends, so it lies in its file's first chunk.
    started = parse(records(chunks.filter("first"), opened)).filter("first")
    headers = started.select("source_file", *[F.col(f"c.`{c}`").alias(c) for c in rules.EXPORT_COLUMNS])
    differs = [~F.col(f"`{c}`").eqNullSafe(F.lit(c)) for c in rules.EXPORT_COLUMNS]
    wrong = headers.filter(F.array_contains(F.array(*differs), True)).limit(1).collect()
    if wrong:
        raise WrongHeader(f"the header of {wrong[0].source_file} is not that of an export")
    renamed = [F.nullif(F.col(f"c.`{src}`"), F.lit("")).alias(dst) for src, dst in rules.EXPORT_COLUMNS.items()]
    return parse(records(chunks, opened)).filter("NOT first").select(*renamed, "source_file")
