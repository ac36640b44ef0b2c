"""Importance resampling towards a target text: hashed word runs, one gain per bucket, Gumbel top-k draw.

The CRC-32 of every feature is made with numpy from a position table. CRC-32 is linear over XOR, so a byte adds
a value that depends only on the byte and its distance from the end: these are looked up for all bytes of a batch
and folded with one `bitwise_xor.reduceat` over the feature spans; a constant for the length closes each one.
Spans longer than the table fold block by block.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.llm.common import arrow_map, slices, stored
from caselens.llm.words import MARKS, Words, words

REACH = 64  # bytes from the end that the position table covers
BUCKETS = 10_000
POLYNOMIAL = 0xEDB88320  # of CRC-32, reflected
ONES = np.uint32(0xFFFFFFFF)


def _position_table() -> np.ndarray:
    """What byte b adds to the CRC when it stands d bytes before the end, at d * 256 + b."""
    table = np.zeros((REACH, 256), dtype=np.uint32)
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ np.uint32(POLYNOMIAL), first >> 1).astype(np.uint32)
    table[0] = first
    for d in range(1, REACH):
        table[d] = (table[d - 1] >> 8) ^ first[table[d - 1] & 255]
    return table.ravel()


TABLE = _position_table()
# The CRC of that many zero bytes: what the length alone adds.
LENGTH = np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], dtype=np.uint32)


def _folded(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XOR of the table's values over spans of 1 to REACH bytes."""
    offsets = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(offsets, sizes)
    left = np.repeat(sizes, sizes) - 1 - place
    return np.bitwise_xor.reduceat(TABLE[left * 256 + data[np.repeat(starts, sizes) + place]], offsets)


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes, empty ones too."""
    sizes = ends - starts
    out = np.zeros(len(starts), dtype=np.uint32)
    short = np.flatnonzero((sizes > 0) & (sizes <= REACH))
    if len(short):
        out[short] = _folded(data, starts[short], sizes[short]) ^ LENGTH[sizes[short]]
    todo = np.flatnonzero(sizes > REACH)
    if not len(todo):
        return out
    # The first piece takes what is left over, so that all others are whole blocks.
    size = (sizes[todo] - 1) % REACH + 1
    at = starts[todo]
    state = _folded(data, at, size) ^ LENGTH[size] ^ ONES
    at = at + size
    while len(todo):
        more = at < ends[todo]
        out[todo[~more]] = state[~more] ^ ONES
        todo, at, state = todo[more], at[more], state[more]
        if not len(todo):
            break
        # The state so far enters a block through its first four bytes.
        moved = _folded(data, at, np.full(len(todo), REACH))
        for k in range(4):
            moved ^= TABLE[(REACH - 1 - k) * 256 + ((state >> np.uint32(8 * k)) & 255)]
        state, at = moved, at + REACH
    return out


def feature_buckets(found: Words, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every run of 1 to `longest` consecutive words of a row, joined by one space."""
    sizes = found.ends - found.starts
    at = np.cumsum(sizes + 1) - (sizes + 1)
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    joined = np.full(int((sizes + 1).sum()), 32, dtype=np.uint8)
    joined[np.repeat(at, sizes) + place] = found.data[np.repeat(found.starts, sizes) + place]
    row = found.rows
    last_of_row = found.first[1:][row] if len(row) else row
    rows, codes = [], []
    for n in range(1, longest + 1):
        begin = np.flatnonzero(np.arange(len(row)) + n <= last_of_row)
        stop = at[begin + n - 1] + sizes[begin + n - 1]
        rows.append(row[begin])
        codes.append((crc32_spans(joined, at[begin], stop) % np.uint32(buckets)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(codes)


def bucket_counts(docs: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket. At most `buckets` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "_text"):
                total += np.bincount(feature_buckets(words(part.column(0), between=MARKS), longest, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    parts = arrow_map(docs.select(F.col(text).cast("string").alias("_text")), count, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(share in the target / share in the raw texts)) by bucket, with one added to every count."""
    size = len(raw)
    s_all, t_all = int(raw.sum()) + size, int(target.sum()) + size
    ratio = [float((t + 1) * s_all) / float((s + 1) * t_all) for s, t in zip(raw.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], dtype=np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, row_id: str, text: str, longest: int, least_words: int) -> DataFrame:
    """_id, n_features, weight and _able (enough words to be drawn) of every row. `gain` is a table of fixed size."""
    kind = docs.schema[row_id].dataType
    schema = T.StructType(
        [
            T.StructField("_id", kind),
            T.StructField("n_features", T.LongType()),
            T.StructField("weight", T.LongType()),
            T.StructField("_able", T.BooleanType()),
        ]
    )

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                found = words(part.column(1), between=MARKS)
                row, bucket = feature_buckets(found, longest, len(gain))
                n = np.bincount(row, minlength=part.num_rows)
                weight = np.zeros(part.num_rows, dtype=np.int64)
                np.add.at(weight, row, gain[bucket])
                able = np.diff(found.first) >= least_words
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(weight), pa.array(able)], names=schema.names)

    return arrow_map(docs.select(F.col(row_id).alias("_id"), F.col(text).cast("string").alias("_text")), weigh, schema)


def draw(rows: DataFrame, share: int) -> DataFrame:
    """Ranks the floor(share * N / 100) best of the N rows with `_able`: score descending, then `_id`.

    Rows are dealt by ranges of (score, id, place in the stored table), so equal rows spread as well, sorted and
    written with their place in their range; what comes before a range is summed over one row per range.
    """
    kept = stored(rows, "weights")
    kept = kept.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    wanted = share * kept.filter("_able").count() // 100
    order = [F.desc("score"), F.asc("_id"), F.asc("_file"), F.asc("_at")]
    dealt = kept.filter("_able").drop("_able").repartitionByRange(*order).sortWithinPartitions(*order)
    in_range = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = stored(dealt.drop("_file", "_at").withColumns({"_range": F.spark_partition_id(), "_place": in_range}), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    bases = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # One row per range of the shuffle above.
    rank = F.col("_base") + F.col("_place") + 1
    ranked = dealt.join(F.broadcast(bases), "_range").withColumn("rank", F.when(rank <= wanted, rank)).drop("_range", "_place", "_base")
    rest = kept.filter("not _able").drop("_able", "_file", "_at").withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest)


def resample(
    docs: DataFrame,
    target: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    longest: int = 1,
    buckets: int = BUCKETS,
    least_words: int = 20,
    share: int = 10,
    seed: str = "2024",
) -> DataFrame:
    """row_id, n_features, weight, score and rank of every row of `docs`; rank is null for rows not drawn.

    Words are runs of ASCII letters, digits and all characters beyond ASCII, A-Z as a-z. Texts are read whole, null
    ones as empty (no feature, weight 0, never drawn if `least_words` is above 0). A null id counts as the empty
    string in the random part of the score and is ordered first. Repeated rows are drawn each by itself, equal
    scores by the smaller id, equal ids in any order. An empty `docs` gives no rows, an empty `target` gives gains
    that only even out the buckets of `docs`. Only the two named columns of `docs` are read.
    """
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    rows = weighted(docs, gain, row_id, text, longest, least_words)
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    ranked = draw(rows.withColumn("score", F.col("weight") + noise), share)
    return ranked.select(F.col("_id").alias(row_id), "n_features", "weight", "score", "rank")
