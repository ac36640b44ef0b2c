"""Token ids in files of fixed-width bits, with block offsets for random access.

A dataset is a folder of shards and a Parquet `manifest` that names them. Only files that the manifest names
belong to it, so what a lost or repeated task leaves behind is never read. A shard is

    blocks    BLOCK ids each (the last one fewer, filled with zeros), `width` bits an id, as 64-bit words
    index     block offsets (u64), document ids (i64), null marks (u8), starts (u64, one more than documents)
    trailer   width, number of blocks, documents and ids, place of the index (u64 each), magic

all little-endian. Documents lie in ascending order of their id (null first, then by text) across the shards.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselens.llm.common import arrow_map, slices
from caselens.llm.tokens import encoder

BLOCK = 65_536
MAGIC = b"IDBITS01"
TRAILER = 5 * 8 + len(MAGIC)
MANIFEST = "shard long, file string, n_docs long, n_ids long"


def bits_for(vocabulary: int) -> int:
    """The least number of bits that holds every id below `vocabulary`."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> np.ndarray:
    """Ids in `width` bits each, as 64-bit words; 64 ids fill `width` words."""
    grid = np.zeros((-(-len(ids) // 64), 64), dtype=np.uint64)
    grid.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(grid), width), dtype="<u8")
    for k in range(64):
        word, shift = divmod(k * width, 64)
        out[:, word] |= grid[:, k] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= grid[:, k] >> np.uint64(64 - shift)
    return out.reshape(-1)


def unpack_bits(words: np.ndarray, width: int, count: int) -> np.ndarray:
    """The first `count` ids of packed words, as unsigned 32-bit integers."""
    rows = words.reshape(-1, width)
    out = np.empty((len(rows), 64), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        value = rows[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (rows[:, word + 1] << np.uint64(64 - shift))
        out[:, k] = value & mask
    return out.reshape(-1)[:count]


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class ShardWriter:
    """Writes one shard; ids are handed on a document at a time or many at once, and kept a block at most."""

    def __init__(self, folder: str, name: str, width: int):
        files, at = _file_system(folder)
        files.create_dir(at, recursive=True)
        self.out = files.open_output_stream(f"{at}/{name}")
        self.width, self.waiting, self.offsets = width, [np.empty(0, dtype=np.uint32)], []
        self.docs: list[int | None] = []
        self.sizes: list[np.ndarray] = []
        self.ids = 0

    def add(self, docs: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.docs += docs
        self.sizes.append(sizes)
        self.ids += len(ids)
        ids = np.concatenate([*self.waiting, ids])
        cut = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:cut])
        self.waiting = [ids[cut:]]

    def _blocks(self, ids: np.ndarray) -> None:
        for k in range(0, len(ids), BLOCK):
            self.offsets.append(self.out.tell())
            self.out.write(pack_bits(ids[k : k + BLOCK], self.width).tobytes())

    def close(self) -> None:
        self._blocks(self.waiting[0])
        index = self.out.tell()
        starts = np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, dtype=np.int64), *self.sizes]))])
        self.out.write(np.array(self.offsets, dtype="<u8").tobytes())
        self.out.write(np.array([d or 0 for d in self.docs], dtype="<i8").tobytes())
        self.out.write(np.array([d is None for d in self.docs], dtype=np.uint8).tobytes())
        self.out.write(starts.astype("<u8").tobytes())
        self.out.write(np.array([self.width, len(self.offsets), len(self.docs), self.ids, index], dtype="<u8").tobytes() + MAGIC)
        self.out.close()


class Shard:
    """Random access to one shard: only the index and the blocks asked for are read."""

    def __init__(self, path: str):
        files, at = _file_system(path)
        self.file = files.open_input_file(at)
        end = self.file.size()
        tail = self.file.read_at(TRAILER, end - TRAILER)
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"{path} is not a shard of token ids")
        self.width, blocks, docs, self.ids, index = np.frombuffer(tail[: 5 * 8], dtype="<u8").astype(int).tolist()
        raw = self.file.read_at(end - TRAILER - index, index)
        self.offsets = np.frombuffer(raw, dtype="<u8", count=blocks)
        self.docs = np.frombuffer(raw, dtype="<i8", count=docs, offset=8 * blocks)
        self.null = np.frombuffer(raw, dtype=np.uint8, count=docs, offset=8 * (blocks + docs)).astype(bool)
        self.starts = np.frombuffer(raw, dtype="<u8", count=docs + 1, offset=8 * (blocks + docs) + docs).astype(np.int64)

    def read(self, start: int, count: int) -> np.ndarray:
        """`count` ids from place `start` on."""
        first, last = start // BLOCK, -(-(start + count) // BLOCK)
        parts = []
        for b in range(first, last):
            n = min(BLOCK, self.ids - b * BLOCK)
            raw = self.file.read_at(-(-n // 64) * self.width * 8, int(self.offsets[b]))
            parts.append(unpack_bits(np.frombuffer(raw, dtype="<u8"), self.width, n))
        ids = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)
        return ids[start - first * BLOCK : start - first * BLOCK + count]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k]))


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, row_id: str = "doc_id", text: str = "text"
) -> None:
    """Encodes whole texts (null: empty), closes each with `end_id` and writes the dataset at `path`.

    `path` is a URI or folder that executors share. Row ids are integers or null; equal ids are ordered by
    their texts, equal rows are all written. Rows are dealt by ranges of id and text hash, so one repeated id
    does not make one large shard. Other columns are not read. An empty table has an empty manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, name = TaskContext.get().partitionId(), None, ""
        for batch in batches:
            for part in slices(batch, text):
                enc = encoder(tokenizer)
                got = enc.encode(part.column(text)).closed(end_id)
                if out is None:
                    name = f"{shard:08d}-{uuid.uuid4().hex}.ids"
                    out = ShardWriter(path, name, bits_for(max(enc.vocabulary, end_id + 1)))
                out.add(part.column(0).to_pylist(), got.ids, np.diff(got.first))
        if out is not None:
            out.close()
            row = [[shard], [name], [len(out.docs)], [out.ids]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["shard", "file", "n_docs", "n_ids"])

    key = F.xxhash64(text)
    ordered = docs.select(F.col(row_id).cast("bigint").alias(row_id), text).repartitionByRange(row_id, key)
    arrow_map(ordered.sortWithinPartitions(row_id, key, text), write, MANIFEST).write.parquet(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str, row_id: str = "doc_id") -> DataFrame:
    """Every document of a dataset: row_id, start (ids before it in the dataset), n_tokens, tokens (bytes).

    tokens holds the ids as little-endian unsigned 32-bit integers. The running sum of starts is taken over
    one row per shard.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    shards = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(f"{path}/{file}")
                at = 0
                while at < len(shard.docs):
                    end = max(at + 1, int(np.searchsorted(shard.starts, shard.starts[at] + 16 * BLOCK, side="right")) - 1)
                    bounds = shard.starts[at : end + 1]
                    raw = shard.read(int(bounds[0]), int(bounds[-1] - bounds[0])).astype("<u4").tobytes()
                    cuts = ((bounds - bounds[0]) * 4).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.docs[at:end], mask=shard.null[at:end]),
                            pa.array(bounds[:-1] + base),
                            pa.array(np.diff(bounds)),
                            pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], type=pa.binary()),
                        ],
                        names=[row_id, "start", "n_tokens", "tokens"],
                    )
                    at = end

    spread = shards.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "file")
    return arrow_map(spread, read, f"{row_id} long, start long, n_tokens long, tokens binary")
