"""Packing of tokenised documents into windows by the sum-of-squares rule.

Every task packs the documents of its partition by itself. A document's full windows stand alone; its rest
goes to the fill level that makes the sum of squared counts of partially filled windows smallest, tracked in an
array with one count per level. A window is given out when it is exactly full. What is still open when the
partition ends is laid end to end and cut into full windows, and the last remainder into windows whose sizes
are powers of two, so nothing is padded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from caselens.llm.common import arrow_map, slices
from caselens.llm.tokens import encoder


@dataclass
class Levels:
    """Counts of partially filled windows by fill level, and the windows themselves."""

    window: int
    counts: np.ndarray = field(init=False)
    open: dict[int, list[list[tuple]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.counts = np.zeros(self.window + 1, dtype=np.int64)

    def place(self, piece: tuple, size: int) -> list[tuple] | None:
        """Puts a piece into the best level; returns the window if that fills it.

        Moving a window from level h to h + size changes the sum of squares by 2(N[h + size] - N[h] + 1),
        filling one up by 1 - 2N[h], and opening one by 2N[size] + 1. Ties go to the fullest level.
        """
        counts, top = self.counts, self.window - size
        change = 2 * (counts[size : self.window + 1] - counts[: top + 1] + 1)
        change[0] = 2 * counts[size] + 1
        change[top] = 1 - 2 * counts[top]
        change[1:][counts[1 : top + 1] == 0] = np.iinfo(np.int64).max
        level = top - int(np.argmin(change[::-1]))
        if level:
            group = self.open[level].pop()
            counts[level] -= 1
        else:
            group = []
        group.append(piece)
        if level + size == self.window:
            return group
        self.open.setdefault(level + size, []).append(group)
        counts[level + size] += 1
        return None

    def left(self) -> list[tuple]:
        """The pieces of all windows that are not full, fullest windows first."""
        return [p for level in sorted(self.open, reverse=True) for group in self.open[level] for p in group]


def _laid_out(pieces: list[tuple], window: int) -> Iterator[list[tuple]]:
    """Pieces end to end, cut into full windows and at last into powers of two."""
    total = sum(len(p[2]) for p in pieces)
    sizes = [window] * (total // window) + [1 << b for b in reversed(range(window.bit_length())) if (total % window) >> b & 1]
    queue, at = iter(pieces), 0
    piece = next(queue, None)
    for size in sizes:
        group, room = [], size
        while room:
            take = min(room, len(piece[2]) - at)
            group.append((piece[0], piece[1] + at, piece[2][at : at + take], piece[3]))
            room, at = room - take, at + take
            if at == len(piece[2]):
                piece, at = next(queue, None), 0
        yield group


def pack_documents(
    docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, row_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of documents and the place of each in a sequence of at most `window` tokens.

    Returns row_id, start (the document's ids before the piece), length, tokens (the ids, little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset (place in the sequence). Every document ends with
    `end_id`, so a null or empty text is one piece of one id. Rows are packed one by one: repeated rows and
    null ids stay as they are; other columns are not read. Every id lies in exactly one piece, the pieces of a
    sequence leave no gap, and every sequence is full but for at most log2(window) per partition, whose sizes
    are powers of two. `window` must be a power of two.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    id_type = docs.schema[row_id].dataType
    schema = T.StructType(
        [
            T.StructField(row_id, id_type),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("tokens", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 33
        levels = Levels(window)
        types = None

        def rows(groups: list[list[tuple]], first: int) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], [], [], []]
            for n, group in enumerate(groups):
                offset = 0
                for doc, start, ids, total in group:
                    for column, value in zip(out, (doc, start, len(ids), ids.tobytes(), total, first + n, offset), strict=True):
                        column.append(value)
                    offset += len(ids)
            kinds = [types, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, kinds, strict=True)], names=schema.names)

        for batch in batches:
            types = batch.column(0).type
            for part in slices(batch, text):
                got = encoder(tokenizer).encode(part.column(text)).closed(end_id)
                groups = []
                for r, doc in enumerate(part.column(0).to_pylist()):
                    ids = got.ids[got.first[r] : got.first[r + 1]]
                    whole = len(ids) // window * window
                    groups += [[(doc, a, ids[a : a + window], len(ids))] for a in range(0, whole, window)]
                    if whole < len(ids):
                        full = levels.place((doc, whole, ids[whole:].copy(), len(ids)), len(ids) - whole)
                        if full:
                            groups.append(full)
                yield rows(groups, made)
                made += len(groups)
        rest = list(_laid_out(levels.left(), window))
        if rest:
            yield rows(rest, made)

    return arrow_map(docs.select(row_id, text), pack, schema)
