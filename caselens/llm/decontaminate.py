"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

The benchmark is taken in blocks of bounded size, each against all documents. Every n-gram of an item is a seed,
however common it is. The item is aligned with the text around the seeds a document holds, unless that text has
too few of the item's words in any order to reach the score. All is one map: no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.llm.common import arrow_map, slices
from caselens.llm.words import MARKS, mix, run_rows, runs, words

SEED_WORDS = 3
SEGMENT = 512  # words of an item that are aligned at once
BLOCK_BYTES = 8_000_000  # of benchmark text at once
MIN_SCORE = 0.5
CELLS = 2_000_000  # of alignment tables worked on at once
MATCH, MISMATCH, GAP = 2, -1, -1


@dataclass
class Items:
    """Word hashes of a block's items, cut into segments, and the n-grams of each segment.

    grams: distinct n-gram hashes, sorted. at: for each gram the range of its (segment, offset) entries.
    """

    item: np.ndarray
    hashes: list[np.ndarray]
    grams: np.ndarray
    at: np.ndarray
    segment: np.ndarray
    offset: np.ndarray
    sizes: list[int]


def _gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    return mix(runs(hashes, n) + np.uint64(n))


def prepare(texts: list[str | None], n: int = SEED_WORDS) -> Items:
    """Segments and n-grams of item texts; an item of fewer than n words has its whole text as its n-gram."""
    found = words(pa.array(texts, type=pa.large_string()), between=MARKS)
    item, hashes, entries = [], [], []
    for k in range(len(texts)):
        own = found.hashes[found.first[k] : found.first[k + 1]]
        for a in range(0, len(own), SEGMENT):
            part = own[a : a + SEGMENT]
            size = min(n, len(part))
            grams = _gram_hashes(part, size)
            entries.append(np.array([grams, np.full(len(grams), len(item)), np.arange(len(grams)), np.full(len(grams), size)], dtype=np.uint64))
            item.append(k)
            hashes.append(part)
    table = np.concatenate(entries, axis=1) if entries else np.empty((4, 0), dtype=np.uint64)
    table = table[:, np.argsort(table[0], kind="stable")]
    grams, counts = np.unique(table[0], return_counts=True)
    return Items(
        np.array(item, dtype=np.int64), hashes, grams, np.concatenate([[0], np.cumsum(counts)]),
        table[1].astype(np.int64), table[2].astype(np.int64), sorted({int(x) for x in table[3]}),
    )


def _hits(items: Items, found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word place in the batch and gram of every n-gram of the batch that an item has."""
    sieve = np.zeros(1 << 20, dtype=bool)
    sieve[(items.grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    rows, places, grams = [], [], []
    for n in items.sizes:
        place, row = run_rows(found.first, n)
        own = _gram_hashes(found.hashes, n)[place]
        some = np.flatnonzero(sieve[(own & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(items.grams, own[some]), len(items.grams) - 1)
        ok = items.grams[at] == own[some]
        rows.append(row[some][ok])
        places.append(place[some][ok])
        grams.append(at[ok])
    return np.concatenate(rows), np.concatenate(places), np.concatenate(grams)


def _aligned(left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignments of rows of `left` (texts) and `right` (items of `sizes` words).

    Returns score as a share of a perfect match, and the place of the first and last text word. Score and
    start travel in one integer (score high, earlier start preferred), so no table is kept for tracing back.
    """
    shift = 24
    unit = np.int64(1 << shift)
    places = np.arange(left.shape[1], dtype=np.int64)
    fresh = unit - 1 - places  # score 0, alignment starting here
    steps = places * unit * -GAP
    none = fresh - 1  # score 0: what follows starts one place later
    before = np.broadcast_to(none, left.shape)
    best = np.zeros(len(left), dtype=np.int64)
    last = np.zeros(len(left), dtype=np.int64)
    for k in range(right.shape[1]):
        gain = np.where(left == right[:, k, None], MATCH * unit, MISMATCH * unit)
        now = np.empty(left.shape, dtype=np.int64)
        now[:, 0] = fresh[0] + gain[:, 0]
        now[:, 1:] = np.maximum(before[:, :-1], fresh[1:]) + gain[:, 1:]
        now = np.maximum(now, before + GAP * unit)
        now = np.maximum.accumulate(now + steps, axis=1) - steps
        now = np.where(now < unit, none, now)
        top = now.argmax(axis=1)
        value = now[np.arange(len(now)), top]
        better = (value >> shift > best >> shift) & (k < sizes)
        best = np.where(better, value, best)
        last = np.where(better, top, last)
        before = now
    return (best >> shift) / (MATCH * sizes), unit - 1 - (best & (unit - 1)), last


def _possible(items: Items, hashes: np.ndarray, segment: np.ndarray, low: np.ndarray, high: np.ndarray, min_score: float) -> np.ndarray:
    """Whether each window has enough of its segment's words, in any order, to reach the score.

    An alignment pairs each word of window and segment at most once, so its score is at most the share of the
    segment's words that the window has, each as often as in both.
    """
    out = np.zeros(len(segment), dtype=bool)
    todo = np.argsort(segment, kind="stable")
    for own in np.split(todo, np.flatnonzero(np.diff(segment[todo])) + 1):
        word, need = np.unique(items.hashes[segment[own[0]]], return_counts=True)
        step = np.cumsum((high - low)[own] + len(word)) // CELLS  # so many windows at once as fit
        for now in np.split(own, np.flatnonzero(np.diff(step)) + 1):
            wide = (high - low)[now]
            window = np.repeat(np.arange(len(now)), wide)
            there = hashes[np.arange(len(window)) + np.repeat(low[now] - (np.cumsum(wide) - wide), wide)]
            at = np.minimum(np.searchsorted(word, there), len(word) - 1)
            ok = word[at] == there
            have = np.bincount(window[ok] * len(word) + at[ok], minlength=len(now) * len(word)).reshape(len(now), len(word))
            out[now] = np.minimum(have, need).sum(axis=1) >= min_score * need.sum() - 1e-9
    return out


def matches(items: Items, column: pa.Array, min_score: float) -> tuple[np.ndarray, ...]:
    """(row, item, score, first word, last word) of the passages of a batch that score enough, best per pair."""
    found = words(column, between=MARKS)
    empty = np.empty(0, dtype=np.int64)
    if not len(items.grams) or not len(found.hashes):
        return empty, empty, np.empty(0), empty, empty
    row, place, gram = _hits(items, found)
    count = items.at[gram + 1] - items.at[gram]
    entry = np.repeat(items.at[gram] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    row, place = np.repeat(row, count), np.repeat(place, count)
    segment = items.segment[entry]
    start = place - items.offset[entry]  # where the segment would begin
    order = np.lexsort((start, segment, row))
    row, segment, start = row[order], segment[order], start[order]
    if not len(row):
        return empty, empty, np.empty(0), empty, empty
    size = np.array([len(h) for h in items.hashes])
    cut = np.ones(len(row), dtype=bool)
    cut[1:] = (np.diff(row) != 0) | (np.diff(segment) != 0) | (np.diff(start) > size[segment[1:]])
    first = np.flatnonzero(cut)
    end = np.append(first[1:], len(row)) - 1
    row, segment, low, high = row[first], segment[first], start[first], start[end]
    slack = size[segment] // 4 + 4
    low = np.maximum(low - slack, found.first[row])
    high = np.minimum(high + size[segment] + slack, found.first[row + 1])
    some = _possible(items, found.hashes, segment, low, high, min_score)
    row, segment, low, high = row[some], segment[some], low[some], high[some]
    wide, long = high - low, size[segment]
    score, begin, close = np.empty(len(row)), np.empty(len(row), dtype=np.int64), np.empty(len(row), dtype=np.int64)
    todo = np.lexsort((long, wide))
    while len(todo):
        # Widths ascend: as many windows as fit into the table.
        fit = int(np.searchsorted(wide[todo] * np.arange(1, len(todo) + 1), CELLS, side="right"))
        now, todo = todo[: max(1, fit)], todo[max(1, fit) :]
        left = np.zeros((len(now), wide[now].max()), dtype=np.uint64)
        right = np.ones((len(now), long[now].max()), dtype=np.uint64)
        at = low[now, None] + np.arange(left.shape[1])
        inside = at < high[now, None]
        left[inside] = found.hashes[at[inside]]
        for k, s in enumerate(segment[now]):
            right[k, : long[now[k]]] = items.hashes[s]
        score[now], b, c = _aligned(left, right, long[now])
        begin[now], close[now] = low[now] + b, low[now] + c
    ok = score >= min_score
    row, item, score = row[ok], items.item[segment[ok]], score[ok]
    begin, close = begin[ok] - found.first[row], close[ok] - found.first[row]
    order = np.lexsort((begin, -score, item, row))
    row, item, score, begin, close = row[order], item[order], score[order], begin[order], close[order]
    lead = np.ones(len(row), dtype=bool)
    lead[1:] = (np.diff(row) != 0) | (np.diff(item) != 0)
    return row[lead], item[lead], score[lead], begin[lead], close[lead]


def blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of the benchmark, a block of bounded size at a time."""
    ids, texts, size = [], [], 0
    for i, t in benchmark.select(item_id, text).toLocalIterator():
        ids.append(i)
        texts.append(t)
        size += len(t or "")
        if size >= block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    min_score: float = MIN_SCORE,
    row_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Documents that hold a benchmark item or an edited copy: row_id, item_id, score, first_word, last_word.

    A row for each document row and item that align with at least `min_score` (matching words count 2, other
    words and gaps -1, as a share of the item matched word for word), with the best passage; ties go to the
    earliest. Words are runs of letters and digits, A-Z as a-z. Items of over 512 words are aligned in segments,
    and the best one counts. Null or empty texts and items match nothing; repeated rows and items, and null
    ids, are matched one by one; other columns are not read.
    """
    result = None
    schema = T.StructType(
        [
            T.StructField(row_id, docs.schema[row_id].dataType),
            T.StructField(item_id, benchmark.schema[item_id].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("last_word", T.LongType()),
        ]
    )
    for ids, texts in blocks(benchmark, item_id, item_text, block_bytes):
        items = prepare(texts)

        def find(batches: Iterator[pa.RecordBatch], items: Items = items, ids: list = ids) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text):
                    row, item, score, begin, end = matches(items, part.column(text), min_score)
                    columns = [part.column(0).take(pa.array(row)), pa.array([ids[k] for k in item.tolist()]), *map(pa.array, (score, begin, end))]
                    if len(row):
                        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        block = arrow_map(docs.select(row_id, text), find, schema)
        result = block if result is None else result.unionByName(block)
    return docs.sparkSession.createDataFrame([], schema) if result is None else result


def clean_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    min_score: float = MIN_SCORE,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows, with all their columns, in which `find_passages` finds nothing."""
    for _, texts in blocks(benchmark, item_id, item_text, block_bytes):
        items = prepare(texts)

        def keep(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text):
                    row = matches(items, part.column(text), min_score)[0]
                    clean = np.ones(part.num_rows, dtype=bool)
                    clean[row] = False
                    yield part.filter(pa.array(clean))

        docs = arrow_map(docs, keep, docs.schema)
    return docs
