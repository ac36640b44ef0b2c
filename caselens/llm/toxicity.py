"""Toxicity scores from a logistic model that is held to the same score when identity terms are swapped.

Features are the distinct words of a text (letters and digits, A-Z as a-z) and their first bytes, hashed into a
fixed table. The model is fitted on a bounded sample of labelled rows, over the features that tell the classes
apart best and those of all identity terms. To the loss comes, for each labelled text with an identity term,
the squared change of its score when every such term is replaced by the next one of its group: a group's name
alone can then not raise a score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.llm.common import arrow_map, slices
from caselens.llm.words import MARKS, hash_spans, mix, words

# Identity terms by group; a swap takes each term to the next of its group.
IDENTITY_GROUPS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives"),
    ("old", "young"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
TABLE = 1 << 20
PREFIXES = (4, 5, 6)
SAMPLE = 20_000  # labelled texts to fit on, at most
SELECTED = 4_096  # features chosen by their chi-square
MIN_TEXTS = 5  # labelled texts that must have a feature
MIN_CHI = 20.0  # chi-square below which a feature is taken for chance (p of about 1e-5)
THRESHOLD = 0.7


def _slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, feature) pairs of a batch, one per occurrence, and the number of rows."""
    found = words(column, between=MARKS)
    row, size = found.rows, found.ends - found.starts
    rows, slots = [row], [found.hashes]
    for k in PREFIXES:
        some = size >= k
        starts = found.starts[some]
        rows.append(row[some])
        slots.append(mix(hash_spans(found.data, starts, starts + k) + np.uint64(k)))
    return np.concatenate(rows), (np.concatenate(slots) % np.uint64(TABLE)).astype(np.int64), len(found.first) - 1


def _distinct(row: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(row * TABLE + slot)
    return pairs // TABLE, pairs % TABLE


def swapped_text(text: str, groups: Sequence[Sequence[str]] = IDENTITY_GROUPS) -> str | None:
    """The plain words of a text with every identity term replaced by the next of its group; None without one."""
    follow = {g[k]: g[(k + 1) % len(g)] for g in groups for k in range(len(g))}
    marks = {c: " " for c in range(128) if MARKS[c]} | {c: chr(c + 32) for c in range(65, 91)}
    found = text.translate(marks).split()
    if not any(w in follow for w in found):
        return None
    return " ".join(follow.get(w, w) for w in found)


def _identity_slots(groups: Sequence[Sequence[str]]) -> np.ndarray:
    terms = [t for g in groups for t in g]
    return np.unique(_slots(pa.array(terms or [""]))[1])


@dataclass
class Model:
    """Weight of each feature slot (zero for those not used) and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, column: pa.Array) -> np.ndarray:
        """Chance of label 1 for each row; null and empty texts get that of a text without features."""
        row, slot, rows = _slots(column)
        used = self.weights[slot] != 0
        row, slot = _distinct(row[used], slot[used])
        total = np.bincount(row, weights=self.weights[slot], minlength=rows) + self.intercept
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _fit(
    indptr: np.ndarray, slots: np.ndarray, label: np.ndarray, change: list[tuple[np.ndarray, np.ndarray]], size: int,
    ridge: float, fairness: float, steps: int = 400,
) -> tuple[np.ndarray, float]:
    """Logistic weights by Adam. change: for each text with an identity term, the slots it loses and gains."""
    row = np.repeat(np.arange(len(label)), np.diff(indptr))
    c_row = np.repeat(np.arange(len(change)), [len(a) + len(b) for a, b in change]) if change else np.empty(0, dtype=np.int64)
    c_slot = np.concatenate([np.concatenate(p) for p in change]) if change else np.empty(0, dtype=np.int64)
    c_sign = np.concatenate([np.repeat([1.0, -1.0], [len(a), len(b)]) for a, b in change]) if change else np.empty(0)
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    size_of = np.bincount(label.astype(np.int64), minlength=2)
    share = 0.5 / np.maximum(size_of, 1)[label.astype(np.int64)]  # both classes weigh the same
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[slots], minlength=len(label)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label) * share
        grad = np.bincount(slots, weights=err[row], minlength=size) + ridge * w
        if change:
            moved = np.bincount(c_row, weights=w[c_slot] * c_sign, minlength=len(change))
            grad += fairness * np.bincount(c_slot, weights=moved[c_row] * c_sign, minlength=size) / len(change)
        g = np.append(grad, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    training: Column | None = None,
    row_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    groups: Sequence[Sequence[str]] = IDENTITY_GROUPS,
    sample: int = SAMPLE,
    ridge: float = 2e-4,
    fairness: float = 1.0,
) -> Model:
    """Fits on at most `sample` labelled rows for which `training` (of the row id) holds.

    The sample is the labelled ids with the smallest hashes, so it does not depend on the order of rows. Rows
    with a null id or label are left out; an id labelled more than once counts with its highest label. Without
    rows of both classes the model gives every text the share of label 1 (0.5 without any row).
    """
    known = labels.select(F.col(row_id).alias("_id"), F.col(label).cast("int").alias("_label"))
    known = known.filter(F.col("_id").isNotNull() & F.col("_label").isNotNull())
    if training is not None:
        known = known.withColumnRenamed("_id", row_id).filter(training).withColumnRenamed(row_id, "_id")
    chosen = known.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # At most `sample` small rows: a proven bound.
    pairs = docs.select(F.col(row_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    fitted = pairs.select("_text", "_label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, TABLE), dtype=np.int64)
        texts = np.zeros(2, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "_text"):
                toxic = (part.column("_label").to_numpy() > 0).astype(np.int64)
                texts += np.bincount(toxic, minlength=2)
                row, slot = _distinct(*_slots(part.column("_text"))[:2])
                for k in (0, 1):
                    total[k] += np.bincount(slot[toxic[row] == k], minlength=TABLE)
        some = np.flatnonzero(total.any(axis=0))
        columns = [np.append(some, -1), np.append(total[0, some], texts[0]), np.append(total[1, some], texts[1])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["slot", "plain", "toxic"])

    counts = arrow_map(fitted, count, "slot long, plain long, toxic long")
    counts = counts.groupBy("slot").agg(F.sum("plain").alias("plain"), F.sum("toxic").alias("toxic"))
    # One row per slot of the fixed table at most.
    table = {int(s): (int(p), int(t)) for s, p, t in counts.filter((F.col("plain") + F.col("toxic") >= MIN_TEXTS) | (F.col("slot") < 0)).collect()}
    plain, toxic = table.pop(-1, (0, 0))
    if not plain or not toxic:
        share = toxic / (plain + toxic) if plain + toxic else 0.5
        return Model(np.zeros(TABLE, dtype=np.float32), float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -20, 20)))
    slot = np.fromiter(table, dtype=np.int64, count=len(table))
    a = np.array([table[int(s)] for s in slot], dtype=float).reshape(-1, 2)
    p, t = a[:, 0], a[:, 1]
    n, cross = plain + toxic, t * (plain - p) - p * (toxic - t)
    chi = n * cross**2 / np.maximum((p + t) * (n - p - t) * plain * toxic, 1)
    order = np.lexsort((slot, -chi))[:SELECTED]
    best = slot[order[chi[order] >= MIN_CHI]]
    used = np.union1d(best, _identity_slots(groups))
    number = np.full(TABLE, -1, dtype=np.int64)
    number[used] = np.arange(len(used))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(column: pa.Array) -> list[np.ndarray]:
            row, slot, rows = _slots(column)
            keep = number[slot] >= 0
            row, slot = _distinct(row[keep], slot[keep])
            return np.split(number[slot], np.cumsum(np.bincount(row, minlength=rows))[:-1])

        for batch in batches:
            for part in slices(batch, "_text"):
                texts = [x or "" for x in part.column("_text").to_pylist()]
                other = [swapped_text(x, groups) for x in texts]
                own = lists(pa.array(texts))
                swap = lists(pa.array([o if o is not None else "" for o in other]))
                columns = [
                    part.column("_label"),
                    pa.array([x.tolist() for x in own], type=pa.list_(pa.int64())),
                    pa.array([s.tolist() if o is not None else None for s, o in zip(swap, other, strict=True)], type=pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "own", "swapped"])

    # At most `sample` rows of the selected features.
    rows = arrow_map(fitted, extract, "label int, own array<long>, swapped array<long>").collect()
    rows.sort(key=lambda r: (r.label, r.own, r.swapped or []))  # the fit does not depend on the order of rows
    own = [np.array(r.own, dtype=np.int64) for r in rows]
    change = [
        (np.setdiff1d(o, r.swapped), np.setdiff1d(np.array(r.swapped, dtype=np.int64), o))
        for o, r in zip(own, rows, strict=True)
        if r.swapped is not None
    ]
    indptr = np.concatenate([[0], np.cumsum([len(o) for o in own])])
    target = np.array([min(1, max(0, r.label)) for r in rows], dtype=float)
    weights, intercept = _fit(indptr, np.concatenate(own), target, change, len(used), ridge, fairness)
    out = np.zeros(TABLE, dtype=np.float32)
    out[used] = weights
    return Model(out, intercept)


def score_documents(docs: DataFrame, model: Model, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row_id and score of every row, from its text alone. The model (a table of fixed size) goes to all tasks."""
    schema = T.StructType([T.StructField(row_id, docs.schema[row_id].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(part.column(text)))], names=schema.names)

    return arrow_map(docs.select(row_id, text), run, schema)
