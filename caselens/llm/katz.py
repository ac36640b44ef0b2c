"""Katz backoff scores of whole texts: Good-Turing discounted word pairs that back off to discounted words.

    P(w | h) = d(c) c(h, w) / (c(h) + 1)          if the pair was seen in training
             = a(h) P(w)                          else, with a(h) such that all words sum up to one
    P(w)     = d(c) c(w) / (N + 1)                if the word was seen
             = what is left                       for all unseen words together

One event more than counted is kept in each denominator, so that something is left for unseen words even where
no count is small. Discounts are Good-Turing's for counts up to 5 (see `discounts`). Contexts h are the start of a
text and every word of the training texts; after a word that is not in them the model backs off to P(w) at once.
The order is two words.

No table over all words or pairs goes to a task. Word counts are one grouped sum. Words that make up at least 1 of
65,536 training tokens are called frequent; there are at most 65,536, so their counts may go to every task. Each
document's distinct (context, word, times) entries go once to the partition of their word (of the pair, for
frequent words), sorted and compressed, a blob for each slice of texts and partition. The partition sums up
the counts, and gives back sums per document and per context. A task takes several partitions in turn and adds up what
they give back for a document. Counts of counts and discounts follow from these.
Backoff weights are a table by context, joined to the unseen pairs of each document; those of frequent contexts
are broadcast. The score is put together from sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.llm.common import arrow_map, scratch, slices, small_batches, stored
from caselens.llm.words import mix, words

HOT = 65_536  # a frequent word makes up at least 1 / HOT of the tokens
SHARE = np.inf  # every word is a context; if set (to HOT at most), only those that make up 1 / SHARE of the tokens
TOP = 5  # counts that are discounted
END = np.uint64(1)  # stands for the end of a text
NONE = np.uint32(0xFFFFFFFF)
# Contexts are numbered by their place among the frequent words; others are their hash with the top bit set.
NO_CONTEXT, RARE = np.uint64(1 << 62), np.uint64(1 << 63)
TOKENS_A_PART = 2_000_000  # what a task of numpy arrays of about 200 MB can sum up at once
PARTS_A_TASK = 4  # parts that a task sums up one after the other, where there are more than TASKS
TASKS = 12
ROWS_A_BATCH = 20_000  # rows of sums that go back at once, some 2 MB
HELD = 1_000_000  # documents whose sums a task holds from part to part, some 100 MB


def _katz(n: list[float]) -> list[float] | None:
    """Katz's discounts from counts of counts, if they all lie in (0, 1]."""
    if min(n[1 : TOP + 2]) <= 0:
        return None
    a = (TOP + 1) * n[TOP + 1] / n[1]
    if a >= 1:
        return None
    out = [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, TOP + 1)]
    return out if all(0 < d <= 1 for d in out) else None


def discounts(n: list[float]) -> list[float]:
    """d(1) .. d(TOP) from the counts of counts n[1] .. n[TOP + 1] (n[0] is not used).

    Copies in a corpus bend the counts of counts. Where Katz's formula then leaves (0, 1], it is applied to
    the power law fitted to them, and if that fails as well, half an event is taken from every count.
    """
    found = _katz(n)
    if found is None and min(n[1 : TOP + 2]) > 0:
        r = np.log(np.arange(1, TOP + 2))
        slope, level = np.polyfit(r, np.log(np.array(n[1 : TOP + 2], dtype=float)), 1)
        found = _katz([0.0, *np.exp(level + slope * r).tolist()])
    return found or [(r - 0.5) / r for r in range(1, TOP + 1)]


@dataclass
class Unigrams:
    """Totals of the training words, and the counts of the frequent ones (sorted by hash, with END).

    context: which of the frequent words are contexts. rest: whether all others are.
    """

    tokens: int
    types: int
    discount: list[float]
    left: float
    texts: int
    frequent: np.ndarray
    counts: np.ndarray
    context: np.ndarray
    rest: bool

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + self.types + 1))

    def log_p(self, count: np.ndarray) -> np.ndarray:
        """log10 P(w) of words with these counts."""
        return np.log10(self.p(count))

    def p(self, count: np.ndarray) -> np.ndarray:
        rate = np.array([0.0, *self.discount, 1.0])
        return np.where(count > 0, rate[np.minimum(count, TOP + 1)] * count / (self.tokens + 1), self.left)

    def code(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the frequent ones, or NONE."""
        sieve = np.zeros(1 << 20, dtype=bool)
        sieve[(self.frequent & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        out = np.full(len(hashes), NONE, dtype=np.uint32)
        some = np.flatnonzero(sieve[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.frequent, hashes[some]), len(self.frequent) - 1)
        ok = self.frequent[at] == hashes[some]
        out[some[ok]] = at[ok]
        return out

    @property
    def start(self) -> int:
        """The context code of the start of a text."""
        return len(self.frequent)

    def context_counts(self) -> np.ndarray:
        return np.append(self.counts, self.texts)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, END after each row, and each token's row."""
    found = words(column)
    each = np.diff(found.first)
    row = np.repeat(np.arange(len(each)), each + 1)
    out = np.full(len(row), END, dtype=np.uint64)
    ends = np.cumsum(each + 1) - 1
    keep = np.ones(len(row), dtype=bool)
    keep[ends] = False
    out[keep] = found.hashes
    return out, row


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, count) over all rows: word is the hash as a signed number, ends of texts included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> pa.RecordBatch:
            word, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([h[1] for h in held])).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

        for batch in batches:
            for part in slices(batch, text):
                held.append(np.unique(_tokens(part.column(text))[0], return_counts=True))
                if sum(len(h[0]) for h in held) > 1_500_000:
                    yield merged()
        if held:
            yield merged()

    return arrow_map(docs.select(text), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("count"))


def fit_words(counted: DataFrame) -> Unigrams:
    """Totals and frequent words of a stored count table; at most HOT + 1 rows come to the driver."""
    same = [F.sum((F.col("count") == r).cast("long")).alias(f"n{r}") for r in range(1, TOP + 2)]
    total, types, *n = (int(x or 0) for x in counted.agg(F.sum("count"), F.count(F.lit(1)), *same).first())
    rate = discounts([0, *n])
    freed = sum(r * n[r - 1] * (1 - rate[r - 1]) for r in range(1, TOP + 1))
    end = int(END)
    often = counted.filter((F.col("count") * HOT >= total) | (F.col("word") == end)).collect()
    pairs = sorted((int(r["word"]) & 0xFFFFFFFFFFFFFFFF, int(r["count"])) for r in often) or [(end, 0)]
    frequent, counts = np.array([p[0] for p in pairs], dtype=np.uint64), np.array([p[1] for p in pairs], dtype=np.int64)
    texts = int(counts[frequent == END].sum())
    rest = SHARE == np.inf
    context = np.full(len(counts), True) if rest else counts * min(SHARE, HOT) >= total
    return Unigrams(total, types, rate, (freed + 1) / (total + 1), texts, frequent, counts, context, rest)


def _planes(a: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, which packs well when high bytes repeat."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _from_planes(raw: bytes, at: int, n: int, kind) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, dtype=np.uint8, count=n * size, offset=at).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n), at + n * size


def write_blob(keys: np.ndarray, train: np.ndarray, word: np.ndarray, context: np.ndarray, doc: np.ndarray, times: np.ndarray) -> bytes:
    """Entries sorted by word, with the row keys of the documents that occur in them.

    Frequent words are their place, others their hash, as contexts are: places pack far better than hashes.
    """
    used, doc = np.unique(doc, return_inverse=True)
    step = np.diff(word, prepend=np.uint64(0))
    head = np.array([len(used), len(word)], dtype="<u4").tobytes()
    raw = b"".join(
        (
            head, _planes(keys[used]), train[used].astype(np.uint8).tobytes(), _planes(step),
            _planes(context), _planes(doc.astype(np.uint32)), _planes(times.astype(np.uint32)),
        )
    )
    return np.array([len(raw)], dtype="<u8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def read_blob(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = pa.decompress(blob[8:], int(np.frombuffer(blob, dtype="<u8", count=1)[0]), codec="zstd", asbytes=True)
    docs, n = np.frombuffer(raw, dtype="<u4", count=2).tolist()
    keys, at = _from_planes(raw, 8, docs, np.int64)
    train, at = _from_planes(raw, at, docs, np.uint8)
    train = train.copy()  # a single plane is a view, which would hold the whole blob
    step, at = _from_planes(raw, at, n, np.uint64)
    context, at = _from_planes(raw, at, n, np.uint64)
    doc, at = _from_planes(raw, at, n, np.uint32)
    times, at = _from_planes(raw, at, n, np.uint32)
    return keys, train, np.cumsum(step, dtype=np.uint64), context, doc, times


def _codes(model: Unigrams, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token, row, the token's own code and its context (NO_CONTEXT where there is none)."""
    token, row = _tokens(column)
    own = model.code(token)
    after = token | RARE if model.rest else np.full(len(own), NO_CONTEXT)
    often = own != NONE
    after[often] = np.where(model.context[own[often]], own[often].astype(np.uint64), NO_CONTEXT)
    before = np.empty(len(own), dtype=np.uint64)
    before[1:] = after[:-1]
    first = np.ones(len(row), dtype=bool)
    first[1:] = np.diff(row) != 0
    before[first] = model.start
    return token, row, own, before


def _entries(docs: DataFrame, model: Unigrams, parts: int, tasks: list[int]) -> DataFrame:
    """(task, part, blob) of the entries that need counts from elsewhere: all, but for frequent words without a context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                token, row, own, before = _codes(model, part.column("text"))
                keep = (own == NONE) | (before != NO_CONTEXT)
                token, row, own, before = token[keep], row[keep], own[keep], before[keep]
                if not len(token):
                    continue
                pair = mix(token + mix(before))
                home = (np.where(own == NONE, mix(token + np.uint64(7)), pair) % np.uint64(parts)).astype(np.int64)
                token = np.where(own == NONE, token | RARE, own.astype(np.uint64))
                order = np.lexsort((row, before, token, home))
                token, row, before, home = token[order], row[order], before[order], home[order]
                lead = np.ones(len(token), dtype=bool)
                lead[1:] = (np.diff(token) != 0) | (np.diff(before) != 0) | (np.diff(row) != 0) | (np.diff(home) != 0)
                at = np.flatnonzero(lead)
                times = np.diff(np.append(at, len(token)))
                token, row, before, home = token[at], row[at], before[at], home[at]
                keys, train = part.column("key").to_numpy(), part.column("train").to_numpy(zero_copy_only=False)
                there, begin = np.unique(home, return_index=True)
                bounds = np.append(begin, len(home))
                blobs = [
                    write_blob(keys, train, token[a:b], before[a:b], row[a:b], times[a:b])
                    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
                ]
                homes = [tasks[k % len(tasks)] for k in there.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(homes, type=pa.int64()), pa.array(there, type=pa.int64()), pa.array(blobs, type=pa.binary())],
                    names=["task", "part", "blob"],
                )

    return arrow_map(docs.select("text", "key", "train"), run, "task long, part long, blob binary")


_SUMS = T.StructType(
    [T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType())]
    + [T.StructField(x, T.DoubleType()) for x in ("base", "log_sum", "p_sum")]
    + [T.StructField(x, T.LongType()) for x in ("known", *[f"k{r}" for r in range(1, TOP + 2)])]
)
_DOC, _CONTEXT, _EVENT, _COUNTS = range(4)
_DOC_SUMS = ["base", "log_sum", "known", *[f"k{r}" for r in range(1, TOP + 1)]]


def _rows(kind: int, key: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    out = [pa.array(np.full(len(key), kind, dtype=np.int32)), pa.array(key.astype(np.int64))]
    for f in _SUMS.fields[2:]:
        double = isinstance(f.dataType, T.DoubleType)
        value = columns.get(f.name)
        kinds = pa.float64() if double else pa.int64()
        out.append(pa.nulls(len(key), kinds) if value is None else pa.array(value.astype(np.float64 if double else np.int64)))
    return pa.RecordBatch.from_arrays(out, names=[f.name for f in _SUMS.fields])


def summed(model: Unigrams, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Sums per document and context of one partition's entries, and its counts of counts."""
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]
    docs = 0
    while blobs:
        own = read_blob(blobs.pop())
        for k, a in enumerate(own):
            columns[k].append(a + np.uint32(docs) if k == 4 else a)
        docs += len(own[0])
    own = a = None
    times, doc, context, word, train, keys = (np.concatenate(columns.pop()) for _ in range(6))
    order = np.lexsort((context, word))
    # One after the other, so that only one of them is held twice.
    word = word[order]
    context = context[order]
    doc = doc[order]
    times = times[order]
    del order
    new_word = np.ones(len(word), dtype=bool)
    new_word[1:] = word[1:] != word[:-1]
    new_pair = new_word.copy()
    new_pair[1:] |= context[1:] != context[:-1]
    at_word, at_pair = np.flatnonzero(new_word), np.flatnonzero(new_pair)
    counted = times * train[doc]
    count = np.add.reduceat(counted, at_word, dtype=np.int64)
    pair = np.add.reduceat(counted, at_pair, dtype=np.int64)
    del counted
    often = word[at_word] < RARE
    count[often] = model.counts[word[at_word][often].astype(np.int64)]
    context = context[at_pair]
    context, context_of = np.unique(context, return_inverse=True)
    context_of = context_of.astype(np.int32)
    paired = (context != NO_CONTEXT)[context_of]
    log_p, p = model.log_p(count), model.p(count)
    del word, at_word
    word_of = np.cumsum(new_word, dtype=np.int32) - np.int32(1)
    pair_of = np.cumsum(new_pair, dtype=np.int32) - np.int32(1)
    del new_word, new_pair
    size = np.where(paired, pair, -1)  # -1: no context
    ukeys, doc_key = np.unique(keys, return_inverse=True)
    doc = doc_key[doc]  # as wide as bincount wants it, which would copy it each time
    add = lambda weight: np.bincount(doc, weights=weight, minlength=len(ukeys))
    # Frequent words have their own part of these sums where the text is.
    base = add(np.where(often, 0.0, model.base(count))[word_of] * times)
    known = add((~often & (count > 0))[word_of] * times)
    of_pair = np.where(size <= 0, log_p[word_of[at_pair]], np.log10(np.maximum(size, 1)) * (size > TOP))
    log_sum = add(of_pair[pair_of] * times)
    del of_pair
    if model.rest:  # a word that is not frequent is a context as often as it occurs
        log_sum -= add(np.where(often, 0.0, np.log10(count + 1))[word_of] * times)
    ones = {f"k{r}": add((size == r)[pair_of] * times) for r in range(1, TOP + 1)}
    event = (size == 0)[pair_of]
    n = len(context)
    spot = doc[event].astype(np.int64) * n + context_of[pair_of[event]]
    often_there = times[event]
    word_of = word_of[at_pair]
    # Nothing with a value for each entry is held while rows are given out.
    del add, doc, times, size, pair_of, event, at_pair
    yield _rows(_DOC, ukeys, base=base, known=known, log_sum=log_sum, **ones)
    del base, known, log_sum, ones
    place, back = np.unique(spot, return_inverse=True)
    often_there = np.bincount(back, weights=often_there, minlength=len(place))
    context = context.view(np.int64)
    del spot, back
    yield _rows(_EVENT, ukeys[place // max(n, 1)], known=often_there, k1=context[place % max(n, 1)])
    del place, often_there
    seen = paired & (pair > 0)
    h, c = context_of[seen], pair[seen]
    by_h = {f"k{r}": np.bincount(h[c == r], minlength=n) for r in range(1, TOP + 1)}
    big = np.bincount(h[c > TOP], weights=c[c > TOP], minlength=n)
    mass = np.bincount(h, weights=p[word_of[seen]], minlength=n)
    some = np.flatnonzero(np.bincount(h, minlength=n))
    yield _rows(_CONTEXT, context[some], log_sum=big[some], p_sum=mass[some], **{k: v[some] for k, v in by_h.items()})
    yield _rows(_COUNTS, np.zeros(1), **{f"k{r}": np.array([(c == r).sum()]) for r in range(1, TOP + 2)})


def _together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Sums per document of several parts as one row each."""
    key, back = np.unique(np.concatenate([b.column("key").to_numpy() for b in batches]), return_inverse=True)
    column = lambda name: np.concatenate([b.column(name).to_numpy() for b in batches])
    return _rows(_DOC, key, **{name: np.bincount(back, weights=column(name), minlength=len(key)) for name in _DOC_SUMS})


def blobs_by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blobs of one part after the other, from rows in order of their part."""
    blobs: list[bytes] = []
    at = None
    for batch in batches:
        for k, part in enumerate(batch.column(1).to_pylist()):
            if part != at and blobs:
                yield blobs
                blobs = []
            at = part
            blobs.append(batch.column(2)[k].as_py())
    if blobs:
        yield blobs


def summed_parts(model: Unigrams, parts: Iterator[list[bytes]], most: int) -> Iterator[pa.RecordBatch]:
    """`summed` of each part. A document has one row for all of them, unless there are more than `most` documents."""
    held: list[pa.RecordBatch] = []
    for blobs in parts:
        for rows in summed(model, blobs):
            if rows.num_rows and rows.column(0)[0].as_py() == _DOC:
                held.append(rows)
            else:
                yield rows
        rows = None
        # Put together when the part's arrays are gone.
        if len(held) > 1:
            held = [_together(held)]
        if held and held[0].num_rows > most:
            yield held.pop()
    yield from held


def _local(docs: DataFrame, model: Unigrams, id_type: T.DataType) -> DataFrame:
    """What each row's score owes to the frequent words alone."""
    schema = T.StructType(
        [T.StructField("id", id_type), T.StructField("key", T.LongType()), T.StructField("held_out", T.BooleanType())]
        + [T.StructField(x, T.LongType()) for x in ("n_tokens", "known")]
        + [T.StructField(x, T.DoubleType()) for x in ("base", "part")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.log10(model.context_counts() + 1)
        base, log_p = model.base(model.counts), model.log_p(model.counts)
        for batch in batches:
            for part in slices(batch, "text"):
                _, row, own, before = _codes(model, part.column("text"))
                n = part.num_rows
                often, after, near = own != NONE, before != NO_CONTEXT, before <= model.start
                add = lambda rows, w, n=n: np.bincount(rows, weights=w, minlength=n)
                score = -add(row[near], total[before[near].astype(np.int64)])
                score += add(row[often & ~after], log_p[own[often & ~after]])
                known = add(row[often], (model.counts[own[often]] > 0).astype(float)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), part.column("key"), part.column("held_out"),
                        pa.array(np.bincount(row, minlength=n)), pa.array(known), pa.array(add(row[often], base[own[often]])), pa.array(score),
                    ],
                    names=schema.names,
                )

    return arrow_map(docs.select("id", "key", "held_out", "text"), run, schema)


def _part_keys(docs: DataFrame, parts: int) -> list[int]:
    """A number for each of `parts` partitions that repartition() sends there."""
    spark = docs.sparkSession
    rows = spark.range(parts * 40).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("p")).agg(F.min("id").alias("id"))
    return sorted(r["id"] for r in rows.collect())


def score_texts(docs: DataFrame, held_out: Column, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from the rows for which `held_out` is not true and scores all. Tokens are words of whole texts (A-Z as
    a-z) and one end; a null text is empty and has the end alone. score is the log10 probability of the text
    under the model, base_score that of add-one word frequencies. Rows equal in id and text are scored once and
    counted as often as they occur; a null id is fine; other columns are not read. Without training rows every
    token is unseen and has probability 1.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(row_id).alias("id"), F.col(text).alias("text"), F.xxhash64(row_id, text).alias("key"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    ).withColumn("train", ~F.col("held_out"))
    counted = stored(count_words(rows.filter("train")), "katz-words")
    model = fit_words(counted)
    # Each document has a row of sums for each task, so there are no more parts than memory asks for, several a task.
    parts = max(1, -(-model.tokens // TOKENS_A_PART))
    tasks = max(-(-parts // PARTS_A_TASK), min(parts, TASKS))
    keys = _part_keys(docs, tasks)

    most = HELD

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in summed_parts(model, blobs_by_part(batches), most):
            for at in range(0, rows.num_rows, ROWS_A_BATCH):
                yield rows.slice(at, ROWS_A_BATCH)
        rows = None
        pa.default_memory_pool().release_unused()  # the worker waits for other tasks

    # In order of their parts and in small batches, so that a task never holds more than the blobs of one part.
    dealt = _entries(rows, model, parts, keys).repartition(tasks, "task").sortWithinPartitions("part")
    path = scratch(spark, "katz-sums")
    with small_batches(spark):
        arrow_map(dealt, reduce, _SUMS).write.parquet(path)
    sums = spark.read.schema(_SUMS).parquet(path)

    ks = [f"k{r}" for r in range(1, TOP + 1)]
    n = sums.filter(F.col("kind") == _COUNTS).agg(*[F.sum(f"k{r}") for r in range(1, TOP + 2)]).first()
    rate = discounts([0, *[x or 0 for x in n]])
    star = F.sum("log_sum")
    for k in range(1, TOP + 1):
        star = star + F.sum(f"k{k}") * (k * rate[k - 1])
    contexts = sums.filter(F.col("kind") == _CONTEXT).groupBy("key").agg(star.alias("star"), F.sum("p_sum").alias("mass"))
    frequent = spark.createDataFrame([(k, int(c)) for k, c in enumerate(model.context_counts())], "key long, count long")
    weight = F.log10((F.col("count") + 1 - F.col("star")) / F.greatest(1 - F.col("mass"), F.lit(1e-300)))
    rare = counted.select(F.col("word").bitwiseOR(F.lit(-(1 << 63))).alias("key"), "count")
    often = contexts.filter("key >= 0").join(F.broadcast(frequent), "key").select(F.col("key").alias("k1"), weight.alias("weight"))
    seldom = contexts.filter("key < 0").join(rare, "key").select(F.col("key").alias("k1"), weight.alias("weight"))

    logs = [float(np.log10(r * rate[r - 1])) for r in range(1, TOP + 1)]
    seen = F.col("log_sum")
    for k, log in zip(ks, logs, strict=True):
        seen = seen + F.col(k) * log
    of_docs = sums.filter(F.col("kind") == _DOC).select("key", "base", "known", seen.alias("part"))
    events = sums.filter(F.col("kind") == _EVENT).select("key", "known", "k1")
    # A context that is not in the training texts has no weight: after it P(w) stands.
    weighted = events.filter("k1 >= 0").join(F.broadcast(often), "k1", "left").unionByName(events.filter("k1 < 0").join(seldom, "k1", "left"))
    of_events = weighted.select(
        "key", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"), (F.col("known") * F.coalesce("weight", F.lit(0.0))).alias("part")
    )
    far = of_docs.unionByName(of_events).groupBy("key").agg(*[F.sum(c).alias(f"far_{c}") for c in ("base", "known", "part")])
    near = stored(_local(rows, model, docs.schema[row_id].dataType), "katz-local")
    copies = near.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    joined = near.join(copies, "key").join(far, "key", "left")
    share = lambda c: F.coalesce(F.col(f"far_{c}") / F.col("copies"), F.lit(0.0))
    return joined.select(
        F.col("id").alias(row_id),
        "held_out",
        "n_tokens",
        (F.col("known") + share("known").cast("long")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + share("base")).alias("base_score"),
        (F.col("part") + share("part")).alias("score"),
    )
