"""Near-duplicate documents by b-bit MinHash (b = 1).

A document's minima give its band keys; of each minimum only the lowest bit is kept, packed into a few 64-bit
words. Documents that share a band are candidates; the packed bits estimate their similarity, corrected for the
half of all unequal minima whose bits agree by chance; those not clearly below the threshold are confirmed on
their full shingle sets.

Groups of copies never meet pair by pair. Equal sets are one class with one representative. The classes of a band
first meet one centre each round: the class that shares bands with most others, then the one of the next component.
Confirmed links join them to components. When a round links hardly anything more, classes of different components
that share a band are compared. What keeps those few are two bounds on the size of the symmetric difference that
lose no link: the sizes, and a parity bitmap of each set, whose unequal bits are at most as many as unequal shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.llm.common import arrow_map, slices, small_side, stored
from caselens.llm.graph import components
from caselens.llm.words import mix, run_rows, runs, words

SHINGLE = 3
PERCENT = 85  # similarity from which documents are linked, in percent
MINIMA = 256
MISSED = 1e-4  # chance at most of missing a link exactly at the threshold
PACKED = MINIMA // 64
LITTLE = 20  # rounds go on while at least one in so many of the pairs confirmed in a round is a link


def band_rows(percent: int) -> int:
    """Minima a band: the most, up to 16, with which a link at the threshold is missed as seldom as MISSED."""
    share = percent / 100
    fit = [r for r in range(1, 17) if (1 - share**r) ** (MINIMA // r) <= MISSED]
    return max(fit, default=1)


def margin(percent: int) -> float:
    """Five standard deviations of the estimate at the threshold, from minima whose bits agree with chance (1 + J) / 2."""
    share = percent / 100
    return ceil(500 * ((1 - share * share) / MINIMA) ** 0.5) / 100

_RNG = np.random.default_rng(20240229)
_FLIP = _RNG.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + _RNG.integers(0, 2, MINIMA, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each row, sorted, and each row's first (one entry more than rows)."""
    found = words(column)
    rows = len(found.first) - 1
    place, row = run_rows(found.first, n)
    grams = [mix(runs(found.hashes, n)[place] + np.uint64(n))]
    owner = [row]
    each = np.diff(found.first)
    for size in range(1, n):  # shorter texts: the whole sequence is the shingle
        some = np.flatnonzero(each == size)
        if len(some):
            grams.append(mix(runs(found.hashes, size)[found.first[some]] + np.uint64(size)))
            owner.append(some)
    gram, owner = np.concatenate(grams), np.concatenate(owner)
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    lead = np.ones(len(gram), dtype=bool)
    lead[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    gram, owner = gram[lead], owner[lead]
    return gram, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])


def signatures(sets: np.ndarray, first: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits (PACKED a row) and band keys of `rows` minima each (MINIMA // rows a row) of non-empty sets."""
    bands = MINIMA // rows
    starts = first[:-1]
    minima = np.empty((len(starts), MINIMA), dtype=np.uint64)
    work = np.empty(len(sets), dtype=np.uint64)
    for k in range(MINIMA):
        np.bitwise_xor(sets, _FLIP[k], out=work)
        np.multiply(work, _ODD[k], out=work)
        minima[:, k] = np.minimum.reduceat(work, starts)
    packed = np.packbits((minima & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
    keys = np.zeros((len(starts), bands), dtype=np.uint64)
    for k in range(rows):
        keys = mix(keys * np.uint64(3) + minima[:, k : bands * rows : rows] + np.arange(bands, dtype=np.uint64))
    return packed, keys.view(np.int64)


_BITS = [f"s{k}" for k in range(PACKED)]


def _sketches(docs: DataFrame, row_id: str, text: str, shingle: int, rows: int) -> DataFrame:
    """row_id, row (hash of id and text), n_shingles, a 128-bit hash of the set (h1, h2), packed bits and band keys of every row."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("row", T.LongType())])
    for name in ("n_shingles", "h1", "h2", *_BITS):
        schema = schema.add(name, T.LongType())
    schema = schema.add("bands", T.ArrayType(T.LongType()))
    bands = MINIMA // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 1_000_000):
                sets, first = shingle_sets(part.column(text), shingle)
                n = np.diff(first)
                full = np.flatnonzero(n)
                h = np.zeros((2, len(n)), dtype=np.uint64)
                packed = np.zeros((len(n), PACKED), dtype=np.int64)
                keys = np.zeros((len(n), bands), dtype=np.int64)
                if len(full):
                    starts = np.append(first[:-1][full], len(sets))
                    for k in range(2):
                        h[k, full] = np.add.reduceat(mix(sets ^ _FLIP[k]), starts[:-1])
                    packed[full], keys[full] = signatures(sets, starts, rows)
                offsets = np.arange(0, (len(n) + 1) * bands, bands, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array(n),
                        *[pa.array(x.view(np.int64)) for x in h],
                        *[pa.array(packed[:, k]) for k in range(PACKED)],
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1))),
                    ],
                    names=schema.names,
                )

    return arrow_map(docs.select(F.col(row_id).cast("bigint"), text, F.xxhash64(row_id, text).alias("row")), run, schema)


def parities(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of each set as 64-bit words, and each one's first word (one entry more than sets).

    Every shingle flips one bit of a width that is a power of two and at least twice the set's size. So two bitmaps
    of equal width differ in at most as many bits as shingles are in one set only, and a bitmap's halves laid over
    each other are the bitmap of half the width.
    """
    sizes = np.diff(first)
    wide = 64 << np.ceil(np.log2(np.maximum(sizes / 32, 1))).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(wide)])
    place = (sets >> np.uint64(20)).astype(np.int64) & np.repeat(wide - 1, sizes)
    flips = np.bincount(place + np.repeat(begin[:-1], sizes), minlength=begin[-1]) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64), begin // 64


def _sets(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """The full shingle sets of (id, text): id, sorted hashes and parity bitmap."""
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("shingles", longs), T.StructField("parity", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                sets, first = shingle_sets(part.column(text), shingle)
                bitmaps, begin = parities(sets, first)
                lists = [
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))
                    for at, values in ((first, sets.view(np.int64)), (begin, bitmaps))
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=schema.names)

    return arrow_map(docs.select("id", text), run, schema)


def _unequal(a: str, b: str) -> Column:
    """How many bits differ in two bitmaps, the wider folded once; 0 where that does not make them equally wide."""
    apart = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), add)
    half = lambda c, n: F.zip_with(F.slice(c, 1, n), F.slice(c, n + 1, n), lambda p, q: p.bitwiseXOR(q))
    x, y = F.col(a), F.col(b)
    return (
        F.when(F.size(x) == F.size(y), apart(x, y))
        .when(F.size(x) == 2 * F.size(y), apart(half(x, F.size(y)), y))
        .when(F.size(y) == 2 * F.size(x), apart(half(y, F.size(x)), x))
        .otherwise(0)
    )


def _likely(percent: int) -> Column:
    """Whether sizes, packed bits and parity bitmaps of sides a and b allow a link."""
    unequal = reduce(add, [F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}"))) for s in _BITS])
    estimate = 1 - 2 * unequal / F.lit(float(MINIMA))
    small, big = F.least("a.n_shingles", "b.n_shingles"), F.greatest("a.n_shingles", "b.n_shingles")
    either = F.col("a.n_shingles") + F.col("b.n_shingles")
    return (
        (100 * small >= percent * big)
        & (estimate >= percent / 100 - margin(percent))
        & ((100 + percent) * _unequal("a.parity", "b.parity") <= (100 - percent) * either)
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The stored pairs (a, b) whose full sets are similar enough. Only sets of paired documents are moved."""
    few = small_side(pairs)
    left = sets.join(few, F.col("id") == F.col("a")).select("a", "b", F.col("shingles").alias("x"))
    right = sets.join(few, F.col("id") == F.col("b")).select("a", "b", F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    both = left.join(right, ["a", "b"])
    return both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def _placed(members: DataFrame, wanted: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Members (band, id) with their number of neighbours and their component so far."""
    if parts is None:
        labels = wanted.withColumn("component", F.col("id"))
    else:
        labels = wanted.join(parts, "id", "left").select("id", "near", F.coalesce("component", "id").alias("component"))
    return members.join(labels, "id").select("band", "id", "near", "component")


def _links(members: DataFrame, wanted: DataFrame, sketched: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, component) of every class linked to another that shares a band."""
    links = parts = None
    turn = 0
    while True:
        # A star in each band: its component of rank `turn` by neighbours, through the class that has most of them.
        placed = _placed(members, wanted, parts)
        tops = placed.groupBy("band", "component").agg(F.max(F.struct("near", "id")).alias("top"))
        order = Window.partitionBy("band").orderBy(F.desc("top"))
        ranked = tops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= turn + 1)
        centre = ranked.filter(F.col("rank") == turn + 1).select("band", F.col("top.id").alias("centre"), F.col("component").alias("its"))
        ends = placed.join(small_side(stored(centre, "centres")), "band").filter("component <> its")
        pairs = ends.select(F.least("id", "centre").alias("x"), F.greatest("id", "centre").alias("y")).distinct()
        both = pairs.join(sketched.alias("a"), F.col("x") == F.col("a.id")).join(sketched.alias("b"), F.col("y") == F.col("b.id"))
        pairs = stored(both.filter(_likely(percent)).select(F.col("x").alias("a"), F.col("y").alias("b")), "star-pairs")
        found = stored(_confirmed(pairs, sets, percent), "star-links")
        links = found if links is None else links.unionByName(found)
        parts = components(links, "parts")
        turn += 1
        if LITTLE * found.count() <= pairs.count():
            break

    # Whatever could still join two components.
    placed = _placed(members, wanted, parts)
    mixed = placed.groupBy("band").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 < c2")
    open_rows = placed.join(small_side(stored(mixed.select("band"), "mixed")), "band", "left_semi").join(sketched, "id")
    open_rows = stored(open_rows, "open-rows")
    across = (
        open_rows.alias("a")
        .join(open_rows.alias("b"), (F.col("a.band") == F.col("b.band")) & (F.col("a.component") < F.col("b.component")) & _likely(percent))
        .select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))
        .distinct()
    )
    more = _confirmed(stored(across, "cross-pairs"), sets, percent)
    return components(links.unionByName(more), "components")


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, row_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """row_id, n_shingles, component_id (smallest id reachable over links, itself included) and kept, per row.

    `row` is a 64-bit hash of id and text, by which a result row can be joined to its input row.

    Documents are linked when the Jaccard similarity of their sets of distinct shingles of `shingle` words (A-Z as a-z; a
    shorter text is one shingle) is at least `percent`. Null, empty and blank texts have no shingle and are
    linked with nothing. Ids are integers. Rows with a null id are linked with nothing, have no component and are kept. Rows equal in
    id and text count as one document and get equal results; an id that repeats with other texts has a result for
    each. Other columns are not read. Shingles are compared by 64-bit hashes; a link at the threshold is missed with a chance of at most 1e-4 (4e-5 at 85%).
    """
    sketch = stored(_sketches(docs, row_id, text, shingle, band_rows(percent)), "sketches")
    light = sketch.select("id", "row", "n_shingles", "h1", "h2")
    some = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    linked = light.filter(some)

    # One row per set: its rows have the same sketch. A class is named by the smallest `row` in it.
    same = [F.first(c).alias(c) for c in ("n_shingles", *_BITS, "bands")]
    classes = sketch.filter(some).groupBy("h1", "h2").agg(F.min("row").alias("rep"), F.min("id").alias("least"), *same)
    classes = stored(classes, "classes")

    # Bands that hold more than one class, their members, and the full sets of those.
    rows = classes.select(F.col("rep").alias("id"), F.explode("bands").alias("band"))
    shared = stored(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "bands")
    members = stored(rows.join(small_side(shared), "band"), "band-members")
    wanted = stored(members.groupBy("id").agg(F.sum(F.col("n") - 1).alias("near")), "wanted")
    few = small_side(wanted.select("id"))
    texts = docs.select(F.xxhash64(F.col(row_id), F.col(text)).alias("id"), text).join(few, "id", "left_semi")
    sets = stored(_sets(texts.dropDuplicates(["id"]), text, shingle), "shingles")
    bits = classes.select(F.col("rep").alias("id"), "n_shingles", *_BITS).join(few, "id", "left_semi")
    sketched = stored(bits.join(sets.select("id", "parity"), "id"), "wanted-sketches")
    final = _links(members.select("band", "id"), wanted, sketched, sets, percent)

    # The smallest id of a component, from its classes.
    named = classes.select(F.col("rep").alias("id"), "h1", "h2", "least").join(final, "id", "left")
    least = named.filter("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("first"))
    named = named.join(least, "component", "left").select("h1", "h2", F.coalesce("first", "least").alias("component_id"))
    joined = linked.join(named, ["h1", "h2"]).select("id", "row", "n_shingles", "component_id")
    alone = light.filter((F.col("n_shingles") == 0) | F.col("id").isNull()).select(
        "id", "row", "n_shingles", F.col("id").alias("component_id")
    )
    return joined.unionByName(alone).select(
        F.col("id").alias(row_id),
        "row",
        "n_shingles",
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def one_of_each(
    docs: DataFrame, percent: int = PERCENT, row_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """The rows, with all their columns, whose document is the first of its component."""
    later = near_duplicates(docs, percent, row_id, text, shingle).filter(~F.col("kept")).select(F.col("row").alias("_row")).distinct()
    keyed = docs.withColumn("_row", F.xxhash64(row_id, text))
    return keyed.join(small_side(stored(later, "later-copies")), "_row", "left_anti").select(*docs.columns)
