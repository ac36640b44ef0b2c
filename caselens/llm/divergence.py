"""Source divergence audit: how far the word shares of a language's sources lie apart, in exact whole numbers.

A group's share of a term depends only on the group and on how often the term occurs there (its level). So the
distance of two sources needs just their joint table: how many terms have level i in one and level j in the
other. In a block of terms every term is a row with a one in the column of its level in each source; that
indicator matrix transposed times itself is every joint table of the block at once. Each cell is priced by the
two shares of its columns, and the prices of a pair of sources are summed over blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.llm.common import arrow_map, ship_package, slices, small_side, stored, text_of
from caselens.llm.words import MARKS, words

SCALE = 1_000_000_000
MIN_DOCS = 10
TOP_TERMS = 10
CELLS = 20_000  # (term, source) cells of a block, about
COLUMNS = 1_024  # indicator columns of a product; wider blocks are split by rows
TILE = 256  # sources of one side of a product
DIGITS = np.arange(256)
NO_LETTER = MARKS | ((DIGITS >= 48) & (DIGITS <= 57))

COUNTS = "lang string, source string, term string, n long, docs long"
PAIRS = "lang string, a string, b string, value long"


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys next to each other (last key first) and where each run of them starts."""
    order = np.lexsort(keys)
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(new)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, summed per slice of texts only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = words(part.column("text"), between=NO_LETTER)
                if not len(found.hashes):
                    continue
                lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
                codes = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
                row = found.rows
                # Once per document and term, then once per group and term.
                order, start = _runs(found.hashes, row)
                per_doc = np.diff(np.append(start, len(order)))
                at = order[start]
                order, start = _runs(found.hashes[at], codes[row[at]])
                n = np.add.reduceat(per_doc[order], start)
                one = at[order[start]]
                size = found.ends[one] - found.starts[one]
                offsets = np.concatenate([[0], np.cumsum(size)])
                data = found.data[np.repeat(found.starts[one] - offsets[:-1], size) + np.arange(offsets[-1])]
                term = pa.LargeStringArray.from_buffers(
                    len(one), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())
                ).cast(pa.string())
                places = pa.array(row[one])
                docs_of = np.diff(np.append(start, len(order)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang").take(places), part.column("source").take(places), term, pa.array(n), pa.array(docs_of)],
                    names=["lang", "source", "term", "n", "docs"],
                )

    return arrow_map(docs, count, COUNTS)


def shares(n: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)) of each count, in Python's whole numbers."""
    return np.array([1 + SCALE * (k + 2) // (total + 2 * terms) for k in n.tolist()], dtype=np.int64)


def _indicators(levels: np.ndarray, totals: list[int], terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-hot columns of (source, level) for a block of terms, each column's share, and where sources start."""
    size = int(levels.max(initial=0)) + 1
    columns, place = np.unique(levels + np.arange(levels.shape[1]) * size, return_inverse=True)
    hot = np.zeros((len(levels), len(columns)), dtype=np.float32)
    hot[np.arange(len(levels))[:, None], place.reshape(levels.shape)] = 1
    source = columns // size
    starts = np.searchsorted(source, np.arange(levels.shape[1]))
    price = np.concatenate([shares(part, totals[k], terms) for k, part in enumerate(np.split(columns % size, starts[1:]))])
    return hot, price, starts


def joint_prices(levels: np.ndarray, totals: list[int], terms: int) -> np.ndarray:
    """Sum over the rows (terms) of levels (terms x sources) of floor((p - q)^2 / (p + q)), for every pair of sources.

    A product holds at most 2^24 rows, so its counts are exact in 32-bit floats.
    """
    n_sources = levels.shape[1]
    out = np.zeros((n_sources, n_sources), dtype=np.int64)
    if not len(levels):
        return out
    tiles = [slice(k, min(k + TILE, n_sources)) for k in range(0, n_sources, TILE)]
    sides = [_indicators(levels[:, t], totals[t], terms) for t in tiles]
    wide = max(hot.shape[1] for hot, _, _ in sides)
    if len(levels) > 1 and (wide > max(COLUMNS, 2 * TILE) or len(levels) > 1 << 14):
        half = len(levels) // 2
        return joint_prices(levels[:half], totals, terms) + joint_prices(levels[half:], totals, terms)
    for i, (hot_a, p, start_a) in enumerate(sides):
        for k, (hot_b, q, start_b) in enumerate(sides[i:], start=i):
            joint = (hot_a.T @ hot_b).astype(np.int64)
            gap = p[:, None] - q[None, :]
            joint *= gap * gap // (p[:, None] + q[None, :])
            block = np.add.reduceat(np.add.reduceat(joint, start_a, axis=0), start_b, axis=1)
            out[tiles[i], tiles[k]] = block
            out[tiles[k], tiles[i]] = block.T
    return out


def _price_block(cells: pa.Table, groups: pa.Table) -> pa.Table:
    """The block's part of the value of each pair of sources (a before b) of one language."""
    groups = groups.sort_by("source")
    names = groups.column("source").combine_chunks()
    totals, n_sources = groups.column("total").to_pylist(), groups.num_rows
    terms = groups.column("terms")[0].as_py() if n_sources else 0
    value = np.zeros((n_sources, n_sources), dtype=np.int64)
    if cells.num_rows and n_sources > 1:
        number = {s: k for k, s in enumerate(names.to_pylist())}
        source = np.array([number[s] for s in cells.column("source").to_pylist()])
        term = cells.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        n = cells.column("n").to_numpy()
        # Terms of like frequency share levels, so blocks of them need few columns.
        mass = np.bincount(term, weights=n)
        order = np.empty(len(mass), dtype=np.int64)
        order[np.argsort(mass, kind="stable")] = np.arange(len(mass))
        row = order[term]
        by_row = np.argsort(row, kind="stable")
        row, source, n = row[by_row], source[by_row], n[by_row]
        step = max(1, 2_000_000 // n_sources)
        for begin in range(0, len(mass), step):
            end = min(begin + step, len(mass))
            here = slice(*np.searchsorted(row, [begin, end]))
            levels = np.zeros((end - begin, n_sources), dtype=np.int64)
            levels[row[here] - begin, source[here]] = n[here]
            value += joint_prices(levels, totals, terms)
    a, b = np.triu_indices(n_sources, 1)
    lang = pa.array([groups.column("lang")[0].as_py()] * len(a) if n_sources else [], type=pa.string())
    return pa.table(
        [lang, names.take(pa.array(a)), names.take(pa.array(b)), pa.array(value[a, b])], names=["lang", "a", "b", "value"]
    )


def _share(n: str, total: str) -> Column:
    """The same share as `shares`, in exact decimals."""
    scaled = (F.col(n) + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (F.col(total) + 2 * F.col("terms")).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", scaled, below)


def audit(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP_TERMS
) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of a source's word shares from other sources and its language.

    Part `pair` has a row for each other source of the language (item), valued by the sum over all kept terms, with
    every rank; part `term` has the `top` kept terms that a source uses more than its language does. Null texts,
    languages and sources are read as ''. A source whose texts have no kept term still has shares and pairs; a
    language without kept terms has pairs of value 0. Repeated rows count as documents of their own. An empty table
    gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    named = docs.select(*[text_of(c).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = term_counts(named).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # All sources of a term side by side: a term has a row per source at most.
    term = Window.partitionBy("lang", "term")
    kept = counted.select(
        "lang", "source", "term", "n",
        F.sum("docs").over(term).alias("docs"),
        F.sum("n").over(term).alias("lang_n"),
        (F.min("source").over(term) == F.col("source")).alias("first"),
    ).filter(F.col("docs") >= min_docs)
    cells = stored(kept.drop("docs"), "cells")

    totals = cells.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.count_if("first").alias("terms"), F.count(F.lit(1)).alias("cells")
    )
    whole = Window.partitionBy("lang")
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "cells")]
    groups = named.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", "source", *filled)
    groups = groups.select(
        "lang", "source", "total",
        F.sum("total").over(whole).alias("lang_total"),
        F.sum("terms").over(whole).alias("terms"),
        F.greatest(F.lit(1), F.ceil(F.sum("cells").over(whole) / CELLS)).cast("int").alias("blocks"),
    )
    groups = stored(groups, "groups")

    # One row per language, and per group: broadcast only after a count.
    langs = small_side(stored(groups.select("lang", "blocks").distinct(), "langs"))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    left = cells.join(langs, "lang").select("lang", block, "term", "source", "n")
    right = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "total", "terms")
    ship_package(spark)
    priced = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(_price_block, PAIRS)
    summed = priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = summed.select("lang", "value", sides).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank")
    )

    with_totals = cells.join(small_side(groups), ["lang", "source"])
    priced_terms = with_totals.select("lang", "source", F.col("term").alias("item"), _share("n", "total").alias("p"), _share("lang_n", "lang_total").alias("q"))
    gap = F.col("p") - F.col("q")
    over = priced_terms.filter(gap > 0).select("lang", "source", "item", F.call_function("div", gap * gap, F.col("p") + F.col("q")).alias("value"))
    terms = (
        over.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= top)
        .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    )
    return pairs.unionByName(terms)
