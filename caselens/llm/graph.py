"""Connected components of an edge table, by alternating large and small stars until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import stored


def _print(edges: DataFrame) -> tuple:
    """Count and order-free hash of an edge table."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Edges point from the larger end `a` to the smaller `b`.

    Large star: every node hands its larger neighbours to its smallest neighbour (or itself). Small star: every
    node hands itself and its smaller neighbours to the smallest of them.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, component) for every id in the edge table (columns a, b); component is the smallest id reachable.

    Self-loops, repeated edges and either direction are fine; edges with a null end are left out. Each round is
    written to the shared folder, so lineage does not grow. Steps group and join by node with map-side sums, and
    no component is ever gathered in one task: joins on a node with very many edges are left to adaptive
    skew handling.
    """
    ends = (F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    ok = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))
    now = stored(edges.filter(ok).select(*ends).distinct(), name)
    mark = _print(now)
    while mark[0]:
        now = stored(_star(_star(now, large=True), large=False), name)
        before, mark = mark, _print(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
