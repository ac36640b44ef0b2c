"""Small tables with the awkward cases, and plain forms of what the operators compute."""

from __future__ import annotations

import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names the operators use themselves.
        T.StructField("kept", T.StringType()),
        T.StructField("component_id", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("dropped", T.StringType()),
        T.StructField("n_words", T.StringType()),
    ]
)


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [
        (i, t, None if k % 3 else "en", "src0", None if t is None else len(t), *["x"] * 6)
        for k, (i, t) in enumerate(zip(ids, texts, strict=True))
    ]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def shingles(text, n=3):
    w = words(text, lower=True)
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1))


def classes(nodes, links):
    """The smallest node reachable from each node."""
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def prose(rnd, n, words_in_use=400):
    return " ".join(f"w{rnd.randrange(words_in_use)}" for _ in range(n))
