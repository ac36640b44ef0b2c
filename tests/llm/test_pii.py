"""Spans by pattern against Python's re, and what contexts discover."""

import random
import re

from llm_fixtures import documents
from pyspark.sql import functions as F

from caselens.llm import pii


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    out = []
    for n, (kind, pattern) in enumerate(pii.PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), n, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


PARTS = [
    *"ab.@+- ()0123456789\n1é", "a@b.c", "x_y%z@h.io.", "+1 (988) 555-2485", "4111111111111111", "4111 1111-1111 1111",
    "1.2.3.4", "255.255.256.1", "000255.1.1.1", "😀", "'",
]


def test_base_spans(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    texts += [None, "", "1 2" * 20_000, "a.b" * 20_000 + "@x.y", "1.1." * 10_000, "+1" + "(" * 20_000, "9" * 50_000, "a@b.c " * 1000]
    texts += texts[:5]
    rows = pii.find_personal_data(documents(spark, texts)).select("doc_id", pii.written(F.col("base")).alias("b"), pii.written(F.col("spans")).alias("s"))
    rows = rows.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.b == base(texts[r.doc_id]), texts[r.doc_id][:200]
        own = [x for x in r.s.split(",") if not x.startswith("id:")]
        assert ",".join(own) == r.b
        assert [int(x.split(":")[1]) for x in r.s.split(",") if x] == sorted(int(x.split(":")[1]) for x in r.s.split(",") if x)


def test_contexts_discover(spark):
    texts = [f"please mail user{k}@host.org now" for k in range(8)] + [f"his number is 415{k}26535 in all" for k in range(8)]
    texts += ["please mail k77-secret-01 now", "version 2.0.1-beta of it", "k77-secret-01"]
    found = {r.doc_id: r.spans for r in pii.find_personal_data(documents(spark, texts)).collect()}
    assert [(s.kind, s.start, s.end) for s in found[16]] == [("id", 12, 25)]
    assert found[17] == found[18] == []  # a cue without seeds, and no cue


def test_edges(spark):
    assert pii.find_personal_data(documents(spark, [])).collect() == []
    rows = pii.find_personal_data(documents(spark, ["a@b.c", "a@b.c", "1.2.3.4"], [None, None, 5])).collect()
    assert sorted((r.doc_id or 0, len(r.spans)) for r in rows) == [(0, 1), (0, 1), (5, 1)]
