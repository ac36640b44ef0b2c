"""Resampling and the divergence audit against plain forms; their SQL on the test tables is in test_queries.py."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from llm_fixtures import LOWER, documents, prose

from caselens.llm import divergence, resampling
from caselens.llm.words import MARKS, words

FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def test_crc_of_spans_of_every_length():
    rnd = np.random.default_rng(1)
    data = rnd.integers(0, 256, size=400_000, dtype=np.uint8)
    sizes = np.concatenate([np.arange(0, 330), [1000, 4096, 100_001]])
    ends = np.cumsum(sizes)
    got = resampling.crc32_spans(data, ends - sizes, ends)
    assert got.tolist() == [zlib.crc32(data[e - n : e].tobytes()) for n, e in zip(sizes, ends)]
    assert len(resampling.crc32_spans(data, ends[:0], ends[:0])) == 0


def features(text, longest=1):
    w = FEATURE.findall((text or "").translate(LOWER))
    return [" ".join(w[k : k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


def test_buckets_of_runs():
    texts = ["Ab, c1 Été--z", "", None, "one", "a  b\nc", "x" * 5000 + " y"]
    row, bucket = resampling.feature_buckets(words(pa.array(texts), between=MARKS), 3, 997)
    want = Counter((k, zlib.crc32(f.encode()) % 997) for k, t in enumerate(texts) for f in features(t, 3))
    assert Counter(zip(row.tolist(), bucket.tolist())) == want


def plain_resample(rows, target, longest, buckets, least, share):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, x in rows for f in features(x, longest))
    t = Counter(bucket(f) for x in target for f in features(x, longest))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in s}
    out = []
    for i, x in rows:
        f = features(x, longest)
        weight = sum(gain[bucket(g)] for g in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(features(x)) >= least))
    best = sorted((o for o in out if o[4]), key=lambda o: (-o[3], -1 if o[0] is None else o[0]))
    best = best[: share * len(best) // 100]
    ranks = defaultdict(list)
    for k, o in enumerate(best, start=1):
        ranks[o].append(k)
    return sorted(((*o[:4], ranks[o].pop(0) if ranks[o] else None) for o in out), key=repr)


def test_resampling(spark):
    rnd = random.Random(4)
    texts = [prose(rnd, rnd.randrange(0, 60), 80) for _ in range(120)] + [None, "", "  ", "ß Ä 12", "w1 " * 30_000]
    texts += [texts[0]] * 40 + [texts[5] + " more"] * 3
    ids = [*range(100, 100 + len(texts) - 45), *[7] * 43, None, None]
    target = [prose(rnd, 30, 20), None, "w1 W2 w3"]
    docs = documents(spark, texts, ids)
    bench = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(target)], "item_id int, text string, weight double")
    for longest, buckets, least, share in ((1, 10_000, 20, 10), (2, 50, 5, 60), (1, 500, 0, 100)):
        got = resampling.resample(docs, bench, longest=longest, buckets=buckets, least_words=least, share=share)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        got = sorted((tuple(r) for r in got.collect()), key=repr)
        want = plain_resample(list(zip(ids, texts)), target, longest, buckets, least, share)
        if share < 100:
            assert got == want
        else:  # equal rows may swap their ranks, no others
            assert Counter(r[:4] for r in got) == Counter(r[:4] for r in want) and {r[4] for r in got} == {r[4] for r in want}


def test_resampling_of_nothing(spark):
    none = documents(spark, [])
    assert resampling.resample(none, none).collect() == []
    few = resampling.resample(documents(spark, ["a b " * 20, None]), none, share=100).collect()
    assert sorted((r.doc_id, r.n_features, r.rank) for r in few) == [(0, 40, 1), (1, 0, None)]


def plain_audit(rows, min_docs, top):
    docs = [(a or "", b or "", TERM.findall((c or "").translate(LOWER))) for a, b, c in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        n_docs = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t in n_docs if n_docs[t] >= min_docs)
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if n_docs[t] >= min_docs) for s in {d[1] for d in mine}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in p:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in p if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, start=1)]
    return sorted(out)


def audit_rows(spark, rows, **settings):
    schema = "doc_id long, lang string, source string, text string, term string, n string, value string"
    df = spark.createDataFrame([(k, *r, "x", "y", "z") for k, r in enumerate(rows)], schema).repartition(3)
    return sorted(tuple(r) for r in divergence.audit(df, **settings).collect())


def test_audit(spark):
    rnd = random.Random(5)
    rows = []
    for k in range(260):
        source = rnd.choice(["s1", "s1", "s1", "s2", "é", None, ""])
        text = " ".join(rnd.choice(["the", "Of", "x1y", "naïve", f"w{'abcdef'[rnd.randrange(6)]}", f"{source}z"]) for _ in range(rnd.randrange(0, 40)))
        rows.append((rnd.choice(["en", "en", "de", None]), source, rnd.choice([text, text, text, None, "the " * 200])))
    rows += [("xx", "only", "some words"), ("yy", "a", None), ("yy", "b", ""), ("yy", "c", "rare"), ("zz", "a", "1 2 _ !")]
    rows += [rows[3]] * 30
    for min_docs, top in ((10, 10), (1, 3)):
        assert audit_rows(spark, rows, min_docs=min_docs, top=top) == plain_audit(rows, min_docs, top)
    assert audit_rows(spark, []) == []


def test_blocks_and_tiles_do_not_change_prices(monkeypatch):
    rnd = np.random.default_rng(6)
    levels = rnd.poisson(rnd.gamma(0.4, 8, size=(300, 1)), size=(300, 11)).astype(np.int64)
    levels[0, 0] = 10**12  # larger than a 32-bit float counts
    totals, terms = (levels.sum(axis=0) + 5).tolist(), 400
    p = np.stack([divergence.shares(levels[:, k], totals[k], terms) for k in range(11)])
    want = np.array([[int(((a - b) ** 2 // (a + b)).sum()) for b in p] for a in p])
    assert (divergence.joint_prices(levels, totals, terms) == want).all()
    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "COLUMNS", 20)
    assert (divergence.joint_prices(levels, totals, terms) == want).all()
    assert not divergence.joint_prices(levels[:0], totals, terms).any()
    assert divergence.shares(np.array([10**14]), 10**15, 10**6)[0] == 1 + 10**9 * (10**14 + 2) // (10**15 + 2 * 10**6)
