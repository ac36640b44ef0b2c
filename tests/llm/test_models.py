"""Toxicity on held-out labels and swapped identity terms; Katz scores against a plain model."""

import math
import os
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import documents, prose, words
from pyspark.sql import functions as F

from caselens.llm import katz, toxicity

DATA = os.environ.get("CASELENS_TEST_TABLES", "/root/testdata/sf0.01")


def test_toxicity_and_identity_terms(spark):
    rnd = random.Random(3)
    texts, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        body = prose(rnd, 40)
        # The group is named mostly in toxic texts: the words alone would look guilty.
        if bad:
            body += " vileword" + ("x" if k % 8 else "y") + (" muslims" if k % 12 else "")
        elif k % 30 == 1:
            body += " muslims"
        texts.append(body)
        labels.append((k, int(bad)))
    docs = documents(spark, texts)
    table = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, toxic int, text string")
    probes = pa.array([prose(rnd, 40) + " muslims", prose(rnd, 40) + " christians", prose(rnd, 40) + " vilewordz", "", None])
    fair, biased = (toxicity.fit(docs, table, fairness=f).score(probes) for f in (10.0, 0.0))
    assert fair[2] > 0.7 and fair[0] < 0.5 and fair[3] == fair[4] < 0.5
    assert abs(fair[0] - fair[1]) < abs(biased[0] - biased[1])


def test_swaps():
    assert toxicity.swapped_text("Black cats, Muslim men.") == "white cats christian women"
    assert toxicity.swapped_text("nothing here") is None


def test_toxicity_edges(spark):
    docs = documents(spark, ["a b", None, "", "a b"], [1, 2, None, 1])
    labels = "doc_id long, toxic int"
    for rows, want in (([], 0.5), ([(1, 0)], 0.0), ([(1, None), (None, 1), (77, 1)], 0.5)):
        model = toxicity.fit(docs, spark.createDataFrame(rows, labels))
        got = toxicity.score_documents(docs, model).collect()
        assert len(got) == 4 and all(abs(r.score - want) < 1e-6 for r in got)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")
def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    rows = toxicity.score_documents(docs, toxicity.fit(docs, labels, ~held)).join(labels, "doc_id").filter(held).collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.85
    assert np.mean([g < toxicity.THRESHOLD for g in good]) > 0.95


def plain_katz(texts, held, ids):
    toks = [words(t, lower=True) + ["</s>"] for t in texts]
    uni, bi = Counter(), Counter()
    for i, t in zip(ids, toks, strict=True):
        if not held(i):
            uni.update(t)
            bi.update(zip(["<s>", *t], t))
    n, texts_in = sum(uni.values()), sum(not held(i) for i in ids)
    context = {w for w in uni if uni[w] * katz.SHARE >= n and w != "</s>"} | {"<s>"}
    bi = Counter({k: v for k, v in bi.items() if k[0] in context})
    counts = lambda c: [0, *(sum(v == r for v in c.values()) for r in range(1, katz.TOP + 2))]
    d1, d2 = katz.discounts(counts(uni)), katz.discounts(counts(bi))
    star = lambda d, c: c * (d[c - 1] if c <= katz.TOP else 1)
    p = {w: star(d1, c) / (n + 1) for w, c in uni.items()}
    left = 1 - sum(p.values())
    of = {**uni, "<s>": texts_in}
    free, mass = Counter(), Counter()
    for (h, w), c in bi.items():
        free[h] += star(d2, c)
        mass[h] += p[w]

    def prob(h, w):
        if h not in context:
            return p.get(w, left)
        if (h, w) in bi:
            return star(d2, bi[h, w]) / (of[h] + 1)
        return (of[h] + 1 - free[h]) / (of[h] + 1) / (1 - mass[h]) * p.get(w, left)

    for h in ["<s>", *list(uni)[:20]]:  # sums to one over the words and the unseen
        assert abs(sum(prob(h, w) for w in uni) + prob(h, "\0") - 1) < 1e-9
    for t in toks:
        yield (
            len(t), sum(w in uni for w in t), n, sum(math.log10((uni[w] + 1) / (n + len(uni) + 1)) for w in t),
            sum(math.log10(prob(h, w)) for h, w in zip(["<s>", *t], t)),
        )


@pytest.mark.parametrize("share", [65_536, 40])
def test_katz(spark, monkeypatch, share):
    monkeypatch.setattr(katz, "SHARE", share)
    rnd = random.Random(2)
    texts = [prose(rnd, rnd.randint(0, 60), 90) + " End" for _ in range(150)] + [None, "", "A a", prose(rnd, 4000, 3000)]
    texts += [texts[0], texts[0]]
    ids = [*range(len(texts) - 2), 0, None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    column = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    rows = katz.score_texts(documents(spark, texts, ids), column).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows)
    want = sorted((i if i is not None else -1, *x) for i, x in zip(ids, plain_katz(texts, held, ids), strict=True))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9) and g[5] == pytest.approx(w[5], rel=1e-9)


def test_katz_pairs_after_rare_words(spark, monkeypatch):
    rnd = random.Random(5)
    texts = [prose(rnd, 30_000, 20_000) for _ in range(4)] + [prose(rnd, rnd.randint(0, 80), 30_000) for _ in range(40)]
    held = lambda i: i % 5 == 4
    rows = katz.score_texts(documents(spark, texts), F.col("doc_id") % 5 == 4).collect()
    monkeypatch.setattr(katz, "SHARE", math.inf)  # every word is a context in the plain model
    for r, w in zip(sorted(rows, key=lambda r: r.doc_id), plain_katz(texts, held, range(len(texts))), strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3] and w[2] > 65_536
        assert r.base_score == pytest.approx(w[3], rel=1e-9) and r.score == pytest.approx(w[4], rel=1e-9)


def test_katz_edges(spark):
    assert katz.score_texts(documents(spark, []), F.lit(False)).collect() == []
    rows = katz.score_texts(documents(spark, ["a b", None]), F.lit(True)).collect()
    assert all(r.train_tokens == r.n_known == 0 and r.score == r.base_score == 0 for r in rows)


def test_discounts():
    assert katz.discounts([0, 100, 40, 20, 12, 8, 5])[0] == pytest.approx((0.8 - 0.3) / 0.7)
    assert katz.discounts([0, 1, 0, 0, 0, 0, 0]) == [0.5, 0.75, 5 / 6, 0.875, 0.9]
    assert all(0 < x <= 1 for x in katz.discounts([0, 60, 33, 8, 19, 3, 9]))


@pytest.mark.parametrize("most", [1_000_000, 20])
def test_katz_has_a_row_for_each_document_and_task(spark, monkeypatch, tmp_path, most):
    rnd = random.Random(12)
    texts = [prose(rnd, rnd.randrange(30, 80), 300) for _ in range(60)]
    held = lambda i: i % 5 == 4
    for name, value in {"TOKENS_A_PART": 200, "TASKS": 2, "PARTS_A_TASK": 100, "HELD": most}.items():
        monkeypatch.setattr(katz, name, value, raising=False)
    monkeypatch.setattr(katz, "scratch", lambda spark, name: f"file://{tmp_path}/{name}")
    rows = katz.score_texts(documents(spark, texts), F.col("doc_id") % 5 == 4).collect()
    for r, w in zip(sorted(rows, key=lambda r: r.doc_id), plain_katz(texts, held, range(len(texts))), strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert r.base_score == pytest.approx(w[3], rel=1e-9) and r.score == pytest.approx(w[4], rel=1e-9)
    sums = spark.read.parquet(f"file://{tmp_path}/katz-sums").filter(F.col("kind") == katz._DOC).count()
    assert sums <= 2 * len(texts) if most > 20 else sums > 2 * len(texts)


def test_katz_lets_go_of_entries_before_rows_are_given_out():
    rnd = np.random.default_rng(4)
    n, docs = 200_000, 500
    blobs = []
    for _ in range(4):
        word = np.sort(rnd.integers(0, 1 << 60, n // 16, dtype=np.uint64)[rnd.integers(0, n // 16, n)] | katz.RARE)
        context, doc = rnd.integers(0, 100, n, dtype=np.uint64), rnd.integers(0, docs, n)
        blobs.append(katz.write_blob(np.arange(docs), np.ones(docs, dtype=bool), word, context, doc, np.ones(n, dtype=np.int64)))
    assert katz.read_blob(blobs[0])[1].base is None  # a view would hold the whole blob
    frequent = np.arange(1, 101, dtype=np.uint64)
    model = katz.Unigrams(
        4 * n, n, [0.5] * katz.TOP, 0.1, docs, frequent, np.full(100, 9), np.full(100, True), True
    )
    tracemalloc.start()
    try:
        rows = katz.summed(model, blobs)
        assert next(rows).num_rows == docs
        assert tracemalloc.get_traced_memory()[0] < 40 * 4 * n
        assert tracemalloc.get_traced_memory()[1] < 80 * 4 * n
        assert sum(r.num_rows for r in rows) > 0
    finally:
        tracemalloc.stop()


def test_katz_takes_one_part_after_the_other(monkeypatch):
    batch = lambda parts: pa.table({"task": [0] * len(parts), "part": parts, "blob": [b"%d" % p for p in parts]}).to_batches()[0]
    assert list(katz.blobs_by_part(iter([batch([0, 0, 3]), batch([3, 4]), batch([4])]))) == [[b"0"] * 2, [b"3"] * 2, [b"4"] * 2]
    assert list(katz.blobs_by_part(iter([]))) == []
    left = []

    def batches():
        for p in (0, 1, 2):
            left.append(p)
            yield batch([p])

    monkeypatch.setattr(katz, "summed", lambda model, blobs: iter([katz._rows(katz._EVENT, np.array([1, 2]))]))
    assert next(katz.summed_parts(None, katz.blobs_by_part(batches()), 9)).num_rows == 2
    assert left == [0, 1]  # the last part is not read yet
