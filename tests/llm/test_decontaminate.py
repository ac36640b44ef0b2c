"""Benchmark passages: alignments against a plain table, and whole, edited and clean documents."""

import random
import re

import numpy as np
from llm_fixtures import documents, prose

from caselens.llm import decontaminate as d


def plain_score(left, right):
    best = 0
    row = [0] * (len(left) + 1)
    for y in right:
        new = [0]
        for j, x in enumerate(left, 1):
            new.append(max(0, row[j - 1] + (d.MATCH if x == y else d.MISMATCH), row[j] + d.GAP, new[-1] + d.GAP))
        row = new
        best = max(best, *row)
    return best / (d.MATCH * len(right))


def test_alignment_scores():
    rnd = random.Random(6)
    lefts = [[rnd.randrange(2, 9) for _ in range(rnd.randint(1, 40))] for _ in range(120)]
    rights = [[rnd.randrange(2, 9) for _ in range(rnd.randint(1, 15))] for _ in range(120)]
    left, right = np.zeros((120, 40), dtype=np.uint64), np.ones((120, 15), dtype=np.uint64)
    for k in range(120):
        left[k, : len(lefts[k])], right[k, : len(rights[k])] = lefts[k], rights[k]
    score, first, last = d._aligned(left, right, np.array([len(r) for r in rights]))
    for k in range(120):
        assert abs(score[k] - plain_score(lefts[k], rights[k])) < 1e-12
        if score[k] > 0:
            assert abs(plain_score(lefts[k][first[k] : last[k] + 1], rights[k]) - score[k]) < 1e-12


def bench(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, score string")


def test_passages(spark):
    rnd = random.Random(12)
    items = [prose(rnd, 30) for _ in range(8)] + [prose(rnd, 1300), "w1 w2", None, "", "..."]
    clean = [prose(rnd, 200) for _ in range(40)]
    hold = {}
    texts = list(clean)
    for k in range(9):
        for share in (0, 0.15):
            words = items[k].split(" ")
            words = [f"n{rnd.randrange(999)}" if rnd.random() < share else w for w in words]
            if share:
                del words[7]
            hold[len(texts)] = k
            texts.append(prose(rnd, 50) + ", " + " ".join(words).upper() + " " + prose(rnd, 60))
    hot = len(texts)
    texts += [prose(rnd, 10) + " " + items[2]] * 60 + [prose(rnd, 20) + " " + " ".join(items[3].split(" ")[:6]), None, "", "w1 w2 zz"]
    rows = d.find_passages(documents(spark, texts), bench(spark, enumerate(items))).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, {})[r.item_id] = r
    for i, k in hold.items():
        assert k in got[i] and got[i][k].score >= 0.5
        if (i - 40) % 2 == 0:
            assert got[i][k].score == 1.0 and got[i][k].first_word == 50
    assert all(2 in got[i] for i in range(hot, hot + 60))
    tiny = {i for i, t in enumerate(texts) if re.search(r"\bw1\W+w2\b", (t or "").lower())}
    assert set(got) == set(hold) | set(range(hot, hot + 60)) | tiny
    left = d.clean_documents(documents(spark, texts), bench(spark, enumerate(items)))
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - set(got)
    # In blocks of one item each, the result is the same.
    again = d.find_passages(documents(spark, texts), bench(spark, enumerate(items[:4])), block_bytes=1).collect()
    assert {(r.doc_id, r.item_id, r.score) for r in again} == {(r.doc_id, r.item_id, r.score) for r in rows if r.item_id < 4}


def test_hot_edited_copies_beside_a_few_verbatim_ones(spark):
    rnd = random.Random(13)
    item = prose(rnd, 40)
    edited = " ".join("zz" if k % 4 == 3 else w for k, w in enumerate(item.split(" ")))
    # 10 n-grams survive the edit, each 41 times as common as the 28 that only whole copies hold.
    texts = [prose(rnd, 20) + " " + x + " " + prose(rnd, 20) for x in [item] * 5 + [edited] * 200] + [prose(rnd, 80) for _ in range(30)]
    rows = d.find_passages(documents(spark, texts), bench(spark, [(1, item)])).collect()
    assert {r.doc_id for r in rows} == set(range(205)) and all(r.score >= 0.6 for r in rows)
    left = d.clean_documents(documents(spark, texts), bench(spark, [(1, item)]))
    assert {r.doc_id for r in left.collect()} == set(range(205, 235))


def test_windows_left_out_cannot_score():
    rnd = random.Random(14)
    items = d.prepare([prose(rnd, 20, 30) for _ in range(6)])
    text = d.words(d.pa.array([prose(rnd, 3000, 60)]), between=d.MARKS).hashes
    segment = np.array([rnd.randrange(6) for _ in range(400)])
    low = np.array([rnd.randrange(2900) for _ in range(400)])
    high = low + np.array([rnd.randint(1, 60) for _ in range(400)])
    some = d._possible(items, text, segment, low, high, 0.5)
    scores = [plain_score(text[a:b].tolist(), items.hashes[s].tolist()) for s, a, b in zip(segment, low, high)]
    assert not any(s >= 0.5 for s, ok in zip(scores, some) if not ok) and 0 < some.sum() < 400


def test_edges(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f"], [None, 3])
    for items in ([], [(1, None)], [(1, " ")]):
        assert d.find_passages(docs, bench(spark, items)).collect() == []
        assert d.clean_documents(docs, bench(spark, items)).count() == 2
    found = d.find_passages(docs, bench(spark, [(None, "b c d"), (2, "b c d"), (2, "b c d")])).collect()
    assert len(found) == 6
    assert d.find_passages(documents(spark, []), bench(spark, [(1, "a b c")])).collect() == []
