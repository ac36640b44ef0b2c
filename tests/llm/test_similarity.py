"""Near duplicates, fuzzy lines and components against brute force."""

import random

from llm_fixtures import classes, documents, prose, shingles

from caselens.llm import fuzzy_lines, graph, minhash


def edited(rnd, text, share):
    return " ".join(f"e{rnd.randrange(10**6)}" if rnd.random() < share else w for w in text.split(" "))


def test_components(spark):
    rnd = random.Random(4)
    links = [(k, k + 1) for k in range(0, 60)] + [(200, x) for x in range(201, 260)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)]
    rows = [*links, (7, 7), (None, 3), (2, 1), (2, 1)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(rows, "a long, b long"), "test").collect()}
    nodes = {x for pair in links for x in pair if pair[0] != pair[1]}
    want = classes(nodes, [p for p in links if p[0] != p[1]])
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long"), "test").collect() == []


def test_near_duplicates(spark):
    rnd = random.Random(8)
    seeds = [prose(rnd, 120) for _ in range(12)]
    texts = seeds + [edited(rnd, s, 0.02) for s in seeds for _ in range(5)] + [edited(rnd, seeds[0], 0.05) for _ in range(60)]
    texts += seeds[:3] + [seeds[0]] * 40 + [seeds[4].upper(), "a b", "A  b", "a", None, "", " \n", prose(rnd, 9000)]
    docs = documents(spark, texts)
    rows = minhash.near_duplicates(docs).collect()
    sets = [shingles(t) for t in texts]
    links = [
        (i, j)
        for i in range(len(texts))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    ]
    want = classes(range(len(texts)), links)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {
        i: (len(sets[i]), want[i], want[i] == i) for i in range(len(texts))
    }
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in want if want[i] == i}


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(documents(spark, [])).collect() == []
    rows = minhash.near_duplicates(documents(spark, ["a b c d", "a b c d", "a b c d", "x y z"], [None, 5, 5, 6])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (5, 5, True), (5, 5, True), (6, 6, True)]


def test_an_id_with_two_texts_has_a_result_for_each(spark):
    rnd = random.Random(3)
    one, two = prose(rnd, 200, 5000), prose(rnd, 200, 5000)
    docs = documents(spark, [one, two, one + " x", two + " y", two + " z"], [5, 5, 6, 7, 9])
    rows = minhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows) == [(5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (9, 5, False)]


def test_a_large_group_around_the_threshold(spark):
    """Copies of three texts with few and many words left out, some linked only through others, beside brute force."""
    rnd = random.Random(12)
    texts = []
    for _ in range(3):
        words = [f"w{rnd.randrange(300)}" for _ in range(140)]
        for _ in range(150):
            share = rnd.uniform(0.005, 0.09)
            texts.append(" ".join(w for w in words if rnd.random() >= share))
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = classes(range(len(sets)), links)
    assert 20 < len(set(want.values())) < 400
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert got == want


def test_parity_bitmaps_bound_the_unequal_shingles(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    sets = []
    for n in (1, 31, 32, 33, 40, 400, 1000, 1100, 5000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base[: n - n // 9], rng.integers(0, 1 << 63, n // 7, dtype=np.uint64)]))]
    bitmaps, begin = minhash.parities(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))
    rows = [(k, bitmaps[begin[k] : begin[k + 1]].tolist()) for k in range(len(sets))]
    assert all(64 * len(w) >= 2 * len(s) and len(w) & (len(w) - 1) == 0 for s, (_, w) in zip(sets, rows, strict=True))
    df = spark.createDataFrame(rows, "k int, parity array<long>")
    both = df.alias("a").join(df.alias("b"), F.col("a.k") <= F.col("b.k"))
    found = both.select(F.col("a.k").alias("i"), F.col("b.k").alias("j"), minhash._unequal("a.parity", "b.parity").alias("n")).collect()
    tight = 0
    for r in found:
        apart = len(np.setxor1d(sets[r.i], sets[r.j]))
        assert r.n <= apart and (r.i != r.j or r.n == 0)
        if r.i // 2 == r.j // 2 and r.i != r.j and len(sets[r.i]) >= 400:  # in small sets chance may cancel more
            tight += 1
            assert r.n >= 0.7 * apart
    assert tight == 4


def test_pipeline_stage_links_on_five_words_and_80_percent(spark):
    import corpus_pipeline

    rnd = random.Random(21)
    text = prose(rnd, 200, 5000)
    added = text + " " + prose(rnd, 44, 5000)
    other = prose(rnd, 200, 5000)
    words = other.split(" ")
    # Scattered edits: 3-word shingles over 85% alike, 5-word ones below 80%.
    scattered = " ".join("zz" if k in (30, 60, 90, 120, 150) else w for k, w in enumerate(words))
    alike = lambda a, b, n: len(shingles(a, n) & shingles(b, n)) / len(shingles(a, n) | shingles(b, n))
    assert 0.8 <= alike(text, added, 5) < 0.85 and alike(text, added, 3) < 0.85
    assert alike(other, scattered, 3) >= 0.85 and alike(other, scattered, 5) < 0.8
    kept = corpus_pipeline.near_duplicate_stage(spark, documents(spark, [text, added, other, scattered]), "")
    assert {r.doc_id for r in kept.collect()} == {0, 2, 3}


def test_bands_follow_the_threshold():
    for percent in (70, 75, 80, 85, 90):
        rows = minhash.band_rows(percent)
        assert (1 - (percent / 100) ** rows) ** (minhash.MINIMA // rows) <= 1e-4
    assert minhash.band_rows(85) == 8 and minhash.band_rows(80) == 6 and minhash.margin(85) == 0.17


def norm(line):
    return line.lower().strip(" \t\n\x0b\f\r") if any(c.isalnum() for c in line) else ""


def simhash(text):
    import xxhash

    ws = [w for w in text.split(" ") if w]
    hs = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in ws]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(ws))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_fuzzy_lines(spark):
    rnd = random.Random(9)
    common = [prose(rnd, 30) for _ in range(6)]
    long = prose(rnd, 400)
    texts = []
    for k in range(70):
        lines = [rnd.choice(common), edited(rnd, rnd.choice(common), 0.04), prose(rnd, 12), "", "--- ***", f"Page {k}"]
        rnd.shuffle(lines)
        texts.append("\n".join(lines))
    texts += [long, edited(rnd, long, 0.01), long + "!", None, "", "\n\n", common[0].upper(), "Tiny\ntiny\nTINY."]
    docs = documents(spark, texts)
    rows = fuzzy_lines.dedupe_lines(docs).collect()
    found = {}
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            if norm(line):
                found.setdefault(norm(line), []).append((i, k))
    keys = sorted(found)
    sims = {n: simhash(n) for n in keys}
    links = [
        (a, b)
        for x, a in enumerate(keys)
        for b in keys[:x]
        if (sims[a] ^ sims[b]).bit_count() <= fuzzy_lines.DISTANCE and edits(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9)
    ]
    assert links
    group = classes(keys, links)
    places = {}
    for n in keys:
        places.setdefault(group[n], []).extend(found[n])
    gone = {p for g in places.values() for p in sorted(g)[1:]}
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (r.doc_id, k) not in gone)
        assert r.text == want and r.lang in (None, "en") and r.score == "x"
        assert list(r.dropped) == sorted(k for i, k in gone if i == r.doc_id)
        assert r.n_lines == (0 if t is None else len(t.split("\n")))


def test_lines_three_bits_apart_are_linked(spark):
    rnd = random.Random(31)
    texts = []
    while len(texts) < 12:
        line = prose(rnd, 60, 100_000)
        near = edited(rnd, line, 0.03)
        if (simhash(line) ^ simhash(near)).bit_count() == 3 and 5 * edits(line, near) <= max(len(line), len(near)):
            texts += [line, near]
    rows = fuzzy_lines.dedupe_lines(documents(spark, texts)).collect()
    assert {r.doc_id for r in rows if r.dropped} == set(range(1, 12, 2))


def test_fuzzy_lines_edges(spark):
    assert fuzzy_lines.dedupe_lines(documents(spark, [])).collect() == []
    rows = fuzzy_lines.dedupe_lines(documents(spark, ["a line\nb", "a line\nb", "a line\nc", "a line"], [4, 4, None, 9])).collect()
    got = sorted((r.doc_id or 0, r.text) for r in rows)
    assert got == [(0, "a line\nc"), (4, "b"), (4, "b"), (9, "")]
    left = fuzzy_lines.distinct_lines(documents(spark, ["a line\nb", "a line", "!!", None]))
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(0, "a line\nb"), (2, "!!"), (3, None)]


def test_block_keys_hold_the_pigeonhole(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), 3):
            b ^= 1 << bit
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a long, b long")
    from pyspark.sql import functions as F

    for pick in (1, 2):
        ka, kb = (fuzzy_lines.block_keys(F.col(c), 3, pick) for c in "ab")
        assert df.filter(F.size(F.array_intersect(ka, kb)) == 0).count() == 0


def test_rows_of_tables_with_one_simhash(spark, monkeypatch):
    rnd = random.Random(5)
    lines = []
    for k in range(120):
        cells = [prose(rnd, 1, 5000) for _ in range(rnd.randrange(4, 12))]
        lines.append(" | ".join(cells) + " |")
        if k % 6 == 0:
            lines.append(" | ".join([*cells[:-1], cells[-1] + "x"]) + " |")
    rnd.shuffle(lines)
    assert len({simhash(norm(x)) for x in lines}) < len(lines) / 4
    sizes = []
    stored = fuzzy_lines.stored
    monkeypatch.setattr(fuzzy_lines, "stored", lambda df, name: sizes.append(stored(df, name).count()) or stored(df, name))
    rows = fuzzy_lines.dedupe_lines(documents(spark, lines)).collect()
    keys = sorted({norm(x) for x in lines})
    sims = {n: simhash(n) for n in keys}
    links = [
        (a, b)
        for x, a in enumerate(keys)
        for b in keys[:x]
        if (sims[a] ^ sims[b]).bit_count() <= fuzzy_lines.DISTANCE and edits(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9)
    ]
    group = classes(keys, links)
    first = {}
    for i, x in enumerate(lines):
        first.setdefault(group[norm(x)], i)
    assert {r.doc_id for r in rows if not r.dropped} == set(first.values())
    assert max(sizes) <= 2 * len(lines)  # a row per class, not one for each bucket or pair


def test_letter_counts_reject_no_like_lines(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(8)
    pairs = []
    for _ in range(300):
        a = prose(rnd, rnd.randrange(1, 30), 500) + rnd.choice(["", " é | 7", " " + "e" * 300])
        b = list(a)
        for _ in range(int(len(a) * 0.2 * rnd.random())):
            at = rnd.randrange(len(b))
            b[at : at + rnd.randrange(2)] = rnd.choice(["", "z", "|", "é", "e"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "x string, y string")
    side = lambda c: F.struct(F.length(c).alias("len"), *fuzzy_lines.letter_counts(F.col(c))).alias(f"{c}{c}")
    df = df.select("x", "y", side("x"), side("y")).withColumn("edits", F.levenshtein("x", "y"))
    assert df.filter(~fuzzy_lines.letters_allow("xx", "yy", F.col("edits"))).count() == 0
    assert df.filter(~fuzzy_lines.letters_allow("xx", "yy", F.floor(F.col("edits") / 20))).count() > 0
