import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caselens.functions.frames import shuffled_rank
from caselens.operators import sampling

STRATA = [("A", "2024-Q1", 200), ("A", "2024-Q2", 50), ("B", "2024-Q1", 400), ("B", "2024-Q2", 10)]


@pytest.fixture(scope="module")
def pool(spark):
    rows, i = [], 0
    for issuer, quarter, n in STRATA:
        for _ in range(n):
            rows.append((i, issuer, quarter, f"text {i}"))
            i += 1
    return spark.createDataFrame(rows, "complaint_id bigint, issuer string, quarter string, narrative string")


def key(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i


def test_stratified_sample_sizes_and_weights(spark, pool):
    got = sampling.stratified_sample(pool, caps={"A": 80}, default_cap=32, seed=5).collect()
    sizes = Counter((r.issuer, r.quarter) for r in got)
    assert sizes == {("A", "2024-Q1"): 80, ("A", "2024-Q2"): 50, ("B", "2024-Q1"): 32, ("B", "2024-Q2"): 10}
    assert len({r.complaint_id for r in got}) == len(got)
    for issuer, quarter, n in STRATA:
        cell = [r for r in got if (r.issuer, r.quarter) == (issuer, quarter)]
        assert {r.stratum_size for r in cell} == {n}
        assert sum(r.weight for r in cell) == pytest.approx(n)
    assert all(r.narrative == f"text {r.complaint_id}" for r in got)


def test_stratified_sample_is_the_same_on_any_partitioning(spark, pool):
    draw = lambda df: sorted(r.complaint_id for r in sampling.stratified_sample(df, caps={}, default_cap=20, seed=5).collect())
    want = sorted(i for s in _by_stratum().values() for i in sorted(s, key=lambda i: key(5, i))[:20])
    assert draw(pool) == want == draw(pool.repartition(11, "narrative"))


def _by_stratum():
    out, i = {}, 0
    for issuer, quarter, n in STRATA:
        out[issuer, quarter] = range(i, i + n)
        i += n
    return out


def test_sample_summary(spark, pool):
    got = {r.issuer: r for r in sampling.sample_summary(sampling.stratified_sample(pool, caps={}, default_cap=20)).collect()}
    assert (got["B"].sampled, got["B"].quarters) == (30, 2)
    assert got["B"].narratives_represented == pytest.approx(410)


def test_eligible_narratives(spark):
    rows = [(1, "x" * 80, "2024-01-01"), (2, "x" * 79, "2024-01-01"), (3, None, "2024-01-01"), (4, "x" * 90, "2024-01-03")]
    df = spark.createDataFrame(rows, "complaint_id bigint, narrative string, d string").select(
        "*", F.col("d").cast("date").alias("date_received"),
        *[F.lit("v").alias(c) for c in ("issuer", "issue", "sub_issue", "company_response")],
    )
    assert [r.complaint_id for r in sampling.eligible_narratives(df, until="2024-01-02").collect()] == [1]


@pytest.mark.parametrize("by", [[], ["issuer"]])
def test_shuffled_rank_equals_a_full_sort(spark, pool, by):
    got = shuffled_rank(pool, "complaint_id", 3, by=by, prefix=1).collect()
    groups = {}
    for r in got:
        groups.setdefault(tuple(r[c] for c in by), []).append(r)
    for rows in groups.values():
        ordered = sorted(rows, key=lambda r: key(3, r.complaint_id))
        assert [r["rank"] for r in ordered] == list(range(1, len(rows) + 1))


def test_balanced_draw_rolls_the_shortfall_forward(spark):
    classes = [("a", 600), ("b", 300), ("c", 96), ("d", 4)]
    rows = [(i, c) for c, n in classes for i in range(n)]
    df = spark.createDataFrame([(n, c) for n, (_, c) in enumerate(rows)], "complaint_id bigint, primary_theme string")
    got = Counter(r.primary_theme for r in sampling.balanced_draw(df, n=40).collect())
    assert got == {"a": 12, "b": 12, "c": 12, "d": 4}


def test_packs_hold_every_row_once(spark, pool):
    rows = pool.limit(21).cache()
    packs = sampling.request_packs(rows, pack_size=8).orderBy("pack_id").collect()
    assert [len(p.ids) for p in packs] == [8, 8, 5]
    ids = [i for p in packs for i in p.ids]
    assert sorted(ids) == sorted(r.complaint_id for r in rows.collect())
    assert ids == sorted(ids, key=lambda i: key(17, i))
    assert f'<complaint id="{packs[0].ids[0]}">\ntext {packs[0].ids[0]}\n</complaint>\n\n<complaint' in packs[0].text


def test_long_narratives_are_cut_and_flagged(spark):
    df = spark.createDataFrame([(1, "x" * 6500), (2, "  short.\n ")], "complaint_id bigint, narrative string")
    whole = sampling.request_packs(df).first()
    assert whole.truncated_ids == [] and "x" * 6500 in whole.text
    pack = sampling.request_packs(df, max_chars=6000).first()
    assert pack.truncated_ids == [1]
    assert "x" * 6000 + "\n[narrative cut here for length]" in pack.text and "x" * 6001 not in pack.text
    assert '<complaint id="2">\nshort.\n</complaint>' in pack.text


def test_keyword_seeds_take_single_matches_up_to_the_cap(spark):
    rows = [(i, "the annual fee") for i in range(9)] + [(50, "nothing"), (51, "annual fee and a lounge")]
    df = spark.createDataFrame(rows, "complaint_id bigint, narrative string")
    got = sorted((r.complaint_id, r.theme) for r in sampling.keyword_seeds(df, cap=4).collect())
    want = sorted(sorted(range(9), key=lambda i: key(7, i))[:4])
    assert got == [(i, "annual_fee") for i in want]


def test_packs_hold_every_row_once_with_repeated_and_null_ids(spark):
    rows = [(1, "first"), (1, "second"), (1, "second"), (None, "no id"), (2, "two"), (None, None)]
    df = spark.createDataFrame(rows, "complaint_id bigint, narrative string")
    packs = sampling.request_packs(df, pack_size=4).collect()
    assert sorted(len(p.ids) for p in packs) == [2, 4]
    ids = [i for p in packs for i in p.ids]
    assert sorted(ids, key=str) == sorted([r[0] for r in rows], key=str)
    text = "\n".join(p.text for p in packs)
    assert [text.count(x) for x in ("first", "second", "no id", "two")] == [1, 2, 1, 1]
