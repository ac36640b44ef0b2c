"""Packing and token files: every id in its place, nothing padded, exact round trips."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import documents, prose
from tokenizers import Tokenizer

from caselens.llm import packing, tokenfiles
from caselens.llm.common import scratch

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def corpus():
    rnd = random.Random(5)
    texts = [prose(rnd, rnd.randint(1, 300)) for _ in range(60)] + [None, "", " ", prose(rnd, 4000), "same", "same"]
    ids = [*range(len(texts) - 2), 900, 900]
    return texts, ids


def test_pieces(spark):
    texts, ids = corpus()
    library = Tokenizer.from_file(BYTE)
    rows = packing.pack_documents(documents(spark, texts, ids), BYTE, window=256, end_id=0).collect()
    want = defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        want[i].append(library.encode(t or "", add_special_tokens=False).ids + [0])
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        own = np.frombuffer(r.tokens, dtype="<u4").tolist()
        assert len(own) == r.length > 0 and own == want[r.doc_id][0][r.start : r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id][0])
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length))
    for i, copies in want.items():
        covered = sorted(x for start, length in pieces[i] for x in range(start, start + length))
        assert covered == sorted(list(range(len(copies[0]))) * len(copies))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256 and at & (at - 1) == 0
    partial = [s for s in sequences.values() if sum(x[1] for x in s) < 256]
    assert len(partial) <= 3 * 8


def test_levels_take_the_smallest_sum_of_squares():
    rnd = random.Random(2)
    levels = packing.Levels(32)
    for k in range(500):
        size = rnd.randint(1, 31)
        counts = levels.counts.copy()

        def squares(level, counts=counts, size=size):
            c = counts.copy()
            if level:
                c[level] -= 1
            if level + size < 32:
                c[level + size] += 1
            return int((c[1:32] ** 2).sum())

        best = min(squares(h) for h in range(33 - size) if h == 0 or counts[h])
        levels.place((k, 0, np.zeros(size), size), size)
        assert int((levels.counts[1:32] ** 2).sum()) == best
        assert sum(len(g) for g in levels.open.values()) == levels.counts[1:32].sum()


def test_packing_edges(spark):
    empty = documents(spark, [])
    assert packing.pack_documents(empty, BYTE).collect() == []
    with pytest.raises(ValueError):
        packing.pack_documents(empty, BYTE, window=1000)
    (row,) = packing.pack_documents(documents(spark, [None], [None]), BYTE).collect()
    assert row.doc_id is None and row.length == row.doc_tokens == 1


def test_files_round_trip(spark):
    texts, ids = corpus()
    texts, ids = [*texts, "no id"], [*ids, None]
    library = Tokenizer.from_file(WORD)
    path = scratch(spark, "test-files")
    tokenfiles.write_token_files(documents(spark, texts, ids), path, WORD, end_id=2)
    rows = sorted(tokenfiles.read_token_files(spark, path).collect(), key=lambda r: r.start)
    got = [(r.doc_id, np.frombuffer(r.tokens, dtype="<u4").tolist()) for r in rows]
    want = [(i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in zip(ids, texts, strict=True)]
    key = lambda x: (x[0] is not None, x[0] or 0)
    assert [g[0] for g in got] == [w[0] for w in sorted(want, key=key)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.tokens) // 4
        at += r.n_tokens
    for s in spark.read.parquet(f"{path}/manifest").collect():
        shard = tokenfiles.Shard(f"{path}/{s.file}")
        assert shard.width == 16 and (shard.ids, len(shard.docs)) == (s.n_ids, s.n_docs)
        everything = shard.read(0, shard.ids)
        for k in (0, len(shard.docs) - 1):
            a, b = shard.starts[k], shard.starts[k + 1]
            assert shard.document(k).tolist() == everything[a:b].tolist()


def test_shard_crosses_blocks(tmp_path):
    rnd = np.random.default_rng(1)
    ids = rnd.integers(0, 49_408, 3 * tokenfiles.BLOCK + 17).astype(np.uint32)
    out = tokenfiles.ShardWriter(f"file://{tmp_path}", "a.ids", 16)
    cuts = [0, 5, tokenfiles.BLOCK - 1, 2 * tokenfiles.BLOCK + 9, len(ids)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        out.add([k if k else None], ids[a:b], np.array([b - a]))
    out.close()
    shard = tokenfiles.Shard(f"file://{tmp_path}/a.ids")
    assert shard.null.tolist() == [True, False, False, False] and len(shard.offsets) == 4
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        assert shard.document(k).tolist() == ids[a:b].tolist()
    assert shard.read(tokenfiles.BLOCK - 3, 9).tolist() == ids[tokenfiles.BLOCK - 3 : tokenfiles.BLOCK + 6].tolist()


def test_no_documents_no_files(spark):
    path = scratch(spark, "test-empty")
    tokenfiles.write_token_files(documents(spark, []), path, WORD, end_id=2)
    assert tokenfiles.read_token_files(spark, path).collect() == []
