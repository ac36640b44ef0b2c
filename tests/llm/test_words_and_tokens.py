"""Word hashes and token ids against plain Python and the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_fixtures import words as plain_words
from tokenizers import Tokenizer

from caselens.llm import tokenfiles, tokens
from caselens.llm.words import run_rows, runs, words

ALPHABET = [*"ab'sS1 \n\t\x0b\x1f.É é|日<", " ", "　", " ", "́", "<|endoftext|>", " 's", "ing ", "ΣΑΣ "]


def texts(n, seed=1):
    rnd = random.Random(seed)
    made = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(n)]
    return [*made, None, "", " ", "\n\n", "word " * 5000, "x" * 3000]


def test_words_are_those_of_the_pattern():
    column = texts(500)
    found = words(pa.array(column))
    seen = {}
    for r, t in enumerate(column):
        own = found.hashes[found.first[r] : found.first[r + 1]].tolist()
        want = plain_words(t, lower=True)
        assert len(own) == len(want)
        for h, w in zip(own, want, strict=True):
            assert seen.setdefault(h, w) == w
    assert len(set(seen.values())) == len(seen)


def test_sliced_columns_and_runs():
    column = pa.array(["a b c d", "a b", None, "b c d e"]).slice(1)
    found = words(column)
    place, row = run_rows(found.first, 2)
    assert row.tolist() == [0, 2, 2, 2] and len(runs(found.hashes, 2)[place]) == 4


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 700)  # forgets on the way
    path = public_tokenizers.path(name)
    column, library = texts(1500), Tokenizer.from_file(path)
    encoder = tokens.Encoder(path)
    for a in range(0, len(column), 300):
        part = column[a : a + 300]
        got = encoder.encode(pa.array(part, type=pa.string()))
        for r, t in enumerate(part):
            assert got.ids[got.first[r] : got.first[r + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids
        closed = got.closed(7)
        assert closed.ids[closed.first[1:] - 1].tolist() == [7] * len(part)


@pytest.mark.parametrize("width", [1, 5, 16, 17, 31, 32])
def test_bits_round_trip(width):
    rnd = np.random.default_rng(width)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rnd.integers(0, 1 << width, n).astype(np.uint32)
        packed = tokenfiles.pack_bits(ids, width)
        assert len(packed) == -(-n // 64) * width
        assert tokenfiles.unpack_bits(packed, width, n).tolist() == ids.tolist()
    assert tokenfiles.bits_for(49_408) == 16 and tokenfiles.bits_for(65_537) == 17 and tokenfiles.bits_for(1) == 1
