"""Token ids of whole texts by the `tokenizers` library, with one call of the library per distinct chunk.

A text is cut into chunks at which its ids are known to part: blank characters and the run of other characters
after them. Distinct chunks are found by hash with numpy, new ones are encoded by the library in one joined
call, and a text's ids are put together from its chunks'. Texts in which this cut is not known to be safe
(blank characters outside ASCII, strings of added tokens) are encoded whole. Both ways give the library's ids.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from caselens.llm.words import hash_spans, text_bytes

# Chunks remembered per Python worker; beyond it the memory starts anew. Results do not depend on it.
REMEMBERED = 1_000_000
# Chunks per joined call of the library.
JOINED = 500

_BYTES = np.arange(256)
_BLANK = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_CONTROL = (_BYTES >= 0x1C) & (_BYTES <= 0x1F)


@dataclass
class Ids:
    """Ids of the rows of a batch: row r has ids[first[r]:first[r + 1]]."""

    ids: np.ndarray
    first: np.ndarray

    def closed(self, end_id: int) -> Ids:
        """The same with one more id at the end of each row."""
        size = np.diff(self.first)
        first = np.zeros(len(self.first), dtype=np.int64)
        np.cumsum(size + 1, out=first[1:])
        out = np.empty(first[-1], dtype=np.uint32)
        ends = first[1:] - 1
        keep = np.ones(len(out), dtype=bool)
        keep[ends] = False
        out[keep] = self.ids
        out[ends] = end_id
        return Ids(out, first)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated index ranges start..start+size."""
    total = int(sizes.sum())
    begin = np.cumsum(sizes) - sizes
    return np.repeat(starts - begin, sizes) + np.arange(total)


class Encoder:
    """Ids of Arrow string columns for one tokenizer file (a path executors can read, or the file's JSON)."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        if tokenizer.lstrip().startswith("{"):
            self.tokenizer, spec = Tokenizer.from_str(tokenizer), json.loads(tokenizer)
        else:
            with open(tokenizer, encoding="utf-8") as f:
                text = f.read()
            self.tokenizer, spec = Tokenizer.from_str(text), json.loads(text)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.added = [t["content"].encode() for t in spec.get("added_tokens") or ()]
        # A byte-level vocabulary without normaliser keeps every byte: ids are matched to chunks by their
        # bytes. Otherwise blanks carry no ids and ids are matched by their offsets.
        self.bytewise = spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        if self.bytewise:
            self.width = np.zeros(self.vocabulary, dtype=np.int64)
            for piece, i in self.tokenizer.get_vocab().items():
                self.width[i] = len(piece)  # one character per byte
        self._forget()

    def _forget(self) -> None:
        self.known = np.empty(0, dtype=np.uint64)
        self.at = np.empty(0, dtype=np.int64)
        self.size = np.empty(0, dtype=np.int64)
        self.pool = np.empty(0, dtype=np.uint32)

    def _odd_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows to encode whole."""
        a, b = data[:-1], data[1:]
        odd = np.zeros(len(data), dtype=bool)
        odd |= _CONTROL[data]
        odd[:-1] |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        odd[:-1] |= (a == 0xE2) & ((b == 0x80) | (b == 0x81))
        odd[:-1] |= ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE3) & (b == 0x80))
        for token in self.added:
            hit = np.ones(len(data), dtype=bool)
            for k, byte in enumerate(token[:2]):
                hit[: len(data) - k] &= data[k:] == byte
                hit[len(data) - k :] = False
            odd |= hit
        places = np.flatnonzero(odd)
        return np.unique(np.searchsorted(offsets, places, side="right") - 1) if len(places) else places

    def _encode_new(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, joined, and the number of each chunk's."""
        if self.bytewise:
            # Side by side, chunks part again only where a run of blanks begins and a word follows it.
            if not all(_BLANK[c[0]] and not _BLANK[c[-1]] for c in chunks):
                each = [self.tokenizer.encode(c.decode(), add_special_tokens=False).ids for c in chunks]
                return np.array([i for ids in each for i in ids], dtype=np.uint32), np.array([len(x) for x in each])
            ids = np.array(self.tokenizer.encode(b"".join(chunks).decode(), add_special_tokens=False).ids, dtype=np.uint32)
            ends = np.cumsum([len(c) for c in chunks])
            owner = np.searchsorted(ends, np.cumsum(self.width[ids]), side="left")
        else:
            texts = [c.decode() for c in chunks]
            got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ids = np.array(got.ids, dtype=np.uint32)
            begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
            owner = np.searchsorted(begins, np.array([o[0] for o in got.offsets], dtype=np.int64), side="right") - 1
        return ids, np.bincount(owner, minlength=len(chunks))

    def _learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        if len(self.known) + len(hashes) > REMEMBERED:
            self._forget()
        joins = np.array([bool(_BLANK[c[0]] and not _BLANK[c[-1]]) for c in chunks])
        order = np.argsort(~joins, kind="stable")  # those that can be joined come first
        hashes, chunks = hashes[order], [chunks[k] for k in order]
        cuts = [*range(0, int(joins.sum()), JOINED), *range(int(joins.sum()), len(chunks), JOINED), len(chunks)]
        pools, sizes = [self.pool], []
        for a, b in zip(cuts, cuts[1:]):
            ids, size = self._encode_new(chunks[a:b])
            pools.append(ids)
            sizes.append(size)
        size = np.concatenate(sizes)
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate(pools)
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.at = np.concatenate([self.at, at])[order]
        self.size = np.concatenate([self.size, size])[order]

    def encode(self, column: pa.Array) -> Ids:
        """Ids of every row of a string column; null is the empty text."""
        data, offsets = text_bytes(column)
        rows = len(offsets) - 1
        if not len(data):
            return Ids(np.empty(0, dtype=np.uint32), np.zeros(rows + 1, dtype=np.int64))
        odd = self._odd_rows(data, offsets)
        blank = _BLANK[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        after = np.ones(len(data) + 1, dtype=bool)  # blank before this place
        after[1:] = blank
        if self.bytewise:  # blanks belong to the chunk they lead
            starts = np.flatnonzero(edge[:-1] | (blank & ~after[:-1]))
            ends = np.append(starts[1:], len(data))
        else:
            starts = np.flatnonzero(~blank & (edge[:-1] | after[:-1]))
            stops = np.ones(len(data) + 1, dtype=bool)
            stops[:-1] = blank
            ends = np.flatnonzero(~after & (edge | stops))
        padded = np.zeros(len(data) + 8, dtype=np.uint8)
        padded[: len(data)] = data
        row = np.searchsorted(offsets, starts, side="right") - 1
        if len(odd):
            keep = ~np.isin(row, odd)
            starts, ends, row = starts[keep], ends[keep], row[keep]
        distinct, first, back = np.unique(hash_spans(padded, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != distinct[inside]
        if new.any():
            if len(self.known) + new.sum() > REMEMBERED:
                self._forget()
                new[:] = True
            where = first[new]
            raw = data.tobytes()
            self._learn(distinct[new], [raw[a:b] for a, b in zip(starts[where], ends[where], strict=True)])
            place = np.searchsorted(self.known, distinct)
        size = self.size[place][back]
        ids = self.pool[_ranges(self.at[place][back], size)]
        counts = np.bincount(row, weights=size, minlength=rows).astype(np.int64)
        if not len(odd):
            return Ids(ids, np.concatenate([[0], np.cumsum(counts)]))
        text = data.tobytes()
        whole = {r: self.tokenizer.encode(text[offsets[r] : offsets[r + 1]].decode(), add_special_tokens=False).ids for r in odd.tolist()}
        parts, begin = [], np.cumsum(counts) - counts
        before = 0
        for r, own in whole.items():
            parts += [ids[before : begin[r]], np.array(own, dtype=np.uint32)]
            before, counts[r] = begin[r], len(own)
        parts.append(ids[before:])
        return Ids(np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)]))


_LAST: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """The encoder of this Python worker, made once."""
    if tokenizer not in _LAST:
        _LAST.clear()
        _LAST[tokenizer] = Encoder(tokenizer)
    return _LAST[tokenizer]
