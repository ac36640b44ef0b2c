"""Quality rules and the archive on awkward rows; their SQL on the test tables is in test_queries.py."""

import base64
import hashlib
from collections import Counter

from llm_fixtures import documents, words

from caselens.llm import quality, warc
from caselens.llm.common import scratch


def plain(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    n = Counter(grams)
    covered = {k + d for k, g in enumerate(grams) if n[g] > 1 for d in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "base_failed": failed,
    }


TEXTS = [
    None, "", " \t\n\x0b\f\r ", "a", "one two three four five " * 3, "The cat of the house is in it and to the sea, by all.",
    "a b c d e a b c d e f", "x x x x x x", "same line\nsame line\n\n \nsame line ", "## $$ |a| <b> 100% & *", "é ß 😀 　 z",
    "THE!! CAT!! OF!! HOUSE!! IS!! IN!! IT!! AND!! TO!! SEA!! BY!!", "w " * 20_000, " ".join(f"w{k}" for k in range(20_000)),
]


def test_counts_and_verdict(spark):
    docs = documents(spark, TEXTS + TEXTS[:3])
    rows = quality.judged(docs).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        want = plain(r.text)
        assert {k: r[k] for k in want} == want, r.text
        assert r.kept == (not r.base_failed and not r.broken_rules)
    by_text = {r.text: r for r in rows}
    assert by_text[TEXTS[5]].kept and by_text[TEXTS[11]].broken_rules == ["shout_ratio"]
    kept = quality.judged(docs).filter("kept").select("doc_id").collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in rows if r.kept}


def test_rules_are_a_table(spark):
    docs = documents(spark, [TEXTS[5], None])
    rules = [quality.Rule("n_words", None, 5), quality.Rule("symbol_ratio", 0.5, None)]
    rows = {r.doc_id: r for r in quality.judged(docs, rules=rules).collect()}
    assert rows[0].broken_rules == ["n_words", "symbol_ratio"] and rows[1].broken_rules == []
    assert all(r.broken_rules == [] for r in quality.judged(docs, rules=[]).collect())
    assert quality.judged(documents(spark, [])).collect() == []


PAGES = [
    (3, "http://a", "<p>x</p>"), (1, "http://b\r\nX: y", "<p>x</p>"), (2, None, "<p>x</p>"), (4, "http://d", None),
    (5, "http://é", ""), (None, "http://f", "only here é"), (7, "http://g", "\r\n\r\nWARC/1.1\r\n"), (8, "u", "y" * 300_000),
    (9, "u", "twice"), (9, "u", "twice"), (None, "n", "<p>x</p>"),
]


def test_archive_round_trip(spark):
    path = scratch(spark, "test-warc")
    pages = spark.createDataFrame([(*p, "extra", b"z") for p in PAGES], "page_id long, url string, html string, payload string, sha256 binary")
    warc.write_archive(pages.repartition(3), path)
    heads = warc.read_headers(spark, path).collect()
    assert len(heads) == len(PAGES)
    kinds = Counter((h.record_id, h.record_type, h.refers_to) for h in heads)
    assert kinds == Counter(
        {
            ("1", "response", None): 1, ("3", "revisit", "1"): 1, ("2", "revisit", "1"): 1, (None, "revisit", "1"): 1,
            ("4", "response", None): 1, ("5", "revisit", "4"): 1, (None, "response", None): 1, ("7", "response", None): 1,
            ("8", "response", None): 1, ("9", "response", None): 2,
        }
    )
    stored = warc.verified_payloads(spark, path).collect()
    texts = {p[2] or "" for p in PAGES}
    assert len(stored) == len(texts)
    sha1 = {base64.b32encode(hashlib.sha1(t.encode()).digest()).decode(): len(t.encode()) for t in texts}
    assert {s.stored_digest: s.payload_bytes for s in stored} == sha1
    assert {h.payload_digest for h in heads} == set(sha1)
    records = warc.read_records(spark, path).collect()
    for r in records:
        body = r.payload if r.record_type == "response" else b""
        assert bytes(r.record) == bytes(r.header) + bytes(body) + b"\r\n\r\n" and r.content_length == len(body)
        assert bytes(r.header).startswith(b"WARC/1.1\r\n") and bytes(r.header).count(b"\r\n\r\n") == 1
    whole = warc.read_records(spark, path, resolve=True).collect()
    assert Counter(bytes(r.payload).decode() for r in whole) == Counter(p[2] or "" for p in PAGES)


def test_short_payloads_and_no_pages(spark):
    path, schema = scratch(spark, "test-warc"), "page_id long, url string, html string"
    warc.write_archive(spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "yyyy"), (4, "d", "yyyy")], schema), path, revisit_from=3)
    assert Counter(h.record_type for h in warc.read_headers(spark, path).collect()) == {"response": 3, "revisit": 1}
    path = scratch(spark, "test-warc")
    warc.write_archive(spark.createDataFrame([], schema), path)
    assert warc.read_headers(spark, path).collect() == warc.read_records(spark, path).collect() == []
