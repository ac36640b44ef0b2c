import json

import pytest
from pyspark.sql import functions as F

from caselens.operators import label_parse, labels

GOOD = {
    "primary_theme": "billing", "secondary_theme": None, "sentiment": "negative",
    "named_benefits": ["Lounge access"], "card_product": "Gold",
}


def parse(spark, *raws):
    texts = [(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(raws)]
    df = spark.createDataFrame(texts, "i int, raw string")
    return label_parse.parse_labels(df, "raw").orderBy("i").collect()


def test_good_labels_in_several_forms(spark):
    wrapped = "Sure, here:\n```json\n" + json.dumps(GOOD | {"primary_theme": " Dispute or Fraud "}, indent=1) + "\n```"
    loose = GOOD | {"primary_theme": "ANNUAL-FEE", "sentiment": "Very Negative", "secondary_theme": "Rewards and points"}
    same = GOOD | {"secondary_theme": "Billing"}
    rows = parse(spark, GOOD, wrapped, loose, same)
    assert {r.status for r in rows} == {"ok"}
    assert [r.primary_theme for r in rows] == ["billing", "dispute_fraud", "annual_fee", "billing"]
    assert [r.secondary_theme for r in rows] == [None, None, "rewards_points", None]
    assert rows[2].sentiment == "very_negative"
    assert (rows[0].named_benefits, rows[0].card_product) == (["Lounge access"], "Gold")


@pytest.mark.parametrize(
    "raw, error",
    [
        ("nothing here", label_parse.NO_JSON),
        (None, label_parse.NO_JSON),
        ('{"primary_theme": "billing"', label_parse.NO_JSON),
        ('{"primary_theme": }', label_parse.BAD_JSON),
        ({k: v for k, v in GOOD.items() if k != "primary_theme"}, label_parse.NO_PRIMARY),
        (GOOD | {"primary_theme": "parking"}, label_parse.UNKNOWN_THEME),
        (GOOD | {"primary_theme": 3}, label_parse.THEME_NOT_TEXT),
        (GOOD | {"primary_theme": None}, label_parse.THEME_NOT_TEXT),
        (GOOD | {"primary_theme": ["billing"]}, label_parse.THEME_NOT_TEXT),
        (GOOD | {"secondary_theme": "parking"}, label_parse.UNKNOWN_THEME),
        (GOOD | {"secondary_theme": 4}, label_parse.NOT_TEXT),
        (GOOD | {"sentiment": "furious"}, label_parse.UNKNOWN_SENTIMENT),
        ({k: v for k, v in GOOD.items() if k != "sentiment"}, label_parse.UNKNOWN_SENTIMENT),
        (GOOD | {"sentiment": None}, label_parse.UNKNOWN_SENTIMENT),
        (GOOD | {"named_benefits": {"a": 1}}, label_parse.BENEFITS_NOT_LIST),
        (GOOD | {"named_benefits": 4}, label_parse.BENEFITS_NOT_LIST),
        (GOOD | {"named_benefits": ["a", 4]}, label_parse.NOT_TEXT),
        (GOOD | {"named_benefits": ["a", ["b"]]}, label_parse.NOT_TEXT),
        (GOOD | {"card_product": 9}, label_parse.NOT_TEXT),
        (GOOD | {"primary_theme": "parking", "sentiment": "furious"}, label_parse.UNKNOWN_THEME),
    ],
)
def test_bad_labels_are_errors(spark, raw, error):
    r = parse(spark, raw)[0]
    assert (r.status, r.error) == ("parse_error", error)
    assert r.primary_theme is None and r.sentiment is None and r.named_benefits is None


@pytest.mark.parametrize("word", ["", "none", "NULL", " n/a ", "NA", "Unknown", "not  specified", "not stated", None])
def test_nullish_words_are_null(spark, word):
    r = parse(spark, GOOD | {"secondary_theme": word, "card_product": word, "named_benefits": [word, "x"]})[0]
    assert (r.status, r.secondary_theme, r.card_product, r.named_benefits) == ("ok", None, None, ["x"])


def test_benefits_are_unique_ignoring_case(spark):
    many = ["Resy", "resy ", "", "RESY", "a  b", "A b", "c", "d", "e", "f"]
    as_text = GOOD | {"named_benefits": "One thing"}
    missing = {k: v for k, v in GOOD.items() if k != "named_benefits"}
    rows = parse(spark, GOOD | {"named_benefits": many}, as_text, missing, GOOD | {"named_benefits": None})
    assert [r.named_benefits for r in rows] == [["Resy", "a b", "c", "d", "e", "f"], ["One thing"], [], []]


# --- packs -------------------------------------------------------------------------------
def packs(spark, *responses):
    rows = [
        (str(i), "m", "v1", "batch", ids, ids[:1], raw if isinstance(raw, str) else json.dumps(raw), stop, 800, 400, 80, 0)
        for i, (ids, raw, stop) in enumerate(responses)
    ]
    schema = (
        "pack_id string, model string, prompt_version string, mode string, ids array<string>, truncated_ids array<string>, "
        "raw string, stop_reason string, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint"
    )
    out = label_parse.parse_packs(spark.createDataFrame(rows, schema)).collect()
    return {r.complaint_id: r for r in out}


def item(i, theme="billing"):
    return GOOD | {"id": i, "primary_theme": theme}


def test_packs_match_by_id_not_position(spark):
    got = packs(spark, (["1", "2"], {"results": [item(" 2 ", "annual_fee"), item(1, "dispute_fraud")]}, "end"))
    assert {i: r.primary_theme for i, r in got.items()} == {1: "dispute_fraud", 2: "annual_fee"}
    assert got[1].narrative_truncated and not got[2].narrative_truncated


def test_missing_repeated_and_bad_items_are_errors_of_their_own_row(spark):
    results = [item("1"), item("2"), item("2"), item("3", "parking"), item("99"), "text", 7, {"no": "id"}]
    got = packs(spark, (["1", "2", "3", "4"], {"results": results}, "end"))
    assert {i: (r.status, r.error) for i, r in got.items()} == {
        1: ("ok", None),
        2: ("parse_error", label_parse.ID_TWICE),
        3: ("parse_error", label_parse.UNKNOWN_THEME),
        4: ("missing_in_response", label_parse.ID_MISSING),
    }


@pytest.mark.parametrize(
    "raw, stop, status",
    [
        ("no json", "end", "parse_error"),
        ({"items": []}, "end", "parse_error"),
        ({"results": "x"}, "end", "parse_error"),
        ('{"results": [', "max_tokens", "output_cut_off"),
        ({"results": [item("1")]}, "refusal", "refusal"),
    ],
)
def test_malformed_packs(spark, raw, stop, status):
    got = packs(spark, (["1", "2"], raw, stop))
    assert {r.status for r in got.values()} == {status} and len(got) == 2
    assert all(r.primary_theme is None for r in got.values())


def test_usage_is_split_evenly(spark):
    got = packs(spark, (["1", "2", "3"], {"results": [item("1")]}, "end"))
    assert sum(r.input_tokens for r in got.values()) == pytest.approx(800)
    assert {r.output_tokens for r in got.values()} == {400 / 3}


# --- ledger ------------------------------------------------------------------------------
LEDGER = "seq bigint, complaint_id bigint, model string, prompt_version string, status string, primary_theme string"


@pytest.fixture
def ledger(spark):
    rows = [
        (1, 1, "m", "v1", "ok", "billing"), (2, 2, "m", "v1", "parse_error", None), (3, 3, "m", "v1", "api_error", None),
        (4, 4, "m", "v0", "ok", "billing"), (5, 1, "m", "v1", "ok", "other"), (6, 1, "n", "v1", "ok", "annual_fee"),
    ]
    extra = {"secondary_theme": "string", "sentiment": "string", "named_benefits": "array<string>", "card_product": "string", "narrative_truncated": "boolean"}
    return spark.createDataFrame(rows, LEDGER).withColumns({c: F.lit(None).cast(t) for c, t in extra.items()})


def test_final_attempts_and_pending_rows(spark, ledger):
    sample = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "complaint_id bigint")
    left = labels.pending_rows(sample, ledger, "m", "v1")
    assert sorted(r.complaint_id for r in left.collect()) == [3, 4, 5]


def test_current_labels_keep_the_last_of_one_model(spark, ledger):
    got = labels.current_labels(ledger, "v1").collect()
    assert [(r.complaint_id, r.model, r.primary_theme) for r in got] == [(1, "m", "other")]
    asked = labels.current_labels(ledger, "v1", model="n").collect()
    assert [r.primary_theme for r in asked] == ["annual_fee"]
    assert labels.current_labels(ledger, "v1", model="absent").first().model == "m"
    assert labels.current_labels(ledger, "v9").count() == 0


def test_label_source_follows_coverage(spark, ledger):
    sample = spark.createDataFrame(
        [(1, "A", "2024-Q1", 30, 15.0), (2, "A", "2024-Q1", 30, 15.0)],
        "complaint_id bigint, issuer string, quarter string, stratum_size bigint, weight double",
    )
    model = spark.createDataFrame([(1, "billing", "x"), (2, "other", "x"), (3, "other", "x")], "complaint_id bigint, primary_theme string, label_source string")
    few = labels.current_labels(ledger, "v1")
    got = labels.labelled_sample(sample, few, model, min_coverage=0.5).collect()
    assert [(r.complaint_id, r.weight, r.label_source, r.primary_theme) for r in got] == [(1, 30.0, "llm", "other")]
    got = labels.labelled_sample(sample, few, model).orderBy("complaint_id").collect()
    assert [(r.primary_theme, r.weight, r.sentiment, r.label_source) for r in got] == [
        ("billing", 15.0, None, "x"), ("other", 15.0, None, "x"),
    ]


def test_a_ledger_holds_together_in_any_row_order(spark, tmp_path):
    from pyspark.sql import functions as F

    from caselens.functions import rules
    from caselens.operators import label_parse, labels
    from caselens.sources import tables

    raw = '{"results": [{"id": "1", "primary_theme": "%s", "sentiment": "negative"}]}'
    known = [t for t in rules.THEME_RULES][:2]
    packs = [(k, f"p{k}", "m", "v1", "batch", [1], [], raw % t, "end", 1.0, 1.0, 0.0, 0.0) for k, t in enumerate(known)]
    schema = (
        "seq long, pack_id string, model string, prompt_version string, mode string, ids array<long>, truncated_ids array<long>, "
        "raw string, stop_reason string, input_tokens double, output_tokens double, cache_read_tokens double, cache_write_tokens double"
    )
    chosen = set()
    for n, order in enumerate((packs, packs[::-1])):
        path = f"{tmp_path}/ledger{n}"
        for p in order:
            tables.append_ledger(label_parse.parse_packs(spark.createDataFrame([p], schema)), path)
        chosen.add(labels.current_labels(tables.read_ledger(spark, path), "v1").first().primary_theme)
    assert chosen == {known[1]}
    unordered = label_parse.parse_packs(spark.createDataFrame(packs, schema).drop("seq"))
    with pytest.raises(ValueError):
        tables.append_ledger(unordered, f"{tmp_path}/ledger9")
    with pytest.raises(Exception, match="no seq"):
        tables.append_ledger(unordered.withColumn("seq", F.lit(None).cast("long")), f"{tmp_path}/ledger9")


def test_packs_match_items_by_id_at_any_size(spark):
    import json

    from caselens.operators import label_parse

    n = 3000
    item = lambda i, **more: {"id": f" {i} ", "primary_theme": "billing", "sentiment": "negative"} | more
    items = [item(i) for i in range(n) if i % 5] + [item(7), "no object", {"primary_theme": "billing"}, item(9, id=None), item(n + 1)]
    asked = [*range(n), 11, 11, None]
    schema = (
        "pack_id string, model string, prompt_version string, mode string, ids array<long>, truncated_ids array<long>, "
        "raw string, stop_reason string, input_tokens double, output_tokens double, cache_read_tokens double, cache_write_tokens double"
    )
    pack = ("p", "m", "v1", "batch", asked, [], json.dumps({"results": items}), "end", 1.0, 1.0, 0.0, 0.0)
    got = label_parse.parse_packs(spark.createDataFrame([pack, ("q", *pack[1:4], None, *pack[5:])], schema)).collect()
    assert len(got) == n + 3
    by_id = {}
    for r in got:
        by_id.setdefault(r.complaint_id, []).append((r.status, r.error))
    assert by_id[7] == [("parse_error", label_parse.ID_TWICE)] and by_id[10] == by_id[None] == [("missing_in_response", label_parse.ID_MISSING)]
    assert by_id[11] == [("ok", None)] * 3 and by_id[12] == [("ok", None)]
    assert sum(v[0][0] == "ok" for v in by_id.values()) == sum(1 for i in range(n) if i % 5) - 1


def test_label_source_may_be_named(spark):
    from caselens.operators import labels

    sample = spark.createDataFrame([(1, "A", "q", 2, 1.0), (2, "A", "q", 2, 1.0)], "complaint_id bigint, issuer string, quarter string, stratum_size bigint, weight double")
    own = spark.createDataFrame([(1, "m", "billing")], "complaint_id bigint, model string, primary_theme string")
    model = spark.createDataFrame([(1, "other", "x"), (2, "other", "x")], "complaint_id bigint, primary_theme string, label_source string")
    assert [r.primary_theme for r in labels.labelled_sample(sample, own, model, source="labels").collect()] == ["billing"]
    assert labels.labelled_sample(sample, own, model, source="model").count() == 2
    with pytest.raises(ValueError):
        labels.labelled_sample(sample, own, model, source="any")
