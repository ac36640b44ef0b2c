import datetime as dt

import pytest
from pyspark.sql import functions as F

from caselens.functions import rules
from caselens.sources import exports, tables
from caselens.streaming import incremental

HEADER = list(rules.EXPORT_COLUMNS)
CARD = rules.CARD_PRODUCT
OLD = rules.CARD_PRODUCT_BEFORE_RENAME


def row(complaint_id, date="2024-05-01", narrative="", company=" DISCOVER BANK ", product=CARD, **more):
    cells = {
        "Complaint ID": complaint_id, "Date received": date, "Product": product, "Company": company,
        "Consumer complaint narrative": narrative, "Issue": "Fees", "Timely response?": "Yes",
        "Date sent to company": "2024-05-02", "Company response to consumer": "Closed with explanation",
    } | more
    return [cells.get(h, "") for h in HEADER]


def write_export(folder, name, rows):
    quote = lambda v: '"' + str(v).replace('"', '""') + '"'
    lines = [",".join(HEADER)] + [",".join(quote(v) for v in r) for r in rows]
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(folder / name)


CARD_CASES = [
    (CARD, None, True),
    (CARD, "Store credit card", True),
    (CARD, "anything", True),
    (OLD, "General-purpose credit card or charge card", True),
    (OLD, "Store credit card", True),
    (OLD, "General-purpose prepaid card", False),
    (OLD, "Gift card", False),
    (OLD, None, False),
    ("Prepaid card", "General-purpose prepaid card", False),
    ("credit card", None, False),
    ("Mortgage", None, False),
    (None, None, False),
]


def test_card_filter_is_never_null(spark):
    df = spark.createDataFrame(CARD_CASES, "product string, sub_product string, want boolean")
    wrong = df.filter(~exports.is_card().eqNullSafe(F.col("want"))).collect()
    assert wrong == []


@pytest.mark.parametrize("company", ["Discover Bank", "DISCOVER BANK NA", "CITIBANK", "JPMORGAN CHASE", "AMEX"])
def test_lookalike_companies_are_not_mapped(spark, company):
    assert spark.range(1).select(exports.issuer_of(F.lit(company))).first()[0] is None


def test_issuer_map_trims_and_passes_null(spark):
    r = spark.range(1).select(exports.issuer_of(F.lit("  DISCOVER BANK ")), exports.issuer_of(F.lit(None).cast("string"))).first()
    assert tuple(r) == ("Discover", None)


def test_multi_line_cells_quotes_and_types(spark, tmp_path):
    text = 'First line, with "quotes"\n\nthird line, 1,5 %'
    path = write_export(tmp_path, "Export_4_a.csv", [row(7, narrative=text), row(8, narrative="   "), row(9, date="2022-12-31")])
    got = exports.ingest(spark, path).orderBy("complaint_id").collect()
    assert [(r.complaint_id, r.narrative, r.company, r.date_received, r.source_file) for r in got] == [
        (7, text, "DISCOVER BANK", dt.date(2024, 5, 1), "Export_4_a.csv"),
        (8, None, "DISCOVER BANK", dt.date(2024, 5, 1), "Export_4_a.csv"),
    ]
    assert got[0].state is None


def test_gate_names_the_unclean_export(spark, tmp_path):
    good = write_export(tmp_path, "Export_4_a.csv", [row(1)])
    bad = write_export(tmp_path, "Export_5_b.csv", [row("12x"), row(3, date="not a date"), row(4, date="2024-02-30"), row(5)])
    raw = exports.read_exports(spark, [good, bad])
    assert [tuple(r) for r in exports.unclean_rows(raw).collect()] == [("Export_5_b.csv", 3)]
    with pytest.raises(exports.UncleanExport, match="Export_5_b.csv: 3"):
        exports.ingest(spark, [good, bad])


@pytest.mark.parametrize("text, ok", [("2024-05-01", True), ("2024/05/01", True), ("2024", False), ("2024-05", False), ("05/01/2024", False), ("2024-13-01", False)])
def test_text_date(spark, text, ok):
    assert (spark.range(1).select(exports.text_date(F.lit(text))).first()[0] == dt.date(2024, 5, 1)) is ok


def test_newest_export_wins_by_number(spark, tmp_path):
    paths = [
        write_export(tmp_path, f"Export_{n}_x.csv", [row(1, narrative=f"from {n}"), row(100 + n)]) for n in (4, 9, 10)
    ]
    got = {r.complaint_id: r for r in exports.ingest(spark, paths).collect()}
    assert sorted(got) == [1, 104, 109, 110] and got[1].narrative == "from 10"


def test_dedupe_limits_a_hot_id_before_the_shuffle(spark):
    plan = exports.dedupe_latest(
        spark.range(10).selectExpr("id % 3 AS complaint_id", "'Export_4_x.csv' AS source_file", "id AS other")
    )._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_file_counts(spark, tmp_path):
    path = write_export(tmp_path, "Export_4_a.csv", [row(1), row(2, date="2024-01-09"), row(3, product="Mortgage")])
    got = exports.file_counts(exports.read_exports(spark, path)).first()
    assert tuple(got) == ("Export_4_a.csv", 3, 2, "2024-01-09", "2024-05-01")


def test_restrict_puts_the_issuer_first(spark, tmp_path):
    path = write_export(tmp_path, "Export_4_a.csv", [row(1), row(2, company="SOMEBODY ELSE")])
    got = exports.restrict_to_issuers(exports.ingest(spark, path))
    assert got.columns[0] == "issuer" and [r.issuer for r in got.collect()] == ["Discover"]


def test_incremental_ingest_reads_each_export_once(spark, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    run = lambda: incremental.process_new_files(
        spark, str(incoming), str(tmp_path / "parts"), str(tmp_path / "checkpoint")
    )
    rows = lambda: sorted((r.complaint_id, r.narrative) for r in incremental.ingested_cards(spark, str(tmp_path / "parts")).collect())
    write_export(incoming, "Export_9_a.csv", [row(1, narrative="old\nline"), row(2)])
    run()
    run()
    assert rows() == [(1, "old\nline"), (2, None)]
    write_export(incoming, "Export_10_b.csv", [row(1, narrative="new"), row(3)])
    run()
    assert rows() == [(1, "new"), (2, None), (3, None)]
    counts = incremental.ingested_counts(spark, str(tmp_path / "parts")).collect()
    assert sorted((r.source_file, r.rows_total) for r in counts) == [("Export_10_b.csv", 2), ("Export_9_a.csv", 2)]


def test_incremental_ingest_stops_on_an_unclean_export(spark, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    write_export(incoming, "Export_4_a.csv", [row("x1")])
    with pytest.raises(Exception, match="id or date check failed"):
        incremental.process_new_files(spark, str(incoming), str(tmp_path / "parts"), str(tmp_path / "c"))
    assert not (tmp_path / "parts" / "rows").exists() and not (tmp_path / "parts" / "counts").exists()


def test_nothing_ingested_is_no_rows(spark, tmp_path):
    cards, counts = incremental.ingested_cards(spark, str(tmp_path / "p")), incremental.ingested_counts(spark, str(tmp_path / "p"))
    assert cards.collect() == counts.collect() == [] and cards.columns == exports.CARD_COLUMNS


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    incoming, parts = tmp_path / "in", tmp_path / "parts"
    incoming.mkdir()
    run = lambda: incremental.process_new_files(spark, str(incoming), str(parts), str(tmp_path / "checkpoint"))
    files = lambda k: sorted(p.name for p in (parts / "rows" / f"bucket={k}").glob("*.parquet"))
    million = incremental.IDS_PER_BUCKET
    write_export(incoming, "Export_4_a.csv", [row(5, narrative="old"), row(million + 1), row(2 * million)])
    run()
    before = {k: files(k) for k in range(3)}
    write_export(incoming, "Export_5_b.csv", [row(million + 1, narrative="newer"), row(million + 2)])
    run()
    assert files(0) == before[0] and files(2) == before[2] and files(1) != before[1]
    got = {r.complaint_id: r.narrative for r in incremental.ingested_cards(spark, str(parts)).collect()}
    assert got == {5: "old", million + 1: "newer", million + 2: None, 2 * million: None}
    assert "Window" not in incremental.ingested_cards(spark, str(parts))._jdf.queryExecution().executedPlan().toString()


def test_a_replayed_merge_changes_nothing(spark, tmp_path):
    rows, work = str(tmp_path / "rows"), str(tmp_path / "work")
    path = write_export(tmp_path, "Export_4_a.csv", [row(1, narrative="a"), row(2)])
    first = exports.clean_rows(exports.read_exports(spark, path))
    read = lambda: sorted((r.complaint_id, r.narrative) for r in spark.read.parquet(rows).collect())
    incremental.merge_rows(first, rows, f"{work}/0")
    again = exports.clean_rows(exports.read_exports(spark, write_export(tmp_path, "Export_5_b.csv", [row(1, narrative="b")])))
    incremental.merge_rows(again, rows, f"{work}/1")
    incremental.merge_rows(again, rows, f"{work}/1")  # after its marker: only the last step
    incremental.merge_rows(again, rows, f"{work}/2")  # before it: merged once more
    assert read() == [(1, "b"), (2, None)]


def test_each_export_is_parsed_once(spark, tmp_path):
    path = write_export(tmp_path, "Export_4_a.csv", [row(1), row(2, product="Mortgage", narrative="not kept"), row(3)])
    out = exports.ingest(spark, path)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Scan csv" not in text and text.count("FileScan parquet") == 1
    (tmp_path / "Export_4_a.csv").unlink()
    assert sorted(r.complaint_id for r in out.collect()) == [1, 3]
    raw = exports.read_exports(spark, write_export(tmp_path, "Export_5_b.csv", [row(1), row(2, product="Mortgage", narrative="not kept")]))
    kept = exports.staged(raw, str(tmp_path / "staged"))
    assert exports.gated_counts(kept).first().rows_total == 2 and kept.filter("narrative IS NOT NULL").count() == 0


def test_views_and_denominators(spark, tmp_path):
    csv = tmp_path / "volume.csv"
    csv.write_text(
        "issuer,fiscal_year,metric,value,scope_label,source_title,source_url,quote,notes\n"
        'JPMorgan Chase,2024,purchase_volume_usd_bn,10.5,"a, b",t,u,"x ""y""",n\n'
        "Citi,2024,purchase_volume_usd_bn,1,branded,t,u,q,n\n"
        "Citi,2024,purchase_volume_usd_bn,2,retail,t,u,q,n\n"
        "Citi,2024,accounts_mn,99,retail,t,u,q,n\n"
    )
    path = write_export(tmp_path, "Export_4_a.csv", [row(1, **{"Sub-issue": "Problem with fees"})])
    cards = exports.ingest(spark, path)
    tables.write_by_year(cards, str(tmp_path / "cards"))
    exports.restrict_to_issuers(cards).write.parquet(str(tmp_path / "complaints"))
    tables.register_views(spark, str(tmp_path / "complaints"), str(tmp_path / "cards"), str(csv))
    got = spark.sql("SELECT issuer, purchase_volume FROM purchase_volume ORDER BY 1").collect()
    assert [tuple(r) for r in got] == [("Chase", 10.5), ("Citi", 3.0)]
    c = spark.sql("SELECT quarter, month, has_narrative, value_issue FROM complaints").first()
    assert tuple(c) == ("2024-Q2", dt.date(2024, 5, 1), False, "Fees")
    assert spark.table("cards_all").filter("year = 2024").count() == 1


def test_ledger_round_trip(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert tables.read_ledger(spark, path).count() == 0
    first = spark.createDataFrame([(1, 10, "ok", ["a"])], "seq bigint, complaint_id bigint, status string, named_benefits array<string>")
    second = first.withColumn("seq", F.lit(2).cast("bigint"))
    for run, records in (("one", first), ("two", second), ("two", second), ("one", first)):
        tables.append_ledger(records, path, run)
    got = tables.read_ledger(spark, path)
    assert got.columns == list(tables.LEDGER_TYPES)
    assert sorted((r.seq, r.complaint_id, r.named_benefits, r.error) for r in got.collect()) == [(1, 10, ["a"], None), (2, 10, ["a"], None)]
    tables.append_ledger(second, path)
    tables.append_ledger(second, path)
    assert tables.read_ledger(spark, path).count() == 4


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_ordered_results_are_checked_on_reading(spark, tmp_path, fmt):
    rows = [("b", 1), (None, 2), ("a", 3), ("a", None), ("a", 3)] + [(f"c{k:03d}", k) for k in range(200)]
    path = str(tmp_path / "out")
    tables.write_result(spark.createDataFrame(rows, "k string, v bigint").repartition(5), path, ["k", "v"], fmt)
    back = tables.read_result(spark, path, "k string, v bigint", ["k", "v"], fmt).orderBy("position").collect()
    last = lambda x: (x is None, x)
    assert [(r.k, r.v) for r in back] == sorted(rows, key=lambda r: (last(r[0]), last(r[1])))
    assert [r.position for r in back] == list(range(1, len(rows) + 1))
    with pytest.raises(tables.UnorderedResult):
        tables.read_result(spark, path, "k string, v bigint", ["v"], fmt)
    for spoilt in (F.col("position") + (F.col("position") > 3).cast("int"), F.least("position", F.lit(7)).cast("bigint")):
        spark.createDataFrame(back).withColumn("position", spoilt).write.mode("overwrite").parquet(f"{path}2")
        with pytest.raises(tables.UnorderedResult):
            tables.read_result(spark, f"{path}2", "k string, v bigint", ["k", "v"], "parquet")


def test_unordered_result(spark, tmp_path):
    tables.write_result(spark.createDataFrame([("b", 1), (None, 2)], "k string, v int"), str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True).collect()
    assert sorted((r.k or "", r.v) for r in back) == [("", "2"), ("b", "1")]


@pytest.mark.parametrize("max_ids", [0, 100])
def test_dedupe_of_stored_rows_shuffles_only_repeated_ids(spark, max_ids):
    names = exports.CARD_COLUMNS
    cells = {"complaint_id": lambda i: None if i > 37 else i % 30, "source_file": lambda i: f"Export_{i % 11}_a.csv"}
    rows = [tuple(cells.get(n, lambda i, n=n: f"{n}{i}")(i) for n in names) for i in range(40)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'bigint' if n == 'complaint_id' else 'string'}" for n in names))
    got = exports.dedupe_stored(df, max_ids)
    assert sorted(map(str, got.collect())) == sorted(map(str, exports.dedupe_latest(df).collect()))
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("LeftAnti" in text) == (max_ids > 0)
    assert got.count() == 31


def test_merging_copies_only_the_rows_before(spark, tmp_path):
    rows, work = str(tmp_path / "rows"), tmp_path / "work"
    stored = lambda at: sorted(r.complaint_id for r in spark.read.schema(incremental.ROWS_SCHEMA).parquet(str(at)).collect())
    body = [row(1, narrative="a"), row(2), row(2, narrative="twice"), row(5_000_000)]
    first = exports.clean_rows(exports.read_exports(spark, write_export(tmp_path, "Export_4_a.csv", body)))
    incremental.merge_rows(first, rows, f"{work}/0")
    assert [*(p.name for p in sorted((work / "0").iterdir()))] == ["before", "done"] and stored(work / "0" / "before") == []
    again = exports.clean_rows(exports.read_exports(spark, write_export(tmp_path, "Export_5_b.csv", [row(1, narrative="b"), row(3)])))
    incremental.merge_rows(again, rows, f"{work}/1")
    assert stored(work / "1" / "before") == [1, 2] and stored(rows) == [1, 2, 3, 5_000_000]
    # A driver lost while the touched bucket was replaced: the rows before are still there.
    for part in (tmp_path / "rows" / "bucket=0").iterdir():
        part.unlink()
    incremental.merge_rows(again, rows, f"{work}/1")
    assert stored(rows) == [1, 2, 3, 5_000_000]
    assert spark.read.parquet(rows).filter("complaint_id = 1").first().narrative == "b"


def test_a_run_leaves_no_copies_of_its_rows(spark, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    for k in (4, 5):
        write_export(incoming, f"Export_{k}_a.csv", [row(1, narrative=f"n{k}"), row(k)])
        incremental.process_new_files(spark, str(incoming), str(tmp_path / "parts"), str(tmp_path / "checkpoint"))
        left = [f for f in (tmp_path / "parts" / "work").rglob("*.parquet") if f.parent.name in ("staged", "before", "merged")]
        assert sum(spark.read.parquet(str(f)).count() for f in left) == 0
    got = {r.complaint_id: r.narrative for r in incremental.ingested_cards(spark, str(tmp_path / "parts")).collect()}
    assert got == {1: "n5", 4: None, 5: None} and incremental.ingested_counts(spark, str(tmp_path / "parts")).count() == 2


def test_rows_without_repeated_ids_are_not_joined(spark, tmp_path):
    rows = exports.clean_rows(exports.read_exports(spark, write_export(tmp_path, "Export_4_a.csv", [row(1), row(2)])))
    assert exports.dedupe_stored(rows)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
