"""Exports read in blocks give the rows of the plain multi-line scan."""

import random
from collections import Counter

import pytest
from test_exports import HEADER, row, write_export

from caselens.sources import csv_blocks, exports

TEXTS = ["", "plain", 'says "no", twice ""', "two\nlines", '\n\n"', "a,b\n\n\nc", "é x", "ends with\n", '"', '""\n""', "x" * 300]


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows_of(df):
    return Counter(tuple(r) for r in df.select(sorted(df.columns)).collect())


def test_same_rows_as_the_plain_scan(spark, tmp_path, small_blocks):
    rnd = random.Random(1)
    paths = []
    for k, n in ((4, 400), (5, 1), (6, 150)):
        body = [row(i, narrative=rnd.choice(TEXTS) + rnd.choice(["", "\n" * rnd.randrange(40)]), company=rnd.choice(["A", 'B "b"', "C\nc"])) for i in range(n)]
        paths.append(write_export(tmp_path, f"Export_{k}_x.csv", body))
    lines = csv_blocks._lines(spark, paths)
    assert lines.rdd.getNumPartitions() > 10 and lines.select("path", "block").distinct().count() > 10
    got = rows_of(csv_blocks.read_split_exports(spark, paths))
    assert got == rows_of(exports.read_exports(spark, paths)) and sum(got.values()) == 551


def test_a_cell_longer_than_many_blocks(spark, tmp_path, small_blocks):
    long = "\n".join(f'line {k} with a "quote" and a comma,' for k in range(3000))
    path = write_export(tmp_path, "Export_4_x.csv", [row(1), row(2, narrative=long), row(3)])
    got = {r.complaint_id: r.narrative for r in csv_blocks.read_split_exports(spark, path).collect()}
    assert got == {"1": None, "2": long, "3": None}


def test_no_line_within_a_chunk_is_shuffled(spark, tmp_path):
    rows = [row(i, narrative=f"first {i}\n" + "a line of this text\n" * 40 + f'and "{i}"') for i in range(2000)]
    path = write_export(tmp_path, "Export_4_x.csv", rows)
    chunks = csv_blocks._chunks(csv_blocks._lines(spark, path))
    pieces = csv_blocks.records(chunks, csv_blocks._opened(chunks))
    crossing = pieces.filter("text LIKE '%first%'").count(), chunks.count()
    assert crossing[0] == 2000 and 1 < crossing[1] < 20
    plan = csv_blocks.read_split_exports(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    # One window, over the pieces that cross a chunk's ends; before, one over all lines of a block.
    assert plan.count("Window [") == 1


def test_compressed_exports_are_split_as_well(spark, tmp_path, small_blocks):
    import bz2

    rnd = random.Random(2)
    body = [row(i, narrative="".join(rnd.choices('ab"\n ,é', k=600))) for i in range(4000)]
    path = write_export(tmp_path, "Export_4_x.csv", body)
    packed = tmp_path / "Export_5_x.csv.bz2"
    packed.write_bytes(bz2.compress(open(path, "rb").read(), 1))
    plain = csv_blocks.read_split_exports(spark, path).drop("source_file")
    got = csv_blocks.read_split_exports(spark, str(packed))
    assert csv_blocks._lines(spark, str(packed)).select("block").distinct().count() > 3
    assert rows_of(got.drop("source_file")) == rows_of(plain) and got.count() == 4000


def test_other_line_ends_and_headers(spark, tmp_path):
    path = write_export(tmp_path, "Export_4_x.csv", [row(1, narrative="a\nb"), row(2)])
    text = open(path, encoding="utf-8").read().replace("\n", "\r\n")
    (tmp_path / "Export_5_y.csv").write_bytes((text + "\r\n").encode())
    got = csv_blocks.read_split_exports(spark, str(tmp_path / "Export_5_y.csv")).collect()
    assert sorted((r.complaint_id, r.timely_response, r.narrative) for r in got) == [("1", "Yes", "a\r\nb"), ("2", "Yes", None)]
    bad = tmp_path / "Export_6_z.csv"
    bad.write_text(",".join(HEADER[::-1]) + "\n")
    with pytest.raises(csv_blocks.WrongHeader, match="Export_6"):
        csv_blocks.read_split_exports(spark, str(bad))
    empty = write_export(tmp_path, "Export_7_e.csv", [])
    assert csv_blocks.read_split_exports(spark, empty).collect() == []


def test_chunks_are_bounded_in_bytes(spark, tmp_path):
    rows = [row(i, narrative="\n".join(["w" * 900] * 20), company='a "b"') for i in range(200)] + [row(200, narrative="v" * 1_000_000)]
    path = write_export(tmp_path, "Export_4_x.csv", rows)
    chunks = csv_blocks._chunks(csv_blocks._lines(spark, path))
    sizes = [r.n for r in chunks.selectExpr("octet_length(text) AS n").collect()]
    assert len(sizes) > 10 and sum(n > 2 * csv_blocks.CHUNK for n in sizes) == 1
    got = csv_blocks.read_split_exports(spark, path)
    assert rows_of(got) == rows_of(exports.read_exports(spark, path))
