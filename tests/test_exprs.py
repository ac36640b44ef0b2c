import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from caselens.functions import exprs as X


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_share_is_null_without_a_denominator(spark):
    nan = F.lit(float("nan"))
    r = one(spark, X.share(F.lit(1), F.lit(4)), X.share(F.lit(1), F.lit(0)), X.share(F.lit(1), nan), X.share(F.lit(1), F.lit(None)))
    assert tuple(r) == (0.25, None, None, None)


def test_wilson_known_values_and_bounds(spark):
    cases = [(10, 100), (0, 20), (20, 20), (0, 0)]
    df = spark.createDataFrame(cases, "k int, n int")
    low, high = X.wilson_bounds(F.col("k"), F.col("n"))
    got = {(r.k, r.n): (r.low, r.high) for r in df.select("k", "n", low.alias("low"), high.alias("high")).collect()}
    assert got[10, 100] == pytest.approx((0.0552, 0.1744), abs=5e-4)
    assert got[0, 20][0] == 0.0 and got[20, 20][1] == 1.0
    assert all(math.isnan(x) for x in got[0, 0])


def test_kish_size(spark):
    def size(weights):
        df = spark.createDataFrame([(w,) for w in weights], "w double")
        return df.agg(X.kish_size("w")).first()[0]

    assert size([1.0] * 10) == pytest.approx(10)
    assert size([9.0, 1.0]) == pytest.approx(100 / 82)
    assert size([]) == 0.0


def test_two_roundings(spark):
    r = one(
        spark,
        X.round_up(F.lit(1.005), 2), X.round_up(F.lit(12.125), 2), X.round_even(F.lit(12.125), 2),
        X.round_even(F.lit(-0.001), 2),
    )
    assert tuple(r) == (1.0, 12.13, 12.12, 0.0)
    assert math.copysign(1, r[3]) == 1


@pytest.mark.parametrize("month, offset", [("2025-06-01", 0), ("2025-03-01", -3), ("2025-11-01", 5), ("2026-02-01", 8)])
def test_months_from(spark, month, offset):
    at = F.lit("2025-06-01").cast("date")
    assert one(spark, X.months_from(at, F.lit(month).cast("date")))[0] == offset


def test_calendar(spark):
    d = F.lit("2024-08-17").cast("date")
    assert tuple(one(spark, X.month_start(d), X.quarter_label(d))) == (dt.date(2024, 8, 1), "2024-Q3")


def test_ascii_and_unicode_word_edges(spark):
    text = F.lit("éplatinum card")
    r = one(spark, text.rlike(X.ascii_regex(r"\bplatinum\b")), text.rlike(X.unicode_regex(r"\bplatinum\b")))
    assert tuple(r) == (True, False)


def test_draw_key_ignores_partitioning(spark):
    ids = spark.range(500)
    a = [r.id for r in ids.orderBy(X.draw_key("id", 7)).collect()]
    b = [r.id for r in ids.repartition(13).orderBy(X.draw_key("id", 7)).collect()]
    assert a == b and a != sorted(a)
