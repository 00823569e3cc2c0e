"""Scalar helpers: calendar edges (D3, D5, D6, D8) and array / code-vector helpers."""

import datetime as dt

from pyspark.sql import functions as F

from shoplens.functions import arrays as A
from shoplens.functions import dates as D


def test_year_week_sunday_matches_strftime(spark):
    start = dt.date(2019, 1, 1)
    days = [start + dt.timedelta(days=i) for i in range(2500)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = dict(df.select("d", D.year_week_sunday("d").alias("w")).collect())
    assert all(got[d] == d.strftime("%Y-%U") for d in days)


def test_calendar_windows_on_first_of_month(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 1),), (dt.date(2024, 3, 15),)], "a date")
    w = D.calendar_windows(F.col("a"))
    rows = df.select("a", *[b.alias(f"{k}_{i}") for k, (lo, hi) in w.items() for i, b in ((0, lo), (1, hi))]) \
        .orderBy("a").collect()
    first, mid = rows
    assert (first.last_week_0, first.last_week_1) == (dt.date(2024, 2, 24), dt.date(2024, 3, 1))
    assert (first.prev_week_0, first.prev_week_1) == (dt.date(2024, 2, 17), dt.date(2024, 2, 23))
    assert (first.last_month_0, first.last_month_1) == (dt.date(2024, 2, 1), dt.date(2024, 2, 29))
    assert (first.prev_month_0, first.prev_month_1) == (dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    assert (mid.last_month_0, mid.last_month_1) == (dt.date(2024, 3, 1), dt.date(2024, 3, 31))
    assert (mid.prev_month_0, mid.prev_month_1) == (dt.date(2024, 2, 1), dt.date(2024, 2, 29))


def test_whole_days_floor_elapsed_time(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 3, 0)),
                                (dt.datetime(2024, 1, 1, 0), dt.datetime(2024, 1, 1, 23, 59))], "s timestamp, e timestamp")
    got = [r[0] for r in df.select(D.whole_days("s", "e")).collect()]
    assert got == [1, 0]
    frac = df.select(D.fractional_days("s", "e")).first()[0]
    assert abs(frac - 1.5) < 1e-12


def test_day_index_counts_calendar_days(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 23, 0), dt.date(2024, 1, 1))], "t timestamp, f date")
    assert df.select(D.day_index("t", "f")).first()[0] == 4


def test_last_n_keeps_short_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1],), ([],)], "a array<int>")
    got = [r[0] for r in df.select(A.last_n("a", 2)).collect()]
    assert got == [[2, 3], [1], []]


def test_code_vectors(spark):
    df = spark.createDataFrame([("[11 2 3]",), ("[ 7  8 ]",), ("[1 -2]",), ("[]",)], "s string")
    rows = df.select(A.codes_to_array("s").alias("a"), A.is_code_vector("s").alias("ok"),
                     A.codes_text("s").alias("t")).collect()
    assert [r.a for r in rows] == [[11, 2, 3], [7, 8], [1, 2], []]
    assert [r.ok for r in rows] == [True, True, False, True]
    assert [r.t for r in rows] == ["11 2 3", "7 8", "1 2", ""]


def test_position_of(spark):
    df = spark.createDataFrame([([5, 6, 7], 6), ([5], 9)], "a array<long>, v long")
    assert [r[0] for r in df.select(A.position_of("a", "v")).collect()] == [2, 0]
