import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from farescope.functions import scalars as S


def value(spark, column, **inputs):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()]).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "type_name", "want"),
    [
        ("12.345", "decimal(18,2)", D("12.35")),
        ("  7 ", "decimal(18,2)", D("7.00")),
        ("", "decimal(18,2)", None),
        ("None", "decimal(18,2)", None),
        ("abc", "decimal(18,2)", None),
        (None, "decimal(18,2)", None),
        ("191", "int", 191),
        ("191.0", "int", 191),
        ("191.5", "int", None),
        ("M/L", "double", None),
        ("nan", "double", None),
        ("2.5", "double", 2.5),
        ("2025-08-06", "date", dt.date(2025, 8, 6)),
        ("2025-08-06 00:00:00", "date", dt.date(2025, 8, 6)),
        ("2025-13-06", "date", None),
        ("2025", "date", None),
        (" kept ", "string", " kept "),
    ],
)
def test_parse(spark, text, type_name, want):
    assert value(spark, S.parse(F.col("x").cast("string"), type_name), x=text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("05-08-2025 08:00:00", dt.datetime(2025, 8, 5, 8)),
        ("31-02-2025 08:00:00", None),
        ("2025-08-05 08:00:00", None),
        ("soon", None),
    ],
)
def test_parse_stamp(spark, text, want):
    assert value(spark, S.parse_stamp(F.col("x")), x=text) == want


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("file:/in/seat_prices_2025-07-31_08-05.csv", dt.datetime(2025, 7, 31, 8, 5)),
        ("/in/seat_prices_with_DT_2025-07-31_08-05.csv", dt.datetime(2025, 7, 31, 8, 5)),
        ("/in/seat_prices_2025-07-31_08-05.csv/part-0001.csv", dt.datetime(2025, 7, 31, 8, 5)),
        ("/in/seat_prices_2025-07-31.csv", None),
        ("/in/seat_prices_2025-07-31_99-05.csv", None),
    ],
)
def test_file_stamp(spark, path, want):
    assert value(spark, S.file_snapshot_ts(F.col("x")), x=path) == want


@pytest.mark.parametrize(
    ("actual", "model", "delta", "pct", "pct_actual", "status"),
    [
        (D("120"), D("100"), 20, 20.0, -100 / 6, S.BAD),
        (D("80"), D("100"), -20, -20.0, 25.0, S.GOOD),
        (D("5"), D("0"), 5, 0.0, 0.0, S.BAD),
        (D("0"), D("5"), -5, -100.0, 0.0, S.GOOD),
        (D("5"), D("5"), 0, 0.0, 0.0, S.NEUTRAL),
        (None, D("5"), 0, 0.0, 0.0, S.NEUTRAL),
        (D("5"), None, 0, 0.0, 0.0, S.NEUTRAL),
    ],
)
def test_delta(spark, actual, model, delta, pct, pct_actual, status):
    a, m = (F.col(c).cast("decimal(18,2)") for c in "am")
    assert value(spark, S.delta(a, m), a=actual, m=model) == delta
    assert value(spark, S.delta_percent(a, m), a=actual, m=model) == pytest.approx(pct)
    assert value(spark, S.delta_percent_of_actual(a, m), a=actual, m=model) == pytest.approx(pct_actual)
    assert value(spark, S.status(a, m), a=actual, m=model) == status


def test_week_starts_on_sunday(spark):
    for day, want in [("2025-08-03", "2025-08-03"), ("2025-08-06", "2025-08-03"), ("2025-08-09", "2025-08-03")]:
        assert str(value(spark, S.week_start(F.col("d").cast("date")), d=day)) == want


@pytest.mark.parametrize(
    ("text", "wanted", "match"),
    [("24", 24, True), ("24.009", 24, True), ("24.02", 24, False), ("-24", 24, False), ("soon", "soon", True),
     ("24.0", "24", True), ("soon", 24, False)],
)
def test_near_hour_text(spark, text, wanted, match):
    assert value(spark, S.near_hour_text(F.col("h"), wanted), h=text) is match


def test_near_hour(spark):
    for h, match in [(24.0, True), (24.0099, True), (23.99, False), (24.01, False)]:
        assert value(spark, S.near_hour(F.col("h"), 24.0), h=h) is match


def test_small_helpers(spark):
    assert value(spark, S.hour_label(F.col("h")), h=24.0) == "24"
    assert value(spark, S.hour_label(F.col("h")), h=2.5) == "2.5"
    assert value(spark, S.demand_grade(F.col("d")), d="M/L") == "M/L"
    assert value(spark, S.demand_value(F.col("d")), d="0.8") == 0.8
    assert value(spark, S.blank_else(F.col("a"), F.col("b")), a="", b="x") == "x"
    assert value(spark, S.blank_as_zero(F.col("a")), a="abc") == 0
    assert value(spark, S.month_name(F.col("d").cast("date")), d="2025-07-31") == "July"
    first, following = S.month_bounds(F.col("d").cast("date"))
    assert str(value(spark, first, d="2025-12-31")) == "2025-12-01"
    assert str(value(spark, following, d="2025-12-31")) == "2026-01-01"
    as_of = F.lit("2025-08-06").cast("date")
    for text, past in [("2025-08-05", True), ("2025-08-06", False), ("x", False), ("", False)]:
        assert value(spark, S.is_past(F.col("d"), as_of), d=text) is past


def test_hours_between_crosses_days(spark):
    start, end = F.col("a").cast("timestamp_ntz"), S.departure_ts(F.lit("2025-08-06").cast("date"), F.lit("10:00:00"))
    assert value(spark, S.hours_between(start, end), a="2025-08-05 08:30:00") == 25.5
    assert value(spark, S.hours_between(start, end), a="2025-08-06 11:00:00") == -1.0
