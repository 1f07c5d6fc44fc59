"""Hand-made feed files whose results are known."""

import datetime as dt
import os
from decimal import Decimal as D

import pytest
from conftest import rows
from pyspark.sql import functions as F

from farescope.operators import (
    choices, compare, filters, lookups, quality, rollups, seats as seat_ops, trends, views,
)
from farescope.schemas import FEEDS, SEAT_PRICES, SEAT_WISE_PRICES
from farescope.sources import feeds, store

T1, T2, T3 = (dt.datetime(2025, m, d, 8) for m, d in ((7, 31), (8, 5), (8, 6)))
DAY = dt.date(2025, 8, 6)


def test_schema_matches_feed(snaps, seats):
    assert snaps.schema == SEAT_PRICES.silver_schema
    assert seats.schema == SEAT_WISE_PRICES.silver_schema


def test_typed_rows(snaps):
    got = rows(snaps, "seat_type", "hours_before_departure", "actual_fare", "price", "snapshot_ts")
    assert got == [
        ("A", 10.0, D("100.00"), D("90.00"), T1),
        ("A", 2.0, D("120.00"), D("125.00"), T2),
        ("B", 0.0, None, D("70.00"), T3),
        ("B", 10.0, None, D("80.00"), T1),
        ("B", 2.0, D("60.00"), None, T2),
    ]
    assert rows(snaps.select("week_start").distinct()) == [(dt.date(2025, 8, 3),)]
    assert rows(snaps.select("snapshot_date", "snapshot_time").distinct())[0] == (T1.date(), "08:00:00")


def test_latest_is_by_time_not_text(snaps):
    got = rows(views.seat_prices_latest(snaps), "seat_type", "snapshot_ts")
    assert got == [("A", T2), ("B", T3)]
    assert rows(views.seat_prices_latest(snaps, unique=True), "seat_type", "snapshot_ts") == got


def test_second_load_adds_nothing(spark, feed_folders, store_base, snaps):
    assert store.load_all(spark, feed_folders, store_base) == {"seat_prices": 0, "seat_wise_prices": 0}
    paths = [r.path for r in feeds.list_files(spark, feed_folders["seat_prices"]).collect()]
    again = feeds.typed(feeds.read_feed(spark, SEAT_PRICES, paths), SEAT_PRICES)
    assert again.count() == 6
    assert store.insert_ignore(again, store_base, SEAT_PRICES) == 0
    assert snaps.count() == 5


def test_model_price_falls_back_to_actual(snaps):
    got = rows(lookups.price_triples(snaps))
    assert ("S1", "B", 2.0, D("60.00"), D("60.00"), D("0.00"), "neutral") in got
    assert ("S1", "A", 2.0, D("120.00"), D("125.00"), D("5.00"), "favourable") in got
    assert ("S1", "A", 10.0, D("100.00"), D("90.00"), D("10.00"), "unfavourable") in got


@pytest.mark.parametrize(
    ("asked", "matched", "stamp"),
    [(9.0, 10.0, T1), (6.0, 2.0, T2), (2.0, 2.0, T2), (2.009, 2.0, T2), (0.5, 0.0, T3), (500.0, 10.0, T1)],
)
def test_nearest_hour(spark, snaps, asked, matched, stamp):
    want = [("S1", asked, matched, stamp)]
    columns = ("schedule_id", "requested_hours", "matched_hours", "snapshot_ts")
    assert rows(lookups.nearest_snapshots(snaps, [asked]), *columns) == want
    requests = spark.createDataFrame([("S1", asked), ("S9", asked)], "schedule_id string, requested_hours double")
    assert rows(lookups.nearest_snapshots_for(snaps, requests), *columns) == want


def test_nearest_prices_keep_listed_seat_types(spark, snaps, seats):
    columns = ("requested_hours", "seat_type", "actual_price", "model_price")
    want = [(9.0, "A", D("100.00"), D("90.00")), (9.0, "B", None, D("80.00"))]
    assert rows(lookups.nearest_hour_prices(snaps, [9.0]), *columns) == want
    only_a = seats.filter("seat_type = 'A'")
    assert rows(lookups.nearest_hour_prices(snaps, [9.0], only_a), *columns) == want[:1]
    requests = spark.createDataFrame([("S1", 9.0)], "schedule_id string, requested_hours double")
    assert rows(lookups.nearest_hour_prices(snaps, requests), *columns) == want


def test_kpi_means(snaps):
    got = rollups.kpi_means(snaps).first()
    assert got.avg_actual_fare == 56.0
    assert got.avg_model_price == 73.0
    assert got.avg_delta == -17.0
    assert got.avg_delta_pct == -23.29
    assert got.avg_occupancy == 40.2
    ignore = rollups.kpi_means(snaps, blanks="ignore").first()
    assert ignore.avg_actual_fare == 93.33
    assert ignore.avg_model_price == 91.25
    assert rollups.kpi_means(snaps.filter("false")).first().avg_actual_fare == 0
    with pytest.raises(ValueError):
        rollups.kpi_means(snaps, blanks="drop")


def test_occupancy_trend(snaps):
    got = rows(trends.occupancy_trend(snaps), "seat_type", "hours_before_departure", "actual_occupancy")
    assert got == [
        ("A", 10.0, D("50.00")), ("A", 2.0, D("70.00")), ("B", 0.0, D("41.00")), ("B", 2.0, D("40.00")),
    ]
    by_hour = rows(lookups.occupancy_by_hour(snaps))
    assert ("S1", "B", 10.0, D("0.00"), D("0.00")) in by_hour


def test_demand_split(snaps):
    got = rows(lookups.demand_index(snaps), "seat_type", "hours_before_departure", "demand_grade", "demand_value")
    assert got == [("A", 10.0, "M/L", None), ("A", 2.0, None, 0.8), ("B", 0.0, "H", None), ("B", 2.0, None, 1.0)]


def test_price_sum_by_hour(snaps, seats):
    got = rows(trends.price_sum_by_hour(seats, snaps))
    assert got == [
        ("S1", "A", 10.0, D("100.00"), D("90.00"), 1),
        ("S1", "A", 2.0, D("240.00"), D("255.00"), 2),
        ("S1", "B", 2.0, D("60.00"), D("55.00"), 1),
    ]


def test_date_summaries(snaps, seats):
    assert rows(rollups.date_summary_seat(seats, snaps)) == [
        (DAY, D("300.00"), D("310.00"), D("-10.00"), D("10.00"), "favourable")
    ]
    # Lowest hours: A at 2 (120 / 125), B at 0 (blank / 70).
    assert rows(rollups.date_summary_schedule(snaps), "actual_sum", "model_sum") == [(D("120.00"), D("195.00"))]
    assert rollups.date_summary_schedule(snaps, as_of="2025-08-06").count() == 0
    assert rollups.date_summary_schedule(snaps, as_of="2025-08-07").count() == 1
    assert rollups.date_summary_schedule(snaps, day="2025-08-06").count() == 1
    assert rollups.date_summary_schedule(snaps, day="2025-08-07").count() == 0
    one_day = rollups.date_summary_seat(seats, snaps, day="2025-08-06")
    assert rows(one_day, "actual_sum") == [(D("300.00"),)]
    nothing = rollups.date_summary_seat(seats.filter("false"), snaps)
    assert rows(nothing, "actual_sum", "model_sum", "status") == [(D("0.00"), D("0.00"), "neutral")]


def test_monthly(snaps, seats):
    # The schedule's lowest hour is 0, where only B has a row.
    assert rows(rollups.monthly_delta_schedule(snaps)) == [(2025, 8, 1, D("0.00"), D("70.00"), D("-70.00"))]
    assert rows(rollups.monthly_delta_seat(seats, snaps)) == [(2025, 8, 1, D("300.00"), D("310.00"), D("-10.00"))]


def test_monthly_of_one_month(snaps, seats):
    for year, month, n in ((2025, 8, 1), (2025, 7, 0), (None, 8, 1), (2024, None, 0)):
        assert rollups.monthly_delta_schedule(snaps, year, month).count() == n
        assert rollups.monthly_delta_seat(seats, snaps, year, month).count() == n


def test_totals(snaps, seats):
    got = rows(rollups.total_seat_prices(seats, snaps))
    assert got == [
        ("S1", 10.0, D("100.00"), D("90.00"), 1, D("10.00")),
        ("S1", 2.0, D("300.00"), D("310.00"), 3, D("-10.00")),
    ]
    picked = lookups.seat_rows(seats, snaps, "S1", 2, "2025-08-06")
    assert rows(rollups.seat_totals(picked)) == [(D("300.00"), D("310.00"), 3, D("-10.00"))]
    none = lookups.seat_rows(seats, snaps, "S1", 3)
    assert rows(rollups.seat_totals(none)) == [(0, 0, 0, 0)]


def test_seats_at_hour_and_latest(snaps, seats):
    got = rows(lookups.seats_by_hour(seats, snaps), "hours_before_departure", "seat_number")
    assert got == [(10.0, "1"), (2.0, "1"), (2.0, "10"), (2.0, "2")]
    table = seat_ops.in_seat_order(seat_ops.seat_price_table(lookups.seats_latest(seats)))
    assert [r.seat_number for r in table.collect()] == ["1", "2", "10"]
    details = {r.seat_number: r for r in seat_ops.seat_details(lookups.seats_latest(seats)).collect()}
    assert details["10"].price_diff == D("-5.00")
    assert details["10"].price_diff_pct == pytest.approx(-100 / 12)


def test_journey_dates(snaps, seats):
    assert rows(lookups.journey_dates(seats, snaps), "snapshot_ts", "date_of_journey") == [(T1, DAY), (T2, DAY)]
    assert rows(lookups.journey_dates(seats, snaps, hours=2), "snapshot_ts") == [(T2,)]


def test_filters(snaps):
    assert filters.filtered(snaps).count() == 5
    assert filters.filtered(snaps, "S1", 191, "A", 2, "2025-08-06").count() == 1
    assert filters.filtered(snaps, date_of_journey="2025-08-07").count() == 0
    assert filters.of_schedule_text(snaps, "  S1 ").count() == 5
    assert filters.of_seat(snaps.withColumn("seat_number", F.lit(7)), "7").count() == 5
    assert filters.filtered(snaps, departure_time=None, operator_id=296).count() == 0
    newest = filters.filtered(snaps, newest_first=True).first()
    assert newest.snapshot_ts == T3
    plan = filters.on_date(snaps, "date_of_journey", "2025-08-06")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(week_start" in plan
    zero = filters.snapshots_in_month_at_zero_hour(snaps, "2025-08-20")
    assert rows(zero, "seat_type") == [("B",)]


def test_fallback(spark, snaps):
    timed = snaps.filter("seat_type = 'A'")
    got = filters.with_fallback(timed, snaps, ["schedule_id", "seat_type"])
    assert got.count() == 5
    assert filters.table_or(spark, "no_such_table", snaps, ["schedule_id"]).count() == 5
    timed.createOrReplaceTempView("timed_rows")
    assert filters.table_or(spark, "timed_rows", snaps, ["schedule_id"]).count() == 2


def test_choices(spark, snaps, seats):
    assert rows(choices.seat_type_choices(seats, snaps, "S1")) == [("A",), ("B",)]
    assert rows(choices.seat_type_choices(seats.filter("seat_type = 'A'"), snaps, "S1")) == [("A",)]
    assert rows(choices.seat_type_choices(seats, snaps, "S7")) == [("A",), ("B",)]
    assert rows(choices.seat_type_choices(seats, snaps)) == [("A",), ("B",)]
    assert rows(choices.distinct_hours(snaps), "hours_label") == [("0",), ("10",), ("2",)]
    assert rows(choices.schedules_on(snaps, "2025-08-06")) == [("S1",)]
    assert rows(choices.seat_types_count(seats)) == [("S1", 2)]
    assert rows(choices.seat_types_count(seats, approximate=True)) == [("S1", 2)]
    until = choices.seat_types_until(
        views.actual_price_view(snaps), views.model_price_view(snaps), "S1", "2025-07-31 08:00:00"
    )
    assert rows(until) == [("A",), ("B",)]
    names = choices.dimension_from(spark, choices.OPERATOR_NAMES)
    named = choices.with_name(snaps, names, "operator_id", "id", "name", "operator_name")
    assert rows(named.select("operator_name").distinct()) == [(choices.OPERATOR_NAMES[191],)]


def test_quality(spark, snaps, seats):
    got = {r.column_name: r for r in quality.profile(snaps).collect()}
    assert got["actual_fare"].null_count == 2
    assert got["departure_time" if "departure_time" in got else "price"].row_count == 5
    extent = quality.date_extent([(snaps, "date_of_journey"), (seats, "travel_date")], "2025-01-01")
    assert rows(extent) == [(DAY, DAY)]
    empty = quality.date_extent([(snaps.filter("false"), "date_of_journey")], "2025-01-31")
    assert rows(empty) == [(dt.date(2025, 1, 1), dt.date(2025, 3, 2))]
    assert quality.columns_present(snaps, ["SEAT_TYPE", "departure_time"]) == {
        "SEAT_TYPE": True, "departure_time": False,
    }
    months = rows(quality.month_hour_fallback(snaps))
    assert months == [(dt.date(2025, 7, 1), 10.0, 1), (dt.date(2025, 8, 1), 0.0, 1)]


def test_month_hour_counts_schedules_not_rows(spark):
    data = [("S1", 3.0, T1), ("S1", 3.0, T1.replace(hour=9)), ("S2", 3.0, T1), ("S3", 5.0, T1)]
    df = spark.createDataFrame(data, "schedule_id string, hours_before_departure double, snapshot_ts timestamp_ntz")
    assert rows(quality.month_hour_fallback(df)) == [(dt.date(2025, 7, 1), 3.0, 2)]


def test_rejects(spark, feed_folders):
    paths = [r.path for r in feeds.list_files(spark, feed_folders["seat_prices"]).collect()]
    raw = feeds.read_feed(spark, SEAT_PRICES, paths)
    got = {r.column_name: r.reject_count for r in quality.rejects(raw, SEAT_PRICES).collect()}
    assert got["actual_fare"] == 1
    assert sum(got.values()) == 1


def test_header_traps(spark, tmp_path):
    (tmp_path / "seat_wise_prices_2025-01-01_06-30.csv").write_text(
        "﻿Seat_Type, schedule_id ,actual_fare\nA,007,100.50\n"
    )
    (tmp_path / "seat_wise_prices_2025-01-02_06-30.csv").write_text(
        'schedule_id,junk,"seat_type",actual_fare\nS2,zz,B,\nS3,zz,"price",7\n'
    )
    (tmp_path / "notes.txt").write_text("schedule_id\n1\n")
    paths = [r.path for r in feeds.list_files(spark, str(tmp_path)).collect()]
    raw = feeds.read_feed(spark, SEAT_WISE_PRICES, paths)
    assert rows(raw, "seat_type", "schedule_id", "actual_fare") == [
        ("A", "007", "100.50"), ("B", "S2", None), ("price", "S3", "7"),
    ]
    typed = feeds.typed(raw, SEAT_WISE_PRICES)
    assert rows(typed, "schedule_id", "actual_fare", "snapshot_ts")[0] == (
        "007", D("100.50"), dt.datetime(2025, 1, 1, 6, 30),
    )


def test_quoted_values(spark, tmp_path):
    (tmp_path / "seat_wise_prices_2025-01-01_06-30.csv").write_text(
        'schedule_id,seat_type,actual_fare\n"S,1","Semi ""A"", low",7\nS2,NA,NaN\n\n'
    )
    raw = feeds.read_feed(spark, SEAT_WISE_PRICES, [str(tmp_path / "seat_wise_prices_2025-01-01_06-30.csv")])
    assert rows(raw, "schedule_id", "seat_type", "actual_fare") == [
        ("S,1", 'Semi "A", low', "7"), ("S2", None, None),
    ]


def test_filters_reach_the_scan(spark, snaps):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    picked = filters.filtered(snaps, schedule_id="S1", hours=2, date_of_journey="2025-08-06")
    plan = picked.select("actual_fare")._jdf.queryExecution().executedPlan().toString()
    for part in (
        "GreaterThan(hours_before_departure,1.99)", "LessThan(hours_before_departure,2.01)",
        "EqualTo(schedule_id,S1)", "EqualTo(date_of_journey,2025-08-06)", "week_start#",
    ):
        assert part in plan, part
    assert "seat_type" not in plan.split("ReadSchema")[1]
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_kpi_cards(snaps):
    columns = ("requested_hours", "seat_type", "actual_price", "model_price", "actual_occupancy", "demand_grade")
    assert rows(lookups.kpi_cards(snaps, [2, 9.5]), *columns) == [
        (2.0, "A", D("120.00"), D("125.00"), D("70.00"), None),
        (2.0, "B", D("60.00"), None, D("40.00"), None),
        (9.5, "A", D("100.00"), D("90.00"), D("0.00"), None),
        (9.5, "B", None, D("80.00"), D("0.00"), None),
    ]


def test_unparsable_name_gives_no_stamp_and_no_row(spark, tmp_path):
    (tmp_path / "seat_wise_prices_latest.csv").write_text("schedule_id,seat_number,travel_date\nS1,1,2025-01-01\n")
    raw = feeds.read_feed(spark, SEAT_WISE_PRICES, [str(tmp_path / "seat_wise_prices_latest.csv")])
    typed = feeds.typed(raw, SEAT_WISE_PRICES)
    assert rows(typed, "snapshot_date", "snapshot_time", "snapshot_ts") == [(None, None, None)]
    assert store.insert_ignore(typed, str(tmp_path / "t"), SEAT_WISE_PRICES) == 0


def test_equal_names_in_two_feeds_are_both_loaded(spark, tmp_path):
    name = "x_2025-01-01_06-30.csv"
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    (a / name).write_text("schedule_id,seat_type,date_of_journey\nS1,A,2025-01-01\n")
    (b / name).write_text("schedule_id,seat_number,travel_date\nS1,1,2025-01-01\n")
    got = store.load_all(spark, {"seat_prices": str(a), "seat_wise_prices": str(b)}, str(tmp_path / "t"))
    assert got == {"seat_prices": 1, "seat_wise_prices": 1}


def test_migrate_takes_a_half_open_window(spark, snaps, tmp_path):
    base = str(tmp_path)
    assert store.migrate(snaps, base, SEAT_PRICES, "2025-08-01", "2025-08-06") == 0
    assert store.migrate(snaps, base, SEAT_PRICES, "2025-08-06", "2025-08-07") == 5
    assert store.migrate(snaps, base, SEAT_PRICES, "2025-08-01", "2025-09-01") == 0


def test_weeks_between_the_first_and_last_are_compared(spark, snaps, tmp_path):
    base = str(tmp_path)
    store.insert_ignore(snaps, base, SEAT_PRICES)
    later = snaps.withColumn("week_start", F.date_add("week_start", 7)).withColumn(
        "date_of_journey", F.date_add("date_of_journey", 7)
    )
    both = snaps.unionByName(later)
    assert store.insert_ignore(both, base, SEAT_PRICES) == 5
    assert store.insert_ignore(both, base, SEAT_PRICES) == 0


def test_common_columns(snaps):
    odd = snaps.select(F.col("seat_type").alias(" Seat_Type "), "price", F.lit(1).alias("extra"))
    assert store.common_columns(odd, SEAT_PRICES.columns).columns == ["seat_type", "price"]


def test_columns_of_another_frame_are_added(snaps):
    wider = store.with_columns_of(snaps.select("price"), snaps.select("PRICE", "seat_type"))
    assert wider.dtypes == [("price", "decimal(18,2)"), ("seat_type", "string")]


def test_views_and_sql(spark, snaps, seats):
    names = views.register_views(spark, snaps, seats, snaps.withColumn("departure_time", F.lit("10:00:00")), seats)
    assert "dateofjourney" in names
    got = views.run_sql(
        spark, "SELECT schedule_id FROM dateofjourney WHERE date_of_journey = :d AND snapshot_ts = :t", d=DAY, t=T1
    )
    assert rows(got) == [("S1",)]
    hours = rows(spark.table("computed_hours"), "snapshot_ts", "hours_before_departure")
    assert hours == [(T2, 26.0), (T3, 2.0)]
    assert views.newest_first(snaps).first().snapshot_ts == T3


def test_optional_columns(snaps):
    latest = views.seat_prices_latest(snaps)
    model = views.latest_model_price_view(latest.withColumn("model_price", F.lit("1")))
    assert rows(model, "model_price") == [("1",), ("1",)]
    filled = views.with_defaults(snaps, {"sales_percentage": F.lit(0), "price": F.lit(1)})
    assert rows(filled.select("sales_percentage").distinct()) == [(0,)]
    assert rows(filled, "price") == rows(snaps, "price")


def test_compare(spark):
    data = [
        # operator, date, time, schedule, seat type, stamp, fare, price
        (1, DAY, "08:00:00", "a", "X", T1, 10, 11),
        (1, DAY, "08:00:00", "a", "X", T2, 12, 13),
        (2, DAY, "08:00:00", "b", "X", T1, 20, 21),
        (2, DAY, "09:00:00", "b2", "Y", T1, 5, 6),
        (3, DAY, "08:00:00", "c", "Y", T2, 30, 31),
        (2, DAY, None, "d", "X", T2, 40, 41),
    ]
    df = spark.createDataFrame(
        data,
        "operator_id int, date_of_journey date, departure_time string, schedule_id string, seat_type string,"
        " snapshot_ts timestamp_ntz, actual_fare int, price int",
    ).withColumn("hours_before_departure", F.lit(1.0))
    assert rows(compare.matching_times(df, 1)) == [(2, DAY, "08:00:00"), (3, DAY, "08:00:00")]
    assert rows(compare.matching_times(df, 1, same_seat_type=True)) == [(2, DAY, "08:00:00")]
    assert rows(compare.matching_times(df, 1, 3, same_seat_type=True)) == []
    assert rows(compare.match_counts(df, [1])) == [(1, 2, DAY, "08:00:00", 2), (1, 3, DAY, "08:00:00", 2)]
    assert rows(compare.common_slots(df, 1, 2)) == [("08:00:00", DAY)]
    stats = rows(compare.compare_stats(compare.seat_type_offers(df, 1)))
    got = {
        r.actual_operator: (r.model_total, r.actual_total, r.price_diff)
        for r in compare.compare_stats(compare.seat_type_offers(df, 1)).collect()
    }
    assert got == {2: (13, 20, 7), 3: (13, 30, 17)}
    assert len(stats) == 2
    assert rows(filters.other_operators(df, 2)) == [(1,), (3,)]


def test_monthly_card_sample(spark):
    df = spark.createDataFrame(
        [(D("25000.50"), D("22500.75")), (D("24800.25"), D("22300.50"))], "actual_fare decimal(18,2), price decimal(18,2)"
    )
    assert [r.delta for r in trends.price_trend(df).collect()] == [D("2499.75"), D("2499.75")]


def test_feed_keys():
    assert FEEDS["seat_prices"].primary_key == ["date_of_journey", "schedule_id", "seat_type", "snapshot_ts"]
    assert len(FEEDS["seat_prices_with_dt"].columns) == 16


def test_quoted_line_breaks_stay_in_their_value(spark, tmp_path):
    path = tmp_path / "seat_wise_prices_2025-01-01_06-30.csv"
    path.write_text('schedule_id,seat_type,seat_number\n"S\n1","two\n""lines"",\n",7\nS2,B,8\n')
    raw = feeds.read_feed(spark, SEAT_WISE_PRICES, [str(path)])
    got = rows(raw, "schedule_id", "seat_type", "seat_number")
    assert got == sorted([("S\n1", 'two\n"lines",\n', "7"), ("S2", "B", "8")])


def test_unpaired_quotes_are_plain_characters(spark, tmp_path):
    path = tmp_path / "seat_wise_prices_2025-01-01_06-30.csv"
    path.write_text('schedule_id,seat_type,seat_number\nS1,5" wide,7\nS2,B,8\n')
    raw = feeds.read_feed(spark, SEAT_WISE_PRICES, [str(path)])
    assert rows(raw, "schedule_id", "seat_type", "seat_number") == [("S1", '5" wide', "7"), ("S2", "B", "8")]


def test_files_without_a_header_are_rejected(spark, tmp_path):
    folder, base = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    (folder / "seat_wise_prices_2025-01-01_06-30.csv").write_text("1,2,3\n4,5,6\n")
    (folder / "seat_wise_prices_2025-01-01_07-30.csv").write_text("")  # holds nothing, is not listed
    (folder / "seat_wise_prices_2025-01-01_08-30.csv").write_text(
        "schedule_id,seat_number,travel_date\nS1,1,2025-01-02\n"
    )
    assert store.load_folder(spark, str(folder), base, SEAT_WISE_PRICES) == 1
    assert store.load_folder(spark, str(folder), base, SEAT_WISE_PRICES) == 0
    bad = sorted(r.path[-9:] for r in store.rejected_files(spark, base).collect())
    assert bad == ["06-30.csv"]
    done = spark.read.parquet(store.ledger_path(base))
    assert [r.path[-9:] for r in done.collect()] == ["08-30.csv"]


def blocks_of(spark, path, size):
    """The lines of a file as a scan in blocks of ``size`` bytes lands them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        return feeds.land(feeds.read_lines(spark, [str(path)]))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_file_is_divided_whatever_its_quotes(spark, tmp_path):
    """Values with line breaks within and across blocks; csv is the judge."""
    import csv
    import random

    rng = random.Random(4)
    path = tmp_path / "seat_wise_prices_2025-01-01_06-30.csv"
    with path.open("w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(["seat_type", "note", "seat_number", "schedule_id"])
        for i in range(400):
            long = "\n".join(rng.choice(("x", 'say ""', "a,b", "", "y" * 90)) for _ in range(rng.choice((1, 1, 1, 2, 40))))
            out.writerow([rng.choice(("A", "B")), long, i, long[:50].strip() or "s"])
    lines = blocks_of(spark, path, 2000)
    assert lines.select("file_block_start").distinct().count() > 8
    raw, notes = feeds.parse_lines(lines, SEAT_WISE_PRICES)
    with path.open(newline="") as f:
        want = [(r["seat_type"], r["schedule_id"], r["seat_number"]) for r in csv.DictReader(f)]
    assert rows(raw, "seat_type", "schedule_id", "seat_number") == sorted(want)
    assert rows(notes, "unpaired", "has_header") == [(False, True)]
    plan = feeds.joined_records(lines)._jdf.queryExecution().optimizedPlan().toString()
    for window in (line for line in plan.splitlines() if " Window " in f" {line}" and "line_id" in line.split("[")[-1]):
        assert "file_block_start" in window  # lines are ordered by block, never by file


def test_scans_do_not_grow_with_headers(spark, tmp_path):
    names = ["schedule_id", "seat_type", "seat_number", "actual_fare"]
    for i in range(12):
        order = names[i % 4 :] + names[: i % 4] + [f"extra{i}"] * (i % 3)
        cells = {"schedule_id": f"S{i}", "seat_type": "A", "seat_number": str(i), "actual_fare": "7"}
        text = ",".join(order) + "\n" + ",".join(cells.get(c, "zz") for c in order) + "\n"
        (tmp_path / f"seat_wise_prices_2025-01-{i + 1:02d}_06-30.csv").write_text(text)
    paths = [r.path for r in feeds.list_files(spark, str(tmp_path)).collect()]
    raw = feeds.read_feed(spark, SEAT_WISE_PRICES, paths)
    assert rows(raw, *names) == sorted((f"S{i}", "A", str(i), "7") for i in range(12))
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2  # the lines and the headers


def test_unpaired_quotes_are_noted(spark, tmp_path):
    folder, base = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    (folder / "seat_wise_prices_2025-01-01_06-30.csv").write_text(
        'schedule_id,seat_number,travel_date,seat_type\nS1,1,2025-01-02,5" wide\nS2,1,2025-01-02,B\n'
    )
    (folder / "seat_wise_prices_2025-01-01_07-30.csv").write_text(
        'schedule_id,seat_number,travel_date,seat_type\n"S\n3",1,2025-01-02,B\n'
    )
    assert store.load_folder(spark, str(folder), base, SEAT_WISE_PRICES) == 3
    assert store.load_folder(spark, str(folder), base, SEAT_WISE_PRICES) == 0
    noted = store.rejected_files(spark, base).collect()
    assert [(r.path[-9:], r.reason) for r in noted] == [("06-30.csv", store.UNPAIRED)]
    assert rows(store.read_table(spark, base, SEAT_WISE_PRICES), "schedule_id") == [("S\n3",), ("S1",), ("S2",)]


def test_distant_weeks_are_read_alone(spark, tmp_path):
    """Insert-or-ignore reads the partitions of the weeks that occur, and tests keys before it shuffles them."""
    schema = "schedule_id string, seat_type string, date_of_journey date, snapshot_ts timestamp_ntz"
    days = [DAY + dt.timedelta(weeks=w) for w in range(12)]
    table = spark.createDataFrame([(f"S{i}", "A", d, T1) for d in days for i in range(30)], schema)
    base = str(tmp_path / "store")
    store.append(store.conform(table, SEAT_PRICES), base, SEAT_PRICES)
    new = store.conform(table.filter(F.col("date_of_journey").isin(days[0], days[9])), SEAT_PRICES)
    target = store.only_weeks_of(store.read_table(spark, base, SEAT_PRICES), new)
    scan = target._jdf.queryExecution().executedPlan().toString()
    pruned = scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "IN" in pruned and days[0].strftime("%Y-%m-%d") not in pruned and pruned.count("2025-") == 2
    assert target.count() == 60
    low = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1",
    }
    for k, v in low.items():
        spark.conf.set(k, v)
    new = new.persist()  # as a load does
    assert new.count() == 60
    try:
        plan = store.new_rows(new, target, SEAT_PRICES.primary_key)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k in low:
            spark.conf.unset(k)
    assert "might_contain" in plan and "bloom_filter_agg" in plan
    more = new.unionByName(store.conform(table.limit(1).withColumn("schedule_id", F.lit("new")), SEAT_PRICES))
    assert store.insert_ignore(more, base, SEAT_PRICES) == 1
    assert store.insert_ignore(more, base, SEAT_PRICES) == 0
    assert store.insert_ignore(more.limit(0), base, SEAT_PRICES) == 0


def test_a_table_takes_columns_it_has_not_seen(spark, snaps, tmp_path):
    from pathlib import Path

    base = str(tmp_path / "store")
    plain = store.grow(snaps, base, SEAT_PRICES)
    assert store.added_columns(spark, base, SEAT_PRICES) == []
    assert store.insert_ignore(plain, base, SEAT_PRICES) == 5
    old = {p: p.stat().st_mtime_ns for p in Path(base).rglob("*.parquet")}
    wider = snaps.withColumns({" Depot ": F.lit(7), "PRICE": F.col("price"), "schedule_id": F.concat(F.lit("x"), "schedule_id")})
    wider = store.grow(wider, base, SEAT_PRICES)
    assert wider.columns[-2:] == ["depot", "week_start"]
    assert store.insert_ignore(wider, base, SEAT_PRICES) == 5
    more = snaps.withColumns({"lane": F.lit("l"), "DEPOT": F.lit("d2"), "schedule_id": F.concat(F.lit("y"), "schedule_id")})
    assert store.insert_ignore(store.grow(more, base, SEAT_PRICES), base, SEAT_PRICES) == 5
    narrow = snaps.withColumn("schedule_id", F.concat(F.lit("z"), "schedule_id"))
    store.append(store.grow(narrow, base, SEAT_PRICES), base, SEAT_PRICES)
    assert store.added_columns(spark, base, SEAT_PRICES) == ["depot", "lane"]
    got = store.read_table(spark, base, SEAT_PRICES, every_column=True)
    seen = got.groupBy(F.substring("schedule_id", 1, 1).alias("load"), "depot", "lane").count()
    want = {("S", None, None, 5), ("x", "7", None, 5), ("y", "d2", "l", 5), ("z", None, None, 5)}
    assert {tuple(r) for r in seen.collect()} == want
    assert store.read_table(spark, base, SEAT_PRICES).columns == SEAT_PRICES.silver_schema.names
    assert {p: p.stat().st_mtime_ns for p in old} == old  # old files stay as they are


def test_small_loads_are_compacted_beside_a_reader(spark, tmp_path):
    from pathlib import Path

    base = str(tmp_path / "store")
    schema = "schedule_id string, seat_type string, date_of_journey date, snapshot_ts timestamp_ntz"
    days, compacted = [DAY, DAY + dt.timedelta(weeks=3)], 0
    reader = None
    for n in range(50):
        day = days[n % 5 == 0]
        part = spark.createDataFrame([(f"S{n}", "A", day, T1)], schema)
        if n == 20:  # a column that comes with a later load survives compaction
            part = part.withColumn("depot", F.lit("d"))
        store.append(store.grow(part, base, SEAT_PRICES), base, SEAT_PRICES)
        if n % 7 == 6:
            reader = store.read_table(spark, base, SEAT_PRICES)
            names = sorted(r.schedule_id for r in reader.select("schedule_id").collect())
            compacted += store.compact(spark, base, SEAT_PRICES, most_files=4)
            # A reader that had listed the files before goes on reading them.
            assert sorted(r.schedule_id for r in reader.select("schedule_id").collect()) == names
    assert compacted > 5
    table = store.read_table(spark, base, SEAT_PRICES, every_column=True)
    assert sorted(r.schedule_id for r in table.collect()) == sorted(f"S{n}" for n in range(50))
    assert [r.schedule_id for r in table.filter("depot = 'd'").collect()] == ["S20"]
    live = table.select("week_start", F.input_file_name().alias("f")).distinct().groupBy("week_start").count()
    assert max(r["count"] for r in live.collect()) <= 4 + 7
    assert len(list(Path(base).rglob("week_start=*/*.parquet"))) < 40  # of 50 loads and what was rewritten
    again = store.conform(spark.createDataFrame([("S3", "A", DAY, T1), ("S99", "A", DAY, T1)], schema), SEAT_PRICES)
    assert store.insert_ignore(again, base, SEAT_PRICES) == 1
    plan = store.only_weeks_of(store.read_table(spark, base, SEAT_PRICES), again)._jdf.queryExecution().executedPlan()
    filters_of = plan.toString().split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "gen" in filters_of and "week_start" in filters_of


def test_loads_look_back_from_the_newest_file(spark, tmp_path):
    folder, base, day = tmp_path / "in", str(tmp_path / "store"), dt.timedelta(days=1)
    folder.mkdir()
    now = dt.datetime.now().timestamp()

    def file(hour, schedule, days_ago):
        path = folder / f"seat_wise_prices_2025-01-01_{hour:02d}-30.csv"
        path.write_text(f"schedule_id,seat_number,travel_date,snapshot_ts\n{schedule},1,2025-01-02,2025-01-01 06:30:00\n")
        os.utime(path, (now - days_ago * 86400,) * 2)

    def load(**how):
        return store.load_folder(spark, str(folder), base, SEAT_WISE_PRICES, **how)

    for i in range(8):
        file(10 + i, f"S{i}", 40 - i)
    assert load(look_back=day, files_per_round=3) == 8 and load(look_back=day) == 0
    mark = store.loaded_until(spark, str(folder) + "/", base, SEAT_WISE_PRICES)
    assert mark == int(now - 33 * 86400)
    # Of the old files, only the one within a day of the newest is listed.
    assert feeds.list_files(spark, str(folder), mark - 86400 // 2).count() == 1
    file(3, "LATE", 0)  # an old name
    assert load(look_back=day) == 1 and load(look_back=day) == 0
    file(4, "BACK", 20)  # put there with an old time of change
    assert load(look_back=day) == 0 and load() == 1 and load() == 0
    table = store.read_table(spark, base, SEAT_WISE_PRICES)
    assert sorted(r.schedule_id for r in table.collect()) == sorted([*(f"S{i}" for i in range(8)), "LATE", "BACK"])


def test_ledger_is_folded(spark, tmp_path):
    base = str(tmp_path / "store")
    path = store.ledger_path(base)
    assert store.fold_ledger(spark, base) == 0
    for i in range(6):
        entry = spark.createDataFrame([("f", f"p{i % 5}", dt.datetime(2025, 1, 1 + i))], store.LEDGER_SCHEMA)
        entry.coalesce(1).write.mode("append").parquet(path)
    assert store.fold_ledger(spark, base, most_files=6) == 0
    assert store.fold_ledger(spark, base, most_files=5) == 6
    left = spark.read.parquet(path)
    assert sorted((r.path, r.modified.day) for r in left.collect()) == [("p0", 6), *((f"p{i}", i + 1) for i in range(1, 5))]
    assert len(left.inputFiles()) < 6
    # Files that are large already stay as they are.
    assert store.fold_ledger(spark, base, most_files=0, small=10) == 0


def test_ledgers_without_times_still_count(spark, tmp_path):
    folder, base = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    file = folder / "seat_wise_prices_2025-01-01_06-30.csv"
    file.write_text("schedule_id,seat_number,travel_date\nS1,1,2025-01-02\n")
    old = spark.createDataFrame([(SEAT_WISE_PRICES.name, file.as_uri().replace("///", "/"))], "feed string, path string")
    old.write.parquet(store.ledger_path(base))
    assert store.new_files(spark, str(folder), base, SEAT_WISE_PRICES).count() == 0
    assert store.new_files(spark, str(folder), base, SEAT_WISE_PRICES, since=0).count() == 0
