"""Every operator as a query over the driver's tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farescope.functions import scalars as S
from farescope.operators import (
    choices,
    compare,
    filters,
    lookups,
    quality,
    rollups,
    seats,
    trends,
    views,
)
from farescope.operators.latest import latest_one, written
from farescope.plans.feed_files import loaded_table, raw_rows, stream_rows, write_feed
from farescope.plans.proxies import SEAT_TIES, raw_snap, seat, snap, table, trip
from farescope.plans.session import working_folder
from farescope.schemas import SEAT_PRICES, SEAT_PRICES_WITH_DT
from farescope.sources import feeds, store
from farescope.streaming import latest_table, pickup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

REQUESTED_HOURS = (0.0, 1.5, 10.5, 24.004, 48.0, 100.0)
AS_OF = "2024-01-15"


def doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles: declared decimal widths differ between engines."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if f.dataType.typeName() == "decimal"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: doubles(fn(spark, sf_dir))
        return fn

    return register


# --- newest per key and derived views -------------------------------------------------


@query("latest_seat_type")
def _(spark, d):
    return views.seat_prices_latest(snap(spark, d))


@query("latest_seat")
def _(spark, d):
    return views.seat_wise_prices_latest(seat(spark, d))


@query("latest_seat_one")
def _(spark, d):
    return latest_one(seat(spark, d), ["schedule_id", "seat_number"], ties=SEAT_TIES)


@query("latest_snapshot_rows")
def _(spark, d):
    return filters.at_latest_snapshot(seat(spark, d))


@query("newest_first")
def _(spark, d):
    return views.newest_first(snap(spark, d))


@query("hours_view")
def _(spark, d):
    return views.hours_view(snap(spark, d))


@query("computed_hours")
def _(spark, d):
    return views.computed_hours(views.seat_prices_latest(snap(spark, d)))


@query("occupancy_view")
def _(spark, d):
    return views.occupancy_view(snap(spark, d))


@query("expected_occupancy_view")
def _(spark, d):
    return views.occupancy_view(snap(spark, d), "expected_occupancy")


@query("latest_occupancy_view")
def _(spark, d):
    latest = views.seat_prices_latest(snap(spark, d))
    present = views.latest_occupancy_view(latest, "expected_occupancy")
    absent = views.latest_occupancy_view(latest, "occupancy")
    return present.unionByName(absent, allowMissingColumns=True)


@query("date_of_journey_view")
def _(spark, d):
    return views.date_of_journey_view(trip(spark, d, "date_of_journey", "schedule_id", "snapshot_ts"))


@query("schedule_id_text")
def _(spark, d):
    return views.schedule_id_text(snap(spark, d))


@query("actual_price_view")
def _(spark, d):
    return views.actual_price_view(snap(spark, d))


@query("model_price_view")
def _(spark, d):
    return views.model_price_view(snap(spark, d))


@query("latest_model_price_view")
def _(spark, d):
    return views.latest_model_price_view(views.seat_prices_latest(snap(spark, d)))


@query("latest_actual_price_view")
def _(spark, d):
    return views.latest_actual_price_view(views.seat_prices_latest(snap(spark, d)))


@query("sql_over_views")
def _(spark, d):
    s, t = snap(spark, d), seat(spark, d)
    views.register_views(spark, s, t, s, t)
    return views.run_sql(
        spark,
        "SELECT seat_type, count(*) AS n, max(actual_fare) AS top_fare"
        " FROM seat_prices_latest WHERE date_of_journey >= CAST(:since AS DATE) GROUP BY seat_type",
        since=AS_OF,
    )


# --- look-ups --------------------------------------------------------------------------

SNAP_TIES = ("actual_fare", "price", "expected_occupancy")


@query("latest_price_by_hour")
def _(spark, d):
    return lookups.latest_per_hour(snap(spark, d), SNAP_TIES)


@query("latest_price_actual_model")
def _(spark, d):
    return lookups.price_triples(snap(spark, d), SNAP_TIES)


@query("latest_occupancy")
def _(spark, d):
    return lookups.occupancy_by_hour(snap(spark, d), SNAP_TIES)


@query("demand_index_split")
def _(spark, d):
    return lookups.demand_index(snap(spark, d), ties=SNAP_TIES)


@query("demand_index_by_seat_type")
def _(spark, d):
    return lookups.demand_index(snap(spark, d), by_hour=False, ties=SNAP_TIES)


@query("distinct_prices_timed")
def _(spark, d):
    return lookups.distinct_prices(snap(spark, d), ties=SNAP_TIES)


@query("distinct_prices_plain")
def _(spark, d):
    return lookups.distinct_prices(snap(spark, d), timed=False, ties=SNAP_TIES)


@query("departure_times")
def _(spark, d):
    return lookups.departure_times(snap(spark, d))


@query("nearest_hour_price")
def _(spark, d):
    return lookups.nearest_hour_prices(snap(spark, d), REQUESTED_HOURS)


@query("nearest_hour_requests")
def _(spark, d):
    requests = table(spark, d, "events").select(
        F.col("user_id").alias("schedule_id"),
        F.col("value").alias("requested_hours"),
    )
    return lookups.nearest_snapshots_for(snap(spark, d), requests)


@query("kpi_cards")
def _(spark, d):
    return lookups.kpi_cards(snap(spark, d), REQUESTED_HOURS, SNAP_TIES)


@query("seats_by_hour")
def _(spark, d):
    snaps = trip(spark, d, "schedule_id", "snapshot_ts", "hours_before_departure")
    return lookups.seats_by_hour(seat(spark, d), snaps, SEAT_TIES)


@query("seats_latest")
def _(spark, d):
    return lookups.seats_latest(seat(spark, d), SEAT_TIES)


@query("seat_rows_at_hour")
def _(spark, d):
    snaps = trip(spark, d, "schedule_id", "snapshot_ts", "hours_before_departure")
    return lookups.seat_rows(seat(spark, d), snaps, hours=6)


@query("journey_dates")
def _(spark, d):
    snaps = trip(spark, d, "schedule_id", "snapshot_ts", "date_of_journey")
    return lookups.journey_dates(seat(spark, d), snaps)


# --- roll-ups --------------------------------------------------------------------------


@query("date_summary_seat")
def _(spark, d):
    return rollups.date_summary_seat(seat(spark, d), trip(spark, d, "schedule_id", "date_of_journey"))


@query("date_summary_schedule")
def _(spark, d):
    return rollups.date_summary_schedule(snap(spark, d))


@query("date_summary_past_dates")
def _(spark, d):
    return rollups.date_summary_schedule(snap(spark, d), as_of=AS_OF)


@query("monthly_delta_schedule")
def _(spark, d):
    return rollups.monthly_delta_schedule(snap(spark, d))


@query("monthly_delta_seat")
def _(spark, d):
    snaps = trip(spark, d, "schedule_id", "snapshot_ts", "hours_before_departure", "date_of_journey")
    return rollups.monthly_delta_seat(seat(spark, d), snaps)


@query("total_seat_prices")
def _(spark, d):
    snaps = trip(spark, d, "schedule_id", "snapshot_ts", "hours_before_departure")
    return rollups.total_seat_prices(seat(spark, d), snaps)


@query("seat_totals")
def _(spark, d):
    return rollups.seat_totals(seat(spark, d))


@query("kpi_means")
def _(spark, d):
    return rollups.kpi_means(snap(spark, d), ["schedule_id"], places=None)


@query("kpi_means_ignore_blank")
def _(spark, d):
    return rollups.kpi_means(snap(spark, d), ["schedule_id"], blanks="ignore", places=None)


@query("kpi_means_seat")
def _(spark, d):
    return rollups.kpi_means(seat(spark, d), ["seat_type"], places=None)


@query("model_price_fallback")
def _(spark, d):
    return rollups.with_model_price(snap(spark, d)).select(
        "schedule_id", "seat_type", "snapshot_ts", "model_price"
    )


# --- trends ----------------------------------------------------------------------------


@query("price_sum_by_hour")
def _(spark, d):
    snaps = trip(spark, d, "schedule_id", "seat_type", "snapshot_ts", "hours_before_departure")
    return trends.price_sum_by_hour(seat(spark, d), snaps, SEAT_TIES)


@query("occupancy_trend")
def _(spark, d):
    return trends.occupancy_trend(snap(spark, d))


@query("occupancy_history")
def _(spark, d):
    return trends.occupancy_history(snap(spark, d))


@query("price_trend_delta")
def _(spark, d):
    return trends.price_trend(snap(spark, d)).select(
        "schedule_id", "seat_type", "snapshot_ts", "actual_fare", "price", "delta", "delta_pct"
    )


@query("seat_analysis")
def _(spark, d):
    return trends.seat_analysis(seat(spark, d))


# --- two operators ---------------------------------------------------------------------


@query("matching_times")
def _(spark, d):
    return compare.matching_times(snap(spark, d), 0, 1)


@query("matching_times_seat_type")
def _(spark, d):
    return compare.matching_times(snap(spark, d), 0, 1, same_seat_type=True)


@query("matching_times_all_others")
def _(spark, d):
    snaps = trip(spark, d, "operator_id", "date_of_journey", "departure_time", "seat_type")
    return compare.matching_times(snaps, 2, same_seat_type=True)


@query("operator_match_counts")
def _(spark, d):
    return compare.match_counts(snap(spark, d), [0, 1, 2])


@query("common_slots_intersect")
def _(spark, d):
    return compare.common_slots(snap(spark, d), 1, 2)


@query("operator_compare_seat_type")
def _(spark, d):
    return compare.seat_type_offers(snap(spark, d), 0, 1)


@query("operator_compare_seat")
def _(spark, d):
    snaps = trip(spark, d, "operator_id", "date_of_journey", "departure_time", "schedule_id")
    return compare.seat_offers(seat(spark, d), snaps, 0, 1)


@query("operator_compare_seat_one")
def _(spark, d):
    snaps = trip(spark, d, "operator_id", "date_of_journey", "departure_time", "schedule_id")
    return compare.seat_offers(seat(spark, d), snaps, 0, 1, one_row_ties=SEAT_TIES)


@query("operator_compare_stats")
def _(spark, d):
    return compare.compare_stats(compare.seat_type_offers(snap(spark, d), 0))


@query("operator_compare_seat_stats")
def _(spark, d):
    snaps = trip(spark, d, "operator_id", "date_of_journey", "departure_time", "schedule_id")
    return compare.compare_stats(compare.seat_offers(seat(spark, d), snaps, 0))


# --- distinct values, dimensions, scalars ----------------------------------------------


@query("distinct_schedules")
def _(spark, d):
    return choices.distinct_values(trip(spark, d, "schedule_id"), "schedule_id")


@query("distinct_operators")
def _(spark, d):
    return choices.distinct_values(trip(spark, d, "operator_id"), "operator_id")


@query("distinct_seat_types")
def _(spark, d):
    return choices.distinct_values(trip(spark, d, "seat_type"), "seat_type")


@query("journey_dates_distinct")
def _(spark, d):
    return choices.distinct_values(trip(spark, d, "date_of_journey"), "date_of_journey")


@query("schedule_dim")
def _(spark, d):
    return choices.schedule_dimension(trip(spark, d, "schedule_id", "operator_id", "departure_time"))


@query("schedule_operators")
def _(spark, d):
    return choices.schedule_operators(trip(spark, d, "schedule_id", "operator_id"))


@query("seat_types_per_schedule")
def _(spark, d):
    return choices.distinct_values(seat(spark, d), "schedule_id", "seat_type")


@query("seat_types_count")
def _(spark, d):
    return choices.seat_types_count(seat(spark, d))


@query("hours_distinct")
def _(spark, d):
    return choices.distinct_hours(snap(spark, d))


@query("schedules_by_date")
def _(spark, d):
    snaps = trip(spark, d, "date_of_journey", "schedule_id")
    return choices.distinct_values(snaps, "date_of_journey", "schedule_id")


@query("schedule_choices")
def _(spark, d):
    return choices.schedules_on(snap(spark, d))


@query("seat_type_choices")
def _(spark, d):
    # A schedule without seat rows is offered every seat type of the feed.
    return choices.seat_type_choices(seat(spark, d), snap(spark, d), "-1")


@query("seat_types_union")
def _(spark, d):
    s = snap(spark, d)
    return choices.seat_type_union(
        views.actual_price_view(s.filter("actual_fare IS NOT NULL")),
        views.model_price_view(s.filter("price IS NOT NULL")),
    )


@query("other_operators")
def _(spark, d):
    return filters.other_operators(trip(spark, d, "operator_id"), 1)


@query("operator_names")
def _(spark, d):
    suppliers = table(spark, d, "supplier")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("operator_id"))
    counts = lines.agg(F.count(F.lit(1)).alias("n"))
    return choices.with_name(counts, suppliers, "operator_id", "s_suppkey", "s_name", "operator_name")


@query("operator_names_fixed")
def _(spark, d):
    lines = table(spark, d, "lineitem")
    name = choices.operator_name(F.col("l_partkey")).alias("operator_name")
    return lines.groupBy(name).agg(F.count(F.lit(1)).alias("n"))


@query("origin_destination")
def _(spark, d):
    return choices.origin_destination(seat(spark, d))


@query("filtered_snapshots")
def _(spark, d):
    return filters.filtered(
        snap(spark, d), operator_id=1, seat_type="click", hours=24, departure_time="03:00:00"
    )


@query("filtered_hours_text")
def _(spark, d):
    raw = raw_snap(spark, d)
    hours = F.col("hours_before_departure")
    number, text = S.near_hour_text(hours, 24), S.near_hour_text(hours, "soon")
    return raw.filter(number | text).groupBy("schedule_id", hours).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("zero_hour_in_month")
def _(spark, d):
    return filters.snapshots_in_month_at_zero_hour(snap(spark, d), "2024-01-10")


@query("source_fallback")
def _(spark, d):
    # Timed snapshots where a (schedule, seat type, hour) has a priced one, the rest as a fallback.
    keys = ["schedule_id", "seat_type", "hours_before_departure"]
    timed = snap(spark, d).filter("price IS NOT NULL")
    return filters.with_fallback(timed, snap(spark, d), keys)


@query("delta_status")
def _(spark, d):
    s = snap(spark, d)
    actual, model = F.col("actual_fare"), F.col("price")
    return s.select(
        "schedule_id",
        "seat_type",
        "snapshot_ts",
        S.delta(actual, model).alias("delta"),
        S.delta_percent(actual, model).alias("delta_pct"),
        S.status(actual, model).alias("status"),
    )


@query("typed_values")
def _(spark, d):
    raw = raw_snap(spark, d)
    fare = S.parse(F.col("actual_fare"), "decimal(18,2)")
    price = S.parse(F.col("price"), "decimal(18,2)")
    return raw.select(
        "schedule_id",
        "seat_type",
        S.parse_stamp(F.col("stamp_text")).alias("snapshot_ts"),
        S.parse(F.col("date_of_journey"), "date").alias("date_of_journey"),
        S.parse(F.col("hours_before_departure"), "double").alias("hours_before_departure"),
        fare.alias("actual_fare"),
        S.blank_as_zero(F.col("actual_fare")).alias("actual_or_zero"),
        F.coalesce(price, fare).alias("model_price"),
        S.week_start(S.parse(F.col("date_of_journey"), "date")).alias("week_start"),
        S.is_past(F.col("date_of_journey"), F.lit(AS_OF).cast("date")).alias("is_past"),
    )


# --- seats -----------------------------------------------------------------------------


@query("seat_price_table")
def _(spark, d):
    return seats.seat_price_table(lookups.seats_latest(seat(spark, d), SEAT_TIES))


@query("seat_order")
def _(spark, d):
    table = seats.seat_price_table(lookups.seats_latest(seat(spark, d), SEAT_TIES))
    return seats.in_seat_order(table).select("schedule_id", "seat_no", "actual_fare", "final_price")


@query("seat_details")
def _(spark, d):
    return seats.seat_details(lookups.seats_latest(seat(spark, d), SEAT_TIES))


@query("seat_rows_13")
def _(spark, d):
    # One long coach per customer: every order line of the customer is a seat.
    lines = table(spark, d, "lineitem").join(
        table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    long_coach = lines.select(
        F.col("o_custkey").cast("string").alias("schedule_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string").alias("seat_number"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("actual_fare"),
        F.col("l_quantity").cast("decimal(18,2)").alias("final_price"),
    )
    return seats.seat_map_rows(long_coach).drop("seat_number")


# --- quality, extent, partitions -------------------------------------------------------


@query("profile")
def _(spark, d):
    return quality.profile(
        snap(spark, d),
        ["schedule_id", "seat_type", "departure_time", "price", "actual_occupancy", "demand_index"],
        approximate=False,
    )


@query("profile_sketch")
def _(spark, d):
    # The sketch of every column beside its exact count: within three standard errors of 5 %.
    rows = written(seat(spark, d), "seats")
    exact = quality.profile(rows, approximate=False, on_disk=True)
    exact = exact.select("column_name", F.col("distinct_count").alias("exact_count"))
    error = F.abs(F.col("distinct_count") - F.col("exact_count"))
    return quality.profile(rows).join(exact, "column_name").select(
        "column_name", "row_count", "null_count", "exact_count",
        (error <= 0.15 * F.col("exact_count")).alias("within_bound"),
    )


def _week_sketches(spark, d):
    """The sketches of every week of journeys, as they would lie beside the weeks."""
    rows = written(seat(spark, d).withColumn("week_start", S.week_start(F.col("travel_date"))), "seats")
    path = working_folder(spark, "sketches")
    quality.write_sketches(rows, ["week_start"], path)
    return rows, spark.read.parquet(path)


@query("profile_of_weeks")
def _(spark, d):
    # Weeks of 1996, merged from sketches alone, beside exact counts over their rows.
    rows, kept = _week_sketches(spark, d)
    span = F.col("week_start").between(dt.date(1996, 1, 7), dt.date(1996, 12, 22))
    exact = quality.profile(rows.filter(span).drop("week_start"), approximate=False, on_disk=True)
    exact = exact.select("column_name", F.col("distinct_count").alias("exact_count"))
    error = F.abs(F.col("distinct_estimate") - F.col("exact_count"))
    return quality.profile_of(kept.filter(span)).join(exact, "column_name").select(
        "column_name", "row_count", "null_count", "exact_count",
        (error <= 4 * quality.SKETCH_ERROR * F.col("exact_count")).alias("within_bound"),
    )


@query("profile_estimates")
def _(spark, d):
    # No SQL: the estimates themselves, of all weeks merged, with their relative error.
    rows, kept = _week_sketches(spark, d)
    exact = quality.profile(rows.drop("week_start"), approximate=False, on_disk=True).select(
        "column_name", F.col("distinct_count").alias("exact_count")
    )
    error = F.abs(F.col("distinct_estimate") - F.col("exact_count")) / F.col("exact_count")
    merged = quality.profile_of(kept).join(exact, "column_name")
    return merged.select("*", F.round(error, 4).alias("relative_error"))


@query("seat_types_count_approx")
def _(spark, d):
    return choices.seat_types_count(seat(spark, d), approximate=True)


@query("rejects")
def _(spark, d):
    return quality.rejects(raw_snap(spark, d), SEAT_PRICES)


@query("date_extent")
def _(spark, d):
    tables = [(snap(spark, d), "date_of_journey"), (seat(spark, d), "travel_date")]
    return quality.date_extent(tables, AS_OF)


@query("week_bucket_counts")
def _(spark, d):
    return quality.rows_per_week(seat(spark, d), "travel_date")


@query("week_coverage")
def _(spark, d):
    return quality.week_coverage(seat(spark, d), "travel_date")


@query("month_zero_hour_fallback")
def _(spark, d):
    snaps = trip(spark, d, "schedule_id", "snapshot_ts", "hours_before_departure")
    return quality.month_hour_fallback(snaps)


@query("sample_rows")
def _(spark, d):
    return choices.sample_rows(
        seat(spark, d), ["schedule_id", "seat_number", "snapshot_ts", *SEAT_TIES], 5
    )


# --- single arms of the operators above ------------------------------------------------


@query("kpi_means_rounded")
def _(spark, d):
    return rollups.kpi_means(snap(spark, d), ["schedule_id"])


@query("nearest_hour_price_of_seats")
def _(spark, d):
    # Only the seat types that the seat feed lists for a schedule.
    listed = snap(spark, d).filter("actual_occupancy < 30").select("schedule_id", "seat_type")
    return lookups.nearest_hour_prices(snap(spark, d), REQUESTED_HOURS, seats=listed)


@query("occupancy_trend_listed")
def _(spark, d):
    return trends.in_display_order(trends.occupancy_trend(snap(spark, d)))


@query("hours_listed")
def _(spark, d):
    return choices.listed_hours(snap(spark, d))


@query("of_seat")
def _(spark, d):
    return filters.of_seat(seat(spark, d), " 3".strip())


@query("of_schedule_text")
def _(spark, d):
    return filters.of_schedule_text(snap(spark, d), " 7 ")


@query("filtered_schedule_date")
def _(spark, d):
    return filters.filtered(snap(spark, d), schedule_id="7", date_of_journey="2024-01-10")


@query("schedules_on_date")
def _(spark, d):
    return choices.schedules_on(snap(spark, d), "2024-01-10")


@query("seat_types_of_schedule")
def _(spark, d):
    return choices.seat_type_choices(seat(spark, d), seat(spark, d), "7")


@query("seat_types_until")
def _(spark, d):
    s = snap(spark, d)
    return choices.seat_types_until(
        s.filter("actual_fare IS NOT NULL"), s.filter("price IS NOT NULL"), "7", "2024-01-10 12:00:00"
    )


@query("date_summary_one_day")
def _(spark, d):
    return rollups.date_summary_schedule(snap(spark, d), day="2024-01-10")


@query("date_summary_seat_one_day")
def _(spark, d):
    trips = trip(spark, d, "schedule_id", "date_of_journey")
    return rollups.date_summary_seat(seat(spark, d), trips, day="1996-05-01")


@query("monthly_delta_one_month")
def _(spark, d):
    return rollups.monthly_delta_schedule(snap(spark, d), year=2024, month=1)


@query("monthly_delta_seat_one_month")
def _(spark, d):
    snaps = trip(spark, d, "schedule_id", "snapshot_ts", "hours_before_departure", "date_of_journey")
    return rollups.monthly_delta_seat(seat(spark, d), snaps, year=1996, month=5)


@query("fallback_without_table")
def _(spark, d):
    keys = ["schedule_id", "seat_type", "hours_before_departure"]
    return filters.table_or(spark, "farescope_no_such_table", snap(spark, d), keys)


@query("columns_with_defaults")
def _(spark, d):
    rows = snap(spark, d).select("schedule_id", "snapshot_ts", "price")
    return views.with_defaults(rows, {"price": F.lit(0), "occupancy": F.lit(-1), "route": F.lit("none")})


@query("columns_of_both")
def _(spark, d):
    rows = snap(spark, d).select("schedule_id", "seat_type", "snapshot_ts")
    return store.with_columns_of(rows, seat(spark, d).select("SEAT_TYPE", "seat_number", "travel_date"))


@query("text_defaults")
def _(spark, d):
    raw = raw_snap(spark, d)
    return raw.select(
        "schedule_id",
        "stamp_text",
        S.blank_else(F.col("actual_fare"), F.lit("missing")).alias("fare"),
        S.month_name(S.parse(F.col("date_of_journey"), "date")).alias("month_name"),
    )


@query("timed_views")
def _(spark, d):
    s, t = snap(spark, d), seat(spark, d)
    views.register_views(spark, s, t, s, t)
    counts = "SELECT '{0}' AS view_name, count(*) AS n, max(snapshot_ts) AS newest FROM {0}"
    names = (
        "seat_prices_with_dt_latest", "seat_wise_prices_with_dt_latest", "seat_prices_with_dt_view",
        "seat_wise_prices_raw_view", "computed_hours", "dateofjourney", "model_price_sp",
    )
    return views.run_sql(spark, " UNION ALL ".join(counts.format(n) for n in names))


# --- ingest and streams ----------------------------------------------------------------
# These write the snapshots as CSV feed files first and read them back.

FEED = SEAT_PRICES_WITH_DT


@query("csv_ingest_typed")
def _(spark, d):
    return feeds.typed(raw_rows(spark, write_feed(spark, d)), FEED)


@query("insert_ignore")
def _(spark, d):
    # The first load takes January's first half; the second sees those rows again.
    rows = feeds.typed(raw_rows(spark, write_feed(spark, d)), FEED)
    base = working_folder(spark, "store")
    store.migrate(rows, base, FEED, "2024-01-01", "2024-01-16")
    store.insert_ignore(rows, base, FEED)
    return store.read_table(spark, base, FEED)


@query("append_frame")
def _(spark, d):
    # Odd column case, an extra column, most of the feed's columns missing.
    base = working_folder(spark, "store")
    frame = snap(spark, d).select(
        F.col("schedule_id").alias("SCHEDULE_ID"), F.col("seat_type").alias(" Seat_Type "),
        "date_of_journey", "actual_fare", "snapshot_ts", F.lit(1).alias("extra"),
    )
    store.append(store.conform(frame, SEAT_PRICES), base, SEAT_PRICES)
    return store.read_table(spark, base, SEAT_PRICES).select(
        "schedule_id", "seat_type", "date_of_journey", "actual_fare", "price", "snapshot_ts", "week_start"
    )


@query("table_grows")
def _(spark, d):
    # Three loads: with the table's columns, with two more, and without them again.
    base = working_folder(spark, "store")
    own = ["schedule_id", "seat_type", "date_of_journey", "actual_fare", "snapshot_ts"]
    rows = snap(spark, d)
    hour, more = F.hour("snapshot_ts"), {
        " Depot ": F.concat(F.lit("d"), F.col("schedule_id") % 5), "stop_count": F.col("schedule_id") % 4,
    }
    for part in (rows.filter(hour < 6), rows.filter(hour.between(6, 11)).withColumns(more), rows.filter(hour >= 12)):
        part = part.select(*own, *[c for c in part.columns if c in more])
        store.append(store.grow(part, base, SEAT_PRICES), base, SEAT_PRICES)
    table = store.read_table(spark, base, SEAT_PRICES, every_column=True)
    return table.select(*own, "depot", "stop_count", "week_start")


@query("compacted_table")
def _(spark, d):
    # Many small loads, compacted twice on the way and read in between.
    base = working_folder(spark, "store")
    rows = snap(spark, d).select("schedule_id", "seat_type", "date_of_journey", "actual_fare", "snapshot_ts")
    for part in range(8):
        store.append(store.conform(rows.filter(F.col("schedule_id") % 8 == part), SEAT_PRICES), base, SEAT_PRICES)
        if part in (4, 7):
            store.compact(spark, base, SEAT_PRICES, most_files=3)
    return store.read_table(spark, base, SEAT_PRICES).select(*rows.columns, "week_start")


@query("load_folder_twice")
def _(spark, d):
    folder, base = write_feed(spark, d), working_folder(spark, "store")
    store.load_folder(spark, folder, base, FEED, files_per_round=25)
    store.load_folder(spark, folder, base, FEED)
    return store.read_table(spark, base, FEED)


@query("load_folder_recent")
def _(spark, d):
    # Files come in two lots; loads look back from the newest file that was taken, and the ledger is folded between.
    folder, base = working_folder(spark, "feed"), working_folder(spark, "store")
    for lot in (F.col("schedule_id") % 2 == 0, None):
        write_feed(spark, d, folder, lot)
        for _ in range(2):
            store.load_folder(spark, folder, base, FEED, files_per_round=200, look_back=dt.timedelta(hours=1))
            store.fold_ledger(spark, base, most_files=1)
    return store.read_table(spark, base, FEED)


@query("partition_report")
def _(spark, d):
    return quality.rows_per_week(loaded_table(spark, d), FEED.date_column)


@query("json_export")
def _(spark, d):
    path = working_folder(spark, "json")
    store.write_json(snap(spark, d), path)
    schema = "schedule_id bigint, seat_type string, snapshot_ts timestamp_ntz, actual_fare double, price double"
    return spark.read.schema(schema).json(path)


@query("stream_pickup")
def _(spark, d):
    folder, base = write_feed(spark, d), working_folder(spark, "store")
    for run in range(2):
        # The second run finds no new file.
        pickup.start_pickup(
            spark, FEED, folder, base, f"{base}/_checkpoint", files_per_batch=40
        ).awaitTermination()
    return store.read_table(spark, base, FEED)


@query("rejected_files")
def _(spark, d):
    # One file per journey date, without a header line; none of them is loaded.
    folder, base = working_folder(spark, "headless"), working_folder(spark, "store")
    rows = snap(spark, d).select("schedule_id", "seat_type", "price", F.col("date_of_journey").alias("day"))
    rows.hint("rebalance", "day").write.partitionBy("day").csv(folder)
    for _ in range(2):
        store.load_folder(spark, folder, base, FEED)
    day = F.regexp_extract("path", "day=([0-9-]+)", 1).cast("date").alias("day")
    return store.rejected_files(spark, base).select("feed", day, "reason").distinct()


@query("stream_dedupe")
def _(spark, d):
    rows, base = stream_rows(spark, d, copies=2), working_folder(spark, "deduped")
    pickup.start_dedupe(rows, FEED, base, f"{base}/_checkpoint").awaitTermination()
    return store.read_table(spark, base, FEED)


@query("stream_dedupe_within")
def _(spark, d):
    # Every row comes twice; a run stops when half the files are there, and the next goes on from its checkpoint.
    rows = loaded_table(spark, d)
    silver, out = working_folder(spark, "silver"), working_folder(spark, "within")
    half = F.dayofyear("snapshot_ts") % 2 == 0
    for part in (rows.filter(half), rows.filter(~half).unionByName(rows)):
        part.write.mode("append").parquet(silver)
        stream = spark.readStream.schema(FEED.silver_schema).option("maxFilesPerTrigger", 4).parquet(silver)
        pickup.start_dedupe_within(stream, FEED, "400 days", f"{out}/rows", f"{out}/_checkpoint").awaitTermination()
    return spark.read.schema(FEED.silver_schema).parquet(f"{out}/rows")


@query("stream_latest_table")
def _(spark, d):
    rows, out = stream_rows(spark, d), working_folder(spark, "latest")
    latest_table.start_latest_table(rows, FEED, out, f"{out}/_checkpoint").awaitTermination()
    return latest_table.read_latest(spark, out, FEED.silver_schema)
