"""The driver's tables read as fare snapshots.

There is no fare data among the driver's tables, so three views stand in for
the silver tables, with the tables' own integer keys as ids. The same
definitions, as SQL, are in ``oracles.py``.

* ``snap``: schedule-level snapshots, from ``events``
* ``seat``: seat-level snapshots, from ``lineitem`` and ``orders``
* ``trip``: the schedule-level snapshots that go with ``seat``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farescope.plans.session import size_shuffles, tune

# Columns of ``seat`` that tell equal stamps apart.
SEAT_TIES = ("coach_layout_id", "operator_reservation_id", "sales_count")


# Given schemas spare a job that reads file footers.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,"
    " props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark, fine=True).read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _slot(number: Column) -> Column:
    return F.concat(F.lit("0"), number.cast("string"), F.lit(":00:00"))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    events = table(spark, sf_dir, "events")
    size_shuffles(events)
    return (
        events.withColumn("k", _k())
        .select(
            F.col("user_id").alias("schedule_id"),
            F.col("event_type").alias("seat_type"),
            (F.col("user_id") % 3).cast("int").alias("operator_id"),
            F.col("ts").alias("snapshot_ts"),
            F.col("ts").cast("date").alias("date_of_journey"),
            _slot(F.hour("ts") % 4).alias("departure_time"),
            (3 * (23 - F.hour("ts"))).cast("double").alias("hours_before_departure"),
            F.col("value").cast("decimal(18,2)").alias("actual_fare"),
            F.when(k % 10 != 0, k.cast("decimal(18,2)")).alias("price"),
            F.when(k % 7 != 0, k.cast("decimal(10,2)")).alias("actual_occupancy"),
            (100 - k).cast("decimal(10,2)").alias("expected_occupancy"),
            F.when(k % 4 == 0, "M/L")
            .when(k % 4 == 1, F.concat(k.cast("string"), F.lit(".5")))
            .when(k % 4 == 2, k.cast("string"))
            .alias("demand_index"),
        )
    )


def raw_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``snap`` as the text a feed delivers, with blanks and unparsable values."""
    k = F.col("k")
    hours = (3 * (23 - F.hour("ts"))).cast("string")
    stamp = F.date_format("ts", "dd-MM-yyyy HH:mm:ss")
    fare = F.col("value").cast("decimal(18,2)").cast("string")
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", _k())
        .select(
            F.col("user_id").cast("string").alias("schedule_id"),
            F.col("event_type").alias("seat_type"),
            (F.col("user_id") % 3).cast("string").alias("operator_id"),
            F.col("ts").cast("date").cast("string").alias("date_of_journey"),
            F.when(k % 9 == 0, "soon").otherwise(hours).alias("hours_before_departure"),
            F.when(k % 10 == 0, "").when(k % 10 == 1, "abc").when(k % 10 == 2, "None")
            .otherwise(fare).alias("actual_fare"),
            F.when(k % 6 == 0, " ").otherwise(k.cast("string")).alias("price"),
            stamp.alias("stamp_text"),
        )
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    size_shuffles(orders, lines)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def seat(spark: SparkSession, sf_dir: str) -> DataFrame:
    fare = F.col("l_extendedprice").cast("decimal(18,2)")
    return _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("schedule_id"),
        F.col("l_linenumber").alias("seat_number"),
        F.col("l_returnflag").alias("seat_type"),
        (fare * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("final_price"),
        fare.alias("actual_fare"),
        F.col("l_partkey").alias("coach_layout_id"),
        F.col("l_quantity").cast("int").alias("sales_count"),
        (F.col("l_discount").cast("decimal(4,2)") * 100).cast("decimal(10,2)").alias("sales_percentage"),
        F.col("l_suppkey").alias("operator_reservation_id"),
        F.when(F.col("o_custkey") % 2 == 0, 1646).otherwise(7).alias("origin_id"),
        F.when(F.col("o_custkey") % 3 == 0, 1821).otherwise(8).alias("destination_id"),
        F.col("o_orderdate").cast("date").alias("travel_date"),
        F.col("l_shipdate").alias("snapshot_ts"),
    )


# Columns of ``trip`` and the lineitem column each needs, if any.
TRIP_COLUMNS = {
    "schedule_id": None,
    "seat_type": "l_returnflag",
    "snapshot_ts": "l_shipdate",
    "hours_before_departure": "l_shipdate",
    "date_of_journey": None,
    "operator_id": None,
    "departure_time": None,
}


def trip(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Distinct snapshots of the trips in ``seat``, in the given columns (default all).

    Lines shrink to distinct values before they meet the orders, so an order
    with very many lines is small by then.
    """
    columns = columns or tuple(TRIP_COLUMNS)
    needed = sorted({c for c in map(TRIP_COLUMNS.get, columns) if c})
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    size_shuffles(lines, orders)
    lines = lines.select("l_orderkey", *needed).distinct()
    made = {
        "schedule_id": F.col("l_orderkey"),
        "seat_type": F.col("l_returnflag"),
        "snapshot_ts": F.col("l_shipdate"),
        "hours_before_departure": F.month("l_shipdate").cast("double"),
        "date_of_journey": F.col("o_orderdate").cast("date"),
        "operator_id": (F.col("o_custkey") % 3).cast("int"),
        "departure_time": _slot(F.col("l_orderkey") % 4),
    }
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(*[made[c].alias(c) for c in columns]).distinct()
