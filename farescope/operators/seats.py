"""Seat-level price table and seat map rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farescope.functions import scalars as S
from farescope.operators.latest import number_in_group

SEATS_PER_ROW = 13


def seat_price_table(seats_once: DataFrame) -> DataFrame:
    """One row per seat with number, delta, distance and status; input has unique seats."""
    actual, model = F.col("actual_fare"), F.col("final_price")
    return seats_once.select(
        "*",
        F.col("seat_number").try_cast("bigint").alias("seat_no"),
        (actual - model).alias("delta"),
        F.abs(actual - model).alias("abs_delta"),
        S.status(actual, model).alias("status"),
    )


def in_seat_order(table: DataFrame) -> DataFrame:
    """Sorted by schedule and numeric seat, unparsable seats last."""
    return table.orderBy("schedule_id", F.col("seat_no").asc_nulls_last(), "seat_number")


def seat_details(seats_once: DataFrame) -> DataFrame:
    """Model minus actual per seat and its share of the actual; 0 when a price is missing or 0."""
    actual, model = F.col("actual_fare"), F.col("final_price")
    usable = (actual != 0) & (model != 0)
    return seats_once.select(
        "schedule_id",
        "seat_number",
        "actual_fare",
        "final_price",
        F.when(usable, model - actual).otherwise(F.lit(0)).alias("price_diff"),
        S.delta_percent_of_actual(actual, model).alias("price_diff_pct"),
    )


def seat_map_rows(seats_once: DataFrame, per_row: int = SEATS_PER_ROW) -> DataFrame:
    """Place each numbered seat in rows of ``per_row`` in seat order, per schedule."""
    numbered = (
        seat_price_table(seats_once)
        .filter(F.col("seat_no").isNotNull())
        .groupBy("schedule_id", "seat_no")
        .agg(
            F.max(F.struct("seat_number", "actual_fare", "final_price", "delta", "status")).alias("s")
        )
        .select("schedule_id", "seat_no", "s.*")
    )
    placed = number_in_group(numbered, ["schedule_id"], "seat_no", "position")
    return placed.withColumn("seat_row", F.floor(F.col("position") / per_row)).withColumn(
        "seat_in_row", F.col("position") % per_row
    )
