"""Series over time and over hours before departure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farescope.functions import scalars as S
from farescope.operators.latest import first_per_key, latest_one, number_in_order
from farescope.operators.lookups import HOUR_KEY, SEAT_TIES


def occupancy_trend(snaps: DataFrame, ties: Sequence[str] = ("date_of_journey",)) -> DataFrame:
    """Newest occupancy pair per (schedule, seat type, hour) among rows that have both."""
    pair = ["actual_occupancy", "expected_occupancy"]
    return latest_one(snaps.dropna(subset=pair), HOUR_KEY, ties=(*ties, *pair)).select(
        *HOUR_KEY, "snapshot_ts", *[F.col(c).cast("decimal(10,2)").alias(c) for c in pair]
    )


def occupancy_history(snaps: DataFrame) -> DataFrame:
    """All occupancy readings with blanks as 0 (order by ``snapshot_ts`` to plot)."""
    zero = F.lit(0).cast("decimal(10,2)")
    return snaps.select(
        *HOUR_KEY,
        "snapshot_ts",
        F.coalesce("actual_occupancy", zero).alias("actual_occupancy"),
        F.coalesce("expected_occupancy", zero).alias("expected_occupancy"),
    )


def price_sum_by_hour(
    seats: DataFrame, snaps: DataFrame, ties: Sequence[str] = SEAT_TIES
) -> DataFrame:
    """Sum of seat prices at the newest snapshot of each (schedule, hour, seat type).

    Seats are deduplicated and summed per snapshot before the join, so the join
    carries one row per (schedule, seat type, snapshot) instead of one per seat.
    """
    at = ["schedule_id", "seat_type", "snapshot_ts"]
    one = first_per_key(
        seats.filter(F.col("snapshot_ts").isNotNull()),
        (*at, "seat_number"),
        [F.col(c).asc_nulls_last() for c in ties],
    )
    sums = one.groupBy(*at).agg(
        F.sum("actual_fare").alias("total_actual_price"),
        F.sum("final_price").alias("total_model_price"),
        F.count("seat_number").alias("seat_count"),
    )
    newest = snaps.groupBy(*HOUR_KEY).agg(F.max("snapshot_ts").alias("snapshot_ts"))
    return newest.join(sums, at).select(
        *HOUR_KEY, "total_actual_price", "total_model_price", "seat_count"
    )


def in_display_order(trend: DataFrame, keys: Sequence[str] = ("schedule_id",)) -> DataFrame:
    """``trend`` with each row's place: seat types ascending, hours descending, per ``keys``."""
    order = [F.col("seat_type").asc_nulls_last(), F.col("hours_before_departure").desc_nulls_last()]
    return number_in_order(trend, keys, order, "position").withColumn("position", F.col("position").cast("int"))


def price_trend(snaps: DataFrame) -> DataFrame:
    """Every snapshot with blanks as 0 and its delta (order by ``snapshot_ts`` to plot)."""
    zero = F.lit(0).cast("decimal(18,2)")
    price = "price" if "price" in snaps.columns else "actual_fare"
    rows = snaps.withColumns(
        {"actual_fare": F.coalesce("actual_fare", zero), "price": F.coalesce(price, zero)}
    )
    actual, model = F.col("actual_fare"), F.col("price")
    return rows.withColumns(
        {"delta": S.delta(actual, model), "delta_pct": S.delta_percent(actual, model)}
    )


def seat_analysis(rows: DataFrame) -> DataFrame:
    """Seat rows with prices, sales share and the true delta."""
    return rows.select(
        "schedule_id",
        "snapshot_ts",
        "seat_number",
        "seat_type",
        "actual_fare",
        "final_price",
        "sales_percentage",
        S.delta(F.col("actual_fare"), F.col("final_price")).alias("delta"),
    )
