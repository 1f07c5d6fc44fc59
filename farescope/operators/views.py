"""The derived views over the four snapshot tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farescope.functions import scalars as S
from farescope.operators.latest import latest_one, latest_ties

SCHEDULE_KEY = ("date_of_journey", "schedule_id", "seat_type")
SEAT_KEY = ("travel_date", "schedule_id", "seat_number")


def seat_prices_latest(snaps: DataFrame, unique: bool = False) -> DataFrame:
    """Newest rows per (date, schedule, seat type).

    ``unique`` says that key and stamp identify a row, as they do in a table
    filled by insert-or-ignore: then one of them is kept without looking for ties.
    """
    return _newest(snaps, SCHEDULE_KEY, unique)


def seat_wise_prices_latest(seats: DataFrame, unique: bool = False) -> DataFrame:
    """Newest rows per (date, schedule, seat); ``unique`` as above."""
    return _newest(seats, SEAT_KEY, unique)


def _newest(df: DataFrame, keys: Sequence[str], unique: bool) -> DataFrame:
    if unique:
        return latest_one(df.dropna(subset=[*keys, "snapshot_ts"]), keys)
    return latest_ties(df, keys)


def newest_first(df: DataFrame) -> DataFrame:
    """The whole table, newest snapshot first (a range-partitioned sort)."""
    return df.orderBy(F.col("snapshot_ts").desc_nulls_last())


def hours_view(snaps: DataFrame) -> DataFrame:
    return snaps.select("hours_before_departure", "schedule_id", "snapshot_ts").distinct()


def computed_hours(latest_with_dt: DataFrame) -> DataFrame:
    """Hours from snapshot to departure, taken from the full timestamps."""
    departure = S.departure_ts(F.col("date_of_journey"), F.col("departure_time"))
    return latest_with_dt.select(
        "date_of_journey",
        "schedule_id",
        "departure_time",
        "snapshot_ts",
        S.hours_between(F.col("snapshot_ts"), departure).alias("hours_before_departure"),
    )


def occupancy_view(snaps: DataFrame, column: str = "actual_occupancy") -> DataFrame:
    """Distinct readings of one occupancy column."""
    return snaps.select(column, "seat_type", "schedule_id", "snapshot_ts").distinct()


def optional_column(df: DataFrame, name: str, type_name: str, default: Column | None = None) -> Column:
    """``name`` when the table has it, otherwise ``default`` or a typed NULL."""
    if name in df.columns:
        return F.col(name)
    value = F.lit(None) if default is None else default
    return value.cast(type_name).alias(name)


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add each required column that is absent."""
    missing = {name: c for name, c in defaults.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def latest_occupancy_view(latest_with_dt: DataFrame, column: str = "occupancy") -> DataFrame:
    """Occupancy projection of newest rows; a typed NULL when the column is absent."""
    return latest_with_dt.select(
        "date_of_journey",
        "schedule_id",
        "operator_id",
        "departure_time",
        "snapshot_ts",
        optional_column(latest_with_dt, column, "decimal(10,2)"),
    )


def date_of_journey_view(snaps: DataFrame) -> DataFrame:
    return snaps.select("date_of_journey", "schedule_id", "snapshot_ts").distinct()


def schedule_dates(snaps: DataFrame) -> DataFrame:
    return snaps.select("date_of_journey", "schedule_id").distinct()


def schedule_id_text(snaps: DataFrame) -> DataFrame:
    text = F.col("schedule_id").cast("string").alias("schedule_id_text")
    return snaps.select("schedule_id", text).distinct()


def actual_price_view(snaps: DataFrame) -> DataFrame:
    return snaps.select("seat_type", "actual_fare", "schedule_id", "snapshot_ts").distinct()


def model_price_view(snaps: DataFrame) -> DataFrame:
    return snaps.select("seat_type", "price", "schedule_id", "snapshot_ts").distinct()


def latest_actual_price_view(latest: DataFrame) -> DataFrame:
    return latest.select("date_of_journey", "schedule_id", "seat_type", "snapshot_ts", "actual_fare")


def latest_model_price_view(latest: DataFrame) -> DataFrame:
    model = optional_column(latest, "model_price", "decimal(18,2)", F.col("price"))
    return latest.select("date_of_journey", "schedule_id", "seat_type", "snapshot_ts", model)


def register_views(
    spark: SparkSession,
    seat_prices: DataFrame,
    seat_wise_prices: DataFrame,
    seat_prices_with_dt: DataFrame,
    seat_wise_prices_with_dt: DataFrame,
    unique: bool = False,
) -> list[str]:
    """Create every temp view over the four tables; returns the names.

    Pass ``unique=True`` for tables filled by insert-or-ignore.
    """
    latest = seat_prices_latest(seat_prices, unique)
    latest_dt = seat_prices_latest(seat_prices_with_dt, unique)
    views = {
        "seat_prices_partitioned": seat_prices,
        "seat_wise_prices_partitioned": seat_wise_prices,
        "seat_prices_with_dt_partitioned": seat_prices_with_dt,
        "seat_wise_prices_with_dt_partitioned": seat_wise_prices_with_dt,
        "seat_prices_raw_view": seat_prices,
        "seat_wise_prices_raw_view": seat_wise_prices,
        "seat_prices_with_dt_view": seat_prices_with_dt,
        "seat_wise_prices_with_dt_view": seat_wise_prices_with_dt,
        "seat_prices_latest": latest,
        "seat_wise_prices_latest": seat_wise_prices_latest(seat_wise_prices, unique),
        "seat_prices_with_dt_latest": latest_dt,
        "seat_wise_prices_with_dt_latest": seat_wise_prices_latest(seat_wise_prices_with_dt, unique),
        "fngethoursbeforedeparture": hours_view(seat_prices),
        "computed_hours": computed_hours(latest_dt),
        "occupancies": occupancy_view(seat_prices, "actual_occupancy"),
        "expected_occupancies": occupancy_view(seat_prices, "expected_occupancy"),
        "dateofjourney": date_of_journey_view(seat_prices),
        "schedule_id_text": schedule_id_text(seat_prices),
        "actual_price_sp": actual_price_view(seat_prices),
        "model_price_sp": model_price_view(seat_prices),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return sorted(views)


def run_sql(spark: SparkSession, query: str, **params) -> DataFrame:
    """Parameterised SQL over the registered views; ``:name`` marks a parameter."""
    return spark.sql(query, args=params)
