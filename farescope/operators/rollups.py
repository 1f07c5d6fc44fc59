"""Sums and means of actual against model price: schedule, date, month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farescope.functions import scalars as S
from farescope.operators.filters import on_date, past_only
from farescope.operators.joins import rows_in
from farescope.operators.latest import first_per_key
from farescope.operators.views import schedule_dates


def kpi_means(
    df: DataFrame,
    keys: Sequence[str] = (),
    model: str | None = None,
    blanks: str = "zero",
    places: int | None = 2,
) -> DataFrame:
    """Mean prices and occupancies per ``keys`` with delta and percent delta of the model.

    ``blanks="zero"`` counts a missing value as 0, ``"ignore"`` leaves it out of
    the mean. Without ``model`` the model column is price, final_price or
    actual_fare, whichever the table has first.
    """
    if blanks not in ("zero", "ignore"):
        raise ValueError(f"blanks must be 'zero' or 'ignore', not {blanks!r}")
    model = model or model_column(df)

    def mean(name: str) -> Column:
        if name not in df.columns:
            return F.lit(0.0)
        total = F.coalesce(F.sum(name).cast("double"), F.lit(0.0))
        n = F.count(F.lit(1)) if blanks == "zero" else F.count(name)
        return F.when(n > 0, total / n).otherwise(F.lit(0.0))

    means = df.groupBy(*keys).agg(
        mean("actual_fare").alias("avg_actual_fare"),
        mean(model).alias("avg_model_price"),
        mean("actual_occupancy").alias("avg_occupancy"),
        mean("expected_occupancy").alias("avg_expected_occupancy"),
    )
    diff = F.col("avg_actual_fare") - F.col("avg_model_price")
    out = means.withColumn("avg_delta", diff).withColumn(
        "avg_delta_pct",
        F.when(F.col("avg_model_price") != 0, diff / F.col("avg_model_price") * 100).otherwise(
            F.lit(0.0)
        ),
    )
    if places is None:
        return out
    values = [c for c in out.columns if c not in keys]
    return out.withColumns({c: F.round(c, places) for c in values})


def model_column(df: DataFrame) -> str:
    return next(c for c in ("price", "final_price", "actual_fare") if c in df.columns)


def with_model_price(df: DataFrame) -> DataFrame:
    """Adds ``model_price``: per row the first of price, final_price, actual_fare that is set."""
    present = [c for c in ("price", "final_price", "actual_fare") if c in df.columns]
    return df.withColumn("model_price", F.coalesce(*present))


def snapshot_sums(
    df: DataFrame, keys: Sequence[str], model: str, hours: bool
) -> DataFrame:
    """Sums of all rows of each (key, snapshot), and the snapshot's lowest hour.

    This runs before any choice among snapshots: the rows are combined map-side
    and only one row per (key, snapshot) is left for the choice that follows.
    """
    aggs = [F.sum("actual_fare").alias("actual"), F.sum(model).alias("model")]
    if hours:
        aggs.append(F.min("hours_before_departure").alias("hours"))
    return df.groupBy(*keys, "snapshot_ts").agg(*aggs)


def nearest_departure(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the snapshot with the lowest hour; equal hours go to the later stamp."""
    order = [F.col("hours").asc_nulls_last(), F.col("snapshot_ts").desc_nulls_last()]
    return first_per_key(sums, keys, order)


def newest(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    return first_per_key(sums, keys, [F.col("snapshot_ts").desc_nulls_last()])


def _per_schedule(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("schedule_id").agg(
        F.sum("actual").alias("actual"), F.sum("model").alias("model")
    )


def _zero(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0))


def date_summary(per_schedule: DataFrame, dates: DataFrame) -> DataFrame:
    """Totals per journey date over the schedules running on it; 0 where none has prices."""
    totals = (
        dates.join(per_schedule, "schedule_id", "left")
        .groupBy("date_of_journey")
        .agg(_zero("actual").alias("actual_sum"), _zero("model").alias("model_sum"))
    )
    actual, model = F.col("actual_sum"), F.col("model_sum")
    return totals.select(
        "date_of_journey",
        "actual_sum",
        "model_sum",
        (actual - model).alias("delta"),
        F.abs(actual - model).alias("abs_delta"),
        S.status(actual, model).alias("status"),
    )


def _dates(snaps: DataFrame, day: str | None, as_of: str | None) -> DataFrame:
    if day is not None:
        snaps = on_date(snaps, "date_of_journey", day)
    if as_of is not None:
        snaps = past_only(snaps, "date_of_journey", as_of)
    return schedule_dates(snaps)


def date_summary_schedule(
    snaps: DataFrame, day: str | None = None, as_of: str | None = None
) -> DataFrame:
    """Date totals from each (schedule, seat type) at its lowest hour.

    For all dates, or one ``day``, or those before ``as_of``.
    """
    dates = _dates(snaps, day, as_of)
    if day is not None:
        snaps = rows_in(snaps, dates, ["schedule_id"])
    keys = ("schedule_id", "seat_type")
    chosen = nearest_departure(snapshot_sums(snaps, keys, "price", hours=True), keys)
    return date_summary(_per_schedule(chosen), dates)


def date_summary_seat(
    seats: DataFrame, snaps: DataFrame, day: str | None = None, as_of: str | None = None
) -> DataFrame:
    """Date totals from each (schedule, seat) at its newest snapshot."""
    dates = _dates(snaps, day, as_of)
    if day is not None:
        seats = rows_in(seats, dates, ["schedule_id"])
    keys = ("schedule_id", "seat_number")
    chosen = newest(snapshot_sums(seats, keys, "final_price", hours=False), keys)
    return date_summary(_per_schedule(chosen), dates)


def schedule_months(snaps: DataFrame) -> DataFrame:
    day = F.col("date_of_journey")
    return (
        snaps.filter(day.isNotNull())
        .select(F.year(day).alias("year"), F.month(day).alias("month"), "schedule_id")
        .distinct()
    )


def _monthly(per_schedule: DataFrame, months: DataFrame) -> DataFrame:
    totals = (
        months.join(per_schedule, "schedule_id", "left")
        .groupBy("year", "month")
        .agg(
            F.count(F.lit(1)).alias("schedule_count"),
            _zero("actual").alias("total_actual_price"),
            _zero("model").alias("total_model_price"),
        )
    )
    return totals.withColumn(
        "price_difference", F.col("total_actual_price") - F.col("total_model_price")
    )


def _months(snaps: DataFrame, year: int | None, month: int | None) -> DataFrame:
    months = schedule_months(snaps)
    if year is not None:
        months = months.filter(F.col("year") == year)
    if month is not None:
        months = months.filter(F.col("month") == month)
    return months


def monthly_delta_schedule(
    snaps: DataFrame, year: int | None = None, month: int | None = None
) -> DataFrame:
    """Month totals of each schedule's rows at its lowest-hour snapshot.

    With ``year`` or ``month`` only the schedules running then are read on.
    """
    months = _months(snaps, year, month)
    if year is not None or month is not None:
        snaps = rows_in(snaps, months, ["schedule_id"])
    keys = ("schedule_id",)
    chosen = nearest_departure(snapshot_sums(snaps, keys, "price", hours=True), keys)
    return _monthly(chosen, months)


def monthly_delta_seat(
    seats: DataFrame, snaps: DataFrame, year: int | None = None, month: int | None = None
) -> DataFrame:
    """Month totals of each seat at its lowest-hour snapshot.

    Seat rows carry no hours; they come from the schedule feed by snapshot.
    """
    months = _months(snaps, year, month)
    if year is not None or month is not None:
        seats = rows_in(seats, months, ["schedule_id"])
    keys = ("schedule_id", "seat_number")
    at = snaps.groupBy("schedule_id", "snapshot_ts").agg(
        F.min("hours_before_departure").alias("hours")
    )
    sums = snapshot_sums(seats, keys, "final_price", hours=False).join(
        at, ["schedule_id", "snapshot_ts"], "left"
    )
    return _monthly(_per_schedule(nearest_departure(sums, keys)), months)


def total_seat_prices(seats: DataFrame, snaps: DataFrame) -> DataFrame:
    """Totals and row counts of all seat rows per (schedule, hour).

    Row-based over every snapshot of the hour; the latest-only totals are
    ``price_sum_by_hour`` and ``date_summary_seat``.
    """
    per_snapshot = seats.groupBy("schedule_id", "snapshot_ts").agg(
        F.sum("actual_fare").alias("actual"),
        F.sum("final_price").alias("model"),
        F.count(F.lit(1)).alias("n"),
    )
    hours = snaps.select("schedule_id", "snapshot_ts", "hours_before_departure").distinct()
    totals = (
        per_snapshot.join(hours, ["schedule_id", "snapshot_ts"])
        .groupBy("schedule_id", "hours_before_departure")
        .agg(
            _zero("actual").alias("total_actual_price_all_rows"),
            _zero("model").alias("total_model_price_all_rows"),
            F.sum("n").alias("seat_count_all_rows"),
        )
    )
    return totals.withColumn(
        "price_difference",
        F.col("total_actual_price_all_rows") - F.col("total_model_price_all_rows"),
    )


def seat_totals(rows: DataFrame) -> DataFrame:
    """Grand total over already filtered seat rows; one row, zeros when there are none."""
    totals = rows.agg(
        _zero("actual_fare").alias("total_actual_price"),
        _zero("final_price").alias("total_model_price"),
        F.count(F.lit(1)).alias("seat_count"),
    )
    return totals.withColumn(
        "price_difference", F.col("total_actual_price") - F.col("total_model_price")
    )
