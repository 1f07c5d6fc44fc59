"""Row selection: optional filters, date pruning, source fallback."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farescope.functions import scalars as S
from farescope.operators.joins import rows_in, rows_not_in
from farescope.operators.latest import latest_all


def on_date(df: DataFrame, date_column: str, day: str | dt.date) -> DataFrame:
    """Rows of one date. Mentions ``week_start`` so that a partitioned table is pruned."""
    day = F.lit(str(day)).cast("date")
    df = df.filter(F.col(date_column) == day)
    if "week_start" in df.columns:
        df = df.filter(F.col("week_start") == S.week_start(day))
    return df


def in_date_range(
    df: DataFrame, date_column: str, start: str | dt.date, end: str | dt.date
) -> DataFrame:
    """Rows with ``start <= date < end``, pruned by week when partitioned."""
    lo, hi = F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")
    df = df.filter((F.col(date_column) >= lo) & (F.col(date_column) < hi))
    if "week_start" in df.columns:
        df = df.filter((F.col("week_start") >= S.week_start(lo)) & (F.col("week_start") < hi))
    return df


def filtered(
    df: DataFrame,
    schedule_id: str | None = None,
    operator_id: int | None = None,
    seat_type: str | None = None,
    hours: float | None = None,
    date_of_journey: str | dt.date | None = None,
    departure_time: str | None = None,
    newest_first: bool = False,
) -> DataFrame:
    """Conjunction of the filters that were given; a missing argument filters nothing."""
    if schedule_id is not None:
        df = df.filter(F.col("schedule_id") == F.lit(str(schedule_id)))
    if operator_id is not None:
        df = df.filter(F.col("operator_id") == F.lit(int(operator_id)))
    if seat_type is not None:
        df = df.filter(F.col("seat_type") == F.lit(seat_type))
    if hours is not None:
        df = df.filter(S.near_hour(F.col("hours_before_departure"), float(hours)))
    if date_of_journey is not None:
        df = on_date(df, "date_of_journey", date_of_journey)
    if departure_time is not None:
        df = df.filter(F.col("departure_time") == F.lit(departure_time))
    if newest_first:
        df = df.orderBy(F.col("snapshot_ts").desc_nulls_last())
    return df


def past_only(df: DataFrame, date_column: str, as_of: str | dt.date) -> DataFrame:
    """Rows whose date lies before ``as_of``."""
    return df.filter(F.col(date_column) < F.lit(str(as_of)).cast("date"))


def of_schedule_text(df: DataFrame, search: str) -> DataFrame:
    """Exact id search, blanks around the id ignored on both sides."""
    return df.filter(F.trim("schedule_id") == F.lit(str(search).strip()))


def of_seat(df: DataFrame, seat_number: str | int) -> DataFrame:
    return df.filter(F.col("seat_number").cast("string") == F.lit(str(seat_number)))


def other_operators(df: DataFrame, operator_id: int) -> DataFrame:
    """Distinct operators except the chosen one."""
    return df.filter(F.col("operator_id") != F.lit(int(operator_id))).select("operator_id").distinct()


def of_schedules(df: DataFrame, schedules: DataFrame) -> DataFrame:
    """Rows whose schedule appears in ``schedules`` (never fans out)."""
    return rows_in(df, schedules, ["schedule_id"])


def at_latest_snapshot(df: DataFrame, keys: Sequence[str] = ("schedule_id",)) -> DataFrame:
    """All rows of each schedule's newest snapshot."""
    return latest_all(df, list(keys))


def snapshots_in_month_at_zero_hour(df: DataFrame, month_day: str | dt.date) -> DataFrame:
    """Rows at hour 0 whose stamp falls in the month of ``month_day`` (half-open)."""
    first, following = S.month_bounds(F.lit(str(month_day)).cast("date"))
    ts = F.col("snapshot_ts")
    return df.filter(
        (F.col("hours_before_departure") == 0)
        & (ts >= first.cast("timestamp_ntz"))
        & (ts < following.cast("timestamp_ntz"))
    )


def with_fallback(primary: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``primary`` plus the ``fallback`` rows of keys that ``primary`` lacks altogether."""
    rest = rows_not_in(fallback, primary, keys)
    return primary.unionByName(rest, allowMissingColumns=True)


def table_or(spark, name: str, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``with_fallback`` over a table that may not exist."""
    if not spark.catalog.tableExists(name):
        return fallback
    return with_fallback(spark.table(name), fallback, keys)
