"""Data profile, date extent, partition report and coverage."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farescope.functions import scalars as S
from farescope.operators.latest import written
from farescope.plans.session import setting
from farescope.schemas import Feed


def profile(
    df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = True, on_disk: bool = False
) -> DataFrame:
    """Rows, NULLs and distinct values per column.

    Sketches (the default) need a single pass whatever the width. The exact form groups each column by itself, from
    rows that are written to the shared folder first unless they are ``on_disk`` already: the values of a column meet
    in one map-side table without the other columns, and only its distinct values are shuffled.
    """
    columns = list(columns or df.columns)
    if not approximate:
        return _exact_profile(df if on_disk else written(df.select(*columns), "profiled"), columns)
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.approx_count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(columns)],
    )
    per_column = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col("rows").alias("row_count"),
                (F.col("rows") - F.col(f"n{i}")).alias("null_count"),
                F.col(f"d{i}").alias("distinct_count"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(F.inline(per_column))


def _exact_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    def of(c: str) -> DataFrame:
        values = df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        return values.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
            F.count("value").alias("distinct_count"),
        ).select(F.lit(c).alias("column_name"), "row_count", "null_count", "distinct_count")

    return reduce(DataFrame.unionAll, map(of, columns))


SKETCH_BITS = 12  # 4096 registers a sketch: an error of 1.04 / sqrt(4096), 1.6 %, whatever the count
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def column_sketches(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """keys, column_name, row_count, value_count, sketch: what can be merged of the profile of each group.

    A sketch (HyperLogLog) has a fixed size, so the rows of a week can be kept beside the week and merged for any span
    of weeks; the table is not read again.
    """
    columns = [c for c in (columns or df.columns) if c not in keys]
    wide = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.hll_sketch_agg(F.col(c).cast("string"), SKETCH_BITS).alias(f"s{i}") for i, c in enumerate(columns)],
    )
    per_column = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col("rows").alias("row_count"),
                F.col(f"n{i}").alias("value_count"),
                F.col(f"s{i}").alias("sketch"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(*keys, F.inline(per_column))


# Weeks that one task's table of sketches holds before it sorts its rows instead: 4 KB a column and week.
MOST_GROUPS = 2048


def write_sketches(df: DataFrame, keys: Sequence[str], path: str) -> None:
    """``column_sketches`` written to ``path``; a task keeps the sketches of its groups and does not sort its rows."""
    with setting(df.sparkSession, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(MOST_GROUPS)):
        column_sketches(df, keys).write.parquet(path)


def profile_of(sketches: DataFrame, keys: Sequence[str] = ("column_name",)) -> DataFrame:
    """Rows, NULLs and estimated distinct values per ``keys``, from the sketches of any groups."""
    return sketches.groupBy(*keys).agg(
        F.sum("row_count").alias("row_count"),
        (F.sum("row_count") - F.sum("value_count")).alias("null_count"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"),
    )


def rejects(raw: DataFrame, feed: Feed) -> DataFrame:
    """Per typed column, how many non-blank texts do not parse."""
    names = [c for c in feed.columns if c in feed.types and c in raw.columns]

    def bad(c: str):
        col = F.col(c)
        return S.clean_text(col).isNotNull() & S.parse(col, feed.types[c]).isNull()

    wide = raw.agg(*[F.count_if(bad(c)).alias(c) for c in names])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("reject_count")) for c in names]
    )
    return wide.select(F.inline(pairs))


def columns_present(df: DataFrame, expected: Sequence[str]) -> dict[str, bool]:
    """Which expected columns the table has, matched without regard to case."""
    have = {c.strip().lower() for c in df.columns}
    return {c: c.lower() in have for c in expected}


def date_extent(
    tables: Sequence[tuple[DataFrame, str]], as_of: str | dt.date, slack_days: int = 30
) -> DataFrame:
    """Earliest and latest date over several tables; ``as_of`` -/+ slack when all are empty."""
    ends = [df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")) for df, c in tables]
    today = F.lit(str(as_of)).cast("date")
    return reduce(DataFrame.unionAll, ends).agg(
        F.coalesce(F.min("lo"), F.date_sub(today, slack_days)).alias("min_date"),
        F.coalesce(F.max("hi"), F.date_add(today, slack_days)).alias("max_date"),
    )


def rows_per_week(df: DataFrame, date_column: str) -> DataFrame:
    """Row count per week; a partitioned table groups on its partition column."""
    week = F.col("week_start") if "week_start" in df.columns else S.week_start(F.col(date_column))
    return df.groupBy(week.alias("week_start")).agg(F.count(F.lit(1)).alias("row_count"))


def week_coverage(df: DataFrame, date_column: str) -> DataFrame:
    """Every week between the first and last date with its row count, 0 where empty."""
    counts = rows_per_week(df, date_column).filter(F.col("week_start").isNotNull())
    weeks = counts.agg(F.min("week_start").alias("a"), F.max("week_start").alias("b")).select(
        F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("week_start")
    )
    return weeks.join(counts, "week_start", "left").select(
        "week_start", F.coalesce("row_count", F.lit(0)).alias("row_count")
    )


def month_hour_fallback(snaps: DataFrame) -> DataFrame:
    """Per month the hour to report on: 0 where some schedule has it, else the lowest seen.

    Also counts the schedules observed at that hour.
    """
    h, month = F.col("hours_before_departure"), F.trunc("snapshot_ts", "month")
    seen = (
        snaps.filter(h.isNotNull() & F.col("snapshot_ts").isNotNull())
        .groupBy(month.alias("month_start"), h, "schedule_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("month_start", "hours_before_departure")
        .agg(F.count(F.lit(1)).alias("schedule_count"))
    )
    zero = F.max(F.when(h == 0, F.struct(h, "schedule_count")))
    lowest = F.min(F.struct(h, F.col("schedule_count")))
    return seen.groupBy("month_start").agg(F.coalesce(zero, lowest).alias("c")).select(
        "month_start",
        F.col("c.hours_before_departure").alias("used_hours"),
        F.col("c.schedule_count").alias("schedule_count"),
    )
