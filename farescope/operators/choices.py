"""Distinct values, dimensions and the cascading filter choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farescope.functions import scalars as S
from farescope.operators.filters import on_date
from farescope.operators.joins import one_value
from farescope.operators.latest import number_in_order

# Names by id.
OPERATOR_NAMES = {191: "Pullman San Andreas", 296: "Pullman Bus TS"}
PLACE_NAMES = {1646: "Santiago", 1821: "La Serena"}
OTHER = "Other"


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def schedule_operators(snaps: DataFrame) -> DataFrame:
    """One operator per schedule."""
    return snaps.groupBy("schedule_id").agg(F.min("operator_id").alias("operator_id"))


def schedule_dimension(snaps: DataFrame) -> DataFrame:
    return snaps.groupBy("schedule_id").agg(
        F.min("operator_id").alias("operator_id"), F.min("departure_time").alias("departure_time")
    )


def seat_types_count(seats: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of distinct seat types per schedule."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return seats.groupBy("schedule_id").agg(count("seat_type").alias("seat_types_count"))


def distinct_hours(snaps: DataFrame, by_schedule: bool = True) -> DataFrame:
    """Distinct hours with their label; ``listed_hours`` gives their order."""
    hours = F.col("hours_before_departure")
    keys = ["schedule_id"] if by_schedule else []
    values = snaps.filter(hours.isNotNull()).select(*keys, hours).distinct()
    return values.withColumn("hours_label", S.hour_label(hours))


def listed_hours(snaps: DataFrame) -> DataFrame:
    """Distinct hours per schedule with their place in the list, the largest first."""
    order = [F.col("hours_before_departure").desc()]
    listed = number_in_order(distinct_hours(snaps), ["schedule_id"], order, "position", unique=True)
    return listed.withColumn("position", F.col("position").cast("int"))


def schedules_on(snaps: DataFrame, day: str | None = None) -> DataFrame:
    """Schedules of one date; all of them when no date is chosen."""
    if day is not None:
        snaps = on_date(snaps, "date_of_journey", day)
    return snaps.select("schedule_id").distinct()


def seat_type_choices(seats: DataFrame, snaps: DataFrame, schedule_id: str | None = None) -> DataFrame:
    """Seat types of one schedule; all seat types when it has none or none is chosen."""
    every = snaps.select("seat_type").distinct()
    if schedule_id is None:
        return every
    mine = seats.filter(F.col("schedule_id") == F.lit(str(schedule_id))).select("seat_type")
    found = mine.agg(F.count(F.lit(1)).alias("n")).scalar()
    return mine.distinct().union(every.filter(found == 0))


def seat_type_union(actual_prices: DataFrame, model_prices: DataFrame) -> DataFrame:
    """Seat types with an actual or a model price, per schedule."""
    columns = ["schedule_id", "seat_type"]
    return actual_prices.select(*columns).union(model_prices.select(*columns)).distinct()


def seat_types_until(
    actual_prices: DataFrame, model_prices: DataFrame, schedule_id: str, until: str
) -> DataFrame:
    """Seat types of one schedule priced at or before a snapshot."""

    def part(df: DataFrame) -> DataFrame:
        keep = (F.col("schedule_id") == F.lit(str(schedule_id))) & (
            F.col("snapshot_ts") <= F.lit(until).cast("timestamp_ntz")
        )
        return df.filter(keep).select("seat_type")

    return part(actual_prices).union(part(model_prices)).distinct()


def name_of(key: Column, names: dict[int, str], default: str = OTHER) -> Column:
    """Name of an id from a fixed list, as one CASE expression."""
    key = key.try_cast("int")
    out = F.lit(default)
    for k, v in reversed(names.items()):
        out = F.when(key == k, v).otherwise(out)
    return out


def operator_name(key: Column) -> Column:
    return name_of(key, OPERATOR_NAMES)


def place_name(key: Column) -> Column:
    return name_of(key, PLACE_NAMES)


def origin_destination(seats: DataFrame) -> DataFrame:
    """One (origin, destination) per schedule with names."""
    one = seats.groupBy("schedule_id").agg(
        F.min(F.struct("origin_id", "destination_id")).alias("p")
    )
    return one.select(
        "schedule_id",
        "p.origin_id",
        "p.destination_id",
        place_name(F.col("p.origin_id")).alias("origin_name"),
        place_name(F.col("p.destination_id")).alias("destination_name"),
    )


def with_name(
    df: DataFrame, dimension: DataFrame, key: str, dim_key: str, dim_name: str, alias: str,
    default: str = OTHER,
) -> DataFrame:
    """Names from a dimension table, ``default`` where there is none.

    The dimension is made unique on its key so that the join cannot fan out.
    Spark broadcasts it only while it is under the configured size.
    """
    pairs = dimension.select(F.col(dim_key).alias(key), F.col(dim_name).alias(alias))
    names = one_value(pairs, key, alias)
    return df.join(names, key, "left").withColumn(alias, F.coalesce(alias, F.lit(default)))


def dimension_from(spark: SparkSession, names: dict[int, str]) -> DataFrame:
    """A fixed list as a dimension table."""
    return spark.createDataFrame(sorted(names.items()), "id int, name string")


def sample_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in key order (a distributed top-k)."""
    return df.orderBy(*order).limit(n)
