"""Price, occupancy and demand look-ups, for all keys in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farescope.functions import scalars as S
from farescope.operators.filters import on_date
from farescope.operators.joins import rows_in
from farescope.operators.latest import first_per_key, latest_all, latest_one

HOUR_KEY = ("schedule_id", "seat_type", "hours_before_departure")
SNAP_TIES = ("date_of_journey", "actual_fare", "price")
SEAT_TIES = ("travel_date", "actual_fare", "final_price")


def latest_per_hour(snaps: DataFrame, ties: Sequence[str] = SNAP_TIES) -> DataFrame:
    """Newest row per (schedule, seat type, hour)."""
    return latest_one(snaps, HOUR_KEY, ties=ties)


def price_triples(snaps: DataFrame, ties: Sequence[str] = SNAP_TIES) -> DataFrame:
    """Actual price, model price (falling back to actual) and their distance per hour."""
    model = F.coalesce("price", "actual_fare")
    return latest_per_hour(snaps, ties).select(
        *HOUR_KEY,
        F.col("actual_fare").alias("actual_price"),
        model.alias("model_price"),
        F.abs(F.col("actual_fare") - model).alias("abs_delta"),
        S.status(F.col("actual_fare"), model).alias("status"),
    )


def occupancy_by_hour(snaps: DataFrame, ties: Sequence[str] = SNAP_TIES) -> DataFrame:
    """Newest occupancy pair per (schedule, seat type, hour); 0 for both when either is missing."""
    both = F.col("actual_occupancy").isNotNull() & F.col("expected_occupancy").isNotNull()
    pair = [
        F.when(both, F.col(c)).otherwise(F.lit(0)).cast("decimal(10,2)").alias(c)
        for c in ("actual_occupancy", "expected_occupancy")
    ]
    return latest_per_hour(snaps, ties).select(*HOUR_KEY, *pair)


def demand_index(
    snaps: DataFrame, by_hour: bool = True, ties: Sequence[str] = SNAP_TIES
) -> DataFrame:
    """Newest demand index per schedule and seat type (and hour), split into grade and number."""
    keys = HOUR_KEY if by_hour else ("schedule_id", "seat_type")
    demand = F.col("demand_index")
    return (
        latest_one(snaps, keys, ties=ties)
        .filter(demand.isNotNull())
        .select(
            *keys,
            S.demand_grade(demand).alias("demand_grade"),
            S.demand_value(demand).alias("demand_value"),
        )
    )


def distinct_prices(
    snaps: DataFrame, timed: bool = True, ties: Sequence[str] = SNAP_TIES
) -> DataFrame:
    """Newest price per schedule, seat type and hour for every (date, operator, time).

    The timed feed belongs to operators without a model, so its price is the
    charged fare; the plain feed keeps its own price where there is one.
    """
    offer = ("date_of_journey", "operator_id", "departure_time")
    price = F.col("actual_fare") if timed else F.coalesce("price", "actual_fare")
    zero = F.lit(0).cast("decimal(10,2)")
    return latest_one(snaps, (*offer, *HOUR_KEY), ties=ties).select(
        *offer,
        *HOUR_KEY,
        "snapshot_ts",
        "actual_fare",
        price.alias("price"),
        F.coalesce("actual_occupancy", zero).alias("actual_occupancy"),
        F.coalesce("expected_occupancy", zero).alias("expected_occupancy"),
    )


def kpi_cards(
    snaps: DataFrame, hours: Sequence[float], ties: Sequence[str] = SNAP_TIES
) -> DataFrame:
    """Prices, occupancies and demand per schedule, seat type and requested hour.

    Prices come from the nearest snapshot; occupancies (0 when missing) and
    demand from the newest row at the hour itself, within 0.01.
    """
    h, wanted = F.col("hours_before_departure"), [float(x) for x in hours]
    key = ["schedule_id", "seat_type", "requested_hours"]
    close = F.filter(
        F.array(*[F.lit(x) for x in wanted]), lambda x: F.abs(h - x) < S.HOUR_TOLERANCE
    )
    at_hour = latest_one(snaps.withColumn("requested_hours", F.explode(close)), key, ties=ties)
    at_hour = at_hour.select(*key, "actual_occupancy", "expected_occupancy", "demand_index")
    actual, model = F.col("actual_price"), F.col("model_price")
    both = F.col("actual_occupancy").isNotNull() & F.col("expected_occupancy").isNotNull()
    zero = F.lit(0).cast("decimal(10,2)")
    return (
        nearest_hour_prices(snaps, wanted)
        .join(at_hour, key, "left")
        .select(
            *key,
            "matched_hours",
            actual,
            model,
            F.abs(actual - model).alias("abs_delta"),
            S.status(actual, model).alias("status"),
            *[
                F.when(both, F.col(c)).otherwise(zero).alias(c)
                for c in ("actual_occupancy", "expected_occupancy")
            ],
            S.demand_grade(F.col("demand_index")).alias("demand_grade"),
            S.demand_value(F.col("demand_index")).alias("demand_value"),
        )
    )


def departure_times(snaps: DataFrame) -> DataFrame:
    """One departure time per schedule."""
    return snaps.groupBy("schedule_id").agg(F.min("departure_time").alias("departure_time"))


def hour_snapshots(snaps: DataFrame) -> DataFrame:
    """Newest stamp of each (schedule, hour)."""
    return (
        snaps.filter(F.col("hours_before_departure").isNotNull())
        .groupBy("schedule_id", "hours_before_departure")
        .agg(F.max("snapshot_ts").alias("snapshot_ts"))
    )


def seats_by_hour(
    seats: DataFrame, snaps: DataFrame, ties: Sequence[str] = SEAT_TIES
) -> DataFrame:
    """One row per seat at the newest snapshot of every (schedule, hour)."""
    one = first_per_key(
        seats.filter(F.col("snapshot_ts").isNotNull()),
        ("schedule_id", "snapshot_ts", "seat_number"),
        [F.col(c).asc_nulls_last() for c in ties],
    )
    return one.join(hour_snapshots(snaps), ["schedule_id", "snapshot_ts"]).select(
        "schedule_id", "hours_before_departure", "snapshot_ts",
        "seat_number", "actual_fare", "final_price",
    )


def seats_latest(seats: DataFrame, ties: Sequence[str] = SEAT_TIES) -> DataFrame:
    """One row per seat at each schedule's newest snapshot."""
    return first_per_key(
        latest_all(seats, ["schedule_id"]),
        ("schedule_id", "seat_number"),
        [F.col(c).asc_nulls_last() for c in ties],
    ).select("schedule_id", "snapshot_ts", "seat_number", "actual_fare", "final_price")


def seat_rows(
    seats: DataFrame,
    snaps: DataFrame,
    schedule_id: str | None = None,
    hours: float | None = None,
    date_of_journey: str | None = None,
) -> DataFrame:
    """Seat rows restricted through the snapshot's hour and journey date.

    A filter that matches nothing yields nothing, and no row is repeated.
    """
    if schedule_id is not None:
        seats = seats.filter(F.col("schedule_id") == F.lit(str(schedule_id)))
        snaps = snaps.filter(F.col("schedule_id") == F.lit(str(schedule_id)))
    if hours is not None:
        at_hour = snaps.filter(S.near_hour(F.col("hours_before_departure"), float(hours)))
        seats = rows_in(seats, at_hour, ["schedule_id", "snapshot_ts"]).withColumn(
            "hours_before_departure", F.lit(float(hours))
        )
    if date_of_journey is not None:
        on_day = on_date(snaps, "date_of_journey", date_of_journey)
        seats = rows_in(seats, on_day, ["schedule_id", "snapshot_ts"]).withColumn(
            "date_of_journey", F.lit(str(date_of_journey)).cast("date")
        )
    return seats


def journey_dates(seats: DataFrame, snaps: DataFrame, hours: float | None = None) -> DataFrame:
    """Journey dates of the snapshots in ``seats``, optionally only those at one hour."""
    if hours is not None:
        snaps = snaps.filter(S.near_hour(F.col("hours_before_departure"), float(hours)))
    days = snaps.select("schedule_id", "snapshot_ts", "date_of_journey").distinct()
    wanted = seats.select("schedule_id", "snapshot_ts").distinct()
    return wanted.join(days, ["schedule_id", "snapshot_ts"])


def nearest_snapshots(snaps: DataFrame, hours: Sequence[float]) -> DataFrame:
    """For every schedule and requested hour, the snapshot nearest in hours.

    Hours within 0.01 count as exact; equally near ones go to the later stamp.
    History shrinks to one row per (schedule, hour) first; the choice is then a
    plain ``max`` per schedule, combined map-side, with no join.
    """
    h, ts = F.col("hours_before_departure"), F.col("snapshot_ts")

    def nearest(x: float):
        gap = F.abs(h - F.lit(float(x)))
        gap = F.when(gap <= S.EXACT_GAP, F.lit(0.0)).otherwise(gap)
        return F.max(F.struct((-gap).alias("closeness"), ts, h))

    wanted = [float(x) for x in hours]
    best = (
        hour_snapshots(snaps)
        .groupBy("schedule_id")
        .agg(*[nearest(x).alias(f"_n{i}") for i, x in enumerate(wanted)])
    )
    choices = F.array(
        *[
            F.struct(
                F.lit(x).alias("requested_hours"),
                F.col(f"_n{i}.hours_before_departure").alias("matched_hours"),
                F.col(f"_n{i}.snapshot_ts").alias("snapshot_ts"),
            )
            for i, x in enumerate(wanted)
        ]
    )
    return best.select("schedule_id", F.inline(choices))


BLOCK_HOURS = 24


def nearest_snapshots_for(snaps: DataFrame, requests: DataFrame) -> DataFrame:
    """``nearest_snapshots`` for a table of (schedule_id, requested_hours).

    Both sides shrink to distinct hours and are sorted together, so that each
    request finds its neighbours by looking one step up and one step down; no
    pairs are formed. A schedule is cut into blocks of 24 hours that different
    tasks sort; the neighbours beyond a block's edge come from a summary that
    holds one row per block.
    """
    known = hour_snapshots(snaps).select(
        "schedule_id",
        F.col("hours_before_departure").alias("_h"),
        F.struct(F.col("hours_before_departure").alias("h"), F.col("snapshot_ts").alias("ts")).alias("_known"),
    )
    asked = requests.select(
        "schedule_id", F.col("requested_hours").cast("double").alias("_h")
    ).dropna().distinct()
    rows = known.withColumn("_asked", F.lit(False)).unionByName(
        asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True
    )

    # A known hour within the tolerance of an edge is also visible across it.
    def block(shift: float):
        return F.floor((F.col("_h") + F.lit(shift)) / BLOCK_HOURS)

    own = block(0.0)
    seen_from = F.when(F.col("_asked"), F.array(own)).otherwise(
        F.array_distinct(F.array(own, block(-S.HOUR_TOLERANCE), block(S.HOUR_TOLERANCE)))
    )
    rows = rows.withColumn("_block", F.explode(seen_from))

    in_block = Window.partitionBy("schedule_id", "_block")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    up = in_block.orderBy("_h", "_asked").rowsBetween(*so_far)
    down = in_block.orderBy(F.desc("_h"), "_asked").rowsBetween(*so_far)
    within = F.expr(
        "max(CASE WHEN NOT _asked THEN struct(_known.ts, _known.h) END) OVER (PARTITION BY schedule_id,"
        f" _block ORDER BY _h RANGE BETWEEN {S.EXACT_GAP!r}D PRECEDING AND {S.EXACT_GAP!r}D FOLLOWING)"
    )
    found = (
        rows.withColumn("_exact", within)
        .withColumn("_below", F.last("_known", ignorenulls=True).over(up))
        .withColumn("_above", F.last("_known", ignorenulls=True).over(down))
        .filter("_asked")
    )

    order = Window.partitionBy("schedule_id")
    earlier = order.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    later = order.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        rows.groupBy("schedule_id", "_block")
        .agg(F.max("_known").alias("_hi"), F.min("_known").alias("_lo"))
        .select(
            "schedule_id",
            "_block",
            F.last("_hi", ignorenulls=True).over(earlier).alias("_far_below"),
            F.last("_lo", ignorenulls=True).over(later).alias("_far_above"),
        )
    )

    def candidate(name: str):
        c = F.col(name)
        return F.when(
            c.isNotNull(),
            F.struct((-F.abs(c["h"] - F.col("_h"))).alias("closeness"), c["ts"].alias("ts"), c["h"].alias("h")),
        )

    exact = F.when(
        F.col("_exact.ts").isNotNull(),
        F.struct(F.lit(0.0).alias("closeness"), F.col("_exact.ts").alias("ts"), F.col("_exact.h").alias("h")),
    )
    best = F.greatest(exact, *[candidate(c) for c in ("_below", "_above", "_far_below", "_far_above")])
    return (
        found.join(edges, ["schedule_id", "_block"])
        .withColumn("_best", best)
        .filter("_best IS NOT NULL")
        .select(
            "schedule_id",
            F.col("_h").alias("requested_hours"),
            F.col("_best.h").alias("matched_hours"),
            F.col("_best.ts").alias("snapshot_ts"),
        )
    )


def nearest_hour_prices(
    snaps: DataFrame,
    hours: Sequence[float] | DataFrame,
    seats: DataFrame | None = None,
    ties: Sequence[str] = ("date_of_journey", "hours_before_departure", "actual_fare", "price"),
) -> DataFrame:
    """Actual and model price per seat type at the snapshot nearest to each requested hour.

    ``hours`` is a list for all schedules or a table of (schedule_id, requested_hours).
    With ``seats``, only the seat types the seat feed lists for the schedule are kept.
    """
    nearest = nearest_snapshots_for if isinstance(hours, DataFrame) else nearest_snapshots
    chosen = nearest(snaps, hours)
    one = first_per_key(
        snaps,
        ("schedule_id", "seat_type", "snapshot_ts"),
        [F.col(c).asc_nulls_last() for c in ties],
    ).select("schedule_id", "seat_type", "snapshot_ts", "actual_fare", "price")
    if seats is not None:
        one = rows_in(one, seats, ["schedule_id", "seat_type"])
    return one.join(chosen, ["schedule_id", "snapshot_ts"]).select(
        "schedule_id",
        "requested_hours",
        "matched_hours",
        "snapshot_ts",
        "seat_type",
        F.col("actual_fare").alias("actual_price"),
        F.col("price").alias("model_price"),
    )
