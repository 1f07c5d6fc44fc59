"""Two operators' offers on the same date and departure time.

One operator is the model side and its ``price``/``final_price`` counts; the
other is charged ``actual_fare``. With no second operator named, the model
operator is compared with each of the others. Offers shrink to distinct slots
or per-slot totals before the sides meet, so the joins carry at most one row
per slot and operator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farescope.operators.latest import latest_one, latest_ties
from farescope.operators.views import SEAT_KEY, seat_wise_prices_latest

SLOT = ("date_of_journey", "departure_time")


def _others(df: DataFrame, model_operator: int, actual_operator: int | None) -> DataFrame:
    op = F.col("operator_id")
    if actual_operator is None:
        return df.filter(op != F.lit(int(model_operator)))
    return df.filter(op == F.lit(int(actual_operator)))


def matching_times(
    snaps: DataFrame,
    model_operator: int,
    actual_operator: int | None = None,
    same_seat_type: bool = False,
) -> DataFrame:
    """Departure times both operators offer on a date (and, optionally, in one seat type)."""
    keys = [*SLOT, "seat_type"] if same_seat_type else list(SLOT)
    offers = (
        snaps.filter(F.col("departure_time").isNotNull())
        .select("operator_id", *keys)
        .distinct()
    )
    model = offers.filter(F.col("operator_id") == F.lit(int(model_operator))).select(*keys)
    shared = _others(offers, model_operator, actual_operator).join(model, keys, "left_semi")
    return shared.select(F.col("operator_id").alias("actual_operator"), *SLOT).distinct()


def match_counts(snaps: DataFrame, model_operators: Sequence[int]) -> DataFrame:
    """Matching row pairs per slot of each given operator with every other one.

    Rows are counted per (slot, operator) first; the pair count is a product.
    """
    counts = (
        snaps.filter(F.col("departure_time").isNotNull())
        .groupBy("operator_id", *SLOT)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    left = counts.filter(F.col("operator_id").isin([int(o) for o in model_operators])).select(
        F.col("operator_id").alias("op1"), *SLOT, F.col("n").alias("n1")
    )
    right = counts.select(F.col("operator_id").alias("op2"), *SLOT, F.col("n").alias("n2"))
    return (
        left.join(right, list(SLOT))
        .filter(F.col("op1") != F.col("op2"))
        .select("op1", "op2", *SLOT, (F.col("n1") * F.col("n2")).alias("match_count"))
    )


def common_slots(snaps: DataFrame, operator1: int, operator2: int) -> DataFrame:
    """(time, date) sets of two operators, intersected."""
    slots = snaps.select("operator_id", "departure_time", "date_of_journey").distinct()

    def of(operator: int) -> DataFrame:
        return slots.filter(F.col("operator_id") == F.lit(int(operator))).drop("operator_id")

    return of(operator1).intersect(of(operator2))


def _role_price(model_operator: int, model_column: str) -> Column:
    is_model = F.col("operator_id") == F.lit(int(model_operator))
    return F.when(is_model, F.col(model_column)).otherwise(F.col("actual_fare"))


def _role(model_operator: int) -> Column:
    is_model = F.col("operator_id") == F.lit(int(model_operator))
    return F.when(is_model, "model").otherwise("actual")


def _sides(df: DataFrame, model_operator: int, actual_operator: int | None) -> DataFrame:
    if actual_operator is None:
        return df
    return df.filter(F.col("operator_id").isin(int(model_operator), int(actual_operator)))


def seat_type_offers(
    snaps: DataFrame, model_operator: int, actual_operator: int | None = None
) -> DataFrame:
    """Newest price per seat type of every schedule in each slot, by operator role."""
    timed = _sides(snaps, model_operator, actual_operator).filter(
        F.col("departure_time").isNotNull()
    )
    newest = latest_ties(timed, [*SLOT, "operator_id", "schedule_id", "seat_type"])
    return newest.select(
        *SLOT,
        "operator_id",
        _role(model_operator).alias("role"),
        "schedule_id",
        "seat_type",
        "hours_before_departure",
        _role_price(model_operator, "price").alias("price"),
    )


def seat_offers(
    seats: DataFrame,
    snaps: DataFrame,
    model_operator: int,
    actual_operator: int | None = None,
    one_row_ties: Sequence[str] | None = None,
) -> DataFrame:
    """Newest price per seat of every schedule in each slot, by operator role.

    Rows with equal stamps are all kept, unless ``one_row_ties`` names the
    columns that pick one of them.
    """
    schedules = (
        _sides(snaps, model_operator, actual_operator)
        .filter(F.col("departure_time").isNotNull())
        .select(*SLOT, "operator_id", "schedule_id")
        .distinct()
    )
    if one_row_ties is None:
        newest = seat_wise_prices_latest(seats)
    else:
        newest = latest_one(seats, SEAT_KEY, ties=one_row_ties)
    newest = newest.select(
        F.col("travel_date").alias("date_of_journey"),
        "schedule_id",
        "seat_number",
        "seat_type",
        "final_price",
        "actual_fare",
    )
    return newest.join(schedules, ["date_of_journey", "schedule_id"]).select(
        *SLOT,
        "operator_id",
        _role(model_operator).alias("role"),
        "schedule_id",
        "seat_number",
        F.col("seat_number").try_cast("bigint").alias("seat_no"),
        "seat_type",
        _role_price(model_operator, "final_price").alias("price"),
    )


def offer_stats(offers: DataFrame) -> DataFrame:
    """Count, sum and mean price per slot and operator."""
    total = F.sum("price")
    return offers.groupBy(*SLOT, "operator_id", "role").agg(
        F.count(F.lit(1)).alias("offer_count"),
        F.coalesce(total, F.lit(0)).alias("total_price"),
        (total.cast("double") / F.count("price")).alias("avg_price"),
    )


def compare_stats(offers: DataFrame) -> DataFrame:
    """The model operator's statistics beside each other operator's, per shared slot.

    Statistics are taken once; a slot has one row per operator, and the model's is
    spread over its slot.
    """
    names = {"operator": "operator_id", "count": "offer_count", "total": "total_price", "avg": "avg_price"}
    values = F.struct(*[F.col(c).alias(n) for n, c in names.items()])
    model = F.max(F.when(F.col("role") == "model", values)).over(Window.partitionBy(*SLOT))
    beside = (
        offer_stats(offers)
        .withColumn("model", model)
        .filter((F.col("role") == "actual") & F.col("model").isNotNull())
    )
    sides = beside.select(
        *SLOT,
        *[F.col("model")[n].alias(f"model_{n}") for n in names],
        *[F.col(c).alias(f"actual_{n}") for n, c in names.items()],
    )
    diff = F.col("actual_total") - F.col("model_total")
    return sides.withColumn("price_diff", diff).withColumn("abs_price_diff", F.abs(diff))
