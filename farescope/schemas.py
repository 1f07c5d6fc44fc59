"""Feed definitions: raw columns, silver types, keys and date columns.

Every raw value arrives as text. ``Feed.types`` names the silver type each
column is parsed to; columns without an entry stay text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

MONEY = "decimal(18,2)"
PERCENT = "decimal(10,2)"

# Columns the loader adds from the file name, after parsing.
STAMP_COLUMNS = ("snapshot_date", "snapshot_time", "snapshot_ts")

# Expected columns of the schedule-level feed.
SEAT_PRICES_COLUMNS = (
    "expected_occupancy",
    "actual_occupancy",
    "demand_index",
    "time_step_to_check",
    "operator_id",
    "date_of_journey",
    "time_slot",
    "seat_type",
    "hours_before_departure",
    "price",
    "origin",
    "destination",
    "actual_fare",
    "schedule_id",
    "coach_layout_id",
)

# Expected columns of the seat-level feed.
SEAT_WISE_PRICES_COLUMNS = (
    "schedule_id",
    "seat_number",
    "seat_type",
    "final_price",
    "actual_fare",
    "coach_layout_id",
    "sales_count",
    "sales_percentage",
    "operator_reservation_id",
    "travel_id",
    "origin_id",
    "destination_id",
    "travel_date",
    "op_origin",
    "op_destination",
)

_SEAT_PRICES_TYPES = {
    "expected_occupancy": PERCENT,
    "actual_occupancy": PERCENT,
    "operator_id": "int",
    "date_of_journey": "date",
    "hours_before_departure": "double",
    "price": MONEY,
    "actual_fare": MONEY,
}

_SEAT_WISE_PRICES_TYPES = {
    "final_price": MONEY,
    "actual_fare": MONEY,
    "sales_count": "int",
    "sales_percentage": PERCENT,
    "origin_id": "int",
    "destination_id": "int",
    "travel_date": "date",
}


@dataclass(frozen=True)
class Feed:
    """One snapshot feed and the table it fills."""

    name: str
    columns: tuple[str, ...]
    date_column: str
    item_column: str
    types: dict[str, str] = field(default_factory=dict)

    @property
    def primary_key(self) -> list[str]:
        return [self.date_column, "schedule_id", self.item_column, "snapshot_ts"]

    @property
    def raw_schema(self) -> T.StructType:
        """Text columns of the feed plus the file they came from."""
        names = (*self.columns, "source_file")
        return T.StructType([T.StructField(c, T.StringType()) for c in names])

    @property
    def silver_schema(self) -> T.StructType:
        """Typed columns, the three stamp columns and the partition column."""
        parts = [f"{c} {self.types.get(c, 'string')}" for c in self.columns]
        parts += ["snapshot_date date", "snapshot_time string", "snapshot_ts timestamp_ntz"]
        parts += ["week_start date"]
        return T.StructType.fromDDL(", ".join(parts))


SEAT_PRICES = Feed(
    "seat_prices",
    SEAT_PRICES_COLUMNS,
    "date_of_journey",
    "seat_type",
    _SEAT_PRICES_TYPES,
)
SEAT_PRICES_WITH_DT = Feed(
    "seat_prices_with_dt",
    (*SEAT_PRICES_COLUMNS, "departure_time"),
    "date_of_journey",
    "seat_type",
    _SEAT_PRICES_TYPES,
)
SEAT_WISE_PRICES = Feed(
    "seat_wise_prices",
    SEAT_WISE_PRICES_COLUMNS,
    "travel_date",
    "seat_number",
    _SEAT_WISE_PRICES_TYPES,
)
SEAT_WISE_PRICES_WITH_DT = Feed(
    "seat_wise_prices_with_dt",
    SEAT_WISE_PRICES_COLUMNS,
    "travel_date",
    "seat_number",
    _SEAT_WISE_PRICES_TYPES,
)

FEEDS = {
    f.name: f
    for f in (
        SEAT_PRICES,
        SEAT_WISE_PRICES,
        SEAT_PRICES_WITH_DT,
        SEAT_WISE_PRICES_WITH_DT,
    )
}
