"""The ``snap`` view written out as snapshot CSV files, for the ingest queries.

Every row is written; each half-day is one snapshot, so rows of one key can meet
in it, and insert-or-ignore chooses. Morning and afternoon files have different
headers: other column order, other case, blanks around names, an extra column.
Every row is written twice, so that the loads have duplicates to ignore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farescope.plans.proxies import snap
from farescope.plans.session import working_folder
from farescope.schemas import SEAT_PRICES_WITH_DT
from farescope.sources.feeds import list_files, read_feed, typed
from farescope.sources.store import insert_ignore, read_table

FEED = SEAT_PRICES_WITH_DT
COLUMNS = [
    "schedule_id", "seat_type", "operator_id", "date_of_journey", "departure_time",
    "hours_before_departure", "actual_fare", "price", "actual_occupancy", "expected_occupancy",
    "demand_index",
]


def write_feed(spark: SparkSession, sf_dir: str, folder: str | None = None, only: Column | None = None) -> str:
    """Write the files, of the rows that ``only`` names if given, and return their folder."""
    folder = folder or working_folder(spark, "feed")
    half = F.when(F.hour("snapshot_ts") < 12, "00-00").otherwise("12-00")
    rows = snap(spark, sf_dir).withColumn("half", half)
    rows = rows if only is None else rows.filter(only)
    file = F.concat(F.lit(f"{FEED.name}_"), F.col("date_of_journey").cast("string"), F.lit("_"), "half", F.lit(".csv"))
    rows = rows.withColumn("file", file).hint("rebalance", "file")
    rows = rows.unionAll(rows)
    forms = {
        "00-00": [F.col(c) for c in COLUMNS],
        "12-00": [F.lit("x").alias("junk"), *[F.col(c).alias(f" {c.title()} ") for c in reversed(COLUMNS)]],
    }
    for name, columns in forms.items():
        part = rows.filter(F.col("half") == name).select("file", *columns)
        part.write.partitionBy("file").option("header", "true").mode("append").csv(f"{folder}/{name}")
    return folder


def raw_rows(spark: SparkSession, folder: str) -> DataFrame:
    paths = [r.path for r in list_files(spark, folder).collect()]
    return read_feed(spark, FEED, paths)


def loaded_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = working_folder(spark, "store")
    insert_ignore(typed(raw_rows(spark, write_feed(spark, sf_dir)), FEED), base, FEED)
    return read_table(spark, base, FEED)


def stream_rows(spark: SparkSession, sf_dir: str, copies: int = 1) -> DataFrame:
    """The loaded table as a stream of silver rows, each row ``copies`` times."""
    rows = loaded_table(spark, sf_dir)
    path = working_folder(spark, "silver")
    for _ in range(copies):
        rows.write.mode("append").parquet(path)
    return spark.readStream.schema(FEED.silver_schema).option("maxFilesPerTrigger", 4).parquet(path)
