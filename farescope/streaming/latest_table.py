"""A newest-rows-per-key table kept up to date by micro-batches, merged when it is read.

A batch writes its own newest rows, as a delta of each week it touches, to
``rows/batch_id=N/week_start=W``; then ``versions`` records (W, N). Only when the deltas of a week have
grown to the size of its folded rows, or to ``MOST_DELTAS``, are both folded into one version of
the week, under the batch that brought it that far. So what is written follows the batches, and
what is read is at most about twice the table. A reader takes the newest folded version of a
week and the deltas after it, so it never sees a half-written batch, and a repeated batch replaces its own
output. Batches that no week needs are emptied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from farescope.operators.latest import latest_one
from farescope.schemas import Feed
from farescope.sources.store import read_or_empty

VERSIONS_SCHEMA = "week_start date, batch_id bigint, folded boolean, row_count bigint, keys array<string>"
EMPTIED_SCHEMA = "batch_id bigint"
MOST_DELTAS = 32


def latest_keys(feed: Feed) -> list[str]:
    return [feed.date_column, "schedule_id", feed.item_column]


def _live(spark: SparkSession, path: str, before: int | None) -> DataFrame:
    """week_start, batch_id, folded, row_count: each week's newest folded version and the deltas after it."""
    versions = read_or_empty(spark, f"{path}/versions", VERSIONS_SCHEMA)
    if before is not None:
        versions = versions.filter(F.col("batch_id") < before)
    # A repeated batch is recorded twice, with the same rows.
    once = versions.groupBy("week_start", "batch_id").agg(
        F.max("folded").alias("folded"), F.max("row_count").alias("row_count")
    )
    base = once.filter("folded").groupBy("week_start").agg(F.max("batch_id").alias("base"))
    return once.join(base, "week_start", "left").filter("base IS NULL OR batch_id >= base").drop("base")


def _live_rows(spark: SparkSession, path: str, schema: T.StructType, live: DataFrame) -> DataFrame:
    stored = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    rows = read_or_empty(spark, f"{path}/rows", stored)
    return rows.join(live.select("week_start", "batch_id"), ["week_start", "batch_id"], "left_semi").select(*schema.names)


def read_latest(
    spark: SparkSession, path: str, schema: T.StructType, before: int | None = None
) -> DataFrame:
    """The newest rows per key, optionally as of the state before a batch.

    Weeks of one version are read as they are; the rows of others are merged by key.
    """
    keyed = read_or_empty(spark, f"{path}/versions", VERSIONS_SCHEMA).select("keys").first()
    if keyed is None:
        return spark.createDataFrame([], schema)
    live = _live(spark, path, before)
    several = live.groupBy("week_start").count().filter("count > 1").select("week_start")
    whole = _live_rows(spark, path, schema, live.join(several, "week_start", "left_anti"))
    parts = _live_rows(spark, path, schema, live.join(several, "week_start", "left_semi"))
    return whole.unionByName(_newest(parts, keyed.keys))


def _newest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in (*keys, "snapshot_ts")]
    return latest_one(df.dropna(subset=[*keys, "snapshot_ts"]), keys, ties=rest)


def merge_batch(
    batch: DataFrame, batch_id: int, path: str, keys: Sequence[str], most_deltas: int = MOST_DELTAS
) -> None:
    """Fold one micro-batch into the table, one row per key.

    Key and stamp identify a row of a feed's table; should two rows share both,
    the remaining columns decide, so a repeated batch gives the same table.
    """
    spark = batch.sparkSession
    batch = _newest(batch, keys).persist()
    try:
        live = _live(spark, path, batch_id)
        held = live.groupBy("week_start").agg(
            F.sum(F.when(F.col("folded"), F.col("row_count"))).alias("base_rows"),
            F.sum(F.when(~F.col("folded"), F.col("row_count"))).alias("delta_rows"),
            F.count_if(~F.col("folded")).alias("deltas"),
        )
        grown = F.col("n") + F.coalesce("delta_rows", F.lit(0)) >= F.coalesce("base_rows", F.lit(0))
        weeks = (
            batch.groupBy("week_start")
            .agg(F.count(F.lit(1)).alias("n"))
            .join(held, "week_start", "left")
            .select("week_start", (grown | (F.col("deltas") + 1 >= most_deltas)).alias("fold"))
            .collect()  # one row a week of the batch
        )
        folding = [w.week_start for w in weeks if w.fold]
        out = batch
        if folding:
            chosen = F.col("week_start").isin(folding)
            # Only the weeks that are folded are read.
            old = _live_rows(spark, path, batch.schema, live).filter(chosen)
            out = _newest(old.unionByName(batch.filter(chosen)), keys).unionByName(batch.filter(~chosen))
        written = f"{path}/rows/batch_id={batch_id}"
        out.hint("rebalance", "week_start").write.mode("overwrite").partitionBy("week_start").parquet(written)
        done = (
            spark.read.schema(batch.schema).parquet(written)
            .groupBy("week_start")
            .agg(F.count(F.lit(1)).alias("row_count"))
            .select(
                "week_start",
                F.lit(batch_id).cast("bigint").alias("batch_id"),
                F.col("week_start").isin(folding).alias("folded") if folding else F.lit(False).alias("folded"),
                "row_count",
                F.array(*map(F.lit, keys)).alias("keys"),
            )
        )
        done.coalesce(1).write.mode("append").parquet(f"{path}/versions")
        empty_superseded(spark, path, batch_id, batch.schema)
    finally:
        batch.unpersist()


def empty_superseded(spark: SparkSession, path: str, batch_id: int, schema: T.StructType) -> None:
    """Empty the batches before ``batch_id`` of which no week is current any more.

    What ``batch_id`` itself would read when repeated stays. So the rows on disk are those of
    the live table, of one batch before, and of batches that still hold a live week.
    """
    versions = read_or_empty(spark, f"{path}/versions", VERSIONS_SCHEMA)
    live = _live(spark, path, batch_id).union(_live(spark, path, None))
    emptied = read_or_empty(spark, f"{path}/emptied", EMPTIED_SCHEMA)
    dead = (
        versions.select("batch_id")
        .distinct()
        .join(live, "batch_id", "left_anti")
        .join(emptied, "batch_id", "left_anti")
    )
    ids = [r.batch_id for r in dead.collect()]  # of batches that ended since the last call
    for dead_id in ids:
        spark.createDataFrame([], schema).write.mode("overwrite").partitionBy("week_start").parquet(
            f"{path}/rows/batch_id={dead_id}"
        )
    if ids:
        spark.createDataFrame([(i,) for i in ids], EMPTIED_SCHEMA).coalesce(1).write.mode("append").parquet(
            f"{path}/emptied"
        )


def start_latest_table(
    stream: DataFrame, feed: Feed, path: str, checkpoint: str, continuous: bool = False
) -> StreamingQuery:
    """Maintain the newest rows per (date, schedule, item) of a stream of silver rows."""
    keys = latest_keys(feed)
    writer = stream.writeStream.foreachBatch(
        lambda batch, batch_id: merge_batch(batch, batch_id, path, keys)
    ).option("checkpointLocation", checkpoint)
    return writer.start() if continuous else writer.trigger(availableNow=True).start()
