"""Continuous file pickup and duplicate removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from farescope.schemas import Feed
from farescope.sources.feeds import LINE, LISTING, land
from farescope.sources.store import insert_ignore, load_lines


def start_pickup(
    spark: SparkSession,
    feed: Feed,
    folder: str,
    base: str,
    checkpoint: str,
    files_per_batch: int = 10_000,
    continuous: bool = False,
) -> StreamingQuery:
    """Load each new file of ``folder`` once into the feed's table.

    Each micro-batch lands the lines of its files, then inserts or ignores their rows
    by key. A batch that is repeated after a failure adds nothing, so the table sees
    every row once. A late file is accepted whenever it appears; one without a header
    is noted among the rejected files.
    """
    lines = (
        spark.readStream.options(**LISTING)
        .option("maxFilesPerTrigger", files_per_batch)
        .text(folder)
        .select(*LINE)
    )

    def load(batch: DataFrame, _: int) -> None:
        load_lines(land(batch), base, feed)

    writer = lines.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    if continuous:
        return writer.start()
    return writer.trigger(availableNow=True).start()


def start_dedupe(
    stream: DataFrame, feed: Feed, base: str, checkpoint: str, continuous: bool = False
) -> StreamingQuery:
    """Keep the first row per key of a stream of silver rows in the feed's table, whatever its age."""

    def load(batch: DataFrame, _: int) -> None:
        insert_ignore(batch, base, feed)

    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return writer.start() if continuous else writer.trigger(availableNow=True).start()


def dedupe_within(stream: DataFrame, feed: Feed, delay: str) -> DataFrame:
    """First row per key, remembering keys for ``delay`` after their stamp.

    Opt-in: a file later than ``delay`` is dropped. Without that limit use
    ``insert_ignore``, which accepts files of any age. Watermarks need a zoned
    timestamp, so the stamp is copied in the session's zone (UTC has no gaps).
    """
    return (
        stream.withColumn("_event_time", F.col("snapshot_ts").cast("timestamp"))
        .withWatermark("_event_time", delay)
        .dropDuplicatesWithinWatermark(feed.primary_key)
        .drop("_event_time")
    )


def start_dedupe_within(
    stream: DataFrame, feed: Feed, delay: str, path: str, checkpoint: str, continuous: bool = False
) -> StreamingQuery:
    """Write the first row per key of a stream of silver rows to the Parquet files at ``path``.

    Keys seen live in the state store, which forgets them once the watermark has passed their stamp by
    ``delay``; so the state is bounded by the keys of that span, not by the table. A run that
    starts from the checkpoint knows the keys of the runs before, and the file sink takes each batch once.
    """
    writer = (
        dedupe_within(stream, feed, delay)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return writer.start() if continuous else writer.trigger(availableNow=True).start()
