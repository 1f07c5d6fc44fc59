"""Reduce a snapshot history to the chosen row (or rows) per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farescope.plans.session import working_folder


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first under ``order``.

    ``row_number() = 1`` lets Spark plan a WindowGroupLimit on both sides of the
    shuffle, so a key that holds a large share of the table sends one row per
    map task and never arrives whole in a single task. ``order`` must be total
    for the result to be repeatable.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def latest_one(
    df: DataFrame, keys: Sequence[str], stamp: str = "snapshot_ts", ties: Sequence[str] = ()
) -> DataFrame:
    """The newest row per key; equal stamps are broken by the ``ties`` columns, ascending."""
    order = [F.col(stamp).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]]
    return first_per_key(df, keys, order)


def latest_all(df: DataFrame, keys: Sequence[str], stamp: str = "snapshot_ts") -> DataFrame:
    """Every row that carries its key's newest stamp (ties kept, NULL keys dropped).

    The maximum is combined map-side, and the rows come back through a semi-join
    on key and stamp. The number of ties is not bounded, so a window over the key
    could pull a whole hot key into one task; a join is split by AQE.
    """
    best = df.groupBy(*keys).agg(F.max(stamp).alias("_best"))
    best = best.select(*[F.col(k).alias(f"_{k}") for k in keys], "_best")
    cond = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(stamp) == F.col("_best")]
    return df.join(best, cond, "left_semi")


def latest_ties(df: DataFrame, keys: Sequence[str], stamp: str = "snapshot_ts") -> DataFrame:
    """As ``latest_all``, in one scan: for keys that name an item, whose ties are few.

    ``rank() = 1`` is limited on the map side, like ``row_number() = 1``, and keeps ties.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(stamp).desc())
    ranked = df.dropna(subset=[*keys, stamp]).withColumn("_rank", F.rank().over(w))
    return ranked.filter("_rank = 1").drop("_rank")


BLOCK = 1024


def number_in_group(df: DataFrame, keys: Sequence[str], number: str, alias: str) -> DataFrame:
    """0-based position of each row by the integer column ``number`` within ``keys``.

    ``number`` must be unique per key. Positions are counted inside blocks of
    1024 consecutive numbers, so a task never sorts more than one block of a
    key; the rows before the block come from counts per block. The rows are
    written to the shared folder first, so ``df`` is evaluated once.
    """
    path = working_folder(df.sparkSession, "numbered")
    rows = df.withColumn("_block", F.floor(F.col(number) / BLOCK))
    rows.write.parquet(path)
    rows = df.sparkSession.read.schema(rows.schema).parquet(path)
    counts = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    in_block = Window.partitionBy(*keys, "_block").orderBy(number)
    return (
        rows.withColumn("_pos", F.row_number().over(in_block) - 1)
        .join(_counted_before(counts, keys, levels=1), [*keys, "_block"])
        .withColumn(alias, F.col("_pos") + F.col("_before"))
        .drop("_block", "_pos", "_before")
    )


def _counted_before(counts: DataFrame, keys: Sequence[str], levels: int) -> DataFrame:
    """(keys, _block, _before): the sum of ``_n`` over the key's earlier blocks.

    Blocks are grouped 1024 to 1 and summed the same way, ``levels`` times, so
    that a key with many blocks is not summed in one task either. What is left
    for one task is one row per 1024 ** (levels + 1) numbers.
    """
    so_far = (Window.unboundedPreceding, -1)
    if levels == 0:
        w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(*so_far)
        return counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    grouped = counts.withColumn("_group", F.floor(F.col("_block") / BLOCK))
    w = Window.partitionBy(*keys, "_group").orderBy("_block").rowsBetween(*so_far)
    totals = grouped.groupBy(*keys, F.col("_group").alias("_block")).agg(F.sum("_n").alias("_n"))
    earlier = _counted_before(totals, keys, levels - 1).select(
        *keys, F.col("_block").alias("_group"), F.col("_before").alias("_base")
    )
    return (
        grouped.withColumn("_in_group", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        .join(earlier, [*keys, "_group"])
        .select(*keys, "_block", (F.col("_base") + F.col("_in_group")).alias("_before"))
    )


_PLACES = 1 << 33  # rows that monotonically_increasing_id leaves room for in a partition


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so it is evaluated once."""
    path = working_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_in_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], alias: str, unique: bool = False
) -> DataFrame:
    """1-based place of each row under ``order`` within ``keys``; no task sees all rows of a key.

    One sort over keys and order deals the rows into ranges, so a hot key lies in many. A row's
    place is its distance from the key's first row in the range, plus the key's rows in earlier ranges;
    those are summed from one row per key and range. Rows that are equal under ``order`` are
    numbered as they come: they are dealt over ranges too, by a row number written first, so that a
    task that runs again deals them alike. ``unique`` says that there are none, which saves that table.
    Without ``keys`` all rows are one list. NULL keys are a key.
    """
    if not unique:
        df = written(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
        order = [*order, F.col("_row")]
    placed = written(
        df.orderBy(*keys, *order).withColumn("_place", F.monotonically_increasing_id()), "ordered"
    ).withColumn("_range", F.floor(F.col("_place") / _PLACES))
    earlier = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_r"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1)
    )
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return placed.join(starts, [F.col("_range") == F.col("_r"), *same]).select(
        *[c for c in df.columns if c != "_row"], (F.col("_place") + F.col("_shift")).alias(alias)
    )
