"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farescope.plans.session import tune, working_folder

# Fixed value: ASCII white space, as every word and line rule here means it.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, purpose: str, files: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: lost executors cost no recomputation.

    ``files`` is the most files to write, for rows that are few next to the partitions they were dealt to.
    """
    spark = df.sparkSession
    if files is not None:
        df = df.coalesce(files)
    path = working_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the runs of characters other than ASCII white space; NULL counts as empty."""
    blank = F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, " " * len(SPACE_CHARS))
    return F.filter(F.split(blank, " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, without building them: separators plus one, less empty ends."""
    t = F.coalesce(text, F.lit(""))
    pieces = F.size(F.split(t, f"{SPACE}+", -1))
    ends = F.rlike(t, F.lit(f"^{SPACE}")).cast("int") + F.rlike(t, F.lit(f"{SPACE}\\z")).cast("int")
    return F.when(t == "", F.lit(0)).otherwise(pieces - ends).cast("long")


def holds_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether the CRC32 of the id, as text, has the given remainder; a NULL id has none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def input_tasks(df: DataFrame) -> int:
    """Tasks that scan ``df``: follows the input's size, runs no job."""
    return max(1, df.rdd.getNumPartitions())


def files_for(df: DataFrame) -> int:
    """Most files for a table made from ``df``: two to each of its splits.

    A shuffle deals rows to as many partitions as the session says, however few the rows; a file each costs more
    than its rows, as a local folder's writers start processes for every file.
    """
    return 2 * input_tasks(df)


def by_batch(
    make: Callable[[pa.RecordBatch], pa.RecordBatch],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield make(batch)

    return run


def give_back() -> None:
    """Hand memory that Arrow and the C library keep after use back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def releasing(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, whose task gives memory back at its end: workers outlive their tasks."""

    def then_release(batches):
        yield from run(batches)
        give_back()

    return then_release
