"""Session settings that the plans rely on, and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"

# Applied only where the session has no value of its own.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even when that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A Bloom filter of a load's keys, of a bounded number of bits, is worth its scan against a table far larger.
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "2g",
}

# For the tables of numbers: a task's sorts and hash tables hold several times the rows it reads, and a Parquet file
# packs them into some 20 bytes each, so small splits and shuffle reads bound a task's memory, whatever the input.
FINE = {"spark.sql.files.maxPartitionBytes": "16m", ADVISORY: "16m"}

BYTES_PER_SHUFFLE_PARTITION = 64 << 20
UNPACKED = 8  # bytes of rows in memory to one byte of their files
FILE_BYTES = "64m"
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
DEFAULT = "farescope.shuffle.default"


def tune(spark: SparkSession, fine: bool = False) -> SparkSession:
    """Set the runtime options the operators expect, ``fine`` splits among them, keeping any the caller has set."""
    for key, value in (SETTINGS | FINE if fine else SETTINGS).items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def size_shuffles(*tables: DataFrame) -> None:
    """Start shuffles with enough partitions for these scans; AQE merges the small ones.

    The number follows the scans' splits, without running a job: up for large tables, and
    back down to the session's own value for small ones.
    """
    spark = tables[0].sparkSession
    if spark.conf.get(DEFAULT, None) is None:
        own = spark.conf.get(INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set(DEFAULT, own)
    splits = sum(t.rdd.getNumPartitions() for t in tables)
    size = splits * _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) * UNPACKED
    spark.conf.set(INITIAL, str(max(int(spark.conf.get(DEFAULT)), size // BYTES_PER_SHUFFLE_PARTITION)))


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Run what is inside with a setting of its own."""
    own = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, own)


def _bytes(text: str) -> int:
    """A size setting such as 134217728b or 128MB in bytes."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", text.strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit[:1]]


def working_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder all executors can reach, under the session's checkpoint folder.

    Only a local session may leave ``spark.checkpoint.dir`` unset; a temporary
    folder takes its place there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="farescope-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
