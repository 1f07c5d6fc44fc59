"""The date-partitioned table of each feed: append, insert-or-ignore, ledger, JSON."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from itertools import islice

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farescope.functions import scalars as S
from farescope.operators.filters import in_date_range
from farescope.operators.latest import first_per_key
from farescope.plans.session import ADVISORY, FILE_BYTES, setting, size_shuffles, tune
from farescope.schemas import FEEDS, Feed
from farescope.sources.feeds import land, list_files, parse_lines, plain_path, read_lines, typed

LEDGER_SCHEMA = "feed string, path string, modified timestamp"
MARKS_SCHEMA = "feed string, folder string, modified long"
COLUMNS_SCHEMA = "column_name string, added_at timestamp"
GENERATIONS_SCHEMA = "week_start date, gen int"
REJECTED_SCHEMA = "feed string, path string, reason string"


def table_path(base: str, feed: Feed) -> str:
    return f"{base.rstrip('/')}/{feed.name}"


def columns_path(base: str, feed: Feed) -> str:
    return f"{base.rstrip('/')}/_columns/{feed.name}"


def generations_path(base: str, feed: Feed) -> str:
    return f"{base.rstrip('/')}/_generations/{feed.name}"


def files_path(base: str) -> str:
    """The files that loads have seen, by status: one write notes both kinds."""
    return f"{base.rstrip('/')}/_files"


def ledger_path(base: str) -> str:
    return f"{files_path(base)}/status=loaded"


def rejected_path(base: str) -> str:
    return f"{files_path(base)}/status=noted"


def marks_path(base: str) -> str:
    """How far each folder has been loaded, by its files' times of change."""
    return f"{base.rstrip('/')}/_marks"


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    return spark.range(1).filter(F.lit(False)).select(*none)  # known to be empty when joins with it are planned


def added_columns(spark: SparkSession, base: str, feed: Feed) -> list[str]:
    """Names of the columns that loads have added to the feed's table, oldest first."""
    log = read_or_empty(spark, columns_path(base, feed), COLUMNS_SCHEMA)
    first = log.groupBy("column_name").agg(F.min("added_at").alias("added_at"))
    return [r.column_name for r in first.orderBy("added_at", "column_name").collect()]


def stored_schema(spark: SparkSession, base: str, feed: Feed) -> T.StructType:
    """The feed's columns and those added since, as text; the partition column comes last."""
    *own, week = feed.silver_schema.fields
    added = [T.StructField(c, T.StringType()) for c in added_columns(spark, base, feed)]
    return T.StructType([*own, *added, week])


def _generations(spark: SparkSession, base: str, feed: Feed) -> dict[dt.date, int]:
    """The newest generation of each week that has been compacted; the driver sees one line a week."""
    log = read_or_empty(spark, generations_path(base, feed), GENERATIONS_SCHEMA)
    return {r.week_start: r.gen for r in log.groupBy("week_start").agg(F.max("gen").alias("gen")).collect()}


def _current(generations: dict[dt.date, int]) -> Column:
    """Whether a row is of its week's newest generation or later; says so by partition columns alone."""
    if not generations:
        return F.lit(True)
    pairs = [F.lit(x) for pair in generations.items() for x in pair]
    return F.col("gen") >= F.coalesce(F.create_map(*pairs)[F.col("week_start")], F.lit(0))


def _stored(spark: SparkSession, base: str, feed: Feed, every_column: bool) -> DataFrame:
    """All rows on disk, with their generation."""
    schema = stored_schema(spark, base, feed) if every_column else feed.silver_schema
    schema = T.StructType([*schema.fields, T.StructField("gen", T.IntegerType())])
    return read_or_empty(tune(spark, fine=True), table_path(base, feed), schema)


def read_table(spark: SparkSession, base: str, feed: Feed, every_column: bool = False) -> DataFrame:
    """The feed's table; with ``every_column`` also the added ones, NULL in rows of older files."""
    rows = _stored(spark, base, feed, every_column).filter(_current(_generations(spark, base, feed))).drop("gen")
    size_shuffles(rows)
    return rows


def common_columns(df: DataFrame, target: Sequence[str]) -> DataFrame:
    """The frame's columns that the target has, matched without regard to case."""
    have = {c.strip().lower(): c for c in df.columns}
    return df.select(*[F.col(f"`{have[c.lower()]}`").alias(c) for c in target if c.lower() in have])


def conform(df: DataFrame, feed: Feed, stored: T.StructType | None = None) -> DataFrame:
    """A typed frame in the table's shape: the feed's own, or that of ``stored``.

    Columns are matched without regard to case; others are dropped, absent ones
    are NULL, and the week follows from the date.
    """
    schema = [f for f in (stored or feed.silver_schema).fields if f.name != "week_start"]
    rows = common_columns(df, [f.name for f in schema])
    rows = rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )
    return rows.withColumn("week_start", S.week_start(F.col(feed.date_column)))


def with_columns_of(df: DataFrame, other: DataFrame) -> DataFrame:
    """``df`` plus the columns only ``other`` has, as NULL text."""
    have = {c.lower() for c in df.columns}
    unseen = {c: F.lit(None).cast("string") for c in other.columns if c.lower() not in have}
    return df.withColumns(unseen) if unseen else df


def grow(df: DataFrame, base: str, feed: Feed) -> DataFrame:
    """``df`` in the table's shape, after adding to the table every column it has not seen.

    A column is added by a line in the table's log of columns, as text; files that are there stay as they are.
    Names are matched without regard to case and outer blanks. Adding a column again, or at the same
    time as another load, changes nothing.
    """
    spark = df.sparkSession
    known = {c.lower() for c in stored_schema(spark, base, feed).names}
    unseen = sorted({c.strip().lower() for c in df.columns} - known)
    if unseen:
        rows = spark.createDataFrame([(c,) for c in unseen], "column_name string")
        rows = rows.withColumn("added_at", F.current_timestamp()).coalesce(1)
        rows.write.mode("append").parquet(columns_path(base, feed))
    return conform(df, feed, stored_schema(spark, base, feed))


def _write(df: DataFrame, base: str, feed: Feed, gen: int) -> None:
    rows = df.hint("rebalance", "week_start").sortWithinPartitions("week_start", "schedule_id", "snapshot_ts")
    # Files are larger than what a task reads of a shuffle elsewhere.
    with setting(df.sparkSession, ADVISORY, FILE_BYTES):
        rows.write.mode("append").partitionBy("week_start").parquet(f"{table_path(base, feed)}/gen={gen}")


def append(df: DataFrame, base: str, feed: Feed) -> None:
    """Add rows to the feed's table, one folder per week.

    Rebalancing by week keeps files large and lets AQE split a week that holds
    much of the data; sorting by schedule makes row groups skippable.
    """
    generations = _generations(df.sparkSession, base, feed)
    _write(df, base, feed, max(generations.values(), default=0))


def compact(spark: SparkSession, base: str, feed: Feed, most_files: int = 16) -> int:
    """Rewrite the weeks that lie in more than ``most_files`` files; returns how many weeks.

    The rows of such a week are written again as a new generation, then a line in the log of generations
    switches readers to it: a reader sees the old files or the new ones, and a run that is lost in between has
    changed nothing. The files that were left stay until the week is compacted the next time, for readers that had
    listed them; those left before are emptied. Loads and compactions of a feed take turns; readers need not wait.
    """
    generations = _generations(spark, base, feed)
    live = _stored(spark, base, feed, True).filter(_current(generations))
    files = live.select("week_start", "gen", F.col("_metadata.file_path").alias("file"))
    crowded = files.groupBy("week_start").agg(F.count_distinct("file").alias("n")).filter(F.col("n") > most_files)
    weeks = [r.week_start for r in crowded.collect()]
    if not weeks:
        return 0
    chosen = F.col("week_start").isin(weeks)
    gen = max(generations.values(), default=0) + 1
    # What a lost run may have left of this generation goes first.
    half_done = _stored(spark, base, feed, False).filter(chosen & (F.col("gen") == gen))
    left = _stored(spark, base, feed, False).filter(chosen & ~_current(generations)) if generations else None
    for old in (half_done, left):
        if old is not None:
            _empty(spark, base, feed, old.select("gen", "week_start").distinct().collect())
    _write(live.filter(chosen).drop("gen"), base, feed, gen)
    log = spark.createDataFrame([(w, gen) for w in weeks], GENERATIONS_SCHEMA)
    log.coalesce(1).write.mode("append").parquet(generations_path(base, feed))
    return len(weeks)


def _empty(spark: SparkSession, base: str, feed: Feed, folders: Sequence[Row]) -> None:
    *own, _ = feed.silver_schema.fields
    nothing = spark.createDataFrame([], T.StructType(own))
    for f in folders:
        nothing.write.mode("overwrite").parquet(f"{table_path(base, feed)}/gen={f.gen}/week_start={f.week_start}")


def only_weeks_of(target: DataFrame, new: DataFrame) -> DataFrame:
    """``target`` limited to the partitions of the weeks that occur in ``new``, however far apart they are.

    The driver sees the distinct weeks: some fifty a year of journeys.
    """
    weeks = [r.week_start for r in new.select("week_start").distinct().collect()]
    return target.filter(F.col("week_start").isin(weeks) if weeks else F.lit(False))


def only_keys_near(target: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``target`` limited to the range that each key column has in the complete keys of ``new``.

    No key is lost by that. The table's files are in order of schedule and stamp, so Parquet leaves out the parts of
    them that a load of few stamps or schedules cannot meet: what it reads follows the load, not the table.
    """
    types = {f.name: f.dataType for f in target.schema.fields}
    ends = [end(c).cast("string").alias(f"{name}_{c}") for c in key for name, end in (("low", F.min), ("high", F.max))]
    found = new.dropna(subset=list(key)).agg(*ends).first()
    for c in key:
        low, high = (F.lit(found[f"{name}_{c}"]).cast(types[c]) for name in ("low", "high"))
        target = target.filter(F.col(c).between(low, high))
    return target


def new_rows(new: DataFrame, target: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``new`` with a complete key that ``target`` lacks, one per key.

    The keys of ``target`` that ``new`` has are found first, by a semi-join on week and key: there Spark can
    test the rows of a large table against a Bloom filter of the new keys before it shuffles them.
    """
    rest = [c for c in new.columns if c not in key]
    complete = new.dropna(subset=list(key))
    once = first_per_key(complete, key, [F.col(c).asc_nulls_last() for c in rest])
    wide = list(dict.fromkeys(["week_start", *key])) if "week_start" in new.columns else list(key)
    known = target.select(*wide).join(complete.select(*wide), wide, "left_semi")
    return once.join(known.select(*key), list(key), "left_anti").select(*new.columns)


def insert_ignore(new: DataFrame, base: str, feed: Feed) -> int:
    """Append the rows whose key is not in the table yet; returns how many.

    Running it again with the same rows adds nothing, so a retried load is safe.
    """
    held = new.is_cached
    new = new if held else new.persist(StorageLevel.DISK_ONLY)
    try:
        table = read_table(new.sparkSession, base, feed)
        target = only_keys_near(only_weeks_of(table, new), new, feed.primary_key)
        fresh = new_rows(new, target, feed.primary_key).persist(StorageLevel.DISK_ONLY)
        try:
            n = fresh.count()
            if n:
                append(fresh, base, feed)
            return n
        finally:
            fresh.unpersist()
    finally:
        if not held:
            new.unpersist()


def migrate(source: DataFrame, base: str, feed: Feed, start: str, end: str) -> int:
    """Insert-or-ignore for the dates ``start <= date < end``."""
    return insert_ignore(in_date_range(source, feed.date_column, start, end), base, feed)


def new_files(spark: SparkSession, folder: str, base: str, feed: Feed, since: int | None = None) -> DataFrame:
    """Files not in the ledger, which is keyed by feed and full path; with ``since`` only those changed after it.

    Then the ledger, too, is read from there on: an entry has its file's time of change.
    """
    done = read_or_empty(spark, ledger_path(base), LEDGER_SCHEMA)
    if since is not None:
        done = done.filter(F.col("modified").isNull() | (F.col("modified") >= F.timestamp_seconds(F.lit(since))))
    found = list_files(spark, folder, since).withColumn("feed", F.lit(feed.name))
    return found.join(done.select("feed", "path"), ["feed", "path"], "left_anti").select("feed", "path", "modified")


def loaded_until(spark: SparkSession, folder: str, base: str, feed: Feed) -> int | None:
    """The newest time of change, in seconds, among the files that complete loads of the folder have taken."""
    marks = read_or_empty(spark, marks_path(base), MARKS_SCHEMA)
    own = marks.filter((F.col("feed") == feed.name) & (F.col("folder") == folder.rstrip("/")))
    return own.agg(F.max("modified")).first()[0]


def fold_ledger(spark: SparkSession, base: str, most_files: int = 16, small: int = 32 << 20) -> int:
    """Write the ledger's files below ``small`` bytes together if there are more than ``most_files``; returns how many.

    Large ones stay, so what is rewritten does not follow the ledger's age. Entries are in order of their files' times,
    so a load that looks back a little skips the others. The new files are there before the old ones go; entries
    that stand twice after a failure in between change nothing. Loads and folds take turns.
    """
    path = ledger_path(base)
    if not path_exists(spark, path):
        return 0
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    old = [r.path for r in files.filter(F.col("length") < small).select("path").collect()]
    if len(old) <= most_files:
        return 0
    entries = spark.read.schema(LEDGER_SCHEMA).parquet(*old)
    entries.groupBy("feed", "path").agg(F.max("modified").alias("modified")).orderBy("modified", "path").write.mode(
        "append"
    ).parquet(path)
    for file in old:
        p = spark._jvm.org.apache.hadoop.fs.Path(file)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False)
    return len(old)


def rejected_files(spark: SparkSession, base: str) -> DataFrame:
    """Files that something is wrong with, and what.

    Those without a header are not loaded, and each run looks at them again; those with an unpaired quote
    are loaded, every line as a record.
    """
    return read_or_empty(spark, rejected_path(base), REJECTED_SCHEMA).distinct()


NO_HEADER = "no header"
UNPAIRED = "unpaired quote: read line by line"


def load_lines(lines: DataFrame, base: str, feed: Feed, paths: DataFrame | None = None) -> int:
    """Insert the rows of landed lines, then note their files, or ``paths`` (path, modified), as loaded or rejected.

    A file whose quotes do not pair up is loaded line by line, and noted too.
    """
    raw, notes = parse_lines(lines, feed)
    total = insert_ignore(typed(raw, feed), base, feed)
    files = notes.select(plain_path(F.col("file_path")).alias("path"), "unpaired", "has_header")
    if paths is not None:
        files = paths.distinct().join(files, "path", "left")
    else:
        files = files.withColumn("modified", F.lit(None).cast("timestamp"))
    headed = F.coalesce("has_header", F.lit(False))

    def entry(status: str, reason: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), reason.alias("reason"))

    entries = F.array(
        F.when(headed, entry("loaded", F.lit(None).cast("string"))),
        F.when(~headed, entry("noted", F.lit(NO_HEADER))),
        F.when(F.col("unpaired"), entry("noted", F.lit(UNPAIRED))),
    )
    (
        files.withColumn("e", F.explode(F.filter(entries, lambda e: e.isNotNull())))
        .select(F.lit(feed.name).alias("feed"), "path", "modified", "e.*")
        .coalesce(1)
        .write.mode("append")
        .partitionBy("status")
        .parquet(files_path(base))
    )
    return total


def load_folder(
    spark: SparkSession,
    folder: str,
    base: str,
    feed: Feed,
    files_per_round: int = 10_000,
    look_back: dt.timedelta | None = None,
) -> int:
    """Load every new file, oldest name first, in rounds of bounded size.

    The folder is listed once; the driver holds one round's file names at a time.
    The ledger is written after the rows. A failure in between makes the next
    run read those files again, and insert-or-ignore then adds nothing twice.
    A file without a header goes to the table of rejected files.

    With ``look_back``, files are taken that have changed since that long before the newest one that complete
    loads of this folder have taken: neither the names nor the ledger entries of older files are read. A late file
    with an old name is taken, as its time of change is new; one that was put there with a time of change further back
    needs a load without ``look_back``, and so does a file without a header that is to be looked at again.
    """
    mark = None if look_back is None else loaded_until(spark, folder, base, feed)
    since = None if mark is None else mark - int(look_back.total_seconds()) - 1
    files = new_files(spark, folder, base, feed, since)
    total, newest = 0, mark
    todo = files.orderBy("path").toLocalIterator()
    while found := list(islice(todo, files_per_round)):
        names = spark.createDataFrame([(r.path, r.modified) for r in found], "path string, modified timestamp")
        total += load_lines(land(read_lines(spark, [r.path for r in found])), base, feed, names)
        newest = max([int(r.modified.timestamp()) for r in found] + [newest or 0])
    if look_back is not None and newest != mark:
        line = spark.createDataFrame([(feed.name, folder.rstrip("/"), newest)], MARKS_SCHEMA)
        line.coalesce(1).write.mode("append").parquet(marks_path(base))
    return total


def load_all(spark: SparkSession, folders: dict[str, str], base: str) -> dict[str, int]:
    """``load_folder`` for several feeds, by feed name."""
    return {name: load_folder(spark, f, base, FEEDS[name]) for name, f in folders.items()}


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines with ISO dates and timestamps, NULL fields written out."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
