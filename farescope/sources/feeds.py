"""Snapshot CSV files to typed rows.

Raw files are read once, as lines, and land in the shared folder. From there lines
become CSV records, a quoted line break included. Columns are matched by name per
file: all records are parsed at once into cells, and the header of a record's file, joined to it,
says which cell is which column. A file without a header is reported, never taken as loaded.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farescope.functions import scalars as S
from farescope.plans.session import working_folder
from farescope.schemas import STAMP_COLUMNS, Feed

# Texts a data-frame CSV reader takes as missing.
MISSING_TEXT = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# A quote inside a quoted value is doubled.
CSV = {"escape": '"'}
LISTING = {"recursiveFileLookup": "true", "pathGlobFilter": "*.csv"}


LINE = ("value", "_metadata.file_path", "_metadata.file_block_start")
LANDED = ("file_path", "file_block_start", "line_id", "value")


def list_files(spark: SparkSession, folder: str, since: int | None = None) -> DataFrame:
    """Path and time of change of the CSV files under ``folder``; the contents are not read.

    ``since``, in seconds of the epoch, leaves out files that have not changed after it.
    """
    reader = spark.read.format("binaryFile").options(**LISTING)
    if since is not None:
        after = dt.datetime.fromtimestamp(since, dt.UTC).strftime("%Y-%m-%dT%H:%M:%S")
        reader = reader.option("timeZone", "UTC").option("modifiedAfter", after)
    return reader.load(folder).select("path", F.col("modificationTime").alias("modified"))


def is_header(line: Column, feed: Feed) -> Column:
    """Whether a line has a cell that is one of the feed's column names."""
    names = "|".join(feed.columns)
    return F.lower(line).rlike(rf'(^|,)[\s"\x{{FEFF}}]*({names})[\s"]*(,|$)')


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.text(list(paths)).select(*LINE)


def _landed(df: DataFrame, purpose: str) -> DataFrame:
    path = working_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def land(lines: DataFrame) -> DataFrame:
    """Lines of raw files, written to the shared folder and read back: the files themselves are read once."""
    return _landed(lines.withColumn("line_id", F.monotonically_increasing_id()).select(*LANDED), "lines")


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.translate(line, '"', ""))


def _place() -> Column:
    return F.struct("file_block_start", "line_id")


def file_notes(lines: DataFrame, feed: Feed) -> DataFrame:
    """file_path, unpaired, spans, header: what each file of landed lines needs to be read.

    ``unpaired`` says that a file's quotes do not pair up, ``spans`` that a quoted value may hold
    a line break: some line has an odd number of quotes, and they pair up. ``header`` is the place and text
    of the first line that names a column: mostly the file's first line, and only files where it is not are
    searched. One row per file, written to the shared folder.
    """
    q, line = _quotes(F.col("value")), F.struct("file_block_start", "line_id", "value")
    first = F.min(F.when(F.col("file_block_start") == 0, F.col("line_id"))).alias("first")
    quotes = lines.groupBy("file_path").agg(F.sum(q).alias("quotes"), F.max(q % 2).alias("odd"), first)
    quotes = _landed(quotes, "quotes")
    firsts = quotes.select(F.col("file_path").alias("named"), F.col("first").alias("line_id"))
    begins = lines.filter("file_block_start = 0").join(firsts, "line_id").filter("file_path = named")
    begins = _landed(begins.select("named", line.alias("header")), "begins")  # or Spark tests every line before the join
    begins = begins.filter(is_header(F.col("header.value"), feed))
    others = quotes.select("file_path").join(begins, F.col("file_path") == F.col("named"), "left_anti")
    named = lines.join(others, "file_path", "left_semi").filter(is_header(F.col("value"), feed))
    named = named.groupBy(F.col("file_path").alias("named")).agg(F.min(line).alias("header"))
    unpaired = F.col("quotes") % 2 == 1
    notes = quotes.join(begins.unionByName(named), F.col("file_path") == F.col("named"), "left").select(
        "file_path", unpaired.alias("unpaired"), ((F.col("odd") == 1) & ~unpaired).alias("spans"), "header"
    )
    return _landed(notes, "files")


def joined_records(lines: DataFrame) -> DataFrame:
    """file_path, file_block_start, line_id, value: lines joined while a quoted value is open.

    Whether a line begins inside a value follows from the quotes before it: those of the file's earlier
    blocks, summed from one row a block, and those of earlier lines of its block. So a task orders
    the lines of a block, not of a file. A record stands at the place of its first line, which may lie blocks before.
    """
    block = ["file_path", "file_block_start"]
    earlier_blocks = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*block).orderBy("line_id")
    counted = lines.withColumn("quotes", _quotes(F.col("value")))
    before = (
        counted.groupBy(*block)
        .agg(F.sum("quotes").alias("n"))
        .select(*block, F.coalesce(F.sum("n").over(earlier_blocks), F.lit(0)).alias("before"))
    )
    in_block = F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = (F.col("before") + F.col("in_block")) % 2 == 0
    marked = (
        counted.join(before, block)
        .withColumn("in_block", in_block)
        .withColumn("first", F.when(begins, _place()))
        .withColumn("first", F.last("first", ignorenulls=True).over(inside))
        .select(*LANDED, "first")
    )
    marked = _landed(marked, "marked")
    # A record that is open where a block begins: the last one that began in an earlier block.
    open_ = (
        marked.groupBy(*block)
        .agg(F.max("first").alias("last"))
        .select(*block, F.last("last", ignorenulls=True).over(earlier_blocks).alias("carried"))
    )
    parts = F.array_sort(F.collect_list(F.struct("file_block_start", "line_id", "value")))
    return (
        marked.join(open_, block)
        .groupBy("file_path", F.coalesce("first", "carried").alias("first"))
        .agg(F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("value"))
        .select("file_path", "first.*", "value")
    )


def _cells(line: Column, width: int) -> Column:
    """The cells of a record, as an array of ``width`` texts; those of a record without quotes lie between its commas.

    The CSV parser sees the other records only: it takes far longer, most of all where the number of cells is not ``width``.
    """
    names = [f"c{i}" for i in range(width)]
    parsed = F.array(F.from_csv(line, ", ".join(f"{n} string" for n in names), CSV))
    parsed = F.transform(parsed, lambda row: F.array(*[row[n] for n in names]))[0]  # parsed once, not once a cell
    plain = ~(line.contains('"') | line.contains("\r") | line.contains("\n") | line.contains("\0"))
    return F.when(plain, F.split(line, ",")).otherwise(parsed)


def parse_lines(lines: DataFrame, feed: Feed) -> tuple[DataFrame, DataFrame]:
    """(rows of text columns, notes of the files: file_path, unpaired, has_header) of landed lines.

    Every record is parsed once into an array of cells, whatever headers there are; the header of
    its file, joined to it, says which cell is which column. Expected columns a file lacks are NULL.
    A file's stamps come with its header, so that its name is parsed once; ``typed`` takes them. The driver sees the largest number of cells and whether any value spans lines.
    """
    files = file_notes(lines, feed)
    kept = ["file_path", "unpaired", "header"]
    records, heads = lines, files.filter(~F.col("spans")).select(*kept)
    commas = F.length("header.value") - F.length(F.translate(F.col("header.value"), ",", ""))
    width, spans = files.agg(F.max(commas + 1), F.max("spans")).first()
    if spans:
        flagged = lines.join(files.select("file_path", "spans"), "file_path")
        whole = _landed(joined_records(flagged.filter("spans").select(*LANDED)), "records")
        named = whole.filter(is_header(F.col("value"), feed)).groupBy("file_path")
        named = named.agg(F.min(F.struct("file_block_start", "line_id", "value")).alias("header"))
        more = files.filter("spans").drop("header").join(named, "file_path", "left").select(*kept)
        heads = _landed(heads.unionByName(more), "heads")
        records = flagged.filter("NOT spans").select(*LANDED).unionByName(whole.select(*LANDED))
        width = heads.agg(F.max(commas + 1)).first()[0]
    notes = heads.select("file_path", "unpaired", F.col("header").isNotNull().alias("has_header"))
    if width is None:
        return lines.sparkSession.createDataFrame([], feed.raw_schema), notes
    header = F.regexp_replace(F.col("header.value"), "^\ufeff", "")
    names = F.transform(_cells(header, width), lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")))
    places = F.transform(F.array(*map(F.lit, feed.columns)), lambda c: F.array_position("names", c))
    dimension = (
        heads.filter("header IS NOT NULL")
        .select("file_path", F.struct("header.file_block_start", "header.line_id").alias("header_place"), names.alias("names"))
        .select("file_path", "header_place", places.alias("places"), *_stamps(F.col("file_path")))
    )

    def value(place: Column) -> Column:
        text = F.get("cells", (place - 1).cast("int"))
        return F.when(~text.isin(*MISSING_TEXT), text)

    rows = (
        records.join(dimension, "file_path")
        .filter((_place() > F.col("header_place")) & (F.trim("value") != ""))
        .select("file_path", "places", *STAMPS, _cells(F.col("value"), width).alias("cells"))
        # All values in one expression: one a column makes a function too long for the JVM to compile.
        .withColumn("values", F.transform("places", value))
    )
    columns = [F.get("values", F.lit(i)).alias(c) for i, c in enumerate(feed.columns)]
    return rows.select(*columns, F.col("file_path").alias("source_file"), *STAMPS), notes


def read_feed(spark: SparkSession, feed: Feed, paths: Iterable[str]) -> DataFrame:
    paths = list(paths)
    if not paths:
        return spark.createDataFrame([], feed.raw_schema)
    return parse_lines(land(read_lines(spark, paths)), feed)[0]


def plain_path(file_path: Column) -> Column:
    """The path of a file as a listing names it."""
    return F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))


STAMPS = [f"_{c}" for c in STAMP_COLUMNS]


def _stamps(file: Column) -> list[Column]:
    parsed = S.file_snapshot_date(file), S.file_snapshot_time(file), S.file_snapshot_ts(file)
    return [c.alias(name) for c, name in zip(parsed, STAMPS, strict=True)]


def typed(raw: DataFrame, feed: Feed) -> DataFrame:
    """Parse text to silver types, add the file's stamp and the week of the journey.

    Bad values become NULL. The stamp is parsed from ``source_file`` unless ``parse_lines`` has done so. Columns outside the feed are dropped, absent ones are NULL.
    """
    text = [F.col(c) if c in raw.columns else F.lit(None).cast("string") for c in feed.columns]
    columns = [
        S.parse(t, feed.types.get(c, "string")).alias(c)
        for c, t in zip(feed.columns, text, strict=True)
    ]
    stamps = list(map(F.col, STAMPS)) if set(STAMPS) <= set(raw.columns) else _stamps(F.col("source_file"))
    rows = raw.select(*columns, *[c.alias(name) for c, name in zip(stamps, STAMP_COLUMNS, strict=True)])
    return rows.withColumn("week_start", S.week_start(F.col(feed.date_column)))
