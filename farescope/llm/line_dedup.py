"""Drop lines that many documents share, keeping one document's.

Lines become two independent 64-bit hashes of their keys. The hashes are range-partitioned
by hash, document and position, sorted so inside each partition, so equal hashes stand
together, the largest document first, and a hash that fills more than a task is cut
over several. A streamed pass leaves the first occurrence of each hash in each
partition with its count of documents; these few rows per hash merge into the document that keeps it.
What comes back is no text but a bitmap per document, with one 64-bit word per 64
lines and only words that drop a line.

DataFrame functions only.

Defined cases: NULL or empty text is one empty line; a NULL id keeps all its lines and
counts as no document; rows that share an id are one document when documents are
counted; an empty table gives no bitmaps; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farescope.llm.common import SPACE_CHARS, files_for, saved

LEAST_CHARS = 20
LEAST_DOCS = 3
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(SPACE_CHARS)), UPPER, UPPER.lower())


def line_hashes(docs: DataFrame, doc_id: str, text: str, least_chars: int) -> DataFrame:
    """doc, row, place, h1, h2 of every line whose key is long enough.

    ``row`` is a hash of the text: it tells rows apart that share an id.
    """
    return (
        docs.where(F.col(doc_id).isNotNull())
        .select(
            F.col(doc_id).alias("doc"),
            F.xxhash64(F.col(text)).alias("row"),
            F.posexplode(lines_of(F.col(text))).alias("place", "line"),
        )
        .withColumn("key", line_key(F.col("line")))
        .where(F.length("key") >= least_chars)
        .select(
            "doc", "row", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("2"), "key").alias("h2")
        )
    )


def keep_bitmaps(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
) -> DataFrame:
    """doc, row, keep: for documents that lose lines, map of word number -> 64 keep bits; other words keep all."""
    hashes = saved(line_hashes(docs, doc_id, text, least_chars), "line-hashes")
    first = Window.partitionBy("h1", "h2", "doc").orderBy("row", "place")
    shared = saved(
        hashes.repartitionByRange("h1", "h2", "doc")
        .withColumn("nth", F.row_number().over(first))
        .where("nth = 1")
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("docs"), F.max("doc").alias("holder"))
        .where(F.col("docs") >= least_docs)
        .select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), "holder"),
        "shared-lines",
        files_for(docs),
    )
    # Read back, the shared lines are shuffled for the join as the hashes are, so a hot line can be split.
    bit = F.expr("shiftleft(1L, place % 64)")
    return (
        hashes.join(
            shared,
            (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")) & (F.col("doc") != F.col("holder")),
        )
        .groupBy("doc", "row", F.expr("place div 64").cast("int").alias("word"))
        .agg(F.bit_or(bit).alias("drop"))
        .groupBy("doc", "row")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("drop")))).alias("keep"))
    )


def kept(place: Column, keep: Column) -> Column:
    word = F.element_at(keep, F.floor(place / 64).cast("int"))
    return F.coalesce(F.getbit(word, place % 64) == 1, F.lit(True))


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """Every row of ``docs`` with its lines kept (``text``), n_lines and n_dropped.

    Columns of those two names that ``docs`` brings give way.
    """
    bitmaps = keep_bitmaps(docs, doc_id=doc_id, text=text, **limits)
    own = F.col("own")
    left = F.filter("lines", lambda line, i: kept(i, F.col("keep")))
    out = (
        docs.select(F.struct("*").alias("own"))
        .join(bitmaps, (own[doc_id] == F.col("doc")) & (F.xxhash64(own[text]) == F.col("row")), "left")
        .withColumn("lines", lines_of(own[text]))
        .withColumn("left", F.when(F.col("keep").isNull(), F.col("lines")).otherwise(left))
    )
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(
        *[F.array_join("left", "\n").alias(c) if c == text else own[c].alias(c) for c in columns],
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"),
    )
