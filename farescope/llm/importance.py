"""Target-distribution importance resampling over hashed word features.

Texts are lower-cased (A-Z only) and split by the tokenizers library's pre-tokeniser, an untrained
``Split`` on a pattern, which gives words with their offsets. Every window of one to ``longest``
consecutive words is a feature; its CRC32 gives its bucket, carried on from the window one word
shorter. The buckets' counts over the source texts and over the target texts give each bucket a gain,
the logarithm of a ratio of smoothed shares, and a document weighs the mean gain of its features. Gumbel noise from
a hash of the id is added and the highest scores are drawn, which samples without replacement in
proportion to the weights.

Texts are split once: the buckets of each document's features are written, two bytes a feature, and both the counts
and the weights read that table. Counts are added up per task before they are shuffled. What the driver
sees and sends is one gain per bucket. Places come from a range sort, so no task orders all documents.

Defined cases: NULL or empty text has no features, weight 0 and too few words to be drawn; a row
without an id has no noise, so its score is NULL, and it is neither counted nor drawn; repeated rows are drawn each
on their own, with equal scores, and ties go to the smaller id; very long texts are split in
slices that end between words; an empty table gives no rows, and an empty target gives gains from the
smoothing alone; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farescope.llm.common import saved
from farescope.operators.latest import number_in_order

BUCKETS = 10_000
LONGEST = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
# Words are runs of ASCII letters and digits and of anything beyond ASCII; A-Z are lower-cased before.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLICE_CHARS = 1 << 13
_GAP = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")

FEATURES = "doc_id long, n_words long, n_features long, buckets binary"


def splitter():
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters that begin and end between words."""
    start = 0
    while len(text) - start > size:
        gap = _GAP.search(text, start + size)
        if gap is None:
            break
        yield text[start : gap.start()]
        start = gap.start()
    yield text[start:]


def lowered(text: bytes) -> str:
    return text.lower().decode("utf-8", "replace")  # bytes have no case beyond A-Z


def word_bytes(text: bytes, split) -> list[bytes]:
    """The words of a text, each taken from the text by its offsets."""
    out = []
    for part in slices(lowered(text)):
        out += [part[start:end].encode() for _, (start, end) in split(part)]
    return out


def feature_crcs(words: list[bytes], longest: int) -> list[int]:
    """CRC32 of every window of 1 to ``longest`` words, joined by one space."""
    ends = list(map(crc32, words))
    crcs = ends.copy()
    for k in range(1, longest):
        # A window goes on from the one that lacks its last word.
        ends = [crc32(b" " + word, crc) for word, crc in zip(words[k:], ends)]
        crcs += ends
    return crcs


def bucket_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def features(texts: DataFrame, doc_id: Column, text: str, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, buckets (of every feature, little-endian, two or four bytes each)."""
    kind = bucket_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter().pre_tokenize_str
        for batch in batches:
            words_of, counts, blobs = [], [], []
            for value in batch.column(1):
                words = word_bytes(value.as_py() or b"", split)
                crcs = np.array(feature_crcs(words, longest), np.uint32) % np.uint32(buckets)
                words_of.append(len(words))
                counts.append(len(crcs))
                blobs.append(crcs.astype(kind).tobytes())
            yield pa.record_batch(
                [batch.column(0), pa.array(words_of, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())],
                names=["doc_id", "n_words", "n_features", "buckets"],
            )

    return texts.select(doc_id.cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(
        run, FEATURES
    )


def histogram(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket has over all ``rows`` of ``features``."""
    kind = bucket_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += np.bincount(np.frombuffer(blob.as_py(), kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counts = rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():  # at most one row a bucket
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of each bucket's share of the target over that of the source, floored."""
    n, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((float(t) + 1) * (all_s + n) / ((float(s) + 1) * (all_t + n))))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        np.int64,
    )


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain of a document's features."""
    kind = bucket_type(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gain[np.frombuffer(blob.as_py(), kind)].sum()) for blob in batch.column("buckets")]
            weights = [s // n if n else 0 for s, n in zip(sums, batch.column("n_features").to_pylist())]
            yield pa.record_batch(
                [*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(weights, pa.int64())],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel number from the hash of the id, floored; NULL without an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: every document, with its place if it is drawn.

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred are drawn.
    """
    rows = saved(features(docs, F.col(doc_id), text, buckets, longest), "importance-features")
    wanted = features(target, F.lit(None), target_text, buckets, longest)
    gain = gains(histogram(rows, buckets), histogram(wanted, buckets))
    scored = saved(
        weighted(rows, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)),
        "importance-scores",
    )
    fit = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    open_ = scored.where(fit)
    drawn = percent * open_.count() // 100
    # The rest of the columns last, so that rows of one id are numbered alike in every run.
    order = [F.col("score").desc(), *map(F.col, ("doc_id", "weight", "n_features", "n_words"))]
    placed = number_in_order(open_, [], order, "place")
    rank = F.when(F.col("place") <= drawn, F.col("place")).alias("rank")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    return placed.select(*columns, rank).unionByName(
        scored.where(~F.coalesce(fit, F.lit(False))).select(*columns, F.lit(None).cast("long").alias("rank"))
    )


def drawn_documents(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is drawn; of repeated ids, all rows if one of them is drawn."""
    ranks = resample(docs, target, doc_id=doc_id, **options).where("rank IS NOT NULL")
    taken = ranks.select(F.col("doc_id").alias("taken")).distinct()
    own = F.col("own")
    return (
        docs.select(F.struct("*").alias("own"))
        .join(taken, own[doc_id] == F.col("taken"), "left_semi")
        .select(*[own[c].alias(c) for c in docs.columns])
    )
