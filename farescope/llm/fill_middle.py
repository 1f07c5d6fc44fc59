"""Fill-in-the-middle: cut a text at two token borders and move its middle to the end.

Every character has a class: not a letter, first letter of a word, later letter of a word. A token
begins at each character of the first two classes, so the tokens before a position are the
sum of two ranks in a wavelet matrix over the classes, and a cut after some number of
tokens is found by bisection on that sum. One matrix serves the texts of a slice, all cuts at once.

Both cuts, the form and its order follow from a hash of the id, so a task that runs again gives
the same rows. Work is map-only.

Defined cases: NULL text is empty, and empty text is plain; a row without an id draws
nothing and is plain; a text that holds a mark is plain, so that the marks of an output are its own;
equal rows give equal rows, each its own; very long texts are a slice of their own; an empty table
gives no rows; other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farescope.llm.wavelet import WaveletMatrix

SEED = 1
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
KEPT_PERCENT = 10  # texts that stay plain
SPM_PERCENT = 20  # of the others: the suffix comes first
SLICE_BYTES = 1 << 21

OTHER, FIRST, LATER = 0, 1, 2
CUTS = "doc_id long, text string, n long, prefix_chars long, middle_chars long"


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2**32 from the hash of the id; NULL without an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def classes(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The class of every code point; ``begins`` are the positions of the texts' first ones."""
    low = codes | np.uint32(32)
    letter = (low >= 97) & (low <= 122) & (codes < 128)
    later = np.zeros(len(codes), bool)
    later[1:] = letter[1:] & letter[:-1]
    later[begins[begins < len(codes)]] = False
    return np.where(later, LATER, letter).astype(np.uint8)


class Borders:
    """Token borders of a run of texts."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray):
        self.ends = ends
        self.begins = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
        self.matrix = WaveletMatrix(classes(codes, self.begins), 2)
        self.first = self.before(self.begins)

    def before(self, at: np.ndarray) -> np.ndarray:
        """Tokens that begin before each position."""
        return self.matrix.rank(OTHER, at) + self.matrix.rank(FIRST, at)

    def counts(self) -> np.ndarray:
        return self.before(self.ends) - self.first

    def cut(self, tokens: np.ndarray) -> np.ndarray:
        """Characters that the first ``tokens`` tokens of each text have.

        The largest position with no more tokens before it: where the next one begins, or the end.
        """
        wanted = self.first + tokens
        low, high = self.begins.copy(), self.ends.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            fits = self.before(middle) <= wanted
            low = np.where(open_ & fits, middle, low)
            high = np.where(open_ & ~fits, middle - 1, high)
        return low - self.begins


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + 4 * len(text) > SLICE_BYTES:
            yield first, i
            first, size = i, 0
        size += 4 * len(text)
    if texts:
        yield first, len(texts)


def _find_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in _slices(texts):
            part = batch.slice(a, b - a)
            ends = np.cumsum([len(t) for t in texts[a:b]], dtype=np.int64)
            codes = np.frombuffer("".join(texts[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32)
            borders = Borders(codes, ends)
            n = borders.counts()
            h1, h2 = (part.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
            one, two = h1 % (n + 1), h2 % (n + 1)
            prefix, both = borders.cut(np.minimum(one, two)), borders.cut(np.maximum(one, two))
            yield pa.record_batch(
                [part.column("doc_id"), part.column("text"), *map(pa.array, (n, prefix, both - prefix))],
                names=["doc_id", "text", "n", "prefix_chars", "middle_chars"],
            )


def transform(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    kept_percent: int = KEPT_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (NULL if plain), output."""
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    cuts = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .select("doc_id", "text", h1.alias("h1"), h2.alias("h2"))
        .mapInArrow(_find_cuts, CUTS)
    )
    t = F.col("text")
    marked = F.contains(t, F.lit(PREFIX)) | F.contains(t, F.lit(SUFFIX)) | F.contains(t, F.lit(MIDDLE))
    plain = (t == "") | marked | F.col("doc_id").isNull() | (h3 % 100 >= 100 - kept_percent)
    form = F.when(plain, F.lit("plain")).when(h4 % 100 < spm_percent, F.lit("spm")).otherwise(F.lit("psm"))
    p, m = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, middle = F.substring(t, F.lit(1), p), F.substring(t, p + 1, m)
    suffix = F.substring(t, p + m + 1, F.length(t))
    output = (
        F.when(F.col("form") == "plain", t)
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    chars = [F.when(F.col("form") != "plain", F.col(c)).alias(c) for c in ("prefix_chars", "middle_chars")]
    return cuts.withColumn("form", form).select("doc_id", "n", "form", *chars, output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from: the parts between its marks, in their first order."""
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    at = F.instr(output, second)
    end = F.instr(output, F.lit(MIDDLE))
    one = F.substring(output, F.lit(4), at - 4)
    two = F.substring(output, at + 3, end - at - 3)
    middle = F.substring(output, end + 3, F.length(output))
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(one, middle, two))
        .otherwise(F.concat(two, middle, one))
    )
