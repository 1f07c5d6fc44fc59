"""Language identification, words first, with backoff to shorter character n-grams.

Learning, from a bounded sample of rows with a language (``LEARN_ROWS``, chosen by a hash
of the id, with equal shares for the languages; one that has fewer rows gives all): counts of words and
of character n-grams of words, per language. The ``KNOWN_WORDS`` commonest words and ``KNOWN_GRAMS``
commonest n-grams of each language are kept, as logarithms of smoothed frequencies.

Scoring: a known word adds its log frequency in every language. An unseen word backs
off: the longest n-grams that are known score it, else shorter ones, down to single
characters. The language with the largest sum wins; the score is its share after a softmax
of the sums per square root of words. Only text is read when a text is scored.

Words are runs of Unicode letters (category L) with the marks that follow them, lower-cased; numbers such as "½", "²", "①"
and "Ⅷ" are no letters.

Defined cases: a text that is NULL or has no letter gets ``und`` and score 0; so does every
text when no row teaches; NULL languages teach nothing; NULL ids teach, as they are in no
fold; repeated rows are scored each; a very long text is scored whole; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farescope.llm.common import holds_out, saved

FOLDS, HELD_OUT = 4, 2
LEARN_ROWS = 20_000
KNOWN_WORDS = 50_000
KNOWN_GRAMS = 50_000
LONGEST = 5
REMEMBERED = 200_000
SMOOTHING = 0.5
UNKNOWN = "und"

# A word: letters, and the marks that follow them (vowel signs, accents written apart).
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
# The same words of texts below U+0250, which hold no marks.
BEYOND_LATIN = re.compile("[^\x00-\u024f]")
LATIN_LETTERS = re.compile("[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")


def found_words(text: str) -> list[str]:
    """The words of a text in lower case: runs of Unicode letters with their marks."""
    text = text.lower()
    return (LETTERS if BEYOND_LATIN.search(text) else LATIN_LETTERS).findall(text)


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its ends marked; single characters have no marks."""
    marked = word if n == 1 else f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, n (0 for words, else the n-gram's length), unit, times."""
    for batch in batches:
        words: dict[str, Counter] = defaultdict(Counter)
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            words[lang].update(found_words(text))
        rows = []
        for lang, counted in words.items():
            pieces: Counter = Counter()
            for word, times in counted.items():
                rows.append((lang, 0, word, times))
                for n in range(1, LONGEST + 1):
                    for g in grams(word, n):
                        pieces[n, g] += times
            rows += [(lang, n, g, times) for (n, g), times in pieces.items()]
        if rows:
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["lang", "n", "unit", "times"]
            )


class Model:
    """Log frequencies of words and n-grams; one row of a matrix per unit, one column per language."""

    def __init__(self, langs: list[str], rows: list[tuple[str, int, str, int]]):
        self.langs = langs
        column = {x: i for i, x in enumerate(langs)}
        self.units: dict[tuple[int, str], int] = {}
        for _, n, unit, _ in rows:
            self.units.setdefault((n, unit), len(self.units))
        counts = np.zeros((len(self.units), len(langs)))
        for lang, n, unit, times in rows:
            counts[self.units[n, unit], column[lang]] = times
        self.logs = np.zeros_like(counts, dtype=np.float32)
        lengths = np.array([n for n, _ in self.units])
        for n in range(LONGEST + 1):
            of = np.flatnonzero(lengths == n)
            c = counts[of] + SMOOTHING
            self.logs[of] = np.log(c / c.sum(0))
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.matrix = np.zeros((1024, len(self.langs)), np.float32)

    def row(self, word: str) -> np.ndarray:
        known = self.units.get((0, word))
        if known is not None:
            return self.logs[known]
        for n in range(LONGEST, 0, -1):
            found = [u for g in grams(word, n) if (u := self.units.get((n, g))) is not None]
            if found:
                return self.logs[found].mean(0)
        return np.zeros(len(self.langs), np.float32)

    def place(self, word: str) -> int:
        at = self.rows[word] = len(self.rows)
        if at == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[at] = self.row(word)
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        counted = Counter(found_words(text)) if text else None
        if not counted:
            return UNKNOWN, 0.0
        if len(self.rows) > REMEMBERED:
            self.forget()
        get, place = self.rows.get, self.place
        at = [i if (i := get(w)) is not None else place(w) for w in counted]
        times = np.fromiter(counted.values(), np.float32, len(counted))
        sums = times @ self.matrix[at]
        z = (sums - sums.max()) / np.sqrt(times.sum())
        shares = np.exp(z)
        best = int(shares.argmax())
        return self.langs[best], float(shares[best] / shares.sum())


def shares(counts: dict[str, int], rows: int) -> dict[str, float]:
    """The part of each language's rows to take for about ``rows`` in all: equal numbers, or all a language has."""
    out, left = {}, rows
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: x[1])):
        take = min(n, max(1, left // (len(counts) - k)))
        out[lang], left = take / n, left - take
    return out


def learn(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    rows: int = LEARN_ROWS,
    folds: int = FOLDS,
    held_out: int = HELD_OUT,
) -> Model | None:
    """The model of rows outside the held-out fold; None if there are none."""
    fit = docs.where(
        F.col(lang).isNotNull() & F.col(text).isNotNull() & ~holds_out(F.col(doc_id), folds, held_out)
    ).select(F.col(doc_id).cast("string").alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = {r["lang"]: r["n"] for r in fit.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    # A place in hash order decides which rows are in the sample.
    place = F.pmod(F.xxhash64("key", F.lit("language")), F.lit(1 << 30))
    limits = [(k, int(v * (1 << 30))) for k, v in shares(counts, rows).items()]
    limit = saved(docs.sparkSession.createDataFrame(limits, "l_lang string, l_limit long"), "language-shares")
    sample = fit.join(limit, F.col("lang") == F.col("l_lang")).where(place < F.col("l_limit"))
    counted = saved(
        sample.select("text", "lang")
        .mapInArrow(_counts, "lang string, n int, unit string, times long")
        .groupBy("lang", "n", "unit")
        .agg(F.sum("times").alias("times")),
        "language-counts",
    )
    kind = F.col("n") > 0
    nth = F.row_number().over(Window.partitionBy("lang", kind).orderBy(F.col("times").desc(), "n", "unit"))
    most = F.when(kind, F.lit(KNOWN_GRAMS)).otherwise(F.lit(KNOWN_WORDS))
    kept = counted.withColumn("nth", nth).where(F.col("nth") <= F.lit(max(KNOWN_WORDS, KNOWN_GRAMS)))
    kept = kept.where(F.col("nth") <= most).select("n", "unit").distinct()
    found = counted.join(kept, ["n", "unit"])
    # As Arrow columns: a list of Row objects would be several times as large.
    columns = found.select("lang", "n", "unit", "times").orderBy("n", "unit", "lang").toArrow()
    rows_ = list(zip(*(c.to_pylist() for c in columns.columns)))
    return Model(sorted({r[0] for r in rows_}), rows_) if rows_ else None


def identify(docs: DataFrame, model: Model | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    kind = docs.schema[doc_id].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the kept words and n-grams of each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = sent.value
        for batch in batches:
            found = [
                judge.predict(t.as_py()) if judge is not None else (UNKNOWN, 0.0)
                for t in batch.column("text")
            ]
            yield pa.record_batch(
                [
                    batch.column("key"),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                names=["key", "lang_pred", "score"],
            )

    return (
        docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text"))
        .mapInArrow(run, f"key {kind}, lang_pred string, score double")
        .select(
            F.col("key").alias("doc_id"),
            holds_out(F.col("key"), FOLDS, HELD_OUT).alias("held_out"),
            "lang_pred",
            "score",
        )
    )
