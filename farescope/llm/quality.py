"""Quality rules whose cutoffs adapt to each language and source.

Measures of every text are taken once. Per (language, source) a mergeable quantile sketch of each
measure, over all rows of the group, gives its median and an upper and a lower quantile (``TAIL``). The
fences lie ``REACH`` times the distance from the median beyond them and replace fixed cutoffs: where seven
in eight texts have no symbols, the fence is zero. A rate counts events, and ``CHANCE`` of them may
come by chance where none are expected, so a text fails a fence only if it does so without them.
The fences are joined back to the measures. Sketches merge across tasks, so a hot source costs one sketch
per task. A small group needs no rule of its own: its quantiles are its own rows, and a row alone is inside.

DataFrame functions only. The measures are written to the shared folder between the
two passes; the text is read once.

Defined cases: NULL or empty text has no words and fails the base rules; NULL language
or source is a group of its own; every row is judged on its own, so repeated rows get
equal verdicts; a very long text is measured whole, in one row's arrays; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farescope.llm.common import SPACE_CHARS, saved, words

SYMBOLS = "#*$%&|<>"
RUN = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20
TAIL = 0.125
REACH = 3.0
CHANCE = 3
ACCURACY = 2000

# Measure: what it counts, of how many, and the size of one event. A mean has no events.
MEASURES = {
    "word_length": ("word_chars", "n_words", 0),
    "symbol_rate": ("n_symbols", "n_words", 1),
    "line_repeat_rate": ("n_dup_lines", "n_lines", 1),
    "word_repeat_rate": ("n_repeat_words", "n_words", RUN),
}


def measured(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """doc_id, lang, source and the measures of each text.

    Runs of ``RUN`` words are hashed. Where a text has equal hashes, they are sorted
    with their places; each place of a repeated run covers up to the next such place,
    or ``RUN`` words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    run = F.transform(
        F.slice("tokens", 1, F.greatest(F.col("n_words") - (RUN - 1), F.lit(0)).cast("int")),
        lambda w, i: F.xxhash64(*[F.get("tokens", i + k) for k in range(RUN)]),
    )
    by_place = F.array_sort(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = F.filter(
        "placed",
        lambda x, i: (x["h"] == F.get("placed", i - 1)["h"]) | (x["h"] == F.get("placed", i + 1)["h"]),
    )
    covered = F.aggregate(
        F.transform(
            "starts",
            lambda s, i: F.least(F.lit(RUN), F.coalesce(F.get("starts", i + 1) - s, F.lit(RUN))),
        ),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    lines = F.filter(F.split(F.col("t"), "\n"), lambda line: F.translate(line, SPACE_CHARS, "") != "")
    repeats = F.size(F.array_distinct("runs")) < F.size("runs")
    nothing = F.expr("array()").cast("array<struct<h:bigint,i:int>>")
    return (
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(lang).alias("lang"),
            F.col(source).alias("source"),
            t.alias("t"),
        )
        .withColumn("tokens", words(F.col("t")))
        .withColumn("lines", lines)
        .withColumn("n_words", F.size("tokens").cast("long"))
        .withColumn("runs", run)
        .withColumn("placed", F.when(repeats, by_place).otherwise(nothing))
        .withColumn("starts", F.array_sort(F.transform(again, lambda x: x["i"])))
        .select(
            "doc_id",
            "lang",
            "source",
            "n_words",
            F.length(F.translate("t", SPACE_CHARS, "")).cast("long").alias("word_chars"),
            (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            covered.alias("n_repeat_words"),
        )
    )


def rates(measures: DataFrame) -> DataFrame:
    """Each measure, and as ``may_`` what chance may add to it; 0 where there is nothing to count in."""
    out = {}
    for m, (count, of, event) in MEASURES.items():
        many = F.when(F.col(of) > 0, F.col(of))
        out[m] = F.coalesce(F.col(count) / many, F.lit(0.0))
        out[f"may_{m}"] = F.coalesce(F.lit(CHANCE * event) / many, F.lit(0.0))
    return measures.withColumns(out)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    )


def fences(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: low_ and high_ of every measure, from sketches of all its rows."""
    sketches = [F.percentile_approx(m, [TAIL, 0.5, 1 - TAIL], ACCURACY).alias(f"q_{m}") for m in MEASURES]
    out = {}
    for m in MEASURES:
        low, middle, high = (F.get(f"q_{m}", F.lit(i)) for i in range(3))
        out |= {f"low_{m}": low - (middle - low) * REACH, f"high_{m}": high + (high - middle) * REACH}
    return rows.groupBy(*keys).agg(*sketches).withColumns(out).drop(*[f"q_{m}" for m in MEASURES])


def judge(docs: DataFrame, **columns) -> DataFrame:
    """doc_id, the measures, base_failed and kept."""
    rows = rates(saved(measured(docs, **columns), "quality-measures"))
    own = fences(rows, ["lang", "source"]).withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    inside = F.lit(True)
    for m in MEASURES:
        inside &= F.col(m) + F.col(f"may_{m}") >= F.col(f"low_{m}")
        inside &= F.col(m) - F.col(f"may_{m}") <= F.col(f"high_{m}")
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    return rows.join(own, same).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & inside).alias("kept"),
    )
