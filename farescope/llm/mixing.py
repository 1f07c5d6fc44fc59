"""Mix sources to target weights by Pareto order sampling.

Every source gets a word target. A source's documents are first taken whole as
many times as is certain; the rest of the target is a sample of fixed size in
words: documents are ranked by random odds divided by inclusion odds (Pareto
order sampling) and taken in that order until the target is filled. The document
at the edge is taken in part, so that the target is met to the word.

Hot sources: ranks are cut into ``RANK_BINS`` bins. Sums per (source, bin) find
the words before each bin, so only the rows of one bin are ever ordered together.

Defined cases: NULL or empty text has size 0 and is never taken; NULL source is a
source of its own, ordered last; equal rows are interchangeable, so ties between
them leave the rows of the result as they are; a NULL id is a value like any other;
an empty table gives an empty result. Other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farescope.llm.common import SPACE, saved, word_count, words

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-1"
RANK_BINS = 4096


def uniform(key: Column, seed: str) -> Column:
    """A number inside (0, 1) that depends on the key's text and the seed only."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + "|"), key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.0,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """source, source_size, target per source.

    ``sizes`` has one row per source. Weights repeat over the sources in order of
    code points, NULL last. A target above ``max_repeats`` times its source stops
    there, and the excess goes to the others by weight until none is above: in order
    of cap per weight, the capped sources come first.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"),
    )
    every = Window.partitionBy()
    tight = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    onward = tight.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = tight.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size").cast("double") * max_repeats)
        .withColumn("total", F.sum("source_size").over(every).cast("double") * share)
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("among", F.sum("weight").over(onward))
        .withColumn("capped", F.col("left") * F.col("weight") / F.col("among") >= F.col("cap"))
        .withColumn("left", F.first(F.when(~F.col("capped"), F.col("left")), True).over(whole))
        .withColumn("among", F.first(F.when(~F.col("capped"), F.col("among")), True).over(whole))
        .select(
            "source",
            "source_size",
            F.when(F.col("capped"), F.col("cap"))
            .otherwise(F.col("left") * F.col("weight") / F.col("among"))
            .alias("target"),
        )
    )


def mix(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.0,
    max_repeats: int = MAX_REPEATS,
    seed: str = SEED,
) -> DataFrame:
    """doc_id, source, size, source_size, target and taken: words taken of each row, repeats counted."""
    rows = saved(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
        ),
        "mix-sizes",
    )
    targets = source_targets(
        rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeats
    )
    # Names of sources are few next to documents; Spark broadcasts them only below its size limit.
    copies = F.col("target") / F.col("source_size")
    chance = F.col("copies") - F.col("certain")
    u = uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed)
    ranked = (
        rows.join(
            targets.withColumnRenamed("source", "of")
            .withColumn("copies", F.when(F.col("source_size") > 0, copies).otherwise(0.0))
            .withColumn("certain", F.floor("copies")),
            F.col("source").eqNullSafe(F.col("of")),
        )
        .drop("of")
        .withColumn(
            "need",
            F.floor(F.col("target") + 0.5).cast("long") - F.col("certain") * F.col("source_size"),
        )
        .withColumn("u", u)
        .withColumn(
            "rank",
            F.when(chance > 0, (F.col("u") / (1 - F.col("u"))) / (chance / (1 - chance))),
        )
        .withColumn("bin", F.floor(F.col("u") * RANK_BINS).cast("int"))
    )
    # Inclusion chances are equal inside a source, so the bins of u are in the order of the ranks.
    ahead = Window.partitionBy("b_source").orderBy("b_bin").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bins = (
        ranked.groupBy(F.col("source").alias("b_source"), F.col("bin").alias("b_bin"))
        .agg(F.sum("size").alias("words"))
        .withColumn("words_before", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    )
    inside = (
        Window.partitionBy("source", "bin")
        .orderBy("rank", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    room = F.col("need") - F.col("words_before") - F.col("inside_before")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), room))
    return (
        ranked.join(bins, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bin") == F.col("b_bin")))
        .withColumn("inside_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            (F.col("certain") * F.col("size") + extra).cast("long").alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``docs``: a document comes once per copy, the last one cut if taken in part.

    Rows that agree in id, source and size are paired with their parts by number.
    """
    alike = Window.partitionBy("m_id", "m_source", "m_size")
    taken = (
        mix(docs, **options)
        .select(
            F.col("doc_id").alias("m_id"),
            F.col("source").alias("m_source"),
            F.col("size").alias("m_size"),
            F.col("taken").alias("m_taken"),
        )
        .withColumn("m_number", F.row_number().over(alike.orderBy("m_taken")))
        .where("m_taken > 0")
    )
    own = F.col("own")
    numbered = docs.select(F.struct("*").alias("own")).withColumn("words", word_count(own["text"]))
    numbered = numbered.withColumn(
        "number",
        F.row_number().over(
            Window.partitionBy(own["doc_id"], own["source"], "words").orderBy(own["text"])
        ),
    )
    part = F.transform(
        F.sequence(F.lit(1), F.ceil(F.col("m_taken") / F.col("m_size")).cast("int")),
        lambda k: F.least(F.col("m_size"), F.col("m_taken") - (k - 1) * F.col("m_size")),
    )
    cut = F.array_join(F.slice(words(own["text"]), 1, F.col("part").cast("int")), " ")
    text = F.when(F.col("part") == F.col("m_size"), own["text"]).otherwise(cut)
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return (
        numbered.join(
            taken,
            own["doc_id"].eqNullSafe(F.col("m_id"))
            & own["source"].eqNullSafe(F.col("m_source"))
            & (F.col("words") == F.col("m_size"))
            & (F.col("number") == F.col("m_number")),
        )
        .withColumn("part", F.explode(part))
        .select(*[changed.get(c, own[c]).alias(c) for c in docs.columns])
    )
