"""Find secrets through an incremental ledger of scanned blobs.

A text is a blob named by its SHA-256, so every version of a document that has ever
been seen is one content address, wherever it lies. The ledger lists for every blob
the rules, with their versions, that have been run over it, and what they found. A run
scans each distinct blob once, with only those rules that the ledger lacks for it,
appends one ledger row per blob, and joins all findings back to every path that
holds the blob. Findings and the note that a rule is done are one row, so a run that dies
leaves either both or neither.

DataFrame functions only. Places are counted from the lengths of the texts between
matches, so they are code points.

Defined cases: NULL text is the empty blob; NULL and repeated ids are paths like any
other; a very long text is one blob, scanned whole; an empty table gives no paths; other columns are
not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farescope.llm.common import saved
from farescope.plans.session import working_folder


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# Kinds and patterns, in the listed order. A run of the characters of
# "access" or "hex" is matched whole, so its least length stands in the pattern; for
# "assign" a match that is too short still uses up its text, so the length is checked after.
RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)

SPANS = "array<struct<start:bigint,nth:int,end:bigint,rule:string>>"
LEDGER = f"blob binary, rules array<string>, spans {SPANS}"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def new_ledger(spark) -> str:
    """The path of an empty ledger in the shared folder."""
    path = working_folder(spark, "secret-ledger")
    spark.createDataFrame([], LEDGER).write.parquet(path)
    return path


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of ``blobs`` (blob, text, todo: names of the rules to run)."""
    hits, parts = {}, {}
    for k, r in enumerate(rules):
        found = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))
        hits[f"hits_{k}"] = F.when(F.array_contains("todo", r.name), found)
        some = F.size(f"hits_{k}") > 0
        between = F.transform(F.split("text", r.pattern, -1), lambda x: F.length(x))
        values = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))
        parts[f"gaps_{k}"] = F.when(some, between)
        parts[f"values_{k}"] = F.when(some, values)
    def pieces(k: int, r: Rule) -> Column:
        return F.transform(
            f"hits_{k}",
            lambda hit, i: F.struct(
                F.lit(k).alias("nth"),
                i.alias("i"),
                F.get(f"gaps_{k}", i).alias("gap"),
                F.length(hit).alias("length"),
                (F.length(F.get(f"values_{k}", i)) >= r.least).alias("holds"),
            ),
        )

    none = F.expr("array()").cast("array<struct<nth:int,i:int,gap:int,length:int,holds:boolean>>")
    upto = Window.partitionBy("blob", "nth").orderBy("i")
    names = F.array(*[F.lit(r.name) for r in rules])
    span = F.struct(
        (F.col("end") - F.col("length")).alias("start"),
        F.col("nth"),
        F.col("end"),
        F.get(names, F.col("nth")).alias("rule"),
    )
    return (
        blobs.withColumns(hits)
        .withColumns(parts)
        .select("blob", "todo", F.concat(*[F.coalesce(pieces(k, r), none) for k, r in enumerate(rules)]).alias("pieces"))
        .select("blob", "todo", F.explode_outer("pieces").alias("m"))
        .select("blob", "todo", "m.*")
        .withColumn("end", F.sum(F.col("gap").cast("long") + F.col("length")).over(upto))
        .groupBy("blob")
        .agg(
            F.first("todo").alias("rules"),
            F.array_sort(F.collect_list(F.when(F.col("holds"), span))).cast(SPANS).alias("spans"),
        )
    )


def find_secrets(
    docs: DataFrame,
    ledger: str | None = None,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """doc_id, blob and spans (by start, then rule) of every row; the ledger at ``ledger`` grows.

    Without a path a new ledger is begun in the shared folder.
    """
    spark = docs.sparkSession
    ledger = ledger or new_ledger(spark)
    seen = spark.read.schema(LEDGER).parquet(ledger)
    names = F.array(*[F.lit(r.name) for r in rules])
    known = seen.groupBy(F.col("blob").alias("k_blob")).agg(
        F.array_distinct(F.flatten(F.collect_list("rules"))).alias("k_rules")
    )
    blobs = (
        docs.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .dropDuplicates(["blob"])
        .join(known, F.col("blob") == F.col("k_blob"), "left")
        .withColumn("todo", F.array_except(names, F.coalesce("k_rules", F.expr("array()").cast("array<string>"))))
        .where(F.size("todo") > 0)
        .select("blob", "text", "todo")
    )
    scan(blobs, rules).write.mode("append").parquet(ledger)
    wanted = F.filter(
        F.array_distinct(F.flatten(F.collect_list("spans"))), lambda x: F.array_contains(names, x["rule"])
    )
    found = saved(
        spark.read.schema(LEDGER)
        .parquet(ledger)
        .groupBy(F.col("blob").alias("f_blob"))
        .agg(F.array_sort(wanted).alias("spans")),
        "secret-findings",
    )
    # Read back, the findings are shuffled for the join as the paths are, so a hot blob can be split.
    paths = docs.select(F.col(doc_id).alias("doc_id"), blob_of(F.col(text)).alias("blob"))
    return paths.join(found, F.col("blob") == F.col("f_blob"), "left").select("doc_id", "blob", "spans")


def listed(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    one = F.transform(
        spans,
        lambda s: F.concat_ws(
            ":", F.substring_index(s["rule"], "@", 1), s["start"].cast("string"), s["end"].cast("string")
        ),
    )
    return F.array_join(one, ",")
