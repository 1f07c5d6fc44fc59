"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use for columns of their own.
CLASHING = ("doc", "row", "h", "c", "key", "start", "n", "class", "comp", "blob", "spans", "size", "target", "u",
            "rank", "bin", "line", "place", "b_doc", "t", "tokens", "kept", "score", "toxic", "l_id", "m_id", "bucket")

VOCABULARY = "the of and in that it was on are this shore river mountain light stone paper window garden".split()


def prose(rng, n, extra=()):
    words = [rng.choice(VOCABULARY) + str(rng.randint(0, 60)) for _ in range(n)]
    for w in extra:
        words.insert(rng.randint(0, len(words)), w)
    return " ".join(words)


def corpus(seed=3, n=60):
    """(doc_id, text, lang, source, n_chars) with copies, near copies, shared lines and passages."""
    rng = random.Random(seed)
    passage = prose(rng, 40)
    line = "A line that many documents hold, such as a licence."
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 1 and texts:
            texts.append(rng.choice(texts))
        elif kind == 2 and texts:
            w = rng.choice(texts).split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        elif kind == 3:
            texts.append(prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 20))
        elif kind == 4:
            texts.append(line + "\n" + prose(rng, 50) + "\n  " + line.upper() + "\t\n")
        else:
            texts.append(prose(rng, rng.choice((3, 4, 5, 12, 80, 200))))
    return [(i, t, rng.choice(("en", "de", None)), rng.choice(("a", "b", None)), len(t)) for i, t in enumerate(texts)]


AWKWARD = [
    (1000, None, None, None, None),
    (1001, "", "en", "a", 0),
    (1002, " \t\n\x0b", "en", "a", 4),
    (1003, "one", None, "b", 3),
    (1004, "é" * 300 + "\n" + "𝒳 ñ " * 60, "de", "b", 0),
    (1005, "a" * 450, "en", None, 450),
    (1006, "ab " * 400, "en", "a", 0),
    (1007, "\n" * 5 + "same line of some length here\n" * 4, "en", "a", 0),
]


def table(spark, rows=None, schema=SCHEMA, extra=True, parts=3):
    df = spark.createDataFrame(corpus() + AWKWARD if rows is None else rows, schema)
    if extra:
        for name in CLASHING:
            if name not in df.columns:
                df = df.selectExpr("*", f"'x' AS `{name}`")
    return df.repartition(parts)


def by_id(df, *columns):
    out = {r["doc_id"]: tuple(r[c] for c in columns) for r in df.select("doc_id", *columns).collect()}
    return out


def many(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
