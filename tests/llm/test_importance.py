import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from helpers import AWKWARD, corpus, many, prose, table

from farescope.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def buckets(text, n):
    w = words(text)
    runs = w + [" ".join(p) for p in zip(w, w[1:])]
    return [zlib.crc32(r.encode()) % n for r in runs]


def plain_version(docs, target, n=10_000, least=20, percent=25):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text, n))
    for text in target:
        t.update(buckets(text, n))
    total_s, total_t = sum(s.values()), sum(t.values())
    out = []
    for doc, text in docs:
        bs = buckets(text, n)
        gain = sum(
            math.floor(1000 * math.log((t[b] + 1) * (total_s + n) / ((s[b] + 1) * (total_t + n)))) for b in bs
        )
        weight = gain // len(bs) if bs else 0
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"7:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(words(text)), len(bs), weight, score, None])
    fit = sorted((r for r in out if r[1] >= least and r[4] is not None), key=lambda r: (-r[4], *r[:1], r[3], r[2]))
    for place, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[5] = place
    return sorted(map(tuple, out), key=repr)


COLUMNS = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


def target(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "item_id string, text string").repartition(2)


def test_equals_plain_version(spark):
    import random

    rng = random.Random(3)
    rows = corpus() + AWKWARD + [(None, prose(rng, 30), None, None, 0), (None, None, None, None, 0)]
    rows += [(5, prose(rng, 25), None, None, 0)] * 3  # repeated rows, of an id that has another text too
    rows += [(5000, "Straße ÀB x_y \x85z " * 4000, None, None, 0), (5001, "a" * 300_000, None, None, 0)]
    texts = [prose(rng, 60), None, "", "Shore RIVER mountain"]
    got = importance.resample(table(spark, rows), target(spark, texts))
    assert got.columns == COLUMNS
    assert many(got, *COLUMNS) == plain_version([r[:2] for r in rows], texts)


def test_other_parameters(spark):
    rows = corpus(n=30)
    got = importance.resample(table(spark, rows), target(spark, [rows[0][1]]), buckets=70_000, least_words=3, percent=50)
    assert many(got, *COLUMNS) == plain_version([r[:2] for r in rows], [rows[0][1]], 70_000, 3, 50)


def test_empty_tables(spark):
    assert importance.resample(table(spark, []), target(spark, ["x"])).count() == 0
    got = importance.resample(table(spark, corpus(n=8)), target(spark, []))
    assert many(got, *COLUMNS) == plain_version([r[:2] for r in corpus(n=8)], [])


def test_windows_of_words():
    w = [b"a", b"bc", b"a"]
    want = [zlib.crc32(x) for x in (b"a", b"bc", b"a", b"a bc", b"bc a", b"a bc a")]
    assert importance.feature_crcs(w, 3) == want
    assert importance.feature_crcs([], 2) == []


def test_slices_change_nothing():
    text = "".join("wörd%d-x " % i for i in range(9000))
    split = importance.splitter().pre_tokenize_str
    assert [w.decode() for w in importance.word_bytes(text.encode(), split)] == words(text)
    assert "".join(importance.slices("ab cd" * 10, 4)) == "ab cd" * 10


def test_target_like_documents_are_drawn(spark):
    """Documents that speak like the target come first by far."""
    like = [(i, " ".join(f"river{(i * 7 + k) % 40}" for k in range(60)), "en", "a", 0) for i in range(100)]
    other = [(1000 + i, " ".join(f"stone{(i * 5 + k) % 40}" for k in range(60)), "en", "a", 0) for i in range(300)]
    texts = [" ".join(f"river{k % 40}" for k in range(20_000))]  # outweighs the smoothing
    docs = table(spark, like + other)
    drawn = importance.drawn_documents(docs, target(spark, texts))
    assert drawn.columns == docs.columns
    ids = [r.doc_id for r in drawn.collect()]
    assert len(ids) == 100 and np.mean([i < 1000 for i in ids]) > 0.9
