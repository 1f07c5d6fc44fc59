from collections import Counter

import brute
import pytest
from helpers import AWKWARD, SCHEMA, by_id, corpus, many, prose, table

from farescope.llm import mixing


def test_sizes_targets_and_taken(spark):
    rows = corpus() + AWKWARD
    got = mixing.mix(table(spark)).collect()
    sizes = {r[0]: len(brute.words(r[1])) for r in rows}
    source = {r[0]: r[3] for r in rows}
    total = Counter()
    for d, n in sizes.items():
        total[source[d]] += n
    targets = brute.targets(total)
    taken = Counter()
    for r in got:
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == total[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(targets[source[r["doc_id"]]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 0.5 + 1e-6


def test_excess_is_reshared(spark):
    """A small source with a large weight stops at three times its size."""
    import random

    rng = random.Random(1)
    rows = [(i, prose(rng, 20), None, "a" if i < 2 else "b" if i < 20 else None, 0) for i in range(60)]
    got = by_id(mixing.mix(table(spark, rows)), "target", "taken", "size")
    assert got[0][0] == 3 * 40 and got[0][1] == 3 * got[0][2]
    assert got[5][0] + got[30][0] + got[0][0] == pytest.approx(60 * 20)


def test_reruns_agree_and_rows_repeat(spark):
    rows = corpus() + corpus()[:20]
    a = many(mixing.mix(table(spark, rows, parts=2)), "doc_id", "source", "size", "taken")
    assert a == many(mixing.mix(table(spark, rows, parts=5)), "doc_id", "source", "size", "taken")


def test_documents_of_the_mix_hold_the_words_taken(spark):
    rows = corpus() + corpus()[:10] + AWKWARD
    docs = table(spark, rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += len(brute.words(r["text"]))
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r["source"]] += r["taken"]
    assert +words == +taken


def test_no_words_and_empty(spark):
    got = by_id(mixing.mix(table(spark, AWKWARD[:3])), "target", "taken")
    assert set(got.values()) == {(0.0, 0)}
    assert mixing.mix(table(spark, [], SCHEMA)).collect() == []
    assert mixing.mixed_documents(table(spark, [], SCHEMA)).collect() == []
