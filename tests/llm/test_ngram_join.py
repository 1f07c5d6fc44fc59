import random

import brute
import numpy as np
import pytest
from helpers import AWKWARD, SCHEMA, by_id, corpus, many, prose, table

from farescope.llm import ngram_join
from farescope.llm.signature_tree import join


def test_tree_connects_what_similarity_connects():
    rng = random.Random(2)
    for _ in range(60):
        base = [rng.getrandbits(60) for _ in range(200)]
        sets = []
        for _ in range(rng.randint(2, 60)):
            keep = rng.choice((20, 80, 150, 160, 180))
            start = rng.randint(0, 200 - keep)
            sets.append(np.unique(np.array(base[start : start + keep] + [rng.getrandbits(60) for _ in range(rng.choice((0, 5, 40)))], np.uint64)))
        root = list(range(len(sets)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        got = list(range(len(sets)))

        def found(x, got=got):
            while got[x] != x:
                x = got[x]
            return x

        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    root[max(find(a), find(b))] = min(find(a), find(b))
        for a, b in join(sets, list(range(len(sets)))):
            got[max(found(a), found(b))] = min(found(a), found(b))
        assert [find(x) for x in range(len(sets))] == [found(x) for x in range(len(sets))]


def test_members_without_a_partner_are_left_out():
    rng = random.Random(5)
    for _ in range(300):
        rows = sorted((rng.randint(0, 3), n := rng.randint(1, 60), n - rng.randint(0, n // 4)) for _ in range(rng.randint(1, 30)))
        k, n, rest = (np.array(x, np.int64) for x in zip(*rows))
        want = [
            any(i != j and k[i] == k[j] and 175 * min(rest[i], rest[j]) >= 75 * (n[i] + n[j]) for j in range(len(k)))
            for i in range(len(k))
        ]
        assert ngram_join.satisfiable(k, n, rest, 75).tolist() == want


def test_equals_brute_force(spark):
    rows = corpus() + AWKWARD
    got = by_id(ngram_join.link_components(table(spark)), "n_shingles", "component_id")
    assert got == brute.linked_components([r[:2] for r in rows])


@pytest.mark.parametrize("block, local", [(3, 0), (4096, 1 << 20)])
def test_chain_and_large_group(spark, monkeypatch, block, local):
    """Near copies of one text, a chain of ever further texts, and blocks of a few."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LOCAL_LINKS", local)
    rng = random.Random(9)
    base = prose(rng, 120).split(" ")
    rows = []
    for i in range(25):
        w = list(base)
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w), None, None, 0))
    chain = prose(rng, 60).split(" ")
    for i in range(25, 40):
        chain = chain[4:] + prose(rng, 4).split(" ")
        rows.append((i, " ".join(chain), None, None, 0))
    got = by_id(ngram_join.link_components(table(spark, rows)), "n_shingles", "component_id")
    assert got == brute.linked_components([r[:2] for r in rows])


@pytest.mark.parametrize("block", [3, 4096])
def test_every_link_is_found(spark, monkeypatch, block):
    """Near copies that are one component after a few links: their other links are found and counted, too."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(10)
    base = prose(rng, 120).split(" ")
    rows = corpus() + AWKWARD + [(None, " ".join(base), None, None, 0)]
    for i in range(2000, 2018):
        w = list(base)
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w), None, None, 0))
    rows += [(3000 + i, rows[-1][1], None, None, 0) for i in range(3)] + [(3000, rows[-1][1], None, None, 0)]
    rows.append((3001, rows[-8][1], None, None, 0))  # an id with two texts
    known = sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=repr)
    sets = [(d, brute.shingles(t)) for d, t in known]

    def similar(x, y):
        return bool(x) and 100 * len(x & y) >= 75 * len(x | y)

    reps = {}
    for d, x in sets:
        reps[x] = min(d, reps.get(x, d))
    pairs = sorted(
        tuple(sorted((reps[x], reps[y]))) for x in reps for y in reps if repr(sorted(x)) < repr(sorted(y)) and similar(x, y)
    )
    found = ngram_join.similar_pairs(table(spark, rows)).collect()
    assert sorted((r["a_id"], r["b_id"]) for r in found) == pairs
    assert len(pairs) > 100
    counts = many(ngram_join.count_links(table(spark, rows)), "doc_id", "n_shingles", "n_links")
    want = [
        (r[0], len(x := brute.shingles(r[1])), 0 if r[0] is None else max(0, sum(similar(x, y) for _, y in sets) - 1))
        for r in rows
    ]
    assert counts == sorted(want, key=repr)


def test_rows_of_one_id_are_one_document(spark):
    """Id 5 holds the text of id 3 and another one, which ids 8 and 9 hold or resemble."""
    rng = random.Random(13)
    one, other = prose(rng, 60), prose(rng, 60).split(" ")
    near = [*other[:-1], "changed"]
    rows = [(3, one, None, None, 0), (5, one, None, None, 0), (5, " ".join(other), None, None, 0),
            (8, " ".join(other), None, None, 0), (9, " ".join(near), None, None, 0), (10, prose(rng, 60), None, None, 0)]
    got = many(ngram_join.link_components(table(spark, rows)), "doc_id", "component_id")
    assert got == sorted([(3, 3), (5, 3), (5, 3), (8, 3), (9, 3), (10, 10)], key=repr)


def test_one_of_each_keeps_all_columns(spark):
    rows = corpus() + AWKWARD + [(None, "no id at all", None, None, 0)]
    docs = table(spark, rows)
    kept = ngram_join.one_of_each(docs)
    want = {d for d, (_, c) in brute.linked_components([r[:2] for r in rows if r[0] is not None]).items() if d == c}
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == want | {None}


def test_empty(spark):
    assert ngram_join.link_components(table(spark, [], SCHEMA)).collect() == []


def test_no_links_of_nothing(spark):
    assert ngram_join.similar_pairs(table(spark, [], SCHEMA)).collect() == []
    assert ngram_join.count_links(table(spark, [], SCHEMA)).collect() == []
