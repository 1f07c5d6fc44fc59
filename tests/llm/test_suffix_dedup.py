import hashlib
import random

import brute
import numpy as np
import pytest
from helpers import AWKWARD, SCHEMA, corpus, table

from farescope.llm import suffix_dedup
from farescope.llm.suffix_array import suffix_array


@pytest.mark.parametrize("letters", [1, 2, 3, 9])
def test_suffix_array_matches_sorting(letters):
    rng = random.Random(letters)
    for _ in range(300):
        x = [rng.randint(0, letters) for _ in range(rng.randint(0, 40))]
        assert suffix_array(np.array(x, np.int64)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def result(df):
    out = {}
    for r in df.collect():
        removed = sum(s["end"] - s["start"] for s in r["spans"])
        value = (r["n_bytes"], removed, len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest())
        out.setdefault(r["doc_id"], []).append(value)
    return out


def test_equals_brute_force(spark):
    rows = corpus() + AWKWARD
    got = result(suffix_dedup.remove_repeats(table(spark)))
    want = brute.repeated_bytes([(r[0], r[1]) for r in rows])
    assert got == {k: [v] for k, v in want.items()}


def test_pieces_that_differ_are_sorted(spark, monkeypatch):
    """Arrays of a few words, so that groups are cut and arrays follow one another."""
    rng = random.Random(5)
    core = "".join(rng.choice("abcd ") for _ in range(260))
    rows = [
        (i, "".join(rng.choice("xy") for _ in range(40)) + core[rng.randint(0, 60) : 260 - rng.randint(0, 60)] + str(i), None, None, 0)
        for i in range(40)
    ]
    monkeypatch.setattr(suffix_dedup, "SORTED_WORDS", 64)
    rows += [(100 + i, t, *rest) for i, (_, t, *rest) in enumerate(rows[:7])]
    pieces = [(i, 0, len(t) - 99, 5, t.encode()) for i, t, *_ in rows]
    alone = {(d, s) for d, s in suffix_dedup.repeats(pieces, 100)}
    seen, want = set(), set()
    for i, t, *_ in rows:
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                want.add((i, s))
        seen |= {t[s : s + 100] for s in range(len(t) - 99)}
    assert {x for x in want} >= alone  # strings at other places of the anchor do not meet here
    got = result(suffix_dedup.remove_repeats(table(spark, rows)))
    assert got == {k: [v] for k, v in brute.repeated_bytes([r[:2] for r in rows]).items()}


def test_large_groups_are_not_gathered(spark, monkeypatch):
    """A passage that all documents hold, between texts of their own: no task lists the pieces of its edges."""
    monkeypatch.setattr(suffix_dedup, "GROUP_PIECES", 8, raising=False)
    monkeypatch.setattr(suffix_dedup, "HELD_STRINGS", 50, raising=False)
    sort = suffix_dedup._sorted

    def bounded(width):
        inner = sort(width)

        def run(batches):
            times = {}

            def counted():
                for batch in batches:
                    for key in batch.column("key").to_pylist():
                        times[key] = times.get(key, 0) + 1
                        assert times[key] <= 8, "a large group in one task"
                    yield batch

            yield from inner(counted())

        return run

    monkeypatch.setattr(suffix_dedup, "_sorted", bounded)
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(230))
    rows = [
        (i, f"{rng.randint(0, 10**9)}" + rng.choice(("", "and ", "so ")) + passage + rng.choice(("", " next", " page")) + f"{i:03}" * 9, None, None, 0)
        for i in range(90)
    ]
    rows += [(100 + i, t, *rest) for i, (_, t, *rest) in enumerate(rows[:7])]
    rows += [(500 + i, *r[1:]) for i, r in enumerate(corpus(9, 20))]
    got = result(suffix_dedup.remove_repeats(table(spark, rows)))
    assert got == {k: [v] for k, v in brute.repeated_bytes([r[:2] for r in rows]).items()}


def test_long_text_is_cut_into_units(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "UNIT", 1 << 9)
    rows = corpus(7, 30)
    got = result(suffix_dedup.remove_repeats(table(spark, rows)))
    assert got == {k: [v] for k, v in brute.repeated_bytes([r[:2] for r in rows]).items()}


def test_repeated_and_missing_ids(spark):
    rng = random.Random(11)
    text = "".join(rng.choice("abcdefgh") for _ in range(130)) + "end"
    other = text[:120] + "another end"
    rows = [(1, text, None, None, 0), (1, text, None, None, 0), (2, text, None, None, 0), (2, other, None, None, 0),
            (None, text, None, None, 0)]
    got = result(suffix_dedup.remove_repeats(table(spark, rows)))
    assert [v[1] for v in got[1]] == [0, 0]
    assert sorted(v[1] for v in got[2]) == [120, 133]
    assert [v[1] for v in got[None]] == [0]


def test_repeated_ids_near_the_ends_of_the_type(spark):
    """Numbers for repeated ids keep the ids' order and cannot overflow, however large the ids are."""
    rng = random.Random(12)
    text = "".join(rng.choice("abcdefgh") for _ in range(130))
    far = 2**63 - 1
    rows = [(5, "x", None, None, 0), (5, "y", None, None, 0), (far, text + "last", None, None, 0),
            (2**62 + 1, "mid" + text, None, None, 0), (-far, text + "first", None, None, 0)]
    got = result(suffix_dedup.remove_repeats(table(spark, rows)))
    assert [got[i][0][1] for i in (-far, 2**62 + 1, far)] == [0, 130, 130]
    assert [v[1] for v in got[5]] == [0, 0]


def test_empty(spark):
    assert suffix_dedup.remove_repeats(table(spark, [], SCHEMA)).collect() == []
