import brute
from helpers import AWKWARD, SCHEMA, by_id, corpus, many, table
from pyspark.sql import functions as F

from farescope.llm import line_dedup, quality


def test_lines_equal_brute_force(spark):
    rows = corpus() + AWKWARD
    rows += [(3000 + i, "\n".join(f"shared line number {k}, long enough" for k in range(150)), None, None, 0) for i in range(3)]
    got = by_id(
        line_dedup.dedup_lines(table(spark, rows)).withColumn("sha", F.sha2("text", 256)), "n_lines", "n_dropped", "sha"
    )
    assert got == brute.lines([r[:2] for r in rows])
    bitmaps = {r["doc"]: r["keep"] for r in line_dedup.keep_bitmaps(table(spark, rows)).collect()}
    assert sorted(bitmaps[3000]) == [0, 1, 2] and 3002 not in bitmaps


def test_lines_of_repeated_and_missing_ids(spark):
    line = "a line of twenty or more characters"
    rows = [(1, line, None, None, 0), (1, line, None, None, 0), (1, "first\n" + line, None, None, 0), (2, line, None, None, 0),
            (None, line, None, None, 0)]
    kept = many(line_dedup.dedup_lines(table(spark, rows)), "doc_id", "n_dropped")
    assert {n for _, n in kept} == {0}  # two documents hold it
    rows.append((3, line, None, None, 0))
    kept = many(line_dedup.dedup_lines(table(spark, rows)), "doc_id", "text", "n_dropped")
    assert kept == sorted(
        [(1, "", 1), (1, "", 1), (1, "first", 1), (2, "", 1), (3, line, 0), (None, line, 0)], key=repr
    )


def test_lines_empty(spark):
    assert line_dedup.dedup_lines(table(spark, [], SCHEMA)).collect() == []


def test_measures_equal_brute_force(spark):
    rows = corpus() + AWKWARD + [(4000, "x y z a b " * 3 + "x y z a b c", "en", "a", 0), (4001, "w " * 9, "en", "a", 0)]
    got = by_id(quality.judge(table(spark, rows)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {r[0]: brute.measures(r[1]) for r in rows}


def test_fences_follow_the_group(spark):
    """The same symbol rate is common in one source and odd in another."""
    import random

    from helpers import prose

    rng = random.Random(6)
    rows = [(i, prose(rng, 60), "en", "plain", 0) for i in range(80)]
    rows += [(100 + i, prose(rng, 60, ["#"] * (20 + i % 20)), "en", "code", 0) for i in range(80)]
    rows += [(300, prose(rng, 60, ["#"] * 30), "en", "plain", 0), (301, prose(rng, 60, ["#"] * 30), "en", "code", 0)]
    kept = by_id(quality.judge(table(spark, rows)), "kept")
    assert kept[300] == (False,) and kept[301] == (True,)
    assert all(kept[i] == (True,) for i in range(80))


def unlike(rng, n):
    """n words whose runs do not come again."""
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n)]


def test_each_measure_alone_rejects(spark):
    """Texts that pass the base rules and are odd in one measure only (lines: see the next test)."""
    import random

    rng = random.Random(8)
    rows = [(i, "\n".join(" ".join(unlike(rng, 10)) for _ in range(20)), "en", "a", 0) for i in range(60)]
    phrase = " ".join(unlike(rng, 18))
    odd = {
        "word_length": " ".join(w * 8 for w in unlike(rng, 200)),
        "symbol_rate": " ".join(unlike(rng, 200)) + "#" * 18,
        "word_repeat_rate": " ".join([*unlike(rng, 100), phrase, *unlike(rng, 100), phrase, *unlike(rng, 5)]),
    }
    rows += [(100 + i, t, "en", "a", 0) for i, t in enumerate(odd.values())]
    few = " ".join(unlike(rng, 200))
    rows += [(200, few + "###", "en", "a", 0), (201, few + "\n" + "\n".join(["same"] * 4), "en", "a", 0)]
    got = by_id(quality.judge(table(spark, rows)), "base_failed", "kept")
    assert {got[i] for i in range(60)} == {(False, True)}
    assert got[100] == got[101] == got[102] == (False, False)
    assert got[200] == got[201] == (False, True)  # three events may come by chance


def test_lines_alone_reject(spark):
    import random

    rng = random.Random(9)
    rows = [(i, "\n".join(" ".join(unlike(rng, 10)) for _ in range(20)), "en", "a", 0) for i in range(60)]
    text = "\n".join(x for _ in range(30) for x in (" ".join(unlike(rng, 10)), "menu"))
    rows.append((100, text, "en", "a", 0))
    got = {r["doc_id"]: r for r in quality.judge(table(spark, rows)).collect()}
    assert (got[100]["n_repeat_words"], got[100]["n_dup_lines"]) == (0, 29)
    assert got[100]["kept"] is False and all(got[i]["kept"] for i in range(60))


def test_verdicts_equal_plain_fences(spark):
    rows = corpus(21, 150) + AWKWARD
    rows = [(i, None if t is None else t + (" " + "$" * 60) * (i % 30 == 3), *rest) for i, t, *rest in rows]
    sized = {r[0]: (r[2:4], brute.measures(r[1]), brute.n_lines(r[1])) for r in rows}

    def rated(m, n_lines):
        n, chars, symbols, dups, repeats, _ = m
        return [(c / of if of else 0.0, 3 * e / of if of else 0.0)
                for c, of, e in ((chars, n, 0), (symbols, n, 1), (dups, n_lines, 1), (repeats, n, 5))]

    groups = {}
    for group, m, lines in sized.values():
        groups.setdefault(group, []).append(rated(m, lines))
    want = {}
    for i, (group, m, lines) in sized.items():
        kept = not m[5]
        for k, (rate, chance) in enumerate(rated(m, lines)):
            ordered = sorted(r[k][0] for r in groups[group])
            low, mid, high = (ordered[max(0, -(-len(ordered) * q // 8) - 1)] for q in (1, 4, 7))
            kept &= low - 3 * (mid - low) <= rate + chance and rate - chance <= high + 3 * (high - mid)
        want[i] = (kept,)
    assert by_id(quality.judge(table(spark, rows)), "kept") == want
    assert {False, True} == {k for (k,), (_, m, _) in zip(want.values(), sized.values()) if not m[5]}


def test_small_groups_and_long_texts(spark):
    long = "word " * 5 + " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long, "en", "a", 0), (2, "$ " * 40 + "a b c d e f g h i j k l m n o p q r s t u v w", None, None, 0)]
    assert by_id(quality.judge(table(spark, rows)), "n_words", "kept")[1] == (60_005, True)


def test_quality_repeats_missing_and_empty(spark):
    rows = corpus()[:5] * 2 + [(None, None, None, None, None)]
    got = many(quality.judge(table(spark, rows)), "doc_id", "n_words", "kept")
    assert len(got) == 11 and (None, 0, False) in got
    assert quality.judge(table(spark, [], SCHEMA)).collect() == []
