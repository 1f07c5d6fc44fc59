"""Toxicity and language: what is learned, and held-out accuracy on small made texts."""

import random

import brute
import pytest
from helpers import AWKWARD, SCHEMA, many, prose, table
from pyspark.sql import functions as F

from farescope.llm import language, toxicity
from farescope.llm.toxicity import Lexicon

BAD = ["worthless", "scoundrel", "rotter"]


def labelled(n=300, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        extra = [rng.choice(BAD) for _ in range(rng.randint(1, 3))] if toxic else []
        if i % 11 == 0 and not toxic:
            extra = [f'"{rng.choice(BAD)}"']
        if toxic and i % 3 == 0:
            extra = [rng.choice(("foulmo", "foulwe")) + rng.choice(("ab", "cde", "fg")) for _ in range(2)]
        text = prose(rng, 40, extra)
        rows.append((i, text, None, None, 0))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def learned(spark):
    rows, labels = labelled()
    return toxicity.learn(table(spark, rows), spark.createDataFrame([*labels, (None, 1), (7777, 1), (5, None)], "doc_id long, toxic int"))


def test_lexicon_holds_words_and_stems(learned):
    terms, stems, _, _ = learned
    assert set(BAD) <= set(terms)
    assert any("foul".startswith(s[:4]) for s in stems)
    assert len(terms) + len(stems) <= 8


def test_held_out_rows_are_judged_right(spark, learned):
    rows, labels = labelled()
    got = {r["doc_id"]: r for r in toxicity.score(table(spark, rows + AWKWARD), learned).collect()}
    assert len(got) == len(rows) + len(AWKWARD)
    for i, toxic in labels:
        assert got[i]["held_out"] == brute.held_out(i, 5, 0)
        assert got[i]["predicted"] == toxic == int(got[i]["score"] >= 0.5)
    assert all(got[r[0]]["predicted"] == 0 and 0 <= got[r[0]]["score"] <= 1 for r in AWKWARD)


def test_misspelled_and_quoted(spark, learned):
    rows = [(1, "you are wortless and a scoundrell all day long", None, None, 0),
            (2, 'he was called a "scoundrel" by the paper and it printed that', None, None, 0),
            (3, "a scoundrel, that is what you are", None, None, 0)]
    features = Lexicon(*learned[:2])
    assert features.features(rows[0][1])[1] > 0 and features.features(rows[1][1])[2] > 0
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(table(spark, rows), learned).collect()}
    assert got[2] == 0 and got[3] == 1


def test_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(1)
    terms = ["abcab", "abcabcabc", "bbbacc", "cab", "aaaaabbbbb"]
    lexicon = Lexicon(terms, [])
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        if rng.random() < 0.6:
            w = list(rng.choice(terms))
            for _ in range(rng.randint(0, 3)):
                w.insert(rng.randint(0, len(w)), rng.choice("abc")) if rng.random() < 0.5 else w and w.pop(rng.randrange(len(w)))
            word = "".join(w)
        fits = [d for t in terms if (d := distance(word, t)) <= toxicity.budget(t)]
        assert lexicon.edits(word) == min(fits, default=None), word


def test_without_labels_nothing_is_toxic(spark):
    rows, _ = labelled(20)
    docs = table(spark, rows)
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model is None
    assert {r["predicted"] for r in toxicity.score(docs, model).collect()} == {0}
    assert toxicity.clean_documents(docs, model).count() == 20


def test_rejected_rows_go_and_others_stay_whole(spark, learned):
    rows, labels = labelled(40)
    docs = table(spark, rows + AWKWARD + [(None, "scoundrel worthless rotter", None, None, 0)])
    kept = toxicity.clean_documents(docs, learned)
    assert kept.columns == docs.columns
    want = {i for i, toxic in labels if not toxic} | {r[0] for r in AWKWARD}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_toxicity_of_empty_table(spark, learned):
    assert toxicity.score(table(spark, [], SCHEMA), learned).collect() == []


TONGUES = {"xx": "the tha tho thin then thorn wither", "yy": "le la lu luire louer valeur elle", "zz": "ko ka kiko okako kokia akik"}


def tongues(n=240, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(TONGUES))
        syllables = TONGUES[lang].split()
        words = [rng.choice(syllables) + rng.choice(syllables + [""] * 6) for _ in range(rng.randint(4, 40))]
        rows.append((i, " ".join(words), lang, None, 0))
    return rows


def test_language_of_held_out_rows(spark):
    rows = tongues()
    docs = table(spark, rows + [(9000, "1 2 3 !", "xx", None, 0), (9001, None, None, None, None), (9002, "", "xx", None, 0)])
    got = {r["doc_id"]: r for r in language.identify(docs, language.learn(docs)).collect()}
    for i, _, lang, *_ in rows:
        assert got[i]["held_out"] == brute.held_out(i, 4, 2)
        assert 0 <= got[i]["score"] <= 1
    right = [got[i]["lang_pred"] == lang for i, _, lang, *_ in rows if got[i]["held_out"]]
    assert sum(right) >= 0.97 * len(right) > 30
    assert {(got[i]["lang_pred"], got[i]["score"]) for i in (9000, 9001, 9002)} == {("und", 0.0)}


def test_unseen_words_back_off(spark):
    model = language.learn(table(spark, tongues()))
    assert ("thenthin" * 3, 0) not in model.units
    assert model.predict("thorthorwithen thinthenthor")[0] == "xx"
    assert model.predict("kikokikoka okiakko")[0] == "zz"


def test_rare_language_keeps_its_words(spark, monkeypatch):
    """A language with nearly all rows and many words takes neither the sample nor the limits from a rare one."""
    monkeypatch.setattr(language, "KNOWN_WORDS", 40)
    monkeypatch.setattr(language, "KNOWN_GRAMS", 60)
    rng = random.Random(12)
    hot = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80)]
    rare = ["qoro", "quri", "quqo", "rorqu"]
    rows = [(i, " ".join(rng.choices(hot, k=60)), "hot", None, 0) for i in range(1500)]
    rows += [(5000 + i, " ".join(rng.choices(rare, k=8)), "rare", None, 0) for i in range(8)]
    model = language.learn(table(spark, rows), rows=100)
    assert model.langs == ["hot", "rare"]
    assert {(0, w) for w in rare} <= set(model.units)
    assert model.predict("qoro quri rorqu")[0] == "rare" and model.predict(" ".join(hot[:9]))[0] == "hot"


def test_shares_are_equal_or_all():
    got = language.shares({"a": 10, "b": 1_000_000, "c": 400}, 1000)
    assert got["a"] == 1 and got["c"] == 1 and round(got["b"] * 1_000_000) == 590
    assert language.shares({"a": 3}, 1000) == {"a": 1}


def test_words_are_letters_with_their_marks(spark):
    assert language.found_words("हिन्दी भाषा") == ["हिन्दी", "भाषा"]
    assert language.found_words("½ ² ① Ⅷ 12 _ ٣") == []
    assert language.found_words("L'Été_à №7 µm") == ["l", "été", "à", "µm"]
    assert language.found_words("e\u0301te\u0301 \u0301x") == ["e\u0301te\u0301", "x"]
    every = " ".join(map(chr, range(0x250))) + "".join(map(chr, range(0x250)))
    for text in (every, "Straße und naïve ªº"):
        assert language.LATIN_LETTERS.findall(text) == language.LETTERS.findall(text)
    model = language.learn(table(spark, tongues()))
    assert model.predict("½ ² ①") == ("und", 0.0)


def test_language_of_a_very_long_text(spark):
    """Whole texts count: the end of a long one decides."""
    model = language.learn(table(spark, tongues()))
    docs = table(spark, [(1, "the " * 9 + "kiko okokia " * 200_000, None, None, 0)] * 2)
    assert many(language.identify(docs, model), "doc_id", "lang_pred") == [(1, "zz")] * 2


def test_language_without_teachers(spark):
    docs = table(spark, [(1, "some text", None, None, 0), (1, "some text", None, None, 0)])
    assert language.learn(docs) is None
    assert many(language.identify(docs, None), "lang_pred", "score") == [("und", 0.0)] * 2
    assert language.identify(table(spark, [], SCHEMA), None).collect() == []
