import random
from collections import Counter, defaultdict

import numpy as np
from helpers import AWKWARD, SCHEMA, corpus, prose, table
from tokenizers import Tokenizer

from farescope.llm import packing


def test_least_slack_equals_trying_all():
    rng = random.Random(4)
    for _ in range(200):
        counts = Counter(rng.randint(1, 40) for _ in range(rng.randint(0, 9)))
        capacity = rng.randint(0, 90)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= capacity}
        chosen = packing.least_slack(dict(counts), capacity)
        assert all(chosen[n] <= counts[n] for n in chosen)
        assert sum(n * c for n, c in chosen.items()) == max(sums)


def test_plan_places_every_token_once():
    rng = random.Random(8)
    for _ in range(60):
        lengths = [rng.choice((1, 2, 7, 30, 63, 64, 65, 200)) for _ in range(rng.randint(0, 40))]
        held = defaultdict(list)
        for sequence in packing.plan(lengths, 64):
            total = sum(n for _, _, n in sequence)
            assert total == 64 or (total < 64 and total & (total - 1) == 0)
            for doc, start, n in sequence:
                held[doc] += range(start, start + n)
        assert {d: sorted(x) for d, x in held.items()} == {d: list(range(n)) for d, n in enumerate(lengths)}


def test_pieces_give_back_the_ids(spark):
    import random as r

    rows = corpus() + AWKWARD + [(2000, "don't STOP we'll see 3,4 #$% naïve ǅ ﬁ é x y " + prose(r.Random(1), 5000), None, None, 0)]
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in packing.pack(table(spark, rows), batch_tokens=3000).collect():
        docs[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    for doc, text, *_ in rows:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        pieces = sorted(docs[doc], key=lambda p: p["start"])
        assert np.concatenate([np.frombuffer(p["ids"], "<u4") for p in pieces]).tolist() == want
        assert [p["start"] for p in pieces] == np.cumsum([0] + [p["length"] for p in pieces])[:-1].tolist()
        assert {p["doc_tokens"] for p in pieces} == {len(want)}
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)


def test_seen_words_are_forgotten_when_full():
    encoder = packing.WordEncoder(packing.tokenizer_path(), cached=10)
    text = prose(random.Random(2), 300).encode()
    want = Tokenizer.from_file(packing.tokenizer_path()).encode(text.decode(), add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want and len(encoder) > 10


def test_words_are_encoded_as_in_their_text():
    texts = ["naïve Straße, ÉCOLE... d\u0065\u0301j\u00e0-vu i\u0307 İ ΣΊΣΥΦΟΣ ǅ ﬁ ½ don't we'll 'tis 42nd x<|y <|endoftext|>z",
             "a\u00a0b\u2028c \x85 d\x1ce “q”. a!?b.c ...! ñ! 日本語, 3.14 ٣ é́ ß SS \U0001d4b3 \u00ad ſ K", "<|ENDOFTEXT|> <|startoftext|>A"]
    encoder = packing.WordEncoder(packing.tokenizer_path())
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    for text in texts + [t for _, t, *_ in corpus()]:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == want, text


def test_missing_id_repeats_and_empty(spark):
    rows = [(None, "x y", None, None, 0), (1, "x y", None, None, 0), (1, "x y", None, None, 0)]
    assert len(packing.pack(table(spark, rows)).collect()) >= 3
    assert packing.pack(table(spark, [], SCHEMA)).collect() == []
