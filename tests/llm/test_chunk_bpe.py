import random
import tracemalloc

import pyarrow as pa
import pytest
from helpers import AWKWARD, corpus, many, prose, table
from tokenizers import Tokenizer
from zstandard import ZstdCompressor, ZstdDecompressor

from farescope.llm import chunk_bpe, packing

LIBRARY = Tokenizer.from_file(packing.tokenizer_path())


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def awkward_rows():
    """Shared passages at every offset, copies, odd characters, texts without white space."""
    rng = random.Random(11)
    passage = prose(rng, 900) + " ÀÉ naïve 𝒳   é ́x it's <|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b 12345 "
    solid = "".join(rng.choice("abcdé𝒳") for _ in range(9000))
    rows = []
    for i in range(24):
        rows.append((3000 + i, prose(rng, rng.randint(0, 30)) + rng.choice(("", " ", "\n", "x")) + passage, None, None, 0))
        rows.append((3100 + i, passage[rng.randint(0, 3000) :] + prose(rng, 5), None, None, 0))
        rows.append((3200 + i, "y" * i + solid + solid[:3000], None, None, 0))
    rows += [(3300, rows[0][1], None, None, 0)] * 5 + [(None, rows[0][1], None, None, 0), (None, passage, None, None, 0)]
    rows += [(3400, passage * 40, None, None, 0)]  # very long
    return corpus() + AWKWARD + rows


def test_equals_the_library(spark):
    rows = awkward_rows()
    got = chunk_bpe.encode(table(spark, rows))
    assert got.columns == ["doc_id", "ids"]
    assert many(got, "doc_id", "ids") == sorted(((r[0], ids_of(r[1])) for r in rows), key=repr)
    text = chunk_bpe.decode(got)
    want = sorted(((r[0], LIBRARY.decode(ids_of(r[1]), skip_special_tokens=False)) for r in rows), key=repr)
    assert many(text, "doc_id", "text") == want


def test_decoding_of_any_ids(spark):
    rng = random.Random(5)
    lists = [[rng.randrange(49408) for _ in range(rng.randint(0, 50))] for _ in range(600)]
    lists += [[], [49406, 49407], [5, 49408, 7], [-0, 60_000]]
    df = spark.createDataFrame(list(enumerate([*lists, None])), "doc_id long, ids array<int>")
    for skip in (False, True):
        got = {r.doc_id: r.text for r in chunk_bpe.decode(df, skip_special_tokens=skip).collect()}
        assert got == {i: LIBRARY.decode(v or [], skip_special_tokens=skip) for i, v in enumerate([*lists, None])}


def test_shared_chunks_are_encoded_once(spark):
    """Every chunk that two texts hold has one core, and texts take their shared ids from it."""
    rows = awkward_rows()
    docs = table(spark, rows).selectExpr("doc_id", "cast(text AS binary) AS text")
    held = {}
    for r in chunk_bpe.all_chunks(docs).collect():
        held.setdefault((r.h1, r.h2), set()).add((r.k1, r.k2))
    shared = [h for h, texts in held.items() if len(texts) > 1]
    assert len(shared) > 5
    plan = chunk_bpe.encode(table(spark, rows))
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("ReusedExchange") >= 2  # texts travel once, chunks are cut once


def test_cuts_depend_on_content_alone():
    rng = random.Random(2)
    passage = prose(rng, 3000).encode()
    for shift in (1, 33, 500):
        front = prose(rng, 200).encode()[:shift]

        def pieces(text):
            points = chunk_bpe.cut_points(chunk_bpe.np.frombuffer(text, "u1")).tolist()
            return {text[a:b] for a, b in chunk_bpe.chunks(points, 0, len(text))}

        one, two = pieces(passage), pieces(front + passage)
        assert len(one & two) >= len(one) - 2


def test_hashes_are_held_by_blocks(monkeypatch):
    """Blocks of any size cut alike, between characters, and a long text needs no arrays of its length."""
    rng = random.Random(4)
    text = "".join(rng.choice("abc dé𝒳") for _ in range(60_000)).encode()
    for data in (text, text[:33], text[:97], text + b"\x80" * 300):  # the last one is no UTF-8
        data, found = chunk_bpe.np.frombuffer(data, "u1"), []
        for size in (1, 64, 1000, 1 << 16, 1 << 30)[len(data) > 97 :]:
            monkeypatch.setattr(chunk_bpe, "HASHED_BYTES", size)
            found.append(chunk_bpe.cut_points(data).tolist())
        assert all(f == found[0] for f in found)
        assert all(p == len(data) or data[p] & 0xC0 != 0x80 for p in found[0])
    monkeypatch.undo()
    data = chunk_bpe.np.frombuffer(text * 40, "u1")
    tracemalloc.start()
    chunk_bpe.cut_points(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * len(data)


def test_a_batch_is_packed_in_parts():
    rng = random.Random(6)
    texts = [prose(rng, 9000).encode() for _ in range(40)] + [None, b"", b"x"]
    batch = pa.record_batch([pa.array(range(43), pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    empty = batch.slice(0, 0)
    parts = list(chunk_bpe._pack_texts(iter([empty, batch, empty, batch.slice(39)])))
    unpack = ZstdDecompressor().decompress
    plain = [[unpack(v) for v in p.column("packed").to_pylist()] for p in parts]
    assert len(parts) > 3 and max(sum(map(len, p)) for p in plain) <= chunk_bpe.SLICE_BYTES
    assert sum(plain, []) == [t or b"" for t in texts + texts[39:]]
    assert [i for p in parts for i in p.column("doc_id").to_pylist()] == [*range(43), *range(39, 43)]


def test_a_text_comes_once_with_all_its_chunks():
    text = prose(random.Random(7), 400).encode()
    chunks = [{"start": a, "size": 300, "h1": a, "h2": 7} for a in (0, 300, 900)]
    packed = ZstdCompressor().compress(text)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]))
    batch = pa.record_batch(
        [pa.array([1, 1], pa.int64()), pa.array([2, 2], pa.int64()), pa.array([packed] * 2), pa.array([chunks] * 2, kind)],
        names=["k1", "k2", "packed", "chunks"],
    )
    rows = [r for b in chunk_bpe._cores(None)(iter([batch])) for r in b.to_pylist()]
    assert [(r["h1"], r["h2"]) for r in rows] == [(0, 7), (300, 7), (900, 7)]  # the repeated row adds none
    for r in rows:
        got, want = chunk_bpe.Core(r["h1"], ZstdDecompressor().decompress(r["core"])), core(text, r["h1"], r["h1"] + 300)
        assert (got.start, got.end, got.ids, got.first, got.last) == (want.start, want.end, want.ids, want.first, want.last)


def test_long_results_leave_in_parts():
    text = (prose(random.Random(8), 30_000)).encode()
    kind = pa.list_(pa.struct([("start", pa.int32()), ("core", pa.binary())]))
    packed = ZstdCompressor().compress(text)
    batch = pa.record_batch(
        [pa.array([*range(9), None], pa.int64()), *[pa.array([3] * 10, pa.int64())] * 2, pa.array([packed] * 10), pa.nulls(10, kind)],
        names=["doc_id", "k1", "k2", "packed", "shared"],
    )
    parts = list(chunk_bpe._join_up(None)(iter([batch])))
    ids = ids_of(text.decode())
    assert len(parts) > 1 and all(4 * len(ids) * (p.num_rows - 1) < chunk_bpe.SLICE_BYTES for p in parts)
    assert [r for p in parts for r in p.to_pylist()] == [{"doc_id": i, "ids": ids} for i in [*range(9), None]]


def test_workers_give_memory_back_and_share_a_tokenizer(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(chunk_bpe, "releasing", lambda run: seen.append(run.__qualname__) or run)
    chunk_bpe.decode(chunk_bpe.encode(table(spark, [])))
    assert sorted(q.split(".")[0] for q in seen) == ["_cores", "_cut", "_join_up", "_pack_texts", "decode"]
    path = packing.tokenizer_path()
    assert chunk_bpe.word_encoder(path).tokenizer is packing.tokenizer_at(path) is packing.encoder_for(path).tokenizer


def encode(text):
    return chunk_bpe.word_encoder(packing.tokenizer_path()).encode(text)


def core(text, start, end):
    p, p2, q2, q = chunk_bpe.core_of(text[start:end])
    part = text[start:end]
    blobs = [encode(part[p:q]), encode(part[p:p2]), encode(part[q2:q])]
    head = chunk_bpe.np.array([p, p2, q2, q, *map(len, blobs)], "<i4").tobytes()
    return chunk_bpe.Core(start, head + b"".join(blobs))


def test_joins_that_disagree_are_widened():
    text = prose(random.Random(1), 400).encode()
    cores = [core(text, a, a + 300) for a in (0, 300, 700, 1000)]
    assert chunk_bpe.assemble(text, cores, encode) == encode(text)
    cores[1].first = b"\1\0\0\0"  # wrong ids at one edge: the chunks at that join are given up
    cores[1].ids = b"\1\0\0\0" + cores[1].ids
    assert chunk_bpe.assemble(text, cores, encode) == encode(text)
    assert chunk_bpe.assemble(b"", [], encode) == b""


def test_words_outlast_a_full_map():
    rng = random.Random(9)
    words = chunk_bpe.RecentWords(packing.tokenizer_path(), cached=40)
    for _ in range(300):
        text = " ".join(rng.choice(("the", "of", f"x{rng.randrange(500)}", f"{rng.choice('abc')}{rng.randrange(90)}!")) for _ in range(12))
        assert chunk_bpe.np.frombuffer(words.encode(text.encode()), "<u4").tolist() == ids_of(text)
    assert len(words) <= 40 + 24 and len(words.old) <= 40 + 24


def test_core_has_whole_words():
    assert chunk_bpe.core_of(b"ab cd ef gh") == (3, 5, 6, 8)
    assert chunk_bpe.core_of(b"ab cd ef") is None  # one whole word
    for none in (b"", b" ", b"abc", b"a  b", b"   "):
        assert chunk_bpe.core_of(none) is None


def test_empty_table_and_refused_tokenizer(spark):
    assert chunk_bpe.decode(chunk_bpe.encode(table(spark, []))).count() == 0
    with pytest.raises(ValueError):
        chunk_bpe.word_encoder(packing.tokenizer_path("byte_bpe_50k.json"))
