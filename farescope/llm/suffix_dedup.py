"""Remove repeated stretches of bytes, found in suffix arrays.

A byte goes if a string of ``WIDTH`` bytes that covers it also starts earlier: in a document of a
smaller id, or earlier in the same one.

1. Every string of ``WIDTH`` bytes holds ``WIDTH - SEED + 1`` seeds of ``SEED`` bytes; the one with
   the smallest hash is its anchor. Equal strings have equal anchors at equal places, so
   neighbouring strings with one anchor travel as one stretch, and stretches meet at the
   hash of their anchor. An anchor that occurs once needs no more work.
2. Equal stretches collapse to the earliest, first in a batch of documents, then over all; the
   others lose all their strings. So a passage that a third of all documents hold sends one
   stretch per batch.
3. The stretches that are left at an anchor differ, mostly at the ends of a shared passage. They
   are cut into pieces of ``PIECE`` neighbouring strings, and pieces meet again by what all strings
   of a piece share, which also splits the stretches of a hot anchor. Pieces that meet are
   written one after another as 64-bit words, aligned to their anchors, and sorted as one suffix
   array (``suffix_array``). Suffixes that agree for long enough hold the same string; the earliest
   stays and the others go.
4. Where more than ``GROUP_PIECES`` pieces would meet (a passage that many documents hold, followed by
   text of their own), their strings are grouped by Spark instead: the earliest of equal strings is found
   with map-side combining, and a join that can be split finds the others.

Hashes are 64 bits wide, and what goes in step 2 relies on them; steps 3 and 4 compare bytes.

Defined cases: NULL text is empty; texts under ``WIDTH`` bytes lose nothing; a NULL id is taken as
no document: it loses nothing and repeats nothing; rows with one id and one text are the
same document and share its result; rows with one id and other texts are judged at their
own places; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farescope.llm.common import input_tasks, saved
from farescope.llm.hashing import mix, raw, running
from farescope.llm.suffix_array import suffix_array
from farescope.operators.latest import number_in_order

WIDTH = 100
SEED = 32
PIECE = 16
UNIT = 1 << 18
BUCKETS_PER_TASK = 4
SORTED_WORDS = 1 << 20
GROUP_PIECES = 1 << 13
HELD_STRINGS = 1 << 16

DEALT = "bucket int, doc long, h binary, c binary, docs binary, starts binary, n binary, off binary"
MET = "doc long, start long, n long, off int, h long, ask boolean"
CUT = "key long, doc long, start long, n long, lead int, piece binary"
STRINGS = "string binary, doc long, start long"
GONE = "doc long, start long, n long"
REMOVED = "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"


def stretches(data: np.ndarray, offsets: np.ndarray, width: int, seed: int):
    """(value, start, strings, anchor offset, anchor hash, stretch hash) of all values, as arrays.

    Values are taken together up to ``UNIT`` bytes; a longer one is taken in parts that overlap.
    """
    parts = []
    first, n = 0, len(offsets) - 1
    while first < n:
        size = offsets[first + 1] - offsets[first]
        if size > UNIT:
            for at in range(0, int(size) - width + 1, UNIT):
                stop = min(int(size), at + UNIT + width - 1)
                a = int(offsets[first]) + at
                got = _unit(data[a : a + stop - at], np.array([0, stop - at]), width, seed)
                parts.append((got[0] + first, got[1] + at, *got[2:]))
            first += 1
            continue
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + UNIT, "right")) - 1)
        a, b = int(offsets[first]), int(offsets[last])
        got = _unit(data[a:b], offsets[first : last + 1] - a, width, seed)
        parts.append((got[0] + first, *got[1:]))
        first = last
    if not parts:
        parts = [_unit(data[:0], np.zeros(1, np.int64), width, seed)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _unit(data: np.ndarray, offsets: np.ndarray, width: int, seed: int):
    total = len(data)
    strings = total - width + 1
    if strings <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums, down = running(data)
    seeds = mix((sums[seed:] - sums[:-seed]) * down[: total - seed + 1])
    place = np.uint64((1 << (2 * UNIT).bit_length()) - 1)
    low = (seeds & ~place) | np.arange(len(seeds), dtype=np.uint64)
    span, reach = width - seed + 1, 1
    while 2 * reach <= span:  # smallest of ``reach`` seeds from each place
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[: reach - span], low[span - reach :])
    anchor = (low & place).astype(np.int64)[:strings]
    inside = np.ones(strings + 1, bool)
    inside[-1] = False
    for k in range(1, width):  # strings that run over the end of a value
        over = offsets[1:-1] - k
        inside[over[(over >= 0) & (over < strings)]] = False
    moved = np.ones(strings + 1, bool)
    moved[1:-1] = anchor[1:] != anchor[:-1]
    s = np.flatnonzero(inside[:-1] & (moved[:-1] | ~np.concatenate(([False], inside[:-2]))))
    e = np.flatnonzero(inside[:-1] & (moved[1:] | ~inside[1:]))
    n, a = e - s + 1, anchor[s]
    h = seeds[a]
    c = mix((sums[e + width] - sums[s]) * down[s])
    c = mix(c ^ mix(h) ^ ((n << 32) | (a - s)).astype(np.uint64))
    of = np.searchsorted(offsets, s, "right") - 1
    return of, s - offsets[of], n, a - s, h, c


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of stretches, as sorted ones that do not touch."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    heads = np.flatnonzero(new)
    return s[heads], np.append(e[heads[1:] - 1], e[-1:]) if len(s) else e


def earliest(h, c, docs, starts):
    """Order by (h, c, document, start), and whether each is the first of its (h, c)."""
    order = np.lexsort((starts, docs, c, h))
    new = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    new[1:] = (h[a] != h[b]) | (c[a] != c[b])
    tie = ~new
    # The same place again is no earlier place.
    last = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    first = order[last]
    tie &= (docs[order] == docs[first]) & (starts[order] == starts[first])
    return order, new, tie


def _deal(width: int, seed: int, buckets: int):
    """Per batch: the earliest stretches per bucket, and per document what goes already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            of, s, n, off, h, c = stretches(*raw(batch.column(1)), width, seed)
            docs = ids[of]
            order, first, tie = earliest(h, c, docs, s)
            out = {k: [] for k in ("bucket", "doc", "h", "c", "docs", "starts", "n", "off")}
            gone = order[~first & ~tie]
            gone = gone[np.lexsort((s[gone], of[gone]))]
            edges = np.flatnonzero(np.diff(of[gone], prepend=-1, append=-1))
            for a, b in zip(edges, edges[1:]):
                at, end = merged(s[gone[a:b]], s[gone[a:b]] + n[gone[a:b]])
                doc = int(docs[gone[a]])
                out["bucket"].append(doc % buckets)
                out["doc"].append(doc)
                out["starts"].append(at.astype("<i8").tobytes())
                out["n"].append((end - at).astype("<i8").tobytes())
                for k in ("h", "c", "docs", "off"):
                    out[k].append(None)
            keep = order[first | tie]
            bucket = (mix(h[keep]) % np.uint64(buckets)).astype(np.int64)
            by_bucket = np.argsort(bucket, kind="stable")
            keep, bucket = keep[by_bucket], bucket[by_bucket]
            packed = {
                "h": (h[keep] >> np.uint64(32)).astype("<u4"),
                "c": c[keep],
                "docs": narrow(docs[keep]),
                "starts": narrow(s[keep]),
                "n": n[keep].astype(np.uint8),
                "off": off[keep].astype(np.uint8),
            }
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            for a, b in zip(edges, edges[1:]):
                out["bucket"].append(int(bucket[a]))
                out["doc"].append(None)
                for k, v in packed.items():
                    out[k].append(v[a:b].tobytes())
            kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 6
            yield pa.record_batch([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    return run


def narrow(values: np.ndarray) -> np.ndarray:
    """Little-endian unsigned numbers of the least width that holds all, signed 64-bit if some are negative."""
    most = values.max(initial=0)
    if values.min(initial=0) < 0 or most >= 1 << 32:
        return values.astype("<i8")
    return values.astype("<u2" if most < 1 << 16 else "<u4")


def widened(blob: bytes, count: int) -> np.ndarray:
    kind = {2: "<u2", 4: "<u4", 8: "<i8"}[len(blob) // count]
    return np.frombuffer(blob, kind).astype(np.int64)


def batches_of(names: list[str], columns: list[np.ndarray], size: int = 200_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), size):
        yield pa.record_batch([pa.array(c[i : i + size]) for c in columns], names=names)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What goes for certain, and the earliest stretches of anchors where others differ from them."""
    h, c, docs, starts, n, off = ([] for _ in range(6))
    names = ["doc", "start", "n", "off", "h", "ask"]
    for batch in batches:
        local: list[list[np.ndarray]] = [[], [], []]
        for row in batch.to_pylist():
            if row["doc"] is not None:
                at = np.frombuffer(row["starts"], "<i8")
                local[0].append(np.full(len(at), row["doc"]))
                local[1].append(at)
                local[2].append(np.frombuffer(row["n"], "<i8"))
                continue
            count = len(row["n"])
            h.append(np.frombuffer(row["h"], "<u4").astype(np.int64) | (row["bucket"] << 32))
            c.append(np.frombuffer(row["c"], "<u8"))
            docs.append(widened(row["docs"], count))
            starts.append(widened(row["starts"], count))
            n.append(np.frombuffer(row["n"], np.uint8))
            off.append(np.frombuffer(row["off"], np.uint8))
        if local[0]:
            d, s, k = map(np.concatenate, local)
            zero = np.zeros(len(d), np.int64)
            yield from batches_of(names, [d, s, k, zero.astype(np.int32), zero, zero.astype(bool)])
    if not h:
        return
    h, c, docs, starts, n, off = map(np.concatenate, (h, c, docs, starts, n, off))
    order, first, tie = earliest(h, c, docs, starts)
    head = h[order]
    new = np.ones(len(head), bool)
    new[1:] = head[1:] != head[:-1]
    kinds = np.add.reduceat(first.astype(np.int64), np.flatnonzero(new))  # stretches per anchor
    ask = first & (kinds[np.cumsum(new) - 1] > 1)
    tell = ask | (~first & ~tie)
    at = order[tell]
    yield from batches_of(
        names,
        [docs[at], starts[at], n[at].astype(np.int64), off[at].astype(np.int32), h[at], ask[tell]],
    )


def _cut(width: int):
    """Pieces of the stretches asked for, named by what all their strings share."""
    core = width - PIECE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple, tuple[int, int]] = {}
            gone: list[tuple[int, int, int]] = []
            for doc, text, asked in zip(
                batch.column("doc").to_pylist(), batch.column("text"), batch.column("asked").to_pylist()
            ):
                text = text.as_py()
                sums, down = running(np.frombuffer(text, np.uint8))
                start, n, off, h = (np.array([a[k] for a in asked], np.int64) for k in ("start", "n", "off", "h"))
                # A piece holds the strings whose distance to the anchor has one quotient.
                far, near = off // PIECE, (off - n + 1) // PIECE
                of = np.repeat(np.arange(len(start)), far - near + 1)
                part = far[of] - (np.arange(len(of)) - np.repeat(np.cumsum(far - near + 1) - (far - near + 1), far - near + 1))
                anchor = start[of] + off[of]
                low = np.maximum(start[of], anchor - (part * PIECE + PIECE - 1))
                high = np.minimum(start[of] + n[of] - 1, anchor - part * PIECE)
                c = anchor - part * PIECE
                key = mix(
                    mix((sums[c + core] - sums[c]) * down[c]) ^ mix(h[of].astype(np.uint64) * np.uint64(64) + part.astype(np.uint64))
                ).astype(np.int64)
                for k, a, b, x in zip(key.tolist(), low.tolist(), high.tolist(), anchor.tolist()):
                    name = (k, b - a + 1, x - a, text[a : b + width])
                    other = rows.setdefault(name, (doc, a))
                    if other != (doc, a):
                        rows[name], later = min(other, (doc, a)), max(other, (doc, a))
                        gone.append((*later, b - a + 1))
            if rows:
                key, n, lead, piece = zip(*rows)
                doc, start = zip(*rows.values())
                columns = [key, doc, start, n, lead, piece]
                kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
                yield pa.record_batch(
                    [pa.array(v, k) for v, k in zip(columns, kinds)],
                    names=["key", "doc", "start", "n", "lead", "piece"],
                )
            if gone:
                doc, start, n = zip(*gone)
                yield pa.record_batch(
                    [pa.nulls(len(gone), pa.int64()), *(pa.array(v, pa.int64()) for v in (doc, start, n))]
                    + [pa.nulls(len(gone), pa.int32()), pa.nulls(len(gone), pa.binary())],
                    names=["key", "doc", "start", "n", "lead", "piece"],
                )

    return run


def repeats(pieces: list[tuple[int, int, int, int, bytes]], width: int) -> list[tuple[int, int]]:
    """(document, start) of every string that another piece, (document, start, strings, lead, bytes), holds earlier.

    Pieces are laid out as big-endian words aligned to their anchors, so words sort as bytes do. Strings
    start up to seven bytes before a word: they are equal if those bytes are and the suffixes from the word
    agree for the rest.
    """
    docs, starts, n, lead = (np.array([p[i] for p in pieces], np.int64) for i in range(4))
    pad = -lead % 8
    laid = b"".join(
        b"\0" * int(p) + x[4] + b"\0" * int(-(p + len(x[4])) % 8) for p, x in zip(pad, pieces)
    )
    words = np.frombuffer(laid, ">u8").astype(np.uint64)
    lengths = (pad + np.array([len(x[4]) for x in pieces]) + 7) // 8
    begin = np.cumsum(lengths) - lengths
    line = suffix_array(words)
    span = width // 8 + 1
    padded = np.concatenate((words, np.zeros(span, np.uint64)))
    common = np.zeros(len(line), np.int64)  # bytes shared with the suffix before, up to 8 * span
    step = 1 << 16
    for a in range(1, len(line), step):
        x = line[a : a + step, None] + np.arange(span)
        y = line[a - 1 : a - 1 + len(x), None] + np.arange(span)
        other = padded[x] ^ padded[y]
        differs = other != 0
        at = np.where(differs.any(1), differs.argmax(1), span)
        odd = other[np.arange(len(at)), np.minimum(at, span - 1)]
        same = sum((odd < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))
        common[a : a + len(x)] = 8 * at + np.where(at < span, same, 0)
    piece = np.repeat(np.arange(len(pieces)), lengths)[line]
    out: list[tuple[int, int]] = []
    for d in range(8):
        alike = np.cumsum(common < width - d)
        rel = 8 * (line - begin[piece]) - d - pad[piece]
        ok = (rel >= 0) & (rel < n[piece])
        p, r, alike = piece[ok], rel[ok], alike[ok]
        left = padded[line[ok] - 1] & np.uint64((1 << (8 * d)) - 1)
        doc, start = docs[p], starts[p] + r
        order, first, tie = earliest(alike, left, doc, start)
        gone = order[~first & ~tie]
        out += zip(doc[gone].tolist(), start[gone].tolist())
    return out


def _sorted(width: int):
    """(doc, start, n) of the strings that go, from pieces in order of their keys."""

    def distinct(group) -> tuple[list, list]:
        best: dict[tuple, tuple[int, int]] = {}
        gone = []
        for doc, start, n, lead, piece in group:
            other = best.setdefault((n, lead, piece), (doc, start))
            if other != (doc, start):
                best[n, lead, piece], later = min(other, (doc, start)), max(other, (doc, start))
                gone.append((*later, n))
        return [(*v, *k) for k, v in best.items()], gone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list = []
        held = 0
        key, group = None, []

        def emit(rows) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.record_batch(
                    [pa.array(v, pa.int64()) for v in zip(*rows)], names=["doc", "start", "n"]
                )

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, held
            left, gone = distinct(group)
            yield from emit(gone)
            if len(left) < 2:
                return
            waiting += left
            held += sum(len(x[4]) + 8 for x in left) // 8
            if held >= SORTED_WORDS:
                yield from sort()

        def sort() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, held
            if len(waiting) > 1:
                yield from emit([(d, s, 1) for d, s in repeats(waiting, width)])
            waiting, held = [], 0

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("key", "doc", "start", "n", "lead", "piece")]
            for k, *rest in zip(*columns):
                if k != key:
                    if len(group) > 1:
                        yield from close()
                    key, group = k, []
                group.append(tuple(rest))
        if len(group) > 1:
            yield from close()
        yield from sort()

    return run


def _strings(width: int):
    """The strings of pieces, one of equal ones among ``HELD_STRINGS``; for the others, which go, no string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple[int, int]] = {}
        gone: list[tuple[int, int]] = []

        def emit() -> Iterator[pa.RecordBatch]:
            places = [*best.values(), *gone]
            if places:
                doc, start = zip(*places)
                yield pa.record_batch(
                    [
                        pa.array([*best, *[None] * len(gone)], pa.binary()),
                        pa.array(doc, pa.int64()),
                        pa.array(start, pa.int64()),
                    ],
                    names=["string", "doc", "start"],
                )
            best.clear()
            gone.clear()

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("doc", "start", "n", "piece")]
            for doc, start, n, piece in zip(*columns):
                for i in range(n):
                    string, place = piece[i : i + width], (doc, start + i)
                    other = best.setdefault(string, place)
                    if other != place:
                        best[string] = min(other, place)
                        gone.append(max(other, place))
                if len(best) + len(gone) >= HELD_STRINGS:
                    yield from emit()
        yield from emit()

    return run


def _grouped(pieces: DataFrame, width: int) -> DataFrame:
    """(doc, start, n) of the strings that go, from pieces of keys of any size."""
    strings = saved(
        pieces.select("doc", "start", "n", "piece").mapInArrow(_strings(width), STRINGS), "suffix-strings"
    )
    alike = strings.where("string is not null")
    # Read back, the repeated strings are shuffled for the join as all strings are, so a hot one can be split.
    repeated = saved(
        alike.groupBy("string")
        .agg(F.count("*").alias("times"), F.min(F.struct("doc", "start")).alias("first"))
        .where("times > 1")
        .select("string", "first"),
        "suffix-repeated",
    )
    later = alike.join(repeated, "string").where(F.struct("doc", "start") != F.col("first"))
    return strings.where("string is null").select("doc", "start").union(later.select("doc", "start")).withColumn(
        "n", F.lit(1).cast("long")
    )


def _remove(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            gone = batch.column("gone")
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                sizes.append(len(text))
                found = gone[i].values
                if found is None or not len(found):
                    spans.append([])
                    kept.append(text)
                    continue
                a = found.field("start").to_numpy()
                a, b = merged(a, a + found.field("n").to_numpy() + (width - 1))
                spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())])
                edges = [0, *np.stack((a, b), 1).ravel().tolist(), len(text)]
                kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2])))
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    return run


def numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, doc, text: ``doc`` is the id, or, where ids repeat, the place of the (id, text) in the ids' order."""
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    most = (
        rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    )
    if (most or 0) < 2:
        return rows.withColumn("doc", F.col("doc_id"))
    rows = rows.withColumn("row", F.xxhash64("text"))
    texts = rows.select("doc_id", "row").where("doc_id is not null").distinct()
    places = number_in_order(texts, [], [F.col("doc_id"), F.col("row")], "doc", unique=True)
    return rows.join(places, ["doc_id", "row"], "left").select("doc_id", "doc", "text")


def remove_repeats(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED
) -> DataFrame:
    """doc_id, n_bytes, spans removed (bytes, end exclusive) and the bytes kept, of every row."""
    rows = numbered(docs, doc_id, text)
    known = rows.where("doc is not null").select("doc", "text")
    buckets = BUCKETS_PER_TASK * input_tasks(docs)
    met = saved(
        known.mapInArrow(_deal(width, seed, buckets), DEALT)
        .repartitionById(buckets, F.col("bucket"))
        .mapInArrow(_meet, MET),
        "suffix-met",
    )
    asked = met.where("ask").groupBy("doc").agg(F.collect_list(F.struct("start", "n", "off", "h")).alias("asked"))
    cut = saved(known.dropDuplicates(["doc"]).join(asked, "doc").mapInArrow(_cut(width), CUT), "suffix-cut")
    pieces = cut.where("key is not null")
    large = saved(
        pieces.groupBy("key").agg(F.count("*").alias("pieces")).where(F.col("pieces") > GROUP_PIECES).select("key"),
        "suffix-large",
    )
    found = (
        pieces.join(large, "key", "left_anti")
        .repartition(buckets, "key")
        .sortWithinPartitions("key")
        .mapInArrow(_sorted(width), GONE)
        .union(_grouped(pieces.join(large, "key", "left_semi"), width))
    )
    gone = (
        met.where("not ask")
        .select("doc", "start", "n")
        .union(cut.where("key is null").select("doc", "start", "n"))
        .union(found)
        .groupBy("doc")
        .agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    )
    return (
        rows.join(gone.withColumnRenamed("doc", "g_doc"), F.col("doc") == F.col("g_doc"), "left")
        .select("doc_id", "text", "gone")
        .mapInArrow(_remove(width), REMOVED)
    )
