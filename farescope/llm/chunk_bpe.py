"""BPE encoding by chunks that documents share, and decoding.

Texts are cut where a rolling hash of the last bytes says so, so equal passages are cut alike
wherever they stand. Chunks that at least two different texts hold are encoded once, from one of these
texts; their ids go to every text that holds them, and what lies between is encoded where the text is. A
chunk's ids hold for its whole words only, as its first and last ones may go on in its neighbours. So every
join is encoded again, from the last whole word before it to the first one after it, and has to
agree with the ids of both words; where it does not, the chunks at that join are given up and the longer
stretch is encoded, in the end the whole text.

Plan: texts travel once, compressed, dealt by a 128-bit hash of the text; that one exchange serves both
the join that finds a chunk's text and the join that brings a text its shared chunks. Chunks are counted, and joined,
as rows of hashes. Equal texts count as one, so copies add no rows past the map side; a chunk in many
texts is a hot key of a join alone, which Spark splits.

The tokenizer must drop white space, so that words are encoded on their own; others are refused.
Chunks are known by 128-bit hashes, so two that collide would be taken for equal.

A task holds a batch of rows and, beside it, about ``SLICE_BYTES`` of what it makes of them; hashes are made by
blocks, of long texts too. At its end its worker gives freed memory back.

Defined cases: NULL or empty text has no ids and decodes to the empty text; rows without an id are encoded
like others; repeated rows give a row each; very long texts are cut and joined like short ones; an
empty table gives no rows; other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farescope.llm.common import releasing
from farescope.llm.hashing import mix, raw, running, units
from farescope.llm.packing import SLICE_BYTES, WordEncoder, slices, tokenizer_at, tokenizer_path

WINDOW = 32  # bytes that decide a cut
AVERAGE = 512  # bytes between cuts, a power of two
LEAST, MOST = 128, 8192  # bytes of a chunk; shorter ones are encoded in place
HASHED_BYTES = 1 << 16  # bytes of a text whose hashes are held at once
CACHED_WORDS = 100_000
DOCS = "doc_id long, k1 long, k2 long, packed binary"
PIECES = "k1 long, k2 long, doc_id long, start int, size int, h1 long, h2 long"
CORES = "h1 long, h2 long, core binary"
IDS = "doc_id long, ids array<int>"
ROWS_OUT, TOKENS_OUT = 256, 1 << 17
# Stated, though no hash is NULL: joins would add these tests to one use of a table and so part it from the other.
KEYS = "k1 IS NOT NULL AND k2 IS NOT NULL AND h1 IS NOT NULL AND h2 IS NOT NULL"

class RecentWords(WordEncoder):
    """Keeps the words of the last two fillings of its map, so that common words outlast the rare ones."""

    old: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        if (found := self.old.get(word)) is None:
            return super().__missing__(word)
        self[word] = found
        return found

    def encode(self, text: bytes) -> bytes:
        if len(self) > self.cached:
            self.old = dict(self)
            self.clear()
        return super().encode(text)


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder, after a look at whether the tokenizer drops white space."""
    if path not in _encoders:
        encoder = RecentWords(path, CACHED_WORDS)
        one, two, both = (encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in ("a", "b", " a \n b "))
        if one + two != both:
            raise ValueError("the tokenizer keeps white space, so words cannot be encoded on their own")
        _encoders[path] = encoder
    return _encoders[path]


def names_of(data: bytes) -> tuple[int, int]:
    """A 128-bit hash as two signed 64-bit numbers."""
    from xxhash import xxh3_128_digest

    one, two = np.frombuffer(xxh3_128_digest(data), "<i8").tolist()
    return one, two


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions after which the hash of the last ``WINDOW`` bytes asks for a cut, moved to a character's start."""
    if len(data) <= WINDOW:
        return np.zeros(0, np.int64)
    found, after = [], len(data)  # the first character's start behind the block
    for first in reversed(range(0, len(data) - WINDOW + 1, HASHED_BYTES)):
        # A window's hash does not depend on its place, so blocks give the hashes of the whole.
        sums, down = running(data[first : first + HASHED_BYTES + WINDOW - 1])
        hashes = mix((sums[WINDOW:] - sums[:-WINDOW]) * down[: len(sums) - WINDOW])
        points = np.flatnonzero(hashes & np.uint64(AVERAGE - 1) == 0)
        ends = data[first + WINDOW : first + WINDOW + HASHED_BYTES]
        starts = np.append(np.flatnonzero(ends & 0xC0 != 0x80) + first + WINDOW, after)
        found.append(starts[np.searchsorted(starts, points + first + WINDOW)])
        after = starts[0]
    return np.unique(np.concatenate(found))


def chunks(points: list[int], begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Chunks of a text that lies from ``begin`` to ``end``, of ``LEAST`` to ``MOST`` bytes but for the last one."""
    at, i = begin, 0
    while at < end:
        i = bisect_left(points, at + LEAST, i)
        cut = min(points[i] if i < len(points) else end, end)
        # A longer stretch without a cut is not shared by its chunks, so it stays in place.
        if cut - at <= MOST:
            yield at, cut
        at = cut


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = raw(batch.column(1))
        ids = batch.column(0).to_pylist()
        seen: set[tuple[int, int]] = set()
        for a, b in units(offsets):
            unit = data[offsets[a] : offsets[b]]
            points, whole, rows = cut_points(unit).tolist(), unit.tobytes(), []
            for i in range(a, b):
                begin, end = int(offsets[i] - offsets[a]), int(offsets[i + 1] - offsets[a])
                if end - begin < LEAST:
                    continue
                key = names_of(whole[begin:end])
                if key in seen:
                    continue
                seen.add(key)
                rows += [
                    (*key, ids[i], s - begin, e - s, *names_of(whole[s:e]))
                    for s, e in chunks(points, begin, end)
                    if e - s >= LEAST
                ]
            if rows:
                kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 2
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    names=["k1", "k2", "doc_id", "start", "size", "h1", "h2"],
                )


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from zstandard import ZstdCompressor

    squeeze = ZstdCompressor(level=3).compress
    for batch in batches:
        _, offsets = raw(batch.column(1))
        for a, b in units(offsets, SLICE_BYTES):
            part = batch.slice(a, b - a)
            texts = [v or b"" for v in part.column(1).to_pylist()]
            one, two = zip(*map(names_of, texts))
            packed = pa.array(map(squeeze, texts), pa.binary())
            yield pa.record_batch(
                [part.column(0), pa.array(one, pa.int64()), pa.array(two, pa.int64()), packed],
                names=["doc_id", "k1", "k2", "packed"],
            )


SPACES = b" \t\n\r\x0b\x0c"


def _first_space(data: bytes, at: int, end: int) -> int:
    while at < end and data[at] not in SPACES:
        at += 1
    return at


def _last_space(data: bytes, begin: int, at: int) -> int:
    """The position after the last white space before ``at``."""
    while at > begin and data[at - 1] not in SPACES:
        at -= 1
    return at


def core_of(chunk: bytes) -> tuple[int, int, int, int] | None:
    """(start, end of its first word, start of its last word, end) of a chunk's whole words, if it has two."""
    p = _first_space(chunk, 0, len(chunk))
    while p < len(chunk) and chunk[p] in SPACES:
        p += 1
    q = _last_space(chunk, 0, len(chunk))
    while q > 0 and chunk[q - 1] in SPACES:
        q -= 1
    p2 = _first_space(chunk, p, q)
    q2 = _last_space(chunk, p, q)
    return (p, p2, q2, q) if p < p2 <= q2 < q else None


def _cores(path: str | None):
    """Rows (k1, k2, packed, chunks of start, size, h1, h2) to the chunks' encoded cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor, ZstdDecompressor

        encode = word_encoder(path or tokenizer_path()).encode
        squeeze, unpack = ZstdCompressor(level=3).compress, ZstdDecompressor().decompress
        held = None
        for batch in batches:
            for part in slices(batch):
                rows = []
                for k1, k2, packed, wanted in zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "packed", "chunks"))):
                    if held == (k1, k2):  # another row of the same id and text
                        continue
                    held, text = (k1, k2), unpack(packed)
                    for c in wanted:
                        chunk = text[c["start"] : c["start"] + c["size"]]
                        if ends := core_of(chunk):
                            p, p2, q2, q = ends
                            parts = [encode(chunk[p:q]), encode(chunk[p:p2]), encode(chunk[q2:q])]
                            head = np.array([p, p2, q2, q, *map(len, parts)], "<i4").tobytes()
                            rows.append((c["h1"], c["h2"], squeeze(head + b"".join(parts))))
                if rows:
                    yield pa.record_batch(
                        [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))],
                        names=["h1", "h2", "core"],
                    )

    return run


class Core:
    """A shared chunk's whole words at their place in a text; ids as little-endian 32-bit integers."""

    __slots__ = ("start", "first_end", "last_start", "end", "ids", "first", "last")

    def __init__(self, at: int, plain: bytes):
        *ends, n, first, last = np.frombuffer(plain[:28], "<i4").tolist()
        self.start, self.first_end, self.last_start, self.end = (at + x for x in ends)
        self.ids = plain[28 : 28 + n]
        self.first = plain[28 + n : 28 + n + first]
        self.last = plain[28 + n + first :]


def assemble(text: bytes, cores: list[Core], encode) -> bytes:
    """Ids of ``text`` from those of its cores (in order, apart) and of the joins between them."""
    while True:
        joins, bad = [], set()
        for left, right in pairwise([None, *cores, None]):
            begin = left.last_start if left else 0
            end = right.first_end if right else len(text)
            found = encode(text[begin:end])
            before, after = left.last if left else b"", right.first if right else b""
            if len(found) >= len(before) + len(after) and found.startswith(before) and found.endswith(after):
                joins.append(found[len(before) : len(found) - len(after)])
            else:
                bad |= {left, right}
        if not bad:
            break
        cores = [c for c in cores if c not in bad]
    out = [joins[0]]
    for core, join in zip(cores, joins[1:]):
        out += [core.ids, join]
    return b"".join(out)


def _join_up(path: str | None):
    """Rows (doc_id, k1, k2, packed, shared) to (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdDecompressor

        encode = word_encoder(path or tokenizer_path()).encode
        unpack = ZstdDecompressor().decompress
        held, ids = None, b""

        def emit(docs: list[int | None], blobs: list[bytes]) -> pa.RecordBatch:
            ends = np.cumsum([0, *(len(b) // 4 for b in blobs)])
            values = pa.array(np.frombuffer(b"".join(blobs), "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            return pa.record_batch([pa.array(docs, pa.int64()), lists], names=["doc_id", "ids"])

        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(first, ROWS_OUT)
                docs, blobs, size = [], [], 0
                columns = (part.column(c).to_pylist() for c in ("doc_id", "k1", "k2", "packed", "shared"))
                for doc, k1, k2, packed, shared in zip(*columns):
                    if held != (k1, k2):  # copies come one after another
                        cores = [Core(s["start"], unpack(s["core"])) for s in shared or ()]
                        held, ids = (k1, k2), assemble(unpack(packed), sorted(cores, key=lambda c: c.start), encode)
                    docs.append(doc)
                    blobs.append(ids)
                    size += len(ids)
                    if size >= SLICE_BYTES:
                        yield emit(docs, blobs)
                        docs, blobs, size = [], [], 0
                if docs:
                    yield emit(docs, blobs)

    return run


def all_chunks(docs: DataFrame) -> DataFrame:
    """Rows of ``PIECES`` (doc_id, text binary): every chunk of every different text, with the text's smallest id."""
    return (
        docs.mapInArrow(releasing(_cut), PIECES)
        .where(KEYS)
        .groupBy("k1", "k2", "start", "size", "h1", "h2")
        .agg(F.min("doc_id").alias("doc_id"))
    )


def encode(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None
) -> DataFrame:
    """doc_id, ids (array of int) of every row; ``tokenizer`` is a file that every executor can open."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    texts = rows.mapInArrow(releasing(_pack_texts), DOCS).where("k1 IS NOT NULL AND k2 IS NOT NULL")
    pieces = all_chunks(rows)
    place = F.struct("k1", "k2", "doc_id", "start", "size")
    owners = (
        pieces.groupBy("h1", "h2")
        .agg(F.min(place).alias("owner"), F.max(F.struct("k1", "k2")).alias("other"))
        .where((F.col("owner.k1") != F.col("other.k1")) | (F.col("owner.k2") != F.col("other.k2")))
        .select("h1", "h2", "owner.*")
        # One row a text, so that a long one is not sent again with each of its chunks.
        .groupBy(F.col("k1").alias("o_k1"), F.col("k2").alias("o_k2"), F.col("doc_id").alias("o_doc"))
        .agg(F.collect_list(F.struct("start", "size", "h1", "h2")).alias("chunks"))
    )
    same_text = (F.col("k1") == F.col("o_k1")) & (F.col("k2") == F.col("o_k2"))
    # Compared after the join, not as a key of it: both joins of the texts are dealt by the text's hash alone.
    same_row = (F.col("doc_id").bitwiseXOR(F.col("o_doc")) == 0) | (F.col("doc_id").isNull() & F.col("o_doc").isNull())
    encoded = (
        texts.join(owners.hint("merge"), same_text & same_row)
        .select("k1", "k2", "packed", "chunks")
        .mapInArrow(releasing(_cores(tokenizer)), CORES)
        # Rows that repeat id and text may lie in two tasks; the join must meet one core. Grouped by more
        # than the join key, so that the join shuffles both sides and can split a hot chunk.
        .groupBy("h1", "h2", F.pmod("h1", F.lit(1)).alias("apart"))
        .agg(F.min("core").alias("core"))
        .select(F.col("h1").alias("c_h1"), F.col("h2").alias("c_h2"), "core")
    )
    found = (
        pieces.join(encoded, (F.col("h1") == F.col("c_h1")) & (F.col("h2") == F.col("c_h2")))
        .groupBy(F.col("k1").alias("s_k1"), F.col("k2").alias("s_k2"), "doc_id")  # one id a text
        .agg(F.collect_list(F.struct("start", "core")).alias("shared"))
        .drop("doc_id")
    )
    same_list = (F.col("k1") == F.col("s_k1")) & (F.col("k2") == F.col("s_k2"))
    return (
        texts.join(found.hint("merge"), same_list, "left")  # sorted, so copies are assembled once
        .select("doc_id", "k1", "k2", "packed", "shared")
        .mapInArrow(releasing(_join_up(tokenizer)), IDS)
    )


def decoder(path: str, skip_special_tokens: bool):
    """Lists of ids to texts. A tokenizer without a decoder joins its tokens by spaces, which Arrow does for all at once."""
    tokenizer = tokenizer_at(path)
    size = tokenizer.get_vocab_size()
    tokens = pa.array([tokenizer.id_to_token(i) for i in range(size)], pa.string())

    def one_by_one(lists: pa.ListArray) -> pa.Array:
        texts = (tokenizer.decode(v, skip_special_tokens=skip_special_tokens) for v in lists.to_pylist())
        return pa.array(texts, pa.string())

    def joined(lists: pa.ListArray) -> pa.Array:
        ids = lists.flatten()
        if len(ids) and not 0 <= pc.min(ids).as_py() <= pc.max(ids).as_py() < size:
            return one_by_one(lists)  # the library passes over ids it does not know
        ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens.take(ids)), " ")

    return one_by_one if skip_special_tokens or tokenizer.decoder is not None else joined


def decode(
    encoded: DataFrame, *, ids: str = "ids", tokenizer: str | None = None, skip_special_tokens: bool = False
) -> DataFrame:
    """doc_id, ids, text: the tokenizer's text for the ids of every row; NULL ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoder(tokenizer or tokenizer_path(), skip_special_tokens)
        for batch in batches:
            for first, last in units(batch.column(1).offsets.to_numpy().astype(np.int64), TOKENS_OUT):
                part = batch.slice(first, last - first)
                yield pa.record_batch([*part.columns, back(part.column(1))], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", F.coalesce(ids, F.array().cast("array<int>")).alias("ids")).mapInArrow(
        releasing(run), f"{IDS}, text string"
    )
