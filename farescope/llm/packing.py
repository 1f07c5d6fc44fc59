"""Pack token ids into fixed windows by minimum bin slack.

Documents are tokenised, ended with an end id and cut at the window's length. The
remainders of a batch of documents fill windows one by one: the longest remainder
goes first, then a subset-sum over a bitset of reachable totals picks the multiset
of remainders that leaves the least slack, and the counts are read back from the
stages of the bitset. A pattern is used as often as its counts allow. If slack is
left, a cut of one more remainder fills it. The last window of a batch is cut
into sequences whose lengths are powers of two, which need no padding.

Work is map-only: each task packs its own documents in batches of bounded size, so
nothing is shuffled, and a task that is run again gives the same sequences.

Defined cases: NULL or empty text has the end id only; rows are packed as they come,
so repeated rows are packed each; ids may be NULL; an empty table gives no pieces.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farescope.llm.common import releasing

WINDOW = 2048
END_ID = 1
BATCH_TOKENS = 2_000_000
CACHED_WORDS = 300_000
SLICE_BYTES = 1 << 20
TOKENIZER = "word_bpe_49k.json"

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def tokenizer_at(path: str):
    """The file's tokenizer, one per process: all that encode and decode by it share it, and never change it."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[int, int]:
    """The tokenizer's letter for each byte: printable ones stand for themselves, others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in plain else next(rest) for b in range(256)}


class WordEncoder(dict):
    """Ids of texts as little-endian 32-bit integers; a map from words to their ids that fills itself.

    The tokenizer lower-cases, splits at white space and drops it, so a text's ids are those of
    its words joined, and A-Z may be lowered first unless a special token could be spelled. A run of
    closing marks after a letter or digit is a word of its own to it. A word of lower-case Latin letters
    is one word to its merges, which then need no other step. The map starts anew when full.
    """

    MARKS = b".,;:!?"
    LETTERS = byte_letters()

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        super().__init__()
        self.tokenizer = tokenizer_at(path)
        self.merge = self.tokenizer.model.tokenize
        self.cached = cached

    def __missing__(self, word: bytes) -> bytes:
        body = word.rstrip(self.MARKS)
        if body and len(body) < len(word) and body[-1:].isalnum():
            found = self[body] + self[word[len(body) :]]
        elif word.isalpha() and word.islower():
            found = array("I", [t.id for t in self.merge(word.decode("ascii"))]).tobytes()
        else:
            text = word.decode("utf-8")
            if text.isalpha() and text == text.lower() and max(text) < "\u0250":
                merged = self.merge(word.decode("latin-1").translate(self.LETTERS))
                found = array("I", [t.id for t in merged]).tobytes()
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                found = array("I", ids).tobytes()
        self[word] = found
        return found

    def encode(self, text: bytes) -> bytes:
        if len(self) > self.cached:
            self.clear()
        chunks = (text if b"<|" in text else text.lower()).split()
        return b"".join(map(self.__getitem__, chunks))


_encoders: dict[str, WordEncoder] = {}


def encoder_for(path: str) -> WordEncoder:
    """One encoder per process, so that a worker's later tasks know the words of earlier ones."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def least_slack(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Length -> how many, of the available multiset, with the largest total up to ``capacity``.

    Bit t of ``reach`` says that total t can be made. Each length enters in powers
    of two of its count; the bitset before every step is kept to read the choice back.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, full, steps = 1, 1 << capacity, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], capacity // length)
        times = 1
        while left > 0:
            times = min(times, left)
            steps.append((reach, length, times))
            reach |= (reach << (length * times)) & mask
            left -= times
            times *= 2
        if reach & full:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for before, length, times in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + times
            total -= length * times
    return chosen


def powers(total: int) -> list[int]:
    """Powers of two that sum to ``total``, largest first."""
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


def plan(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token of the documents once."""
    sequences = []
    piles: dict[int, list[tuple[int, int]]] = {}
    counts: dict[int, int] = {}
    for doc, n in enumerate(lengths):
        sequences.extend([(doc, s, window)] for s in range(0, n - window + 1, window))
        if rest := n % window:
            piles.setdefault(rest, []).append((doc, n - rest))
            counts[rest] = counts.get(rest, 0) + 1

    def take(length: int) -> tuple[int, int, int]:
        doc, start = piles[length].pop()
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        return doc, start, length

    def put(doc: int, start: int, length: int) -> None:
        piles.setdefault(length, []).append((doc, start))
        counts[length] = counts.get(length, 0) + 1

    open_total = sum(n * c for n, c in counts.items())
    while open_total >= window:
        longest = max(counts)
        counts[longest] -= 1  # the one that is placed for certain
        chosen = least_slack({k: c for k, c in counts.items() if c}, window - longest)
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        slack = window - sum(n * c for n, c in chosen.items())
        for _ in range(1 if slack else min(counts[n] // c for n, c in chosen.items())):
            pieces = [take(n) for n, c in chosen.items() for _ in range(c)]
            if slack:  # every remainder left is longer than the slack
                doc, start, length = take(min(counts))
                pieces.append((doc, start, slack))
                put(doc, start + slack, length - slack)
            sequences.append(pieces)
            open_total -= window
    last = [take(n) for n in sorted(counts, reverse=True) for _ in range(counts[n])]
    for size in powers(sum(n for _, _, n in last)):
        pieces = []
        while size:
            doc, start, length = last.pop(0)
            here = min(size, length)
            pieces.append((doc, start, here))
            if length > here:
                last.insert(0, (doc, start + here, length - here))
            size -= here
        sequences.append(pieces)
    return sequences


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about ``limit`` bytes."""
    rows = max(1, int(batch.num_rows * limit / max(limit, batch.nbytes)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def pack(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    batch_tokens: int = BATCH_TOKENS,
) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``tokenizer`` is a file that every executor can open; by default the public one's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what a worker's earlier tasks have left
        encoder = encoder_for(tokenizer or tokenizer_path())
        end = np.asarray([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 32

        def emit(ids: list, blobs: list[bytes]) -> pa.RecordBatch:
            nonlocal first
            rows = []
            for pieces in plan([len(b) // 4 for b in blobs], window):
                offset = 0
                for doc, start, length in pieces:
                    blob = blobs[doc]
                    part = blob[4 * start : 4 * (start + length)]
                    rows.append((ids[doc], start, length, part, len(blob) // 4, first, offset))
                    offset += length
                first += 1
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            return pa.record_batch(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names
            )

        ids, blobs, held = [], [], 0
        for batch in batches:
            for part in slices(batch):
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids.append(key)
                    blobs.append(encoder.encode(text or b"") + end)
                    held += len(blobs[-1]) // 4
                    if held >= batch_tokens:
                        yield emit(ids, blobs)
                        ids, blobs, held = [], [], 0
                        pa.default_memory_pool().release_unused()
        if ids:
            yield emit(ids, blobs)

    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")
    ).mapInArrow(releasing(run), PIECES)
