"""Toxicity by a lexicon trie, Levenshtein automata and the words around a hit.

Learning, from a bounded sample of labelled rows (``LEARN_ROWS``, chosen by a hash of the
id): words and word beginnings that toxic texts hold and clean texts do not form the
lexicon. They must stand in more unlike toxic texts than chance explains, so words of one
much-copied text stay out. A logistic regression then weighs what the
lexicon finds.

Scoring: the lexicon is a trie. The Levenshtein automata of its terms are intersected
with it by walking sets of (trie node, edits), determinised as words come, so a word
costs a few table look-ups until its state dies. Every hit is scored by its window:
inside quotation marks, or beside a word of reported speech, it counts as quoted, else
as abuse. Only text is read when a text is scored.

Defined cases: NULL or empty text scores what a text without hits scores; a NULL label is no
label; a labelled id that is missing teaches nothing; repeated rows are scored each;
without a toxic and a clean labelled row there is no lexicon and every score is
``NO_MODEL``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farescope.llm.common import holds_out, releasing, saved

FOLDS, HELD_OUT = 5, 0
LEARN_ROWS = 20_000
CANDIDATES = 5_000
LEXICON = 400
LEAST_TOXIC = 3
MOST_CLEAN = 0.02
STEMS = (4, 5, 6, 7)
WINDOW = 6
REMEMBERED, STATES = 100_000, 50_000  # forms and automaton states that a task keeps
NO_MODEL = 0.0

EDGES = "#$%&|@=+^/\\.,;:!?()[]{}<>*_~`\"'“”„‘’«»…-"
QUOTES = "\"“”„«»‘’"
# Words that introduce what somebody else said.
REPORTING = frozenset(
    "said says wrote writes called calls quote quoted quotes quoting word words term phrase "
    "sagte schrieb nannte wort zitat dit écrit appelé mot citation dijo escribió llamó palabra cita".split()
)


def forms(text: str) -> list[str]:
    return text.lower().split()


def budget(term: str) -> int:
    """Edits under which a term is still taken as misspelled."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Terms (whole words, misspelled or not) and stems (beginnings of words) in one trie."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]  # edits allowed where a term ends
        self.stem: list[bool] = [False]
        self.room: list[int] = [0]  # most edits allowed below a node
        for word in terms:
            self.term[self._path(word, budget(word))] = budget(word)
        for word in stems:
            self.stem[self._path(word, 0)] = True
        self.start = self._close({0: 0})
        self.steps: dict[tuple, dict[str, tuple | None]] = {}
        self.hits: dict[str, int] = {}
        self.clean: set[str] = set()

    def _path(self, word: str, edits: int) -> int:
        node = 0
        self.room[0] = max(self.room[0], edits)
        for c in word:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.term.append(-1)
                self.stem.append(False)
                self.room.append(0)
            node = self.children[node][c]
            self.room[node] = max(self.room[node], edits)
        return node

    def _close(self, state: dict[int, int]) -> tuple:
        """With the nodes reached by leaving characters of a term out; node -> fewest edits."""
        todo = list(state.items())
        while todo:
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits < self.room[child] and state.get(child, 9) > edits + 1:
                    state[child] = edits + 1
                    todo.append((child, edits + 1))
        return tuple(sorted(state.items()))

    def _step(self, state: tuple, c: str) -> tuple | None:
        out: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.room[node] and out.get(node, 9) > edits:
                out[node] = edits

        for node, edits in state:
            reach(node, edits + 1)  # a character too many
            for x, child in self.children[node].items():
                reach(child, edits if x == c else edits + 1)
        return self._close(out) if out else None

    def edits(self, word: str) -> int | None:
        """Fewest edits to a term, 0 for a stem; None if nothing matches."""
        state = self.start
        for c in word:
            steps = self.steps.setdefault(state, {})
            if c in steps:
                state = steps[c]
            else:
                if len(self.steps) > STATES:
                    self.steps = {}
                state = steps[c] = self._step(state, c)
            if state is None:
                return None
            for node, edits in state:
                if self.stem[node] and edits == 0:
                    return 0
        found = [e for node, e in state if e <= self.term[node]]
        return min(found, default=None)

    def known_hits(self, seen: set[str]) -> bool:
        """Whether any of the forms matches; forms are remembered, up to a bound."""
        new = seen - self.clean
        found = False
        for form in new:
            if form not in self.hits:
                edits = self.edits(form.strip(EDGES))
                if edits is None:
                    if len(self.clean) >= REMEMBERED:
                        self.clean.clear()
                    self.clean.add(form)
                    continue
                if len(self.hits) >= REMEMBERED:
                    self.hits.clear()
                self.hits[form] = edits
            found = True
        return found

    def features(self, text: str) -> list[float]:
        """log(1 + n) of exact, misspelled and quoted hits, and of exact hits per 100 words."""
        words = forms(text)
        if not self.known_hits(set(words)):
            return [0.0] * 4
        exact = misspelled = quoted = 0
        for i, form in enumerate(words):
            edits = self.hits.get(form)
            if edits is None:
                if form in self.clean:
                    continue
                edits = self.edits(form.strip(EDGES))
                if edits is None:
                    continue
            if is_quoted(words, i):
                quoted += 1
            elif edits:
                misspelled += 1
            else:
                exact += 1
        density = 100.0 * exact / len(words)
        return [math.log1p(x) for x in (exact, misspelled, quoted, density)]


def is_quoted(words: list[str], i: int) -> bool:
    """Whether the window of word ``i`` makes it a quotation: marks around it, or reported speech before it with a mark."""
    word = words[i]
    if word[0] in QUOTES and word.rstrip(".,;:!?)")[-1:] in QUOTES:
        return True
    before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
    opened = word[0] in QUOTES or any(w[0] in QUOTES for w in before)
    closed = word[-1] in QUOTES or any(w.rstrip(".,;:!?)")[-1:] in QUOTES for w in after)
    shut = any(w.rstrip(".,;:!?)")[-1:] in QUOTES for w in before)
    reported = any(w.strip(EDGES) in REPORTING for w in before)
    return (opened and closed and not shut) or (reported and (opened or closed))


def units(text: str) -> set[str]:
    """What may become a lexicon entry: words outside quotations, and word beginnings marked by a hyphen."""
    words = forms(text)
    if any(q in text for q in QUOTES):
        words = [w for i, w in enumerate(words) if not is_quoted(words, i)]
    words = {w.strip(EDGES) for w in words}
    out = {w for w in words if 3 <= len(w) <= 30}
    for n in STEMS:
        out |= {w[:n] + "-" for w in words if len(w) > n}
    return out


def _count_units(label: int, only: frozenset | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                if toxic == label:
                    found = units(text or "")
                    counts.update(found if only is None else found & only)
        if counts:
            yield pa.record_batch(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                names=["unit", "n"],
            )

    return run


def _held_units(only: frozenset):
    """Per toxic text a value that near copies mostly share, and the units of ``only`` that it holds."""
    order = {u: i for i, u in enumerate(sorted(only))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike, rows = [], []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                if toxic == 1:
                    alike.append(min((crc32(w.encode()) for w in set(forms(text or ""))), default=0))
                    rows.append(sorted(order[u] for u in units(text or "") & only))
            yield pa.record_batch(
                [pa.array(alike, pa.int64()), pa.array(rows, pa.list_(pa.int32()))], names=["alike", "held"]
            )

    return run


def least_support(units_seen: int, toxic: int, clean: int) -> int:
    """Texts that must hold a unit: so many that chance gives less than a tenth of a unit that only toxic ones hold."""
    return max(LEAST_TOXIC, math.ceil(math.log(10 * max(units_seen, 1)) / math.log((toxic + clean) / toxic)))


def choose(support: dict[str, int], least: int, most: int = LEXICON) -> list[str]:
    """Entries of the lexicon, from the number of unlike toxic texts that hold each unit.

    Words with enough support are entries. A stem is one if its words are not mostly one entry; it
    is drawn out while it keeps nine tenths of its support, and then stands for all longer ones.
    """
    enough = {u for u, n in support.items() if n >= least}
    entries = [u for u in enough if not u.endswith("-")]
    covered: list[str] = []
    for stem in sorted((u for u in enough if u.endswith("-")), key=lambda u: (len(u), u)):
        start, wanted = stem[:-1], 0.9 * support[stem]
        if any(start.startswith(c) for c in covered):
            continue
        if any(w.startswith(start) and support[w] >= wanted for w in entries if not w.endswith("-")):
            continue
        drawn = [u for u in enough if u.endswith("-") and u.startswith(start) and support[u] >= wanted]
        longest = max(drawn, key=lambda u: (len(u), support[u], u))
        entries.append(longest)
        covered.append(longest[:-1])
    return sorted(entries, key=lambda u: (-support[u], u))[:most]


def fit(x: np.ndarray, y: np.ndarray, l2: float = 0.02, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps; weights are not negative, as every feature is evidence."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.diag([l2] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        gradient = a.T @ (p - y) + ridge @ w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + ridge
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        w[:-1] = np.maximum(w[:-1], 0.0)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def learn(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    rows: int = LEARN_ROWS,
) -> tuple[list[str], list[str], list[float], float] | None:
    """(terms, stems, weights, bias) from labelled rows outside the held-out fold."""
    # A place in hash order decides which rows are in the sample; about ``rows`` are.
    place = F.pmod(F.xxhash64(F.col("l_id").cast("string")), F.lit(1 << 30))
    marked = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).select(
        F.col(doc_id).alias("l_id"), F.col(label).cast("int").alias("toxic")
    )
    marked = marked.where(~holds_out(F.col("l_id"), FOLDS, HELD_OUT))
    n = marked.count()
    if not n:
        return None
    chosen = marked.where(place < int(min(1.0, rows / n) * (1 << 30)))
    sample = saved(
        docs.select(F.col(doc_id).alias("d_id"), F.col(text).alias("text"))
        .join(F.broadcast(chosen), F.col("d_id") == F.col("l_id"))  # about ``rows`` rows at most
        .select("text", "toxic"),
        "toxicity-sample",
    )
    size = {r.toxic: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return None

    def counted(which: int, only: frozenset | None) -> DataFrame:
        return (
            sample.where(F.col("toxic") == which)
            .mapInArrow(releasing(_count_units(which, only)), "unit string, n long")
            .groupBy("unit")
            .agg(F.sum("n").alias("n"))
        )

    toxic_units = counted(1, None).where(F.col("n") >= LEAST_TOXIC)
    seen_units = toxic_units.count()
    common = frozenset(
        r.unit for r in toxic_units.orderBy(F.col("n").desc(), "unit").limit(20 * CANDIDATES).collect()
    )
    clean = {r.unit: r["n"] for r in counted(0, common).collect()}
    toxic_rate = {u: clean.get(u, 0) / size[0] for u in common}
    toxic_n = {r.unit: r["n"] for r in counted(1, common).collect()}

    def weight(u: str) -> float:
        return toxic_n[u] / size[1] * math.log((toxic_n[u] / size[1]) / (toxic_rate[u] + 0.5 / size[0]))

    good = [u for u in common if toxic_rate[u] <= MOST_CLEAN * toxic_n[u] / size[1]]
    good = frozenset(sorted(good, key=lambda u: (-weight(u), u))[:CANDIDATES])
    names = sorted(good)
    unlike: dict[str, set[int]] = {u: set() for u in names}
    for row in sample.mapInArrow(releasing(_held_units(good)), "alike long, held array<int>").collect():
        for u in row.held:
            unlike[names[u]].add(row.alike)
    entries = choose({u: len(x) for u, x in unlike.items()}, least_support(seen_units, size[1], size[0]))
    terms = [u for u in entries if not u.endswith("-")]
    stems = [u[:-1] for u in entries if u.endswith("-")]
    seen = sample.mapInArrow(releasing(_featured(terms, stems)), "toxic int, f array<double>").collect()
    x = np.array([r.f for r in seen])
    y = np.array([r.toxic for r in seen], float)
    weights, bias = fit(x, y)
    return terms, stems, weights.tolist(), bias


def _featured(terms: list[str], stems: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms, stems)
        for batch in batches:
            f = [lexicon.features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("toxic"), pa.array(f, pa.list_(pa.float64()))], names=["toxic", "f"]
            )

    return run


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is not None:
            terms, stems, weights, bias = model
            lexicon = Lexicon(terms, stems)
        for batch in batches:
            scores = []
            for text in batch.column("text"):
                if model is None:
                    scores.append(NO_MODEL)
                    continue
                f = lexicon.features(text.as_py() or "")
                z = bias + sum(w * v for w, v in zip(weights, f))
                scores.append(1 / (1 + math.exp(-max(-35.0, min(35.0, z)))))
            keys = batch.column("key")
            yield pa.record_batch([keys, pa.array(scores, pa.float64())], names=["key", "score"])

    return run


def score(docs: DataFrame, model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    kind = docs.schema[doc_id].dataType.simpleString()
    return (
        docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text"))
        .mapInArrow(releasing(_scored(model)), f"key {kind}, score double")
        .select(
            F.col("key").alias("doc_id"),
            holds_out(F.col("key"), FOLDS, HELD_OUT).alias("held_out"),
            "score",
            (F.col("score") >= 0.5).cast("int").alias("predicted"),
        )
    )


def clean_documents(docs: DataFrame, model, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    schema = docs.schema
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def asked() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held.append(batch)
                rows = pa.array(range(batch.num_rows), pa.int64())
                yield pa.record_batch([rows, batch.column(at)], names=["key", "text"])

        for scored in _scored(model)(asked()):  # one lexicon a task
            keep = [s < 0.5 for s in scored.column("score").to_pylist()]
            yield held.pop().filter(pa.array(keep, pa.bool_()))
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(releasing(run), schema)
