"""Join of documents whose sets of word n-grams have a Jaccard similarity of 0.75 or more.

Documents with equal sets are one class, so copies never meet as pairs. Two similar sets
share a token among the first quarter of each, in any fixed order of tokens (prefix filter),
so classes are grouped by those tokens; tokens that are common in the corpus come last in
the order. Inside a group a signature tree is joined with itself (``signature_tree``), and
each pair that its bounds leave is compared exactly.

Prefixes are somewhat longer than that, so that similar sets share several tokens there, and a class with
fewer repeated ones is left out. A pair need only meet at its first common token, which bounds its overlap by what follows in
either set; members of a group that no other can satisfy so are left out of it.

Groups are opened in rounds: first by each class's first repeated tokens, then by all. A
group is opened only while it still joins two components, so the many
groups that near copies share cost one opening. No round drops a pair that could add
a link between components: the last one covers every group left.

``link_components`` needs no more than that. ``similar_pairs`` is the whole join: it opens every group and
keeps every similar pair of classes, and ``count_links`` gives the number of links of each document from
the pairs and the classes' sizes. Its pairs grow with the square of a group of near copies, as the result does.

Hot groups: tokens are counted over all documents (a count per batch, summed), copies are
collapsed before tokens are dealt, and a group of more than ``BLOCK`` classes is cut into blocks
whose pairs go to different tasks.

Defined cases: a text without words has an empty set and is linked with nothing, so its
component is its own id; a NULL id has a count but no component and links nothing; rows that
share an id are one document for components; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farescope.llm.common import files_for, input_tasks, releasing, saved
from farescope.llm.hashing import (
    HASH_BITS,
    hash_of,
    mix,
    shingle_sets,
    shingle_units,
    signatures,
    sorted_per_value,
    value_of,
)
from farescope.llm.signature_tree import bitmap, hopeful
from farescope.llm.signature_tree import join as tree_join
from farescope.llm.signature_tree import pairs as tree_pairs
from farescope.plans.session import working_folder

WORDS = 5
PERCENT = 75
HOT_TOKENS = 1 << 20
HOT_IN_BATCH = 3
BLOCK = 4096
ROUNDS = (2, None)
LOCAL_LINKS = 1 << 20
STEP = 32
SIEVE_BITS = 1 << 23
BUCKETS_PER_TASK = 4
HOT = np.uint64(1 << 63)

SIGNED = "doc_id long, n long, s1 long, s2 long, token long, times long"
DEALT = ["bucket", "keys", "classes", "sizes", "rests"]
SOURCES = "class long, s2 long, doc_id long, n int, bits binary, packed binary"


def _new(seen: set, one: np.ndarray, two: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which sets are not empty and were not seen in this batch before."""
    out = np.zeros(len(sizes), bool)
    for i, name in enumerate(zip(one.tolist(), two.tolist())):
        if sizes[i] and name not in seen:
            seen.add(name)
            out[i] = True
    return out


def _sign(words: int):
    """Per document its set's size and signature; per batch the tokens that many sets hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ones, twos, held, seen = [], [], [], [], set()
            for _, bounds, hashes in shingle_units(batch.column(1), words):
                n = np.diff(bounds)
                one, two = signatures(bounds, hashes)
                held.append(hashes[np.repeat(_new(seen, one, two, n), n)])
                sizes.append(n)
                ones.append(one)
                twos.append(two)
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            many = times >= HOT_IN_BATCH
            n, one, two = map(np.concatenate, (sizes, ones, twos))
            yield pa.record_batch(
                [batch.column(0), pa.array(n), pa.array(one), pa.array(two), pa.nulls(len(n), pa.int64())]
                + [pa.nulls(len(n), pa.int64())],
                names=["doc_id", "n", "s1", "s2", "token", "times"],
            )
            blank = pa.nulls(int(many.sum()), pa.int64())
            yield pa.record_batch(
                [blank] * 4 + [pa.array(tokens[many].astype(np.int64)), pa.array(times[many].astype(np.int64))],
                names=["doc_id", "n", "s1", "s2", "token", "times"],
            )

    return run


class TokenOrder:
    """The global order of tokens: by hash, then the hot ones by how common they are."""

    def __init__(self, hot: np.ndarray, rank: np.ndarray):
        self.hot, self.rank = hot, rank
        self.maybe = np.zeros(1 << 23, bool)
        self.maybe[(hot & np.uint64((1 << 23) - 1)).astype(np.int64)] = True

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        keys = mix(hashes) >> np.uint64(1)
        asked = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 23) - 1)).astype(np.int64)])
        if len(asked):
            at = np.minimum(np.searchsorted(self.hot, hashes[asked]), len(self.hot) - 1)
            is_hot = self.hot[at] == hashes[asked]
            keys[asked[is_hot]] = HOT | (self.rank[at[is_hot]] << np.uint64(32))
        return keys


def shared_tokens(n, percent: int):
    """Tokens that two similar sets share at least in their prefixes, one of them of size ``n``.

    A prefix is longer by one token for every ``STEP`` of its set, and every token more is one more that two
    similar sets share there. The other set may be the smaller one.
    """
    if isinstance(n, Column):
        return F.floor(F.floor(n * percent / 100) / STEP) + 1
    return n * percent // 100 // STEP + 1


def _deal(words: int, percent: int, buckets: int, hot):
    """Per bucket, packed: the keys of the prefixes of a batch's distinct sets, their classes, the sets' sizes, and
    how many tokens of the set follow, the key's own included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = TokenOrder(*hot.value)
        for batch in batches:
            keys, classes, sizes, rests, seen = [], [], [], [], set()
            for _, bounds, hashes in shingle_units(batch.column(1), words):
                n = np.diff(bounds)
                one, two = signatures(bounds, hashes)
                new = _new(seen, one, two, n)
                of = np.repeat(np.arange(len(n)), n)
                use = new[of]
                ordered = sorted_per_value(order.keys(hashes[use]), of[use])
                of = value_of(ordered)
                nth = np.arange(len(of)) - np.searchsorted(of, np.arange(len(n)))[of]
                prefix = nth < (n + (-percent * n // 100) + 1 + n // STEP)[of]
                of, nth = of[prefix], nth[prefix]
                keys.append(hash_of(ordered[prefix]))
                classes.append(one[of])
                sizes.append(n[of])
                rests.append(n[of] - nth)
            k, c, n, rest = map(np.concatenate, (keys, classes, sizes, rests))
            bucket = (mix(k) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            k, bucket = (k[by] >> np.uint64(HASH_BITS - 32)).astype("<u4"), bucket[by]
            kind = "<u2" if n.max(initial=0) < 1 << 16 else "<u4"
            packed = k, c[by], n[by].astype(kind), rest[by].astype(kind)
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            if len(edges) > 1:
                yield pa.record_batch(
                    [pa.array(bucket[edges[:-1]].astype(np.int32))]
                    + [pa.array([v[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()) for v in packed],
                    names=DEALT,
                )

    return run


def satisfiable(k: np.ndarray, n: np.ndarray, rest: np.ndarray, percent: int) -> np.ndarray:
    """Which members have another one in their group that a first common token here could link.

    Members are in order of group ``k`` and size ``n``; ``rest`` tokens are left in each. Two may be linked if
    the smaller rest is enough for both sizes: if each size is within the other's reach. The sizes
    within a member's reach are a run of its group, so the longest reach over that run decides.
    """
    start = np.flatnonzero(np.diff(k, prepend=-1))
    counts = np.diff(np.append(start, len(k)))
    group = np.repeat(np.arange(len(start)), counts)
    first = np.repeat(start, counts)
    reach = np.minimum((100 + percent) * rest // percent - n, (1 << 31) - 1)
    stop = np.searchsorted((group << 32) | n, (group << 32) | np.maximum(reach, 0), "right")
    longest = [reach.astype(np.int32)]  # over 1, 2, 4, ... members from each place
    while 2 << (len(longest) - 1) <= counts.max(initial=0):
        half = 1 << (len(longest) - 1)
        longest.append(np.maximum(longest[-1][:-half], longest[-1][half:]))

    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, np.int64)
        some = np.flatnonzero(b > a)
        level = np.frexp((b - a)[some])[1] - 1
        for x in np.unique(level):
            at = some[level == x]
            out[at] = np.maximum(longest[x][a[at]], longest[x][b[at] - (1 << x)])
        return out

    me = np.arange(len(k))
    return (over(first, np.minimum(me, stop)) >= n) | (over(me + 1, stop) >= n)


def _repeated(percent: int):
    """(gid, class, fits) of the keys that two classes or more share, per bucket.

    ``fits`` tells whether another class of the key may be linked with this one by a first common token here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            for bucket, k, c, n, rest in zip(*(batch.column(i).to_pylist() for i in range(5))):
                parts[0].append(np.frombuffer(k, "<u4").astype(np.int64) | (bucket << 32))
                parts[1].append(np.frombuffer(c, np.int64))
                kind = "<u2" if len(n) * 2 == len(k) else "<u4"
                parts[2].append(np.frombuffer(n, kind).astype(np.int64))
                parts[3].append(np.frombuffer(rest, kind).astype(np.int64))
        if not parts[0]:
            return
        k, c, n, rest = map(np.concatenate, parts)
        order = np.lexsort((c, n, k))
        k, c, n, rest = k[order], c[order], n[order], rest[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        k, c, n, rest = k[new], c[new], n[new], rest[new]
        if not len(k):
            return
        counts = np.diff(np.append(np.flatnonzero(np.diff(k, prepend=-1)), len(k)))
        many = np.repeat(counts > 1, counts)
        k, c, fits = k[many], c[many], satisfiable(k[many], n[many], rest[many], percent)
        for i in range(0, len(k), 100_000):
            yield pa.record_batch(
                [pa.array(x[i : i + 100_000]) for x in (k, c, fits)], names=["gid", "class", "fits"]
            )

    return run


def sieve(classes: DataFrame) -> np.ndarray:
    """A bitmap of ``SIEVE_BITS`` in which every class's bit is set, so that most others can be left out early."""
    bit = F.expr(f"w_class & {SIEVE_BITS - 1}L")
    words = (
        classes.groupBy((bit / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, int((w_class & {SIEVE_BITS - 1}L) % 64))")).alias("bits"))
        .toPandas()  # at most SIEVE_BITS / 64 rows
    )
    out = np.zeros(SIEVE_BITS // 64, np.int64)
    out[words.word.to_numpy(int)] = words.bits.to_numpy(np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _sources(words: int, sifted):
    """Per wanted set of a batch: class, second signature, smallest id, size, bitmap and packed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = sifted.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            best: dict[tuple, tuple] = {}
            for first, bounds, hashes in shingle_units(texts, words):
                one, two = signatures(bounds, hashes)
                for i in np.flatnonzero((np.diff(bounds) > 0) & maybe[one & (SIEVE_BITS - 1)]).tolist():
                    a, b = bounds[i], bounds[i + 1]
                    name, doc = (int(one[i]), int(two[i])), ids[first + i]
                    if name in best and best[name][0] <= doc:
                        continue
                    packed = zlib.compress(texts[first + i].as_py(), 1)
                    best[name] = (doc, int(b - a), bitmap(hashes[a:b]), packed)
            if best:
                one, two = zip(*best)
                columns = [one, two, *zip(*best.values())]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.record_batch(
                    [pa.array(v, k) for v, k in zip(columns, kinds)],
                    names=["class", "s2", "doc_id", "n", "bits", "packed"],
                )

    return run


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """(task, rows) of batches whose rows are in order of their task."""
    task, held = None, []
    for batch in batches:
        for t, *row in zip(batch.column("task").to_pylist(), *(batch.column(n).to_pylist() for n in names)):
            if t != task:
                if len(held) > 1:
                    yield task, held
                task, held = t, []
            held.append(row)
    if len(held) > 1:
        yield task, held


def _hope(percent: int):
    """(task, class, comp) of the members that may link two components, by sizes and bitmaps alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for task, rows in _groups(batches, ("class", "comp", "n", "bits")):
            classes, comps, sizes, bits = zip(*rows)
            if len(set(comps)) > 1:
                out += [(task, classes[i], comps[i]) for i in hopeful(bits, sizes, comps, percent)]
            if len(out) > 10_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, pa.int64()) for v in zip(*out)], names=["task", "class", "comp"])


def _open(words: int, percent: int, every: bool):
    """Links between components, or, if ``every``, between all members, from texts in order of their task."""

    def sets(texts: list[bytes]) -> list[np.ndarray]:
        return list(shingle_sets(pa.array([zlib.decompress(t) for t in texts], pa.binary()), words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, ("comp", "packed")):
            comps = [r[0] for r in rows]
            if len(set(comps)) < 2:
                continue
            held = sets([r[1] for r in rows])
            made = tree_pairs(held, percent) if every else tree_join(held, comps, percent)
            if made:
                yield pa.record_batch(
                    [pa.array([comps[p[i]] for p in made], pa.int64()) for i in (0, 1)], names=["a", "b"]
                )

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    if root:
        nodes = list(root)
        yield pa.record_batch(
            [pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "comp"]
        )


def smallest_reachable(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node that links (a, b) reach from each node that has one.

    Up to ``LOCAL_LINKS`` links are united in one task, which that number bounds. Beyond it, large-star and
    small-star steps alternate until nothing changes; each step is written out.
    """
    if links.count() <= LOCAL_LINKS:
        return saved(links.coalesce(1).mapInArrow(_united, "node long, comp long"), "reached")
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, before = saved(edges.distinct(), "links"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small.select("u", F.col("m").alias("v"))
        )
        edges = saved(small.where("u <> v").distinct(), "links")
        after = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first()
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before = after


def commonest(common: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens with the largest counts, ``most`` of them at most, in order, and their ranks by count.

    How many tokens have each count tells from which count on they fit.
    """
    sizes = sorted(common.groupBy("times").count().collect(), key=lambda r: -r.times)
    total, cut = 0, None
    for row in sizes:
        total += row["count"]
        if total > most:
            break
        cut = row.times
    if cut is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    rows = common.where(F.col("times") >= cut).toPandas()
    tokens, times = rows.token.to_numpy(np.int64), rows.times.to_numpy(np.int64)
    rank = np.empty(len(tokens), np.uint64)
    rank[np.lexsort((tokens, times))] = np.arange(len(tokens), dtype=np.uint64)
    order = np.argsort(tokens.astype(np.uint64))
    return tokens.astype(np.uint64)[order], rank[order]


def _prepared(docs: DataFrame, doc_id: str, text: str, words: int, percent: int):
    """Signed rows, classes, groups of classes by token, the classes that may have links, and their table's name."""
    spark = docs.sparkSession
    texts = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")
    )
    signed = saved(texts.mapInArrow(releasing(_sign(words)), SIGNED), "ngram-signed")
    rows = signed.where("n is not null").select("doc_id", "n", "s1", "s2")
    common = (
        signed.where("token is not null")
        .groupBy("token")
        .agg(F.sum("times").alias("times"))
    )
    files = files_for(texts)
    common = saved(common, "ngram-common", files)
    hot = spark.sparkContext.broadcast(commonest(common, HOT_TOKENS))

    # A class is a distinct set, named by its first signature; its representative is its smallest id.
    classes = saved(
        rows.where("n > 0 and doc_id is not null")
        .groupBy(F.col("s1").alias("class"), "s2", "n")
        .agg(F.min("doc_id").alias("rep")),
        "ngram-classes",
        files,
    )
    tasks = input_tasks(texts)
    buckets = BUCKETS_PER_TASK * tasks
    known = texts.where("doc_id is not null")
    shared = (
        known.mapInArrow(
            releasing(_deal(words, percent, buckets, hot)),
            "bucket int, keys binary, classes binary, sizes binary, rests binary",
        )
        .repartitionById(buckets, F.col("bucket"))
        .mapInArrow(releasing(_repeated(percent)), "gid long, class long, fits boolean")
    )
    # A class without enough repeated tokens in its prefix is like no other: chance repeats a token or two.
    mine = Window.partitionBy("class")
    nth = F.row_number().over(mine.orderBy(~F.col("fits"), F.expr("gid & 4294967295L"), "gid"))
    shared = saved(
        shared.withColumn("repeated", F.count("*").over(mine)).withColumn("nth", nth).where("fits").drop("fits"),
        "ngram-groups",
        files,
    )
    enough = F.col("repeated") >= shared_tokens(F.col("n"), percent)
    wanted = saved(
        shared.select("class", "repeated")
        .distinct()
        .join(classes, "class")
        .where(enough)
        .select(F.col("class").alias("w_class"), "s2", "rep"),
        "ngram-wanted",
        files,
    )
    shared = shared.join(wanted.select(F.col("w_class").alias("class")).distinct(), "class", "left_semi")
    parts = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sifted = spark.sparkContext.broadcast(sieve(wanted))
    name = _bucketed(known.mapInArrow(releasing(_sources(words, sifted)), SOURCES), wanted, parts)
    return rows, classes, shared, wanted, name


def _same_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: links between the representatives of the classes in which one id stands."""
    known = rows.where("n > 0 and doc_id is not null")
    several = known.groupBy("doc_id").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).where("low < high")
    named = classes.withColumnRenamed("class", "s1")
    held = known.join(several.select("doc_id"), "doc_id").join(named, ["s1", "s2", "n"]).select("doc_id", "rep").distinct()
    first = held.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return held.join(first, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))


def link_components(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    rows, classes, shared, wanted, name = _prepared(docs, doc_id, text, words, percent)
    files = files_for(docs)
    found = saved(_same_ids(rows, classes), "ngram-same-ids", files)
    nodes = wanted.select(F.col("rep").alias("node")).union(found.select("a")).union(found.select("b")).distinct()
    comps = nodes.select("node", F.col("node").alias("comp"))
    for depth in ROUNDS:
        labelled = wanted.join(comps, F.col("rep") == F.col("node")).select("w_class", "comp")
        links = saved(_round(shared, labelled, spark.table(name), depth, words, percent), "ngram-links")
        found = found.union(links)
        reached = smallest_reachable(found)
        comps = saved(
            nodes.join(reached, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")),
            "ngram-components",
            files,
        )
    spark.sql(f"DROP TABLE {name}")
    named = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("class").alias("c_class"),
        F.col("s2").alias("c_s2"),
        F.col("n").alias("c_n"),
        F.coalesce("comp", "rep").alias("comp"),
    )
    named = saved(named, "ngram-named", files)
    same = (F.col("s1") == F.col("c_class")) & (F.col("s2") == F.col("c_s2")) & (F.col("n") == F.col("c_n"))
    return rows.join(named, same, "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"),
    )


def _class_pairs(shared, wanted, name, words, percent) -> DataFrame:
    """a, b: the classes of every similar pair, once, the smaller name first."""
    spark = shared.sparkSession
    labelled = wanted.select("w_class", F.col("w_class").alias("comp")).distinct()
    found = _round(shared, labelled, spark.table(name), None, words, percent, every=True)
    found = saved(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "ngram-pairs")
    spark.sql(f"DROP TABLE {name}")
    return found


def similar_pairs(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """a_id, b_id: every similar pair of different sets, once, each named by the smallest id that has it."""
    _, classes, shared, wanted, name = _prepared(docs, doc_id, text, words, percent)
    found = _class_pairs(shared, wanted, name, words, percent)
    one, two = (classes.select(F.col("class").alias(k), F.col("rep").alias(f"{k}_rep")) for k in "ab")
    return (
        found.join(one, "a")
        .join(two, "b")
        .select(F.least("a_rep", "b_rep").alias("a_id"), F.greatest("a_rep", "b_rep").alias("b_id"))
    )


def count_links(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_shingles and n_links of every row: how many other documents have an equal or a similar set.

    Copies are counted by the sizes of their classes. An id with several texts counts once for each.
    """
    rows, _, shared, wanted, name = _prepared(docs, doc_id, text, words, percent)
    found = _class_pairs(shared, wanted, name, words, percent)
    known = rows.where("n > 0 and doc_id is not null")
    sizes = saved(
        known.distinct().groupBy(F.col("s1").alias("class"), "s2", "n").agg(F.count("*").alias("size")), "ngram-sizes"
    )
    both = found.union(found.select("b", "a"))
    others = (
        both.join(sizes.select(F.col("class").alias("b"), "size"), "b")
        .groupBy(F.col("a").alias("class"))
        .agg(F.sum("size").alias("others"))
    )
    named = saved(
        sizes.join(others, "class", "left").select(
            F.col("class").alias("c_class"),
            F.col("s2").alias("c_s2"),
            F.col("n").alias("c_n"),
            (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"),
        ),
        "ngram-link-counts",
    )
    same = (F.col("s1") == F.col("c_class")) & (F.col("s2") == F.col("c_s2")) & (F.col("n") == F.col("c_n"))
    return rows.join(named, same, "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).alias("n_links"),
    )


def _bucketed(sources: DataFrame, wanted: DataFrame, parts: int) -> str:
    """The representatives' sources as a table bucketed by class, so that no round shuffles it; its name."""
    spark = sources.sparkSession
    path = working_folder(spark, "ngram-sources")
    name = "ngram_sources_" + path.rpartition("-")[2]
    keys = wanted.withColumnRenamed("s2", "w_s2")
    # Both sides are dealt by class alone, so only the class may be a join key; the rest is compared after.
    same = (F.col("s2").bitwiseXOR(F.col("w_s2")) == 0) & (F.col("doc_id").bitwiseXOR(F.col("rep")) == 0)
    (
        sources.repartition(parts, "class")
        .join(keys.repartition(parts, "w_class"), (F.col("class") == F.col("w_class")) & same)
        .select("class", "rep", "n", "bits", "packed")
        .dropDuplicates(["class", "rep"])
        .write.bucketBy(parts, "class")
        .option("path", path)
        .saveAsTable(name)
    )
    return name


def _round(shared, labelled, sources, depth, words, percent, every=False) -> DataFrame:
    """Links from the groups of tokens up to ``depth`` in their classes' order that join two components.

    With ``every``, all links of groups whose classes have labels of their own; a link may come more than once.
    """
    members = shared if depth is None else shared.where(F.col("nth") <= depth)
    members = members.join(labelled, F.col("class") == F.col("w_class")).select("gid", "class", "comp")
    # Groups with the same members are opened once: count and two sums of hashes name the members.
    open_groups = (
        members.groupBy("gid")
        .agg(
            F.min("comp").alias("low"),
            F.max("comp").alias("high"),
            F.count("*").alias("size"),
            F.expr("bit_xor(xxhash64(class))").alias("x"),
            F.expr("bit_xor(xxhash64(class, 1))").alias("y"),
        )
        .where("low < high")
        .groupBy("size", "x", "y")
        .agg(F.min("gid").alias("g_id"))
        .select("g_id", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("class", F.lit("block")), F.col("blocks")).cast("int")
    tasks = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.xxhash64("g_id", F.least(other, own), F.greatest(other, own)),
    )
    asked = (
        members.join(open_groups, F.col("gid") == F.col("g_id"))
        .withColumn("task", F.explode(tasks))
        .select("task", "comp", F.col("class").alias("m_class"))
    )
    hopeful_rows = saved(
        asked.join(sources.select("class", "n", "bits"), F.col("m_class") == F.col("class"))
        .select("task", "comp", "class", "n", "bits")
        .repartition("task")
        .sortWithinPartitions("task", "class")
        .mapInArrow(releasing(_hope(percent)), "task long, class long, comp long"),
        "ngram-hopeful",
    ).withColumnRenamed("class", "m_class")
    return (
        hopeful_rows.join(sources.select("class", "packed"), F.col("m_class") == F.col("class"))
        .select("task", "comp", "class", "packed")
        .repartition("task")
        .sortWithinPartitions("task", "class")
        .mapInArrow(releasing(_open(words, percent, every)), "a long, b long")
    )


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest; NULL ids stay."""
    found = link_components(docs, doc_id=doc_id, text=text)
    later = found.where("doc_id <> component_id").select(F.col("doc_id").alias("later")).distinct()
    own = F.col("own")
    return (
        docs.select(F.struct("*").alias("own"))
        .join(later, own[doc_id] == F.col("later"), "left_anti")
        .select(*[own[c].alias(c) for c in docs.columns])
    )
