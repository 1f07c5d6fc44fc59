"""The pipeline on a small corpus, each stage beside a plain version of it."""

import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import brute
import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, SCHEMA, prose, table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from farescope.llm import mixing, packing, toxicity
from farescope.llm.common import files_for, give_back, releasing
from farescope.plans.session import setting

FEW_FILES = {"shared-lines", "ngram-common", "ngram-classes", "ngram-groups", "ngram-wanted", "ngram-components", "ngram-named"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    from helpers import AWKWARD, SCHEMA, corpus

    rng = random.Random(1)
    rows = corpus(5, 120) + AWKWARD
    rows += [(7000 + i, prose(rng, 30, ["scoundrel"] * 2), "en", "a", 0) for i in range(30)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], int(r[0] >= 7000)) for r in rows]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns
        out.write.parquet(f"{folder}/{name}")
        kept[name] = before, docs = docs.collect(), spark.read.parquet(f"{folder}/{name}")
    pairs = {name: [(r["doc_id"], r["text"]) for r in df.collect()] for name, (_, df) in kept.items()}
    assert {d for d, _ in pairs["toxicity"]} == {r["doc_id"] for r in kept["toxicity"][0] if r["doc_id"] < 7000}
    want = brute.lines(pairs["toxicity"])
    assert {d: brute.sha(t) for d, t in pairs["line_dedup"]} == {d: v[2] for d, v in want.items()}
    components = brute.linked_components(pairs["line_dedup"])
    assert sorted(d for d, _ in pairs["ngram_join"]) == sorted(d for d, (_, c) in components.items() if c == d)
    source = {r["doc_id"]: r["source"] for r in kept["mixing"][0]}
    sizes = Counter()
    for d, t in pairs["ngram_join"]:
        sizes[source[d]] += len(brute.words(t))
    taken = Counter()
    for d, t in pairs["mixing"]:
        taken[source[d]] += len(brute.words(t))
    for s, target in brute.targets(sizes).items():
        assert abs(taken[s] - target) <= 0.5 + 1e-6


def test_run_packs_what_the_mix_left(spark, folder):
    mixed = [r["text"] for r in spark.read.parquet(f"{folder}/mixing").collect()]
    pieces = corpus_pipeline.run(spark, folder).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for text in mixed:
        want.update(tokenizer.encode(text or "", add_special_tokens=False).ids + [1])
    got = Counter()
    sequences = defaultdict(int)
    for p in pieces:
        got.update(np.frombuffer(p["ids"], "<u4").tolist())
        sequences[p["sequence_id"]] += p["length"]
    assert got == want
    assert all(n <= 2048 for n in sequences.values())


def test_uses_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "packing"]
    assert (mixing, toxicity, F) and corpus_pipeline.ORACLE_SQL is None


def written(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_empty_table(spark, tmp_path):
    path = written(spark, tmp_path, table(spark, [], SCHEMA))
    assert corpus_pipeline.run(spark, path).collect() == []


def test_no_labels_repeated_ids_and_clashing_names(spark, tmp_path):
    """Nothing teaches, ids and rows repeat, columns are named like the stages' own: no row or column is lost unasked."""
    rows = AWKWARD + [(1, prose(random.Random(i), 40), "en", "a", 0) for i in (1, 2)] * 2 + [(None, "w " * 12, None, None, 0)]
    path = written(spark, tmp_path, table(spark, rows))
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, path).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        assert docs.columns == columns
        seen[name] = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    assert seen["toxicity"] == sorted(((r[0], r[1]) for r in rows), key=repr)
    assert [i for i, _ in seen["line_dedup"]] == [i for i, _ in seen["toxicity"]]
    # Rows that share an id are one document to the join and stay together; so do rows without an id or words.
    stay = Counter(i for i, _ in seen["ngram_join"])
    assert (stay[1], stay[None], stay[1000], stay[1001]) == (4, 1, 1, 1)
    assert set(i for i, _ in seen["mixing"]) <= set(i for i, _ in seen["ngram_join"])
    pieces = corpus_pipeline.run(spark, path).collect()
    assert sum(p["length"] for p in pieces) == sum(
        len(Tokenizer.from_file(packing.tokenizer_path()).encode(t or "", add_special_tokens=False).ids) + 1
        for _, t in seen["mixing"]
    )


def test_few_files_however_many_partitions(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").coalesce(2)
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    files = {}
    with (
        setting(spark, "spark.sql.shuffle.partitions", "40"),
        setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"),
    ):
        for name, stage in corpus_pipeline.STAGES[1:4]:
            stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
            files[name] = len(list((tmp_path / name).glob("part-*")))
    for path in set(shared.iterdir()) - before:
        if (purpose := path.name.rpartition("-")[0]) in FEW_FILES:
            files[purpose] = max(files.get(purpose, 0), len(list(path.glob("part-*"))))
    assert FEW_FILES <= files.keys()
    assert max(files.values()) <= files_for(docs) == 4, files


def test_releasing_passes_all_batches_on():
    batches = [pa.record_batch([pa.array([i])], names=["x"]) for i in range(3)]
    assert [b.column(0).to_pylist() for b in releasing(lambda rows: rows)(iter(batches))] == [[0], [1], [2]]


def anonymous_mb():
    found = re.search(r"\nRssAnon:\s+(\d+)", Path("/proc/self/status").read_text())
    return int(found[1]) / 1024


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_freed_memory_goes_back():
    rows = [bytes(1000) for _ in range(200_000)]
    last = bytes(1000)  # above the others, so that the C library cannot shrink its heap by itself
    full = anonymous_mb()
    del rows
    give_back()
    assert full - anonymous_mb() > 100 and len(last) == 1000
