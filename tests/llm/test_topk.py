import random

import brute
import numpy as np
from helpers import CLASHING
from pyspark.sql import functions as F

from farescope.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=300, dim=8, seed=1):
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1))) for _ in range(dim)], 0) for i in range(n)]
    for i in range(20, min(60, n)):  # ties
        rows[i] = (i, rows[7][1], 0)
    rows += [(1000, None, 0), (1100, [], 0), (1200, [None] + [0.5] * 7, 0), (1300, [float("nan")] * 8, 0),
             (1400, [float("inf")] * 8, 0), (1500, [0.25] * 5, 0), (1600, [0.5] * 5, 0), (None, [0.5] * 8, 0)]
    return rows


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in (*CLASHING, "query", "vector", "is_query"):
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(3)


def found(df):
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in df.collect()}


def test_equals_brute_force(spark):
    rows = vectors()
    got = found(topk.top_k(table(spark, rows), F.col("vec_id") % 20 == 0, query_block=7, bins=16))
    assert got == brute.top([r[:2] for r in rows], lambda i: i % 20 == 0)


def test_fewer_than_k(spark):
    rows = vectors(4)
    got = found(topk.top_k(table(spark, rows), F.col("vec_id") % 2 == 0))
    assert got == brute.top([r[:2] for r in rows], lambda i: i % 2 == 0)


def test_large_components_stay_exact(spark):
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1) * 2**17)) for _ in range(6)], 0) for i in range(40)]
    got = found(topk.top_k(table(spark, rows), F.col("vec_id") == 0))
    assert got == brute.top([r[:2] for r in rows], lambda i: i == 0)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (1, [0.5, 1.0], 0), (2, [0.25, 0.0], 0)]
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(table(spark, rows), F.col("vec_id") == 0).collect())
    assert got == [(1, 1, 1 << 20), (2, 1, 1 << 19), (3, 2, 1 << 18)]


def test_no_query_and_empty(spark):
    assert topk.top_k(table(spark, vectors(5)), F.lit(False)).collect() == []
    assert topk.top_k(table(spark, []), F.lit(True)).collect() == []
