import hashlib
import random
import re

import numpy as np
from helpers import AWKWARD, corpus, many, table
from pyspark.sql import functions as F

from farescope.llm import fill_middle
from farescope.llm.wavelet import WaveletMatrix


def plain_version(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    if doc_id is None:
        return n, "plain", None, None, text
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 65, 500):
        symbols = rng.integers(0, 8, n).astype(np.uint8)
        matrix = WaveletMatrix(symbols, 3)
        at = np.arange(n + 1)
        for c in range(8):
            assert matrix.rank(c, at).tolist() == np.concatenate(([0], np.cumsum(symbols == c))).tolist()


def test_equals_plain_version(spark):
    rng = random.Random(6)
    odd = ["".join(rng.choice("ab Z1é\n𝒳-<P>SM") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = corpus() + AWKWARD + [(2000 + i, t, None, None, 0) for i, t in enumerate(odd)]
    rows += [(None, "no id at all", None, None, 0), (2000, odd[0], None, None, 0), (2000, odd[0], None, None, 0)]
    rows += [(3000 + i, t, None, None, 0) for i, t in enumerate(("<P", "<", "a<P>b", "x<S", "<M><", "<P<P>", "S>", "x <"))]
    rows += [(4000 + i, "word, " * 60_000 + "é" * 70_000, None, None, 0) for i in range(3)]  # very long
    got = fill_middle.transform(table(spark, rows))
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert got.columns == columns
    want = sorted(((r[0], *plain_version(r[0], r[1])) for r in rows), key=repr)
    assert many(got, *columns) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    back = got.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("t"))
    assert many(back, "doc_id", "t") == sorted(((r[0], r[1] or "") for r in rows), key=repr)


def test_empty_table_and_other_columns(spark):
    assert fill_middle.transform(table(spark, [])).count() == 0
    named = spark.createDataFrame([(7, "one two")], "n long, form string")
    got = fill_middle.transform(named, doc_id="n", text="form", kept_percent=0, spm_percent=100).first()
    assert (got.doc_id, got.n, got.form) == (7, 3, "spm")
