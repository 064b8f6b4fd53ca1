import math
import random

import pytest
from pyspark.sql import functions as F

from faqloom.llm import topk


def plain(rows, k, every):
    sound = [(n, i, [math.floor(64 * x) for x in v]) for n, (i, v) in enumerate(rows)
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, q, qv in sound:
        if q % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(qv, cv)), c, m) for m, c, cv in sound if m != n)
        out += [(q, r + 1, c, -s) for r, (s, c, _) in enumerate(scores[:k])]
    return sorted(out)


def table(n=700, width=16, seed=1):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 1) * (1 + i % 5) for _ in range(width)]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(60)]  # many ties
    rows += [(5000, None), (5020, [1.0, None]), (5040, [float("nan")] * width), (5060, [float("inf")] * width), (None, [1.0] * width),
             (5080, []), (5100, [2.0] * (width // 2)), (40, rows[3][1]), (5120, [0.0] * width)]
    return rows


@pytest.mark.parametrize("chunk,block,parts", [(1024, 32768, 3), (16, 64, 5)])
def test_against_all_pairs(spark, monkeypatch, chunk, block, parts):
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "HEAD", 4 * chunk)
    monkeypatch.setattr(topk, "SLICE", 20)
    rows = table()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("x")).withColumn("row", F.lit(1))
    got = topk.top_k(df.repartition(parts), F.col("vec_id") % 20 == 0, k=20, scale=64.0).collect()
    assert sorted(tuple(g) for g in got) == plain(rows, 20, 20)


def test_few_rows_and_large_numbers(spark):
    rows = [(0, [1e15, -3e15]), (20, [2e15, 1.0]), (1, [-5.0, 7e14])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(tuple(g) for g in topk.top_k(df, F.col("vec_id") % 20 == 0).collect())
    want = [(q, r, c, max(-(2**63), min(2**63 - 1, s))) for q, r, c, s in plain(rows, 20, 20)]
    assert [(q, s) for q, _, _, s in got] == [(q, s) for q, _, _, s in want]
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.top_k(none, F.col("vec_id") % 20 == 0).count() == 0


def test_wide_vectors_are_rotated_too(spark, monkeypatch):
    """More components than the matrix of products may have: leading axes by a random matrix, same result."""
    monkeypatch.setattr(topk, "AXES_CELLS", 300)
    monkeypatch.setattr(topk, "PIECE", 70)
    monkeypatch.setattr(topk, "CELLS", 2000)
    rows = table(n=300, width=40)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    vectors = topk.whole_vectors(df, 64.0, "vec_id", "embedding")
    turn = topk.axes(vectors, 40)
    assert turn.shape == (40, 8) and abs(turn.T @ turn - topk.np.eye(8)).max() < 1e-9
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=20).collect()
    assert sorted(tuple(g) for g in got) == plain(rows, 20, 20)
