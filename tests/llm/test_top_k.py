import math
import random

import numpy as np
from pyspark.sql import functions as F

from briefloom.llm import top_k as module
from briefloom.llm.top_k import SortedBlock, top_k


def brute(rows, k, asked):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, v in good:
        if asked(q):
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v)))[:k]
            out[q] = [(i, -s) for s, i in scores]
    return {q: s for q, s in out.items() if s}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_ROWS", 40)
    monkeypatch.setattr(module, "BLOCK_QUERIES", 7)
    rng = random.Random(2)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(8)]) for i in range(200)]
    rows += [(200 + i, rows[10 * i][1]) for i in range(20)] + [(300, None), (301, []), (302, [1.0, None] + [0.0] * 6), (303, [math.nan] + [0.0] * 7), (304, [math.inf] + [0.0] * 7), (None, rows[0][1]), (310, [0.5, 0.5]), (320, [1.0, -1.0]), (500, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string").repartition(3)
    got = {}
    for r in top_k(df, F.col("vec_id") % 10 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute(rows, 5, lambda i: i % 10 == 0)


def test_block_stops_early_and_is_exact():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-60, 60, (3000, 16))
    vectors[::50] = vectors[0] + rng.integers(-3, 3, (60, 16))
    block = SortedBlock(np.arange(3000), vectors)
    depths = []
    plain = block.bounds
    block.bounds = lambda up, down, depth: depths.append(depth) or plain(up, down, depth)
    queries = vectors[:100:50]
    for q, ids, scores in block.best(np.array([0, 50]), queries, 5):
        exact = vectors @ vectors[q]
        exact[q] = -(10**9)
        want = np.lexsort((np.arange(3000), -exact))[:5]
        assert ids.tolist() == want.tolist() and scores.tolist() == exact[want].tolist()
    assert max(depths) < 3000


def test_empty_and_single(spark):
    schema = "vec_id long, embedding array<float>"
    assert top_k(spark.createDataFrame([], schema), F.lit(True), 5).count() == 0
    assert top_k(spark.createDataFrame([(0, [1.0])], schema), F.lit(True), 5).count() == 0
    twice = top_k(spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])], schema), F.col("vec_id") == 0, 5)
    assert [(r["rank"], r["vec_id"], r["score"]) for r in twice.orderBy("rank").collect()] == [(1, 1, 131072), (2, 1, 131072)]
