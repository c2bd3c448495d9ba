import math
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.topk import best, products, search

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType()), T.StructField("shard", T.StringType())])


def brute(rows, every, k):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        found = sorted((-min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(v, w)))), i) for v in {tuple(x) for j, x in ok if j == q} for i, w in ok if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return out


def run(spark, rows, every=5, k=5, **sizes):
    got = search(spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA), F.col("vec_id") % every == 0, k, **sizes).collect()
    return sorted(map(tuple, got))


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.011, -1e-4, 0.0]) for _ in range(4)]) for i in range(-40, 160)]
    rows += [(500 + i, [0.25] * 4) for i in range(120)]
    rows += [(1000, None), (None, [1.0] * 4), (1005, [1.0, None, 1.0, 1.0]), (1010, [float("nan")] * 4), (1015, [float("inf")] * 4), (1020, [0.5] * 3), (1025, [0.5] * 3), (1030, []), (1035, []), (10, [0.5] * 4)]
    want = brute(rows, 5, 5)
    assert run(spark, rows) == want
    assert run(spark, rows, shard_rows=7, block_queries=9) == want


def test_small_and_large_values(spark):
    assert run(spark, []) == [] and run(spark, [(0, [1.0])]) == []
    rows = [(i, [(-1.0) ** i * 10.0 ** (i % 30), 3.0 * i]) for i in range(40)]
    assert run(spark, rows, 10) == brute(rows, 10, 5)


def test_pieces():
    rng = np.random.default_rng(0)
    a = rng.integers(-(2**40), 2**40, (3, 5)).astype(float)
    assert products(a, a).tolist() == [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in a] for p in a]
    for n in (0, 1, 5, 30, 1000):
        scores, ids, names = rng.integers(0, 4, (7, n)), np.sort(rng.integers(0, 2 * n + 1, n)), rng.integers(0, 2 * n + 1, 7)
        want = [(r, c) for r in range(7) for c in sorted((c for c in range(n) if ids[c] != names[r]), key=lambda c: (-scores[r, c], ids[c], c))[:5]]
        assert list(zip(*(x.tolist() for x in best(scores.copy(), ids, names, 5)))) == want


def test_repeated_queries_and_sums_beyond_53_bits(spark):
    """A query row that is there twice asks once; scores that differ only beyond double precision are told apart."""
    rows = [(50, [1.0, 2.0**-8]), (50, [1.0, 2.0**-8]), *[(i, [0.25 * i, 0.0]) for i in range(1, 9)]]
    assert [r[2] for r in run(spark, rows, 50)] == [8, 7, 6, 5, 4]
    assert run(spark, rows, 50) == brute(rows, 50, 5)
    big = [(50, [2.0**22, 2.0**-8]), (1, [0.0, 3 * 2.0**-8]), (3, [2.0**22, 2.0**-8]), (5, [2.0**22, 0.0]), (7, [2.0**22, 2.0**-7])]
    assert [r[2] for r in run(spark, big, 50)] == [7, 3, 5, 1]
    assert run(spark, big, 50) == brute(big, 50, 5)
