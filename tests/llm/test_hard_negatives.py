import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import hard_negatives as H
from scriptorium.llm import vector_blocks
from scriptorium.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, score string, block string, vec string"


def brute(rows, step=50, k=5, m=3):
    v = {}
    for i, e, label, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2] is None, r[2] or 0, r[1] or [])):
        if i is None or e is None or label is None or not all(x is not None and math.isfinite(x) for x in e):
            continue
        v.setdefault(i, (label, [math.floor(256 * x) for x in e]))
    out = []
    for a, (label, x) in v.items():
        if a % step:
            continue
        s = {i: sum(p * q for p, q in zip(x, y)) for i, (_, y) in v.items() if i != a}
        for p in sorted((i for i in s if v[i][0] == label), key=lambda i: (-s[i], i))[:k]:
            ok = [i for i in s if v[i][0] != label and 50 * s[p] <= 100 * s[i] <= 95 * s[p]]
            out += [(a, p, r, i, s[p], s[i]) for r, i in enumerate(sorted(ok, key=lambda i: (-s[i], i))[:m], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, e, c, "s", "b", "v") for i, e, c in rows], SCHEMA)


def vectors(rng, n, dims=24, labels=3):
    return [(i, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert rows_of(QUERIES["op12_hard_negatives"](spark, "/root/testdata/sf0.001")) == brute(rows)


@pytest.mark.parametrize("size", [3, 300, 10**6, 2**26])
def test_products_are_exact(size):
    rng = np.random.default_rng(size)
    a = rng.integers(-size, size + 1, (7, 150)).astype(np.float64)
    b = rng.integers(-size, size + 1, (9, 150)).astype(np.float64)
    a[0], b[0], b[1] = size, size, -size
    bound = int(max((a * a).sum(1).max(), (b * b).sum(1).max()))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert H.rns_product(a, b, H.primes_for(bound)).tolist() == want


def test_primes():
    p = H.primes_for(10**9)
    assert math.prod(p) > 2 * 10**9 + 1 and len(set(p)) == len(p) and all(all(x % k for k in range(2, x)) for x in p)
    assert H.SLAB * ((H.TOP_PRIME - 1) // 2) ** 2 < 2**24 and len(H.primes_for(1)) == 2


def test_blocks_and_ties(spark, monkeypatch):
    rng = random.Random(5)
    rows = vectors(rng, 260)
    rows += [(1000 + i, rows[3][1], i % 2) for i in range(40)]         # equal vectors: ties by id
    rows += [(2000 + i, rows[50][1], 0) for i in range(30)]            # one hot label beside an anchor
    want = brute(rows, 10)
    run = lambda: rows_of(H.mine(frame(spark, rows), F.col("id") % 10 == 0, F.col("label")))
    assert run() == want and len(want) > 100
    monkeypatch.setattr(vector_blocks, "BLOCK_ROWS", 64)
    monkeypatch.setattr(H, "TILE", 3)
    assert run() == want


def test_odd_rows(spark):
    rng = random.Random(6)
    rows = vectors(rng, 60, 5, 2)
    odd = [(100, None, 1), (101, [1.0, None, 0.0, 0.0, 0.0], 1), (102, [float("nan")] * 5, 0), (103, [float("inf")] * 5, 0),
           (104, rows[0][1], None), (None, rows[0][1], 0), (105, [], 1), (106, [0.0] * 5, 0), (107, [0.5, 0.25], 1),
           (10, rows[10][1], 5), (10, rows[11][1], 5), (11, rows[11][1], rows[11][2])]
    rows += odd
    pad = [(i, None if e is None else e + [0.0] * (5 - len(e)), c) for i, e, c in rows]
    assert rows_of(H.mine(frame(spark, rows), F.col("id") % 10 == 0, F.col("label"))) == brute(pad, 10)
    assert H.mine(frame(spark, []), F.col("id") % 10 == 0, F.col("label")).count() == 0
    assert H.mine(frame(spark, rows), F.lit(False), F.col("label")).count() == 0
    with pytest.raises(ArithmeticError):
        H.mine(frame(spark, [(0, [1e12], 0)]), F.col("id") % 10 == 0, F.col("label"))
