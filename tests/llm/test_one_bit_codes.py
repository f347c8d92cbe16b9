import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import one_bit_codes as A
from scriptorium.llm import vector_blocks
from scriptorium.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, id string, block string, score string"


def brute(rows, step=20, k=20):
    v = {}
    for i, e in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or [])):
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e) and any(e):
            v.setdefault(i, e)
    out = []
    for a, x in v.items():
        if a % step == 0:
            s = {}
            for i, y in v.items():
                s[i] = 0.0
                for p, q in zip(x, y):
                    s[i] += p * q
            del s[a]
            out += [(a, r, i, s[i]) for r, i in enumerate(sorted(s, key=lambda i: (-s[i], i))[:k], 1)]
    return sorted(out)


def rows_of(df, name="id"):
    return sorted((r.query_id, r["rank"], r[name], r.score) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x", "y", "z") for i, e in rows], SCHEMA)


def vectors(rng, n, dims=32, spread=1.0):
    return [(i, [float(np.float32(rng.gauss(0, spread))) for _ in range(dims)]) for i in range(n)]


def recall(got, want):
    pairs = {(q, i) for q, _, i, _ in got}
    return sum((q, i) in pairs for q, _, i, _ in want) / len(want)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    got, want = rows_of(QUERIES["op13_one_bit_ann"](spark, f"/root/testdata/{sf}"), "vec_id"), brute(rows)
    assert recall(got, want) >= 0.99
    exact = {(q, i): s for q, _, i, s in want}
    assert all(exact[q, i] == s for q, _, i, s in got if (q, i) in exact)


def test_bounds_hold_as_often_as_epsilon_says():
    rng = np.random.default_rng(1)
    v, q = rng.standard_normal((4000, 48)), rng.standard_normal((40, 48))
    for per, eps, least in ((1, 1.9, 0.93), (4, 3.0, 0.995)):
        turn = A.rotation(48, A.code_bits(48, per))
        assert np.allclose(turn @ turn.T, np.eye(48))
        est, width = A.estimates(*A.encode(v, turn), q, turn, eps)
        true = q @ v.T
        assert (np.abs(est - true) <= width).mean() >= least
        assert abs((est - true).mean()) < 0.02 * np.abs(true).mean()       # unbiased


def test_rounds_blocks_and_hot_vectors(spark, monkeypatch):
    rng = random.Random(4)
    rows = vectors(rng, 900)
    base = rows[40][1]
    rows += [(5000 + i, [x + 1e-3 * rng.gauss(0, 1) for x in base]) for i in range(300)]    # near copies of one vector
    rows += [(7000 + i, base) for i in range(60)]                                           # equal vectors: ties by id
    rows = [(i, [float(np.float32(x)) for x in e]) for i, e in rows]
    want = brute(rows)
    monkeypatch.setattr(vector_blocks, "BLOCK_ROWS", 64)        # 20 blocks in three rounds
    monkeypatch.setattr(A, "GROWTH", 3)
    monkeypatch.setattr(A, "TILE", 7)
    got = rows_of(A.search(frame(spark, rows), F.col("id") % 20 == 0))
    assert recall(got, want) >= 0.99
    hot = [x for x in want if x[0] == 40]
    assert [x for x in got if x[0] == 40] == hot and [x[2] for x in hot if x[2] >= 7000] == sorted(x[2] for x in hot if x[2] >= 7000)


def test_odd_rows(spark):
    rng = random.Random(8)
    rows = vectors(rng, 70, 4)
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [float("nan")] * 4), (103, [float("-inf")] * 4), (104, [0.0] * 4),
             (105, []), (None, rows[0][1]), (106, [0.5, 9.0]), (20, rows[21][1]), (21, rows[21][1]), (120, [2.0**-100] * 4),
             (140, [2.0**60] * 4), (160, [2.0**120] * 4)]
    pad = [(i, None if e is None else e + [0.0] * (4 - len(e))) for i, e in rows]
    assert rows_of(A.search(frame(spark, rows), F.col("id") % 20 == 0, epsilon=6.0)) == brute(pad)
    few = rows[:5]
    assert rows_of(A.search(frame(spark, few), F.col("id") % 20 == 0)) == brute(few)
    assert A.search(frame(spark, []), F.col("id") % 20 == 0).count() == 0
    assert A.search(frame(spark, few[:1]), F.col("id") % 20 == 0).count() == 0
    assert A.recall_at(A.search(frame(spark, few), F.col("id") % 20 == 0), A.search(frame(spark, few), F.col("id") % 20 == 0)) == 1.0
