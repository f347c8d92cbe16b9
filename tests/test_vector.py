"""Semantic search: embed job batches and failures, exact top-k, batch
top-k == single top-k, chunked broadcast == unchunked."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import vector as VV


def pending(spark, n):
    return spark.createDataFrame([(i, f"{i:06d}", f"T{i}", None if i % 2 else f"A{i}") for i in range(1, n + 1)],
                                 "paper_id long, archive_id string, paper_title string, abstract string")


def const_embedder(fail_batches=()):
    calls = []

    def embed(texts):
        if texts and texts[0] in fail_batches:
            raise RuntimeError("model down")
        return [[1.0, 0.0]] * len(texts)
    return embed


def summary(spark, pend, embed):
    res = VV.embed_pending(pend, embed)
    ok = res.filter(F.col("error").isNull()).select("paper_id")
    after = pend.join(ok, "paper_id", "left_anti")
    return res, VV.embed_summary(res, after).first()


def test_nothing_pending(spark):
    _, s = summary(spark, pending(spark, 0), const_embedder())
    assert (s.embedded, s.remaining) == (0, 0)


def test_two_pending(spark):
    _, s = summary(spark, pending(spark, 2), const_embedder())
    assert (s.embedded, s.remaining, s.errors) == (2, 0, [])


def test_first_batch_fails(spark):
    # 150 pending, batch 0 (ids 1..100) fails: 50 embedded, 100 remaining
    res, s = summary(spark, pending(spark, 150), const_embedder(fail_batches=("T1. ",)))
    assert (s.embedded, s.remaining) == (50, 100)
    assert len(s.errors) == 1 and s.errors[0].startswith("Batch 0:")
    assert sorted(r.paper_id for r in res.filter("error IS NULL").collect()) == list(range(101, 151))


def test_limit_and_texts(spark):
    assert VV.embed_pending(pending(spark, 620), const_embedder()).count() == 620
    res = VV.embed_pending(pending(spark, 620), const_embedder(), limit=500)
    assert res.count() == 500
    assert [r["count"] for r in res.groupBy("batch").count().orderBy("batch").collect()] == [100] * 5
    t = VV.embedding_texts(pending(spark, 2)).orderBy("paper_id").collect()
    assert [r.text for r in t] == ["T1. ", "T2. A2"]


def _corpus(spark, n=300, d=16, seed=3):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d))
    return m, spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(n)], "id long, vec array<double>")


def _brute(m, q, k):
    mn = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = mn @ (q / np.linalg.norm(q))
    order = np.lexsort((np.arange(len(s)), -s))[:k]
    return [(int(i), float(s[i])) for i in order]


def test_topk_matches_brute_force(spark):
    m, df = _corpus(spark)
    got = [(r.id, r.score) for r in VV.vector_topk(df, m[7], 10).collect()]
    exp = _brute(m, m[7], 10)
    assert [g[0] for g in got] == [e[0] for e in exp]
    assert all(abs(g[1] - e[1]) < 1e-9 for g, e in zip(got, exp))
    assert VV.vector_topk(df, m[0], 200).count() == 200
    assert VV.clamp_k("0") == 1 and VV.clamp_k(None) == 10 and VV.clamp_k(200) == 50      # requests only
    assert VV.clamp_k("7abc") == 7 and VV.clamp_k("abc") == 10 and VV.clamp_k("-3") == 1


@pytest.mark.parametrize("budget", [VV.BROADCAST_BUDGET, 16 * 8 * 3])
def test_batch_topk_equals_single(spark, budget):
    m, df = _corpus(spark)
    qs = spark.createDataFrame([(q, [float(x) for x in m[q]]) for q in (3, 50, 77, 120, 299)],
                               "qid long, vec array<double>")
    out = VV.vector_topk_batch(df.repartition(4), qs, 5, budget_bytes=budget).collect()
    for q in (3, 50, 77, 120, 299):
        got = sorted(((r.rank, r.id) for r in out if r.qid == q))
        assert [i for _, i in got] == [e[0] for e in _brute(m, m[q], 5)]


def test_zero_and_null_vectors_alike_in_both_forms(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [-1.0, 0.0])], "id long, vec array<double>")
    qs = spark.createDataFrame([(9, [2.0, 0.0]), (10, [0.0, 0.0]), (11, None)], "qid long, vec array<double>")
    one = [(r.id, r.score) for r in VV.vector_topk(df, [2.0, 0.0], 10).collect()]
    zero = [(r.id, r.score) for r in VV.vector_topk(df, [0.0, 0.0], 10).collect()]
    assert one == [(1, 1.0), (2, 0.0), (4, -1.0)] and zero == [(1, 0.0), (2, 0.0), (4, 0.0)]
    both = VV.vector_topk_batch(df, qs, 10).orderBy("qid", "rank").collect()
    assert [(r.id, r.score) for r in both if r.qid == 9] == one
    assert [(r.id, r.score) for r in both if r.qid == 10] == zero
    assert all(r.qid != 11 for r in both)


def test_tiles_and_ties_keep_the_smallest_ids(spark, monkeypatch):
    monkeypatch.setattr(VV, "TILE_CELLS", 7)
    qids, q = np.array([1, 2]), np.eye(2)
    import pandas as pd
    rows = pd.DataFrame({"id": np.arange(40)[::-1], "vec": [[1.0, 0.0]] * 30 + [[0.0, 1.0]] * 10})
    (out,) = VV._topk_block(qids, q, 4, None)([rows.iloc[:13], rows.iloc[13:]])
    got = {k: sorted(g["id"][g["score"] == 1.0]) for k, g in out.groupby("qid")}
    assert got == {1: [10, 11, 12, 13], 2: [0, 1, 2, 3]}


def test_upsert_vectors_and_semantic_search(spark):
    idx = spark.createDataFrame(
        [("000001", [1.0, 0.0], ("000001", "old", 1)), ("000002", [0.0, 1.0], ("000002", "two", 2))],
        "id string, vec array<double>, metadata struct<archive_id:string,title:string,paper_id:long>")
    new = spark.createDataFrame([("000001", [0.0, 1.0], ("000001", "new", 1))], idx.schema)
    idx2 = VV.upsert_vectors(idx, new)
    assert {r.id: r.metadata.title for r in idx2.collect()} == {"000001": "new", "000002": "two"}
    details = spark.createDataFrame([("000002", "Paper Two")], "archive_id string, paper_title string")
    hits = VV.semantic_search(idx2, [0.0, 1.0], details, 10).collect()
    assert [h.archive_id for h in hits] == ["000001", "000002"]
    assert hits[0].paper_title is None and hits[1].paper_title == "Paper Two"


def test_embed_job_marks_exactly_embedded(spark):
    import datetime as dt
    now = dt.datetime(2026, 1, 1)
    papers = spark.createDataFrame(
        [(10, "000010", "T10", None, None), (20, "000020", "T20", "A", None), (30, "000030", "T30", "B", now)],
        "paper_id long, archive_id string, paper_title string, abstract string, embedded_at timestamp_ntz")
    index = spark.createDataFrame([], "id string, vec array<float>, "
                                      "metadata struct<archive_id:string,title:string,paper_id:long>")
    emb = VV.hash_embedder(8)
    idx2, papers2, summ, _ = VV.embed_job(papers.filter("embedded_at IS NULL").unionByName(
        papers.filter("embedded_at IS NOT NULL")), index, emb, now)
    assert sorted(r.id for r in idx2.collect()) == ["000010", "000020"]
    marked = {r.paper_id: r.embedded_at for r in papers2.collect()}
    assert marked == {10: now, 20: now, 30: now}
    s = summ.first()
    assert (s.embedded, s.remaining) == (2, 0)
