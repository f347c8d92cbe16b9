"""Change feed against set differences; dated versions; vector cells."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from scriptorium.operators import cells as VC
from scriptorium.operators import changes as C
from scriptorium.operators import search as S
from scriptorium.operators import vector as V
from scriptorium.operators import versions as W

from .test_search import seed


def feed(df, key):
    return sorted(((r.change, *[r[k] for k in key], tuple(r.old) if r.old else None, tuple(r.new) if r.new else None) for r in df.collect()), key=str)


def test_table_changes(spark):
    kind = "id long, k string, x int"
    old = [(1, "a", 1), (2, "a", 2), (3, None, None), (4, "d", 4), (None, "n", 1), (6, "r", 1), (6, "r", 1), (7, "t", 1), (7, "t", 2)]
    new = [(1, "a", 1), (2, "a", None), (3, None, 3), (5, "e", 5), (None, "n", 2), (6, "r", 1), (7, "t", 2), (7, "t", 1)]
    a, b = spark.createDataFrame(old, kind), spark.createDataFrame(new, kind)
    got = feed(C.table_changes(a, b, ["id"]), ["id"])
    assert got == sorted([("update", 2, (2, "a", 2), (2, "a", None)), ("update", 3, (3, None, None), (3, None, 3)),
                          ("delete", 4, (4, "d", 4), None), ("insert", 5, None, (5, "e", 5)), ("update", None, (None, "n", 1), (None, "n", 2)),
                          ("update", 6, (6, "r", 1), (6, "r", 1))], key=str)       # one of two equal rows went
    assert [r[1] for r in feed(C.table_changes(a, b, ["id"], ["id", "k"]), ["id"])] == [4, 5, 6]
    assert C.table_changes(a, a, ["id"]).count() == 0 and C.table_changes(a.limit(0), a.limit(0), ["id"]).count() == 0
    assert C.table_changes(a.limit(0), b, ["id"]).filter("change <> 'insert'").count() == 0


def test_feed_drives_the_index(spark, tmp_root):
    names = list(C.KEYS)
    before = seed(spark, extra_papers=[(3, "000003", "Gone soon", "x"), (4, "000004", "Stays", "y")], extra_kwl=[(2, 3), (3, 4)], extra_aul=[(2, 4, 1)])
    p, a, k, al, kl = before
    after = (p.filter("paper_id <> 3").withColumn("paper_title", F.when(F.col("paper_id") == 1, "New title").otherwise(F.col("paper_title"))),
             a.withColumn("last_name", F.when(F.col("author_id") == 2, "Moved").otherwise(F.col("last_name"))),
             k.withColumn("keyword", F.when(F.col("keyword_id") == 3, "lake").otherwise(F.col("keyword"))),
             al.unionByName(spark.createDataFrame([(1, 2, 2)], al.schema)), kl.filter("not (keyword_id = 2 and paper_id = 1)"))
    as_dict = lambda t: dict(zip(("papers", "authors", "keywords", "author_links", "keyword_links"), t))
    f = C.write_feed(C.change_feed(as_dict(before), as_dict(after)), f"{tmp_root}/feed")
    assert sorted((r.relation, r.change, r.id, r.paper_id) for r in C.flat_feed(f).collect() if r.paper_id is None) == [
        ("authors", "update", 2, None), ("keywords", "update", 3, None), ("papers", "delete", 3, None), ("papers", "update", 1, None)]
    assert sorted((r.relation, r.change, r.id, r.paper_id) for r in C.flat_feed(f).collect() if r.paper_id) == [
        ("author_links", "insert", 1, 2), ("keyword_links", "delete", 2, 1)]
    old = S.build_search_docs(*before)
    got = S.refresh_search_docs(old, C.change_set(f), *after)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.build_search_docs(*after).collect()))
    assert names[0] == "papers"


def t(day):
    return dt.datetime(2024, 1, day)


def test_versions(spark):
    kind = "id long, a string, b int"
    obs = [[(1, "x", 1), (2, "y", 2), (3, None, 3), (None, "n", 0)], [(1, "x", 1), (2, "y", None), (3, "z", 3), (4, "new", 4)], [(2, "y", 2), (4, "new", 4)]]
    frames = [spark.createDataFrame(o, kind) for o in obs]
    h = W.first_versions(frames[0], "id", ["a", "b"], t(1))
    for i, f in enumerate(frames[1:], 2):
        h = W.refresh_versions(h, f, "id", ["a", "b"], t(i))
    rows = sorted(map(tuple, h.collect()), key=str)
    assert rows == sorted([(1, "x", 1, t(1), t(3)), (2, "y", 2, t(1), t(2)), (2, "y", None, t(2), t(3)), (2, "y", 2, t(3), None),
                           (3, None, 3, t(1), t(2)), (3, "z", 3, t(2), t(3)), (4, "new", 4, t(2), None)], key=str)
    again = W.refresh_versions(h, frames[2], "id", ["a", "b"], t(9))
    assert sorted(map(tuple, again.collect()), key=str) == rows                     # the same observation changes nothing
    for i, o in enumerate(obs, 1):
        assert sorted(map(tuple, W.as_of(h, t(i)).collect()), key=str) == sorted((r for r in o if r[0] is not None), key=str)
    kept = W.refresh_versions(W.first_versions(frames[0], "id", ["a", "b"], t(1)), frames[2], "id", ["a", "b"], t(2), gone=False)
    assert {r.id for r in W.as_of(kept, t(5)).collect()} == {1, 2, 3, 4}
    got = sorted(map(tuple, W.field_changes(frames[0], frames[1], "id", ["a", "b"]).collect()), key=str)
    assert got == [(2, "b", "2", None), (3, "a", None, "z")]
    assert W.refresh_versions(h.limit(0), frames[0].limit(0), "id", ["a", "b"], t(2)).count() == 0


def exact(vectors, queries, k):
    out = {}
    for q, v in queries:
        cos = {i: (float(np.dot(v, x) / (np.linalg.norm(v) * np.linalg.norm(x))) if any(x) and any(v) else 0.0) for i, x in vectors}
        out[q] = [(i, round(cos[i], 6)) for i in sorted(cos, key=lambda i: (-round(cos[i], 6), i))[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.id, round(r.score, 6)))
    return out


def test_cells_recall_pruning_and_exact_search(spark, tmp_root):
    rng = np.random.default_rng(3)
    hubs = rng.standard_normal((30, 24))
    vectors = [(i, (hubs[i % 30] + 0.35 * rng.standard_normal(24)).tolist()) for i in range(1500)]
    vectors += [(2000 + i, hubs[0].tolist()) for i in range(400)]           # a hot cell of equal vectors
    vectors += [(3000, [0.0] * 24)]
    queries = [(q, (hubs[q % 30] + 0.35 * rng.standard_normal(24)).tolist()) for q in range(40)] + [(99, [0.0] * 24)]
    vf = spark.createDataFrame([*vectors, (4000, None)], "id long, vec array<double>").repartition(3)
    qf = spark.createDataFrame([*queries, (98, None)], "qid long, vec array<double>")
    index = VC.build_cells(vf, f"{tmp_root}/cells", cells=40)
    assert index.rows.count() == len(vectors) and len(index.centres) == 40
    want = exact(vectors, queries, 10)
    batch = found(V.vector_topk_batch(vf, qf, 10, round_digits=6))
    near = found(VC.search_cells(index, qf, 10, probes=6, round_digits=6))
    hit = sum(i in {x for x, _ in near[q]} for q in batch for i, _ in batch[q] if q != 99)
    assert hit / sum(len(batch[q]) for q in batch if q != 99) >= 0.95
    assert found(VC.search_cells(index, qf, 10, probes=2, exact=True, round_digits=6)) == want == batch
    small = found(VC.search_cells(index, qf, 10, probes=2, exact=True, round_digits=6, budget_bytes=8000))
    assert small == want                    # queries in several blocks
    few = VC.search_cells(index, qf.filter("qid = 5"), 10, probes=3)
    plan = few._jdf.queryExecution().toString()
    cells = plan[plan.index("PartitionFilters: ["):].split("]")[0]
    assert "cell" in cells and cells.count(",") <= 4        # three cells and that of zero vectors


def test_cells_of_odd_tables(spark, tmp_root):
    kind = "id long, vec array<double>"
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vec array<double>")
    empty = VC.build_cells(spark.createDataFrame([], kind), f"{tmp_root}/none")
    assert VC.search_cells(empty, q, 3).count() == 0
    one = VC.build_cells(spark.createDataFrame([(7, [0.0, 0.0]), (8, None), (9, [2.0, 0.0])], kind), f"{tmp_root}/one")
    assert found(VC.search_cells(one, q, 3)) == {1: [(9, 1.0), (7, 0.0)]}
    assert VC.search_cells(one, q.limit(0), 3).count() == 0
    assert math.isclose(float(one.reach[0]), 1.0)


def test_cells_hold_bounded_scores():
    """A task keeps the best rows of each query, never all pairs of its queries and rows; ties and NaN as in a full sort."""
    import tracemalloc
    import pyarrow as pa
    rng = np.random.default_rng(3)
    n, q, d, k = 4096, 1500, 8, 5
    vecs = np.round(rng.normal(size=(n, d)), 1)
    vecs[:300] = vecs[0]
    units = VC._unit(np.round(rng.normal(size=(q, d)), 1))
    ids = rng.permutation(n)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(vecs.tolist()), pa.array(np.zeros(n, np.int32))], names=["id", "vec", "cell"])
    run = VC._best(list(range(q)), units, {0: np.arange(q)}, k, 3)
    tracemalloc.start()
    (out,) = run(iter([batch.slice(0, 1000), batch.slice(1000)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    score = np.round(units @ VC._unit(vecs).T, 3)
    want = {(i, ids[j], score[i, j]) for i in range(q) for j in np.lexsort((ids, -score[i]))[:k]}
    assert {(r["qid"], r["id"], r["score"]) for r in out.to_pylist()} == want
    assert VC._bound(np.array([[np.nan, 3.0, 1.0, 2.0]]), np.array([-np.inf]), 2).tolist() == [2.0]


def test_feed_refresh_works_out_both_states_once(spark, tmp_root, monkeypatch):
    from scriptorium.operators import search as S
    from scriptorium.plans import q_segments as QG

    def state(titles, author, links):
        return (spark.createDataFrame([(i, str(i), t, None) for i, t in titles.items()], "paper_id long, archive_id string, paper_title string, abstract string"),
                spark.createDataFrame([(7, author, "B", "u", None, None)], "author_id long, first_name string, last_name string, username string, email string, affiliation string"),
                spark.createDataFrame([(1, "red")], "keyword_id long, keyword string"),
                spark.createDataFrame([(7, p, 1) for p in links], "author_id long, paper_id long, author_position int"),
                spark.createDataFrame([(1, p) for p in links], "keyword_id long, paper_id long"))
    calls = []

    def both(sp, d):
        calls.append(d)
        return state({1: "one", 2: "two", 3: "gone"}, "A", [1, 3]), state({1: "one", 2: "two"}, "Z", [1, 2])
    monkeypatch.setattr(QG, "_both_states", both)
    monkeypatch.setattr(QG, "_stored", lambda sp, d, tag, make: make(f"{tmp_root}/{tag}"))
    monkeypatch.setattr(QG, "stored_docs", lambda sp, d, tag, build: build())
    rows = {tuple(r) for r in QG.q_feed_refresh(spark, "nowhere").collect()}
    assert len(calls) == 1
    assert rows == {tuple(r) for r in S.build_search_docs(*both(spark, "")[1]).collect()}
    assert rows == {(1, "1", "one", "", "red", "Z B"), (2, "2", "two", "", "red", "Z B")}


def test_changed_keys_are_found_from_plain_hashes(spark):
    """Rows go to their key's task as two longs, not as two decimals; rows that differ in one of many copies are still found."""
    from scriptorium.operators import changes as C
    old = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "id long, x string")
    new = spark.createDataFrame([(1, "a"), (1, "A"), (2, "b"), (None, "d"), (3, "e")], "id long, x string")
    assert dict(C._side(old, ["id"], ["x"], -1).dtypes)["h1"] == "bigint"
    found = {(r.change, r.id) for r in C.table_changes(old, new, ["id"]).collect()}
    assert found == {("update", 1), ("update", None), ("insert", 3)}
