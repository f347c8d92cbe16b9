"""Conflict checks on bucketed key tables: same rows, and the held side is not shuffled."""

import uuid

import pytest

from scriptorium.operators import held_keys as K
from scriptorium.operators import mutate as M
from scriptorium.plans import q_jobs as QJ
from scriptorium.plans import q_mutate as QM
from scriptorium.sources import html as H
from scriptorium.streaming import sync_stream as ST

from .conftest import SF_SMALL


@pytest.fixture()
def table(spark):
    made = [f"keys_{uuid.uuid4().hex[:10]}" for _ in range(2)]
    yield made
    for t in made:
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_runs_count_once_committed(spark, table):
    t, small = table
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "k string")
    K.add_keys(df("a", "b", None), t, ["k"], 8)
    K.add_keys(df("c"), t, ["k"], 8, "stopped")
    K.add_keys(df("d"), t, ["k"], 8, "done")
    K.add_keys(df("d"), t, ["k"], 8, "done")                 # a replay
    assert sorted(r.k for r in K.held(spark, t, ["k"], ["base", "done"]).distinct().collect()) == ["a", "b", "d"]
    assert K.held(spark, t, ["k"], []).count() == 0
    K.compact(spark, t, small, ["k"], 8, ["base", "done"])
    assert sorted(r.k for r in K.held(spark, small, ["k"]).collect()) == ["a", "b", "d"]
    new = M.insert_ignore(df("z"), df("a", "c", "d", None, "c"), "k", known=K.held(spark, t, ["k"], ["base", "done"]))
    assert [r.k for r in new.collect()] == ["c"]


def _nodes(spark, df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


@pytest.mark.parametrize("how", ["left_anti", "left_semi"])
def test_the_held_side_is_not_shuffled(spark, table, how):
    t, _ = table
    key = ["author_id", "paper_id"]
    K.add_keys(spark.range(20_000).selectExpr("id % 100 AS author_id", "id AS paper_id"), t, key, 16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = spark.range(500).selectExpr("id % 100 AS author_id", "id * 50 AS paper_id")
        held = _nodes(spark, batch.join(K.held(spark, t, key), key, how))
        plain = _nodes(spark, batch.join(spark.range(20_000).selectExpr("id % 100 AS author_id", "id AS paper_id"), key, how))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("Exchange" in x for x in held) == 1 and sum("Exchange" in x for x in plain) == 2
    scan = next(i for i, x in enumerate(held) if "Scan parquet" in x and t in x)
    assert "Bucketed: true" in held[scan] and not any("Exchange" in x for x in held[scan - 4:scan])


def test_queries_leave_no_table(spark):
    before = {r.tableName for r in spark.sql("SHOW TABLES").collect()}
    for a, b in ((QM.q_insert_papers, QM.q_insert_papers_held_keys), (QM.q_insert_ignore, QM.q_insert_ignore_held_keys),
                 (QM.q_insert_links, QM.q_insert_links_held_keys), (QM.q_upsert_authors, QM.q_upsert_authors_held_keys)):
        assert _rows(a(spark, SF_SMALL)) == _rows(b(spark, SF_SMALL))
    assert {r.tableName for r in spark.sql("SHOW TABLES").collect()} == before


def test_stream_with_key_tables_ends_as_without_them(spark, tmp_root, monkeypatch):
    """Also when a run stops after its keys are written and is done again."""
    d = SF_SMALL
    pages = H.render_listing_pages(spark, d)
    pages.filter("page_id = 0").write.parquet(f"{tmp_root}/drops/d=0")
    pages.filter("page_id > 0").write.parquet(f"{tmp_root}/drops/d=1")
    det, prof, held = H.render_detail_pages(spark, d), H.render_profile_pages(spark, d), QJ.held_state(spark, d)
    prefix = f"keys_{uuid.uuid4().hex[:10]}"

    def run(where, **kw):
        ST.stream_sync(spark, f"{tmp_root}/drops", det, f"{tmp_root}/{where}", f"{tmp_root}/{where}-ckpt", held, prof, QJ.NOW, **kw)
        return {n: _rows(df) for n, df in ST.J.load_state(spark, f"{tmp_root}/{where}").tables().items()}

    real = ST.J.commit
    monkeypatch.setattr(ST.J, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(Exception, match="stopped"):
        run("keyed", key_tables=prefix, key_buckets=8)
    monkeypatch.setattr(ST.J, "commit", real)
    try:
        assert run("keyed", key_tables=prefix, key_buckets=8) == run("plain")
    finally:
        for n in ST.J.KEYS:
            spark.sql(f"DROP TABLE IF EXISTS {prefix}_{n}")
