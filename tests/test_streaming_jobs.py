"""Sync job and availableNow streams: restart safety, idempotence, JSON I/O."""

import os

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import mutate as M
from scriptorium.plans import q_jobs as QJ
from scriptorium.plans import sync_job as J
from scriptorium.sources import html as H
from scriptorium.sources import json_io as JS
from scriptorium.streaming import sync_stream as ST

from .conftest import SF_SMALL

NOW = QJ.NOW


def test_sync_batch_twice_is_idempotent(spark, tmp_root):
    d = SF_SMALL
    st = QJ.held_state(spark, d)
    pages, det = H.render_listing_pages(spark, d), H.render_detail_pages(spark, d)
    r1 = J.sync_batch(st, pages, det, None, NOW)
    J.start_state(spark, st, tmp_root)
    J.commit(r1, tmp_root, "first")
    s1 = r1.stats.first()
    st2 = J.load_state(spark, tmp_root)
    n_papers = st2.papers.count()
    assert n_papers == st.papers.count() + (s1.full_scrapes - s1.failed)
    # the same crawl again: nothing new is inserted
    r2 = J.sync_batch(st2, pages, det, None, NOW)
    assert r2.state.papers.count() == n_papers
    assert r2.stats.first().full_scrapes == s1.failed
    # every inserted paper has its links; ids unique
    p = st2.papers
    assert p.select("paper_id").distinct().count() == n_papers
    assert p.select("archive_id").distinct().count() == n_papers


def _tables(spark, root):
    return {n: sorted(map(str, df.collect())) for n, df in J.load_state(spark, root).tables().items()}


WHOLE = {}


@pytest.mark.parametrize("stop_after", range(6))
def test_replay_after_a_stop_at_any_write(spark, tmp_root, monkeypatch, stop_after):
    """A run stopped after k of its five table writes (5: before the log row)
    is replayed and ends with the tables of an undisturbed run."""
    d = SF_SMALL
    pages = H.render_listing_pages(spark, d).filter("page_id < 1")
    det, prof = H.render_detail_pages(spark, d), H.render_profile_pages(spark, d)
    pages.write.parquet(f"{tmp_root}/drops/d=0")
    held = QJ.held_state(spark, d)

    def stream(where):
        ST.stream_sync(spark, f"{tmp_root}/drops", det, f"{tmp_root}/{where}", f"{tmp_root}/{where}-ckpt", held, prof, NOW)

    J.start_state(spark, held, f"{tmp_root}/broken")
    real, n = M.write_run, [0]

    def failing(*a):
        if n[0] == stop_after:
            raise RuntimeError("stopped")
        n[0] += 1
        real(*a)
    monkeypatch.setattr(M, "write_run", failing)
    if stop_after == 5:
        monkeypatch.setattr(M, "commit_run", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(Exception, match="stopped"):
        stream("broken")
    assert set(M.committed_runs(spark, f"{tmp_root}/broken")) == {M.BASE_RUN}
    monkeypatch.undo()
    stream("broken")
    if not WHOLE:
        stream("whole")
        WHOLE.update(_tables(spark, f"{tmp_root}/whole"))
    assert _tables(spark, f"{tmp_root}/broken") == WHOLE


def test_index_stream_needs_a_stored_index_and_keeps_postings_in_step(spark, tmp_root):
    from scriptorium.operators import search as S
    from tests.test_search import seed
    rel = seed(spark)
    names = dict(zip(("papers", "authors", "keywords", "author_links", "keyword_links"), rel))
    spark.createDataFrame([(2,)], "paper_id long").write.parquet(f"{tmp_root}/changes/d=0")
    args = (f"{tmp_root}/changes", names, f"{tmp_root}/index", f"{tmp_root}/ckpt")
    with pytest.raises(Exception, match="no search index"):
        ST.stream_refresh_index(spark, *args)
    old = names["papers"].withColumn("abstract", F.when(F.col("paper_id") == 2, F.lit("an older abstract")).otherwise(F.col("abstract")))
    ST.start_index(spark, S.rebuild_search_index(old, *rel[1:], fold=True, stem=True), f"{tmp_root}/index")
    ST.stream_refresh_index(spark, *args)                       # the batch was not lost
    got, want = ST.current_index(spark, f"{tmp_root}/index"), S.rebuild_search_index(*rel, fold=True, stem=True)
    for t in ("docs", "postings", "doclen"):
        a, b = getattr(got, t), getattr(want, t)
        assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    assert S.match_count(got, S.term("olden")).first().total == 0


def test_stream_sync_restart(spark, tmp_root):
    d = SF_SMALL
    pages = H.render_listing_pages(spark, d)
    pages.filter("page_id = 0").write.parquet(f"{tmp_root}/drops/d=0")
    det, prof = H.render_detail_pages(spark, d), H.render_profile_pages(spark, d)
    args = (f"{tmp_root}/drops", det, f"{tmp_root}/tables", f"{tmp_root}/ckpt", QJ.held_state(spark, d),
            prof, NOW)
    ST.stream_sync(spark, *args)
    log1 = ST.sync_runs(spark, f"{tmp_root}/tables").count()
    ST.stream_sync(spark, *args)                      # restart, nothing new
    assert ST.sync_runs(spark, f"{tmp_root}/tables").count() == log1 == 1
    pages.filter("page_id > 0").write.parquet(f"{tmp_root}/drops/d=1")
    ST.stream_sync(spark, *args)
    assert ST.sync_runs(spark, f"{tmp_root}/tables").count() == 2
    before = _tables(spark, f"{tmp_root}/tables")
    # a new checkpoint folder reads every drop again: the tables stay as they are
    ST.stream_sync(spark, *args[:3], f"{tmp_root}/ckpt2", *args[4:])
    assert _tables(spark, f"{tmp_root}/tables") == before
    assert ST.sync_runs(spark, f"{tmp_root}/tables").count() == 4


def test_papers_json_round_trip(spark, tmp_root):
    df = spark.createDataFrame([("000001", "A  title\u0085", ["x  y"], "", "", [], "", "ab\nc",
                                 "https://l/1", 3),
                                (None, None, None, None, None, None, None, None, None, None)],
                               JS.PAPER_SCHEMA)
    path = JS.write_papers_json(df, f"{tmp_root}/papers")
    back = JS.load_papers_json(spark, path).collect()
    assert len(back) == 1
    assert back[0].title == "A title" and back[0].authors == ["x y"] and back[0].abstract == "ab\nc"
    with pytest.raises(Exception):
        JS.write_papers_json(df, path)           # never overwrite


def test_load_papers_json_array_missing_and_malformed(spark, tmp_root):
    assert JS.load_papers_json(spark, f"{tmp_root}/nope.json").count() == 0
    good = os.path.join(tmp_root, "papers.json")
    with open(good, "w") as f:
        f.write('[{"id": "000001", "title": "T", "authors": ["A"], "downloads": 2}, {"id": "000002"}]')
    rows = JS.load_papers_json(spark, good).orderBy("id").collect()
    assert [r.id for r in rows] == ["000001", "000002"] and rows[0].downloads == 2
    bad = os.path.join(tmp_root, "bad.json")
    with open(bad, "w") as f:
        f.write('[{"id": "000001", "title": ')
    with pytest.raises(JS.PapersLoadError):
        JS.load_papers_json(spark, bad)


def test_run_log_has_timing(spark, tmp_root):
    d = SF_SMALL
    pages = H.render_listing_pages(spark, d)
    pages.write.parquet(f"{tmp_root}/drops/d=0")
    ST.stream_sync(spark, f"{tmp_root}/drops", H.render_detail_pages(spark, d), f"{tmp_root}/tables",
                   f"{tmp_root}/ckpt", QJ.held_state(spark, d), None, NOW)
    r = ST.sync_runs(spark, f"{tmp_root}/tables").first()
    assert r.finished_at >= r.started_at and r.duration_ms >= 0 and r.success


def test_a_drop_of_several_files_is_one_run(spark, tmp_root, monkeypatch):
    """The sync stream makes a run per drop, however many files the drop was written in."""
    pages = H.render_listing_pages(spark, SF_SMALL)
    monkeypatch.setattr(QJ.H, "render_listing_pages", lambda *a: pages.repartition(3, "page_id"))
    whole = QJ.write_once
    monkeypatch.setattr(QJ, "write_once", lambda df, name="rows": whole(df, name).repartition(3, "page_id") if name == "listing-pages" else whole(df, name))
    QJ._stream(spark, SF_SMALL, tmp_root)
    assert spark.read.parquet(f"{tmp_root}/drops").filter("drop = 1").select(F.input_file_name()).distinct().count() > 1
    runs = sorted((r.batch_id, r.pages, r.papers_seen) for r in ST.sync_runs(spark, f"{tmp_root}/tables").collect())
    assert len(runs) == 2 and runs[0] == (0, 1, 30) and runs[1][1] > 1


def test_a_run_reads_back_only_the_columns_it_needs(spark, tmp_root):
    """What several branches of a run read is a written table, not a checkpoint that gives whole rows."""
    listing = spark.createDataFrame([(0, "u", "<html><body>no rows</body></html>")], ST.CRAWL_SCHEMA)
    for name, df in (("listing", listing), ("detail", spark.createDataFrame([], "page_id long, paper_id string, html string"))):
        df.write.parquet(f"{tmp_root}/{name}")
    for name, df in J.empty_state(spark).tables().items():
        df.write.parquet(f"{tmp_root}/{name}")
    state = J.ArchiveState(**{n: spark.read.parquet(f"{tmp_root}/{n}") for n in J.STATE_TABLES})
    res = J.sync_batch(state, spark.read.parquet(f"{tmp_root}/listing"), spark.read.parquet(f"{tmp_root}/detail"), None, NOW)
    plan = res.stats._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "listing-rows" in plan, plan
    assert res.stats.first().asDict() == {"pages": 1, "seen": 0, "full_scrapes": 0, "version_updates": 0, "skipped": 0, "failed": 0}
