"""Set-wise mutations: inserts with rejects, upserts, audit stamps, run
log folding, versioned writes."""

import datetime as dt

from pyspark.sql import functions as F

from scriptorium.operators import mutate as M
from scriptorium.operators import validate as V

NOW = dt.datetime(2026, 1, 1)


def test_insert_papers_rejects_duplicates(spark):
    ex = spark.createDataFrame([(5, "000001")], "paper_id long, archive_id string")
    inc = spark.createDataFrame([("000001", "T1", "May 2024", 1), ("000002", "T2", "2024", 2),
                                 ("000002", "T2b", "", 3), ("000003", "T3", "", 4)],
                                "archive_id string, title string, date string, seq long")
    ok, bad = M.insert_papers(ex, inc, now=NOW)
    got = {r.archive_id: r for r in ok.collect()}
    assert set(got) == {"000002", "000003"}
    assert (got["000002"].paper_id, got["000003"].paper_id) == (6, 7)
    assert (got["000002"].paper_month, got["000002"].paper_year) == ("2024", "")
    from scriptorium.functions.text import REFERENCE_PREFIX
    assert got["000002"].paper_reference == REFERENCE_PREFIX + "000002"
    errs = sorted((r.archive_id, r.error) for r in bad.collect())
    assert errs == [("000001", "duplicate key: already stored"),
                    ("000002", "duplicate key: repeated in batch")]


def test_insert_ignore_and_links(spark):
    ex = spark.createDataFrame([(1, "syntax")], "keyword_id long, keyword string")
    inc = spark.createDataFrame([("syntax",), ("morphology",), ("morphology",), ("",)], "keyword string")
    got = sorted((r.keyword_id, r.keyword) for r in M.insert_ignore(ex, inc, "keyword", "keyword_id").collect())
    assert got == [(2, "morphology")]
    held = spark.createDataFrame([(1, 1)], "author_id long, paper_id long")
    links = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (2, 1, 3)],
                                  "author_id long, paper_id long, author_position int")
    ok, bad = M.insert_links(held, links, ["author_id", "paper_id"], ["author_position"])
    assert [(r.author_id, r.author_position) for r in ok.collect()] == [(2, 2)]
    assert bad.count() == 2


def test_upsert_authors(spark):
    ex = spark.createDataFrame([(1, "jdoe", "John", "Doe", "j@x", "", "", NOW, NOW)],
                               "author_id long, username string, first_name string, last_name string, "
                               "email string, affiliation string, website string, "
                               "row_created_at timestamp_ntz, row_updated_at timestamp_ntz")
    listed = spark.createDataFrame([("jdoe", "Johnny", "Doe", 1), ("asmith", "Alice", "Smith", 2),
                                    ("", "Blank", "User", 3)],
                                   "username string, first_name string, last_name string, seq long")
    prof = spark.createDataFrame([("asmith", "a@u", "Uni", "")],
                                 "username string, email string, affiliation string, website string")
    nxt, rej = M.upsert_authors(ex, listed, prof, NOW)
    rows = {r.username: r for r in nxt.collect()}
    assert rows["jdoe"].first_name == "John"           # existing: not refreshed
    assert (rows["asmith"].author_id, rows["asmith"].email) == (2, "a@u")
    assert rej.count() == 1


def test_generic_upsert(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, v string, w string")
    new = spark.createDataFrame([(2, "B", "Y"), (3, "c", "z")], "k long, v string, w string")
    out = sorted(tuple(r) for r in M.upsert(old, new, ["k"], ["v"]).collect())
    assert out == [(1, "a", "x"), (2, "B", "y"), (3, "c", "z")]


def test_touch_changed_null_rules(spark):
    old_t = dt.datetime(2025, 1, 1)
    old = spark.createDataFrame([(1, "a", None, old_t), (2, "b", None, old_t)],
                                "id long, name string, site string, row_updated_at timestamp_ntz")
    new = spark.createDataFrame([(1, "a", "http://x"), (2, "B", None), (3, "c", None)],
                                "id long, name string, site string")
    safe = {r.id: r.row_updated_at for r in M.touch_changed(old, new, "id", ["name", "site"], NOW).collect()}
    strict = {r.id: r.row_updated_at for r in
              M.touch_changed(old, new, "id", ["name", "site"], NOW, strict_sql=True).collect()}
    assert safe == {1: NOW, 2: NOW, 3: NOW}
    assert strict == {1: old_t, 2: NOW, 3: NOW}


def test_fold_sync_runs(spark):
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    log = spark.createDataFrame(
        [(1, "start", t0, "cron", None, None, None, None, None, None),
         (1, "finish", t1, None, 42, 7, 3, 1, True, None),
         (2, "start", t1, "manual", None, None, None, None, None, None),
         (3, "start", t0, "cron", None, None, None, None, None, None),
         (3, "finish", t1, None, 0, 0, 0, 0, False, "boom")],
        "sync_run_id long, kind string, at timestamp_ntz, runner string, papers_seen long, "
        "papers_new long, papers_updated long, papers_failed long, success boolean, error_message string")
    r = {x.sync_run_id: x for x in M.fold_sync_runs(log).collect()}
    assert (r[1].papers_seen, r[1].papers_new, r[1].papers_updated, r[1].papers_failed, r[1].success) == \
        (42, 7, 3, 1, True)
    assert (r[2].finished_at, r[2].success, r[2].papers_seen) == (None, False, 0)
    assert (r[3].success, r[3].error_message) == (False, "boom")


def test_rows_count_once_their_run_is_committed(spark, tmp_root):
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "x long")
    read = lambda: sorted(r.x for r in M.read_runs(spark, tmp_root, "t").collect())
    assert M.read_runs(spark, tmp_root, "t") is None and M.committed_runs(spark, tmp_root) == {}
    M.write_run(rows(1), tmp_root, "t", "a")
    assert M.read_runs(spark, tmp_root, "t") is None
    M.commit_run(spark, tmp_root, "a")
    M.write_run(rows(2, 3), tmp_root, "t", "b")                 # stopped before its commit
    assert read() == [1]
    M.write_run(rows(2), tmp_root, "t", "b")                    # the replay replaces its own rows
    M.commit_run(spark, tmp_root, "b", rows(7))
    assert read() == [1, 2] and M.committed_runs(spark, tmp_root) == {"a": 0, "b": 1}
    assert {r.x: r.seq for r in M.read_runs(spark, tmp_root, "t", with_seq=True).collect()} == {1: 0, 2: 1}


def test_enforce_unique(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (2, 1, None)], "p long, a long, n string")
    v = V.enforce_unique(df, ["p", "a"], not_null=["n"], name="link").collect()
    assert sorted((r.n or "", r.violation) for r in v) == [("", "link:not_null:n"), ("b", "link:unique")]


def test_mark_embedded(spark):
    p = spark.createDataFrame([(10,), (20,), (30,)], "paper_id long")
    out = {r.paper_id: r.embedded_at for r in M.mark_embedded(p, [10, 20], NOW).collect()}
    assert out == {10: NOW, 20: NOW, 30: None}
    assert M.mark_embedded(p, [], NOW) is p


def test_insert_into_modes(spark):
    import pytest
    ex = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    inc = spark.createDataFrame([(2, "B"), (3, "c")], "k long, v string")
    nxt, aff, rej = M.insert_into(ex, inc, ["k"])
    assert sorted(tuple(r) for r in nxt.collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert aff is None and [r.k for r in rej.collect()] == [2]
    nxt, aff, rej = M.insert_into(ex, inc, ["k"], on_conflict="update", returning=True)
    assert sorted(tuple(r) for r in nxt.collect()) == [(1, "a"), (2, "B"), (3, "c")]
    assert aff.count() == 2 and rej.count() == 0
    nxt, aff, rej = M.insert_into(ex, inc, ["k"], on_conflict="nothing")
    assert sorted(tuple(r) for r in nxt.collect()) == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(M.WriteModeError):
        M.insert_into(ex, inc, ["k"], on_conflict="nothing", returning=True)


def test_insert_into_counts_a_repeated_key_once(spark):
    ex = spark.createDataFrame([(1, "u1", "old")], "id long, u string, v string")
    inc = spark.createDataFrame([("u5", "a"), ("u5", "a"), ("u1", "x"), ("u1", "y")], "u string, v string")
    for mode, want, rejected in ((None, [("u1", "old"), ("u5", "a")], 3), ("nothing", [("u1", "old"), ("u5", "a")], 0),
                                 ("update", [("u1", "x"), ("u5", "a")], 2)):
        nxt, _, rej = M.insert_into(ex, inc, ["u"], on_conflict=mode)
        assert sorted((r.u, r.v) for r in nxt.collect()) == want
        assert {r.id for r in nxt.filter("u = 'u1'").collect()} == {1}
        assert rej.count() == rejected
    ids = spark.createDataFrame([(7, "u1", "x")], ex.schema)
    assert M.insert_into(ex, ids, ["u"], on_conflict="update", id_col="id")[0].first().id == 1


def test_rejects_are_complete(spark):
    inc = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, 0)], "author_id long, paper_id long, author_position int")
    held = spark.createDataFrame([], "author_id long, paper_id long")
    ok, bad = M.insert_links(held, inc, ["author_id", "paper_id"], ["author_position"])
    assert ok.count() == 2 and bad.count() == 1
