"""Relational operators: classification truth table, cutoff, batches,
merge, dense index, lookups."""

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import relations as R


def test_classify_truth_table(spark):
    listing = spark.createDataFrame(
        [("000001", "freshly changed", 1), ("000002", "new", 2), ("000003", "new", 3),
         ("000004", "2026-01", 4), ("000005", "2026-01", 5), ("000006", "freshly changed", 6)],
        "paper_id string, status string, seq long")
    known = spark.createDataFrame([("000002",), ("000004",), ("000006",)], "paper_id string")
    out = {r.paper_id: (r.action, r.reason) for r in R.classify_rows(listing, known).collect()}
    assert out["000001"] == ("update-version", None)
    assert out["000006"] == ("update-version", None)       # no lookup for freshly changed
    assert out["000002"] == ("skip", "Paper 000002 already in DB")
    assert out["000003"] == ("full-scrape", None)
    assert out["000004"][0] == "skip" and out["000005"][0] == "full-scrape"


def test_incremental_cutoff(spark):
    acts = spark.createDataFrame(
        [(0, "full-scrape"), (0, "skip"), (1, "skip"), (1, "update-version"), (2, "skip"),
         (2, "skip"), (3, "full-scrape")], "page long, action string")
    out = R.incremental_cutoff(acts).collect()
    assert sorted({r.page for r in out}) == [0, 1, 2]        # page 3 never fetched
    assert all(r.process == (r.page < 2) for r in out)       # page 2 seen, not processed
    assert R.incremental_cutoff(acts, full=True).count() == 7


def test_page_without_rows_stops_the_run(spark):
    acts = spark.createDataFrame([(0, "full-scrape"), (2, "full-scrape")], "page long, action string")
    pages = spark.range(4).withColumnRenamed("id", "page")
    assert [(r.page, r.process) for r in R.incremental_cutoff(acts, pages=pages).collect()] == [(0, True)]
    assert sorted(r.page for r in R.fetched_pages(acts, pages).collect()) == [0, 1]
    stats = R.run_stats(R.incremental_cutoff(acts, pages=pages), R.fetched_pages(acts, pages).count()).first()
    assert (stats.pages, stats.seen) == (2, 1)


@pytest.mark.parametrize("n,size,expect", [(6, 2, [2, 2, 2]), (5, 2, [2, 2, 1]), (0, 3, []),
                                           (3, 10, [3]), (4, 1, [1, 1, 1, 1])])
def test_batch_assign(spark, n, size, expect):
    df = spark.range(n).select(F.col("id").alias("k"))
    b = R.batch_assign(df, ["k"], size)
    got = [r["count"] for r in b.groupBy("batch").count().orderBy("batch").collect()]
    assert got == expect
    if n:
        first = {r.k: r.batch for r in b.collect()}
        assert all(first[k] == k // size for k in first)


def test_dense_index_many_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7 % 1000).alias("v"))
    out = R.dense_index(df.repartition(5), ["v"], "i").collect()
    assert sorted((r.v, r.i) for r in out) == [(v, v) for v in range(1000)]


def test_merge_keep_existing(spark):
    ex = spark.createDataFrame([("2", "old2a", 1), ("10", "old10", 2), ("2", "old2b", 3)],
                               "id string, title string, seq long")
    new = spark.createDataFrame([("2", "new2", 1), ("3", "new3a", 2), ("3", "new3b", 3), ("1", "new1", 4)],
                                "id string, title string, seq long")
    out = [(r.id, r.title) for r in R.merge_keep_existing(ex, new, "id", "seq").collect()]
    assert out == [("1", "new1"), ("2", "old2b"), ("3", "new3a"), ("10", "old10")]


def test_new_ids_and_full_load(spark):
    front = spark.createDataFrame([(123456,), (654321,), (5,)], "id long")
    cur = spark.createDataFrame([("005",)], "id string")
    assert sorted(r.id for r in R.new_ids(front, cur).collect()) == [123456, 654321]
    assert R.new_ids(front, cur.limit(0)).count() == 0
    assert [r.id for r in R.full_load_ids(spark, 5).orderBy("id").collect()] == [2, 3, 4, 5]


def test_newest_id_empty_raises(spark):
    with pytest.raises(Exception):
        R.newest_id(spark.createDataFrame([], "id long"), "id").collect()


def test_lookups_and_filters(spark):
    a = spark.createDataFrame([(2, "u", "x@e"), (1, "v", "x@e"), (3, "w", "y@e")],
                              "author_id long, username string, email string")
    assert R.lookup_first(a, "email", "x@e", "author_id").first().author_id == 1
    assert R.lookup_first(a, "username", "nobody", "author_id").count() == 0
    assert R.filter_ids(a, "author_id", []).count() == 0
    assert R.filter_ids(a, "author_id", [1, 3]).count() == 2
    assert R.filter_ids(a, "author_id", spark.createDataFrame([(3,)], "x long")).count() == 1
    assert [r.author_id for r in R.scan(a, "author_id", 2).collect()] == [1, 2]


def test_papers_with_authors_keeps_empty(spark):
    p = spark.createDataFrame([(1, "000001"), (2, "000002")], "paper_id long, archive_id string")
    a = spark.createDataFrame([(7, "A", "B", "ab"), (8, "C", "D", "cd")],
                              "author_id long, first_name string, last_name string, username string")
    l = spark.createDataFrame([(8, 1, 2), (7, 1, 1)], "author_id long, paper_id long, author_position int")
    out = {r.paper_id: r.authors for r in R.papers_with_authors(p, a, l).collect()}
    assert [x.username for x in out[1]] == ["ab", "cd"]
    assert out[2] == []


def test_latest_sync_run(spark):
    import datetime as dt
    runs = spark.createDataFrame(
        [(1, "a", dt.datetime(2024, 1, 1)), (2, "b", dt.datetime(2024, 2, 1))],
        "sync_run_id long, runner string, started_at timestamp_ntz")
    assert R.latest_sync_run(runs).first().runner == "b"
    assert R.latest_sync_run(runs.limit(0)).count() == 0
