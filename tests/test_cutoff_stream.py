"""W2 over micro-batches: decisions equal those of the batch operator, whatever the order of the files."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.operators import relations as R
from scriptorium.streaming import cutoff_stream as SC


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=30), st.randoms(use_true_random=False), st.integers(1, 5))
def test_decisions_do_not_depend_on_the_order(flags, rnd, size):
    order = list(range(len(flags)))
    rnd.shuffle(order)
    cut, got = SC.CrawlCut(0), {}
    for i in range(0, len(order), size):
        part = np.array(order[i:i + size], np.int64)
        for lo, hi, process in cut.add(part, np.array([flags[p] for p in part], bool)):
            for p in range(lo, hi + 1):
                assert p not in got
                got[p] = process
        again = cut.add(part, np.array([flags[p] for p in part], bool))        # a repeated delivery
        assert not [a for a in again if a[0] in got]
        # what waits are ranges before the first idle page, apart from each other
        assert all(a <= b < cut.first_idle for a, b in zip(cut.starts, cut.ends))
        assert all(cut.starts[1:] > cut.ends[:-1] + 1)
    first_idle = flags.index(False) if False in flags else len(flags)
    assert got == {p: p < first_idle for p in range(len(flags)) if p <= first_idle}


def test_merge_ranges():
    a, b = SC.merge_ranges(np.array([5, 1, 2, 9]), np.array([6, 1, 4, 9]))
    assert (a.tolist(), b.tolist()) == ([1, 9], [6, 9])
    a, b = SC.merge_ranges(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(a) == len(b) == 0


def _page(crawl, page, *actions):
    return crawl, page, [(f"{crawl}-{page}-{i}", a) for i, a in enumerate(actions)]


def test_stream_equals_batch_over_files_and_restarts(spark, tmp_root):
    new, skip = "full-scrape", "skip"
    a = [_page("a", 0, new, skip), _page("a", 1, skip, "update-version"), _page("a", 2, skip, skip), _page("a", 3, new)]
    b = [_page("b", p, new) for p in range(4)]
    c = [_page("c", 0), _page("c", 1, new)]                      # an empty page stops the run
    files = [[a[3], b[2], c[1]], [b[0], a[0]], [a[2], b[3]], [c[0], a[1], b[1]],
             [(None, 0, [("x", new)]), ("a", None, [("y", new)]), ("b", -1, [("z", new)]), ("d", 1, None), ("d", 0, [("d-0", new)])],
             [a[3], b[0]]]                                       # delivered again
    drops, out, ckpt = (f"{tmp_root}/{x}" for x in ("drops", "decisions", "ckpt"))
    seen = []
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SC.PAGE_SCHEMA).coalesce(1).write.parquet(f"{drops}/f={i}")
        if i in (1, 3, 5):                                       # two files, then a restart
            SC.stream_cutoff(spark, drops, out, ckpt, files_per_batch=1)
            seen.append(spark.read.parquet(out).count())
    assert seen[0] < seen[1] <= seen[2]
    got = {(r.crawl, r.page): r.process for r in spark.read.schema(SC.DECISION_SCHEMA).parquet(out).collect()}
    assert spark.read.parquet(out).count() == len(got)
    want = {}
    for pages in (a, b, c, [("d", 0, [("d-0", new)]), ("d", 1, None)]):
        df = spark.createDataFrame(pages, SC.PAGE_SCHEMA)
        rows = df.select("page", F.inline("actions"))
        kept = R.fetched_pages(rows, df)
        cut = {r.page: r.process for r in R.incremental_cutoff(rows, pages=df).collect()}
        want |= {(pages[0][0], r.page): cut.get(r.page, False) for r in kept.collect()}
    assert got == want
    rows = SC.decided_rows(spark, drops, out).distinct().collect()
    assert {r.paper_id for r in rows if r.process} == {"a-0-0", "a-0-1", "a-1-0", "a-1-1", "b-0-0", "b-1-0", "b-2-0", "b-3-0", "d-0"}
    assert {r.paper_id for r in rows if not r.process} == {"a-2-0", "a-2-1"}


def test_no_file_has_no_rows(spark, tmp_root):
    spark.createDataFrame([], SC.PAGE_SCHEMA).write.parquet(f"{tmp_root}/drops")
    SC.stream_cutoff(spark, f"{tmp_root}/drops", f"{tmp_root}/out", f"{tmp_root}/ckpt")
    assert SC.decided_rows(spark, f"{tmp_root}/drops", f"{tmp_root}/out").count() == 0
