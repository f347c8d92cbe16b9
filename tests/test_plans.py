"""Plan-shape regression tests: pushdown and pruning reach the scan, no
cartesian / nested-loop joins, bounded broadcasts."""

import contextlib
import io

import __spark_entry__ as E
from scriptorium.operators import search as S

from .conftest import SF_SMALL


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_term_search_prunes_buckets_and_pushes_term(spark, tmp_root):
    from scriptorium.plans.q_search import search_docs
    idx = S.write_index(S.build_postings(search_docs(spark, SF_SMALL)), f"{tmp_root}/idx", n_buckets=16)
    txt = plan(S.match_boolean(idx, S.all_of("the", "and")))
    assert "PartitionFilters: [" in txt and "bucket" in txt
    assert "EqualTo(term,the)" in txt and "EqualTo(term,and)" in txt
    page = plan(S.search_page(idx, S.term("the"), limit=5))
    assert "TakeOrderedAndProject" in page


def test_no_cartesian_in_join_queries(spark):
    q = E.queries()
    for k in ("papers_with_authors", "paper_detail", "classify_rows", "hydrate_hits", "author_position",
              "insert_papers", "incremental_cutoff", "search_page"):
        txt = plan(q[k](spark, SF_SMALL))
        assert "CartesianProduct" not in txt and "BroadcastNestedLoopJoin" not in txt, k


def test_lookup_pushes_filter_to_scan(spark):
    txt = plan(E.queries()["author_by_username"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(s_name), EqualTo(s_name,Supplier#000000007)]" in txt


def test_links_of_both_states_are_worked_out_once(spark):
    from scriptorium.operators import search
    from scriptorium.plans.q_search import _old_new_state
    _, changes, (_, _, _, al, kl) = _old_new_state(spark, "/root/testdata/sf0.001")
    plan = search.affected_papers(changes, kl, al)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan
