import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from scriptorium.llm.line_dedup import LineRuns, dedup_lines, line_pairs

from .conftest import ODD

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    low = -(1 << 63)
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            k = line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
            if len(k) >= 10:
                holders[k].add(low if r[0] is None else r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if (low if r[0] is None else r[0]) == min(
            holders.get(x.strip(" \t\n\x0b\x0c\r").translate(FOLD), {low if r[0] is None else r[0]}))]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def key(x):
    return (x[0] is None, x[0] or 0, x[1:])


def run(df, **kw):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in dedup_lines(df, **kw).collect()), key=key)


ROWS = [(10, "a common line here\nonly ten\nA COMMON line here "), (3, "\ta common line here\nshort\nlast line of three"),
        (7, "short\nshort\nlast line of three\nÀ COMMON LINE\x85"), (8, "à common line\x85\nÀ COMMON LINE\x85"), *ODD]


def test_matches_brute_force(make_docs):
    assert run(make_docs(ROWS)) == sorted(brute(ROWS), key=key)


def test_any_number_of_batches_gives_the_same(make_docs, small_docs):
    rows = small_docs + [(1000 + i, f"line number {i % 7} of the lot\nshared {i % 3} among many") for i in range(60)]
    want = sorted(brute(rows), key=key)
    for batches, fan in ((1, 2), (3, 2), (7, 3)):
        assert run(make_docs(rows), batches=batches, fan=fan) == want


def test_empty_table_and_extra_columns(make_docs):
    got = dedup_lines(make_docs([]))
    assert got.count() == 0 and got.columns[-2:] == ["n_lines", "n_dropped"]
    df = make_docs(ROWS).withColumn("n_lines", F.lit("mine")).withColumn("drops", F.lit(1))
    assert dedup_lines(df).filter("drops = 1 and n = 'x'").count() == len(ROWS)


def test_runs_are_compacted_and_disjoint(spark, make_docs):
    runs = LineRuns(spark, fan=2)
    for i in range(5):
        rows = [(i, f"the line of batch {i}\na line of every batch\nthe line of batch {i - 1}")]
        runs.add(line_pairs(make_docs(rows), "doc_id", "text", 10))
    assert {k: len(v) for k, v in runs.levels.items() if v} == {0: 1, 2: 1}
    every = None
    for r in runs.runs():
        every = r if every is None else every.unionByName(r)
    assert every.count() == every.select("h1", "h2").distinct().count() == 7


def test_no_run_stays_in_the_catalog(spark, make_docs):
    rows = [(i, f"line number {i % 7} of some\nanother line {i}") for i in range(40)]
    before = {t.name for t in spark.catalog.listTables()}
    got = dedup_lines(make_docs(rows), batches=3)
    assert sum(r.n_dropped for r in got.collect()) == 33
    assert {t.name for t in spark.catalog.listTables()} == before


def test_query_on_small_tables(spark, small_docs):
    from scriptorium.llm.queries import QUERIES
    got = {r.doc_id: r.kept_sha256 for r in QUERIES["op1_line_dedup"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: hashlib.sha256(t.encode()).hexdigest() for d, _, _, t in brute(small_docs)}
