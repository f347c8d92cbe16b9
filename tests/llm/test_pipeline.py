import hashlib
import math
import random
from collections import defaultdict

import corpus_pipeline as P

from scriptorium.llm import decontaminate

from . import test_decontaminate, test_line_dedup, test_mix_sources, test_ngram_join

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    first = docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        if name != "mix":
            assert out.columns == first.columns and out.schema == first.schema
            out = P.materialize(out, name)
            assert all(r.n_chars == len(r.text) for r in out.collect())
        seen.append((name, docs.count(), out.count()))
        docs, last = out, docs
    assert [n for n, _, _ in seen] == ["language_id", "line_dedup", "near_duplicates", "decontaminate", "mix"]
    counts = {n: (a, b) for n, a, b in seen}
    assert counts["line_dedup"][0] == counts["line_dedup"][1]
    # lines that copies share are gone by then: what this stage drops is judged on its own input, below
    assert counts["near_duplicates"][1] <= counts["near_duplicates"][0]
    assert counts["decontaminate"][1] < counts["decontaminate"][0] and counts["mix"][0] == counts["mix"][1]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.find_contamination(last, bench).filter(decontaminate.contaminated()).count() == 0


def test_run_equals_the_stages(spark):
    assert set(P.run(spark, SF).columns) == {"doc_id", "size", "source_size", "target", "taken", "first_slot"}


def test_odd_documents(spark, make_docs, tmp_path):
    from .conftest import ODD
    docs = make_docs(ODD).select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (docs, docs.limit(0)):
        out = rows
        for _, stage in P.STAGES:
            out = P.materialize(stage(spark, out, SF), "odd")
        assert out.count() <= len(ODD)


def test_only_near_copies_go(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "one text that is like no other text here"), (1, "a second text under the same id as the first one"),
            (2, long), (3, long + " more"), (None, long), (None, "no id, and like nothing else in this table"),
            (None, "no id, copied word by word in this table"), (None, "no id, copied word by word in this table"),
            (4, "same row twice, word by word the same"), (4, "same row twice, word by word the same")]
    docs = make_docs(rows).select(*P.COLUMNS)
    want = {rows[i] for i in (0, 1, 2, 5, 6, 8)}
    for n in (1, 5):
        got = [(r.doc_id, r.text) for r in P.drop_near_duplicates(spark, docs.repartition(n), SF).collect()]
        assert len(got) == len(want) and set(got) == want


def test_near_copies_without_a_common_line_go(spark, make_docs):
    """Copies whose every line was edited pass line dedup whole and are found by their shingles."""
    rng = random.Random(31)
    rows = []
    for g in range(12):
        lines = [[f"g{g}w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(4)]
        for c in range(1 + g % 4):      # a copy changes one word of each line
            mine = [line[:c] + [f"x{g}.{c}.{k}"] + line[c + 1:] if c else line for k, line in enumerate(lines)]
            rows.append((100 * g + c, "\n".join(" ".join(x) for x in mine)))
    docs = make_docs(rows).select(*P.COLUMNS)
    lines = P.materialize(P.drop_repeated_lines(spark, docs, SF), "lines")
    assert sorted((r.doc_id, r.text) for r in lines.collect()) == rows
    got = P.drop_near_duplicates(spark, lines, SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, _, c in test_ngram_join.brute(rows) if i == c) == [100 * g for g in range(12)]


def plain_stages(rows, items):
    """The stages after language identification, on (doc_id, text, lang, source) rows with unique ids."""
    other = {r[0]: r[2:] for r in rows}
    rows = [(i, t, *other[i]) for i, _, _, t in test_line_dedup.brute(rows)]
    stay = {i for i, _, c in test_ngram_join.brute(rows) if i == c}
    rows = [r for r in rows if r[0] in stay]
    gone = {i for i, n, hit, *_ in test_decontaminate.brute(rows, items) if hit and 20 * hit >= n}
    rows = [r for r in rows if r[0] not in gone]
    n, goal = test_mix_sources.targets(rows)
    off, out = defaultdict(int), []
    for r in sorted(rows, key=lambda r: hashlib.md5(f"{r[0]}:mix-1".encode()).hexdigest()):
        k, src, top = test_mix_sources.size(r[1]), r[3], math.floor(goal[r[3]])
        taken = sum(max(0, min(k, top - p * n[src] - off[src])) for p in (0, 1))
        off[src] += k
        out.append((r[0], k, n[src], round(goal[src], 3), taken))
    return sorted(out)


def test_run_gives_the_rows_of_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.materialize(P.identify_language(spark, docs, SF), "kept").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = plain_stages([(r.doc_id, r.text, r.lang, r.source) for r in kept], items)
    got = sorted((r.doc_id, r.size, r.source_size, round(r.target, 3), r.taken) for r in P.run(spark, SF).collect())
    assert len(want) > 100 and got == want
