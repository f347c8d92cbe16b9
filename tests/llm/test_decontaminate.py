import random
import re

import pytest

from scriptorium.llm import decontaminate as D

from .conftest import ODD

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def norm(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def brute(rows, items, size=13):
    out = []
    tests = {}
    for i, t in items:
        w = norm(t)
        k = min(size, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            tests.setdefault((k, tuple(w[j:j + k])), set()).add(None if i is None else str(i))
    lengths = {k for k, _ in tests}
    for r in rows:
        w = norm(r[1])
        hit, ids = set(), set()
        for k in lengths:
            for j in range(len(w) - k + 1):
                got = tests.get((k, tuple(w[j:j + k])))
                if got:
                    hit |= set(range(j, j + k))
                    ids |= got
        out.append((r[0], len(w), len(hit), len(ids), sorted(x for x in ids if x is not None)))
    return sorted(out, key=str)


def run(df, items, **kw):
    got = D.find_contamination(df, items, **kw).collect()
    for r in got:
        assert r.n_hit == sum(s["last"] - s["first"] + 1 for s in r.hit_spans)
        assert all(a["last"] + 1 < b["first"] for a, b in zip(r.hit_spans, r.hit_spans[1:]))
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.item_ids) for r in got), key=str)


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(2)
    w = [f"t{i}" for i in range(60)]
    long = [" ".join(rng.choice(w) for _ in range(k)) for k in (13, 14, 30, 60)]
    rows = [(1, long[0]), (2, long[1].upper() + "!"), (10, long[2]), (11, long[3]), (12, long[3]), (20, "just four words here"),
            (21, "alone"), (22, None), (23, " -- "), (24, "été 漢字 42"), (None, "no id of its own but words enough to make a window of")]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="module")
def rows(items):
    rng = random.Random(3)
    out = list(ODD) + [(100, "a JUST, four-words: here b"), (101, "alone"), (102, "Alone! alone... alone"), (103, "x Été.漢字/42 y")]
    for i in range(80):
        t = rng.choice([x for _, x in items[0] if x])
        w = t.split()
        a, b = sorted((rng.randint(0, len(w)), rng.randint(0, len(w))))
        pad = " ".join(f"p{rng.randrange(999)}" for _ in range(rng.choice([0, 5, 400])))
        out.append((200 + i, f"{pad} {' - '.join(w[a:b])} {pad} {' '.join(w)}" if i % 2 else f"{pad} {' '.join(w[a:b])}"))
    return out


@pytest.mark.parametrize("chunk", [D.CHUNK_WINDOWS, 20])
def test_matches_brute_force(make_docs, rows, items, chunk):
    assert run(make_docs(rows).repartition(3), items[1], chunk_windows=chunk) == brute(rows, items[0])


def test_removal(make_docs, rows, items):
    want = {r[0] for r in brute(rows, items[0]) if not (r[2] > 0 and 20 * r[2] >= r[1])}
    kept = D.remove_contaminated(make_docs(rows), items[1])
    assert kept.columns == make_docs([]).columns and {r.doc_id for r in kept.collect()} == want
    cut = D.remove_contaminated(make_docs(rows), items[1], mode="spans")
    assert cut.count() == len(rows)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert norm(texts[100]) == ["a", "b"] and norm(texts[102]) == [] and texts[1] is None


def test_items_without_an_id_count_but_have_no_name(make_docs, spark):
    words = [" ".join(f"{x}{i}" for i in range(13)) for x in "abc"]
    bench = spark.createDataFrame([(None, words[0]), (None, words[1]), (7, words[2])], "item_id long, text string")
    docs = make_docs([(1, words[0]), (2, f"{words[0]} x {words[1]}"), (3, f"{words[2]} {words[1]}"), (4, "nothing")])
    for chunk in (D.CHUNK_WINDOWS, 1):
        got = run(docs, bench, chunk_windows=chunk)
        assert got == [(1, 13, 13, 1, []), (2, 27, 26, 1, []), (3, 26, 26, 2, ["7"]), (4, 1, 0, 0, [])]


def test_empty_tables(make_docs, items, spark):
    assert D.find_contamination(make_docs([]), items[1]).count() == 0
    got = D.find_contamination(make_docs([(1, "alone")]), items[1].limit(0)).first()
    assert (got.n_words, got.n_hit, got.n_items) == (1, 0, 0)
