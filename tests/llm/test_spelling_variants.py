import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from scriptorium.llm import spelling_variants as S
from scriptorium.llm.queries import QUERIES, _misspelt

from .conftest import ODD

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, planted=False):
    total = Counter()
    for r in rows:
        for run in RUN.findall(r[1] or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{r[0]}:{run}".encode())
            if planted and r[0] is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_forms(n):
    near = {w: [] for w in n}
    cut: dict[str, set] = {}
    for w in n:         # words that are near have a spelling less one letter in common
        for i in range(len(w)):
            cut.setdefault(w[:i] + w[i + 1:], set()).add(w)
    for w in n:
        cut.setdefault(w, set()).add(w)
    for group in cut.values():
        for a in group:
            near[a] += [b for b in group if a != b and is_near(a, b)]
    near = {w: set(v) for w, v in near.items()}
    form = {}
    for w, v in near.items():
        best = min(v, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(out)


def rows_of(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def test_query_equals_brute_force(spark, small_docs):
    assert rows_of(QUERIES["op11_spelling_variants"](spark, "/root/testdata/sf0.001")) == plain_forms(plain_counts(small_docs, True))


@pytest.mark.parametrize("seed", range(3))
def test_near_pairs_equal_all_pairs(seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice([5, 6]))) for _ in range(150)}
    by = {k: sorted(w for w in words if len(w) == k) for k in (5, 6)}
    for a, b in ((by[5], None), (by[6], None), (by[5], by[6])):
        i, j = S.near_pairs(a, b)
        got = {(a[x], (b or a)[y]) for x, y in zip(i, j)}
        want = {(x, y) for p, x in enumerate(a) for q, y in enumerate(b or a) if (b or p < q) and is_near(x, y)}
        assert got == want


def test_long_words_use_exact_products():
    a = "ab" * 5000
    b, c = a[:77] + "x" + a[78:], a + "b"
    assert S.letter_counts(S.letters([a], len(a))).dtype == np.float64
    assert S.near_pairs([a, b])[0].tolist() == [0] and S.near_pairs([a, b], [c])[0].tolist() == [0]


def test_blocks_that_are_cut_meet_one_another(spark, make_docs, monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcd") for _ in range(rng.choice([5, 6, 7]))) for _ in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=120)).upper() if i % 2 else "-".join(rng.choices(words, k=150))) for i in range(30)]
    counts = S.word_counts(make_docs(rows))
    want = plain_forms(plain_counts(rows))
    assert rows_of(S.spelling_forms(counts)) == want
    monkeypatch.setattr(S, "BLOCK", 5)          # many groups and cut blocks
    assert rows_of(S.spelling_forms(counts)) == want
    monkeypatch.setattr(S, "group_count", lambda n: 2)
    assert rows_of(S.spelling_forms(counts)) == want


def test_roots_follow_long_chains(spark):
    chain = ["aaaaa" + "b" * i for i in range(12)]
    counts = spark.createDataFrame([(w, 3 * 2 ** i) for i, w in enumerate(chain)] + [("zzzzzz", 5)], "word string, n long")
    got = {r.word: r for r in S.spelling_forms(counts).collect()}
    assert {got[w].root for w in chain} == {chain[-1]} and got[chain[3]].form == chain[4] and got[chain[-1]].form is None
    assert (got["zzzzzz"].n_near, got["zzzzzz"].form, got["zzzzzz"].root) == (0, None, "zzzzzz")


def test_ties_go_to_the_first_spelling_and_ratio_counts(spark):
    rows = [("hallo", 4), ("hello", 8), ("hollo", 8), ("hullo", 7)]
    got = {r.word: (r.n_near, r.form, r.form_n, r.root) for r in
           S.spelling_forms(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == {"hallo": (3, "hello", 8, "hello"), "hello": (3, None, None, "hello"), "hollo": (3, None, None, "hollo"),
                   "hullo": (3, None, None, "hullo")}


def test_one_hot_document_and_long_texts(spark, make_docs, monkeypatch):
    monkeypatch.setattr(S, "SLICE", 64)
    monkeypatch.setattr(S, "HELD_WORDS", 7)
    rows = [(1, "Straße straße STRAßE çedilla " * 500 + "x" * 300 + " " + "漢字" * 200), (2, "çedilla çedilXa,çedilla"), (None, "straße " * 3)]
    got = {r.word: r.n for r in S.word_counts(make_docs(rows).repartition(3)).collect()}
    assert got == plain_counts(rows)


def test_odd_rows(make_docs):
    rows = [r for r in ODD if r[0] != 5] * 3
    assert rows_of(S.spelling_forms(S.word_counts(make_docs(rows), respell=_misspelt))) == plain_forms(plain_counts(rows, True))
    assert S.spelling_forms(S.word_counts(make_docs([]))).count() == 0
