import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from scriptorium.llm import simhash as S
from scriptorium.llm.common import materialize

from .conftest import ODD


def term(words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h


def fingerprint(t):
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", t.lower()) if x]
    terms = [term(w[i:i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    fp = 0
    for k in range(64):
        if 2 * sum(h >> k & 1 for h in terms) > len(terms):
            fp |= 1 << k
    return fp


def near(a, b):
    return 1 - (a ^ b).bit_count() / 64


def brute(rows):
    """rows with unique ids"""
    low = -(1 << 63)
    order = sorted(rows, key=lambda r: low if r[0] is None else r[0], reverse=True)
    out = []
    for i, (d, t, *_) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        edited = t[:len(t) - k] + nxt[:k]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(t), fingerprint(edited), fingerprint(nxt)))
    return sorted(out, key=str)


def run(df, **kw):
    u = lambda x: x % (1 << 64)
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, u(r.fp), u(r.edited_fp), u(r.next_fp))
                   for r in S.fingerprints(df, **kw).collect()), key=str)


ROWS = [(i, t) for i, t in ODD if i not in (4, 5, 6, 7)] + [(40, "word"), (41, "x" * 30_000), (-7, "one two three four five six " * 300)]


@pytest.mark.parametrize("ranges", [1, 2, 7, 300])
def test_matches_brute_force(make_docs, ranges):
    assert run(make_docs(ROWS).repartition(3), ranges=ranges) == brute(ROWS)


def test_small_documents(make_docs, small_docs):
    rows = small_docs[::3]
    assert run(make_docs(rows)) == brute(rows)


def test_one_row_repeats_and_empty_table(make_docs):
    (r,) = S.fingerprints(make_docs([(5, "a b c d e f g h i")])).collect()
    assert r.fp == r.next_fp                                    # it is its own next document
    got = S.fingerprints(make_docs([(5, "a b c"), (5, "a b c"), (5, "other words here"), (4, "")]), ranges=5).collect()
    assert len(got) == 4 and len({r.fp for r in got if r.n_chars == 5}) == 1
    assert S.fingerprints(make_docs([])).count() == 0


def test_likeness_tells_edits_from_strangers(spark, small_docs, make_docs):
    got = S.fingerprints(make_docs([r for r in small_docs if len(r[1]) > 1500])).select(
        S.likeness(F.col("fp"), F.col("edited_fp")).alias("e"), S.likeness(F.col("fp"), F.col("next_fp")).alias("n")).collect()
    assert sum(r.e for r in got) / len(got) > 0.65 > 0.6 > sum(r.n for r in got) / len(got)


@pytest.mark.parametrize("radius,blocks", [(0, 2), (3, 4), (3, 5), (4, 7)])
def test_block_tables_find_all(spark, radius, blocks):
    rng = random.Random(radius)
    fps = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    for f in list(fps):
        for k in range(1, 7):
            x = f
            for b in rng.sample(range(64), k):
                x ^= 1 << b
            fps.append(x)
    fps += fps[:20]
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    df = materialize(spark.createDataFrame(signed, "doc_id long, fp long"), "fps")
    got = S.near_counts(df, F.col("doc_id") % 5 == 0, radius, blocks).collect()
    n = Counter(fps)
    want = {i: sum(c for g, c in n.items() if (f ^ g).bit_count() <= radius) - 1 if i % 5 == 0 else None for i, f in enumerate(fps)}
    assert {r.doc_id: r.n_near for r in got} == want and len(got) == len(fps)
    pairs = S.near_fingerprints(df, df, radius, blocks)
    assert pairs.count() == pairs.distinct().count() == sum((f ^ g).bit_count() <= radius for f in n for g in n)


def test_query(spark, small_docs):
    from scriptorium.llm.queries import QUERIES
    got = QUERIES["op3_simhash"](spark, "/root/testdata/sf0.001").collect()
    want = brute(small_docs)
    mine = sorted(((r.doc_id, r.n_chars, r.edited_sha256, int(r.fingerprint, 16), int(r.edited_fingerprint, 16)) for r in got), key=str)
    assert mine == [w[:5] for w in want]
    by = {w[0]: w for w in want}
    assert all(r.near_edited == near(by[r.doc_id][3], by[r.doc_id][4]) and r.near_next == near(by[r.doc_id][3], by[r.doc_id][5]) for r in got)


def shingles(w):
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def edited_pairs(texts, n, seed=5):
    """(Jaccard of the five-word shingles by brute force, text, the text with some words replaced)"""
    rng = random.Random(seed)
    texts = [t.split() for t in texts if t and len(t.split()) >= 30]
    out = []
    while len(out) < n:
        w = rng.choice(texts)
        e = list(w)
        for _ in range(rng.randint(1, max(1, len(w) // 30))):
            e[rng.randrange(len(e))] = f"e{rng.randrange(10 ** 6)}"
        a, b = shingles([x.lower() for x in w]), shingles([x.lower() for x in e])
        out.append((len(a & b) / len(a | b), " ".join(w), " ".join(e)))
    return out


def recall_by_similarity(make_docs, texts, n, bands):
    """Per band of Jaccard: pairs, and the share whose fingerprints lie within RADIUS bits."""
    pairs = edited_pairs(texts, n)
    rows = [(2 * i + k, t[k + 1]) for i, t in enumerate(pairs) for k in (0, 1)]
    fp = {r.doc_id: r.fp % (1 << 64) for r in S.fingerprints(make_docs(rows)).select("doc_id", "fp").collect()}
    near = [(p[0], (fp[2 * i] ^ fp[2 * i + 1]).bit_count() <= S.RADIUS) for i, p in enumerate(pairs)]
    return {b: (sum(b[0] <= j < b[1] for j, _ in near), sum(ok for j, ok in near if b[0] <= j < b[1])) for b in bands}


def test_radius_covers_nearly_equal_texts_only(make_docs, small_docs):
    """What README states: n_near is no search for texts of similarity 0.8."""
    got = recall_by_similarity(make_docs, [t for _, t, *_ in small_docs], 1500, [(0.78, 0.86), (0.97, 1.01)])
    (n, low), (m, high) = got.values()
    assert n > 100 and m > 10
    assert low < 0.15 * n and high > 0.45 * m
