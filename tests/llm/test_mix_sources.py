import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import mix_sources as M

from .conftest import ODD


def size(t):
    return len("".join(c if c.isascii() or not c.isspace() else "x" for c in t or "").translate(
        {i: "x" for i in (0x1C, 0x1D, 0x1E, 0x1F)}).split())


def targets(rows):
    n = defaultdict(int)
    for r in rows:
        n[r[3]] += size(r[1])
    order = sorted(n, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(n.values()), set()
    while True:     # reshare the excess until none is above
        free = [s for s in order if s not in capped]
        rest = total - sum(2 * n[s] for s in capped)
        goal = {s: 2.0 * n[s] if s in capped else rest * w[s] / sum(w[f] for f in free) for s in order}
        over = {s for s in free if goal[s] > 2 * n[s] + 1e-9}
        if not over:
            return n, goal
        capped |= over


def corpus(rng, n=300):
    src = ["a", "b", None, "", "Zed", "é", "漢"]
    out = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 50, 400])), None, rng.choice(src + ["a"] * 6)) for i in range(n)]
    return out + [(i, t, None, "odd") for i, t in ODD] + [(7, "one two", None, "b"), (7, "one two", None, "b")]


@pytest.mark.parametrize("block", [M.BLOCK, 7, 100_000])
def test_targets_and_taken(make_docs, block):
    rows = corpus(random.Random(3))
    n, goal = targets(rows)
    got = M.taken_words(make_docs(rows).repartition(5), block=block).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), size(r[1])) for r in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    key = defaultdict(set)
    for r in got:
        key[r.source_size, round(r.target, 6)].add(r.doc_id)
    assert {(n[s], round(goal[s], 6)) for s in n} == set(key)
    took = defaultdict(int)
    for r in got:
        took[r.source_size, round(r.target, 6)] += r.taken
    for (_, t), k in took.items():
        assert 0 <= t - k < 2 * sum((n[s], round(goal[s], 6)) == (_, t) for s in n)


def test_reruns_agree_whatever_the_partitions(make_docs):
    rows = corpus(random.Random(4), 120)
    a, b = (sorted(map(tuple, M.taken_words(make_docs(rows).repartition(p)).collect()), key=str) for p in (1, 9))
    assert a == b


def test_schedule_follows_the_weights(spark, make_docs):
    rows = [(i, "w " * 100, None, "abc"[i % 3]) for i in range(600)]
    sized, pieces = M.mix(make_docs(rows), block=50)
    p = pieces.groupBy("slot").agg(F.countDistinct("src").alias("s"), F.sum("words").alias("w")).collect()
    # a slot is one block of one source; only a source's last block is partial
    assert all(r.s == 1 and r.w <= 50 for r in p) and sum(r.w < 50 for r in p) <= 3
    goal = {r.src: r.target for r in sized.select("src", "target").distinct().collect()}
    order = [r.src for r in pieces.select("slot", "src").distinct().orderBy("slot").collect()]
    total = sum(goal.values())
    for k in (60, 300, 900):        # every prefix is close to the target shares
        for s, g in goal.items():
            assert abs(order[:k].count(s) - k * g / total) <= 4
    full = pieces.groupBy("src").agg(F.sum("words").alias("w")).collect()
    assert {r.src: r.w for r in full} == {s: int(g) for s, g in goal.items()}


def plain_schedule(goal, block):
    """{(source, rank): slot} of the golden-ratio schedule and its tail."""
    order = [s for s in sorted(goal, key=lambda s: (s is None, s or "")) if goal[s] > 0]
    total, have, out = sum(goal[s] for s in order), defaultdict(int), {}
    for k in range(math.ceil(total / block)):
        x, end = (k + 0.5) * M.PHI, 0.0
        x = (x - math.floor(x)) * total
        for s in order:
            end += goal[s]
            if x < end:
                out[s, have[s]] = k
                have[s] += 1
                break
    k = math.ceil(total / block)
    for s in order:
        for r in range(have[s], math.ceil(math.floor(goal[s]) / block)):
            out[s, r] = k
            k += 1
    return out


def test_slots_equal_the_plain_schedule(spark, make_docs):
    rows = corpus(random.Random(8))
    n, goal = targets(rows)
    sized, pieces = M.mix(make_docs(rows).repartition(3), block=32)
    key = {(s is None, s or ""): s for s in goal}
    by_src = {("1" if s is None else "0" + s): s for s in key.values()}
    want = plain_schedule(goal, 32)
    got = {(by_src[r.src], r.block): r.slot for r in pieces.select("src", "block", "slot").distinct().collect()}
    assert got == {k: v for k, v in want.items() if k in got} and len(got) >= sum(math.floor(g) // 32 for g in goal.values())
    first = {}
    for r in pieces.collect():
        first[r.row] = min(first.get(r.row, r.slot), r.slot)
    ids = {r.row: r.doc_id for r in sized.collect()}
    taken = M.taken_words(make_docs(rows).repartition(3), block=32).collect()
    assert sorted(((r.doc_id, r.first_slot) for r in taken if r.first_slot is not None), key=str) == sorted(((ids[k], v) for k, v in first.items()), key=str)
    assert all((r.first_slot is None) == (r.taken == 0) for r in taken)


def test_without_slots_nothing_is_taken(make_docs, monkeypatch):
    plain = M.schedule
    monkeypatch.setattr(M, "schedule", lambda t, block: plain(t, block).filter("src <> '0a'"))
    rows = [(i, "w " * 100, None, "ab"[i % 2]) for i in range(40)]
    got = M.taken_words(make_docs(rows), block=50).collect()
    assert all(r.taken == 0 and r.first_slot is None for r in got if r.doc_id % 2 == 0)
    assert sum(r.taken for r in got) > 0


def test_many_sources(make_docs):
    rows = [(i, "w " * (1 + i % 9), None, f"s{i % 500:03d}") for i in range(1500)]
    n, goal = targets(rows)
    took = defaultdict(int)
    by_id = {r[0]: r[3] for r in rows}
    for r in M.taken_words(make_docs(rows), block=4).collect():
        took[by_id[r.doc_id]] += r.taken
    assert {s: math.floor(g) for s, g in goal.items()} == dict(took)


def test_empty_tables(make_docs):
    assert M.taken_words(make_docs([])).count() == 0
    got = M.taken_words(make_docs([(1, None), (2, "  ")])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
