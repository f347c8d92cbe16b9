import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import common as C

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB \té\n漢-1", max_size=20)), max_size=8)


def slices(texts, most=8):
    return list(C.text_slices(pa.array(texts, pa.string()), most))


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_slices_and_words(texts):
    seen, found = [], []
    for i, j, b, offs in slices(texts):
        seen += range(i, j)
        s, e, of = C.words(C.fold_case(b), offs, C.SPACES)
        found += [(i + int(o), C.fold_case(b)[x:y].tobytes()) for x, y, o in zip(s, e, of)]
    want = [(i, w) for i, t in enumerate(texts) for w in
            "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()]
    assert seen == list(range(len(texts))) and found == want


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_equal_words_have_equal_hashes(texts):
    by = {}
    for _, _, b, offs in slices(texts, 1 << 20):
        s, e, _ = C.words(b, offs, C.SPACES)
        for x, y, h in zip(s, e, C.word_hashes(b, s, e).tolist()):
            assert by.setdefault(b[x:y].tobytes(), h) == h
    assert len(set(by.values())) == len(by)


def test_shingle_sets():
    texts = ["a b c d e f", "A B C D E F", None, "", "one two", "ONE two", "a b c d e a b c d e"]
    (_, _, b, offs), = slices(texts, 1 << 20)
    h, t = C.shingle_sets(b, offs, 5)
    sets = [frozenset(h[t == i].tolist()) for i in range(len(texts))]
    assert sets[0] == sets[1] and len(sets[0]) == 2 and sets[2] == sets[3] == frozenset()
    assert sets[4] == sets[5] and len(sets[4]) == 1 and len(sets[6]) == 5 and sets[0] & sets[6]


def test_packed_columns_round_trip():
    a = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64))
    assert (C.unpack_sorted(C.pack_sorted(a)) == a).all() and (C.unpack(C.pack(a[::-1]), np.uint64) == a[::-1]).all()
    assert len(C.unpack_sorted(C.pack_sorted(a[:0]))) == 0


def test_join_back_with_a_hot_key(spark):
    left = spark.range(20000).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 700).alias("k"))
    right = C.materialize(left.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")).filter("k <> 5"), "t")
    got = C.join_back(left, right, ["k"], "n", "id", "left")
    assert got.columns == ["k", "id", "low"] and got.count() == 20000
    assert got.filter("low is null").select("k").distinct().collect()[0].k == 5
    assert got.filter("k = -1 and low = 0").count() == 6667


def test_connected_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(7000, 7000)]
    edges += [(5000, i) for i in range(5001, 5200)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for x in root if any(y != x and find(y) == find(x) for y in root)}
    for at_once in (C.EDGES_AT_ONCE, 100, 0):       # in one task, by rounds and then in one task, by rounds alone
        got = C.connected_components(spark.createDataFrame(edges, "a long, b long"), at_once=at_once).collect()
        assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert C.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_written_counts_while_writing(spark):
    df, seen = C.written(spark.range(1000, numPartitions=7).withColumn("x", F.col("id") % 3), "t", n=F.count("*"), s=F.sum("x"))
    assert seen == {"n": 1000, "s": 999} and df.count() == 1000
    df, seen = C.written(spark.range(0), "t", n=F.count("*"), s=F.sum("id"))
    assert not seen.get("n") and seen.get("s") is None and df.count() == 0
