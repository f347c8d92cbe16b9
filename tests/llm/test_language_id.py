import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import language_id as L
from scriptorium.llm.queries import QUERIES

from .conftest import ODD


@pytest.mark.parametrize("n", [2, 3, 4, 7, 8, 20])
def test_codewords_are_apart(n):
    c = L.code_book(n)
    apart = [(c[i] != c[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) * 2 >= c.shape[1] - 1 and (n > 7 or len({tuple(x) for x in c.T}) == c.shape[1])


def test_held_out_accuracy(spark):
    got = QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").filter("held_out").collect()
    assert len(rows) > 200 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95


def test_labels_ids_and_sources_are_not_inputs(make_docs, small_docs):
    model = L.fit(make_docs(small_docs))
    a = L.predict(make_docs(small_docs), model).select("text", "lang_pred", F.col("score")).collect()
    b = L.predict(make_docs([(1, t, None, None) for _, t, _, _ in small_docs]), model).select("text", "lang_pred", "score").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_odd_rows(make_docs):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("le chat est sur le tapis", "fr"),
                                                         ("die katze ist auf der matte", "de"), (None, "xx"), ("no label", None)] * 3)]
    model = L.fit(make_docs(train))
    assert model.languages == ["de", "en", "fr"]
    rows = ODD + [(20, "1234 !!"), (21, "ß"), (22, "漢字"), (23, "the mat"), (24, "")]
    got = {r.doc_id: r for r in L.predict(make_docs(rows), model).collect()}
    und = {i for i, r in got.items() if r.lang_pred == "und"}
    assert und == {1, 2, 3, 8, 20, 24} and all(got[i].score == 0 and got[i].ambiguous for i in und)
    assert got[23].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    assert L.predict(make_docs([]), model).count() == 0


def test_few_languages(make_docs):
    none = L.fit(make_docs([(1, "text", None)]))
    assert [r.lang_pred for r in L.predict(make_docs([(1, "text")]), none).collect()] == ["und"]
    one = L.fit(make_docs([(1, "text", "en")]))
    assert [(r.lang_pred, r.score) for r in L.predict(make_docs([(1, "text")]), one).collect()] == [("en", 1.0)]


def plain_features(text):
    """Counts of hashed byte trigrams with at most one blank, letters folded, other ASCII made blanks."""
    b = [32, *(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in (text or "").encode()), 32]
    out = Counter()
    for t in zip(b, b[1:], b[2:]):
        if t.count(32) <= 1:
            key = t[0] << 16 | t[1] << 8 | t[2]
            out[(key * 2654435761 % (1 << 32)) >> (32 - (L.DIMS.bit_length() - 1))] += 1
    return out


def plain_ecoc(train, texts):
    """(language, score) of each text: codewords, linear bits and loss-weighted decoding with plain dictionaries."""
    langs = sorted({lang for _, lang in train}, key=str.encode)
    words = [[0] * ((1 << (len(langs) - 1)) - 1)] + [
        [k >> i & 1 for k in range(1, 1 << (len(langs) - 1))] for i in range(len(langs) - 1)]
    assert len(langs) <= 7 and words == L.code_book(len(langs)).tolist()
    counts = {x: Counter() for x in langs}
    for t, lang in train:
        counts[lang].update(plain_features(t))
    total = {x: sum(c.values()) + L.SMOOTH * L.DIMS for x, c in counts.items()}
    bits = range(len(words[0]))

    def weight(bit, f):
        side = {0: [], 1: []}
        for x, w in zip(langs, words):
            side[w[bit]].append((counts[x][f] + L.SMOOTH) / total[x])
        return math.log(sum(side[1]) / len(side[1])) - math.log(sum(side[0]) / len(side[0]))
    known = {}

    def margins(text):
        fs = plain_features(text)
        n = sum(fs.values())
        for f in fs:
            if f not in known:
                known[f] = [weight(k, f) for k in bits]
        return [sum(c * known[f][k] for f, c in fs.items()) / n if n else 0.0 for k in bits]
    right = [0] * len(bits)
    for t, lang in train:
        for k, m in enumerate(margins(t)):
            right[k] += (m > 0) == (words[langs.index(lang)][k] > 0)
    share = [(r + 1) / (len(train) + 2) for r in right]
    trust = [max(0.05, math.log(s / (1 - s))) for s in share]
    trust = [t * len(trust) / sum(trust) for t in trust]
    out = []
    for text in texts:
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        m = margins(text)
        loss = [sum(t * math.log1p(math.exp(-L.SHARPNESS * x if b else L.SHARPNESS * x)) for t, x, b in zip(trust, m, w)) for w in words]
        best = min(range(len(langs)), key=lambda i: loss[i])
        out.append((langs[best], 1 / sum(math.exp(loss[best] - x) for x in loss)))
    return out


def test_query_equals_a_plain_version(spark, small_docs):
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in small_docs}
    train = [(t, lang) for i, t, lang, _ in small_docs if not held[i] and t is not None and lang is not None]
    want = dict(zip((r[0] for r in small_docs), plain_ecoc(train, [r[1] for r in small_docs])))
    got = {r.doc_id: r for r in QUERIES["op10_language_id"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(small_docs) == len(want)
    for i, (lang, score) in want.items():
        assert (got[i].lang_pred, got[i].held_out) == (lang, held[i]) and got[i].score == pytest.approx(score, abs=1e-3)
