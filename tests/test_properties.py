"""Property tests (hypothesis): Spark column functions against plain-Python
statements of the same rules; algebraic properties of set operators."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import relations as R
from scriptorium.operators import search as S

JS_WS = "\t\n\x0b\x0c\r   " + "".join(chr(c) for c in range(0x2000, 0x200B)) + \
    "    　﻿"
SPLIT1 = re.compile(r"[,;](?![^{\[(<]*[\])}>])")
SPLIT2 = re.compile(" ·|-|–||/ ")


def js_trim(s):
    return s.strip(JS_WS)


def ref_split(s):
    return [js_trim(p) for part in SPLIT1.split(s) for p in SPLIT2.split(part)]


def ref_normalize(s):
    s = re.sub("[\x00-\x1f\x7f-\x9f]", "", s).replace('"', "'")
    return js_trim(re.sub(f"[{re.escape(JS_WS)}]+", " ", s))


ALPHABET = st.sampled_from(list("ab ,;()[]{}<>-/·–\"\n\t 　\x85\x01xy"))
TEXTS = st.lists(st.text(ALPHABET, max_size=24), min_size=1, max_size=30)


@settings(max_examples=15, deadline=None)
@given(TEXTS)
def test_split_and_normalize_match_reference(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    rows = df.select("i", T.split_keywords("s").alias("k"), T.normalize_text("s").alias("n")).collect()
    for r in rows:
        assert r.k == ref_split(texts[r.i]), texts[r.i]
        assert r.n == ref_normalize(texts[r.i]), texts[r.i]


IDS = st.lists(st.tuples(st.integers(0, 30), st.integers(0, 1000)), max_size=40)


@settings(max_examples=10, deadline=None)
@given(IDS, IDS)
def test_merge_keep_existing_idempotent(spark, ex, new):
    schema = "id string, seq long"
    e = spark.createDataFrame([(str(i), s) for i, s in ex], schema)
    n = spark.createDataFrame([(str(i), s) for i, s in new], schema)
    once = R.merge_keep_existing(e, n, "id", "seq")
    twice = R.merge_keep_existing(once, n, "id", "seq")
    a = [tuple(r) for r in once.collect()]
    assert a == [tuple(r) for r in twice.collect()]
    assert [int(x[0]) for x in a] == sorted({i for i, _ in ex} | {i for i, _ in new})


WORDS = st.lists(st.sampled_from(["syntax", "phonology", "the", "of", "cat", "dog"]), min_size=1, max_size=12)


@settings(max_examples=8, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=12))
def test_search_total_equals_unpaged_count(spark, docs):
    df = spark.createDataFrame([(i, f"{i:06d}", "", " ".join(w), "", "") for i, w in enumerate(docs)],
                               "paper_id long, archive_id string, title string, abstract string, "
                               "keywords string, authors string")
    idx = S.build_postings(df)
    q = S.any_of("syntax", S.phrase("the cat"))
    total = S.match_count(idx, q).first().total
    assert total == S.bm25_rank(idx, q).count()
    expect = sum(1 for w in docs if "syntax" in w or any(w[j:j + 2] == ["the", "cat"] for j in range(len(w))))
    assert total == expect
    page = S.search_page(idx, q, limit=3, offset=1).collect()
    assert len(page) == max(0, min(3, total - 1))


def ref_abstract(s):
    s = s.replace('"', "'").replace("\n", " ")
    return js_trim(re.sub(f"[{re.escape(JS_WS)}]+", " ", s))


RESERVED = set(";/?:@&=+$,#")


def ref_decode_uri(s):
    """JavaScript decodeURI; None where it would throw."""
    out, i, n = [], 0, len(s)
    while i < n:
        if s[i] != "%":
            out.append(s[i])
            i += 1
            continue
        m = re.match(r"%([0-9A-Fa-f]{2})", s[i:])
        if not m:
            return None
        b0 = int(m.group(1), 16)
        if b0 < 0x80:
            ch = chr(b0)
            out.append(s[i:i + 3] if ch in RESERVED else ch)
            i += 3
            continue
        k = 2 if b0 >> 5 == 6 else 3 if b0 >> 4 == 14 else 4 if b0 >> 3 == 30 else 0
        if not k:
            return None
        bs = [b0]
        for j in range(1, k):
            m2 = re.match(r"%([0-9A-Fa-f]{2})", s[i + 3 * j:])
            if not m2:
                return None
            bs.append(int(m2.group(1), 16))
        try:
            out.append(bytes(bs).decode("utf-8"))
        except UnicodeDecodeError:
            return None
        i += 3 * k
    return "".join(out)


URI_ALPHABET = st.sampled_from(["%2F", "%2f", "%20", "%41", "%C3%A9", "%E2%82%AC", "%C3", "%zz", "%",
                                "+", "a", "/", "#", "%23", "%25", "é", " "])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(URI_ALPHABET, max_size=8).map("".join), min_size=1, max_size=30), TEXTS)
def test_decode_uri_and_abstract_match_reference(spark, uris, texts):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(uris)], "i int, s string")
    for r in df.select("i", T.decode_uri("s").alias("d")).collect():
        assert r.d == ref_decode_uri(uris[r.i]), uris[r.i]
    df2 = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    for r in df2.select("i", T.parse_abstract("s").alias("a")).collect():
        assert r.a == ref_abstract(texts[r.i]), texts[r.i]
