import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from scriptorium.llm import ppm as P

from .conftest import ODD


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def plain_ppm(train, texts, order):
    """PPM with escape and exclusion, symbol by symbol."""
    seen = defaultdict(Counter)
    seen[b""]
    for t in train:
        b = b"\0" * order + t
        for i in range(order, len(b)):
            for k in range(order + 1):
                seen[b[i - k:i]][b[i]] += 1
    out = []
    for t in texts:
        b, lp = b"\0" * order + t, 0.0
        for i in range(order, len(b)):
            gone, p, k = set(), 1.0, order
            while k >= 0 and b[i - k:i] not in seen:
                k -= 1
            while k >= 0:
                n = {s: c for s, c in seen[b[i - k:i]].items() if s not in gone}
                room = len(gone) + len(n) < 256
                tot = sum(n.values()) + len(n) * room
                if b[i] in n:
                    p *= n[b[i]] / tot
                    break
                p *= len(n) / tot if tot else 1.0
                gone |= set(n)
                k -= 1
            else:
                p *= 1 / (256 - len(gone))
            lp += math.log10(p)
        out.append(lp)
    return out


def test_nothing_to_learn_from(make_docs):
    assert P.score_documents(make_docs([])).count() == 0


def base(rows):
    tok = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "").encode().split() + [None]
    c = Counter(w for r in rows if not held(r[0]) for w in tok(r[1]))
    n, v = sum(c.values()), len(c)
    out = []
    for r in rows:
        w = tok(r[1])
        out.append((r[0], held(r[0]), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + .1) / (n + .1 * (v + 1))) for x in w)))
    return sorted(out, key=str)


def check(rows, df):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in P.score_documents(df).collect()), key=str)
    want = base(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)


def test_word_baseline(make_docs, small_docs, monkeypatch):
    rows = small_docs + [(i + 5000 if i else None, t) for i, t in ODD]
    check(rows, make_docs(rows).repartition(3))


def test_model_beats_simpler_ones_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = P.score_documents(docs).filter("held_out").toPandas()
    n = docs.toPandas().set_index("doc_id")["text"].map(lambda t: len((t or "").encode()))
    size = got["doc_id"].map(n)
    train = "".join(t or "" for i, t in docs.select("doc_id", "text").toPandas().itertuples(index=False) if not held(i)).encode()
    c = np.bincount(np.frombuffer(train, np.uint8), minlength=256) / len(train)
    entropy = -(c[c > 0] * np.log10(c[c > 0])).sum()
    assert -got["score"].sum() / size.sum() < 0.75 * entropy        # well below single-byte code length
    again = P.score_documents(docs.repartition(7)).filter("held_out").toPandas().sort_values("doc_id")
    assert np.allclose(again["score"], got.sort_values("doc_id")["score"], rtol=1e-6)


def same_scores(rows, df, **kw):
    got = sorted(((r.doc_id, r.score) for r in P.score_documents(df, **kw).collect()), key=str)
    texts = [(t or "").encode() for _, t in rows]
    order = kw.get("order", P.ORDER)
    want = sorted(zip((i for i, _ in rows), plain_ppm([t for (i, _), t in zip(rows, texts) if not held(i)], texts, order)), key=str)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=1e-5, abs=1e-5)


@pytest.mark.parametrize("order", [0, 1, 4])
def test_scores_match_plain_ppm(make_docs, small_docs, order):
    rows = [(i, t[:400]) for i, t, *_ in small_docs[:60]] + [(None, "no id é"), (900, None), (901, ""), (902, "zzz 漢字 \0\0 qq")]
    same_scores(rows, make_docs(rows).repartition(3), order=order)


def test_rare_contexts_stay_in_the_model(make_docs):
    # "qzxj" holds far less than 1/8192 of all bytes, and its next byte is known from training
    train = [i for i in range(40) if not held(i)]
    out = next(i for i in range(100, 200) if held(i))
    rows = [(i, "the cat sat on the mat " * 100) for i in train] + [(90 if not held(90) else 91, "qzxjw qzxjw")] + [(out, "qzxjw")]
    same_scores(rows, make_docs(rows))
