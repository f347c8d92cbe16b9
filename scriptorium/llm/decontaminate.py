"""Benchmark decontamination with a broadcast set of test n-grams.

Test items are cut into windows of ``size`` consecutive normalised words (an
item of fewer words is one window of all of them).  The windows' 64-bit hashes
go to the tasks as sorted arrays; training texts are tokenised at byte level,
every window of a text is looked up by hash, and each hit is verified word by
word against the item before it counts.

Broadcast bound: at most ``chunk_windows`` windows at a time.  A larger test
set is cut into chunks by window hash, one pass over the documents each, and
the hit words of all passes are merged per document; nothing is dropped.

Inputs out of the ordinary: null text has no words; a null or wordless item
gives no window; items without an id count as one item, which is counted but
not named in ``item_ids``; repeated items, or items that share windows, are all
reported; repeated document rows are judged alike; clashing input columns are
replaced; an empty test set leaves every document clean.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NON_ALNUM, fold_case, shingle_hashes, string_buffers, text_slices, word_hashes, words

WINDOW = 13
CHUNK_WINDOWS = 1_000_000
NEW = ("n_words", "n_hit", "n_items", "item_ids", "hit_spans")


def test_windows(benchmark: DataFrame, size: int = WINDOW, id_col: str = "item_id",
                 text_col: str = "text") -> DataFrame:
    """(length, hash, words, item): one row per window of each item; ``words``
    is the window's normalised text, joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            b, o = string_buffers(rb.column(1))
            b, o = fold_case(b[o[0]:o[-1]]), o - o[0]
            s, e, of = words(b, o, NON_ALNUM)
            w = word_hashes(b, s, e)
            raw = b.tobytes()
            counts = np.bincount(of, minlength=len(o) - 1)
            firsts = np.concatenate(([0], np.cumsum(counts)))
            ids = rb.column(0).to_pylist()
            out = defaultdict(list)
            for i, n in enumerate(counts.tolist()):
                k = min(size, n)
                if not k:
                    continue
                own = slice(firsts[i], firsts[i + 1])
                h, at = shingle_hashes(w[own], of[own], k)
                for x, j in zip(h.tolist(), at.tolist()):
                    p = firsts[i] + j
                    out["length"].append(k)
                    out["hash"].append(x - (1 << 64) if x >> 63 else x)
                    out["words"].append(b" ".join(raw[s[q]:e[q]] for q in range(p, p + k)).decode("utf-8"))
                    out["item"].append(ids[i])
            kinds = [("length", pa.int32()), ("hash", pa.int64()), ("words", pa.string()), ("item", pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in kinds], names=[n for n, _ in kinds])

    return (benchmark.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string"), F.col(text_col))
            .mapInArrow(run, "length int, hash long, words string, item string").distinct())


class WindowSet:
    """Sorted hashes per window length; per hash the words and the items."""

    def __init__(self, rows):
        by = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
        for r in rows:
            by[r["length"]][r["hash"] % (1 << 64)][r["words"]].append(r["item"])
        self.sets = {k: (np.array(sorted(v), np.uint64), [v[h] for h in sorted(v)]) for k, v in by.items()}

    def hits(self, b: np.ndarray, offs: np.ndarray):
        """(words per text, per text the hit word mask, items, and the word spans)."""
        low = fold_case(b)
        s, e, of = words(low, offs, NON_ALNUM)
        w = word_hashes(low, s, e)
        cover = np.zeros(len(s) + 1, np.int32)
        items: dict[int, set[str | None]] = defaultdict(set)
        for k, (keys, found) in self.sets.items():
            h, at = shingle_hashes(w, of, k)
            if not len(h):
                continue
            # a table over 16 hash bits lets most windows go without a search
            seen = np.zeros(1 << 16, bool)
            seen[(keys >> np.uint64(48)).astype(np.int64)] = True
            maybe = np.flatnonzero(seen[(h >> np.uint64(48)).astype(np.int64)])
            pos = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
            ok = keys[pos] == h[maybe]
            for q, p in zip(at[maybe[ok]].tolist(), pos[ok].tolist()):
                text = b" ".join(low[s[x]:e[x]].tobytes() for x in range(q, q + k)).decode("utf-8", "replace")
                owners = found[p].get(text)
                if owners:
                    cover[q] += 1
                    cover[q + k] -= 1
                    items[int(of[q])].update(owners)
        return s, e, of, np.cumsum(cover[:-1]) > 0, items


def _scan(docs: DataFrame, text_col: str, rows, keep_text: bool) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = WindowSet(shared.value)
        for rb in batches:
            col = rb.column(rb.schema.get_field_index(text_col))
            n_words, n_hit, n_items, ids, spans = [], [], [], [], []
            for i, j, b, offs in text_slices(col):
                s, e, of, hit, items = tests.hits(b, offs)
                n_words += np.bincount(of, minlength=j - i).tolist()
                n_hit += np.bincount(of[hit], minlength=j - i).tolist()
                n_items += [len(items[x]) if x in items else 0 for x in range(j - i)]
                ids += [sorted(y for y in items[x] if y is not None) if x in items else [] for x in range(j - i)]
                runs = [[] for _ in range(j - i)]
                at = np.flatnonzero(hit)
                if len(at):     # maximal runs of hit words, as byte spans of their text
                    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(of[at]) > 0))
                    for x, y in zip(np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(at) - 1]))):
                        d = int(of[at[x]])
                        runs[d].append({"first": int(at[x]), "last": int(at[y]),
                                        "start": int(s[at[x]] - offs[d]), "end": int(e[at[y]] - offs[d])})
                first = np.searchsorted(of, np.arange(j - i))
                for d, r in enumerate(runs):
                    for x in r:
                        x["first"] -= int(first[d])
                        x["last"] -= int(first[d])
                spans += runs
            span = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
            keep = [(n, c) for n, c in zip(rb.schema.names, rb.columns) if keep_text or n != text_col]
            yield pa.RecordBatch.from_arrays(
                [*(c for _, c in keep), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array(n_items, pa.int64()), pa.array(ids, pa.list_(pa.string())),
                 pa.array(spans, pa.list_(span))], names=[*(n for n, _ in keep), *NEW])

    fields = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    tail = "n_words long, n_hit long, n_items long, item_ids array<string>, " \
           "hit_spans array<struct<first:long,last:long,start:long,end:long>>"
    return docs.mapInArrow(run, T.StructType([*fields, *T.StructType.fromDDL(tail).fields]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text_col: str = "text",
                       item_col: str = "item_id", item_text: str = "text", keep_text: bool = True,
                       chunk_windows: int = CHUNK_WINDOWS) -> DataFrame:
    """All columns plus n_words, n_hit (words inside any occurrence of a
    window), n_items, item_ids (sorted as strings) and hit_spans (maximal runs
    of hit words: word numbers, byte range).

    One pass over the documents per ``chunk_windows`` test windows.
    """
    docs = docs.drop(*[c for c in NEW if c in docs.columns])
    windows = test_windows(benchmark, size, item_col, item_text)
    n = windows.count()
    chunks = max(1, -(-n // chunk_windows))
    if chunks == 1:
        return _scan(docs, text_col, windows.collect(), keep_text)
    # windows of one hash stay together; a chunk holds its share of the hashes
    part = F.pmod(F.xxhash64("hash", "length"), F.lit(chunks))
    out = docs
    for c in range(chunks):
        rows = windows.filter(part == c).collect()
        out = _scan(out, text_col, rows, True)
        names = [f"_{x}_{c}" for x in NEW]
        for a, z in zip(NEW, names):
            out = out.withColumnRenamed(a, z)
    every = lambda x: [F.col(f"_{x}_{c}") for c in range(chunks)]
    unnamed = F.greatest(*[a - F.size(b) for a, b in zip(every("n_items"), every("item_ids"))])
    word_ids = F.array_distinct(F.flatten(F.array(*[
        F.flatten(F.transform(s, lambda r: F.sequence(r["first"], r["last"]))) for s in every("hit_spans")])))
    out = (out.withColumn("n_words", F.col("_n_words_0"))
           .withColumn("n_hit", F.size(word_ids).cast("long"))
           .withColumn("_unnamed", unnamed)
           .withColumn("item_ids", F.array_sort(F.array_distinct(F.flatten(F.array(*every("item_ids"))))))
           .withColumn("hit_spans", _merged(F.array_sort(F.flatten(F.array(*every("hit_spans"))))))
           .withColumn("n_items", (F.size("item_ids") + F.col("_unnamed")).cast("long")))
    keep = [c for c in docs.columns if keep_text or c != text_col]
    return out.select(*keep, *NEW)


def _merged(spans):
    """Sorted runs with overlapping or adjoining word numbers made one."""
    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"),
                          last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(last["last"] + 1 >= x["first"],
                      F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))) \
            .otherwise(F.concat(acc, F.array(x)))
    kind = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"
    return F.aggregate(spans, F.array().cast(kind), step)


def contaminated(share: int = 20):
    """The rule: some word is hit, and at least one word in ``share``."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def items_digest(ids) -> str:
    return sha256(",".join(ids).encode()).hexdigest()


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", **kw) -> DataFrame:
    """``documents``: drop contaminated documents.  ``spans``: cut the hit
    runs out of every text (byte ranges) and keep all documents."""
    kept = [c for c in docs.columns]
    text_col = kw.get("text_col", "text")
    found = find_contamination(docs, benchmark, **kw)
    if mode == "documents":
        return found.filter(~contaminated()).select(*kept)
    if mode != "spans":
        raise ValueError(f"mode: {mode}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            k = rb.schema.get_field_index(text_col)
            texts = []
            for t, spans in zip(rb.column(k).to_pylist(), rb.column(rb.schema.get_field_index("hit_spans")).to_pylist()):
                if spans:
                    raw, at, out = t.encode("utf-8"), 0, []
                    for x in spans:
                        out.append(raw[at:x["start"]])
                        at = x["end"]
                    t = b"".join([*out, raw[at:]]).decode("utf-8")
                texts.append(t)
            cols = {n: c for n, c in zip(rb.schema.names, rb.columns) if n != "hit_spans"}
            cols[text_col] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return found.select(*kept, "hit_spans").mapInArrow(cut, docs.schema)
