"""LM scoring: prediction by partial matching over bytes, with a word baseline.

The model is a trie of byte contexts up to ``ORDER`` bytes, read backwards
from the byte to predict.  A context predicts its seen symbols with c / (n + d)
(n occurrences, d distinct symbols) and escapes with d / (n + d) to the next
shorter context, in which the symbols already seen in the longer one are
excluded; below the empty context all unseen bytes are equally likely.  Counts
come from every training document and every context counted is a node of the
model, however rare: there is no floor, and no bound on the nodes.

The model is never in one place.  Documents are reduced batch by batch to
distinct (ORDER + 1)-grams and words; a batch asks, per hash block, for each of
them once.  The asked grams, with their training counts, are one table; level
by level from the empty context, each gram's row meets the row of its suffix
(``gram_scores``), which gives the log probability of its last byte.  A context
has at most 256 symbols and is the suffix of at most 256 contexts, so no group
of these joins is larger than that.  The answers meet the batch's texts again.
The word baseline asks for corpus counts in the same way.

Inputs out of the ordinary: null and empty texts have one token (the end) and
PPM score 0; a row with null id is a training row; repeated rows count and are
scored each; an empty training set scores all bytes alike; extra columns are
ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (SLICE_BYTES, SPACES, fold_case, is_in_fold, materialize, mix, pack, pack_sorted, shuffle_partitions,
                     text_slices, unpack, unpack_sorted, word_hashes, words)

ORDER = 4
FLUSH_TOKENS = 1_000_000
FLUSH_BYTES = 8 << 20
END = mix(np.array([0x656E64], np.uint64))[0]       # the end token's hash


def _grams(b: np.ndarray, offs: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the ``order`` bytes before it, most recent last, as one
    integer; before a text stand zero bytes."""
    n = len(offs) - 1
    doc = np.repeat(np.arange(n), np.diff(offs))
    at = np.arange(len(b)) + (doc + 1) * order
    padded = np.zeros(len(b) + n * order, np.uint8)
    padded[at] = b
    g = padded[at].astype(np.int64)
    for j in range(1, order + 1):
        g |= padded[at - j].astype(np.int64) << (8 * j)
    return g


# ------------------------------------------------------------- full model ---
def _gram_blocks(g: np.ndarray, parts: int) -> np.ndarray:
    """The hash block of each gram."""
    return ((mix(g.astype(np.uint64)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _sum_by(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and their sums."""
    by = np.argsort(keys, kind="stable")
    keys, n = keys[by], n[by]
    firsts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[firsts], np.add.reduceat(n, firsts)


def _places(g: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(distinct sorted grams, how often each, their places in ``g`` in that order), piece by piece."""
    bits = min(20, 64 - 8 * (order + 1))        # gram and place are sorted as one integer
    for i in range(0, len(g), 1 << bits):
        x = g[i:i + (1 << bits)].astype(np.uint64)
        x = np.sort(x << np.uint64(bits) | np.arange(len(x), dtype=np.uint64))
        at = (x & np.uint64((1 << bits) - 1)).astype(np.int64) + i
        x >>= np.uint64(bits)
        firsts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        yield x[firsts].astype(np.int64), np.diff(np.concatenate((firsts, [len(x)]))), at


def _asked(group: pd.DataFrame) -> pd.DataFrame:
    """One hash block: its distinct asked grams with their training counts (0: only in held-out texts)."""
    g, n = _sum_by(np.concatenate([unpack_sorted(x) for x in group["a"]]),
                   np.concatenate([unpack(x, np.int64) for x in group["b"]]))
    return pd.DataFrame({"gram": g.astype(np.int64), "block": np.int32(group["block"].iloc[0]), "n": n})


def gram_scores(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, block and logp: log10 of the probability of the gram's last byte after its other bytes.

    ``grams`` is a written table (gram, block, n) of distinct grams, with all of the training texts among
    them.  On each level a row has n, its context's occurrences and distinct symbols (all_n, all_d), v (the
    log probability when prediction starts at this context) and w (the same when it comes from this context
    escaping, after the exclusion of its symbols).
    """
    levels = [grams]
    for level in reversed(range(order)):
        mask = (1 << (8 * (level + 1))) - 1
        short = levels[0].groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.sum("n").alias("n"))
        levels.insert(0, materialize(short, f"ppm-level-{level}"))
    n, up_n = F.col("n"), F.col("up_n")
    state = None
    for level, rows in enumerate(levels):
        context = Window.partitionBy(F.shiftright("gram", 8))
        if level:
            mask = (1 << (8 * level)) - 1
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(mask))).join(state, "suffix").drop("suffix")
            rows = rows.withColumn("shared", F.sum(F.when(n > 0, up_n)).over(context))
        rows = (rows.withColumn("all_n", F.sum("n").over(context))
                .withColumn("all_d", F.sum((n > 0).cast("long")).over(context)))
        all_n, all_d = F.col("all_n"), F.col("all_d")
        if level:       # what the suffix's context has besides the symbols excluded
            more = F.col("up_d") - all_d
            left = F.col("up_all") - F.coalesce("shared", F.lit(0)) + F.when(F.col("up_d") < 256, more).otherwise(0)
            w = F.when(up_n > 0, F.log10(F.try_divide(up_n, left))) \
                .otherwise(F.when(more > 0, F.log10(F.try_divide(more, left))).otherwise(0.0) + F.col("up_w"))
        else:
            w = F.when(all_d < 256, -F.log10((256 - all_d).cast("double")))
        rows = rows.withColumn("w", w)
        # a context that has seen every byte never escapes
        v = F.when(n > 0, F.log10(n / (all_n + F.when(all_d < 256, all_d).otherwise(0)))) \
            .when(all_n > 0, F.log10(all_d / (all_n + all_d)) + F.col("w")).otherwise(F.col("up_v") if level else F.col("w"))
        rows = rows.withColumn("v", v)
        state = rows.select(F.col("gram").alias("suffix"), n.alias("up_n"), all_n.alias("up_all"), all_d.alias("up_d"),
                            F.col("v").alias("up_v"), F.col("w").alias("up_w"))
    return rows.select("gram", "block", F.col("v").cast("float").alias("logp"))


def _gram_answers(asks: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """One hash block: the log probabilities every batch asked for, in the order asked."""
    g, v = known["gram"].to_numpy(), known["logp"].to_numpy().astype(np.float32)
    by = np.argsort(g)
    g, v = g[by], v[by]
    rows = [(f, b, pack(v[np.searchsorted(g, unpack_sorted(a).astype(np.int64))]))
            for f, b, a in zip(asks["flush"], asks["block"], asks["a"])]
    return pd.DataFrame(rows, columns=["flush", "block", "c"])


# ------------------------------------------------------------ word counts ---
def _reduce(parts: int, order: int):
    """Documents to batches.  Rows: kinds 'ask' and 'grams' (flush, block,
    distinct word hashes or grams, their training counts) and kind 'docs'
    (flush, texts, per document: id, fold, tokens, bytes; its distinct words as
    numbers into the flush's sorted words, and how often each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("flush", pa.string()), ("block", pa.int32()), ("a", pa.binary()), ("b", pa.binary()),
                            ("docs", pa.binary()), ("texts", pa.binary()), ("kind", pa.string())])
        held, grams, size, base, n_bytes = [], [], 0, 0, 0

        def flush():
            nonlocal held, grams, size, base, n_bytes
            if not held:
                return
            name = uuid.uuid4().hex
            h, doc = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            ids, out, null = (np.concatenate([x[k] for x in held]) for k in (2, 3, 4))
            raw, lens = np.concatenate([x[5] for x in held]), np.concatenate([x[6] for x in held])
            tokens = np.bincount(doc, minlength=len(ids))
            vocab, word = np.unique(h, return_inverse=True)
            counts = np.bincount(word, weights=~out[doc], minlength=len(vocab)).astype(np.int64)
            pair = np.sort(doc * len(vocab) + word)
            firsts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            tf = np.diff(np.concatenate((firsts, [len(pair)])))
            pair = pair[firsts]
            block = ((vocab >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(block, np.arange(parts + 1))
            rows = [{"flush": name, "block": p, "a": pack_sorted(vocab[x:y]), "b": pack(counts[x:y]), "kind": "ask"}
                    for p, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
            if grams:
                g, n = _sum_by(np.concatenate([x for x, _ in grams]), np.concatenate([x for _, x in grams]))
                block = _gram_blocks(g, parts)
                by = np.argsort(block, kind="stable")
                g, n, cuts = g[by].astype(np.uint64), n[by], np.searchsorted(block[by], np.arange(parts + 1))
                rows += [{"flush": name, "block": p, "a": pack_sorted(g[x:y]), "b": pack(n[x:y]), "kind": "grams"}
                         for p, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
            table = pa.table({"doc_id": pa.array(ids, mask=null), "held_out": out, "n_tokens": tokens, "bytes": lens,
                              "words": np.bincount(pair // len(vocab), minlength=len(ids))})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            # word numbers ascend inside a document, so differences are small
            word = pair % len(vocab)
            step = np.diff(word, prepend=0)
            first = np.concatenate(([True], np.diff(pair // len(vocab)) > 0))
            step[first] = word[first]
            rows.append({"flush": name, "block": -1, "a": pack(step.astype(np.uint32)), "b": pack(tf.astype(np.uint32)),
                         "docs": sink.getvalue().to_pybytes(), "texts": pack(raw), "kind": "docs"})
            held, grams, size, base, n_bytes = [], [], 0, 0, 0
            for r in rows:
                yield pa.RecordBatch.from_pylist([r], schema=schema)

        for rb in batches:
            ids = rb.column(0)
            null = np.array(ids.is_null())
            ids = ids.fill_null(0).to_numpy()
            fold = rb.column(2).to_numpy(zero_copy_only=False)
            for i, j, b, offs in text_slices(rb.column(1)):
                low = fold_case(b)
                s, e, of = words(low, offs, SPACES)
                k = j - i
                h = np.concatenate((word_hashes(low, s, e), np.full(k, END)))
                lens = np.diff(offs)
                held.append((h, np.concatenate((of, np.arange(k))) + base, ids[i:j], fold[i:j], null[i:j], b.copy(), lens))
                if len(b):
                    trains = np.repeat(~fold[i:j], lens).astype(np.int64)
                    x, c = np.unique(_grams(b, offs, order) << 1 | trains, return_counts=True)
                    grams.append(_sum_by(x >> 1, c * (x & 1)))
                base, size, n_bytes = base + k, size + len(h), n_bytes + len(b)
                if size >= FLUSH_TOKENS or n_bytes >= FLUSH_BYTES:
                    yield from flush()
        yield from flush()
    return run


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """One hash block: corpus counts for every question, and the block's totals."""
    keys = [unpack_sorted(x) for x in group["a"]]
    counts = [unpack(x, np.int64) for x in group["b"]]
    vocab, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(counts), minlength=len(vocab)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    rows = [(f, b, pack(total[p]), 0, 0) for f, b, p in
            zip(group["flush"], group["block"], np.split(place, ends[:-1]))]
    rows.append(("", int(group["block"].iloc[0]), None, int((total > 0).sum()), int(total.sum())))
    return pd.DataFrame(rows, columns=["flush", "block", "c", "distinct", "tokens"])


def _text_scores(raw: np.ndarray, lens: np.ndarray, c: list[bytes], parts: int, order: int) -> np.ndarray:
    """log10 probability of each of a flush's texts; ``c`` has the answers to its distinct grams, block by block."""
    out = np.zeros(len(lens))
    if not len(raw):
        return out
    offs = np.concatenate(([0], np.cumsum(lens)))
    slices, i = [], 0
    while i < len(lens):
        j = min(len(lens), max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE_BYTES, "right")) - 1))
        slices.append((i, j))
        i = j
    cut = lambda i, j: _grams(raw[offs[i]:offs[j]], offs[i:j + 1] - offs[i], order)
    vocab = np.unique(np.concatenate([np.unique(cut(i, j)) for i, j in slices]))
    v = np.empty(len(vocab))
    v[np.argsort(_gram_blocks(vocab, parts), kind="stable")] = np.concatenate([unpack(x, np.float32) for x in c])
    for i, j in slices:
        g = cut(i, j)
        if not len(g):
            continue
        own = np.empty(len(g))
        for x, times, at in _places(g, order):
            own[at] = np.repeat(v[np.searchsorted(vocab, x)], times)
        full = i + np.flatnonzero(lens[i:j])
        out[full] = np.add.reduceat(own, offs[full] - offs[i])
    return out


def _meet(docs: pd.DataFrame, answers: pd.DataFrame, parts: int, order: int) -> pd.DataFrame:
    """A flush's documents with the counts of its words, which come block by block in hash order, and its texts'
    scores."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "gain", "score"]
    if not len(docs):
        return pd.DataFrame(columns=names)
    answers = answers.sort_values("block")
    c = np.concatenate([unpack(x, np.int64) for x in answers["c"][answers["kind"] == "ask"]])
    row = docs.iloc[0]
    t = pa.ipc.open_stream(row["docs"]).read_all()
    step, tf = unpack(row["a"], np.uint32).astype(np.int64), unpack(row["b"], np.uint32).astype(np.int64)
    n = t["words"].to_numpy()
    firsts = np.concatenate(([0], np.cumsum(n)[:-1]))
    run = np.cumsum(step)
    word = run - np.repeat(run[firsts] - step[firsts], n)
    own = c[word]
    out = t.select(["doc_id", "held_out", "n_tokens"]).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
    out["n_known"] = np.add.reduceat(tf * (own > 0), firsts)
    out["gain"] = np.add.reduceat(tf * np.log10(own + 0.1), firsts)
    out["score"] = _text_scores(unpack(row["texts"], np.uint8), t["bytes"].to_numpy(),
                                answers["c"][answers["kind"] == "grams"].tolist(), parts, order)
    return out[names]


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 10,
                    order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score
    (PPM log10 probability of the text's bytes) of every row."""
    out = is_in_fold(F.col(id_col), mod, 0)
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    ddl = "flush string, block int, a binary, b binary, docs binary, texts binary, kind string"
    batches = materialize(docs.select(F.col(id_col).cast("long"), F.col(text_col), out.alias("held_out"))
                          .mapInArrow(_reduce(parts, order), ddl), "word-batches", partition_by="kind")
    ask = batches.filter("kind = 'ask'").select("flush", "block", "a", "b")
    answers = materialize(ask.groupBy("block").applyInPandas(
        _answer, "flush string, block int, c binary, distinct long, tokens long"), "word-counts")
    n, v = answers.filter("flush = ''").agg(F.coalesce(F.sum("tokens"), F.lit(0)),
                                            F.coalesce(F.sum("distinct"), F.lit(0))).first()
    asked = batches.filter("kind = 'grams'")
    grams = materialize(asked.select("block", "a", "b").groupBy("block")
                        .applyInPandas(_asked, "gram long, block int, n long"), "ppm-grams")
    scored = materialize(asked.select("flush", "block", "a").groupBy("block")
                         .cogroup(gram_scores(grams, order).groupBy("block"))
                         .applyInPandas(_gram_answers, "flush string, block int, c binary"), "gram-answers")
    answers = (answers.filter("flush <> ''").select("flush", "block", "c", F.lit("ask").alias("kind"))
               .unionByName(scored.withColumn("kind", F.lit("grams"))))

    def meet(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return _meet(docs, answers, parts, order)

    met = (batches.filter("kind = 'docs'").select("flush", "a", "b", "docs", "texts").groupBy("flush")
           .cogroup(answers.groupBy("flush"))
           .applyInPandas(meet, "doc_id long, held_out boolean, n_tokens long, n_known long, gain double, score double"))
    per_token = F.log10(F.lit(float(n)) + F.lit(0.1) * (v + 1))
    return met.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"),
                      (F.col("gain") - F.col("n_tokens") * per_token).alias("base_score"), "score")
