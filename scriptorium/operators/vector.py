"""Semantic search (V1-V5, J7): embedding job, vector upsert, exact top-k.

* One query vector (V4): cosine score as built-in array expressions
  (``zip_with`` + ``aggregate``, JVM side, codegen'd), then an ordered
  ``limit`` = TakeOrderedAndProject (per-partition heap of k, one merge).
* Many query vectors (V5): the query block is broadcast *after a size
  check* and each corpus partition is scored against it tile by tile (a
  bounded block of rows x queries) in ``mapInPandas``; a partition keeps a
  running top-k per query and emits it once, so the final top-k per query
  ranks at most k x partitions rows.  Query blocks larger than the broadcast budget are processed in
  chunks - one pass over the corpus per chunk - never dropped.
* Embedding (V1): all pending papers (or the first ``limit``), fixed-size
  batches in id order (W3); each batch is one ``applyInPandas`` group of at most
  ``batch_size`` rows calling a caller-supplied embed function.  A failing
  batch is recorded and the other batches continue.
"""

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import embedding_text
from .relations import batch_assign, unembedded_papers

# Fixed limits of the semantic endpoint's request argument.
DEFAULT_K, MIN_K, MAX_K = 10, 1, 50
EMBED_BATCH = 100
BROADCAST_BUDGET = 64 * 1024 * 1024       # bytes of query vectors per pass
TILE_CELLS = 4 * 1024 * 1024              # scores held at once in a task (8 bytes each)


def clamp_k(k) -> int:
    """The request argument rule - leading integer of the text, default
    10, within [1, 50].  Operators take any k; callers clamp requests."""
    if k is None:
        return DEFAULT_K
    m = re.match(r"\s*[+-]?\d+", str(k))
    return min(max(int(m.group()) if m else DEFAULT_K, MIN_K), MAX_K)


def cosine_col(vec: Column, q) -> Column:
    """cos(vec, q) with built-ins; q is a Python list of floats.  A zero
    vector on either side scores 0; a null vector scores null."""
    qv = [float(x) for x in q]
    qn = math.sqrt(sum(x * x for x in qv)) or 1.0
    qarr = F.array(*[F.lit(x) for x in qv])
    v = vec.cast("array<double>")
    dot = F.aggregate(F.zip_with(v, qarr, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    nrm = F.sqrt(F.aggregate(F.transform(v, lambda a: a * a), F.lit(0.0), lambda acc, x: acc + x))
    return F.when(v.isNotNull(), F.coalesce(F.try_divide(dot, nrm * F.lit(qn)), F.lit(0.0)))


def vector_topk(vectors: DataFrame, query, k=None, id_col: str = "id", vec_col: str = "vec",
                round_digits: int | None = None, keep: tuple = ()) -> DataFrame:
    """V4/T5: (id, score, *keep) of the k nearest vectors by cosine, score
    desc.  ``keep`` columns ride along through the top-k (no join back).
    Rows without a vector are not ranked."""
    k = DEFAULT_K if k is None else int(k)
    vectors = vectors.filter(F.col(vec_col).isNotNull())
    s = cosine_col(F.col(vec_col), query)
    if round_digits is not None:
        s = F.round(s, round_digits)
    return (vectors.select(F.col(id_col).alias(id_col), s.alias("score"), *keep)
            .orderBy(F.desc("score"), id_col).limit(k))


def _topk_block(qids: np.ndarray, qmat: np.ndarray, k: int, round_digits):
    """Running top-k of a partition: tiles of rows x queries, merged into k kept rows per query."""
    qn = qmat / np.where((n := np.linalg.norm(qmat, axis=1, keepdims=True)) == 0, 1.0, n)
    nq = len(qn)

    def run(it):
        best_s, best_i = np.full((0, nq), -np.inf), np.zeros((0, nq), np.int64)
        for pdf in it:
            pdf = pdf[pdf["vec"].notna()]
            step = max(1, TILE_CELLS // max(1, nq))
            for x in range(0, len(pdf), step):
                part = pdf.iloc[x:x + step]
                m = np.stack(part["vec"].map(lambda v: np.asarray(v, dtype=np.float64)).to_list())
                m = m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1.0, n)
                sc = m @ qn.T
                if round_digits is not None:
                    sc = np.round(sc, round_digits)
                ids = np.broadcast_to(part["id"].to_numpy()[:, None], sc.shape)
                sc, ids = np.concatenate((best_s, sc)), np.concatenate((best_i, ids))
                if len(sc) > k:         # score desc, id asc: rows at the k-th score compete by id
                    kth = -np.partition(-sc, k - 1, axis=0)[k - 1]
                    rank = np.where(sc > kth, 0, np.where(sc == kth, 1, 2))
                    order = np.lexsort((ids, rank), axis=0)[:k]
                    sc, ids = np.take_along_axis(sc, order, 0), np.take_along_axis(ids, order, 0)
                best_s, best_i = sc, ids
        if len(best_s):
            yield pd.DataFrame({"qid": np.tile(qids, len(best_s)), "id": best_i.reshape(-1), "score": best_s.reshape(-1)})
    return run


def vector_topk_batch(corpus: DataFrame, queries: DataFrame, k=None, id_col: str = "id",
                      vec_col: str = "vec", qid_col: str = "qid", qvec_col: str = "vec",
                      round_digits: int | None = None,
                      budget_bytes: int = BROADCAST_BUDGET) -> DataFrame:
    """V5: exact top-k per query for a block of queries.

    The query block is read to the driver only after its size is checked
    (count x (dimension + 2 k) x 8 bytes, the running top-k included); beyond
    ``budget_bytes`` it is split into chunks, each scored in its own pass and
    unioned.  Zero and null vectors: as in :func:`vector_topk`.
    """
    k = DEFAULT_K if k is None else int(k)
    spark = corpus.sparkSession
    queries = queries.filter(F.col(qvec_col).isNotNull())
    dim_row = queries.select(F.size(qvec_col).alias("d")).agg(
        F.count("*").alias("n"), F.max("d").alias("d")).first()
    n, d = int(dim_row["n"] or 0), int(dim_row["d"] or 0)
    if n == 0 or k < 1:
        return spark.createDataFrame([], f"{qid_col} long, {id_col} long, score double, rank int")
    per_chunk = max(1, budget_bytes // max(1, (d + 2 * k) * 8))
    c = corpus.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    parts = []
    qi = queries.select(F.col(qid_col).alias("qid"), F.col(qvec_col).alias("qvec"))
    n_chunks = (n + per_chunk - 1) // per_chunk
    for ch in range(n_chunks):
        if n_chunks == 1:
            block = qi
        else:
            block = qi.filter(F.pmod(F.xxhash64("qid"), F.lit(n_chunks)) == ch)
        rows = block.collect()          # bounded by the budget check above
        if not rows:
            continue
        qids = np.array([r["qid"] for r in rows])
        qmat = np.array([np.asarray(r["qvec"], dtype=np.float64) for r in rows])
        bq = spark.sparkContext.broadcast((qids, qmat))
        fn = _topk_from_broadcast(bq, k, round_digits)
        parts.append(c.mapInPandas(fn, "qid long, id long, score double"))
    cand = parts[0]
    for p in parts[1:]:
        cand = cand.unionByName(p)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    out = cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out.select(F.col("qid").alias(qid_col), F.col("id").alias(id_col), "score",
                      F.col("rank").cast("int").alias("rank"))


def _topk_from_broadcast(bq, k, round_digits):
    def run(it):
        qids, qmat = bq.value
        yield from _topk_block(qids, qmat, k, round_digits)(it)
    return run


def hydrate_hits(hits: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Hits left-joined to details; order kept.

    The details table is first cut to the hit ids by a semi join, then two
    small sides are joined; Spark broadcasts the hits where their size allows.
    """
    d = details.join(hits.select(key).distinct(), key, "left_semi")
    return hits.join(d, key, "left").orderBy(F.desc("score"), key)


def semantic_search(index: DataFrame, query_vec, details: DataFrame, k=None,
                    round_digits: int | None = None) -> DataFrame:
    """V3: top-k over the vector index, hydrated with paper details.

    ``index``: id (text id), vec, metadata struct<archive_id, title,
    paper_id>.  Output: score, archive_id, title (metadata or null), and
    the detail columns (null when the paper is gone)."""
    top = vector_topk(index, query_vec, k, "id", "vec", round_digits, keep=("metadata",))
    hits = top.select("score", F.col("id").alias("archive_id"), F.col("metadata.title").alias("title"))
    return hydrate_hits(hits, details, "archive_id")


def upsert_vectors(index: DataFrame, new: DataFrame) -> DataFrame:
    """V2: replace by id (values and metadata) or insert."""
    return index.join(new.select("id"), "id", "left_anti").unionByName(new.select(*index.columns))


def hash_embedder(dim: int = 64):
    """Deterministic stand-in for the hosted model: hashed token counts,
    L2-normalised.  Runs inside tasks (vectorised per batch)."""
    import regex
    import xxhash

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim), dtype=np.float64)
        for i, t in enumerate(texts):
            for tok in regex.findall(r"[\p{L}\p{N}]+", (t or "").lower()):
                h = xxhash.xxh64_intdigest(tok)
                out[i, h % dim] += 1.0 if (h >> 32) & 1 else -1.0
        nrm = np.linalg.norm(out, axis=1, keepdims=True)
        out = out / np.where(nrm == 0, 1.0, nrm)
        return out.astype(np.float32).tolist()
    return embed


EMBED_OUT = ("paper_id long, archive_id string, paper_title string, vec array<float>, "
             "batch long, error string")


def embed_pending(pending: DataFrame, embed_fn, limit: int | None = None,
                  batch_size: int = EMBED_BATCH) -> DataFrame:
    """V1: embed all pending papers (or the first ``limit``) in batches of ``batch_size``.

    Output: one row per selected paper with its vector, or a null vector and
    the batch's error (``Batch i: message``).
    """
    sel = unembedded_papers(pending, limit)
    b = batch_assign(sel, ["paper_id"], batch_size)

    def per_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("paper_id")
        i = int(pdf["batch"].iloc[0])
        texts = [f"{t}. {a if a is not None else ''}" for t, a in zip(pdf["paper_title"], pdf["abstract"])]
        try:
            vecs = embed_fn(texts)
            if not isinstance(vecs, (list, tuple)) or len(vecs) != len(pdf):
                raise ValueError("Unexpected embedding response shape")
            return pd.DataFrame({"paper_id": pdf["paper_id"], "archive_id": pdf["archive_id"],
                                 "paper_title": pdf["paper_title"], "vec": list(vecs),
                                 "batch": pdf["batch"], "error": None})
        except Exception as e:  # noqa: BLE001 - one failed batch must not stop the others
            return pd.DataFrame({"paper_id": pdf["paper_id"], "archive_id": pdf["archive_id"],
                                 "paper_title": pdf["paper_title"], "vec": None,
                                 "batch": pdf["batch"], "error": f"Batch {i}: {e}"})
    return b.groupBy("batch").applyInPandas(per_batch, EMBED_OUT)


def embed_summary(results: DataFrame, pending_after: DataFrame) -> DataFrame:
    """Embedded count, remaining (selected - embedded when anything is
    still pending afterwards, else 0), distinct batch errors in order."""
    left = pending_after.limit(1).count()
    failed = F.when(F.col("error").isNotNull(), F.struct("batch", "error"))      # nulls are not collected
    agg = results.agg(F.count("*").alias("selected"),
                      F.count_if(F.col("error").isNull()).alias("embedded"),
                      F.array_sort(F.collect_set(failed)).alias("_e"))
    return agg.select(
        "embedded",
        (F.col("selected") - F.col("embedded") if left > 0 else F.lit(0).cast("long")).alias("remaining"),
        F.transform("_e", lambda s: s["error"]).alias("errors"))


def vectors_from_embeddings(results: DataFrame) -> DataFrame:
    """Successful V1 rows -> vector-index rows with metadata."""
    ok = results.filter(F.col("error").isNull())
    return ok.select(F.col("archive_id").alias("id"), "vec",
                     F.struct("archive_id", F.col("paper_title").alias("title"), "paper_id")
                     .alias("metadata"))


def embedding_texts(papers: DataFrame) -> DataFrame:
    return papers.select("paper_id", embedding_text("paper_title", "abstract").alias("text"))


def embed_job(papers: DataFrame, index: DataFrame, embed_fn, now=None, limit: int | None = None,
              batch_size: int = EMBED_BATCH):
    """V1 + V2 + M9 + A8: embed pending papers, upsert the successful
    batches into the vector index, mark exactly those papers embedded, and
    summarise.  ``papers`` has paper_id, archive_id, paper_title, abstract
    and ``embedded_at``.  Returns (next index, next papers, summary, rows).
    Failed batches change nothing and are listed in the summary.
    """
    from .mutate import mark_embedded
    res = embed_pending(papers, embed_fn, limit, batch_size)
    ok = res.filter(F.col("error").isNull())
    index_next = upsert_vectors(index, vectors_from_embeddings(res).select(*index.columns))
    papers_next = mark_embedded(papers, ok.select("paper_id"), now)
    after = papers_next.filter(F.col("embedded_at").isNull())
    return index_next, papers_next, embed_summary(res, after), res
