"""Registered semantic-search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vector as VV
from ..sources import tables as tb
from ..sources.tables import DOCS_SQL, PENDING_SQL, with_ctes
from .registry import register

K = 10
BATCH_K = 5
QUERY_LABEL = 0          # vectors with this label serve as the query block
NEW_LABEL = 1            # vectors with this label are re-upserted
DIGITS = 6


def _query_vec(spark, d):
    """The query vector: the table's first vector (smallest id)."""
    e = tb.table(spark, d, "embeddings")
    r = e.orderBy("vec_id").select("embedding").first()
    return [float(x) for x in r["embedding"]]


QVEC_SQL = ("(SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"
            "::DOUBLE[]")
COS_SQL = f"round(list_cosine_similarity(embedding::DOUBLE[], {QVEC_SQL}), {DIGITS})"


@register("vector_topk", f"SELECT vec_id AS id, {COS_SQL} AS score FROM embeddings "
          f"ORDER BY score DESC, id LIMIT {K}")
def q_vector_topk(spark, d):
    e = tb.table(spark, d, "embeddings")
    return VV.vector_topk(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")),
                          _query_vec(spark, d), K, round_digits=DIGITS)


@register("vector_topk_batch", f"""
SELECT q.vec_id AS qid, c.vec_id AS id,
       round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), {DIGITS}) AS score,
       CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY
         round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), {DIGITS}) DESC,
         c.vec_id) AS INTEGER) AS rank
FROM embeddings q, embeddings c WHERE q.label = {QUERY_LABEL}
QUALIFY rank <= {BATCH_K}""")
def q_vector_topk_batch(spark, d):
    e = tb.table(spark, d, "embeddings")
    corpus = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    queries = e.filter(F.col("label") == QUERY_LABEL).select(
        F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    return VV.vector_topk_batch(corpus, queries, BATCH_K, round_digits=DIGITS)


def vector_index(spark, d):
    """The vector index: id = six-digit paper id, metadata from the paper."""
    from ..functions.text import pad_id
    e = tb.table(spark, d, "embeddings")
    docs = tb.docs(spark, d).select(F.col("paper_id").alias("vec_id"), "paper_title")
    return (e.join(docs, "vec_id", "left")
            .select(pad_id("vec_id").alias("id"), F.col("embedding").alias("vec"),
                    F.struct(pad_id("vec_id").alias("archive_id"), F.col("paper_title").alias("title"),
                             F.col("vec_id").alias("paper_id")).alias("metadata")))


PAD = ("CASE WHEN length(CAST(vec_id AS VARCHAR)) >= 6 THEN CAST(vec_id AS VARCHAR) "
       "ELSE lpad(CAST(vec_id AS VARCHAR), 6, '0') END")


@register("semantic_search", with_ctes(DOCS_SQL) + f"""
, top AS (SELECT vec_id, {COS_SQL} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT {K})
SELECT t.score, {PAD.replace('vec_id', 't.vec_id')} AS archive_id, d.paper_title AS title,
       d.paper_id, d.abstract
FROM top t LEFT JOIN docs d ON d.paper_id = t.vec_id""")
def q_semantic_search(spark, d):
    details = tb.docs(spark, d).select("archive_id", "paper_id", "abstract")
    out = VV.semantic_search(vector_index(spark, d), _query_vec(spark, d), details, K, DIGITS)
    return out.select("score", "archive_id", "title", "paper_id", "abstract")


@register("hydrate_hits", with_ctes(DOCS_SQL) + f"""
, top AS (SELECT vec_id, {COS_SQL} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT {K})
SELECT t.vec_id AS paper_id, t.score, d.archive_id, d.paper_title
FROM top t LEFT JOIN docs d ON d.paper_id = t.vec_id""")
def q_hydrate_hits(spark, d):
    e = tb.table(spark, d, "embeddings")
    hits = VV.vector_topk(e.select(F.col("vec_id").alias("paper_id"), F.col("embedding").alias("vec")),
                          _query_vec(spark, d), K, "paper_id", "vec", DIGITS)
    details = tb.docs(spark, d).select("paper_id", "archive_id", "paper_title")
    return VV.hydrate_hits(hits, details, "paper_id")


@register("upsert_vectors", with_ctes(DOCS_SQL) + f"""
SELECT {PAD} AS id, CASE WHEN label = {NEW_LABEL} THEN coalesce(d.paper_title, '') ELSE 'v0' END AS title,
       round(CAST(embedding[1] AS DOUBLE) * CASE WHEN label = {NEW_LABEL} THEN -1 ELSE 1 END, {DIGITS}) AS v1
FROM embeddings e LEFT JOIN docs d ON d.paper_id = e.vec_id""")
def q_upsert_vectors(spark, d):
    """V2: the index holds every vector (metadata title 'v0'); vectors of one
    label are re-embedded (negated) with fresh metadata and upserted."""
    from ..functions.text import pad_id
    e = tb.table(spark, d, "embeddings")
    old = e.select(pad_id("vec_id").alias("id"), F.col("embedding").alias("vec"),
                   F.struct(F.lit("v0").alias("title")).alias("metadata"))
    docs = tb.docs(spark, d).select(F.col("paper_id").alias("vec_id"), "paper_title")
    new = (e.filter(F.col("label") == NEW_LABEL).join(docs, "vec_id", "left")
           .select(pad_id("vec_id").alias("id"),
                   F.transform("embedding", lambda x: -x).alias("vec"),
                   F.struct(F.coalesce("paper_title", F.lit("")).alias("title")).alias("metadata")))
    out = VV.upsert_vectors(old, new)
    return out.select("id", F.col("metadata.title").alias("title"),
                      F.round(F.col("vec")[0].cast("double"), DIGITS).alias("v1"))


def _embedded(spark, d):
    return VV.embed_pending(tb.pending(spark, d), VV.hash_embedder(64))


@register("embed_pending", with_ctes(DOCS_SQL, PENDING_SQL) + f"""
SELECT paper_id, archive_id,
       CAST(floor((row_number() OVER (ORDER BY paper_id) - 1) / {VV.EMBED_BATCH}) AS BIGINT) AS batch,
       CAST(NULL AS VARCHAR) AS error, 64 AS dim
FROM pending""")
def q_embed_pending(spark, d):
    r = _embedded(spark, d)
    return r.select("paper_id", "archive_id", "batch", "error", F.size("vec").alias("dim"))


@register("embed_summary", with_ctes(DOCS_SQL, PENDING_SQL) + """
SELECT count(*) AS embedded, CAST(0 AS BIGINT) AS remaining,
       '' AS errors FROM pending""")
def q_embed_summary(spark, d):
    """A8 with a deterministic embedder that never fails: every selected
    paper is embedded; remaining = selected - embedded = 0."""
    r = _embedded(spark, d)
    emb = r.filter(F.col("error").isNull()).select("paper_id")
    after = tb.pending(spark, d).join(emb, "paper_id", "left_anti")
    s = VV.embed_summary(r, after)
    return s.select("embedded", "remaining", F.array_join("errors", "|").alias("errors"))


@register("embed_summary_failing", with_ctes(DOCS_SQL, PENDING_SQL) + f"""
, batches AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY paper_id) - 1) / {VV.EMBED_BATCH}) AS BIGINT) AS batch FROM pending),
bad AS (SELECT DISTINCT batch FROM batches WHERE paper_title LIKE 'T%')
SELECT count(*) FILTER (WHERE batch NOT IN (FROM bad)) AS embedded, count(*) FILTER (WHERE batch IN (FROM bad)) AS remaining,
       coalesce((SELECT string_agg('Batch ' || batch || ': rejected title', '|' ORDER BY batch) FROM bad), '') AS errors
FROM batches""")
def q_embed_summary_failing(spark, d):
    """A8 with an embedder that refuses batches holding a title that starts with T."""
    def embed(texts):
        if any(t.startswith("T") for t in texts):
            raise ValueError("rejected title")
        return [[1.0] for _ in texts]
    r = VV.embed_pending(tb.pending(spark, d), embed)
    emb = r.filter(F.col("error").isNull()).select("paper_id")
    after = tb.pending(spark, d).join(emb, "paper_id", "left_anti")
    s = VV.embed_summary(r, after)
    return s.select("embedded", "remaining", F.array_join("errors", "|").alias("errors"))
