"""Nearest neighbours by inner product from randomly rotated one-bit codes.

Index.  A vector is turned by a random rotation (its unit form is first
followed by zeros up to the code length, so a code may hold several bits per
component) and only the signs are kept, packed.  Two correction scalars go
with a code: f, the inner product of the rotated unit vector with its own code
(a unit vector of +-1/sqrt(bits)), and the vector's length.

Search.  With c the code and q the rotated query, <c, q> / f estimates the
inner product with the unit vector; its error is like that of a random
direction orthogonal to the code: sqrt((1 - f*f) / (f*f * (bits - 1))) times
``epsilon`` bounds it with the probability of ``epsilon`` normal deviations.
Vectors whose upper bound reaches the best k-th score known for the query are
reranked by exact double-precision scores; others are left.

Rows are dealt into even blocks.  Blocks are searched in rounds of which each
holds ``GROWTH`` times the blocks of all before: a round's exact k-th scores
are the next one's thresholds, so a query reranks some ``k * GROWTH`` vectors
a round plus those that the bounds can't tell apart.  Within the first round,
a block's own k-th lower bound is the threshold.  Every row is indexed and
every code is compared; nothing is capped, and what the bounds lose is
measured as recall (``recall_at``).

Inputs out of the ordinary: zero vectors take no part; see ``vector_blocks``
for nulls, non-finite components, repeated ids and vectors of other lengths.
Rows with the query's own id are no candidates of it.  Ties go to the smaller
id.  Without queries or without other rows the result is empty; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vector_blocks import block_count, dealt, matrix, meet, usable

K = 20
BITS_PER_COMPONENT = 4
EPSILON = 3.0
GROWTH = 16
SEED = 20130
TILE = 256                  # queries estimated at once
PAIRS = 1 << 15             # pairs reranked at once

_CODED = "block int, id long, vec array<double>, code binary, f double, length double"
_HITS = "query_id long, id long, score double"


def rotation(dims: int, bits: int, seed: int = SEED) -> np.ndarray:
    """The first ``dims`` rows of a random orthogonal matrix of ``bits`` columns."""
    g = np.random.Generator(np.random.PCG64(seed)).standard_normal((bits, dims))
    q, r = np.linalg.qr(g)
    return np.ascontiguousarray((q * np.sign(np.diag(r))).T)


def code_bits(dims: int, per_component: int) -> int:
    """Bits of a code: whole bytes, and no fewer than the dimensions."""
    return max(8, -(-max(1, dims) * max(1, per_component) // 8) * 8)


def units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, lengths), whatever the size of the components."""
    most = np.abs(vectors).max(axis=1, initial=0.0)
    small = vectors / np.where(most > 0, most, 1)[:, None]
    length = np.sqrt((small * small).sum(axis=1))
    return small / np.where(length > 0, length, 1)[:, None], length * most


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, f, length) of each row."""
    unit, length = units(vectors)
    turned = unit @ turn
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1]), length


def estimates(codes: np.ndarray, f: np.ndarray, length: np.ndarray, queries: np.ndarray, turn: np.ndarray,
              epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner products, half-widths of their bounds), a row per query."""
    bits = turn.shape[1]
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32)
    unit, size = units(queries)
    turned = (unit @ turn).astype(np.float32)
    # <2 s - 1, q> over the +-1 signs, from the 0/1 bits
    along = 2 * (turned @ signs.T) - turned.sum(axis=1, keepdims=True)
    width = epsilon * np.sqrt(np.maximum(0, 1 - f * f) / (f * f * max(1, bits - 1))) + 1e-6
    return along * (length / f / np.sqrt(bits)) * size[:, None], width * length * size[:, None]


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed component by component: equal vectors give equal scores wherever they lie."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _search(k: int, dims: int, bits: int, epsilon: float, seed: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and rows.num_rows:
            turn = rotation(dims, bits, seed)
            ids, vectors = rows["id"].to_numpy(), matrix(rows["vec"], dims)
            codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
            f, length = rows["f"].to_numpy(), rows["length"].to_numpy()
            who, asked, known = queries["id"].to_numpy(), matrix(queries["vec"], dims), queries["threshold"].to_numpy()
            for i in range(0, len(who), TILE):
                q, own = asked[i:i + TILE], who[i:i + TILE, None] == ids[None, :]
                est, width = estimates(codes, f, length, q, turn, epsilon)
                lower, least = np.where(own, -np.inf, est - width), known[i:i + TILE].copy()
                if len(ids) > k:
                    np.maximum(least, np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k], out=least)
                at, col = np.nonzero(~(est + width < least[:, None]) & ~own)
                score = np.concatenate([np.zeros(0), *(exact_scores(q[at[j:j + PAIRS]], vectors[col[j:j + PAIRS]])
                                                       for j in range(0, len(at), PAIRS))])
                good = score >= known[i:i + TILE][at]
                at, col, score = at[good], col[good], score[good]
                order = np.lexsort((ids[col], -score, at))
                at, col, score = at[order], col[order], score[order]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                found.append((who[i:i + TILE][at][place < k], ids[col][place < k], score[place < k]))
        parts = [np.concatenate([np.zeros(0, t), *(x[j] for x in found)]) for j, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table(dict(zip(("query_id", "id", "score"), parts)))
    return run


def _coded(dims: int, bits: int, seed: int):
    def run(batches):
        turn = rotation(dims, bits, seed)
        for rb in batches:
            codes, f, length = encode(matrix(rb.column("vec"), dims), turn)
            yield pa.RecordBatch.from_arrays(
                [rb.column("block"), rb.column("id"), rb.column("vec"), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array(f), pa.array(length)], names=["block", "id", "vec", "code", "f", "length"])
    return run


def _leading(hits: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", place).filter(F.col("rank") <= k)


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
           bits_per_component: int = BITS_PER_COMPONENT, epsilon: float = EPSILON, seed: int = SEED) -> DataFrame:
    """query_id, rank, id, score: the k nearest rows found for each row that satisfies ``is_query`` (a condition on
    the column ``id``)."""
    rows = usable(df, id_col, vec_col).filter(F.exists("vec", lambda x: x != 0))
    rows = materialize(rows.select("id", F.col("vec").cast("array<double>").alias("vec"),
                                   F.coalesce(is_query, F.lit(False)).alias("query")), "searched-rows")
    n, dims, n_queries = rows.agg(F.count("*"), F.max(F.size("vec")), F.count_if("query")).first()
    dims = dims or 1
    bits = code_bits(dims, bits_per_component)
    n_blocks, n_query_blocks = block_count(n, dims), block_count(n_queries, dims)
    blocks = materialize(dealt(rows.select("id", "vec"), n_blocks, "searched-blocks").select("block", "id", "vec")
                         .mapInArrow(_coded(dims, bits, seed), _CODED), "codes")
    queries = dealt(rows.filter("query").select("id", "vec"), n_query_blocks, "query-blocks").withColumnRenamed("block", "qblock")
    asked, best, done = queries.withColumn("threshold", F.lit(float("-inf"))), None, 0
    while done < n_blocks:
        upto = min(n_blocks, max(1, done * (GROWTH + 1)))
        hits = meet(asked, blocks, _search(k, dims, bits, epsilon, seed), _HITS, n_query_blocks, range(done, upto))
        hits = hits if best is None else hits.unionByName(best.drop("rank"))
        best, done = materialize(_leading(hits, k), "nearest"), upto
        last = best.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("threshold"))
        asked = queries.join(last, "id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(float("-inf"))))
    return best.select("query_id", "rank", "id", "score")


def recall_at(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact (query_id, id) pairs that were found."""
    wanted = exact.select("query_id", "id").distinct()
    got = found.select("query_id", "id", F.lit(1).alias("hit")).distinct()
    return wanted.join(got, ["query_id", "id"], "left").agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]
