"""Hard-negative mining with exact integer scores from a residue-number GEMM.

Components become integers floor(scale * x); a score is the integer inner
product of two rows.  Scores are computed modulo several primes of about ten
bits: balanced residues are multiplied as float32 matrices, in slabs of so
many columns that every partial sum stays below 2**24 and is exact, and the
residues of a score are joined to the signed integer by Chinese remaindering
(mixed radix).  As many primes are taken as the longest row needs: by Cauchy
and Schwarz no score exceeds its squared length.

1. Rows are dealt into even blocks (whatever their ids or labels), anchors
   into blocks of their own; every block of anchors meets every block of rows.
2. First pass: the best rows of the anchor's label in each block; a window
   keeps the first ``positives`` per anchor.
3. Second pass: for each anchor and positive the best rows of other labels in
   each block whose score lies between ``low`` and ``high`` percent of the
   positive's; a window keeps the first ``negatives``.

Higher scores come first, ties by smaller id.  Rows with a null label take no
part; see ``vector_blocks`` for nulls, non-finite components, repeated ids and
vectors of other lengths.  Without anchors, or without rows, the result is
empty; an anchor without positives, or a positive without negatives, has no
rows; extra columns are ignored.  Vectors so long that a score might not fit a
long raise an ArithmeticError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vector_blocks import block_count, dealt, matrix, meet, usable

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95          # a negative's share of the positive's score, in percent
SLAB = 64                   # columns whose partial sums stay exact
TOP_PRIME = 1021            # SLAB * ((TOP_PRIME - 1) / 2)**2 < 2**24
MOST = 1 << 55              # 100 * score must fit a long
TILE = 1024                 # anchors multiplied at once

_ANCHORS = "anchor long, label long, vec array<double>"
_HITS = "anchor_id long, id long, score long"
_WINDOWED = "anchor_id long, positive_id long, positive_score long, id long, score long"


def primes_for(bound: int) -> list[int]:
    """The largest primes up to TOP_PRIME whose product exceeds the span -bound..bound."""
    out, product, p = [], 1, TOP_PRIME
    while product <= 2 * bound + 1 or len(out) < 2:
        if all(p % k for k in range(2, int(p**0.5) + 1)):
            out.append(p)
            product *= p
        p -= 1
    return out


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Balanced residues -(p-1)/2 .. (p-1)/2 as float32; x holds whole numbers."""
    r = np.mod(x, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def rns_product(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """The exact integer matrix a @ b.T, if no entry's size exceeds half the primes' product."""
    digits: list[np.ndarray] = []       # mixed radix: d0 + d1 * p0 + d2 * p0 * p1 ...
    for k, p in enumerate(primes):
        left, right = residues(a, p), residues(b, p)
        total = np.zeros((len(a), len(b)), np.int64)
        for c in range(0, a.shape[1], SLAB):
            total += (left[:, c:c + SLAB] @ right[:, c:c + SLAB].T).astype(np.int64)
        total %= p
        have, radix = np.zeros_like(total), 1
        for d, q in zip(digits, primes):
            have = (have + d * radix) % p
            radix = radix * q % p
        digits.append((total - have) * pow(radix, -1, p) % p if k else total)
    product = 1
    for p in primes:
        product *= p
    out, radix = np.zeros((len(a), len(b)), np.int64), 1
    negative = _above_half(digits, primes, product // 2)
    for d, p in zip(digits, primes):
        # a negative number's digits are counted down from p - 1, so nothing leaves the range of the result
        out += np.where(negative, d - (p - 1), d) * radix
        radix *= p
    return out - negative


def _above_half(digits: list[np.ndarray], primes: list[int], half: int) -> np.ndarray:
    """Whether a mixed-radix number exceeds ``half``, compared from the last digit on."""
    above, equal, limit = np.zeros(digits[0].shape, bool), np.ones(digits[0].shape, bool), []
    for p in primes:
        limit.append(half % p)
        half //= p
    for d, v in zip(digits[::-1], limit[::-1]):
        above |= equal & (d > v)
        equal &= d == v
    return above


def _whole(col: pa.ChunkedArray, dims: int, scale: int) -> np.ndarray:
    return np.floor(scale * matrix(col, dims))


def _tiles(anchors: pa.Table, rows: pa.Table, dims: int, scale: int, primes: list[int]):
    """(first anchor, scores) by tiles of anchors; rows must be sorted by id."""
    b = _whole(rows["vec"], dims, scale)
    a = _whole(anchors["vec"], dims, scale)
    for i in range(0, len(a), TILE):
        yield i, rns_product(a[i:i + TILE], b, primes)


def _best(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k best of the positions ``at`` (ascending ids): higher score first, then smaller id."""
    if len(at) > 4 * k:             # all that reach the k-th score, ties included
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.argsort(-scores[at], kind="stable")[:k]]


def _table(columns: list[list[np.ndarray]], names: list[str]) -> pa.Table:
    return pa.table({n: pa.array(np.concatenate([np.zeros(0, np.int64), *c]), pa.int64()) for n, c in zip(names, columns)})


def _positives(k: int, dims: int, scale: int, primes: list[int]):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if anchors.num_rows and rows.num_rows:
            rows = rows.sort_by("id")
            ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
            of_label = {x: np.flatnonzero(labels == x) for x in np.unique(labels)}
            who, label = anchors["anchor"].to_numpy(), anchors["label"].to_numpy()
            for first, scores in _tiles(anchors, rows, dims, scale, primes):
                for i, s in enumerate(scores, first):
                    at = of_label.get(label[i])
                    if at is not None:
                        at = _best(s, at[ids[at] != who[i]], k)
                        for c, v in zip(out, (np.full(len(at), who[i]), ids[at], s[at])):
                            c.append(v)
        return _table(out, ["anchor_id", "id", "score"])
    return run


def _negatives(k: int, low: int, high: int, dims: int, scale: int, primes: list[int]):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        if anchors.num_rows and rows.num_rows:
            rows = rows.sort_by("id")
            ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
            others = {x: np.flatnonzero(labels != x) for x in np.unique(labels)}
            everyone = np.arange(len(ids))
            who, label, positives = anchors["anchor"].to_numpy(), anchors["label"].to_numpy(), anchors["positives"].to_pylist()
            for first, scores in _tiles(anchors, rows, dims, scale, primes):
                for i, s in enumerate(scores, first):
                    at = others.get(label[i], everyone)
                    mine = 100 * s[at]
                    for p in positives[i]:
                        top = at[(mine <= high * p["score"]) & (mine >= low * p["score"])]
                        top = _best(s, top, k)
                        n = len(top)
                        for c, v in zip(out, (np.full(n, who[i]), np.full(n, p["id"]), np.full(n, p["score"]), ids[top], s[top])):
                            c.append(v)
        return _table(out, ["anchor_id", "positive_id", "positive_score", "id", "score"])
    return run


def mine(df: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the column ``id``; ``label`` an expression on ``df``."""
    rows = usable(df, id_col, vec_col, label)
    length = F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * scale), F.lit(2.0)))
    rows = materialize(rows.select("id", "label", "vec", length.alias("length"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")), "mined-rows")
    n, dims, longest, n_anchors = rows.agg(F.count("*"), F.max(F.size("vec")), F.max("length"), F.count_if("anchor")).first()
    dims, longest = dims or 0, int((longest or 0) * 1.000001) + 1
    if longest >= MOST:
        raise ArithmeticError(f"scores up to {longest} may not fit a long")
    primes = primes_for(longest)
    n_blocks, n_query_blocks = block_count(n, dims), block_count(n_anchors, dims)
    blocks = dealt(rows.select("id", "label", "vec"), n_blocks, "mined-blocks")
    anchors = dealt(rows.filter("anchor").select(F.col("id").alias("anchor"), "label", "vec"), n_query_blocks,
                    "anchor-blocks").withColumnRenamed("block", "qblock")
    order = [F.desc("score"), "id"]
    found = meet(anchors, blocks, _positives(positives, dims, scale, primes), _HITS, n_query_blocks, range(n_blocks))
    first = F.row_number().over(Window.partitionBy("anchor_id").orderBy(*order))
    best = found.withColumn("k", first).filter(F.col("k") <= positives)
    per = best.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    per = materialize(per.select(F.col("anchor_id").alias("anchor"), "positives"), "positives")
    found = meet(anchors.join(per, "anchor"), blocks, _negatives(negatives, low, high, dims, scale, primes), _WINDOWED,
                 n_query_blocks, range(n_blocks))
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(*order))
    return (found.withColumn("rank", rank).filter(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))
