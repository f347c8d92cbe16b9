"""Approximate vector index (V5): coarse cells, probing, exact reranking.

Index.  Unit vectors are grouped by spherical k-means: the centres are fitted
on at most ``SAMPLE`` vectors (those first by a hash of their id), every vector
of the table goes to its nearest centre's cell, and cells are stored as
partitions, each with its radius: the least cosine of a member to the centre.

Search.  A query reads its ``probes`` nearest cells only, and scores are exact
cosines.  ``exact=True`` goes on: by the triangle inequality on angles no vector
of a cell can come closer to the query than angle(query, centre) less the
cell's radius, so cells that can't reach the k-th score are left out and all
others are read.

A cell of any size is read by many tasks: rows stream past the block of
queries, whose size is bounded, and each task keeps the best rows per query.
Null vectors are not indexed, zero vectors have a cell of their own and score
0; ties go to the smaller id; an empty table or no queries give an empty
result.  Ids are unique, as in the vector table that V2 keeps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE = 65_536             # vectors that the centres are fitted on, at most
MAX_CELLS = 4096
ROUNDS = 12
PROBES = 16
QUERY_BYTES = 64 * 1024 * 1024      # query vectors held by a task
ROWS_AT_ONCE = 4096
PAIRS_AT_ONCE = 1_000_000           # (query, row) scores that a task has at once
ZERO_CELL = -1


@dataclass
class CellIndex:
    rows: DataFrame             # id, vec, cell; partitioned by cell
    centres: np.ndarray         # (cells, dimensions), unit
    reach: np.ndarray           # (cells,) least cosine of a member to its centre; 2 for an empty cell
    zeros: bool                 # whether there are zero vectors


def _matrix(col: pa.Array) -> np.ndarray:
    """The vectors of an Arrow list column, from its flat buffer."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def fit_centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Spherical k-means: rows are unit vectors; a centre that loses all rows keeps its place."""
    rng = np.random.default_rng(seed)
    c = sample[np.sort(rng.choice(len(sample), cells, replace=False))]
    for _ in range(rounds):
        near = np.concatenate([(sample[i:i + ROWS_AT_ONCE] @ c.T).argmax(1) for i in range(0, len(sample), ROWS_AT_ONCE)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        full = np.linalg.norm(sums, axis=1) > 0
        c = np.where(full[:, None], _unit(sums), c)
    return c


def build_cells(vectors: DataFrame, path: str, cells: int | None = None, id_col: str = "id", vec_col: str = "vec",
                sample: int = SAMPLE) -> CellIndex:
    """Fit, assign and store; ``path`` is a new folder that all executors share."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter("vec is not null")
    some = v.filter(F.exists("vec", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").collect()
    if some:
        m = _unit(np.array([r["vec"] for r in some], np.float64))
        n = cells or min(MAX_CELLS, max(1, math.isqrt(len(m))))
        centres = fit_centres(m, min(n, len(m)))
    else:
        centres = np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for rb in batches:
            for at in range(0, rb.num_rows, ROWS_AT_ONCE):
                part = rb.slice(at, ROWS_AT_ONCE)
                m = _matrix(part.column(1))
                zero = ~m.any(axis=1)
                cos = _unit(m) @ c.T if len(c) else np.zeros((len(m), 1))
                cell = np.where(zero, ZERO_CELL, cos.argmax(1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell), pa.array(cos.max(1))],
                                                 names=["id", "vec", "cell", "near"])
    kind = dict(v.dtypes)["id"]
    placed = v.mapInArrow(assign, f"id {kind}, vec array<double>, cell int, near double")
    placed.repartitionByRange("cell", "id").write.partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    return read_cells(spark, path)


def read_cells(spark: SparkSession, path: str) -> CellIndex:
    schema = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    centres = np.array([r["centre"] for r in schema], np.float64) if schema else np.zeros((0, 0))
    if not len(centres):
        kind = "id long, vec array<double>, near double, cell int"
        rows = spark.read.schema(kind).parquet(f"{path}/rows")
    else:
        rows = spark.read.parquet(f"{path}/rows")
    least = {r["cell"]: r["near"] for r in rows.groupBy("cell").agg(F.min("near").alias("near")).collect()}    # one row per cell
    reach = np.array([least.get(i, 2.0) for i in range(len(centres))])
    return CellIndex(rows, centres, reach, ZERO_CELL in least)


def _best(qids, units, probed, k: int, digits):
    """The k best rows per query among the rows of a task, by the cells that each query probes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        floor = np.full(len(qids), -np.inf)         # the k-th score so far: what is below cannot be among the best
        for rb in batches:
            for at in range(0, rb.num_rows, ROWS_AT_ONCE):
                part = rb.slice(at, ROWS_AT_ONCE)
                ids, m, cell = part.column(0), _unit(_matrix(part.column(1))), part.column(2).to_numpy()
                for c in np.unique(cell):
                    if int(c) not in probed:
                        continue
                    rows, asked = np.flatnonzero(cell == c), probed[int(c)]
                    size = max(1, PAIRS_AT_ONCE // len(rows))
                    for some in range(0, len(asked), size):
                        q = asked[some:some + size]
                        score = units[q] @ m[rows].T
                        score = np.round(score, digits) if digits is not None else score
                        at_q, at_row = np.nonzero(~(score < _bound(score, floor[q], k)[:, None]))
                        new = (q[at_q], ids.take(pa.array(rows[at_row])), score[at_q, at_row])
                        held = new if held is None else (np.concatenate((held[0], new[0])), pa.concat_arrays([held[1], new[1]]),
                                                         np.concatenate((held[2], new[2])))
                        if len(held[0]) > 4 * k * max(1, len(qids)):
                            held = _cut(held, k)
                            whole = np.flatnonzero(np.bincount(held[0], minlength=len(qids)) >= k)
                            worst = np.full(len(qids), np.inf)
                            np.minimum.at(worst, held[0], np.where(np.isnan(held[2]), -np.inf, held[2]))
                            floor[whole] = worst[whole]
        if held is not None:
            q, ids, score = _cut(held, k)
            yield pa.RecordBatch.from_arrays([pa.array(qids).take(pa.array(q)), ids, pa.array(score)], names=["qid", "id", "score"])
    return run


def _bound(score: np.ndarray, floor: np.ndarray, k: int) -> np.ndarray:
    """Per query (row of ``score``): no less than its k-th score here or so far; scores that aren't numbers are the worst."""
    n = score.shape[1]
    if n <= k:
        return floor
    known = np.where(np.isnan(score), -np.inf, score)
    return np.maximum(floor, np.partition(known, n - k, axis=1)[:, n - k])


def _cut(held: tuple, k: int) -> tuple:
    """k rows per query: highest score first, then smallest id."""
    q, ids, score = held
    place = np.empty(len(ids), np.int64)
    place[np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(ids))
    order = np.lexsort((place, -score, q))
    first = np.searchsorted(q[order], q[order])
    keep = order[np.arange(len(order)) - first < k]
    return q[keep], ids.take(pa.array(keep)), score[keep]


def _pass(index: CellIndex, qids: list, units: np.ndarray, probe: np.ndarray, k: int, digits) -> DataFrame:
    """(qid, id, score): the best rows of each query in the cells that ``probe`` (queries, cells + 1) marks."""
    probed = {int(c): np.flatnonzero(probe[:, i]) for i, c in enumerate([*range(len(index.centres)), ZERO_CELL]) if probe[:, i].any()}
    wanted = index.rows.filter(F.col("cell").isin(sorted(probed))).select("id", "vec", "cell")
    kind = dict(index.rows.dtypes)["id"]
    qkind = "string" if qids and isinstance(qids[0], str) else "long"
    found = wanted.mapInArrow(_best(qids, units, probed, k, digits), f"qid {qkind}, id {kind}, score double")
    first = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", first.cast("int")).filter(F.col("rank") <= k)


def search_cells(index: CellIndex, queries: DataFrame, k: int, qid_col: str = "qid", vec_col: str = "vec", probes: int = PROBES,
                 exact: bool = False, round_digits: int | None = None, budget_bytes: int = QUERY_BYTES) -> DataFrame:
    """qid, id, score, rank of the k nearest rows found per query; queries beyond the budget are searched in blocks."""
    queries = queries.select(F.col(qid_col).alias("qid"), F.col(vec_col).cast("array<double>").alias("qvec")).filter("qvec is not null")
    n, d = queries.agg(F.count("*"), F.max(F.size("qvec"))).first()
    spark = queries.sparkSession
    blocks = -(-n * ((d or 0) + 4 * k + len(index.centres)) * 8 // budget_bytes)
    out = None
    for b in range(blocks):
        mine = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        rows = mine.collect()           # bounded by the budget
        if not rows:
            continue
        part = _search_block(index, [r["qid"] for r in rows], np.array([r["qvec"] for r in rows], np.float64), k, probes, exact, round_digits)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"qid {dict(queries.dtypes)['qid']}, id {dict(index.rows.dtypes)['id']}, score double, rank int")
    return out


def _search_block(index: CellIndex, qids: list, vectors: np.ndarray, k: int, probes: int, exact: bool, digits) -> DataFrame:
    units = _unit(vectors)
    cells = len(index.centres)
    cos = units @ index.centres.T if cells else np.zeros((len(units), 0))
    probe = np.zeros((len(units), cells + 1), bool)
    some = min(probes, cells)
    if some:
        np.put_along_axis(probe, np.argsort(-cos, axis=1, kind="stable")[:, :some], True, axis=1)
    probe[:, cells] = index.zeros
    first = _pass(index, qids, units, probe, k, digits)
    if not exact or some == cells:
        return first
    best = {r["qid"]: (r["score"], r["n"]) for r in first.groupBy("qid").agg(F.min("score").alias("score"), F.count("*").alias("n")).collect()}
    kth = np.array([best[q][0] if best.get(q, (0, 0))[1] == k else -2.0 for q in qids])
    kth = kth - (10.0 ** -digits if digits is not None else 1e-9)
    angle = np.arccos(np.clip(cos, -1, 1)) - np.arccos(np.clip(index.reach, -1, 1))[None, :]
    reachable = (np.cos(np.maximum(0, angle)) >= kth[:, None]) & (index.reach <= 1.5)[None, :]
    more = np.concatenate((reachable, probe[:, cells:]), axis=1) | probe
    return _pass(index, qids, units, more, k, digits)
