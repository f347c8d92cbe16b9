"""Vectors dealt into blocks of rows, shared by the two operators on ``embeddings``.

Rows out of the ordinary: rows without an id, without a vector, or with a null
or non-finite component take no part; an id that repeats counts once, with its
smallest (label, vector); a shorter vector counts as followed by zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BLOCK_BYTES = 1 << 20       # vectors of a block, as float32
BLOCK_ROWS = 4096           # at most


def finite(vec: Column) -> Column:
    """Neither null nor holding a null, NaN or infinite component."""
    ok = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(ok, F.lit(False))


def usable(df: DataFrame, id_col: str, vec_col: str, label: Column | None = None) -> DataFrame:
    """(id, label, vec) of the rows that take part, one per id."""
    label = F.lit(0).cast("long") if label is None else label.cast("long")
    rows = (df.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vec_col).alias("vec"))
            .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vec"))))
    return rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("x")).select("id", "x.label", "x.vec")


def block_count(rows: int, dims: int) -> int:
    return max(1, -(-rows // max(64, min(BLOCK_ROWS, BLOCK_BYTES // (4 * max(1, dims))))))


def dealt(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """The rows in ``blocks`` even blocks, whatever their ids: (block, ...), written."""
    return materialize(rows.repartition(blocks).withColumn("block", F.spark_partition_id()), name)


def matrix(col: pa.ChunkedArray, dims: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of a float64 matrix."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = col.value_lengths().to_numpy()
    if len(col) and (n == dims).all():
        return flat.reshape(len(col), dims)
    out = np.zeros((len(col), dims))
    row = np.repeat(np.arange(len(col)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def meet(queries: DataFrame, blocks: DataFrame, fn, schema: str, n_query_blocks: int, numbers: range) -> DataFrame:
    """``fn(queries, rows)``, two Arrow tables, for every block of queries (``qblock``) against every block in
    ``numbers``: each of the two sides is bounded by the size of a block."""
    left = queries.withColumn("block", F.explode(F.sequence(F.lit(numbers.start), F.lit(numbers.stop - 1))))
    right = (blocks.filter(F.col("block").between(numbers.start, numbers.stop - 1))
             .withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1)))))
    return left.groupBy("block", "qblock").cogroup(right.groupBy("block", "qblock")).applyInArrow(fn, schema)
