"""Helpers shared by the operators of this subpackage.

Spark side: shared-folder tables, a join back that spreads hot keys, connected
components.  Task side (numpy over Arrow buffers): byte-level tokenising,
64-bit word and shingle hashes, packed integer columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

SLICE_BYTES = 1 << 20       # numpy work is done on runs of whole texts, or of words, of about this size
HOT_KEYS = 1000             # a join treats at most this many keys as hot (see join_back)
HOT_SALTS = 64
EDGES_AT_ONCE = 1 << 20     # connected components: edges (16 bytes each) that one task may finish
NULL_ID = -(1 << 63)        # stands for a null id inside jobs; it sorts below all ids
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ------------------------------------------------------------ Spark side ---
def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives
    the loss of executors, and lets later steps read it more than once."""
    path = scratch_path(df.sparkSession, name)
    w = df.write
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, dict]:
    """``materialize`` with totals taken while writing, without a job of their own (missing when there are no rows)."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(n) for n, c in sums.items()]), name)
    return out, seen.get


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def is_in_fold(id_col: Column, mod: int, remainder: int) -> Column:
    """crc32 of the id as text, mod ``mod``, equals ``remainder``; a null id is in no fold."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % mod == remainder, F.lit(False))


def join_back(left: DataFrame, right: DataFrame, keys: list[str], n_col: str, salt_by: str,
              how: str = "inner", total: int | None = None) -> DataFrame:
    """``left`` joined to ``right``, which has one row per key and in ``n_col``
    the number of left rows of that key.

    A key with more than 1/HOT_KEYS of all rows is hot: its right row is
    copied HOT_SALTS times and its left rows are dealt over the copies by a
    hash of ``salt_by``.  At most HOT_KEYS keys can be hot, which bounds the
    broadcast.  ``right`` is read twice, and once more where ``total``, the sum
    of ``n_col``, is not given: pass a written table.
    """
    most = right.agg(F.coalesce(F.sum(n_col), F.lit(0)).alias("t")).scalar() if total is None else F.lit(total)
    is_hot = F.col(n_col) * HOT_KEYS > most
    hot = F.broadcast(right.filter(is_hot).select(*keys, F.lit(True).alias("_hot")))
    salted = (left.join(hot, keys, "left")
              .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(salt_by), F.lit(HOT_SALTS)))
                          .otherwise(F.lit(0)).cast("int")).drop("_hot"))
    copies = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_SALTS - 1)))
                                                 .otherwise(F.array(F.lit(0)))))
    return salted.join(copies.drop(n_col), [*keys, "_salt"], how).drop("_salt")


def connected_components(edges: DataFrame, max_rounds: int = 60, at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """(node, root): root is the smallest node reachable; ``edges`` has (a, b).

    Alternating large-star and small-star rounds.  Each round pre-aggregates
    the smallest neighbour per node and joins it back; rounds are written to
    the shared folder, with their number of edges and a checksum.  As soon as
    no more than ``at_once`` edges are left, which bounds its memory, one task
    finishes them; more edges go on round by round until nothing changes.
    """
    def edge_table(df):
        e, seen = written(df, "edges", n=F.count("*"), x=F.bit_xor(F.xxhash64("u", "v")))
        return e, (seen.get("n") or 0, seen.get("x"))

    e, seen = edge_table(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        if seen[0] <= at_once:
            return e.coalesce(1).mapInArrow(_finish, "node long, root long")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e, now = edge_table(small)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of the edges (u, v) of one task."""
    ends = [(rb.column(0).to_numpy(), rb.column(1).to_numpy()) for rb in batches]
    u, v = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in ends)]) for k in (0, 1))
    nodes, root = small_components(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], names=["node", "root"])


def small_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable), sorted by node."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    low = np.arange(len(nodes))
    while len(a):
        m = np.minimum(low[a], low[b])      # the two roots of an edge hang under the smaller one
        np.minimum.at(low, low[a], m)
        np.minimum.at(low, low[b], m)
        while not np.array_equal(low, low[low]):
            low = low[low]
        open_ = low[a] != low[b]
        a, b = a[open_], b[open_]
    return nodes, nodes[low]


# ------------------------------------------------------------- task side ---
def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, dtype=np.int64)[col.offset:col.offset + len(col) + 1] if offs else np.zeros(1, np.int64)
    b = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b, o


def text_slices(col: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) for runs of whole texts; offsets start at 0."""
    b, o = string_buffers(col)
    i, n = 0, len(o) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, b[o[i]:o[j]], o[i:j + 1] - o[i]
        i = j


def byte_class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[np.frombuffer(chars, np.uint8)] = True
    return t


#: Bytes outside `[^\x20\x09-\x0D]`.
SPACES = byte_class(b" \t\n\x0b\x0c\r")
#: Bytes outside `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, after A-Z are lower-cased.
NON_ALNUM = byte_class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE_KEYS = np.random.Generator(np.random.PCG64(20011)).integers(1, 1 << 64, 256, dtype=np.uint64)


@lru_cache(maxsize=8)
def _place_keys(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20021)).integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def fold_case(b: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, byte for byte."""
    return _FOLD[b]


def words(b: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every word; a word never spans two texts."""
    if not len(b):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~sep[b]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edges = offs[:-1][offs[:-1] < len(b)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    lens = ends - starts
    total = np.cumsum(lens)
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):      # as many words at a time as fill a slice
        done = total[i] - lens[i]
        j = max(i + 1, int(np.searchsorted(total, done + SLICE_BYTES, "right")))
        n = lens[i:j]
        firsts = total[i:j] - n - done
        place = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(firsts, n)
        keys = _place_keys(1 << max(6, int(n.max() - 1).bit_length()))
        v = _BYTE_KEYS[b[place + np.repeat(starts[i:j], n)]] * keys[place]
        out[i:j] = mix(np.add.reduceat(v, firsts) + n.astype(np.uint64))
        i = j
    return out


def shingle_hashes(w: np.ndarray, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its first word) of every run of ``size`` words of one text."""
    n = len(w) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    keys = _place_keys(1 << max(6, (size - 1).bit_length()))
    for j in range(size):
        h += w[j:j + n] * keys[j]
    at = np.flatnonzero(of[:n] == of[size - 1:])
    return mix(h[at] + np.uint64(size)), at


def shingle_sets(b: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number), distinct, sorted by text and hash: the ``size``-word
    shingles of each text; a text of fewer words has them all as its only one."""
    b = fold_case(b)
    s, e, of = words(b, offs, SPACES)
    w = word_hashes(b, s, e)
    h, at = shingle_hashes(w, of, size)
    t = of[at]
    n_words = np.bincount(of, minlength=len(offs) - 1)
    for k in range(1, size):        # short texts, grouped by their number of words
        short = np.flatnonzero(n_words == k)
        if len(short):
            firsts = np.searchsorted(of, short)
            hs = np.zeros(len(short), np.uint64)
            for j in range(k):
                hs += w[firsts + j] * _place_keys(64)[j]
            h, t = np.concatenate((h, mix(hs + np.uint64(k)))), np.concatenate((t, short))
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[new], t[new]


def pack(a: np.ndarray) -> bytes:
    """An integer array as compressed byte planes; sort unsigned keys first
    and pass ``delta`` values where that helps."""
    import zstandard
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    import zstandard
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    k = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(k, len(raw) // k).T).view(dtype).reshape(-1)


def pack_sorted(a: np.ndarray) -> bytes:
    """A sorted uint64 array, as differences."""
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)
