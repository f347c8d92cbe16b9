"""Line dedup against levelled sorted runs of line hashes.

A run is a table of (h1, h2, owner) - the two 64-bit halves of a line key's
hash and the smallest document that holds the key - hash-partitioned and
sorted by key.  A batch of documents is reduced to one row per key, merge
anti-joined with all runs, and the keys that no run holds become a new run of
level 0.  When a level holds ``fan`` runs they are compacted into one run of
the next level.  Keys of different runs are disjoint, so a key has one owner.

Batches must arrive in ascending document order: then the first batch that
holds a key also holds its smallest document.  :func:`dedup_lines` cuts a
whole table into such batches; :class:`LineRuns` is the incremental form.

Inputs out of the ordinary: a null or empty text is one empty line; a null id
counts as an id below all others; rows that repeat an id count as one
document, and each is returned; a clashing input column is replaced by the
operator's column; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import (ASCII_SPACE, NULL_ID, ascii_lower, join_back, materialize, scratch_path,
                     shuffle_partitions)

MIN_KEY = 10        # code points
_SALT = "second half"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def line_pairs(docs: DataFrame, id_col: str, text_col: str, min_key: int) -> DataFrame:
    """(did, h1, h2): each document's distinct line keys of at least ``min_key`` code points."""
    keys = F.filter(F.transform(F.split(F.coalesce(text_col, F.lit("")), "\n"), line_key),
                    lambda k: F.length(k) >= min_key)
    pairs = docs.select(F.coalesce(id_col, F.lit(NULL_ID)).cast("long").alias("did"),
                        F.explode(F.array_distinct(keys)).alias("k"))
    return pairs.select("did", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(_SALT), "k").alias("h2"))


class LineRuns:
    """The levelled runs.  Tables live in the shared folder and are bucketed
    and sorted by key, so a merge join reads them without a shuffle."""

    def __init__(self, spark: SparkSession, fan: int = 2):
        self.spark, self.fan, self.names = spark, fan, []
        self.levels: dict[int, list[str]] = defaultdict(list)

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.names.append(name)
        (df.write.bucketBy(shuffle_partitions(self.spark), "h1", "h2").sortBy("h1", "h2")
         .option("path", scratch_path(self.spark, "line-run")).saveAsTable(name))
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t).filter("fresh").select("h1", "h2", "owner")
                for level in sorted(self.levels) for t in self.levels[level]]

    def add(self, pairs: DataFrame) -> DataFrame:
        """Add a batch of (did, h1, h2); returns a written table with one row
        per key of the batch: owner, n (rows of the key), dup (another
        document holds it too), fresh (no earlier batch held it)."""
        first = pairs.groupBy("h1", "h2").agg(F.min("did").alias("lo"), F.max("did").alias("hi"),
                                              F.count("*").alias("n"))
        olds = []
        for i, run in enumerate(self.runs()):
            first = first.join(run.withColumnRenamed("owner", f"o{i}").hint("merge"), ["h1", "h2"], "left")
            olds.append(F.col(f"o{i}"))
        old = F.coalesce(*olds) if olds else F.lit(None).cast("long")
        name = self._write(first.select("h1", "h2", "n", F.coalesce(old, "lo").alias("owner"),
                                        old.isNull().alias("fresh"),
                                        (old.isNotNull() | (F.col("lo") < F.col("hi"))).alias("dup")))
        self.levels[0].append(name)
        self._compact()
        return self.spark.table(name)

    def forget(self) -> None:
        """Take the runs out of the catalog, once nothing reads them any more."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names, self.levels = [], defaultdict(list)

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fan:
            merged = None
            for t in self.levels[level]:
                run = self.spark.table(t).filter("fresh")
                merged = run if merged is None else merged.unionByName(run)
            n = shuffle_partitions(self.spark)
            self.levels[level + 1].append(self._write(merged.repartition(n, "h1", "h2")))
            self.levels[level] = []
            level += 1


def _batch_bounds(docs: DataFrame, id_col: str, batches: int) -> list[int]:
    parts = [i / batches for i in range(1, batches)]
    row = docs.agg(F.percentile_approx(F.coalesce(id_col, F.lit(NULL_ID)).cast("long"), parts, 1000)).first()
    return sorted(set(row[0] or []))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_key: int = MIN_KEY, batches: int = 4, fan: int = 2) -> DataFrame:
    """(did, drops): for each document that loses lines, the hashes of their keys."""
    spark = docs.sparkSession
    bounds = _batch_bounds(docs, id_col, batches) if batches > 1 else []
    batch = F.lit(0)
    for b in bounds:
        batch = batch + (F.col("did") > b).cast("int")
    pairs = materialize(line_pairs(docs, id_col, text_col, min_key).withColumn("batch", batch),
                        "line-pairs", partition_by="batch")
    runs = LineRuns(spark, fan)
    decided = None
    for b in range(len(bounds) + 1):
        d = runs.add(pairs.filter(F.col("batch") == b).drop("batch")).filter("dup")
        d = d.select(F.lit(b).alias("batch"), "h1", "h2", "n", "owner")
        decided = d if decided is None else decided.unionByName(d)
    lost = join_back(pairs, decided, ["batch", "h1", "h2"], "n", "did").filter("did > owner")
    drops = materialize(lost.groupBy("did").agg(F.collect_set(F.struct("h1", "h2")).alias("drops")), "lost-lines")
    runs.forget()
    return drops


def _apply(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        seed2 = xxhash.xxh64_intdigest(_SALT.encode(), 42)
        fold = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
        space = ASCII_SPACE.encode()

        def signed(x):
            return x - (1 << 64) if x >> 63 else x

        for rb in batches:
            texts, n_lines, n_dropped = [], [], []
            drops = rb.column(rb.schema.get_field_index("_drops"))
            for t, d in zip(rb.column(rb.schema.get_field_index(text_col)), drops):
                t = t.as_py() or ""
                lines = t.split("\n")
                n_lines.append(len(lines))
                if d.is_valid:
                    gone = {(x["h1"], x["h2"]) for x in d.as_py()}
                    kept = []
                    for line in lines:
                        k = line.encode("utf-8", "surrogatepass").strip(space).translate(fold)
                        if (signed(xxhash.xxh64_intdigest(k, 42)), signed(xxhash.xxh64_intdigest(k, seed2))) not in gone:
                            kept.append(line)
                    n_dropped.append(len(lines) - len(kept))
                    t = "\n".join(kept)
                else:
                    n_dropped.append(0)
                texts.append(t)
            cols = {n: rb.column(i) for i, n in enumerate(rb.schema.names) if n != "_drops"}
            cols[text_col] = pa.array(texts, pa.string())
            cols["n_lines"], cols["n_dropped"] = pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY,
                batches: int = 4, fan: int = 2) -> DataFrame:
    """The documents with ``text`` less its repeated lines, plus n_lines and n_dropped.

    A key held by at least two documents loses its lines everywhere but in
    the smallest document that holds it.  Only hashes are shuffled to decide;
    the texts move once, to meet the (few) hashes of their own lost lines.
    """
    docs = docs.drop(*[c for c in ("n_lines", "n_dropped", "_drops", "_did") if c in docs.columns])
    lost = repeated_lines(docs, id_col, text_col, min_key, batches, fan)
    lost = lost.select(F.col("did").alias("_did"), F.col("drops").alias("_drops"))
    joined = (docs.withColumn("_did", F.coalesce(id_col, F.lit(NULL_ID)).cast("long"))
              .join(lost, "_did", "left").select(*docs.columns, "_drops"))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()),
                           T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(_apply(text_col), schema)
