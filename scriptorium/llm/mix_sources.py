"""Mixing sources to target weights with a low-discrepancy schedule.

1. Targets: sources share ``share`` times all words by weight; a source's
   target stops at ``cap`` times its size and the excess is reshared by
   weight (water-filling, solved in closed form over sources sorted by
   size / weight).
2. Schedule: slot k stands at the fractional part of (k + 1/2) times the
   golden ratio's inverse; the point is mapped through the cumulative targets
   to a source, and slots are ranked per source.  There is about a slot for
   each block of the mix.  A source whose target asks for more blocks than it
   has slots gets the missing ranks in tail slots after all others, in order
   of source and rank, so every prefix follows the weights and the whole meets
   every target.
3. Blocks: each source's documents are shuffled by a seeded hash and laid end
   to end, epoch after epoch, in blocks of ``block`` words.  Block r of a
   source is taken at its slot of rank r: a source gives as many blocks as it
   has slots, and its last block stops at its target.  What has no slot is
   not in the mix.

Points meet the cumulative targets by a join on equal parts of the range: no
task holds all sources.

Running totals are two-level (totals per group and bucket, then inside a
bucket), so a source with most of the rows is summed in many tasks.

Inputs out of the ordinary: null or wordless text has size 0 and is never
taken; a null source is a source, last in order; repeated rows are laid out
each for itself; ids may be null; texts of any length are counted whole and
cut into blocks; extra columns, clashing ones too, are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
BLOCK = 2048
SEED = "mix-1"
BUCKET_ROWS = 4096
PHI = 0.6180339887498949        # the golden ratio's inverse
BROADCAST_SOURCES = 100_000     # the table of sources is broadcast up to so many rows, else joined


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   cap: int = CAP) -> DataFrame:
    """(src, source_size, target) from (src, size); windows run over one row per source."""
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("src")) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("top", F.col("source_size") * cap)
    by_ratio = Window.orderBy((F.col("top") / F.col("w")).asc(), "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = (per.withColumn("left_words", F.sum("source_size").over(every) * F.lit(float(share))
                          - F.coalesce(F.sum("top").over(before), F.lit(0)))
           .withColumn("left_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
           .withColumn("rate", F.col("left_words") / F.col("left_w"))
           .withColumn("full", F.col("rate") * F.col("w") > F.col("top"))
           .withColumn("at", F.row_number().over(by_ratio)))
    rate = F.min(F.when(~F.col("full"), F.struct("at", "rate"))).over(every)["rate"]
    return per.select("src", "source_size",
                      F.when(F.col("full"), F.col("top").cast("double")).otherwise(rate * F.col("w")).alias("target"))


def running_total(df: DataFrame, group: str, bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row, inside its group.
    ``bucket`` must not decrease along ``order``; no task holds more than one
    bucket of rows, or one group's bucket totals."""
    totals = df.groupBy(group, bucket).agg(F.sum(value).alias("_v"))
    up_to = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, bucket, F.coalesce(F.sum("_v").over(up_to), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (df.join(offsets, [group, bucket])
            .withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_before"))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(src, rank, slot): the low-discrepancy schedule; each source has a slot for every block of its target."""
    spark = targets.sparkSession
    n_sources, total = targets.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    ends = F.sum("target").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0))
    spans = targets.filter("target > 0").withColumn("hi", ends).withColumn("lo", F.col("hi") - F.col("target"))
    # the range in equal parts, about as many as sources; a span lies in the parts it touches
    parts = max(1, n_sources)
    part = lambda x: F.least(F.floor(x / F.lit(total) * parts), F.lit(parts - 1)).cast("long")
    spans = materialize(spans.select("src", "lo", "hi", "target", part(F.col("lo")).alias("p"), part(F.col("hi")).alias("q")), "mix-spans")
    k = (F.col("slot") + F.lit(0.5)) * F.lit(PHI)
    slots = spark.range(int(-(-total // block))).select(F.col("id").alias("slot")).withColumn("point", (k - F.floor(k)) * F.lit(float(total)))
    touched = spans.select("src", "lo", "hi", F.explode(F.sequence("p", "q")).alias("part"))
    # the last span ends at the total itself, and spans that end where the next begins share no point
    met = (slots.withColumn("part", part(F.col("point"))).join(touched, "part")
           .filter((F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi"))).select("src", "slot"))
    met = met.withColumn("_b", F.floor(F.col("slot") / 65536)).withColumn("_one", F.lit(1).cast("long"))
    ranked = materialize(running_total(met, "src", "_b", ["slot"], "_one", "rank").select("src", "rank", "slot"), "mix-slots")
    have = ranked.groupBy("src").agg(F.count("*").alias("have"))
    needed = F.ceil(F.floor("target") / block)
    short = spans.join(have, "src", "left").select("src", F.coalesce("have", F.lit(0)).alias("have"), needed.alias("needed")).filter("needed > have")
    before = F.sum(F.col("needed") - F.col("have")).over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1))
    tail = short.withColumn("before", F.coalesce(before, F.lit(0))).select(
        "src", "have", "before", F.explode(F.sequence("have", F.col("needed") - 1)).alias("rank"))
    after = F.lit(int(-(-total // block)))
    return ranked.unionByName(tail.select("src", "rank", (after + F.col("before") + F.col("rank") - F.col("have")).alias("slot")))


def source_key(source: str) -> Column:
    """Sorts by code point, null last; never null."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP,
        block: int = BLOCK, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(sized, pieces).  sized: row, doc_id, src, size, source_size, target.
    pieces: slot, src, block, row, epoch, first, words -
    the mix in order of (slot, first) takes ``words`` words of row ``row`` from
    word ``first`` on."""
    order = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":" + seed)))
    rows = docs.select(F.col(id_col).alias("doc_id"), source_key(source_col).alias("src"),
                       word_count(F.col(text_col)).alias("size"), F.coalesce(order, F.lit("")).alias("h"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    buckets = max(1, rows.count() // BUCKET_ROWS)
    rows = rows.withColumn("_b", F.coalesce(F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double")
                                                    / 4294967296.0 * buckets), F.lit(-1)).cast("long"))
    targets = materialize(source_targets(rows, weights, share, cap), "mix-targets")
    few = targets.count() <= BROADCAST_SOURCES
    per_source = F.broadcast(targets) if few else targets
    laid = running_total(rows, "src", "_b", ["h", "size", "row"], "size", "off")
    laid = laid.join(per_source, "src").withColumn("goal", F.floor("target"))
    # a row's words stand at off.. in the first epoch, source_size + off.. in the next ones
    epochs = F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))
    laid = laid.filter("size > 0").withColumn("epoch", epochs)
    start = F.col("off") + F.col("epoch") * F.col("source_size")
    laid = (laid.withColumn("a", start).withColumn("z", F.least(start + F.col("size"), F.col("goal")))
            .filter("z > a"))
    cuts = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("z") - 1) / block))))
    lo, hi = F.greatest("a", F.col("block") * block), F.least("z", (F.col("block") + 1) * block)
    pieces = cuts.select("src", "block", "row", "epoch", (lo - F.col("a")).alias("first"), (hi - lo).alias("words"))
    slots = schedule(targets, block).withColumnRenamed("rank", "block")
    pieces = pieces.join(slots, ["src", "block"])
    sized = rows.join(per_source, "src").select("row", "doc_id", "src", "size", "source_size", "target")
    return sized, pieces


def taken_words(docs: DataFrame, **kw) -> DataFrame:
    """Per document row: doc_id, size, source_size, target, taken, and first_slot, where the mix first takes from it
    (null: nowhere)."""
    sized, pieces = mix(docs, **kw)
    took = pieces.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    return sized.join(took, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
