"""Document fingerprints: 64-bit SimHash, and a search by permuted block tables.

Built from DataFrame functions only.  A text's terms are its five-word
shingles (fewer words: what there is, as one); a term weighs as often as it
occurs.  Each term hash votes on 64 signed bits: the votes are summed two bits
to a long (32-bit lanes), in a partial-free aggregate that needs no shuffle
because rows are already dealt by id range.

The search takes fingerprints within RADIUS bits, which five-word shingles of
Jaccard 0.98 or more mostly are; texts of similarity 0.8 mostly are not (README
has the measured recall).  Such texts are the n-gram join's to find.

Neighbours by id: ids are cut into ranges at approximate quantiles (any cut is
correct, quantiles make it even), one shuffle deals texts to their range, and
the largest id of each range is also dealt to the next higher range, so every
row finds its next document inside its own range.

Inputs out of the ordinary: null text counts as empty; no words give the
fingerprint 0; a null id sorts below all ids; rows that repeat an id follow
each other in an order fixed by their text; a single document is its own next
document; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, join_back, materialize, shuffle_partitions

SHINGLE = 5
BITS = 64
RADIUS = 3
BLOCKS = 5
COARSE = 64                 # range lookup: COARSE groups of bounds, then one group
_LANES = 0x0000000100000001
_LOW = 0xFFFFFFFF


def text_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"), lambda x: x != "")


def term_hashes(w: Column, size: int = SHINGLE) -> Column:
    """Hashes of the shingles of a column of words.  Pass a column, not an
    expression: it is looked up once per shingle."""
    h = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, size)]))
    return F.slice(h, 1, F.greatest(F.least(F.size(w), F.lit(1)), F.size(w) - (size - 1)))


def _votes(h: Column) -> list[Column]:
    """For bit k and bit k + 32: how many terms have it, in two lanes of a long."""
    return [F.coalesce(F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES))), F.lit(0)).alias(f"v{k}")
            for k in range(32)]


def _signs(n: str = "n") -> Column:
    """The bits whose positive votes outweigh the negative ones."""
    bits = []
    for k in range(32):
        low, high = F.col(f"v{k}").bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(f"v{k}", 32)
        bits += [F.when(low * 2 > F.col(n), F.lit(1 << k)).otherwise(F.lit(0)),
                 F.when(high * 2 > F.col(n), F.lit((1 << (k + 32)) - ((1 << 64) if k == 31 else 0))).otherwise(F.lit(0))]
    out = bits[0].cast("long")
    for b in bits[1:]:
        out = out.bitwiseOR(b.cast("long"))
    return out


def fingerprint_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def _range_of(idc: Column, bounds: list[int]) -> Column:
    """Number of bounds below the id: a group of bounds first, then its members."""
    if not bounds:
        return F.lit(0)
    step = -(-len(bounds) // COARSE)
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(g[-1]) for g in groups])
    g = F.size(F.filter(heads, lambda x: x < idc))
    beyond = [[(1 << 63) - 1]]
    inner = F.element_at(F.array(*[F.array(*[F.lit(x) for x in grp]) for grp in groups + beyond]), g + 1)
    return F.least(g * step + F.size(F.filter(inner, lambda x: x < idc)), F.lit(len(bounds))).cast("int")


def dealt_with_next(docs: DataFrame, id_col: str, text_col: str, ranges: int | None = None) -> DataFrame:
    """Rows by range: rng, wrap, id, tie, ghost, doc_id, text, next (the text of the next document in
    descending id order, the first one's after the last).  Ghost rows are copies that only serve as next."""
    spark = docs.sparkSession
    idc = F.coalesce(F.col(id_col), F.lit(NULL_ID)).cast("long")
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                    idc.alias("id"))
    ranges = ranges or 2 * shuffle_partitions(spark)
    cut = d.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] \
        if ranges > 1 else None
    bounds = sorted(set(cut or []))
    rng = _range_of(F.col("id"), bounds)
    tops = {r["rng"]: r["top"] for r in d.select(rng.alias("rng"), "id").groupBy("rng")
            .agg(F.max("id").alias("top")).collect()}            # one row per range
    full = sorted(tops)
    above = dict(zip(full, full[1:]))
    size = len(bounds) + 1
    top = F.array(*[F.lit(tops.get(r)).cast("long") for r in range(size)])
    up = F.array(*[F.lit(above.get(r, -1)) for r in range(size)])
    r = F.col("rng")
    last = bool(full)
    slots = F.array(F.struct(r.alias("rng"), F.lit(0).alias("wrap"), F.lit(False).alias("ghost")),
                    F.when((F.element_at(top, r + 1) == F.col("id")) & (F.element_at(up, r + 1) >= 0),
                           F.struct(F.element_at(up, r + 1).alias("rng"), F.lit(0).alias("wrap"), F.lit(True).alias("ghost"))),
                    F.when((r == (full[-1] if last else 0)) & (F.col("id") == F.lit(tops[full[-1]] if last else 0)),
                           F.struct(F.lit(full[0] if last else 0).alias("rng"), F.lit(1).alias("wrap"), F.lit(True).alias("ghost"))))
    d = d.withColumn("rng", rng).withColumn("s", F.explode(F.filter(slots, lambda x: x.isNotNull())))
    d = d.select(F.col("s.rng").alias("rng"), F.col("s.wrap").alias("wrap"), "id",
                 F.xxhash64("text").alias("tie"), F.col("s.ghost").alias("ghost"), "doc_id", "text")
    return d.withColumn("next", F.lead("text").over(_order()))


def _order():
    return Window.partitionBy("rng").orderBy("wrap", F.desc("id"), "tie", "ghost")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                 ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp of every row."""
    d = dealt_with_next(docs, id_col, text_col, ranges)
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third),
                      F.substring(F.coalesce("next", F.lit("")), F.lit(1), third))
    d = (d.withColumn("edited", edited).withColumn("row", F.monotonically_increasing_id())
         .select("rng", "wrap", "id", "tie", "ghost", "doc_id", "row", F.length("text").cast("long").alias("n_chars"),
                 F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                 F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")),
                                   F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("x")))
    own = ["rng", "wrap", "id", "tie", "ghost", "doc_id", "row", "n_chars", "edited_sha256"]
    terms = (d.select(*own, F.col("x.which").alias("which"), text_words(F.col("x.t")).alias("words"))
             .select(*own, "which", F.explode_outer(term_hashes(F.col("words"), size)).alias("h")))
    votes = terms.groupBy(*own, "which").agg(F.count("h").alias("n"), *_votes(F.col("h")))
    fps = votes.select(*own, "which", _signs().alias("fp"))
    both = fps.groupBy(*own).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"),
                                 F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    both = both.withColumn("next_fp", F.lead("fp").over(_order()))
    return both.filter(~F.col("ghost")).select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


def _block(fp: Column, i: int, blocks: int) -> Column:
    lo, hi = i * BITS // blocks, (i + 1) * BITS // blocks
    return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def near_fingerprints(fps: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(q, fp, distance): for every distinct fingerprint ``q`` of ``queries``, all distinct fingerprints ``fp``
    of ``fps`` within ``radius`` bits; both inputs have a column fp.

    Two fingerprints within the radius agree on at least blocks - radius of the ``blocks`` bit blocks.  There is
    one table per choice of so many blocks, keyed by their bits; a pair is taken in the first table that joins it.
    """
    keep = blocks - radius
    if keep < 1:
        raise ValueError("more blocks than the radius are needed")
    tables = list(combinations(range(blocks), keep))

    def keyed(df, name):
        keys = F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(*[_block(F.col(name), i, blocks) for i in c]).alias("k"))
                         for t, c in enumerate(tables)])
        return df.select(name, F.explode(keys).alias("e")).select(name, "e.t", "e.k")

    a = keyed(queries.select(F.col("fp").alias("q")).distinct(), "q")
    b = keyed(fps.select("fp").distinct(), "fp")
    x = F.col("q").bitwiseXOR(F.col("fp"))
    equal = [_block(x, i, blocks) == 0 for i in range(blocks)]
    first = F.coalesce(*[F.when(_all([equal[i] for i in c]), F.lit(t)) for t, c in enumerate(tables)])
    return (a.join(b, ["t", "k"]).filter((F.bit_count(x) <= radius) & (first == F.col("t")))
            .select("q", "fp", F.bit_count(x).alias("distance")))


def _all(conds):
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def near_counts(prints: DataFrame, is_query: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All columns of ``prints`` (a written table with fp) plus n_near: for rows that are queries, how many
    other rows have a fingerprint within the radius; null for the others."""
    members = prints.groupBy("fp").agg(F.count("*").alias("members"))
    asked = prints.filter(is_query)
    pairs = near_fingerprints(prints, asked, radius, blocks)
    found = pairs.join(members, "fp").groupBy("q").agg((F.sum("members") - 1).alias("n_near"))
    n = asked.groupBy(F.col("fp").alias("q")).agg(F.count("*").alias("n"))
    found = materialize(found.join(n, "q").withColumnRenamed("q", "fp"), "near-counts")
    got = join_back(asked, found, ["fp"], "n", "doc_id").select(*prints.columns, "n_near")
    rest = prints.filter(~F.coalesce(is_query, F.lit(False))).withColumn("n_near", F.lit(None).cast("long"))
    return got.unionByName(rest)
