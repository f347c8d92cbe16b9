"""Refresh of changed papers (M12): field-level differences and dated versions.

A refresh compares what was observed now with what is held.  Each changed
field becomes a row (key, field, old value, new value), and the history keeps
one row per version of a key with the time it became valid and the time it
stopped (null: still valid).  Nothing is updated in place: a refresh gives the
next history, in which a changed or vanished key's open version is closed and
the new state opened.

Keys are unique per observation; a key that repeats counts with its largest
row.  Comparison is null-safe.  Rows with a null key are left out.  A refresh
with the same observation changes nothing, so it may be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALID = ("valid_from", "valid_to")


def _image(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    rows = df.filter(F.col(key).isNotNull()).select(key, F.struct(*fields).alias("_row"))
    return rows.groupBy(key).agg(F.max("_row").alias("_row"))


def field_changes(held: DataFrame, observed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old_value, new_value) as text of every field that differs for keys in both tables."""
    both = _image(held, key, fields).withColumnRenamed("_row", "_held").join(_image(observed, key, fields).withColumnRenamed("_row", "_now"), key)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_held.{f}").cast("string").alias("old_value"),
                               F.col(f"_now.{f}").cast("string").alias("new_value"),
                               F.col(f"_held.{f}").eqNullSafe(F.col(f"_now.{f}")).alias("same")) for f in fields])
    return both.select(key, F.inline(F.filter(pairs, lambda p: ~p["same"]))).drop("same")


def first_versions(observed: DataFrame, key: str, fields: list[str], at) -> DataFrame:
    """The history after a first observation."""
    return _image(observed, key, fields).select(key, "_row.*", _time(at).alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))


def refresh_versions(history: DataFrame, observed: DataFrame, key: str, fields: list[str], at, gone: bool = True) -> DataFrame:
    """The next history: versions of changed keys are closed at ``at`` and their new state opened; ``gone``: an open key
    that was not observed is closed too."""
    now = _image(observed, key, fields).withColumnRenamed("_row", "_now")
    is_open = F.col("valid_to").isNull()
    current = history.filter(is_open).join(now, key, "left")
    seen = F.col("_now").isNotNull()
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"_now.{f}"))
    ends = (seen & differs) | (~seen if gone else F.lit(False))
    closed = current.withColumn("valid_to", F.when(ends, _time(at))).drop("_now")
    known = history.filter(is_open).select(key, F.struct(*fields).alias("_held"))
    opened = now.join(known, key, "left").filter(~F.col("_held").eqNullSafe(F.col("_now")))
    opened = opened.select(key, "_now.*", _time(at).alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    return history.filter(~is_open).unionByName(closed).unionByName(opened)


def as_of(history: DataFrame, at) -> DataFrame:
    """The state at a time: versions that had begun and not yet ended."""
    t = _time(at)
    return history.filter((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t))).drop(*VALID)


def _time(at) -> Column:
    return at if isinstance(at, Column) else F.lit(at).cast("timestamp_ntz")
