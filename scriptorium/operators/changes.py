"""Change feed: what differs between two versions of a table.

The archive's triggers see every row as it changes; here two versions of the
tables are compared.  A feed has one row per changed key with its kind
(insert, update, delete) and the OLD and NEW images, and gives the change set
that index upkeep takes.

Only keys and 128-bit row hashes are shuffled to find the changed keys; the
images are then fetched for those alone.  Comparison is null-safe.  A key that
repeats within a version counts with all its rows: the hashes are summed, and
the image is the largest row.  Null key values are values like others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_once, write_parquet
from .search import ChangeSet

#: The key of each archive relation.
KEYS = {"papers": ["paper_id"], "authors": ["author_id"], "keywords": ["keyword_id"],
        "author_links": ["author_id", "paper_id"], "keyword_links": ["keyword_id", "paper_id"]}
#: Columns whose change is a change of the searched text; other columns of these tables are not indexed.
WATCHED = {"authors": ["first_name", "last_name"], "keywords": ["keyword"]}


@dataclass
class ChangeFeed:
    """Per relation a frame (change, key columns, old, new)."""
    papers: DataFrame
    authors: DataFrame
    keywords: DataFrame
    author_links: DataFrame
    keyword_links: DataFrame


def _side(df: DataFrame, key: list[str], columns: list[str], sign: int) -> DataFrame:
    def h(salt: int) -> Column:
        return F.xxhash64(F.lit(salt), *columns)
    return df.select(*key, h(1).alias("h1"), h(2).alias("h2"), F.lit(sign).cast("tinyint").alias("side"))


def _balance(h: str) -> Column:
    """The hashes of the new rows less those of the old: as decimals, so rows of one key neither cancel nor overflow."""
    x = F.col(h).cast("decimal(38,0)")
    return F.sum(F.when(F.col("side") < 0, -x).otherwise(x))


def table_changes(old: DataFrame, new: DataFrame, key: list[str], watched: list[str] | None = None) -> DataFrame:
    """(change, *key, old, new) of every key whose rows differ in the ``watched`` columns (default: all)."""
    columns = sorted(watched or old.columns)
    both = _side(old, key, columns, -1).unionByName(_side(new, key, columns, 1))
    # dealt by key before they are grouped: grouping whole files first would hold every (distinct) key of a file
    both = both.repartition(*key)
    had, has = F.count_if(F.col("side") < 0), F.count_if(F.col("side") > 0)
    kind = F.when(had == 0, "insert").when(has == 0, "delete").otherwise("update")
    found = both.groupBy(*key).agg(kind.alias("change"), _balance("h1").alias("d1"), _balance("h2").alias("d2"), (had == has).alias("even"))
    found = write_once(found.filter("d1 <> 0 or d2 <> 0 or not even").select(*key, "change"), "changed-keys")

    def images(df: DataFrame, name: str) -> DataFrame:
        keys = found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)])
        same = None
        for i, k in enumerate(key):
            e = F.col(k).eqNullSafe(F.col(f"_k{i}"))
            same = e if same is None else same & e
        mine = df.join(keys, same, "left_semi")
        return mine.groupBy(*key).agg(F.max(F.struct(*[c for c in df.columns])).alias(name))

    def joined(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        right = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], name)
        same = None
        for i, k in enumerate(key):
            e = F.col(k).eqNullSafe(F.col(f"_k{i}"))
            same = e if same is None else same & e
        return left.join(right, same, "left").select(*left.columns, name)
    out = joined(joined(found, images(old, "old"), "old"), images(new, "new"), "new")
    return out.select("change", *key, "old", "new")


def change_feed(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> ChangeFeed:
    """The feed between two versions of the archive relations, by the names of KEYS."""
    return ChangeFeed(**{t: table_changes(old[t], new[t], key, (key + WATCHED[t]) if t in WATCHED else None) for t, key in KEYS.items()})


def write_feed(feed: ChangeFeed, path: str) -> ChangeFeed:
    """Store a feed (in a shared folder) and read it back."""
    spark = feed.papers.sparkSession
    for t in KEYS:
        write_parquet(getattr(feed, t), f"{path}/{t}")
    return read_feed(spark, path)


def read_feed(spark: SparkSession, path: str) -> ChangeFeed:
    return ChangeFeed(**{t: spark.read.parquet(f"{path}/{t}") for t in KEYS})


def change_set(feed: ChangeFeed) -> ChangeSet:
    """The frames of the 11 upkeep rules.  An id that changes its key comes as a delete and an insert; a keyword or
    author that comes or goes counts like a renamed one for the papers linked to it."""
    came, went = F.col("change") != "delete", F.col("change") != "insert"

    def links(df: DataFrame) -> DataFrame:
        return df.select(F.when(came, F.col("paper_id")).alias("paper_id"), F.when(went, F.col("paper_id")).alias("old_paper_id"))
    return ChangeSet(
        papers_upserted=feed.papers.filter(came).select("paper_id"),
        papers_deleted=feed.papers.filter("change = 'delete'").select("paper_id"),
        keyword_links=links(feed.keyword_links), author_links=links(feed.author_links),
        keywords_renamed=feed.keywords.select("keyword_id"), authors_renamed=feed.authors.select("author_id"))


def flat_feed(feed: ChangeFeed) -> DataFrame:
    """(relation, change, id, paper_id): every change of the feed in one frame; paper_id is null but for links."""
    out = None
    for t, key in KEYS.items():
        paper = F.col(key[1]) if len(key) > 1 else F.lit(None).cast("long")
        rows = getattr(feed, t).select(F.lit(t).alias("relation"), "change", F.col(key[0]).cast("long").alias("id"), paper.cast("long").alias("paper_id"))
        out = rows if out is None else out.unionByName(rows)
    return out
