"""A training-corpus pipeline over ``documents``: identify the language, drop
repeated lines, keep one document of each near-duplicate group, drop documents
contaminated by ``benchmark``, and mix the sources to their target weights.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``.  ``run`` writes
each stage's rows to the shared folder and reads them back.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import decontaminate, language_id, line_dedup, mix_sources, ngram_join
from scriptorium.llm.common import is_in_fold, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be identified go."""
    model = language_id.fit(docs.filter(~is_in_fold(F.col("doc_id"), 3, 1)))
    return language_id.predict(docs, model).filter(~language_id.rejected()).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in several documents stay in the first of them; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: the one with the smallest id, then row hash; rows without an id
    come last.  A row is known by a hash of all its columns, so rows that repeat an id with another text are
    documents of their own, and equal rows are one."""
    keyed = docs.withColumn("_key", F.xxhash64(*docs.columns))
    groups = (ngram_join.near_duplicate_groups(keyed, id_col="_key")
              .select(F.col("doc_id").alias("_key"), "component_id").distinct())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_key"))
    firsts = (groups.join(keyed.select("_key", "doc_id").distinct(), "_key").groupBy("component_id")
              .agg(first.alias("first")).select(F.col("first._key").alias("_key")))
    return keyed.join(firsts, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.remove_contaminated(docs, benchmark, mode="documents")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix_sources.taken_words(docs)


STAGES = [("language_id", identify_language), ("line_dedup", drop_repeated_lines),
          ("near_duplicates", drop_near_duplicates), ("decontaminate", drop_contaminated), ("mix", mix)]
#: Language identification has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
