import pytest
from pyspark.sql import types as T

#: documents-like rows; extra columns clash with names the operators use
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("h", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """rows: (doc_id, text[, lang[, source]])"""
    def make(rows):
        full = []
        for r in rows:
            i, t, lang, src = (list(r) + [None, None])[:4]
            full.append((i, t, lang, src, len(t or ""), "x", "y", "z"))
        return spark.createDataFrame(full, SCHEMA)
    return make


@pytest.fixture(scope="session")
def small_docs(spark):
    """All documents of the smallest tables, as (doc_id, text, lang, source) tuples."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


#: nulls, empties, blanks, very long, repeated rows, ties
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (4, "word"), (None, "no id at all here"), (5, "x" * 300_000),
       (6, "one two three four five six " * 4000), (7, "one two three four five six " * 4000), (8, "\n\n\n"),
       (9, "ünï çödé ß 漢字 \U0001F600 " * 30)]
