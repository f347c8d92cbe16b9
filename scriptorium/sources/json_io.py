"""Legacy JSON sources and sinks.

The archive's legacy pipeline keeps all papers in one JSON array file.  We
read that format (``multiLine``, FAILFAST, a declared schema - nothing is
inferred) and write JSON Lines folders, which split across tasks.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAPER_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("authors", T.ArrayType(T.StringType())),
    T.StructField("date", T.StringType()),
    T.StructField("published_in", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("keywords_raw", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("downloads", T.LongType()),
])

AUTHOR_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in
                              ("firstName", "lastName", "authorUrl", "username")])
ARTICLE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("authors", T.MapType(T.StringType(), AUTHOR_SCHEMA)),   # JSON keys: "1", "2", ...
    T.StructField("pdfLink", T.StringType()),
    T.StructField("paperURL", T.StringType()),
    T.StructField("title", T.StringType()),
])

# Characters the legacy writer removes / collapses in the serialised JSON
# text.  Serialisation escapes C0 controls, so inside values only C1
# controls are deleted and only non-control white space is collapsed.
C1_CONTROLS = r"[\x7F-\x9F]"
RAW_JSON_WS = r"[ \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"


class PapersLoadError(RuntimeError):
    pass


def load_papers_json(spark: SparkSession, path: str, schema: T.StructType = PAPER_SCHEMA) -> DataFrame:
    """S3: a missing path is an empty table; anything else that can't be read,
    and malformed JSON, raises ``PapersLoadError('Error loading papers data')``."""
    try:
        # one JSON array file (legacy) or a JSON Lines folder
        df = (spark.read.schema(schema).option("multiLine", path.endswith(".json"))
              .option("mode", "FAILFAST").json(path))
        df.limit(1).collect()       # surface a malformed head now, not later
        return df
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise PapersLoadError("Error loading papers data") from e
    except Exception as e:  # noqa: BLE001 - whatever Spark raises for bad content
        raise PapersLoadError("Error loading papers data") from e


def sanitize_value(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, C1_CONTROLS, ""), RAW_JSON_WS, " ")


def sanitize_papers(df: DataFrame) -> DataFrame:
    """S4 clean-up: drop rows whose every field is null ("empty objects"),
    then per string value delete C1 controls and collapse white space runs."""
    nonempty = F.lit(False)
    for c in df.columns:
        nonempty = nonempty | F.col(c).isNotNull()
    out = df.filter(nonempty)
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            cols.append(sanitize_value(F.col(f.name)).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            cols.append(F.transform(F.col(f.name), sanitize_value).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return out.select(*cols)


def write_papers_json(df: DataFrame, path: str) -> str:
    """Sanitise and write JSON Lines (never over an existing path)."""
    sanitize_papers(df).write.mode("errorifexists").json(path)
    return path


def write_articles_json(rows: DataFrame, path: str) -> str:
    """Parsed legacy listing rows -> articles with an author map keyed by
    position; null fields are left out of the JSON."""
    art = rows.select(
        F.col("paper_id").alias("id"),
        F.map_from_entries(F.transform("authors", lambda a: F.struct(
            a["position"].cast("string"), F.struct(a["first_name"].alias("firstName"), a["last_name"].alias("lastName"),
                                    a["author_url"].alias("authorUrl"), a["username"].alias("username"))
        ))).alias("authors"),
        F.col("download_url").alias("pdfLink"), F.col("paper_url").alias("paperURL"), "title")
    art.write.mode("errorifexists").json(path)
    return path
