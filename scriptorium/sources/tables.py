"""Driver-table loaders and the archive relations derived from them.

The archive's relations (papers, authors, keywords, the two link tables,
the run log, the crawl dump, the vector index) are *views* over the driver
tables, so every query's work grows with the input.  Each view is defined
twice, next to each other: once as a DataFrame (what runs) and once as a
SQL common-table expression (what the DuckDB oracle runs).  Keep the two in
step.

Stand-ins:

* ``papers``   <- ``orders``   (relational papers; date text "Month Year")
* ``docs``     <- ``documents`` (text papers: title = first line, abstract = rest)
* ``authors``  <- ``supplier`` (username = s_name)
* ``keywords`` <- distinct ``part.p_name`` (id = smallest part key)
* ``keyword_links`` / ``author_links`` <- ``lineitem``
* ``sync_runs`` <- ``events``
* ``listing``  <- ``orders`` as listing rows, newest first, pages 30 then 100
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import pad_id

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed parameters of the stand-in views.
KNOWN_BEFORE = "1998-01-01"          # papers already held: ordered before this
FRESH_SINCE = "2000-01-01"           # 'P' orders since this are "freshly changed"
FIRST_PAGE_SIZE = 30                 # listing page sizes (first page, then the rest)
PAGE_SIZE = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ----------------------------------------------------------------- papers ----
def papers(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("paper_id"),
        pad_id("o_orderkey").alias("archive_id"),
        F.col("o_orderpriority").alias("paper_title"),
        F.col("o_orderstatus").alias("published_in"),
        F.date_format("o_orderdate", "MMMM yyyy").alias("paper_date"),
        F.col("o_custkey").alias("downloads"),
        F.col("o_orderdate").alias("row_created_at"),
        F.col("o_orderdate").alias("row_updated_at"),
    )


PAD_SQL = ("CASE WHEN length(CAST({c} AS VARCHAR)) >= 6 THEN CAST({c} AS VARCHAR) "
           "ELSE lpad(CAST({c} AS VARCHAR), 6, '0') END")

PAPERS_SQL = f"""papers AS (
  SELECT o_orderkey AS paper_id, {PAD_SQL.format(c='o_orderkey')} AS archive_id,
         o_orderpriority AS paper_title, o_orderstatus AS published_in,
         strftime(o_orderdate, '%B %Y') AS paper_date, o_custkey AS downloads,
         o_orderdate AS row_created_at, o_orderdate AS row_updated_at
  FROM orders)"""


def docs(spark, d) -> DataFrame:
    t = table(spark, d, "documents")
    nl = F.instr("text", "\n")
    return t.select(
        F.col("doc_id").alias("paper_id"),
        pad_id("doc_id").alias("archive_id"),
        F.substring_index("text", "\n", 1).alias("paper_title"),
        F.when(nl > 0, F.expr("substring(text, instr(text, '\\n') + 1)")).alias("abstract"),
    )


DOCS_SQL = f"""docs AS (
  SELECT doc_id AS paper_id, {PAD_SQL.format(c='doc_id')} AS archive_id,
         split_part(text, chr(10), 1) AS paper_title,
         CASE WHEN strpos(text, chr(10)) > 0
              THEN substr(text, strpos(text, chr(10)) + 1) END AS abstract
  FROM documents)"""


# ---------------------------------------------------------------- authors ----
def authors(spark, d) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(
        F.col("s_suppkey").alias("author_id"),
        F.regexp_extract("s_name", "^([^#]*)", 1).alias("first_name"),
        F.regexp_extract("s_name", "([^#]*)$", 1).alias("last_name"),
        F.col("s_name").alias("username"),
        F.concat(F.lit("desk"), F.col("s_nationkey").cast("string"),
                 F.lit("@example.org")).alias("email"),
        F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("affiliation"),
    )


AUTHORS_SQL = """authors AS (
  SELECT s_suppkey AS author_id, regexp_extract(s_name, '^([^#]*)', 1) AS first_name,
         regexp_extract(s_name, '([^#]*)$', 1) AS last_name, s_name AS username,
         'desk' || CAST(s_nationkey AS VARCHAR) || '@example.org' AS email,
         'Nation ' || CAST(s_nationkey AS VARCHAR) AS affiliation
  FROM supplier)"""


# --------------------------------------------------------------- keywords ----
def keywords(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    return p.groupBy(F.col("p_name").alias("keyword")).agg(
        F.min("p_partkey").alias("keyword_id")).select("keyword_id", "keyword")


KEYWORDS_SQL = """keywords AS (
  SELECT min(p_partkey) AS keyword_id, p_name AS keyword FROM part GROUP BY p_name)"""


def keyword_links(spark, d) -> DataFrame:
    """(keyword_id, paper_id), unique.  part -> keyword is resolved on the
    dimension side first, so the fact table joins once."""
    part_kw = (table(spark, d, "part").select("p_partkey", F.col("p_name").alias("keyword"))
               .join(keywords(spark, d), "keyword").select("p_partkey", "keyword_id"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper_id"),
                                            F.col("l_partkey").alias("p_partkey"))
    return li.join(part_kw, "p_partkey").select("keyword_id", "paper_id").distinct()


KEYWORD_LINKS_SQL = """keyword_links AS (
  SELECT DISTINCT k.keyword_id, l.l_orderkey AS paper_id
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
  JOIN keywords k ON k.keyword = p.p_name)"""


def author_links(spark, d) -> DataFrame:
    """(author_id, paper_id, author_position).

    (l_orderkey, l_suppkey) repeats, so the link key is deduplicated first
    (keeping its first line number), then positions are numbered 1.. within
    a paper in line order (W1).
    """
    from ..operators.relations import author_positions
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper_id"),
                                            F.col("l_suppkey").alias("author_id"), "l_linenumber")
    first = li.groupBy("paper_id", "author_id").agg(F.min("l_linenumber").alias("first_line"))
    return author_positions(first, lines=li).select("author_id", "paper_id", "author_position")


AUTHOR_LINKS_SQL = """author_links AS (
  SELECT author_id, paper_id,
         CAST(row_number() OVER (PARTITION BY paper_id ORDER BY first_line, author_id) AS INTEGER)
           AS author_position
  FROM (SELECT l_orderkey AS paper_id, l_suppkey AS author_id, min(l_linenumber) AS first_line
        FROM lineitem GROUP BY l_orderkey, l_suppkey))"""


# -------------------------------------------------------------- sync runs ----
def sync_runs(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    is_err = F.col("event_type") == "error"
    fin = F.when(F.col("event_type") != "view", F.col("ts"))
    return e.select(
        F.col("event_id").alias("sync_run_id"),
        F.col("event_type").alias("runner"),
        F.col("ts").alias("started_at"),
        fin.alias("finished_at"),
        F.col("user_id").alias("papers_seen"),
        F.floor("value").cast("bigint").alias("papers_new"),
        F.get_json_object("props", "$.k").cast("bigint").alias("papers_updated"),
        F.when(is_err, 1).otherwise(0).cast("bigint").alias("papers_failed"),
        (~is_err & fin.isNotNull()).alias("success"),
        F.when(is_err, F.concat(F.lit("run "), F.col("event_id").cast("string"),
                                F.lit(" failed"))).alias("error_message"),
    )


SYNC_RUNS_SQL = """sync_runs AS (
  SELECT event_id AS sync_run_id, event_type AS runner, ts AS started_at,
         CASE WHEN event_type <> 'view' THEN ts END AS finished_at,
         user_id AS papers_seen, CAST(floor(value) AS BIGINT) AS papers_new,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS papers_updated,
         CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS papers_failed,
         (event_type <> 'error' AND event_type <> 'view') AS success,
         CASE WHEN event_type = 'error' THEN 'run ' || CAST(event_id AS VARCHAR) || ' failed' END
           AS error_message
  FROM events)"""


# ---------------------------------------------------------------- listing ----
def listing_status(o_status, o_date) -> F.Column:
    return (F.when((o_status == "P") & (o_date >= F.lit(FRESH_SINCE).cast("timestamp_ntz")),
                   F.lit("freshly changed"))
            .when(o_status == "O", F.lit("new"))
            .otherwise(F.date_format(o_date, "dd MMM yyyy")))


def listing(spark, d) -> DataFrame:
    """Crawled listing rows (paper_id text, title, status, listing order key)."""
    o = table(spark, d, "orders")
    return o.select(
        pad_id("o_orderkey").alias("paper_id"),
        F.col("o_orderpriority").alias("title"),
        listing_status(F.col("o_orderstatus"), F.col("o_orderdate")).alias("status"),
        F.col("o_orderdate").alias("listed_at"),
        F.col("o_orderkey").alias("listing_key"),
    )


LISTING_SQL = f"""listing AS (
  SELECT {PAD_SQL.format(c='o_orderkey')} AS paper_id, o_orderpriority AS title,
         CASE WHEN o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '{FRESH_SINCE}' THEN 'freshly changed'
              WHEN o_orderstatus = 'O' THEN 'new'
              ELSE strftime(o_orderdate, '%d %b %Y') END AS status,
         o_orderdate AS listed_at, o_orderkey AS listing_key
  FROM orders)"""


def known_ids(spark, d) -> DataFrame:
    """Ids of papers already held by the archive."""
    o = table(spark, d, "orders")
    return (o.filter(F.col("o_orderdate") < F.lit(KNOWN_BEFORE).cast("timestamp_ntz"))
            .select(pad_id("o_orderkey").alias("paper_id")))


KNOWN_SQL = f"""known AS (
  SELECT {PAD_SQL.format(c='o_orderkey')} AS paper_id FROM orders
  WHERE o_orderdate < TIMESTAMP '{KNOWN_BEFORE}')"""


# ----------------------------------------------------------------- vectors ----
def vectors(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(pad_id("vec_id").alias("id"), F.col("vec_id").alias("paper_id"),
                    F.col("embedding").alias("vec"))


def pending(spark, d) -> DataFrame:
    """Papers (text corpus) with no embedding yet: documents without a label."""
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("paper_id"))
    return docs(spark, d).join(lab, "paper_id", "left_anti")


PENDING_SQL = """pending AS (
  SELECT * FROM docs WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = docs.paper_id))"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
