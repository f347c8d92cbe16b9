"""Registered text-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import validate as V
from ..sources import tables as tb
from .registry import register
from .sqltext import RESPLIT_SQL, abstract_sql, normalize_sql, trim_sql


@register("normalize_text", f"SELECT doc_id, {normalize_sql('text')} AS text FROM documents")
def q_normalize_text(spark, d):
    return tb.table(spark, d, "documents").select("doc_id", T.normalize_text("text").alias("text"))


@register("parse_abstract", f"SELECT doc_id, {abstract_sql('text')} AS abstract FROM documents")
def q_parse_abstract(spark, d):
    return tb.table(spark, d, "documents").select("doc_id", T.parse_abstract("text").alias("abstract"))


def keyword_source(p):
    """A keyword string per part with every separator kind: commas, a
    protected comma inside brackets, ';', hyphens and '/ '."""
    return F.concat(F.col("p_name"), F.lit(", "), F.col("p_type"), F.lit(" ("), F.col("p_brand"),
                    F.lit(", size "), F.col("p_size").cast("string"), F.lit("); "),
                    F.regexp_replace("p_name", " ", "-"), F.lit(" / "), F.col("p_brand"))


KEYWORD_SOURCE_SQL = ("p_name || ', ' || p_type || ' (' || p_brand || ', size ' || "
                      "CAST(p_size AS VARCHAR) || '); ' || replace(p_name, ' ', '-') || ' / ' || p_brand")


@register("split_keywords", f"""
WITH src AS (SELECT p_partkey, {KEYWORD_SOURCE_SQL} AS s FROM part),
prot AS (SELECT p_partkey, regexp_replace(s, '\\(([^,()]*),([^()]*)\\)', '(\\1' || chr(1) || '\\2)', 'g') AS s
         FROM src),
pieces AS (SELECT p_partkey, list_transform(flatten(list_transform(
             list_transform(string_split_regex(s, '[,;]'), lambda x: replace(x, chr(1), ',')),
             lambda x: string_split_regex(x, '{RESPLIT_SQL}'))), lambda x: {trim_sql('x')}) AS kw
           FROM prot)
SELECT p_partkey, CAST(generate_subscripts(kw, 1) - 1 AS INTEGER) AS pos, unnest(kw) AS keyword
FROM pieces""")
def q_split_keywords(spark, d):
    p = tb.table(spark, d, "part")
    return p.select("p_partkey", F.posexplode(T.split_keywords(keyword_source(p))).alias("pos", "keyword"))


@register("parse_downloads",
          "SELECT doc_id, COALESCE(TRY_CAST(NULLIF(regexp_extract(text, '(\\d+)', 1), '') AS BIGINT), 0) "
          "AS downloads FROM documents")
def q_parse_downloads(spark, d):
    return tb.table(spark, d, "documents").select("doc_id", T.first_digits_int("text").alias("downloads"))


@register("extract_paper_count", """
SELECT doc_id, c AS paper_count,
       CASE WHEN c IS NULL OR c = 0 THEN 'Paper count not found' END AS error
FROM (SELECT doc_id, TRY_CAST(regexp_extract_all(text, '(\\d+)', 1)[-1] AS BIGINT) AS c FROM documents)""")
def q_extract_paper_count(spark, d):
    """H1 on text: the last digit run; a missing or zero count is reported
    in ``error`` (quarantined, not raised, in a distributed job)."""
    c = T.last_digits_int("text")
    return tb.table(spark, d, "documents").select(
        "doc_id", c.alias("paper_count"),
        F.when(c.isNull() | (c == 0), F.lit("Paper count not found")).alias("error"))


def header_lines(c):
    """H6 semantics on plain text: lines trimmed, blank lines dropped."""
    return F.filter(F.transform(F.split(c, "\n", -1), T.js_trim), lambda x: x != "")


@register("parse_header", f"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
             lambda x: {trim_sql('x')}), lambda x: x <> '') AS lines FROM documents)
SELECT doc_id, {normalize_sql('lines[1]')} AS title,
       array_to_string(list_filter(list_transform(string_split({normalize_sql('lines[2]')}, ','),
         lambda x: {trim_sql('x')}), lambda x: x <> ''), '|') AS authors,
       CASE WHEN lines[3] IS NULL OR lines[3] = '' THEN '' ELSE {normalize_sql('lines[3]')} END AS date
FROM l WHERE coalesce(lines[1], '') <> '' AND coalesce(lines[2], '') <> ''""")
def q_parse_header(spark, d):
    from ..operators.extract import parse_header
    docs = tb.table(spark, d, "documents").select("doc_id", header_lines(F.col("text")).alias("lines"))
    h = parse_header(docs, "lines")
    return h.filter(F.col("title").isNotNull()).select(
        "doc_id", "title", F.array_join("authors", "|").alias("authors"), "date")


@register("first_present_alias", """
SELECT o_orderkey,
  coalesce(NULLIF(CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END, ''),
           NULLIF(o_orderstatus, ''), '') AS published_in
FROM orders""")
def q_first_present_alias(spark, d):
    o = tb.table(spark, d, "orders")
    m = F.create_map(F.lit("publication"),
                     F.when(F.col("o_orderstatus") == "F", F.lit("")).otherwise(F.col("o_orderpriority")),
                     F.lit("published"), F.col("o_orderstatus"))
    return o.select("o_orderkey", T.first_present(m, T.PUBLISHED_KEYS).alias("published_in"))


URL_SQL = "regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^\\s/?#]+[^\\s]*$')"


@register("validate_records", f"""
SELECT page_id, array_to_string(list_filter([
    CASE WHEN NOT coalesce({URL_SQL}, false) THEN 'url' END,
    CASE WHEN NOT coalesce(length(html) > 0, false) THEN 'html' END,
    CASE WHEN NOT coalesce(page_id >= 0, false) THEN 'page_id' END], lambda x: x IS NOT NULL), ',')
  AS violations,
  coalesce({URL_SQL}, false) AND coalesce(length(html) > 0, false) AND coalesce(page_id >= 0, false)
  AS is_valid
FROM pages""")
def q_validate_records(spark, d):
    p = tb.table(spark, d, "pages")
    rules = {"url": V.is_url(F.col("url")), "html": F.length("html") > 0,
             "page_id": F.col("page_id") >= 0}
    v = V.with_violations(p, rules)
    return v.select("page_id", F.array_join("violations", ",").alias("violations"),
                    (F.size("violations") == 0).alias("is_valid"))


@register("page_url_ids", """
SELECT DISTINCT CAST(unnest(regexp_extract_all(url, '/(\\d+)', 1)) AS BIGINT) AS id FROM pages""")
def q_front_page_ids(spark, d):
    """H5 generalised to the crawl dump: numeric path ids of every page url
    (the archive's 6-digit rule is applied to rendered listing pages in
    ``parse_listing_row``)."""
    p = tb.table(spark, d, "pages")
    return (p.select(F.explode(F.regexp_extract_all("url", F.lit(r"/(\d+)"), 1)).alias("id"))
            .select(F.col("id").cast("long").alias("id")).distinct())


@register("scan_html_pages", """
SELECT page_id, url, regexp_extract(html, '<title>(.*?)</title>', 1) AS raw_title,
       CAST(length(html) AS BIGINT) AS n_chars FROM pages""")
def q_scan_html_pages(spark, d):
    from ..sources.html import read_crawl_table
    p = read_crawl_table(spark, f"{d.rstrip('/')}/pages.parquet")
    return p.select("page_id", "url", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("raw_title"),
                    F.length("html").cast("long").alias("n_chars"))
