"""Registered HTML-extraction queries (H1-H8, H12, H17) over pages rendered
from the archive relations (parse(render(rows)) must give rows back)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as X
from ..sources import html as H
from ..sources import tables as tb
from ..sources.tables import (AUTHOR_LINKS_SQL, AUTHORS_SQL, DOCS_SQL, KEYWORD_LINKS_SQL,
                              KEYWORDS_SQL, LISTING_SQL, PAPERS_SQL, with_ctes)
from .registry import register
from .sqltext import PAPER_URL_SQL, RESPLIT_SQL, abstract_sql, normalize_sql, trim_sql

LISTING_POS_SQL = """lp AS (
  SELECT l.*, o.o_orderpriority, pos,
         CAST(CASE WHEN pos < 30 THEN 0 ELSE floor((pos - 30) / 100) + 1 END AS BIGINT) AS page_id
  FROM (SELECT *, row_number() OVER (ORDER BY listed_at DESC, listing_key DESC) - 1 AS pos
        FROM listing) l JOIN orders o ON o.o_orderkey = l.listing_key),
lr AS (SELECT *, CAST(pos - CASE WHEN page_id = 0 THEN 0 ELSE 30 + (page_id - 1) * 100 END AS INTEGER)
        AS row_no FROM lp)"""

LISTING_CTES = with_ctes(LISTING_SQL, AUTHORS_SQL, AUTHOR_LINKS_SQL, LISTING_POS_SQL)


def _authors_str(legacy: bool):
    def one(a):
        return F.concat_ws(":", a["position"].cast("string"),
                           F.concat(a["first_name"], F.lit(","), a["last_name"]),
                           a["username"], a["author_url"])
    return F.array_join(F.transform("authors", one), "|")


def _authors_sql(first: str, last: str) -> str:
    return (f"coalesce((SELECT string_agg(CAST(al.author_position AS VARCHAR) || ':' || {first} || ',' || "
            f"{last} || ':' || a.username || ':/_person/' || a.username, '|' ORDER BY al.author_position) "
            "FROM author_links al JOIN authors a ON a.author_id = al.author_id "
            "WHERE al.paper_id = lr.listing_key), '')")


@register("explode_listing_rows", LISTING_CTES +
          "SELECT page_id, row_no, 4 AS n_cells FROM lr")
def q_explode_listing_rows(spark, d):
    raw = X.explode_listing_rows(H.render_listing_pages(spark, d))
    return raw.filter(F.col("error").isNull()).select("page_id", "row_no", "n_cells")


@register("parse_listing_row", LISTING_CTES +
          "SELECT page_id, row_no, paper_id, title, status, "
          f"CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE {PAPER_URL_SQL} || paper_id "
          f"|| '/current.pdf' END AS download_url, {PAPER_URL_SQL} || paper_id AS paper_url, "
          f"{_authors_sql('a.first_name', 'a.last_name')} AS authors FROM lr")
def q_parse_listing_row(spark, d):
    rows = X.parse_listing_rows(X.explode_listing_rows(H.render_listing_pages(spark, d)))
    return rows.select("page_id", "row_no", "paper_id", "title", "status", "download_url",
                       "paper_url", _authors_str(False).alias("authors"))


@register("parse_article_row", LISTING_CTES +
          "SELECT page_id, row_no, paper_id, title, "
          f"CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE {PAPER_URL_SQL} || paper_id "
          f"|| '/current.pdf' END AS download_url, {PAPER_URL_SQL} || paper_id AS paper_url, "
          f"{_authors_sql(chr(39) + chr(39) + ' || a.last_name || ' + chr(39) + ',' + chr(39), 'a.first_name')}"
          " AS authors FROM lr")
def q_parse_article_row(spark, d):
    """H4 (legacy): third table of the page, names split on a space, a
    missing file link gives null."""
    rows = X.parse_listing_rows(X.explode_listing_rows(H.render_listing_pages(spark, d), legacy=True),
                                legacy=True)
    return rows.select("page_id", "row_no", "paper_id", "title", "download_url", "paper_url",
                       _authors_str(True).alias("authors"))


@register("front_page_ids", LISTING_CTES + "SELECT DISTINCT CAST(paper_id AS BIGINT) AS id FROM lr")
def q_front_page_ids(spark, d):
    return X.front_page_ids(X.front_page(H.render_listing_pages(spark, d))).select("id")


@register("front_page_count", LISTING_CTES +
          "SELECT page_id, count(*) AS paper_count, CAST(NULL AS VARCHAR) AS error FROM lr GROUP BY page_id")
def q_front_page_count(spark, d):
    """H1 on rendered front pages (count text of ``center > b > a``)."""
    return X.paper_count(X.front_page(H.render_listing_pages(spark, d)))


DETAIL_SQL = """det AS (
  SELECT d.paper_id AS page_id, d.archive_id, d.paper_title, d.abstract, p.paper_date,
         p.downloads, doc.source,
         (SELECT string_agg(a.first_name || ' ' || a.last_name, ', ' ORDER BY al.author_position)
          FROM author_links al JOIN authors a ON a.author_id = al.author_id
          WHERE al.paper_id = d.paper_id) AS author_line,
         (SELECT string_agg(k.keyword, ', ' ORDER BY k.keyword) FROM keyword_links kl
          JOIN keywords k ON k.keyword_id = kl.keyword_id WHERE kl.paper_id = d.paper_id) AS kw_line
  FROM docs d LEFT JOIN papers p ON p.paper_id = d.paper_id
  LEFT JOIN documents doc ON doc.doc_id = d.paper_id),
det2 AS (SELECT *, list_filter([""" + trim_sql("paper_title") + ", " + \
    trim_sql("coalesce(author_line, '')") + ", " + trim_sql("coalesce(paper_date, '')") + \
    """], lambda x: x <> '') AS lines,
         CASE WHEN """ + trim_sql("coalesce(abstract, '')") + """ <> ''
              THEN chr(10) || abstract || chr(10) ELSE '' END AS raw_abstract FROM det)"""

DETAIL_CTES = with_ctes(DOCS_SQL, PAPERS_SQL, AUTHORS_SQL, AUTHOR_LINKS_SQL, KEYWORDS_SQL,
                        KEYWORD_LINKS_SQL, DETAIL_SQL)


def _raw(spark, d):
    return X.extract_detail_raw(H.render_detail_pages(spark, d))


@register("parse_center_lines", DETAIL_CTES +
          "SELECT page_id, array_to_string(lines, '|') AS lines FROM det2")
def q_parse_center_lines(spark, d):
    return _raw(spark, d).select("page_id", F.array_join("lines", "|").alias("lines"))


@register("parse_kv_table", DETAIL_CTES + f"""
SELECT page_id, array_to_string(list_sort(list_filter([
   CASE WHEN {trim_sql("coalesce(kw_line, '')")} <> '' THEN 'keywords=' || {trim_sql('kw_line')} END,
   'downloaded=' || {trim_sql("coalesce(CAST(downloads AS VARCHAR), '') || ' times'")},
   CASE WHEN {trim_sql("coalesce(source, '')")} <> '' THEN 'published in=' || {trim_sql('source')} END],
   lambda x: x IS NOT NULL)), '|') AS kv FROM det2""")
def q_parse_kv_table(spark, d):
    kv = F.array_join(F.array_sort(F.transform(F.map_entries("kv"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"]))), "|")
    return _raw(spark, d).select("page_id", kv.alias("kv"))


@register("extract_raw_abstract", DETAIL_CTES + "SELECT page_id, raw_abstract FROM det2")
def q_extract_raw_abstract(spark, d):
    return _raw(spark, d).select("page_id", "raw_abstract")


def _kw_split_sql(x: str) -> str:
    """Keyword split for bracket-free input (keyword texts hold no brackets)."""
    return (f"list_transform(flatten(list_transform(string_split_regex({x}, '[,;]'), "
            f"lambda p: string_split_regex(p, '{RESPLIT_SQL}'))), lambda k: {trim_sql('k')})")


@register("parse_paper_page", DETAIL_CTES + f"""
SELECT page_id, archive_id, {normalize_sql('lines[1]')} AS title,
  array_to_string(list_filter(list_transform(string_split({normalize_sql('lines[2]')}, ','),
    lambda x: {trim_sql('x')}), lambda x: x <> ''), '|') AS authors,
  CASE WHEN coalesce(lines[3], '') <> '' THEN {normalize_sql('lines[3]')} ELSE '' END AS date,
  {normalize_sql(trim_sql("coalesce(source, '')"))} AS published_in,
  {normalize_sql(trim_sql("coalesce(kw_line, '')"))} AS keywords_raw,
  array_to_string({_kw_split_sql(normalize_sql(trim_sql("coalesce(kw_line, '')")))}, '|') AS keywords,
  CASE WHEN starts_with(raw_abstract, 'Format:') THEN '' ELSE {abstract_sql('raw_abstract')} END AS abstract,
  coalesce(downloads, 0) AS downloads,
  {PAPER_URL_SQL} || archive_id || '/current.pdf' AS download_url,
  {PAPER_URL_SQL} || archive_id AS paper_url
FROM det2 WHERE coalesce(lines[1], '') <> '' AND coalesce(lines[2], '') <> ''""")
def q_parse_paper_page(spark, d):
    valid, _bad = X.parse_paper_pages(H.render_detail_pages(spark, d))
    return valid.select("page_id", "archive_id", "title", F.array_join("authors", "|").alias("authors"),
                        "date", "published_in", "keywords_raw",
                        F.array_join("keywords", "|").alias("keywords"), "abstract", "downloads",
                        "download_url", "paper_url")


@register("parse_author_profile", with_ctes(AUTHORS_SQL) +
          "SELECT author_id AS page_id, email, affiliation, '' AS website, "
          "CAST(NULL AS VARCHAR) AS error FROM authors")
def q_parse_author_profile(spark, d):
    return X.parse_author_profiles(H.render_profile_pages(spark, d))


# ------------------------------------------------------- the given pages ----
def _refs_sql(x: str) -> str:
    """Character references resolved."""
    for ref, ch in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{ref}', '{ch}')"
    return x


def _text_sql(x: str) -> str:
    """Text of an element without children: references, then H13."""
    return normalize_sql(_refs_sql(x))


def _element_sql(tag: str) -> str:
    return (f"CASE WHEN regexp_matches(html, '<{tag}>[^<]*</{tag}>') THEN "
            + _text_sql(f"regexp_extract(html, '<{tag}>([^<]*)</{tag}>', 1)") + " END")


_LINK = '<a href="([^"]*)">([^<]*)</a>'


@register("site_page_titles", f"SELECT page_id, {_element_sql('title')} AS title, {_element_sql('h1')} AS heading, "
          f"CAST(len(regexp_extract_all(coalesce(html, ''), '{_LINK}')) AS INTEGER) AS n_links FROM pages")
def q_site_page_titles(spark, d):
    """Title, heading and number of links of the given pages by the tree builder, against regular expressions."""
    return X.parse_site_pages(tb.table(spark, d, "pages")).select("page_id", "title", "heading", F.size("links").alias("n_links"))


@register("site_page_links", f"""SELECT page_id, CAST(i - 1 AS INTEGER) AS link_no, {_refs_sql('hrefs[i]')} AS href,
  {_text_sql('texts[i]')} AS text
FROM (SELECT *, unnest(range(1, len(hrefs) + 1)) AS i
  FROM (SELECT page_id, regexp_extract_all(html, '{_LINK}', 1) AS hrefs, regexp_extract_all(html, '{_LINK}', 2) AS texts FROM pages))""")
def q_site_page_links(spark, d):
    return X.site_links(X.parse_site_pages(tb.table(spark, d, "pages")))
