"""Crawl-dump sources (S1) and HTML rendering of archive pages.

``read_crawl_table`` reads what a crawler leaves behind: a Parquet table of
(page_id, url, html) or a folder of ``.html`` files (one page per file,
``wholetext``).

The render functions turn the archive relations into the three page kinds
the parsers read (listing pages, detail pages, author profile pages) with
Spark string expressions.  They make the extraction jobs run over data that
grows with the driver tables, and they give each parser an exact expected
result: parse(render(rows)) must equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relations import listing_pages
from ..functions import text as T
from . import tables as tb


def read_crawl_table(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.xxhash64(F.input_file_name()).alias("page_id"),
                      F.input_file_name().alias("url"), F.col("value").alias("html"))


def esc(c: Column) -> Column:
    """HTML-escape text content / attribute values."""
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    c = F.replace(c, F.lit(">"), F.lit("&gt;"))
    return F.replace(c, F.lit('"'), F.lit("&quot;"))


def _author_cells(spark, d) -> DataFrame:
    """paper_id (long) -> listing author cell html, ordered by position.
    An author's link is made once, not for each of their papers."""
    link = F.concat(F.lit('<a href="/_person/'), esc(F.col("username")), F.lit('">'),
                    esc(F.col("last_name")), F.lit(", "), esc(F.col("first_name")), F.lit("</a>"))
    a = tb.author_links(spark, d).join(tb.authors(spark, d).select("author_id", link.alias("h")), "author_id")
    return a.groupBy("paper_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("author_position", "h"))),
        lambda s: s["h"]), ",\n").alias("author_cell"))


NO_FILE_PRIORITY = "5-LOW"      # listing rows of this priority carry no file link


def render_listing_pages(spark, d, order_by=None) -> DataFrame:
    """Listing pages (page_id, url, html): 30 rows on the first page, then
    100; two banner tables precede the content table.  One page is built
    from at most 100 rows (bounded group)."""
    from ..plans.q_relations import listing_order
    lst = tb.listing(spark, d)
    lst = lst.withColumn("_pk", F.col("listing_key"))
    paged = listing_pages(lst, order_by or listing_order())
    o = tb.table(spark, d, "orders").select(F.col("o_orderkey").alias("_pk"), "o_orderpriority")
    cells = _author_cells(spark, d).withColumnRenamed("paper_id", "_pk")
    rows = paged.join(cells, "_pk", "left").join(o, "_pk", "left")
    pid = F.col("paper_id")
    file_cell = F.when(F.col("o_orderpriority") == NO_FILE_PRIORITY, F.lit("")).otherwise(
        F.concat(F.lit(f'<a href="{T.PAPER_PATH}'), pid, F.lit("/current.pdf?_s="),
                 F.col("listing_key").cast("string"), F.lit('">pdf</a>')))
    tr = F.concat(F.lit("<tr><td>"), F.coalesce("author_cell", F.lit("")), F.lit("</td><td>"),
                  esc(F.col("status")), F.lit("</td><td>"), file_cell,
                  F.lit(f'</td><td><a href="{T.PAPER_PATH}'), pid, F.lit('">'), esc(F.col("title")),
                  F.lit("</a></td></tr>\n"))
    # rows are dealt by page before they are grouped: lists made on the way there would be sorted and copied for nothing
    rows = rows.select("page", "listing_pos", tr.alias("h")).repartition("page")
    pages = rows.groupBy("page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("listing_pos", "h"))),
                                 lambda s: s["h"]), "").alias("body_rows"),
        F.count("*").alias("n_rows"))
    html = F.concat(
        F.lit(f"<html><head><title>{T.HOME_TITLE}</title></head><body>\n"
              f"<center><b><a href=\"{T.LISTING_PATH}\">"), F.col("n_rows").cast("string"),
        F.lit(" papers</a></b></center>\n"
              "<table><tr><td>banner</td></tr></table>\n"
              "<table><tr><td><a href=\"/\">home</a></td></tr></table>\n"
              "<table><tr><td><table>\n"), F.col("body_rows"),
        F.lit("</table></td></tr></table>\n</body></html>"))
    return pages.select(F.col("page").alias("page_id"),
                        F.concat(F.lit(T.BASE_URL + T.LISTING_PATH + "?page="),
                                 F.col("page").cast("string")).alias("url"), html.alias("html"))


def render_detail_pages(spark, d) -> DataFrame:
    """Detail pages (page_id, paper_id, url, html) for the text corpus:
    title / authors / date header in ``<center>``, a key/value table, and
    the abstract as a text node after two ``<br>``."""
    docs = tb.docs(spark, d)
    papers = tb.papers(spark, d).select("paper_id", "paper_date", "downloads")
    src = tb.table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), "source")
    names = (tb.author_links(spark, d).join(tb.authors(spark, d), "author_id")
             .groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
                 F.struct("author_position", F.concat_ws(" ", "first_name", "last_name").alias("n")))),
                 lambda s: s["n"]), ", ").alias("author_line")))
    kws = (tb.keyword_links(spark, d).join(tb.keywords(spark, d), "keyword_id")
           .groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list("keyword")), ", ")
                                    .alias("kw_line")))
    j = docs.join(papers, "paper_id", "left").join(src, "paper_id", "left") \
            .join(names, "paper_id", "left").join(kws, "paper_id", "left")
    html = F.concat(
        F.lit("<html><head><title>"), esc(F.col("paper_title")), F.lit("</title></head><body>\n<center>"),
        esc(F.col("paper_title")), F.lit("<br>"), esc(F.coalesce("author_line", F.lit(""))),
        F.lit("<br>"), esc(F.coalesce("paper_date", F.lit(""))), F.lit("</center>\n<table>"),
        F.lit("<tr><td>Keywords:</td><td>"), esc(F.coalesce("kw_line", F.lit(""))), F.lit("</td></tr>"),
        F.lit("<tr><td>Downloaded:</td><td>"), F.coalesce(F.col("downloads").cast("string"), F.lit("")),
        F.lit(" times</td></tr>"),
        F.lit("<tr><td>Published in:</td><td>"), esc(F.coalesce("source", F.lit(""))), F.lit("</td></tr>"),
        F.lit("</table>\n<br>\n<br>\n"), esc(F.coalesce("abstract", F.lit(""))), F.lit("\n</body></html>"))
    return j.select(F.col("paper_id").alias("page_id"), F.col("archive_id").alias("paper_id"),
                    F.concat(F.lit(T.BASE_URL + T.PAPER_PATH), F.col("archive_id")).alias("url"),
                    html.alias("html"))


def render_profile_pages(spark, d) -> DataFrame:
    """Author profile pages (page_id = author_id); the e-mail is shown with
    ``" @ "`` as on the archive."""
    a = tb.authors(spark, d)
    email = F.regexp_replace("email", "@", " @ ")
    html = F.concat(
        F.lit("<html><head><title>"), esc(F.col("username")), F.lit("</title></head><body>"
              "<table><tr><td class=\"label\">Name</td><td class=\"value\">"),
        esc(F.concat_ws(" ", "first_name", "last_name")),
        F.lit("</td></tr><tr><td class=\"label\">Email</td><td class=\"value\">"), esc(email),
        F.lit("</td></tr><tr><td class=\"label\">Affiliation</td><td class=\"value\">"),
        esc(F.col("affiliation")),
        F.lit("</td></tr><tr><td class=\"label\">Website</td><td class=\"value\"></td></tr>"
              "</table></body></html>"))
    return a.select(F.col("author_id").alias("page_id"),
                    F.concat(F.lit(T.BASE_URL + T.PAPER_PATH.rstrip("/") + T.PERSON_PATH), F.col("username"))
                    .alias("url"), html.alias("html"))
