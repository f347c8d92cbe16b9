"""Registered relational queries (S6, P, J, A, W, T, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relations as R
from ..sources import tables as tb
from ..sources.tables import (AUTHOR_LINKS_SQL, AUTHORS_SQL, DOCS_SQL, KEYWORD_LINKS_SQL,
                              KEYWORDS_SQL, KNOWN_SQL, LISTING_SQL, PAPERS_SQL, PENDING_SQL,
                              SYNC_RUNS_SQL, with_ctes)
from .registry import register

# Fixed query parameters.
USERNAME = "Supplier#000000007"
AUTHOR_ID = 7
EMAIL = "desk7@example.org"
KEYWORD = "red widget"
EMBED_BATCH = 100
DELETED_STATUS = "P"
MERGE_NEW_SINCE = "1997-01-01"


def listing_order():
    """Listing order: newest first, ties by key (a total order)."""
    return [F.col("listed_at").desc(), F.col("listing_key").desc()]


LISTING_ORDER_SQL = "listed_at DESC, listing_key DESC"


def _authors_str(c):
    """array<struct<position, ..., first_name, last_name>> -> 'pos:first last|...'."""
    return F.array_join(F.transform(c, lambda a: F.concat(
        a["position"].cast("string"), F.lit(":"), a["first_name"], F.lit(" "), a["last_name"])), "|")


AUTHORS_STR_SQL = ("coalesce((SELECT string_agg(CAST(al.author_position AS VARCHAR) || ':' || "
                   "a.first_name || ' ' || a.last_name, '|' ORDER BY al.author_position) "
                   "FROM author_links al JOIN authors a ON a.author_id = al.author_id "
                   "WHERE al.paper_id = p.paper_id), '')")
KEYWORDS_STR_SQL = ("coalesce((SELECT string_agg(k.keyword, '|' ORDER BY k.keyword) "
                    "FROM keyword_links kl JOIN keywords k ON k.keyword_id = kl.keyword_id "
                    "WHERE kl.paper_id = p.paper_id), '')")


# ---------------------------------------------------------------- scans ----
@register("scan_authors", with_ctes(AUTHORS_SQL) + "SELECT * FROM authors")
def q_scan_authors(spark, d):
    return R.scan(tb.authors(spark, d), "author_id")


@register("scan_keywords", with_ctes(KEYWORDS_SQL) + "SELECT * FROM keywords")
def q_scan_keywords(spark, d):
    return R.scan(tb.keywords(spark, d), "keyword_id")


# --------------------------------------------------------------- lookups ---
@register("author_by_username", with_ctes(AUTHORS_SQL) +
          f"SELECT * FROM authors WHERE username = '{USERNAME}' ORDER BY author_id LIMIT 1")
def q_author_by_username(spark, d):
    return R.lookup_first(tb.authors(spark, d), "username", USERNAME, "author_id")


@register("author_by_email", with_ctes(AUTHORS_SQL) +
          f"SELECT * FROM authors WHERE email = '{EMAIL}' ORDER BY author_id LIMIT 1")
def q_author_by_email(spark, d):
    return R.lookup_first(tb.authors(spark, d), "email", EMAIL, "author_id")


@register("keyword_id", with_ctes(KEYWORDS_SQL) +
          f"SELECT keyword_id FROM keywords WHERE keyword = '{KEYWORD}' ORDER BY keyword_id LIMIT 1")
def q_keyword_id(spark, d):
    return R.lookup_first(tb.keywords(spark, d), "keyword", KEYWORD, "keyword_id").select("keyword_id")


@register("unembedded_papers", with_ctes(DOCS_SQL, PENDING_SQL) +
          "SELECT paper_id, archive_id, paper_title, abstract FROM pending")
def q_unembedded_papers(spark, d):
    return R.unembedded_papers(tb.pending(spark, d))


@register("drop_time_columns", with_ctes(PAPERS_SQL) +
          "SELECT * EXCLUDE (row_updated_at) FROM papers")
def q_drop_time_columns(spark, d):
    return R.drop_time_columns(tb.papers(spark, d))


@register("latest_sync_run", with_ctes(SYNC_RUNS_SQL) +
          "SELECT * FROM sync_runs ORDER BY started_at DESC, sync_run_id DESC LIMIT 1")
def q_latest_sync_run(spark, d):
    return R.latest_sync_run(tb.sync_runs(spark, d))


@register("sync_status_projection", with_ctes(SYNC_RUNS_SQL) +
          "SELECT runner, started_at, finished_at, papers_new, papers_updated, success "
          "FROM sync_runs ORDER BY started_at DESC, sync_run_id DESC LIMIT 1")
def q_sync_status(spark, d):
    return R.sync_status(tb.sync_runs(spark, d))


@register("in_list_filter", with_ctes(DOCS_SQL) +
          "SELECT * FROM docs WHERE paper_id IN (SELECT doc_id FROM labels)")
def q_in_list_filter(spark, d):
    """P5 with the id list taken from the data (embedded ids = labels)."""
    return R.filter_ids(tb.docs(spark, d), "paper_id", tb.table(spark, d, "labels").select("doc_id"))


@register("embedding_text", with_ctes(DOCS_SQL) +
          "SELECT paper_id, paper_title || '. ' || coalesce(abstract, '') AS text FROM docs")
def q_embedding_text(spark, d):
    from ..functions.text import embedding_text
    return tb.docs(spark, d).select("paper_id", embedding_text("paper_title", "abstract").alias("text"))


# ------------------------------------------------------------------ joins ---
CLASSIFY_SQL = """classified AS (
  SELECT l.*, CASE WHEN l.status = 'freshly changed' THEN 'update-version'
                   WHEN k.paper_id IS NOT NULL THEN 'skip' ELSE 'full-scrape' END AS action,
         CASE WHEN l.status <> 'freshly changed' AND k.paper_id IS NOT NULL
              THEN 'Paper ' || l.paper_id || ' already in DB' END AS reason
  FROM listing l LEFT JOIN (SELECT DISTINCT paper_id FROM known) k ON k.paper_id = l.paper_id)"""


def classified(spark, d):
    return R.classify_rows(tb.listing(spark, d), tb.known_ids(spark, d))


@register("classify_rows", with_ctes(LISTING_SQL, KNOWN_SQL, CLASSIFY_SQL) + "SELECT * FROM classified")
def q_classify_rows(spark, d):
    return classified(spark, d)


@register("non_skip_filter", with_ctes(LISTING_SQL, KNOWN_SQL, CLASSIFY_SQL) +
          "SELECT * FROM classified WHERE action <> 'skip'")
def q_non_skip(spark, d):
    return R.non_skip(classified(spark, d))


@register("papers_by_author", with_ctes(PAPERS_SQL, AUTHOR_LINKS_SQL) +
          "SELECT p.*, l.author_id, l.author_position FROM papers p JOIN author_links l "
          f"ON l.paper_id = p.paper_id WHERE l.author_id = {AUTHOR_ID}")
def q_papers_by_author(spark, d):
    return R.papers_by_author(tb.papers(spark, d), tb.author_links(spark, d), AUTHOR_ID)


@register("papers_by_keyword", with_ctes(PAPERS_SQL, KEYWORDS_SQL, KEYWORD_LINKS_SQL) +
          "SELECT * EXCLUDE (row_updated_at) FROM papers p WHERE p.paper_id IN ("
          "SELECT kl.paper_id FROM keyword_links kl JOIN keywords k ON k.keyword_id = kl.keyword_id "
          f"WHERE k.keyword = '{KEYWORD}')")
def q_papers_by_keyword(spark, d):
    return R.papers_by_keyword(tb.papers(spark, d), tb.keyword_links(spark, d),
                               tb.keywords(spark, d), KEYWORD)


@register("papers_with_authors", with_ctes(PAPERS_SQL, AUTHORS_SQL, AUTHOR_LINKS_SQL) +
          f"SELECT p.paper_id, p.archive_id, {AUTHORS_STR_SQL} AS authors, "
          "CAST((SELECT count(*) FROM author_links al WHERE al.paper_id = p.paper_id) AS INTEGER) "
          "AS n_authors FROM papers p")
def q_papers_with_authors(spark, d):
    out = R.papers_with_authors(tb.papers(spark, d), tb.authors(spark, d), tb.author_links(spark, d))
    return out.select("paper_id", "archive_id", _authors_str(F.col("authors")).alias("authors"),
                      F.size("authors").alias("n_authors"))


@register("paper_detail", with_ctes(PAPERS_SQL, AUTHORS_SQL, AUTHOR_LINKS_SQL, KEYWORDS_SQL,
                                    KEYWORD_LINKS_SQL) +
          f"SELECT p.paper_id, p.archive_id, p.paper_title, {AUTHORS_STR_SQL} AS authors, "
          f"{KEYWORDS_STR_SQL} AS keywords FROM papers p")
def q_paper_detail(spark, d):
    out = R.paper_detail(tb.papers(spark, d), tb.authors(spark, d), tb.author_links(spark, d),
                         tb.keywords(spark, d), tb.keyword_links(spark, d))
    return out.select("paper_id", "archive_id", "paper_title",
                      _authors_str(F.col("authors")).alias("authors"),
                      F.array_join("keywords", "|").alias("keywords"))


@register("new_ids", with_ctes(LISTING_SQL, KNOWN_SQL) +
          "SELECT DISTINCT CAST(paper_id AS BIGINT) AS id FROM listing "
          "WHERE CAST(paper_id AS BIGINT) NOT IN (SELECT CAST(paper_id AS BIGINT) FROM known)")
def q_new_ids(spark, d):
    front = tb.listing(spark, d).select("paper_id")
    return R.new_ids(front, tb.known_ids(spark, d)).distinct()


@register("full_load_ids", with_ctes(KNOWN_SQL) +
          "SELECT * FROM (SELECT unnest(range(2, (SELECT max(o_orderkey) + 1 FROM orders))) AS id) r "
          "WHERE id NOT IN (SELECT CAST(paper_id AS BIGINT) FROM known)")
def q_full_load_ids(spark, d):
    newest = R.newest_id(tb.table(spark, d, "orders"), "o_orderkey").first()["newest"]
    return R.full_load_ids(spark, newest, tb.known_ids(spark, d))


@register("author_profile", with_ctes(PAPERS_SQL, AUTHORS_SQL, AUTHOR_LINKS_SQL) +
          "SELECT a.author_id, a.username, coalesce((SELECT string_agg(p.archive_id || '@' || "
          "CAST(al.author_position AS VARCHAR), '|' ORDER BY p.paper_id) FROM author_links al "
          "JOIN papers p ON p.paper_id = al.paper_id WHERE al.author_id = a.author_id), '') AS papers "
          f"FROM authors a WHERE a.username = '{USERNAME}'")
def q_author_profile(spark, d):
    out = R.author_profile(tb.authors(spark, d), tb.author_links(spark, d), tb.papers(spark, d),
                           USERNAME)
    return out.select("author_id", "username", F.array_join(F.transform(
        "papers", lambda p: F.concat(p["archive_id"], F.lit("@"),
                                     p["author_position"].cast("string"))), "|").alias("papers"))


@register("cascade_delete", with_ctes(AUTHOR_LINKS_SQL) +
          "SELECT * FROM author_links WHERE paper_id NOT IN "
          f"(SELECT o_orderkey FROM orders WHERE o_orderstatus = '{DELETED_STATUS}')")
def q_cascade_delete(spark, d):
    deleted = (tb.table(spark, d, "orders").filter(F.col("o_orderstatus") == DELETED_STATUS)
               .select(F.col("o_orderkey").alias("paper_id")))
    return R.cascade_delete(tb.author_links(spark, d), deleted)


@register("resolve_keyword_ids", with_ctes(KEYWORDS_SQL) +
          "SELECT k.keyword_id, l.l_orderkey AS paper_id FROM lineitem l "
          "JOIN part p ON p.p_partkey = l.l_partkey JOIN keywords k ON k.keyword = p.p_name")
def q_resolve_keyword_ids(spark, d):
    li = tb.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper_id"), "l_partkey")
    pairs = li.join(tb.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"),
                                                      F.col("p_name").alias("keyword")), "l_partkey")
    return R.resolve_keyword_ids(pairs, tb.keywords(spark, d))


# ------------------------------------------------------------- aggregates ---
@register("newest_id", "SELECT max(o_orderkey) AS newest FROM orders")
def q_newest_id(spark, d):
    return R.newest_id(tb.table(spark, d, "orders"), "o_orderkey")


@register("distinct_values",
          "SELECT l_orderkey AS paper_id, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS keywords "
          "FROM lineitem JOIN part ON p_partkey = l_partkey WHERE length(trim(p_name)) > 0 "
          "GROUP BY l_orderkey")
def q_distinct_values(spark, d):
    li = tb.table(spark, d, "lineitem").join(
        tb.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    per = li.groupBy(F.col("l_orderkey").alias("paper_id")).agg(
        R.distinct_keywords(F.collect_list("p_name")).alias("kw"))
    return per.select("paper_id", F.array_join(F.array_sort("kw"), "|").alias("keywords"))


@register("legacy_run_stats",
          "SELECT count(*) FILTER (WHERE event_type <> 'view') AS attempted, "
          "count(*) FILTER (WHERE event_type NOT IN ('view', 'error')) AS succeeded, "
          "count(*) FILTER (WHERE event_type = 'error') AS failed, "
          "count(*) FILTER (WHERE event_type = 'view') AS skipped, "
          "CASE WHEN count(*) FILTER (WHERE event_type <> 'view') > 0 THEN round(100.0 * "
          "count(*) FILTER (WHERE event_type NOT IN ('view', 'error')) / "
          "count(*) FILTER (WHERE event_type <> 'view'), 1) END AS success_rate FROM events")
def q_legacy_run_stats(spark, d):
    e = tb.table(spark, d, "events")
    outcome = (F.when(F.col("event_type") == "view", "skipped")
               .when(F.col("event_type") == "error", "failed").otherwise("ok"))
    return R.legacy_run_stats(e.select(outcome.alias("outcome")))


# ---------------------------------------------------------------- windows ---
@register("author_position", with_ctes(AUTHOR_LINKS_SQL) + "SELECT * FROM author_links")
def q_author_position(spark, d):
    return tb.author_links(spark, d)


PAGED_SQL = f"""paged AS (
  SELECT c.*, CAST(CASE WHEN pos < 30 THEN 0 ELSE floor((pos - 30) / 100) + 1 END AS BIGINT) AS page
  FROM (SELECT *, row_number() OVER (ORDER BY {LISTING_ORDER_SQL}) - 1 AS pos FROM classified) c),
cut AS (SELECT min(page) AS cutoff FROM (SELECT page, count(*) FILTER (WHERE action <> 'skip') AS n
        FROM paged GROUP BY page) WHERE n = 0),
kept AS (SELECT p.*, (cut.cutoff IS NULL OR p.page < cut.cutoff) AS process
         FROM paged p, cut WHERE cut.cutoff IS NULL OR p.page <= cut.cutoff)"""


def cut_rows(spark, d):
    paged = R.listing_pages(classified(spark, d), listing_order())
    return R.incremental_cutoff(paged)


@register("incremental_cutoff", with_ctes(LISTING_SQL, KNOWN_SQL, CLASSIFY_SQL, PAGED_SQL) +
          "SELECT paper_id, page, action, process FROM kept")
def q_incremental_cutoff(spark, d):
    return cut_rows(spark, d).select("paper_id", "page", "action", "process")


@register("run_stats", with_ctes(LISTING_SQL, KNOWN_SQL, CLASSIFY_SQL, PAGED_SQL) +
          "SELECT count(DISTINCT page) AS pages, count(*) AS seen, "
          "count(*) FILTER (WHERE process AND action = 'full-scrape') AS full_scrapes, "
          "count(*) FILTER (WHERE process AND action = 'update-version') AS version_updates, "
          "count(*) FILTER (WHERE process AND action = 'skip') AS skipped FROM kept")
def q_run_stats(spark, d):
    rows = cut_rows(spark, d)
    # rows of the cutoff page are seen but neither processed nor skipped
    act = F.when(F.col("process"), F.col("action")).otherwise(F.lit("not-processed"))
    return R.run_stats(rows.withColumn("action", act))


@register("batch_assign", with_ctes(DOCS_SQL, PENDING_SQL) +
          f"SELECT paper_id, CAST(floor((row_number() OVER (ORDER BY paper_id) - 1) / {EMBED_BATCH}) "
          "AS BIGINT) AS batch FROM pending")
def q_batch_assign(spark, d):
    return R.batch_assign(tb.pending(spark, d).select("paper_id"), ["paper_id"], EMBED_BATCH)


# ------------------------------------------------------------------ top-k ---
@register("list_papers", with_ctes(PAPERS_SQL) + "SELECT * FROM papers ORDER BY paper_id LIMIT 20")
def q_list_papers(spark, d):
    return R.list_papers(tb.papers(spark, d))


@register("recent_papers", with_ctes(PAPERS_SQL) +
          "SELECT * FROM papers ORDER BY row_created_at DESC, paper_id DESC LIMIT 10")
def q_recent_papers(spark, d):
    return R.recent_papers(tb.papers(spark, d))


@register("sort_by_numeric_id", with_ctes(LISTING_SQL) +
          "SELECT paper_id AS id, title FROM listing ORDER BY CAST(paper_id AS BIGINT)")
def q_sort_by_numeric_id(spark, d):
    return R.sort_by_numeric_id(tb.listing(spark, d).select(F.col("paper_id").alias("id"), "title"))


# ---------------------------------------------------------------- set ops ---
MERGE_SQL = f"""ex AS (SELECT {tb.PAD_SQL.format(c='o_orderkey')} AS id, o_orderpriority AS title,
                      o_orderkey AS seq, 'existing' AS origin
               FROM orders WHERE o_orderdate < TIMESTAMP '{tb.KNOWN_BEFORE}'),
nw AS (SELECT {tb.PAD_SQL.format(c='o_orderkey')} AS id, o_orderstatus AS title, o_orderkey AS seq,
              'new' AS origin FROM orders WHERE o_orderdate >= TIMESTAMP '{MERGE_NEW_SINCE}')"""


@register("merge_keep_existing", "WITH " + MERGE_SQL +
          " SELECT * FROM ex UNION ALL SELECT * FROM nw WHERE id NOT IN (SELECT id FROM ex)")
def q_merge_keep_existing(spark, d):
    o = tb.table(spark, d, "orders")
    from ..functions.text import pad_id
    ex = (o.filter(F.col("o_orderdate") < F.lit(tb.KNOWN_BEFORE).cast("timestamp_ntz"))
          .select(pad_id("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"),
                  F.col("o_orderkey").alias("seq"), F.lit("existing").alias("origin")))
    nw = (o.filter(F.col("o_orderdate") >= F.lit(MERGE_NEW_SINCE).cast("timestamp_ntz"))
          .select(pad_id("o_orderkey").alias("id"), F.col("o_orderstatus").alias("title"),
                  F.col("o_orderkey").alias("seq"), F.lit("new").alias("origin")))
    return R.merge_keep_existing(ex, nw, "id", "seq")


@register("distinct_ids", "SELECT DISTINCT l_orderkey FROM lineitem")
def q_distinct_ids(spark, d):
    return R.distinct_ids(tb.table(spark, d, "lineitem"), "l_orderkey")


@register("ids_except", "SELECT DISTINCT o_orderkey AS paper_id FROM orders WHERE o_orderkey NOT IN "
          "(SELECT l_orderkey FROM lineitem)")
def q_ids_except(spark, d):
    o = tb.table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"))
    li = tb.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper_id"))
    return R.ids_except(o, li, "paper_id")


@register("concat_pages", with_ctes(LISTING_SQL) + "SELECT paper_id, title, status FROM listing")
def q_concat_pages(spark, d):
    """U4: listing rows arrive per status page; the union restores the whole."""
    lst = tb.listing(spark, d).select("paper_id", "title", "status")
    parts = [lst.filter(F.col("status") == s) for s in ("new", "freshly changed")]
    parts.append(lst.filter(~F.col("status").isin("new", "freshly changed")))
    return R.concat_pages(*parts)
