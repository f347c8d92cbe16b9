"""Registered mutation queries."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..operators import held_keys as K
from ..operators import mutate as M
from ..operators import relations as R
from ..operators import validate as V
from ..session import write_once
from ..sources import tables as tb
from ..sources.tables import (AUTHORS_SQL, DOCS_SQL, KNOWN_SQL, LISTING_SQL, PAPERS_SQL,
                              with_ctes)
from .q_relations import CLASSIFY_SQL, classified
from .registry import REGISTRY, register
from .sqltext import REFERENCE_SQL

# Fixed clock and split points of the mutation checks.
NOW = dt.datetime(2026, 1, 1, 0, 0, 0)
NOW_SQL = "TIMESTAMP '2026-01-01 00:00:00'"
OLD_STAMP = dt.datetime(2025, 1, 1, 0, 0, 0)
OLD_STAMP_SQL = "TIMESTAMP '2025-01-01 00:00:00'"
BATCH_SINCE = "1997-01-01"       # incoming batch: papers listed since
RELIST_SINCE = "2001-01-01"      # ... of which these arrive twice
RELIST_SEQ = 1_000_000_000
KEYWORD_HELD_BELOW = "m"         # keywords sorting before this are held
AUTHOR_HELD_MAX_NATION = 12      # authors of nations below this are held
RENAMED_NATION = 3               # authors of this nation change their first name
WEBSITE_NATION = 5               # authors of this nation gain a website
STAMP_HELD_MAX_NATION = 20


def _ts(s):
    return F.lit(s).cast("timestamp_ntz")


def _papers_split(spark, d):
    p = tb.papers(spark, d)
    existing = p.filter(F.col("row_created_at") < _ts(tb.KNOWN_BEFORE))
    batch = p.filter(F.col("row_created_at") >= _ts(BATCH_SINCE)).select(
        "archive_id", F.col("paper_title").alias("title"), F.col("paper_date").alias("date"),
        F.col("paper_id").alias("seq"))
    again = p.filter(F.col("row_created_at") >= _ts(RELIST_SINCE)).select(
        "archive_id", F.col("paper_title").alias("title"), F.col("paper_date").alias("date"),
        (F.col("paper_id") + RELIST_SEQ).alias("seq"))
    return existing, batch.unionByName(again)


@register("insert_papers", with_ctes(PAPERS_SQL) + f"""
, ex AS (SELECT * FROM papers WHERE row_created_at < TIMESTAMP '{tb.KNOWN_BEFORE}'),
inc AS (SELECT archive_id, paper_title AS title, paper_date AS date, paper_id AS seq FROM papers
        WHERE row_created_at >= TIMESTAMP '{BATCH_SINCE}'
        UNION ALL SELECT archive_id, paper_title, paper_date, paper_id + {RELIST_SEQ} FROM papers
        WHERE row_created_at >= TIMESTAMP '{RELIST_SINCE}'),
fresh AS (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY seq) AS r FROM inc
          WHERE archive_id NOT IN (SELECT archive_id FROM ex))
SELECT CAST((SELECT max(paper_id) FROM ex) + row_number() OVER (ORDER BY seq, archive_id) AS BIGINT)
         AS paper_id, archive_id, title, split_part(date, ' ', 2) AS paper_year,
       split_part(date, ' ', 1) AS paper_month, {REFERENCE_SQL} || archive_id AS paper_reference, seq,
       CAST(NULL AS VARCHAR) AS error
FROM fresh WHERE r = 1
UNION ALL
SELECT NULL, archive_id, title, NULL, NULL, NULL, seq,
       CASE WHEN archive_id IN (SELECT archive_id FROM ex) THEN 'duplicate key: already stored'
            ELSE 'duplicate key: repeated in batch' END
FROM inc WHERE archive_id IN (SELECT archive_id FROM ex)
   OR seq NOT IN (SELECT seq FROM fresh WHERE r = 1) AND archive_id NOT IN (SELECT archive_id FROM ex)
""")
def q_insert_papers(spark, d):
    return _inserted_papers(*_papers_split(spark, d))


def _inserted_papers(existing, incoming, known=None):
    ok, bad = M.insert_papers(existing, incoming, "archive_id", "seq", NOW, known)
    cols = ["paper_id", "archive_id", "title", "paper_year", "paper_month", "paper_reference", "seq"]
    a = ok.select(*cols, F.lit(None).cast("string").alias("error"))
    b = bad.select(F.lit(None).cast("long").alias("paper_id"), "archive_id", "title",
                   F.lit(None).cast("string").alias("paper_year"),
                   F.lit(None).cast("string").alias("paper_month"),
                   F.lit(None).cast("string").alias("paper_reference"), "seq", "error")
    return a.unionByName(b)


@register("insert_ignore", f"""
WITH kw AS (SELECT DISTINCT p_name AS keyword FROM part),
held AS (SELECT min(p_partkey) AS keyword_id, p_name AS keyword FROM part
         WHERE p_name < '{KEYWORD_HELD_BELOW}' GROUP BY p_name)
SELECT CAST((SELECT max(keyword_id) FROM held) + row_number() OVER (ORDER BY keyword) AS BIGINT)
         AS keyword_id, keyword
FROM kw WHERE keyword NOT IN (SELECT keyword FROM held)""")
def q_insert_ignore(spark, d):
    held, inc = _keywords_split(spark, d)
    return M.insert_ignore(held, inc, "keyword", "keyword_id", NOW).select("keyword_id", "keyword")


def _keywords_split(spark, d):
    p = tb.table(spark, d, "part")
    held = (p.filter(F.col("p_name") < KEYWORD_HELD_BELOW).groupBy(F.col("p_name").alias("keyword"))
            .agg(F.min("p_partkey").alias("keyword_id")))
    return held, p.select(F.col("p_name").alias("keyword"))


LINKS_IN_SQL = f"""inc AS (
  SELECT l.l_suppkey AS author_id, l.l_orderkey AS paper_id, l.l_linenumber AS author_position,
         l.l_partkey, l.l_extendedprice
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
  WHERE o.o_orderdate >= TIMESTAMP '{BATCH_SINCE}'),
held AS (SELECT DISTINCT l.l_suppkey AS author_id, l.l_orderkey AS paper_id
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
  WHERE o.o_orderdate < TIMESTAMP '{tb.KNOWN_BEFORE}'),
ranked AS (SELECT inc.*, row_number() OVER (PARTITION BY author_id, paper_id
             ORDER BY author_position, l_partkey, l_extendedprice) AS r,
           EXISTS (SELECT 1 FROM held h WHERE h.author_id = inc.author_id AND h.paper_id = inc.paper_id)
             AS stored
           FROM inc)"""


@register("insert_links", f"WITH {LINKS_IN_SQL}\n" +
          "SELECT author_id, paper_id, author_position, l_partkey, l_extendedprice, "
          "CASE WHEN stored OR r > 1 THEN 'duplicate link' END AS error FROM ranked")
def q_insert_links(spark, d):
    return _inserted_links(*_links_split(spark, d))


def _links_split(spark, d):
    li = tb.table(spark, d, "lineitem")
    o = tb.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    j = li.join(o, "l_orderkey")
    inc = j.filter(F.col("o_orderdate") >= _ts(BATCH_SINCE)).select(
        F.col("l_suppkey").alias("author_id"), F.col("l_orderkey").alias("paper_id"),
        F.col("l_linenumber").alias("author_position"), "l_partkey", "l_extendedprice")
    held = j.filter(F.col("o_orderdate") < _ts(tb.KNOWN_BEFORE)).select(
        F.col("l_suppkey").alias("author_id"), F.col("l_orderkey").alias("paper_id")).distinct()
    return held, inc


def _inserted_links(held, inc, known=None):
    ok, bad = M.insert_links(held, inc, ["author_id", "paper_id"],
                             ["author_position", "l_partkey", "l_extendedprice"], known)
    return ok.withColumn("error", F.lit(None).cast("string")).unionByName(bad)


@register("upsert_authors", with_ctes(AUTHORS_SQL) + f"""
, held AS (SELECT author_id, username, first_name, last_name, email, affiliation, '' AS website
           FROM authors a JOIN supplier s ON s.s_suppkey = a.author_id
           WHERE s.s_nationkey < {AUTHOR_HELD_MAX_NATION}),
newa AS (SELECT * FROM authors WHERE username NOT IN (SELECT username FROM held))
SELECT * FROM held
UNION ALL
SELECT CAST((SELECT max(author_id) FROM held) + row_number() OVER (ORDER BY username) AS BIGINT),
       username, first_name, last_name, email, affiliation, '' FROM newa""")
def q_upsert_authors(spark, d):
    return _upserted_authors(*_authors_split(spark, d))


def _authors_split(spark, d):
    a = tb.authors(spark, d)
    s = tb.table(spark, d, "supplier").select(F.col("s_suppkey").alias("author_id"), "s_nationkey")
    held = (a.join(s, "author_id").filter(F.col("s_nationkey") < AUTHOR_HELD_MAX_NATION)
            .select("author_id", "username", "first_name", "last_name", "email", "affiliation",
                    F.lit("").alias("website")))
    listed = a.select("username", "first_name", "last_name", F.col("author_id").alias("seq"))
    return held, listed, a.select("username", "email", "affiliation", F.lit("").alias("website"))


def _upserted_authors(held, listed, profiles, known=None):
    nxt, _rej = M.upsert_authors(held, listed, profiles, NOW, known)
    return nxt.select("author_id", "username", "first_name", "last_name", "email", "affiliation",
                      "website")


@register("assign_ids", with_ctes(PAPERS_SQL) + f"""
SELECT archive_id, CAST((SELECT max(paper_id) FROM papers WHERE row_created_at < TIMESTAMP
  '{tb.KNOWN_BEFORE}') + row_number() OVER (ORDER BY row_created_at, archive_id) AS BIGINT) AS new_id
FROM papers WHERE row_created_at >= TIMESTAMP '{tb.KNOWN_BEFORE}'""")
def q_assign_ids(spark, d):
    p = tb.papers(spark, d)
    held = p.filter(F.col("row_created_at") < _ts(tb.KNOWN_BEFORE)).select(
        F.col("paper_id").alias("new_id"))
    new = p.filter(F.col("row_created_at") >= _ts(tb.KNOWN_BEFORE)).select("archive_id", "row_created_at")
    return M.assign_ids(new, held, "new_id", ["row_created_at", "archive_id"]).select(
        "archive_id", "new_id")


def _author_versions(spark, d):
    a = tb.authors(spark, d)
    s = tb.table(spark, d, "supplier").select(F.col("s_suppkey").alias("author_id"), "s_nationkey")
    a = a.join(s, "author_id")
    old = a.select("author_id", "first_name", "last_name", F.lit(None).cast("string").alias("website"),
                   "s_nationkey", _ts(OLD_STAMP).alias("row_updated_at"))
    new = a.select("author_id",
                   F.when(F.col("s_nationkey") == RENAMED_NATION, F.upper("first_name"))
                   .otherwise(F.col("first_name")).alias("first_name"), "last_name",
                   F.when(F.col("s_nationkey") == WEBSITE_NATION, F.lit("https://example.org"))
                   .alias("website"), "s_nationkey")
    return old, new


AUTHOR_VERSIONS_SQL = f"""old AS (SELECT a.author_id, a.first_name, a.last_name, CAST(NULL AS VARCHAR) AS website,
                s.s_nationkey FROM authors a JOIN supplier s ON s.s_suppkey = a.author_id),
new AS (SELECT author_id, CASE WHEN s_nationkey = {RENAMED_NATION} THEN upper(first_name) ELSE first_name END
               AS first_name, last_name,
               CASE WHEN s_nationkey = {WEBSITE_NATION} THEN 'https://example.org' END AS website, s_nationkey
        FROM old)"""


@register("touch_changed_authors", with_ctes(AUTHORS_SQL, AUTHOR_VERSIONS_SQL) + f"""
SELECT n.author_id, CASE WHEN n.first_name IS DISTINCT FROM o.first_name
   OR n.last_name IS DISTINCT FROM o.last_name OR n.website IS DISTINCT FROM o.website
   THEN {NOW_SQL} ELSE {OLD_STAMP_SQL} END AS row_updated_at
FROM new n JOIN old o ON o.author_id = n.author_id""")
def q_touch_changed_authors(spark, d):
    old, new = _author_versions(spark, d)
    out = M.touch_changed(old, new, "author_id", ["first_name", "last_name", "website"], NOW)
    return out.select("author_id", "row_updated_at")


@register("stamp_audit", with_ctes(AUTHORS_SQL, AUTHOR_VERSIONS_SQL) + f"""
SELECT n.author_id, CASE WHEN o.author_id IS NULL THEN {NOW_SQL}
   WHEN coalesce(n.first_name <> o.first_name, false) OR coalesce(n.last_name <> o.last_name, false)
     OR coalesce(n.website <> o.website, false) THEN {NOW_SQL} ELSE {OLD_STAMP_SQL} END AS row_updated_at
FROM new n LEFT JOIN (SELECT * FROM old WHERE s_nationkey < {STAMP_HELD_MAX_NATION}) o
  ON o.author_id = n.author_id""")
def q_stamp_audit(spark, d):
    """M6 with SQL ``<>`` change rule: inserted rows are stamped now; NULL ->
    value (website) is not a change under ``<>``."""
    old, new = _author_versions(spark, d)
    old = old.filter(F.col("s_nationkey") < STAMP_HELD_MAX_NATION)
    out = M.touch_changed(old, new, "author_id", ["first_name", "last_name", "website"], NOW,
                          strict_sql=True)
    return out.select("author_id", "row_updated_at")


@register("enforce_unique", """
SELECT l_orderkey AS paper_id, l_suppkey AS author_id, l_linenumber, l_partkey,
       'author_link:unique' AS violation
FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey) > 1""")
def q_enforce_unique(spark, d):
    li = tb.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id"),
        "l_linenumber", "l_partkey")
    return V.enforce_unique(li, ["paper_id", "author_id"], name="author_link", order_cols=["l_linenumber", "l_partkey"])


@register("enforce_not_null", """
SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, 'customer:not_null:balance' AS violation
FROM customer WHERE c_acctbal < 0""")
def q_enforce_not_null(spark, d):
    """M8: NOT NULL over customers whose negative balances are taken as missing."""
    c = tb.table(spark, d, "customer").select(
        "c_custkey", "c_nationkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    return V.enforce_unique(c, ["c_custkey"], not_null=["balance"], name="customer")


@register("mark_embedded", with_ctes(DOCS_SQL) + f"""
SELECT paper_id, CASE WHEN paper_id IN (SELECT doc_id FROM labels) THEN {NOW_SQL} END AS embedded_at
FROM docs""")
def q_mark_embedded(spark, d):
    ids = tb.table(spark, d, "labels").select(F.col("doc_id").alias("paper_id"))
    return M.mark_embedded(tb.docs(spark, d).select("paper_id"), ids, NOW)


def run_log(spark, d):
    """Append-only sync log from events: one start per event, one finish
    for every event that is not a 'view' (an unfinished run)."""
    e = tb.table(spark, d, "events")
    start = e.select(F.col("event_id").alias("sync_run_id"), F.lit("start").alias("kind"),
                     F.col("ts").alias("at"), F.col("event_type").alias("runner"),
                     *[F.lit(None).cast("long").alias(c) for c in
                       ("papers_seen", "papers_new", "papers_updated", "papers_failed")],
                     F.lit(None).cast("boolean").alias("success"),
                     F.lit(None).cast("string").alias("error_message"))
    is_err = F.col("event_type") == "error"
    fin = e.filter(F.col("event_type") != "view").select(
        F.col("event_id").alias("sync_run_id"), F.lit("finish").alias("kind"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                          F.floor("value").cast("int"))).alias("at"),
        F.lit(None).cast("string").alias("runner"),
        F.col("user_id").alias("papers_seen"), F.floor("value").cast("long").alias("papers_new"),
        F.get_json_object("props", "$.k").cast("long").alias("papers_updated"),
        F.when(is_err, 1).otherwise(0).cast("long").alias("papers_failed"),
        (~is_err).alias("success"),
        F.when(is_err, F.concat(F.lit("run "), F.col("event_id").cast("string"), F.lit(" failed")))
        .alias("error_message"))
    return start.unionByName(fin)


@register("sync_run_log", """
SELECT event_id AS sync_run_id, event_type AS runner, ts AS started_at,
       CASE WHEN event_type <> 'view' THEN ts + to_seconds(CAST(floor(value) AS BIGINT)) END AS finished_at,
       CASE WHEN event_type <> 'view' THEN user_id ELSE 0 END AS papers_seen,
       CASE WHEN event_type <> 'view' THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS papers_new,
       CASE WHEN event_type <> 'view' THEN coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0)
            ELSE 0 END AS papers_updated,
       CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS papers_failed,
       event_type NOT IN ('view', 'error') AS success,
       CASE WHEN event_type = 'error' THEN 'run ' || CAST(event_id AS VARCHAR) || ' failed' END
         AS error_message
FROM events""")
def q_sync_run_log(spark, d):
    return M.fold_sync_runs(run_log(spark, d))


@register("update_version", with_ctes(LISTING_SQL, KNOWN_SQL, CLASSIFY_SQL) +
          "SELECT count(*) AS version_updates FROM classified WHERE action = 'update-version'")
def q_update_version(spark, d):
    """The archive only counts version updates (no refresh)."""
    return classified(spark, d).agg(
        F.count_if(F.col("action") == "update-version").alias("version_updates"))


@register("write_table", with_ctes(AUTHORS_SQL) + f"""
, held AS (SELECT a.author_id, a.username, a.affiliation FROM authors a JOIN supplier s
           ON s.s_suppkey = a.author_id WHERE s.s_nationkey < {AUTHOR_HELD_MAX_NATION}),
inc AS (SELECT a.author_id, a.username, a.affiliation || ' (updated)' AS affiliation FROM authors a
        JOIN supplier s ON s.s_suppkey = a.author_id
        WHERE s.s_acctbal >= 0 OR a.author_id NOT IN (SELECT author_id FROM held))
SELECT coalesce(h.author_id, i.author_id) AS author_id, coalesce(h.username, i.username) AS username,
       CASE WHEN h.author_id IS NOT NULL AND i.author_id IS NOT NULL THEN i.affiliation
            ELSE coalesce(h.affiliation, i.affiliation) END AS affiliation,
       i.author_id IS NOT NULL AS affected
FROM held h FULL OUTER JOIN inc i ON h.username = i.username""")
def q_write_table(spark, d):
    """ON CONFLICT (username) DO UPDATE SET affiliation, with RETURNING;
    the incoming rows are every author with a non-negative balance plus
    every author not held."""
    a = tb.authors(spark, d)
    s = tb.table(spark, d, "supplier").select(F.col("s_suppkey").alias("author_id"), "s_nationkey",
                                              "s_acctbal")
    held = (a.join(s, "author_id").filter(F.col("s_nationkey") < AUTHOR_HELD_MAX_NATION)
            .select("author_id", "username", "affiliation"))
    inc = (a.join(s, "author_id")
           .join(held.select("author_id").withColumn("_h", F.lit(True)), "author_id", "left")
           .filter((F.col("s_acctbal") >= 0) | F.col("_h").isNull())
           .select("author_id", "username", F.concat("affiliation", F.lit(" (updated)")).alias("affiliation")))
    nxt, affected, _rej = M.insert_into(held, inc, ["username"], on_conflict="update",
                                        update_cols=["affiliation"], returning=True)
    marks = affected.select("username", F.lit(True).alias("affected"))
    return (nxt.join(marks, "username", "left")
            .select("author_id", "username", "affiliation",
                    F.coalesce("affected", F.lit(False)).alias("affected")))


def _link_batches(spark, d):
    """Held links and an incoming batch that repeats keys: one row per order
    line, keyed by (order, supplier)."""
    li = tb.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id"), "l_linenumber",
        F.col("l_partkey").alias("note"))
    held = (li.filter(F.col("paper_id") % 3 == 0).groupBy("paper_id", "author_id")
            .agg(F.min_by("note", F.struct("l_linenumber", "note")).alias("note")))
    return held, li.select("paper_id", "author_id", "note", F.col("l_linenumber").alias("seq"))


_BATCH_SQL = """WITH li AS (SELECT l_orderkey AS paper_id, l_suppkey AS author_id, l_linenumber, l_partkey AS note FROM lineitem),
ranked AS (SELECT *, row_number() OVER (PARTITION BY paper_id, author_id ORDER BY l_linenumber, note) AS k FROM li),
held AS (SELECT paper_id, author_id, note FROM ranked WHERE k = 1 AND paper_id % 3 = 0),
once AS (SELECT paper_id, author_id, note FROM ranked WHERE k = 1),
again AS (SELECT * FROM ranked WHERE k > 1)
"""


def _insert(spark, d, mode):
    held, li = _link_batches(spark, d)
    nxt, _, rejects = M.insert_into(held, li, ["paper_id", "author_id"], on_conflict=mode, order_cols=["seq", "note"],
                                    update_cols=["note"] if mode == "update" else None)
    return (nxt.select("paper_id", "author_id", "note", F.lit("held").alias("outcome"))
            .unionByName(rejects.select("paper_id", "author_id", "note", F.lit("reject").alias("outcome"))))


@register("write_plain", _BATCH_SQL + """
SELECT *, 'held' AS outcome FROM held UNION ALL
SELECT *, 'held' FROM once WHERE (paper_id, author_id) NOT IN (SELECT (paper_id, author_id) FROM held) UNION ALL
SELECT *, 'reject' FROM once WHERE (paper_id, author_id) IN (SELECT (paper_id, author_id) FROM held) UNION ALL
SELECT paper_id, author_id, note, 'reject' FROM again""")
def q_write_plain(spark, d):
    """S7 plain insert of a batch with repeated keys: rows in = rows added + rejects."""
    return _insert(spark, d, None)


@register("write_do_nothing", _BATCH_SQL + """
SELECT *, 'held' AS outcome FROM held UNION ALL
SELECT *, 'held' FROM once WHERE (paper_id, author_id) NOT IN (SELECT (paper_id, author_id) FROM held)""")
def q_write_do_nothing(spark, d):
    """S7 ON CONFLICT DO NOTHING with repeated keys."""
    return _insert(spark, d, "nothing")


@register("write_do_update", _BATCH_SQL + """
SELECT coalesce(h.paper_id, o.paper_id) AS paper_id, coalesce(h.author_id, o.author_id) AS author_id,
       coalesce(o.note, h.note) AS note, 'held' AS outcome
FROM held h FULL JOIN once o ON h.paper_id = o.paper_id AND h.author_id = o.author_id UNION ALL
SELECT paper_id, author_id, note, 'reject' FROM again""")
def q_write_do_update(spark, d):
    """S7 ON CONFLICT DO UPDATE with repeated keys."""
    return _insert(spark, d, "update")


@register("cascade_update", """
SELECT CASE WHEN l_orderkey % 5 = 0 THEN l_orderkey + 10000000 ELSE l_orderkey END AS paper_id, l_suppkey AS author_id, l_linenumber
FROM lineitem""")
def q_cascade_update(spark, d):
    """Every fifth order gets a new id and its links follow."""
    links = tb.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id"),
                                                  "l_linenumber")
    remap = tb.table(spark, d, "orders").filter(F.col("o_orderkey") % 5 == 0).select(
        F.col("o_orderkey").alias("old_paper_id"), (F.col("o_orderkey") + 10_000_000).alias("new_paper_id"))
    return R.cascade_update(links, remap)


# ------------------------------------- conflict checks on bucketed key tables ---
KEY_BUCKETS = 64


def _with_held_keys(held, key, insert):
    """``insert(known)`` with the held keys in a bucketed table, which goes once the result is written."""
    spark, name = held.sparkSession, f"held_keys_{uuid.uuid4().hex[:12]}"
    K.add_keys(held, name, key, KEY_BUCKETS)
    try:
        return write_once(insert(K.held(spark, name, key)), "inserted")
    finally:
        spark.sql(f"DROP TABLE {name}")


def _same_sql(key: str) -> str:
    return REGISTRY[key].sql


@register("insert_papers_held_keys", _same_sql("insert_papers"))
def q_insert_papers_held_keys(spark, d):
    """M1 against a bucketed table of the held ids: only the batch is shuffled."""
    existing, incoming = _papers_split(spark, d)
    return _with_held_keys(existing, ["archive_id"], lambda known: _inserted_papers(existing, incoming, known))


@register("insert_ignore_held_keys", _same_sql("insert_ignore"))
def q_insert_ignore_held_keys(spark, d):
    """M2 against held keywords."""
    held, inc = _keywords_split(spark, d)
    return _with_held_keys(held, ["keyword"], lambda known: M.insert_ignore(
        held, inc, "keyword", "keyword_id", NOW, known).select("keyword_id", "keyword"))


@register("insert_links_held_keys", _same_sql("insert_links"))
def q_insert_links_held_keys(spark, d):
    """M3 against held pairs."""
    held, inc = _links_split(spark, d)
    return _with_held_keys(held, ["author_id", "paper_id"], lambda known: _inserted_links(held, inc, known))


@register("upsert_authors_held_keys", _same_sql("upsert_authors"))
def q_upsert_authors_held_keys(spark, d):
    """M4 against held usernames."""
    held, listed, profiles = _authors_split(spark, d)
    return _with_held_keys(held, ["username"], lambda known: _upserted_authors(held, listed, profiles, known))
