"""Relational operators: lookups, projections, joins, aggregates, windows,
top-k, set operations (P, J, A, W, T, U of the survey).

All are pure DataFrame -> DataFrame functions.  Design rules applied:

* point lookups are filters pushed to the scan, then ``limit`` with a stable
  order (the archive's unordered ``LIMIT`` is made deterministic);
* one-to-many nesting aggregates the link side *before* joining (never join
  two link tables to each other: the product fans out);
* dense numbering never uses a window without PARTITION BY - see
  :func:`dense_index`;
* small argument lists are inlined (``isin``), large ones become semi joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FRESHLY_CHANGED
from ..session import write_once

ISIN_MAX = 10_000          # above this an id list is joined, not inlined


# --------------------------------------------------------------- helpers ---
def dense_index(df: DataFrame, order_by: list, name: str = "idx") -> DataFrame:
    """0-based dense row number in a total order, computed distributed.

    Rows are range-sorted and written once with their (partition, row) place;
    numbers and per-partition counts both come from that one written table,
    so they agree whatever a re-run of the sort would sample.  The number is
    the place in the partition plus the rows of all earlier partitions (one
    row per partition, broadcast).  ``order_by`` must be a total order (end it
    with a unique key).
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order_by]
    # monotonically_increasing_id: partition number in the upper 31 bits, row number below
    s = write_once(df.sort(*cols).withColumn("_place", F.monotonically_increasing_id()), "sorted-rows")
    part = F.shiftrightunsigned("_place", 33)
    row = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = s.groupBy(part.alias("_pid")).agg((F.max(row) + 1).alias("_n"))
    offs = counts.select("_pid", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (s.withColumn("_pid", part).join(F.broadcast(offs), "_pid")
            .withColumn(name, (F.col("_off") + row).cast("long"))
            .drop("_pid", "_place", "_off"))


HOT_GROUP_ROWS = 1_000_000      # groups above this many rows are split across tasks


def group_positions(df: DataFrame, group: str, order_cols: list[str], name: str = "pos",
                    hot_rows: int = HOT_GROUP_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """1-based position of each row inside its group, in ``order_cols`` order
    (``group`` + ``order_cols`` must be unique) - skew-safe.

    Groups are split by size first (a partial-aggregated count per group,
    done once): ordinary groups (at most ``hot_rows`` rows) take one plain
    window, whose task never holds more than ``hot_rows`` rows of a group; hot
    groups - at most rows / ``hot_rows`` of them, so their key set is
    broadcast with a proven bound - take :func:`_spread_positions`.  Both give
    the same positions.  ``counted``: rows to count instead, at least as many
    of each group, where ``df`` is dear to work out.
    """
    sizes = (df if counted is None else counted).groupBy(group).agg(F.count("*").alias("_gn"))
    hot = write_once(sizes.filter(F.col("_gn") > hot_rows).select(group, F.lit(True).alias("_hot")), "hot-groups")
    w = Window.partitionBy(group).orderBy(*order_cols)
    position = F.row_number().over(w).cast("int")
    if hot.isEmpty():
        return df.select(group, *[c for c in df.columns if c != group]).withColumn(name, position)
    tagged = df.join(F.broadcast(hot), group, "left")
    cold = tagged.filter(F.col("_hot").isNull()).drop("_hot").withColumn(name, position)
    warm = tagged.filter(F.col("_hot")).drop("_hot")
    return cold.unionByName(_spread_positions(warm, group, order_cols, name))


def _spread_positions(df: DataFrame, group: str, order_cols: list[str], name: str) -> DataFrame:
    """Positions for hot groups: rows are numbered densely in (group, order)
    order, and a group's first number - one row per hot group, broadcast with
    the bound of :func:`group_positions` - is subtracted."""
    s = dense_index(df, [group, *order_cols], "_i")
    first = s.groupBy(group).agg(F.min("_i").alias("_i0"))
    return (s.join(F.broadcast(first), group)
            .withColumn(name, (F.col("_i") - F.col("_i0") + 1).cast("int")).drop("_i", "_i0"))


def first_per_key(df: DataFrame, key: list[str], order_cols: list[str],
                  last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order_cols``.

    A grouped ``min_by``/``max_by`` over the whole row: partial aggregation
    keeps one candidate per key per map task, so a key holding a third of
    all rows never lands in one task (a ``row_number`` window would).
    """
    pick = F.max_by if last else F.min_by
    return (df.groupBy(*key).agg(pick(F.struct(*df.columns), F.struct(*order_cols)).alias("_row"))
            .select("_row.*"))


def split_first_per_key(df: DataFrame, key: list[str], order_cols: list[str],
                        last: bool = False) -> tuple[DataFrame, DataFrame]:
    """(first row per key, all other rows): together exactly the input rows.

    Rows that tie on ``order_cols`` are told apart by a row number given when
    they are written once, so repeated rows go to the second frame.
    """
    s = write_once(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    chosen = first_per_key(s, key, [*order_cols, "_row"], last)
    rest = s.join(chosen.select("_row"), "_row", "left_anti")
    return chosen.drop("_row"), rest.drop("_row")


def filter_ids(df: DataFrame, col: str, ids) -> DataFrame:
    """P5: keep rows whose ``col`` is in ``ids``; an empty list keeps none
    (an update over no ids touches no row).

    ``ids`` may be a Python collection (inlined, pushed to the scan) or a
    DataFrame with one column (semi join; AQE broadcasts it when small).
    """
    if isinstance(ids, DataFrame):
        other = ids.select(F.col(ids.columns[0]).alias(col)).distinct()
        return df.join(other, col, "left_semi")
    ids = list(dict.fromkeys(ids))
    if not ids:
        return df.limit(0)
    if len(ids) > ISIN_MAX:
        spark = df.sparkSession
        return filter_ids(df, col, spark.createDataFrame([(i,) for i in ids], [col]))
    return df.filter(F.col(col).isin(ids))


# ------------------------------------------------------- lookups (P1, S6) ---
def lookup_first(df: DataFrame, col: str, value, order_by: str) -> DataFrame:
    """First row with ``col == value`` (by ``order_by``), or no row."""
    return df.filter(F.col(col) == F.lit(value)).orderBy(order_by).limit(1)


def scan(df: DataFrame, order_by: str, limit: int | None = None) -> DataFrame:
    """Full scan, optional limit with a stable order."""
    if limit is None or limit <= 0:
        return df
    return df.orderBy(order_by).limit(limit)


def unembedded_papers(papers: DataFrame, limit: int | None = None,
                      embedded_col: str = "embedded_at") -> DataFrame:
    """Papers with no embedding yet, four columns; with a ``limit`` the
    first so many by id, else all."""
    p = papers.filter(F.col(embedded_col).isNull()) if embedded_col in papers.columns else papers
    return scan(p.select("paper_id", "archive_id", "paper_title", "abstract"), "paper_id", limit)


TIME_COLUMNS = ("row_updated_at", "data_created_at", "data_updated_at")


def drop_time_columns(df: DataFrame, drop_created: bool = False) -> DataFrame:
    """Drop audit columns.  The archive keeps ``row_created_at`` (its
    list names the empty string instead); ``drop_created=True`` drops it too."""
    cols = TIME_COLUMNS + (("row_created_at",) if drop_created else ())
    return df.drop(*[c for c in cols if c in df.columns])


SYNC_PUBLIC = ("runner", "started_at", "finished_at", "papers_new", "papers_updated", "success")


def latest_sync_run(runs: DataFrame) -> DataFrame:
    """Newest run by started_at (ties: larger id), or no row.

    A single global ``max_by`` aggregate: partial per partition, one row out.
    """
    cols = runs.columns
    best = runs.agg(F.max_by(F.struct(*cols), F.struct("started_at", "sync_run_id")).alias("r"))
    return best.filter(F.col("r").isNotNull()).select("r.*")


def sync_status(runs: DataFrame) -> DataFrame:
    """The six public columns of the latest run."""
    return latest_sync_run(runs).select(*SYNC_PUBLIC)


def non_skip(actions: DataFrame) -> DataFrame:
    """Rows whose action is not ``skip``."""
    return actions.filter(F.col("action") != "skip")


# ----------------------------------------------------------------- joins ---
def papers_by_author(papers: DataFrame, author_links: DataFrame, author_id,
                     limit: int | None = None) -> DataFrame:
    """Papers of one author, each row carrying the link columns.

    The link side is filtered first (tiny), so the join broadcasts it.
    """
    lk = author_links.filter(F.col("author_id") == F.lit(author_id))
    out = papers.join(lk, "paper_id")
    return scan(out, "paper_id", limit)


def papers_by_keyword(papers: DataFrame, keyword_links: DataFrame, keywords: DataFrame,
                      keyword: str, limit: int | None = None) -> DataFrame:
    """Papers linked to a keyword text, audit columns dropped."""
    kid = keywords.filter(F.col("keyword") == F.lit(keyword)).select("keyword_id")
    lk = keyword_links.join(kid, "keyword_id", "left_semi").select("paper_id").distinct()
    return scan(drop_time_columns(papers.join(lk, "paper_id", "left_semi")), "paper_id", limit)


def nested_authors(authors: DataFrame, author_links: DataFrame) -> DataFrame:
    """(paper_id, authors array<struct<position, first_name, last_name, ...>>)
    sorted by position - aggregated on the link side first."""
    return (author_links.join(authors, "author_id")
            .groupBy("paper_id")
            .agg(F.array_sort(F.collect_list(F.struct(
                F.col("author_position").alias("position"), "author_id", "first_name",
                "last_name", "username"))).alias("authors")))


def nested_keywords(keywords: DataFrame, keyword_links: DataFrame) -> DataFrame:
    return (keyword_links.join(keywords, "keyword_id").groupBy("paper_id")
            .agg(F.array_sort(F.collect_list("keyword")).alias("keywords")))


def papers_with_authors(papers: DataFrame, authors: DataFrame, author_links: DataFrame,
                        limit: int | None = None) -> DataFrame:
    """Every paper with its ordered authors; no authors -> []."""
    nest = nested_authors(authors, author_links)
    out = (papers.join(nest, "paper_id", "left")
           .withColumn("authors", F.coalesce("authors", F.array().cast(nest.schema["authors"].dataType))))
    return scan(out, "paper_id", limit)


def paper_detail(papers: DataFrame, authors: DataFrame, author_links: DataFrame,
                 keywords: DataFrame, keyword_links: DataFrame,
                 archive_id: str | None = None) -> DataFrame:
    """paper(s) with authors[] and keywords[]; both link sides are
    pre-aggregated separately, then two left joins (no fan-out)."""
    p = papers if archive_id is None else papers.filter(F.col("archive_id") == archive_id)
    if archive_id is not None:
        ids = p.select("paper_id")
        author_links = author_links.join(ids, "paper_id", "left_semi")
        keyword_links = keyword_links.join(ids, "paper_id", "left_semi")
    na = nested_authors(authors, author_links)
    nk = nested_keywords(keywords, keyword_links)
    return (p.join(na, "paper_id", "left").join(nk, "paper_id", "left")
            .withColumn("authors", F.coalesce("authors", F.array().cast(na.schema["authors"].dataType)))
            .withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>"))))


def classify_rows(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Action per listing row.

    ``freshly changed`` -> update-version (no lookup); otherwise a known id ->
    skip with reason, else full-scrape.  Set-wise: one left join against the
    distinct known ids (instead of one lookup per row).
    """
    k = known.select(F.col("paper_id").alias("_kid")).distinct().withColumn("_known", F.lit(True))
    j = listing.join(k, listing["paper_id"] == k["_kid"], "left")
    action = (F.when(F.col("status") == FRESHLY_CHANGED, F.lit("update-version"))
              .when(F.col("_known"), F.lit("skip"))
              .otherwise(F.lit("full-scrape")))
    reason = F.when((F.col("status") != FRESHLY_CHANGED) & F.col("_known"),
                    F.concat(F.lit("Paper "), F.col("paper_id"), F.lit(" already in DB")))
    return j.select(*listing.columns, action.alias("action"), reason.alias("reason"))


def new_ids(front_ids: DataFrame, current_ids: DataFrame) -> DataFrame:
    """Front-page ids not held (compared as integers).

    An empty current set yields an empty result (the caller runs a full
    load instead, J11); the emptiness test reads at most one row.
    """
    f = front_ids.select(F.col(front_ids.columns[0]).cast("long").alias("id"))
    c = current_ids.select(F.col(current_ids.columns[0]).cast("long").alias("id"))
    if c.isEmpty():
        return f.limit(0)
    return f.join(c, "id", "left_anti")


def full_load_ids(spark, newest: int, current_ids: DataFrame | None = None) -> DataFrame:
    """Ids 2..newest (minus held ones), generated by ``spark.range``."""
    r = spark.range(2, int(newest) + 1).select(F.col("id").cast("long").alias("id"))
    if current_ids is None:
        return r
    c = current_ids.select(F.col(current_ids.columns[0]).cast("long").alias("id"))
    return r.join(c, "id", "left_anti")


def hydrate_hits(hits: DataFrame, details: DataFrame, key: str = "paper_id") -> DataFrame:
    """Top-k hits left-joined to paper details; order and score kept,
    missing paper -> null columns (see ``vector.hydrate_hits``)."""
    from .vector import hydrate_hits as _h
    return _h(hits, details, key)


def author_profile(authors: DataFrame, author_links: DataFrame, papers: DataFrame,
                   username: str | None = None) -> DataFrame:
    """author(s) + array of their papers; unknown username -> no row."""
    a = authors if username is None else authors.filter(F.col("username") == username)
    lk = author_links.join(a.select("author_id"), "author_id", "left_semi")
    pp = (lk.join(papers, "paper_id").groupBy("author_id")
          .agg(F.array_sort(F.collect_list(F.struct("paper_id", "archive_id", "paper_title",
                                                    "author_position"))).alias("papers")))
    return (a.join(pp, "author_id", "left")
            .withColumn("papers", F.coalesce("papers", F.array().cast(pp.schema["papers"].dataType))))


def cascade_delete(links: DataFrame, deleted: DataFrame, key: str = "paper_id") -> DataFrame:
    """Link rows whose parent survives (ON DELETE CASCADE)."""
    return links.join(deleted.select(key).distinct(), key, "left_anti")


def cascade_update(links: DataFrame, remap: DataFrame, key: str = "paper_id") -> DataFrame:
    """ON UPDATE CASCADE - ``remap`` has (old_<key>, new_<key>)."""
    m = remap.select(F.col(f"old_{key}").alias(key), F.col(f"new_{key}").alias("_new"))
    return (links.join(m, key, "left")
            .withColumn(key, F.coalesce("_new", F.col(key))).drop("_new").select(*links.columns))


def resolve_keyword_ids(pairs: DataFrame, keywords: DataFrame) -> DataFrame:
    """(paper_id, keyword text) -> (keyword_id, paper_id) by equi-join
    (replaces one lookup per keyword)."""
    return pairs.join(keywords, "keyword").select("keyword_id", "paper_id")


# ------------------------------------------------------------ aggregates ---
def newest_id(df: DataFrame, col: str) -> DataFrame:
    """A4: max id; an empty input raises when the value is read
    (``raise_error`` runs inside the aggregate's projection)."""
    m = df.agg(F.max(F.col(col).cast("long")).alias("newest"))
    return m.select(F.when(F.col("newest").isNull(), F.raise_error(F.lit("no ids found")))
                    .otherwise(F.col("newest")).alias("newest"))


def distinct_keywords(keywords: Column) -> Column:
    """A5: deduplicated non-blank keywords (first occurrence order)."""
    return F.array_distinct(F.filter(keywords, lambda x: F.length(F.trim(x)) > 0))


def run_stats(actions: DataFrame, pages: int | Column | None = None,
              failed: Column | None = None) -> DataFrame:
    """Pages, seen, full scrapes, version updates, skipped, failed.
    ``pages``: the number of fetched pages; by default only pages with rows count."""
    aggs = [F.count("*").alias("seen"),
            F.count_if(F.col("action") == "full-scrape").alias("full_scrapes"),
            F.count_if(F.col("action") == "update-version").alias("version_updates"),
            F.count_if(F.col("action") == "skip").alias("skipped")]
    if pages is not None:
        aggs.insert(0, F.any_value(F.lit(pages) if isinstance(pages, int) else pages).cast("long").alias("pages"))
    elif "page" in actions.columns:
        aggs.insert(0, F.countDistinct("page").alias("pages"))
    if "failed" in actions.columns:
        aggs.append(F.count_if(F.col("failed")).alias("failed"))
    return actions.agg(*aggs)


def legacy_run_stats(outcomes: DataFrame) -> DataFrame:
    """Attempted / succeeded / failed / skipped and success rate (% to one
    decimal, only when something was attempted).  ``outcome`` in
    {'ok', 'failed', 'skipped'}."""
    att = F.count_if(F.col("outcome") != "skipped")
    ok = F.count_if(F.col("outcome") == "ok")
    return outcomes.agg(att.alias("attempted"), ok.alias("succeeded"),
                        F.count_if(F.col("outcome") == "failed").alias("failed"),
                        F.count_if(F.col("outcome") == "skipped").alias("skipped")) \
        .withColumn("success_rate", F.when(F.col("attempted") > 0, F.round(
            F.lit(100.0) * F.col("succeeded") / F.col("attempted"), 1)))


# ------------------------------------------------------- windows (W1-W3) ---
def author_positions(raw_links: DataFrame, order_cols=("first_line",), lines: DataFrame | None = None) -> DataFrame:
    """1-based author position within a paper after deduplicating the
    link key (keeps the first line of each (paper, author)).  Skew-safe:
    see :func:`group_positions`; ``lines``: the rows with repeats, if at
    hand, which are counted more cheaply."""
    return group_positions(raw_links, "paper_id", [*order_cols, "author_id"], "author_position", counted=lines)


def listing_pages(listing: DataFrame, order_by: list, first: int = 30,
                  size: int = 100) -> DataFrame:
    """Listing position and page number: first page ``first`` rows, then ``size``."""
    x = dense_index(listing, order_by, "listing_pos")
    p = F.col("listing_pos")
    return x.withColumn("page", F.when(p < first, F.lit(0))
                        .otherwise(F.floor((p - first) / size) + 1).cast("long"))


def incremental_cutoff(actions: DataFrame, full: bool = False, pages: DataFrame | None = None) -> DataFrame:
    """Keep pages before the first page with no actionable row.

    The cutoff page itself counts as fetched and seen but its rows are not
    processed: returned rows carry ``process`` = false for it.  Pages after
    the cutoff are dropped.  ``pages`` lists the fetched pages (column
    ``page``); one without any row has no actionable row either and stops the
    run.  The cutoff is one number planned as a scalar subquery.
    """
    if full:
        return actions.withColumn("process", F.lit(True))
    cutoff = _cutoff(actions, pages).scalar()
    return (actions.filter(cutoff.isNull() | (F.col("page") <= cutoff))
            .withColumn("process", cutoff.isNull() | (F.col("page") < cutoff)))


def _cutoff(actions: DataFrame, pages: DataFrame | None) -> DataFrame:
    per_page = actions.groupBy("page").agg(F.count_if(F.col("action") != "skip").alias("actionable"))
    if pages is not None:
        per_page = pages.select("page").distinct().join(per_page, "page", "left")
    idle = F.coalesce("actionable", F.lit(0)) == 0
    return per_page.select(F.min(F.when(idle, F.col("page"))))


def fetched_pages(actions: DataFrame, pages: DataFrame, full: bool = False) -> DataFrame:
    """The pages a run fetches: up to and including the cutoff page."""
    pages = pages.select("page").distinct()
    if full:
        return pages
    cutoff = _cutoff(actions, pages).scalar()
    return pages.filter(cutoff.isNull() | (F.col("page") <= cutoff))


def batch_assign(df: DataFrame, order_by: list, size: int, name: str = "batch") -> DataFrame:
    """Fixed-size batches in order: batch = floor(index / size)."""
    x = dense_index(df, order_by, "_i")
    return x.withColumn(name, F.floor(F.col("_i") / size).cast("long")).drop("_i")


# ---------------------------------------------------------- top-k (T4, T6) ---
def list_papers(papers: DataFrame, limit=None) -> DataFrame:
    """T4 list: by id, default 20, at most 100."""
    n = 20 if limit in (None, "") else min(int(limit), 100)
    return papers.orderBy("paper_id").limit(max(n, 0))


def recent_papers(papers: DataFrame, limit=None, date_col: str = "row_created_at") -> DataFrame:
    """T4 recent: default 10, at most 50; newest first (the archive returns
    them unordered - a deliberate, documented fix)."""
    n = 10 if limit in (None, "") else min(int(limit), 50)
    return papers.orderBy(F.desc(date_col), F.desc("paper_id")).limit(max(n, 0))


def sort_by_numeric_id(df: DataFrame, col: str = "id") -> DataFrame:
    """Order by the integer value of a text id."""
    return df.orderBy(F.col(col).cast("long"), col)


# ------------------------------------------------------------ set ops (U) ---
def merge_keep_existing(existing: DataFrame, new: DataFrame, key: str = "id",
                        order_col: str = "seq") -> DataFrame:
    """Union by key; an existing row wins over a new one; among existing
    duplicates the last (largest ``order_col``) wins, among new ones the
    first; result sorted by the integer key (T6)."""
    e = first_per_key(existing, [key], [order_col], last=True)
    n = first_per_key(new.join(existing.select(key).distinct(), key, "left_anti"), [key], [order_col])
    return sort_by_numeric_id(e.unionByName(n), key)


def distinct_ids(df: DataFrame, col: str) -> DataFrame:
    """U2."""
    return df.select(col).distinct()


def ids_except(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Ids of ``a`` not in ``b`` (set difference, distinct)."""
    return a.select(col).distinct().join(b.select(col), col, "left_anti")


def concat_pages(*pages: DataFrame) -> DataFrame:
    """U4: append all page results."""
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
