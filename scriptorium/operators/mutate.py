"""Set-wise mutations of the archive tables.

Every mutation is a pure function ``(current tables, changes) -> (new rows or
next table, rejects)``.  Stored tables are Parquet partitioned by the run that
added the rows; a run's rows count once its one log row is written
(``write_run``, ``commit_run``, ``read_runs``).  Nothing is read and
overwritten in place, and a replayed run overwrites only its own rows.

Row-at-a-time inserts with per-row lookups become joins:

* insert / insert-ignore = left-anti join against the current keys;
* upsert = left join on the conflict key + ``coalesce`` of the columns the
  conflict clause updates;
* surrogate ids = max(current id) + dense index of the new rows
  (:func:`relations.dense_index`, no single-partition window);
* audit timestamps come from an explicit ``now`` argument (a fixed clock
  makes runs reproducible and testable).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import REFERENCE_PREFIX, split_date
from .relations import dense_index, first_per_key, split_first_per_key


def _ts(now) -> Column:
    if isinstance(now, Column):
        return now
    if now is None:
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)
    return F.lit(now).cast("timestamp_ntz")


def assign_ids(new: DataFrame, existing: DataFrame, id_col: str, order_by: list) -> DataFrame:
    """M5: auto-increment ids for ``new`` rows: max(existing id) + 1 + index
    in ``order_by`` order.  The max is a scalar subquery (one value)."""
    base = F.coalesce(existing.select(F.max(id_col).cast("long")).scalar(), F.lit(0).cast("long"))
    x = dense_index(new, order_by, "_i")
    return x.withColumn(id_col, (F.col("_i") + base + F.lit(1)).cast("long")).drop("_i")


def insert_papers(existing: DataFrame, incoming: DataFrame, key: str = "archive_id",
                  order_col: str = "seq", now=None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """M1: plain insert of parsed papers.

    ``known``: the held keys, here and below, where they are stored apart
    (:mod:`held_keys`); by default they are taken from ``existing``.

    A key already present, or a repeated key within the batch (after its
    first occurrence), is a constraint error: that row goes to ``rejects``
    (counted as failed) instead of aborting the batch.  Inserted rows get
    year/month from the "Month Year" date, the ``REFERENCE_PREFIX + id`` reference, ids
    (M5) and audit stamps (M6).
    """
    known = existing.select(key).distinct() if known is None else known
    stored = incoming.join(known, key, "left_semi").withColumn(
        "error", F.lit("duplicate key: already stored"))
    fresh = incoming.join(known, key, "left_anti")
    ok, again = split_first_per_key(fresh, [key], [order_col])
    bad = stored.unionByName(again.withColumn("error", F.lit("duplicate key: repeated in batch")))
    year, month = split_date(F.col("date"))
    ok = (ok.withColumn("paper_year", year).withColumn("paper_month", month)
          .withColumn("paper_reference", F.concat(F.lit(REFERENCE_PREFIX), F.col(key)))
          .withColumn("row_created_at", _ts(now)).withColumn("row_updated_at", _ts(now)))
    if "paper_id" in existing.columns:
        ok = assign_ids(ok.drop("paper_id") if "paper_id" in ok.columns else ok,
                        existing, "paper_id", [order_col, key])
    return ok, bad


def insert_ignore(existing: DataFrame, incoming: DataFrame, key: str,
                  id_col: str | None = None, now=None, known: DataFrame | None = None) -> DataFrame:
    """M2: ON CONFLICT DO NOTHING - the rows actually inserted."""
    new = incoming.select(key).filter(F.col(key).isNotNull() & (F.col(key) != "")).distinct() \
        .join(existing.select(key) if known is None else known, key, "left_anti")
    if id_col:
        new = assign_ids(new, existing, id_col, [key])
    return new.withColumn("row_created_at", _ts(now))


def insert_links(existing: DataFrame, incoming: DataFrame, key: list[str],
                 order: list[str] | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """M3: link rows; a duplicate composite key (already stored or repeated
    in the batch) is rejected and reported, the first occurrence is kept."""
    order = order or [c for c in incoming.columns if c not in key]
    known = existing.select(*key).distinct() if known is None else known
    stored = incoming.join(known, key, "left_semi")
    ok, again = split_first_per_key(incoming.join(known, key, "left_anti"), key, order)
    return ok, stored.unionByName(again).withColumn("error", F.lit("duplicate link"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], update_cols: list[str]) -> DataFrame:
    """Generic ON CONFLICT (key) DO UPDATE SET update_cols = excluded.*.

    Full outer join on the key: rows only in ``old`` stay, rows only in
    ``new`` are inserted, matching rows take ``update_cols`` from ``new``
    and keep every other column from ``old``.
    """
    o = old.alias("o")
    n = new.alias("n")
    cond = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key]
    j = o.join(n, cond, "full_outer")
    both = F.col(f"o.{key[0]}").isNotNull() & F.col(f"n.{key[0]}").isNotNull()
    cols = []
    for c in old.columns:
        if c in key:
            cols.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        elif c in update_cols and c in new.columns:
            cols.append(F.when(both, F.col(f"n.{c}"))
                        .otherwise(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))).alias(c))
        elif c in new.columns:
            cols.append(F.when(F.col(f"o.{key[0]}").isNotNull(), F.col(f"o.{c}"))
                        .otherwise(F.col(f"n.{c}")).alias(c))
        else:
            cols.append(F.col(f"o.{c}").alias(c))
    return j.select(*cols)


class WriteModeError(ValueError):
    pass


def insert_into(existing: DataFrame, incoming: DataFrame, key: list[str],
                on_conflict: str | None = None, update_cols: list[str] | None = None,
                returning: bool = False, order_cols: list[str] | None = None, id_col: str | None = None):
    """The four write modes of the archive's insert helper, set-wise.

    A key repeated inside ``incoming`` counts once: its first row by
    ``order_cols`` (default: the remaining columns, in order) takes part, the
    others conflict with it.

    * ``on_conflict=None``: plain insert; a row whose key is held or repeated
      is an error row (returned in ``rejects``), not an abort of the batch.
    * ``"nothing"``: ON CONFLICT DO NOTHING - conflicting rows are skipped.
    * ``"update"``: ON CONFLICT DO UPDATE SET ``update_cols`` (upsert; default:
      all but the key and the held table's surrogate id ``id_col``).  Rows
      repeated in the batch go to ``rejects``.
    * ``returning``: also return the affected rows.  Combining it with
      ``"nothing"`` is rejected, as in the archive (skipped rows return
      nothing to report).
    Returns (next table, affected rows or None, rejects).
    """
    if returning and on_conflict == "nothing":
        raise WriteModeError("returning cannot be combined with on-conflict-do-nothing")
    if on_conflict not in (None, "nothing", "update"):
        raise WriteModeError(f"unknown conflict mode {on_conflict!r}")
    order = order_cols or [c for c in incoming.columns if c not in key] or key
    once, again = split_first_per_key(incoming, key, order)
    again = again.withColumn("error", F.lit("UNIQUE constraint failed: repeated in batch"))
    known = existing.select(*key).distinct()
    fresh = once.join(known, key, "left_anti")
    clash = once.join(known, key, "left_semi")
    empty = again.limit(0)
    if on_conflict == "update":
        cols = update_cols or [c for c in incoming.columns if c not in key and c != id_col]
        nxt, affected, rejects = upsert(existing, once, key, cols), once, again
    elif on_conflict == "nothing":
        nxt = existing.unionByName(fresh, allowMissingColumns=True)
        affected, rejects = fresh, empty
    else:
        nxt = existing.unionByName(fresh, allowMissingColumns=True)
        affected = fresh
        rejects = clash.withColumn("error", F.lit("UNIQUE constraint failed")).unionByName(again)
    return nxt, (affected if returning else None), rejects


def upsert_authors(existing: DataFrame, listed: DataFrame, profiles: DataFrame | None = None,
                   now=None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """M4: resolve listing authors to ids.

    Existing username -> its id, nothing refreshed and no profile fetched.
    New username -> inserted with its profile (missing profile -> blanks)
    and a new id.  Blank usernames would all collapse onto one UNIQUE key;
    they go to rejects instead.  Returns (next authors version, rejects).
    """
    lst = listed.filter(F.col("username") != "")
    rejects = listed.filter(F.col("username") == "").withColumn("error", F.lit("blank username"))
    order = [c for c in ("seq", "position") if c in listed.columns] or ["first_name", "last_name"]
    lst = first_per_key(lst, ["username"], order)
    new = lst.join(existing.select("username") if known is None else known, "username", "left_anti")
    if profiles is not None:
        new = new.join(profiles.select("username", "email", "affiliation", "website"),
                       "username", "left")
    for c in ("email", "affiliation", "website"):
        new = new.withColumn(c, F.coalesce(F.col(c), F.lit(""))) if c in new.columns \
            else new.withColumn(c, F.lit(""))
    new = assign_ids(new.select("username", "first_name", "last_name", "email", "affiliation",
                                "website"), existing, "author_id", ["username"])
    new = new.withColumn("row_created_at", _ts(now)).withColumn("row_updated_at", _ts(now))
    cols = existing.columns
    for c in cols:
        if c not in new.columns:
            new = new.withColumn(c, F.lit(None).cast(existing.schema[c].dataType))
    return existing.unionByName(new.select(*cols)), rejects


def touch_changed(old: DataFrame, new: DataFrame, key: str, watch: list[str], now=None,
                  strict_sql: bool = False, stamp_col: str = "row_updated_at") -> DataFrame:
    """M6/M7: next version of a table with ``stamp_col`` maintained.

    A row without an old counterpart (insert) is stamped ``now``; an
    existing row is stamped ``now`` when a watched column changed, else it
    keeps its old stamp.  Default compares null-safely (NULL -> value is a
    change); ``strict_sql`` follows SQL ``<>`` (a NULL on either side is no
    change), which is what an update trigger written with ``<>`` does.
    """
    o = old.select(F.col(key), F.lit(True).alias("_o_exists"),
                   F.col(stamp_col).alias("_o_stamp"),
                   *[F.col(c).alias(f"_o_{c}") for c in watch])
    j = new.drop(stamp_col).join(o, key, "left")
    if strict_sql:
        ch = [F.coalesce(F.col(c) != F.col(f"_o_{c}"), F.lit(False)) for c in watch]
    else:
        ch = [~F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in watch]
    changed = ch[0]
    for c in ch[1:]:
        changed = changed | c
    stamp = (F.when(F.col("_o_exists").isNull(), _ts(now))
             .when(changed, _ts(now)).otherwise(F.col("_o_stamp")))
    return (j.withColumn(stamp_col, stamp)
            .drop("_o_exists", "_o_stamp", *[f"_o_{c}" for c in watch]))


def mark_embedded(papers: DataFrame, ids, now=None, key: str = "paper_id") -> DataFrame:
    """M9: set embedded_at on the given ids; an empty id list changes nothing."""
    if not isinstance(ids, DataFrame):
        ids = list(ids)
        if not ids:
            return papers
        ids = papers.sparkSession.createDataFrame([(i,) for i in ids], [key])
    hit = ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn("_hit", F.lit(True))
    j = papers.join(hit, key, "left")
    cur = F.col("embedded_at") if "embedded_at" in papers.columns else F.lit(None).cast("timestamp_ntz")
    return j.withColumn("embedded_at", F.when(F.col("_hit"), _ts(now)).otherwise(cur)).drop("_hit")


def fold_sync_runs(log: DataFrame) -> DataFrame:
    """An append-only log of ``start`` and ``finish`` events -> one row
    per run.  Defaults of a run that has not finished: counters 0, success
    false, finished_at null.  ``max_by`` per run id: partial aggregation."""
    start = F.col("kind") == "start"
    fin = F.col("kind") == "finish"
    g = log.groupBy("sync_run_id").agg(
        F.max_by(F.when(start, F.col("runner")), F.when(start, F.col("at"))).alias("runner"),
        F.min(F.when(start, F.col("at"))).alias("started_at"),
        F.max(F.when(fin, F.col("at"))).alias("finished_at"),
        F.max_by(F.struct("papers_seen", "papers_new", "papers_updated", "papers_failed",
                          "success", "error_message"),
                 F.when(fin, F.col("at"))).alias("f"))
    return g.select("sync_run_id", "runner", "started_at", "finished_at",
                    *[F.coalesce(F.col(f"f.{c}"), F.lit(0)).cast("long").alias(c)
                      for c in ("papers_seen", "papers_new", "papers_updated", "papers_failed")],
                    F.coalesce(F.col("f.success"), F.lit(False)).alias("success"),
                    F.col("f.error_message").alias("error_message"))


# ----------------------------------------------------------------- runs ---
RUN_LOG = "sync_runs"
BASE_RUN = "base"


def write_run(df: DataFrame, root: str, name: str, run: str) -> None:
    """Write the rows a run adds to table ``name``; a replay of the run
    replaces exactly these.  ``root`` must be a shared folder."""
    df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}/run={run}")


def commit_run(spark, root: str, run: str, facts: DataFrame | None = None) -> None:
    """Make a run's rows count: one log row (run, seq, facts), written last
    and in one file.  seq numbers the runs in the order of their commits."""
    done = committed_runs(spark, root)
    seq = done[run] if run in done else 1 + max(done.values(), default=-1)
    row = facts if facts is not None else spark.range(1).select()
    row = row.withColumn("run_id", F.lit(run)).withColumn("seq", F.lit(seq).cast("long"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{root.rstrip('/')}/{RUN_LOG}/run={run}")


def run_log_table(spark, root: str) -> DataFrame | None:
    """The log rows of committed runs, or None before the first."""
    path = f"{root.rstrip('/')}/{RUN_LOG}"
    if not _exists(spark, path):
        return None
    return spark.read.option("mergeSchema", "true").option("basePath", path).parquet(path).drop("run")


def committed_runs(spark, root: str) -> dict[str, int]:
    """{run: seq} - one small row per run."""
    log = run_log_table(spark, root)
    return {} if log is None else {r["run_id"]: r["seq"] for r in log.select("run_id", "seq").collect()}


def read_runs(spark, root: str, name: str, with_seq: bool = False) -> DataFrame | None:
    """The table: rows of its committed runs (``with_seq``: and the seq of
    the run that added them); None when no run is committed.  Only the
    committed runs' folders are listed, so rows of an unfinished run are
    never seen."""
    base = f"{root.rstrip('/')}/{name}"
    done = committed_runs(spark, root)
    if not done:
        return None
    paths = [f"{base}/run={r}" for r in done]
    schema = spark.read.parquet(paths[0]).schema
    rows = spark.read.schema(schema.add("run", "string")).option("basePath", base).parquet(*paths)
    if with_seq:
        seq = spark.createDataFrame(list(done.items()), "run string, seq long")
        rows = rows.join(F.broadcast(seq), "run")
    return rows.drop("run")


def _exists(spark, path: str) -> bool:
    """Whether a Parquet folder with data is there, by Spark's own listing."""
    from pyspark.errors import AnalysisException
    try:
        return bool(spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                    .option("pathGlobFilter", "*.parquet").load(path).limit(1).select("path").count())
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def tables_root(spark) -> str:
    """Default shared root for stored tables: under the checkpoint folder."""
    from ..session import checkpoint_dir
    return checkpoint_dir(spark).rstrip("/") + "/tables"
