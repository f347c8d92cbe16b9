"""Registered queries of dated paper versions (M12) and of the vector cells (V5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as VC
from ..operators import versions as W
from ..sources import tables as tb
from .q_search import _stored
from .q_vector import BATCH_K, DIGITS, QUERY_LABEL
from .registry import REGISTRY, register

FIRST, SECOND, THIRD = "2024-01-01 00:00:00", "2024-02-01 00:00:00", "2024-03-01 00:00:00"
FIELDS = ["status", "downloads", "priority"]
#: Three observations of the papers: urgent ones are finished by the second; by the third, failed ones are gone.


def _observations(spark, d):
    o = tb.table(spark, d, "orders")
    first = o.select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderstatus").alias("status"),
                     F.floor("o_totalprice").cast("long").alias("downloads"), F.col("o_orderpriority").alias("priority"))
    urgent, failed = F.col("priority").startswith("1"), F.col("status") == "P"
    second = first.withColumn("downloads", F.when(urgent, F.col("downloads") + 10).otherwise(F.col("downloads"))) \
                  .withColumn("status", F.when(urgent, F.lit("F")).otherwise(F.col("status")))
    third = second.filter(~failed).withColumn("priority", F.when(urgent, F.lit(None).cast("string")).otherwise(F.col("priority")))
    return first, second, third


_OBSERVED_SQL = """WITH first AS (
  SELECT o_orderkey AS paper_id, o_orderstatus AS status, CAST(floor(o_totalprice) AS BIGINT) AS downloads, o_orderpriority AS priority FROM orders),
second AS (
  SELECT paper_id, CASE WHEN priority LIKE '1%' THEN 'F' ELSE status END AS status,
         CASE WHEN priority LIKE '1%' THEN downloads + 10 ELSE downloads END AS downloads, priority FROM first),
third AS (
  SELECT paper_id, status, downloads, CASE WHEN priority LIKE '1%' THEN NULL ELSE priority END AS priority FROM second WHERE status <> 'P')"""
_HISTORY_SQL = _OBSERVED_SQL + f""",
seen AS (
  SELECT *, TIMESTAMP '{FIRST}' AS t FROM first UNION ALL SELECT *, TIMESTAMP '{SECOND}' FROM second
  UNION ALL SELECT *, TIMESTAMP '{THIRD}' FROM third),
marked AS (
  SELECT *, lag(row(status, downloads, priority)) OVER (PARTITION BY paper_id ORDER BY t) AS was FROM seen),
history AS (
  SELECT m.paper_id, status, downloads, priority, t AS valid_from,
         coalesce(lead(t) OVER (PARTITION BY m.paper_id ORDER BY t),
                  CASE WHEN m.paper_id NOT IN (SELECT paper_id FROM third) THEN TIMESTAMP '{THIRD}' END) AS valid_to
  FROM marked m WHERE was IS NULL OR was IS DISTINCT FROM row(status, downloads, priority))"""


def _history(spark, d):
    first, second, third = _observations(spark, d)
    h = W.first_versions(first, "paper_id", FIELDS, FIRST)
    h = W.refresh_versions(h, second, "paper_id", FIELDS, SECOND)
    return W.refresh_versions(h, third, "paper_id", FIELDS, THIRD)


@register("paper_versions", _HISTORY_SQL + " SELECT * FROM history")
def q_paper_versions(spark, d):
    """All dated versions after three observations."""
    return _history(spark, d)


@register("papers_as_of", _OBSERVED_SQL + " SELECT * FROM second")
def q_papers_as_of(spark, d):
    """The state between the second and the third observation, from the history."""
    return W.as_of(_history(spark, d), "2024-02-15 00:00:00")


@register("paper_field_changes", _OBSERVED_SQL + """
SELECT paper_id, field, old_value, new_value FROM (
  SELECT a.paper_id, 'status' AS field, a.status AS old_value, b.status AS new_value FROM first a JOIN second b USING (paper_id)
  UNION ALL SELECT a.paper_id, 'downloads', a.downloads::VARCHAR, b.downloads::VARCHAR FROM first a JOIN second b USING (paper_id)
  UNION ALL SELECT a.paper_id, 'priority', a.priority, b.priority FROM first a JOIN second b USING (paper_id))
WHERE old_value IS DISTINCT FROM new_value""")
def q_paper_field_changes(spark, d):
    """Which fields the second observation changed."""
    first, second, _ = _observations(spark, d)
    return W.field_changes(first, second, "paper_id", FIELDS)


def cell_index(spark, d) -> VC.CellIndex:
    def make(path):
        e = tb.table(spark, d, "embeddings")
        return VC.build_cells(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), path)
    return _stored(spark, d, "vector-cells", make)


def _queries(spark, d):
    e = tb.table(spark, d, "embeddings").filter(F.col("label") == QUERY_LABEL)
    return e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))


@register("vector_cells_exact", REGISTRY["vector_topk_batch"].sql)
def q_vector_cells_exact(spark, d):
    """V5 over stored cells: cells that can't reach the k-th score are not read."""
    return VC.search_cells(cell_index(spark, d), _queries(spark, d), BATCH_K, exact=True, round_digits=DIGITS)


@register("vector_cells", note="rows-only: approximate; recall against the exact top-k is measured in the tests")
def q_vector_cells(spark, d):
    """V5 over stored cells: the nearest cells only."""
    return VC.search_cells(cell_index(spark, d), _queries(spark, d), BATCH_K, round_digits=DIGITS)
