"""W2 over micro-batches: where a crawl's listing pages arrive in many files.

Incremental runs stop at the first page without an actionable row.  When the
pages of a crawl are dealt over several files, in any order, that page may
arrive after later ones.  Here the crawl is the key of a stateful operator
which decides a page once every earlier page of its crawl has arrived: pages
before the cutoff are processed, the cutoff page is fetched but not processed,
pages after it are never decided.  The decisions equal those of the batch
operator (:func:`relations.incremental_cutoff`) over all pages at once.

Size: one (crawl, page, flag) row per page is shuffled, not the listing rows.
The state of a crawl is its next undecided page, the first idle page seen, and
the actionable pages that wait for an earlier one, as ranges of consecutive
pages; what lies behind an idle page is let go.

Odd input: a page number or crawl that is null, and a page below the first,
take no part.  A page delivered again after its decision changes nothing; one
delivered in two parts before it counts as actionable if either part is, as
long as both lie in one micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAGE_SCHEMA = "crawl string, page long, actions array<struct<paper_id:string,action:string>>"
DECISION_SCHEMA = "crawl string, page long, process boolean"
STATE_SCHEMA = "next long, first_idle long, starts array<long>, ends array<long>"
NO_IDLE = np.iinfo(np.int64).max
EMIT_ROWS = 65_536
FILES_PER_BATCH = 256       # a micro-batch opens every state partition, so it should hold many files


def merge_ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of whole numbers, overlapping and adjacent ones joined, in order."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1] + 1
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1) if len(starts) else np.zeros(0, np.int64)
    return starts[new], reach[last]


class CrawlCut:
    """What is known of one crawl."""

    def __init__(self, next_page: int, first_idle: int = NO_IDLE, starts=(), ends=()):
        self.next, self.first_idle = next_page, first_idle
        self.starts, self.ends = np.array(starts, np.int64), np.array(ends, np.int64)

    def add(self, pages: np.ndarray, actionable: np.ndarray) -> list[tuple[int, int, bool]]:
        """Take pages in; returns what is now decided as (first page, last page, process)."""
        idle = pages[~actionable & (pages >= self.next)]
        if len(idle):
            self.first_idle = min(self.first_idle, int(idle.min()))
        fresh = pages[actionable & (pages >= self.next)]
        starts, ends = merge_ranges(np.append(self.starts, fresh), np.append(self.ends, fresh))
        keep = starts < self.first_idle
        self.starts, self.ends = starts[keep], np.minimum(ends[keep], self.first_idle - 1)
        out = []
        if len(self.starts) and self.starts[0] == self.next:
            out.append((self.next, int(self.ends[0]), True))
            self.next = int(self.ends[0]) + 1
            self.starts, self.ends = self.starts[1:], self.ends[1:]
        if self.next == self.first_idle:
            out.append((self.next, self.next, False))
            self.next = NO_IDLE                 # the crawl is decided: no page lies at or behind this
        return out


def _decide(first_page: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            n, idle, starts, ends = state.get
            cut = CrawlCut(n, idle, starts, ends)
        else:
            cut = CrawlCut(first_page)
        # a page's parts may lie in different frames: an idle part counts only when the batch is read
        parts = [(f["page"].to_numpy(np.int64), f["actionable"].to_numpy(bool)) for f in frames]
        pages, flags = (np.concatenate(x) for x in zip(*parts))
        numbers, place = np.unique(pages, return_inverse=True)
        actionable = np.zeros(len(numbers), bool)
        np.logical_or.at(actionable, place, flags)
        decided = cut.add(numbers, actionable)
        state.update((cut.next, cut.first_idle, cut.starts.tolist(), cut.ends.tolist()))
        for first, last, process in decided:
            for lo in range(first, last + 1, EMIT_ROWS):
                page = np.arange(lo, min(lo + EMIT_ROWS, last + 1))
                yield pd.DataFrame({"crawl": key[0], "page": page, "process": process})
    return run


def page_decisions(pages: DataFrame, first_page: int = 0) -> DataFrame:
    """Streaming frame of pages (crawl, page, actions) -> their decisions (crawl, page, process)."""
    actionable = F.coalesce(F.exists("actions", lambda a: a["action"] != "skip"), F.lit(False))
    flagged = (pages.filter(F.col("crawl").isNotNull() & (F.col("page") >= first_page))
               .select("crawl", "page", actionable.alias("actionable")))
    return flagged.groupBy("crawl").applyInPandasWithState(
        _decide(first_page), DECISION_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def stream_cutoff(spark: SparkSession, drops_dir: str, out_dir: str, checkpoint: str,
                  first_page: int = 0, files_per_batch: int = FILES_PER_BATCH) -> None:
    """Decide the pages of every crawl as their files arrive (``availableNow``); decisions are appended to
    ``out_dir`` by the exactly-once file sink.  ``drops_dir`` holds Parquet files of ``PAGE_SCHEMA``;
    ``files_per_batch`` bounds a micro-batch, of which a task holds a crawl's page numbers."""
    pages = (spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
             .option("recursiveFileLookup", "true").parquet(drops_dir))
    q = (page_decisions(pages, first_page).writeStream.outputMode("append").format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def decided_rows(spark: SparkSession, drops_dir: str, out_dir: str) -> DataFrame:
    """Listing rows of the fetched pages: crawl, page, paper_id, action, process."""
    pages = spark.read.schema(PAGE_SCHEMA).option("recursiveFileLookup", "true").parquet(drops_dir)
    made = spark.read.schema(DECISION_SCHEMA).parquet(out_dir)
    return pages.join(made, ["crawl", "page"]).select("crawl", "page", "process", F.inline("actions"))
