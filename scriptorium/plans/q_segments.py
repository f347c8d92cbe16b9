"""Registered queries of the segmented index, its dictionary and top-k, and of the change feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import search as S
from ..operators import segments as G
from ..session import write_once
from .q_search import PAGE_LIMIT, PAGE_OFFSET, RANK_DIGITS, _both_states, _new_state_sql, _old_new_state, _stored, _w, built_index, stored_docs
from .registry import register
from .search_sql import bm25_cte, match_ctes, search_sql

BATCHES = 3         # the whole change set comes in so many batches, by paper
BUCKETS = 16
PREFIX = "est"
Q_PHRASE = S.any_of(S.phrase("in the"), S.phrase("de la"), S.phrase("of the and"))
Q_PREFIX = S.all_of(S.prefix("est"), S.any_of("the", "de"))
Q_TOPK = S.any_of("the", "estion", "de", S.all_of("und", "der"))
Q_TOPK_NOT = S.but_not(S.any_of("the", S.in_field("widget", "keywords")), "der")


def _segment_root(spark, d, tag: str, build) -> str:
    """The root of a segmented index of the new archive state: built from the old state, then changed in batches."""
    def make(path):
        build(path)
        return path
    return _stored(spark, d, tag, make)


def _in_batches(spark, d, compact: bool):
    """The old state as first segment; every batch of changed papers adds one, and segments are joined as they gather."""
    def build(path):
        old, changes, (p, a, k, al, kl) = _old_new_state(spark, d)
        G.start_index(old, path, n_buckets=BUCKETS)
        aff = write_once(S.affected_papers(changes, kl, al), "affected-ids").withColumn("batch", F.pmod(F.xxhash64("paper_id"), F.lit(BATCHES)))
        fresh = write_once(S.build_search_docs(p.join(aff, "paper_id", "left_semi"), a, k, al, kl), "affected-docs")
        for b in range(BATCHES):
            G.add_segment(spark, path, f"batch-{b:04d}", aff.filter(F.col("batch") == b).select("paper_id"), fresh)
            if compact:
                G.compact_index(spark, path)
    return build


def segment_index(spark, d) -> G.SegmentIndex:
    """The new archive state in several live segments."""
    return G.open_index(spark, _segment_root(spark, d, "segments", _in_batches(spark, d, True)))


def _new_search_sql(q, select: str, with_rank: bool = True) -> str:
    return _new_state_sql("").rstrip() + ",\n" + match_ctes(q) + (",\n" + bm25_cte(q) if with_rank else "") + "\n" + select


_POSTINGS = "SELECT term, paper_id, field, CAST(count(*) AS BIGINT) AS tf, array_to_string(list_sort(list(pos)), ',') AS positions " \
            "FROM tok GROUP BY term, paper_id, field"


@register("segment_postings", _new_state_sql(_POSTINGS))
def q_segment_postings(spark, d):
    """Postings of an index kept by segments; the oracle is a rebuild of the new state."""
    return _flat(segment_index(spark, d))


def _flat(index):
    return index.postings.select("term", "paper_id", "field", "tf",
                                 F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


@register("compact_index", _new_state_sql(_POSTINGS))
def q_compact_index(spark, d):
    """All segments joined into one."""
    def build(path):
        _in_batches(spark, d, False)(path)
        G.compact_index(spark, path, full=True)
    return _flat(G.open_index(spark, _segment_root(spark, d, "compacted", build)))


@register("segment_docs", _new_state_sql("SELECT * FROM sd"))
def q_segment_docs(spark, d):
    return segment_index(spark, d).docs


@register("segment_statistics", _new_state_sql(
    "SELECT term, CAST(count(DISTINCT paper_id) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS cf, "
    "(SELECT CAST(count(*) AS BIGINT) FROM doclen) AS n_docs, (SELECT round(avg(n_tokens), 6) FROM doclen) AS avgdl FROM tok GROUP BY term"))
def q_segment_statistics(spark, d):
    """From signed changes per segment, without reading a posting."""
    return G.statistics(segment_index(spark, d)).withColumn("avgdl", F.round("avgdl", 6))


@register("segment_search", _new_search_sql(
    Q_PREFIX, f"SELECT paper_id, round(rank, {RANK_DIGITS}) AS rank FROM ranked "
    f"ORDER BY round(rank, {RANK_DIGITS}), paper_id LIMIT {PAGE_LIMIT}"))
def q_segment_search(spark, d):
    """X4/X6/T2 over live segments: prefix resolved in the dictionary, buckets pruned."""
    return S.search_page(segment_index(spark, d), Q_PREFIX, PAGE_LIMIT, 0, RANK_DIGITS)


@register("prefix_terms", _w(
    f"SELECT term, CAST(count(DISTINCT paper_id) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS cf FROM tok "
    f"WHERE starts_with(term, '{PREFIX}') GROUP BY term"))
def q_prefix_terms(spark, d):
    """The dictionary rows of a prefix."""
    return S.prefix_terms(built_index(spark, d), PREFIX).select("term", "df", "cf")


@register("match_phrase", search_sql(Q_PHRASE, "SELECT paper_id, h0 AS first, h1 AS second, h2 AS third FROM m", with_rank=False))
def q_match_phrase(spark, d):
    """Phrases from their rarest word, position lists intersected."""
    piv, _ = S.match_hits(built_index(spark, d), Q_PHRASE)
    return piv.filter("matched").select("paper_id", F.col("h0").alias("first"), F.col("h1").alias("second"), F.col("h2").alias("third"))


def _page(q, limit=PAGE_LIMIT, offset=PAGE_OFFSET) -> str:
    return _new_search_sql(q, f"SELECT paper_id, round(rank, {RANK_DIGITS}) AS rank FROM ranked "
                              f"ORDER BY round(rank, {RANK_DIGITS}), paper_id LIMIT {limit} OFFSET {offset}")


@register("top_k", _page(Q_TOPK))
def q_top_k(spark, d):
    """A page from bounded blocks."""
    return G.top_k(segment_index(spark, d), Q_TOPK, PAGE_LIMIT, PAGE_OFFSET, RANK_DIGITS).page


@register("top_k_excluding", _page(Q_TOPK_NOT, 10, 0))
def q_top_k_not(spark, d):
    return G.top_k(segment_index(spark, d), Q_TOPK_NOT, 10, 0, RANK_DIGITS).page


# ----------------------------------------------------------- change feed ---
def _versions(spark, d) -> tuple[dict, dict]:
    """Two versions of the archive relations: links added, papers deleted, a keyword and an author renamed."""
    names = ("papers", "authors", "keywords", "author_links", "keyword_links")
    old, new = _both_states(spark, d)
    return dict(zip(names, old)), dict(zip(names, new))


def _feed(spark, d, old: dict, new: dict) -> C.ChangeFeed:
    return _stored(spark, d, "change-feed", lambda path: C.write_feed(C.change_feed(old, new), path))


def _feed_sql() -> str:
    from ..sources.tables import AUTHOR_LINKS_SQL, AUTHORS_SQL, DOCS_SQL, KEYWORD_LINKS_SQL, KEYWORDS_SQL
    from .q_search import DELETED_SQL, NEW_FIRST_NAME, NEW_KEYWORD_TEXT, OLD_LINKS_SQL, RENAMED_AUTHOR, RENAMED_KEYWORD
    pairs = {
        "papers": ("paper_id", "NULL", "docs", f"(SELECT * FROM docs WHERE paper_id NOT IN (SELECT doc_id FROM documents WHERE {DELETED_SQL}))"),
        "authors": ("author_id", "NULL", "authors",
                    f"(SELECT * REPLACE (CASE WHEN author_id = {RENAMED_AUTHOR} THEN '{NEW_FIRST_NAME}' ELSE first_name END AS first_name) FROM authors)"),
        "keywords": ("keyword_id", "NULL", "keywords",
                     f"(SELECT * REPLACE (CASE WHEN keyword = '{RENAMED_KEYWORD}' THEN '{NEW_KEYWORD_TEXT}' ELSE keyword END AS keyword) FROM keywords)"),
        "author_links": ("author_id", "paper_id", "al_old", "author_links"),
        "keyword_links": ("keyword_id", "paper_id", "kl_old", "keyword_links")}
    parts = []
    for t, (i, paper, old, new) in pairs.items():
        parts.append(
            f"SELECT '{t}' AS relation, CASE WHEN count(*) = 2 THEN 'update' WHEN min(side) = 'new' THEN 'insert' ELSE 'delete' END AS change, "
            f"CAST({i} AS BIGINT) AS id, CAST({paper} AS BIGINT) AS paper_id FROM ("
            f"SELECT *, 'old' AS side FROM (SELECT * FROM {old} EXCEPT SELECT * FROM {new}) UNION ALL "
            f"SELECT *, 'new' AS side FROM (SELECT * FROM {new} EXCEPT SELECT * FROM {old})) GROUP BY {i}" + (f", {paper}" if paper != "NULL" else ""))
    return ("WITH " + ",\n".join([DOCS_SQL, AUTHORS_SQL, KEYWORDS_SQL, KEYWORD_LINKS_SQL, AUTHOR_LINKS_SQL, OLD_LINKS_SQL]) + "\n"
            + "\nUNION ALL ".join(parts))


@register("change_feed", _feed_sql())
def q_change_feed(spark, d):
    """Every changed row of two archive versions."""
    return C.flat_feed(C.change_feed(*_versions(spark, d)))


@register("feed_refresh", _new_state_sql("SELECT * FROM sd"))
def q_feed_refresh(spark, d):
    """X9 from a stored feed: the search documents of the new state."""
    old, new = _versions(spark, d)
    held = stored_docs(spark, d, "before", lambda: S.build_search_docs(*old.values()))
    return S.refresh_search_docs(held, C.change_set(_feed(spark, d, old, new)), *new.values())

