"""Lexical search: search documents, inverted index, boolean match, BM25,
paging, snippets, incremental index upkeep (X1-X10).

Layout of the index (all DataFrames, written as Parquet by ``write_index``):

* ``docs``     - one row per paper: paper_id, archive_id, title, abstract,
                 keywords, authors (the four indexed fields are text).
* ``postings`` - one row per (term, paper_id, field): tf and the token
                 positions inside that field.  Stored as blocks, one row per
                 term and chunk of papers, bucketed by a hash of the term and
                 sorted by term, so a term lookup reads a few row groups
                 (``PushedFilters: [In(term, ...)]``); read as rows again.
* ``doclen``   - paper_id, n_tokens over all indexed fields.
* ``terms``    - the dictionary: one row per term with its bucket, the number of
                 papers and of occurrences and the papers per field, sorted by
                 term.  A prefix is resolved here first and reads only the
                 buckets of its terms; document counts of plain terms come from
                 here; phrases start from their rarest term.

``segments`` keeps the same index as immutable segments, for incremental upkeep.

Queries are structured values (``phrase``, ``prefix``, ``all_of``, ``any_of``,
``but_not``, ``near``, ``in_field``); a plain string means all of its words
(``words_query``), and operator syntax in it raises.  A match is computed with one aggregation per query: each
leaf yields (paper_id, hits), the leaves are pivoted to one row per candidate
paper, and the boolean expression is a column expression over the hit
counts.  AND/OR/NOT therefore never join document sets pairwise, and a hot
term (``the``) only widens a partial aggregation keyed by paper_id.
"""


import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field as dc_field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_once
from ..functions.tokens import TOKEN_PATTERN, normalize_token, token_array

FIELDS = ("title", "abstract", "keywords", "authors")
# Fixed values of the ranking function: Okapi BM25 as computed by SQLite FTS5.
BM25_K1 = 1.2
BM25_B = 0.75
IDF_FLOOR = 1e-6
# Paging rules of the search endpoint.
DEFAULT_LIMIT, MIN_LIMIT, MAX_LIMIT, DEFAULT_OFFSET = 20, 1, 100, 0
SNIPPET_TOKENS = 24
MARK_OPEN, MARK_CLOSE, ELLIPSIS = "<mark>", "</mark>", "..."
NEAR_DEFAULT = 10
CHUNK_TOKENS = 1_000_000        # tokens whose postings a task makes at once, and the papers that begin among them
PART_CHARS = 64_000_000         # characters of the papers that one task writes postings of
LEAST_CHARS = 4_000_000         # ... where there are fewer papers than that per core
BROADCAST_PAPERS = 100_000      # ids (8 bytes each) of a phrase's rarest word that are sent to every task


class SearchSyntaxError(ValueError):
    """Raised eagerly on the driver for a query that cannot be matched."""

    def __init__(self, query, reason: str = "Invalid full-text search syntax"):
        super().__init__(reason)
        self.query = query


# ------------------------------------------------------------ query model ---
@dataclass(frozen=True)
class Phrase:
    tokens: tuple[str, ...]
    prefix: bool = False            # last token matches as a prefix
    fields: tuple[str, ...] | None = None
    initial: bool = False           # must start at position 0 of its field


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    keep: object
    drop: object


@dataclass(frozen=True)
class Near:
    phrases: tuple                  # Phrase leaves
    distance: int = NEAR_DEFAULT


def _split_tokens(text: str) -> tuple[str, ...]:
    import regex
    return tuple(regex.findall(TOKEN_PATTERN, text.lower()))


def phrase(text: str, *, prefix: bool = False, initial: bool = False) -> Phrase:
    """A phrase: the text is cut into tokens exactly like indexed text."""
    toks = _split_tokens(text)
    if not toks:
        raise SearchSyntaxError(text)
    return Phrase(toks, prefix=prefix, initial=initial)


def term(text: str) -> Phrase:
    return phrase(text)


def prefix(text: str) -> Phrase:
    return phrase(text, prefix=True)


def all_of(*parts) -> And:
    return And(tuple(_q(p) for p in parts))


def any_of(*parts) -> Or:
    return Or(tuple(_q(p) for p in parts))


def but_not(keep, drop) -> Not:
    return Not(_q(keep), _q(drop))


def near(*parts, distance: int = NEAR_DEFAULT) -> Near:
    ps = tuple(_q(p) for p in parts)
    if len(ps) < 2 or not all(isinstance(p, Phrase) for p in ps):
        raise SearchSyntaxError(parts, "near() takes two or more phrases")
    if any(p.initial for p in ps):
        raise SearchSyntaxError(parts, "near() phrases cannot be anchored")
    return Near(ps, distance)


def _q(x):
    return phrase(x) if isinstance(x, str) else x


_SYNTAX = frozenset('"()*^:+{}')


def words_query(text: str):
    """A plain query string: all of its words, ``OR`` between alternatives, a
    trailing ``*`` for a prefix.  Any other operator syntax raises - build
    such queries from the structured parts."""
    options = []
    for option in re.split(r"\s+OR\s+", text.strip()):
        parts = []
        for word in option.split():
            if word in ("AND", "OR", "NOT", "NEAR") or _SYNTAX & set(word.removesuffix("*")):
                if word == "AND" and parts:
                    continue
                raise SearchSyntaxError(text, "operator syntax: build the query from its parts")
            parts.append(phrase(word, prefix=word.endswith("*")))
        if not parts:
            raise SearchSyntaxError(text)
        options.append(parts[0] if len(parts) == 1 else And(tuple(parts)))
    return options[0] if len(options) == 1 else Or(tuple(options))


def in_field(q, fields) -> object:
    """Restrict every leaf of ``q`` to ``fields`` (all / one field name).

    Unlike splicing ``field:(q)`` into a query string, scope cannot leak.
    """
    if fields in (None, "all"):
        return q
    if isinstance(fields, str):
        fields = (fields,)
    bad = [f for f in fields if f not in FIELDS]
    if bad:
        raise SearchSyntaxError(q, f"unknown field {bad[0]!r}")
    fields = tuple(fields)

    def scope(n):
        if isinstance(n, Phrase):
            keep = fields if n.fields is None else tuple(f for f in n.fields if f in fields)
            return Phrase(n.tokens, n.prefix, keep, n.initial)
        if isinstance(n, And):
            return And(tuple(scope(p) for p in n.parts))
        if isinstance(n, Or):
            return Or(tuple(scope(p) for p in n.parts))
        if isinstance(n, Not):
            return Not(scope(n.keep), scope(n.drop))
        if isinstance(n, Near):
            return Near(tuple(scope(p) for p in n.phrases), n.distance)
        raise SearchSyntaxError(n)
    return scope(_q(q))


def _leaves(q) -> list:
    """Leaves in query order (a Near node is one leaf)."""
    if isinstance(q, (Phrase, Near)):
        return [q]
    if isinstance(q, (And, Or)):
        return [leaf for p in q.parts for leaf in _leaves(p)]
    if isinstance(q, Not):
        return _leaves(q.keep) + _leaves(q.drop)
    raise SearchSyntaxError(q)


def _bool_expr(q, leaves, hit_cols) -> Column:
    if isinstance(q, (Phrase, Near)):
        return hit_cols[leaves.index(q)] > 0
    if isinstance(q, And):
        out = None
        for p in q.parts:
            e = _bool_expr(p, leaves, hit_cols)
            out = e if out is None else (out & e)
        return out
    if isinstance(q, Or):
        out = None
        for p in q.parts:
            e = _bool_expr(p, leaves, hit_cols)
            out = e if out is None else (out | e)
        return out
    if isinstance(q, Not):
        return _bool_expr(q.keep, leaves, hit_cols) & ~_bool_expr(q.drop, leaves, hit_cols)
    raise SearchSyntaxError(q)


def _has_positive(q) -> bool:
    if isinstance(q, (Phrase, Near)):
        return True
    if isinstance(q, And):
        return any(_has_positive(p) for p in q.parts)
    if isinstance(q, Or):
        return all(_has_positive(p) for p in q.parts)
    if isinstance(q, Not):
        return _has_positive(q.keep)
    return False


# ------------------------------------------------------------ index build ---
def build_search_docs(papers: DataFrame, authors: DataFrame, keywords: DataFrame,
                      author_links: DataFrame, keyword_links: DataFrame) -> DataFrame:
    """One searchable document per paper.

    keywords = keyword texts joined by a space in keyword order; authors =
    TRIM(first || ' ' || last) joined by a space in author-position order;
    abstract null -> ''.  Both link sides are aggregated separately (never
    joined to each other: that would multiply rows) and left-joined once.
    Link rows are first reduced to the papers being indexed (a semi join on
    paper_id, which the following per-paper aggregation reuses as its
    partitioning).
    """
    ids = papers.select("paper_id")
    keyword_links = keyword_links.join(ids, "paper_id", "left_semi")
    author_links = author_links.join(ids, "paper_id", "left_semi")
    kw = (keyword_links.join(keywords, "keyword_id")
          .groupBy("paper_id")
          .agg(F.array_join(F.array_sort(F.collect_list("keyword")), " ").alias("keywords")))
    name = F.regexp_replace(
        F.concat(F.coalesce("first_name", F.lit("")), F.lit(" "), F.coalesce("last_name", F.lit(""))),
        r"\A +| +\z", "")
    au = (author_links.join(authors, "author_id")
          .groupBy("paper_id")
          .agg(F.array_join(
              F.transform(F.array_sort(F.collect_list(F.struct(
                  F.col("author_position").alias("p"), name.alias("n")))), lambda s: s["n"]),
              " ").alias("authors")))
    return (papers.select("paper_id", "archive_id", F.col("paper_title").alias("title"),
                          F.coalesce("abstract", F.lit("")).alias("abstract"))
            .join(kw, "paper_id", "left").join(au, "paper_id", "left")
            .select("paper_id", "archive_id", "title", "abstract",
                    F.coalesce("keywords", F.lit("")).alias("keywords"),
                    F.coalesce("authors", F.lit("")).alias("authors")))


def token_rows(docs: DataFrame, fields=FIELDS, fold: bool = False,
               stem: bool = False) -> DataFrame:
    """One row per token occurrence: (paper_id, field, pos, term).

    One generate over all fields of a document (``inline`` of the per-field
    token arrays, then ``posexplode``), so the documents are read once - a
    union of per-field selects would recompute the document plan per field.
    """
    per_field = F.array(*[F.struct(F.lit(f).alias("field"), token_array(F.col(f), fold, stem).alias("toks"))
                          for f in fields])
    out = (docs.select("paper_id", F.inline(per_field))
           .select("paper_id", "field", F.posexplode("toks").alias("pos", "term")))
    return out


@dataclass
class SearchIndex:
    docs: DataFrame
    postings: DataFrame
    doclen: DataFrame
    stats: dict = dc_field(default_factory=dict)   # optional precomputed n_docs, avgdl
    fold: bool = False
    stem: bool = False
    terms: DataFrame | None = None                 # the stored dictionary, see term_dictionary

    def corpus_stats(self) -> dict:
        """N and mean document length as Columns: literals when the index
        carries them, else uncorrelated scalar subqueries (planned once,
        no driver round trip, no join)."""
        if self.stats:
            return {"n_docs": F.lit(self.stats["n_docs"]), "avgdl": F.lit(self.stats["avgdl"])}
        return {"n_docs": self.doclen.select(F.count("*")).scalar(),
                "avgdl": self.doclen.select(F.avg("n_tokens")).scalar()}


# Postings come straight from the documents.  All documents of a paper meet in one task (one shuffle of the
# documents, none of tokens), sorted by paper; chunks of whole papers are turned into postings by sorting numbers.
def _starts(key: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]][:len(key)])


def _lists(starts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)], pa.int32()), values)


def _paper_runs(papers: pa.Array) -> np.ndarray:
    """Where each paper's rows begin, in rows sorted by paper; null is a paper like others."""
    code = papers.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return _starts(code)


@dataclass
class _Chunk:
    """The postings of some papers, by term, paper and field."""
    terms: pa.Array             # a posting's term is terms[term]
    term: np.ndarray
    paper: np.ndarray           # place among the papers
    papers: pa.Array
    field: np.ndarray           # place in FIELDS
    tf: np.ndarray
    positions: pa.Array


def _chunk(rows: pa.Table) -> _Chunk:
    """``rows``: paper_id and a list of tokens per field, all rows of a paper together."""
    runs = _paper_runs(rows["paper_id"].combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(0).type))
    paper = np.repeat(np.arange(len(runs)), np.diff(np.r_[runs, rows.num_rows]))
    step = len(runs) * len(FIELDS)
    words, key, pos = [], [], []
    for f, name in enumerate(FIELDS):
        toks = rows[name].combine_chunks()
        toks = pa.concat_arrays(toks.chunks) if isinstance(toks, pa.ChunkedArray) else toks
        size = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words.append(toks.flatten())
        key.append(np.repeat(paper * len(FIELDS) + f, size))
        pos.append(np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    coded = pa.concat_arrays(words).dictionary_encode()
    key, pos = coded.indices.to_numpy().astype(np.int64) * step + np.concatenate(key), np.concatenate(pos).astype(np.int32)
    # places come in order unless a paper has several documents
    order = np.argsort(key, kind="stable") if len(runs) == rows.num_rows else np.lexsort((pos, key))
    key, pos = key[order], pos[order]
    post = _starts(key)
    one = key[post]
    return _Chunk(coded.dictionary, one // step, one % step // len(FIELDS), rows["paper_id"].take(pa.array(runs)).combine_chunks(),
                  one % len(FIELDS), np.diff(np.r_[post, len(key)]), _lists(post, pa.array(pos)))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    """Chunks of about CHUNK_TOKENS tokens; the last paper of the rows at hand waits for what may follow of it."""
    held: list[pa.RecordBatch] = []
    n = 0
    for rb in batches:
        size = sum(pc.fill_null(pc.list_value_length(rb.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, rb.num_columns))
        at = 0
        for cut in np.flatnonzero(np.diff((n + np.cumsum(size)) // CHUNK_TOKENS, prepend=n // CHUNK_TOKENS)) + 1:
            held.append(rb.slice(at, int(cut) - at))
            at = int(cut)
            rows = pa.Table.from_batches(held).combine_chunks()
            last = int(_paper_runs(rows["paper_id"].combine_chunks())[-1])
            if last:
                yield _chunk(rows.slice(0, last))
            held = rows.slice(last).to_batches()
        if at < rb.num_rows:
            held.append(rb.slice(at))
        n += int(size.sum())
    if held:
        yield _chunk(pa.Table.from_batches(held).combine_chunks())


def _posting_columns(c: _Chunk) -> list[pa.Array]:
    return [c.papers.take(pa.array(c.paper)), pa.array(FIELDS).take(pa.array(c.field)), pa.array(c.tf, pa.int64()), c.positions]


def _posting_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c in _chunks(batches):
        rows = pa.RecordBatch.from_arrays([c.terms.take(pa.array(c.term)), *_posting_columns(c)],
                                          names=["term", "paper_id", "field", "tf", "positions"])
        for at in range(0, rows.num_rows, 100_000):
            yield rows.slice(at, 100_000)


def _counts(c: _Chunk, block: np.ndarray) -> tuple:
    """Of each term (``block``: where its postings begin): papers, papers that have an id, occurrences, papers per field."""
    first = np.zeros(len(c.term), np.int64)
    first[_starts(c.term * max(1, len(c.papers)) + c.paper)] = 1
    known = first * c.papers.is_valid().to_numpy(zero_copy_only=False)[c.paper]
    per_field = np.stack([np.add.reduceat((c.field == f).astype(np.int64), block) for f in range(len(FIELDS))], axis=1)
    return (pa.array(np.add.reduceat(first, block)), pa.array(np.add.reduceat(known, block)), pa.array(np.add.reduceat(c.tf, block).astype(np.int64)),
            _lists(np.arange(0, per_field.size, len(FIELDS)), pa.array(per_field.reshape(-1))))


def _posting_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c in _chunks(batches):
        block = _starts(c.term)
        if not len(block):
            continue
        papers, _, tf, positions = _posting_columns(c)
        terms = c.terms.take(pa.array(c.term[block]))
        df, _, cf, field_df = _counts(c, block)
        rows = pa.RecordBatch.from_arrays(
            [terms, df, cf, field_df, _lists(block, papers), _lists(block, pa.array(c.field, pa.int32())), _lists(block, tf), _lists(block, positions)],
            names=["term", "df", "cf", "field_df", "papers", "fields", "tfs", "places"])
        for at in range(0, rows.num_rows, 20_000):
            yield rows.slice(at, 20_000)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c in _chunks(batches):
        block = _starts(c.term)
        if len(block):
            yield pa.RecordBatch.from_arrays([c.terms.take(pa.array(c.term[block])), *_counts(c, block)],
                                             names=["term", "df", "ids", "cf", "field_df"])


_COUNTS = "df long, cf long, field_df array<bigint>"


def _by_paper(docs: DataFrame, fold: bool, stem: bool, n: int | None = None) -> DataFrame:
    """(paper_id, tokens per field), a paper's documents one after the other; dealt to ``n`` tasks, or as many as Spark likes."""
    rows = docs.select("paper_id", *FIELDS)
    rows = (rows.repartition(n, "paper_id") if n else rows.repartition("paper_id")).sortWithinPartitions("paper_id")
    return rows.select("paper_id", *[token_array(F.col(f), fold, stem).alias(f) for f in FIELDS])


def build_postings(docs: DataFrame, fold: bool = False, stem: bool = False) -> SearchIndex:
    """Inverted index and document lengths from search documents.

    A posting is made where its document is: tokens are never shuffled, and
    a task holds the tokens of a bounded chunk of papers, whatever the input.
    """
    kind = dict(docs.dtypes)["paper_id"]
    postings = _by_paper(docs, fold, stem).mapInArrow(
        _posting_rows, f"term string, paper_id {kind}, field string, tf long, positions array<int>")
    doclen = (docs.select("paper_id", sum(
        (F.size(token_array(F.col(f))) for f in FIELDS), F.lit(0)).cast("long").alias("n_tokens")))
    return SearchIndex(docs, postings, doclen, fold=fold, stem=stem)


def term_dictionary(postings: DataFrame) -> DataFrame:
    """(term, df, cf, field_df): papers and occurrences of every term, and papers per field in the order of FIELDS.

    Rows of a (term, paper) are joined first, so a frequent term is counted by many tasks."""
    n_fields = [F.count_if(F.col("field") == f).alias(f"f{i}") for i, f in enumerate(FIELDS)]
    per = postings.groupBy("term", "paper_id").agg(F.sum("tf").alias("cf"), *n_fields)
    return per.groupBy("term").agg(F.count("*").alias("df"), F.sum("cf").alias("cf"),
                                   F.array(*[F.sum(f"f{i}") for i in range(len(FIELDS))]).alias("field_df"))


def vocabulary(docs: DataFrame, fold: bool = False, stem: bool = False) -> DataFrame:
    """(term, df, cf) straight from the documents, one row per paper, without postings.

    A paper gives each of its tokens as an occurrence and each distinct one as a paper; both are counted in
    one grouping by term, so what is shuffled is a row per term and task."""
    toks = F.flatten(F.array(*[token_array(F.col(f), fold, stem) for f in FIELDS]))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    as_cf = lambda t: F.struct(t.alias("term"), none.alias("df"), one.alias("cf"))
    as_df = lambda t: F.struct(t.alias("term"), one.alias("df"), none.alias("cf"))
    # the token arrays are a column of their own before they are used twice
    rows = docs.select(F.explode(F.array(toks)).alias("toks")).select(F.inline(F.concat(
        F.transform("toks", as_cf), F.transform(F.array_distinct("toks"), as_df))))
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def lookup_terms(index: SearchIndex, tokens) -> dict:
    """Dictionary rows of the query's own tokens; a token that is missing here is in no paper."""
    rows = index.terms.filter(F.col("term").isin(sorted(set(tokens)))).select("term", "df", "cf", "field_df").collect()
    return {r["term"]: r for r in rows}


def prefix_terms(index: SearchIndex, start: str) -> DataFrame:
    """The dictionary rows of the terms that begin with ``start``: a range of a table sorted by term."""
    return index.terms.filter(F.col("term").startswith(start))


def prefix_buckets(index: SearchIndex, start: str) -> list[int]:
    """The posting buckets (at most all of them) that hold terms with this beginning."""
    return sorted(r[0] for r in prefix_terms(index, start).select("bucket").distinct().collect())


def term_bucket(term_col: Column, n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(term_col), F.lit(n_buckets))


def write_index(index: SearchIndex, path: str, n_buckets: int = 64) -> SearchIndex:
    """Persist the index (X10 compaction = this rewrite) and return it
    read back, with N and avgdl stored next to it.

    Postings lie in blocks, a row per term and chunk of papers, clustered by
    term bucket and sorted by term inside each file, so a term lookup prunes
    to one bucket folder and Parquet min/max statistics skip row groups.
    """
    spark = index.docs.sparkSession
    # documents first; postings and lengths are then derived from the
    # written copy, so the document plan runs once
    index.docs.write.mode("errorifexists").parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs")
    index = build_postings(docs, fold=index.fold, stem=index.stem)
    kind = dict(docs.dtypes)["paper_id"]
    chars = docs.agg(F.sum(sum((F.coalesce(F.length(f), F.lit(0)) for f in FIELDS), F.lit(0)))).first()[0] or 0
    n = max(1, chars // PART_CHARS, min(spark.sparkContext.defaultParallelism, chars // LEAST_CHARS))
    # a task writes its papers' blocks of every bucket: a frequent term's postings are spread over
    # all of the bucket's files, and no posting is shuffled
    (_by_paper(docs, index.fold, index.stem, n)
     .mapInArrow(_posting_blocks, f"term string, {_COUNTS}, papers array<{kind}>, fields array<int>, tfs array<bigint>, places array<array<int>>")
     .withColumn("bucket", term_bucket(F.col("term"), n_buckets)).sortWithinPartitions("bucket", "term")
     .write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/postings"))
    # dictionary: a block has all rows of its papers, so its counts are added up
    (_sum_counts(spark.read.schema(f"term string, {_COUNTS}").parquet(f"{path}/postings")).withColumn("bucket", term_bucket(F.col("term"), n_buckets))
     .repartitionByRange("term").sortWithinPartitions("term").write.mode("errorifexists").parquet(f"{path}/terms"))
    index.doclen.write.mode("errorifexists").parquet(f"{path}/doclen")
    dl = spark.read.parquet(f"{path}/doclen")
    dl.agg(F.count("*").alias("n_docs"), F.avg("n_tokens").alias("avgdl"), F.lit(n_buckets).alias("n_buckets"),
           F.lit(index.fold).alias("fold"), F.lit(index.stem).alias("stem")) \
        .coalesce(1).write.mode("errorifexists").parquet(f"{path}/stats")
    return read_index(spark, path)


def _sum_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"),
                                      F.array(*[F.sum(F.col("field_df")[i]) for i in range(len(FIELDS))]).alias("field_df"))


def _read_postings(spark, path: str, kind: str) -> DataFrame:
    """Stored blocks as posting rows; conditions on bucket and term reach the scan."""
    blocks = spark.read.schema(f"term string, papers array<{kind}>, fields array<int>, tfs array<bigint>, places array<array<int>>, bucket int").parquet(path)
    names = F.array(*[F.lit(f) for f in FIELDS])
    entry = F.arrays_zip(F.col("papers").alias("paper_id"), F.col("fields").alias("field"), F.col("tfs").alias("tf"), F.col("places").alias("positions"))
    return (blocks.select("term", "bucket", F.inline(entry).alias("paper_id", "field", "tf", "positions"))
            .select("term", "paper_id", F.get(names, F.col("field")).alias("field"), "tf", "positions", "bucket"))


def read_index(spark, path: str) -> SearchIndex:
    st = spark.read.parquet(f"{path}/stats").first()          # one row
    docs = spark.read.parquet(f"{path}/docs")
    return SearchIndex(docs, _read_postings(spark, f"{path}/postings", dict(docs.dtypes)["paper_id"]),
                       spark.read.parquet(f"{path}/doclen"),
                       {"n_docs": int(st["n_docs"]), "avgdl": float(st["avgdl"] or 0.0),
                        "n_buckets": int(st["n_buckets"])}, fold=st["fold"], stem=st["stem"],
                       terms=spark.read.parquet(f"{path}/terms"))


def _scan_terms(index: SearchIndex, p: DataFrame, toks, last_is_prefix: bool) -> DataFrame:
    """Prune a persisted posting scan to the buckets of the query's terms; a prefix is resolved in the dictionary."""
    nb = index.stats.get("n_buckets") if index.stats else None
    if not nb or "bucket" not in p.columns or (last_is_prefix and index.terms is None):
        return p
    # bucket(lit) constant-folds, so this prunes bucket folders at planning
    wanted = [term_bucket(F.lit(t), nb) for t in (toks[:-1] if last_is_prefix else toks)]
    if last_is_prefix:
        wanted += [F.lit(b) for b in prefix_buckets(index, toks[-1])]
    return p.filter(F.col("bucket").isin(*wanted)) if wanted else p.filter(F.lit(False))


# ---------------------------------------------------------------- matching ---
def _term_match(c: Column, tok: str, is_prefix: bool) -> Column:
    return c.startswith(tok) if is_prefix else (c == tok)


def _leaf_hits(postings: DataFrame, leaf, i: int, index: SearchIndex | None = None) -> DataFrame:
    """(paper_id, leaf, hits) for one leaf."""
    if isinstance(leaf, Near):
        return _near_hits(postings, leaf, i, index)
    p = _leaf_postings(postings, leaf, index)
    if len(leaf.tokens) == 1 and not leaf.initial:
        # raw posting rows: the per-paper pivot sums them (no shuffle here)
        hits = p.filter(_term_match(F.col("term"), leaf.tokens[0], leaf.prefix)) \
                .select("paper_id", F.col("tf").alias("hits"))
    else:
        starts = _phrase_starts(p, leaf, index)
        n = F.array_contains("starts", 0).cast("int") if leaf.initial else F.size("starts")
        hits = starts.select("paper_id", n.alias("hits")).filter("hits > 0")
    return hits.select("paper_id", F.lit(i).alias("leaf"), F.col("hits").cast("long"))


def _leaf_postings(postings: DataFrame, leaf: Phrase, index: SearchIndex | None) -> DataFrame:
    p = postings if index is None else _scan_terms(index, postings, leaf.tokens, leaf.prefix)
    return p if leaf.fields is None else p.filter(F.col("field").isin(list(leaf.fields)))


def _phrase_starts(p: DataFrame, leaf: Phrase, index: SearchIndex | None = None) -> DataFrame:
    """(paper_id, field, starts): where a phrase begins, a row per paper and field that holds it.

    The position lists of its words meet per (paper, field) and are
    intersected, each shifted by the word's place in the phrase, from the
    rarest word on.  With a stored dictionary the other words' rows are first
    cut to the papers of the rarest word, so a phrase costs what its rarest
    word costs, however frequent the others are.
    """
    n = len(leaf.tokens)
    last = n - 1 if leaf.prefix else None           # the place whose word is only a beginning
    words = list(dict.fromkeys((t, k == last) for k, t in enumerate(leaf.tokens)))
    conds = [_term_match(F.col("term"), t, pre) for t, pre in words]
    any_cond = conds[0]
    for c in conds[1:]:
        any_cond = any_cond | c
    order = list(range(n))
    if index is not None and index.terms is not None and n > 1:
        known = lookup_terms(index, [t for t, pre in words if not pre])
        df = {k: (known[t]["df"] if t in known else 0) for k, t in enumerate(leaf.tokens) if k != last}
        order.sort(key=lambda k: df.get(k, math.inf))
        rarest = _term_match(F.col("term"), leaf.tokens[order[0]], False)
        ids = p.filter(rarest).select("paper_id")
        # a bounded set of ids is sent to the scan, a larger one meets it by paper
        few = df[order[0]] <= BROADCAST_PAPERS
        p = p.filter(any_cond).join(F.broadcast(ids) if few else ids, "paper_id", "left_semi")
    per = p.filter(any_cond).groupBy("paper_id", "field").agg(*[
        F.flatten(F.collect_list(F.when(c, F.col("positions")))).alias(f"w{i}") for i, c in enumerate(conds)])
    for i in range(len(words)):
        per = per.filter(F.size(f"w{i}") > 0)
    starts = None
    for k in order:
        i = words.index((leaf.tokens[k], k == last))
        shifted = _shifted(f"w{i}", k)
        starts = shifted if starts is None else F.array_intersect(starts, shifted)
    return per.select("paper_id", "field", starts.alias("starts")).filter(F.size("starts") > 0)


def _shifted(positions: str, k: int) -> Column:
    return F.transform(positions, lambda x: x - F.lit(k))


def _near_hits(postings: DataFrame, leaf: Near, i: int, index: SearchIndex | None = None) -> DataFrame:
    """NEAR: an occurrence of every phrase inside one field such that at most
    ``distance`` tokens stand between the end of any of them and the start of
    the last.

    Occurrences are rows (paper, field, phrase k, start, length); a window
    per (paper, field) ordered by start keeps the latest start of every
    phrase, and a row whose latest-occurrence set fits the distance is one
    hit.  No position pairs are formed.
    """
    n = len(leaf.phrases)
    rows = None
    for k, ph in enumerate(leaf.phrases):
        p = _leaf_postings(postings, ph, index)
        if len(ph.tokens) == 1:
            r = p.filter(_term_match(F.col("term"), ph.tokens[0], ph.prefix)).withColumnRenamed("positions", "starts")
        else:
            r = _phrase_starts(p, ph, index)
        r = r.select("paper_id", "field", F.lit(k).alias("k"), F.explode("starts").alias("start"),
                     F.lit(len(ph.tokens)).alias("len"))
        rows = r if rows is None else rows.unionByName(r)
    w = Window.partitionBy("paper_id", "field").orderBy("start", "k") \
              .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.max(F.when(F.col("k") == k, F.col("start"))).over(w) for k in range(n)]
    lens = [len(ph.tokens) for ph in leaf.phrases]
    ok = F.lit(True)
    for k in range(n):      # the current row is the last phrase
        ok = ok & (F.col("start") - last[k] - F.lit(lens[k]) <= leaf.distance)
    for c in last:
        ok = ok & c.isNotNull()
    hits = rows.withColumn("ok", ok).filter("ok").select("paper_id", F.lit(1).alias("hits"))
    return hits.select("paper_id", F.lit(i).alias("leaf"), F.col("hits").cast("long"))


def normalize_query(q, fold: bool, stem: bool):
    """The query with its tokens put through the index's rules."""
    if not (fold or stem):
        return q
    if isinstance(q, Phrase):
        return replace(q, tokens=tuple(normalize_token(t, fold, stem) for t in q.tokens))
    if isinstance(q, Near):
        return replace(q, phrases=tuple(normalize_query(p, fold, stem) for p in q.phrases))
    if isinstance(q, Not):
        return Not(normalize_query(q.keep, fold, stem), normalize_query(q.drop, fold, stem))
    return type(q)(tuple(normalize_query(p, fold, stem) for p in q.parts))


def match_hits(index: SearchIndex, q) -> tuple[DataFrame, list]:
    """Per candidate paper: hit counts of every leaf (h0..hn) and ``matched``."""
    q = normalize_query(q, index.fold, index.stem)
    leaves = _leaves(q)
    if not _has_positive(q):
        raise SearchSyntaxError(q, "query needs a positive term")
    parts = [_leaf_hits(index.postings, leaf, i, index) for i, leaf in enumerate(leaves)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    piv = u.groupBy("paper_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("leaf") == i, F.col("hits"))), F.lit(0)).alias(f"h{i}")
        for i in range(len(leaves))])
    hit_cols = [F.col(f"h{i}") for i in range(len(leaves))]
    return piv.withColumn("matched", _bool_expr(q, leaves, hit_cols)), leaves


def match_boolean(index: SearchIndex, q) -> DataFrame:
    """Ids of matching papers."""
    piv, _ = match_hits(index, q)
    return piv.filter("matched").select("paper_id")


def match_count(index: SearchIndex, q) -> DataFrame:
    """A1: one row, total matches (0 when none)."""
    return match_boolean(index, q).agg(F.count("*").alias("total"))


def known_count(leaf, known: dict) -> int | None:
    """Papers with a hit of a leaf, where the dictionary says it: a plain term, in all fields or in one."""
    if not isinstance(leaf, Phrase) or len(leaf.tokens) != 1 or leaf.prefix or leaf.initial:
        return None
    row = known.get(leaf.tokens[0])
    if leaf.fields is None:
        return row["df"] if row else 0
    if len(leaf.fields) == 1:
        return row["field_df"][FIELDS.index(leaf.fields[0])] if row else 0
    return None


def idf(n_docs: Column, n: Column) -> Column:
    raw = F.log((n_docs - n + F.lit(0.5)) / (n + F.lit(0.5)))
    return F.when(raw > 0, raw).otherwise(F.lit(IDF_FLOOR))


def bm25_rank(index: SearchIndex, q, k1: float = BM25_K1, b: float = BM25_B, with_total: bool = False) -> DataFrame:
    """(paper_id, rank) for matching papers; lower rank = better.

    Per leaf: idf = ln((N - n + .5) / (n + .5)) floored at 1e-6, n = papers
    with a hit; score = sum idf * f * (k1 + 1) / (f + k1 * (1 - b + b * len / avgdl)).
    The n of plain terms come from a stored dictionary.  Those of other leaves,
    and the number of matches (``with_total``: a column ``total``), are one
    scalar subquery over the same match set, returning an array that is
    projected once into a column and read element by element; N and avgdl
    come from the index's stored statistics (or one more scalar subquery).
    """
    piv, leaves = match_hits(index, q)
    st = index.corpus_stats()
    known = {}
    if index.terms is not None:
        known = lookup_terms(index, [t for x in leaves if isinstance(x, Phrase) for t in x.tokens])
    ns = [known_count(x, known) if index.terms is not None else None for x in leaves]
    asked = [i for i, n in enumerate(ns) if n is None]
    counts = [F.count_if(F.col(f"h{i}") > 0).cast("double") for i in asked]
    counts += [F.count_if("matched").cast("double")] if with_total else []
    m = piv.filter("matched").join(index.doclen, "paper_id")
    if counts:
        m = m.withColumn("_counts", piv.select(F.array(*counts)).scalar())
    m = m.withColumn("_ndocs", st["n_docs"].cast("double")).withColumn("_avgdl", st["avgdl"].cast("double"))
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("n_tokens") / F.col("_avgdl"))
    idfs = [idf(F.col("_ndocs"), F.col("_counts")[asked.index(i)] if n is None else F.lit(float(n))).alias(f"_idf{i}")
            for i, n in enumerate(ns)]
    total = [F.col("_counts")[len(asked)].cast("long").alias("total")] if with_total else []
    m = m.select("paper_id", "n_tokens", "_avgdl", *[F.col(f"h{i}") for i in range(len(leaves))], *idfs, *total)
    score = F.lit(0.0)
    for i in range(len(leaves)):
        f = F.col(f"h{i}").cast("double")
        score = score + F.col(f"_idf{i}") * (f * F.lit(k1 + 1)) / (f + norm)
    return m.select("paper_id", (-score).alias("rank"), *(["total"] if with_total else []))


def clamp_paging(limit=None, offset=None) -> tuple[int, int]:
    """Integer-prefix parse, NaN -> default, limit in [1, 100], offset >= 0."""
    def parse(v, default):
        if v is None:
            return default
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return int(v) if math.isfinite(v) else default
        m = re.match(r"\s*([+-]?\d+)", str(v))
        return int(m.group(1)) if m else default
    lim = parse(limit, DEFAULT_LIMIT)
    off = parse(offset, DEFAULT_OFFSET)
    return min(max(lim, MIN_LIMIT), MAX_LIMIT), max(off, DEFAULT_OFFSET)


def search_page(index: SearchIndex, q, limit=None, offset=None,
                round_digits: int | None = None, with_total: bool = False) -> DataFrame:
    """Ranked page: order by rank then paper_id, offset, limit.

    Planned as TakeOrderedAndProject (a per-partition top-(offset+limit)
    heap, then one merge), never a full sort of the match set.
    """
    lim, off = clamp_paging(limit, offset)
    r = bm25_rank(index, q, with_total=with_total)
    if round_digits is not None:
        r = r.withColumn("rank", F.round("rank", round_digits))
    return r.orderBy("rank", "paper_id").offset(off).limit(lim)


def search_papers(index: SearchIndex, query, field: str = "all", limit=None, offset=None,
                  round_digits: int | None = None, with_snippet: bool = True, with_total: bool = False):
    """(page DataFrame, total DataFrame).

    Page columns: paper_id, archive_id, title, abstract ('' -> null),
    snippet, rank, and with ``with_total`` the total of all matches, counted on
    the match set that is ranked (the second frame plans it again, for a page
    without rows).  The page has at most 100 rows, so it is broadcast into the
    document join and the snippet runs only on those rows.
    """
    if isinstance(query, str):
        query = words_query(query)
    q = in_field(query, field)
    page = search_page(index, q, limit, offset, round_digits, with_total)
    rows = (F.broadcast(page).join(index.docs, "paper_id")
            .select("paper_id", "archive_id", "title",
                    F.nullif(F.col("abstract"), F.lit("")).alias("abstract"), "rank", *(["total"] if with_total else [])))
    if with_snippet:
        rows = rows.withColumn("snippet", snippet_col(F.coalesce("abstract", F.lit("")), q, fold=index.fold, stem=index.stem))
    total = match_count(index, q)
    return rows.orderBy("rank", "paper_id"), total


# ---------------------------------------------------------------- snippet ---
def _query_matchers(q) -> list[tuple[tuple[str, ...], bool]]:
    out = []
    for leaf in _leaves(q):
        phs = leaf.phrases if isinstance(leaf, Near) else (leaf,)
        for ph in phs:
            if ph.fields is None or "abstract" in ph.fields:
                out.append((ph.tokens, ph.prefix))
    return out


def _window_score(hits, start: int, width: int):
    """Score of the window [start, start + width): 1000 per distinct phrase,
    1 per repeat; also the first and last hit token inside it."""
    seen, score, first, last = set(), 0, -1, -1
    for s, pid, n in hits:
        if start <= s < start + width:
            score += 1 if pid in seen else 1000
            seen.add(pid)
            if first < 0:
                first = s
            last = s + n - 1
    return score, first, last


def snippet_text(text: str, matchers, width: int = SNIPPET_TOKENS, fold: bool = False, stem: bool = False) -> str:
    """X7 on one text: the best fragment of ``width`` tokens, hits marked.

    Candidates follow the FTS5 rule: for every hit, a window scored by
    1000 per distinct phrase + 1 per repeated hit and shifted so its hits sit
    in the middle; and a window starting at the sentence start before the
    hit (+100, +120 at the very start).  The first best candidate wins.
    Original text between tokens is kept; ``...`` marks a cut at either end.
    """
    import regex
    text = text or ""
    spans = [(m.start(), m.end(), m.group(0).lower()) for m in regex.finditer(TOKEN_PATTERN, text)]
    if not spans:
        return text
    toks = [normalize_token(t, fold, stem) for _, _, t in spans]
    ntok = len(toks)
    hit = [False] * ntok
    hits = []                         # (start token, phrase id, length), in text order
    for pid, (ptoks, pre) in enumerate(matchers):
        n = len(ptoks)
        for s in range(ntok - n + 1):
            if all((toks[s + k].startswith(ptoks[k]) if (pre and k == n - 1) else toks[s + k] == ptoks[k])
                   for k in range(n)):
                hits.append((s, pid, n))
                for k in range(n):
                    hit[s + k] = True
    hits.sort()
    # sentence starts: first token, or a token preceded by white space that
    # follows a '.' or ':'
    starts = [0]
    for i in range(1, ntok):
        gap = text[spans[i - 1][1]:spans[i][0]]
        core = gap.rstrip(" \t\n\r")
        if core != gap and core.endswith((".", ":")):
            starts.append(i)
    best, best_score = 0, 0
    for s, _pid, _n in hits:
        score, first, last = _window_score(hits, s, width)
        adj = first - (width - (last - first)) // 2
        if adj + width > ntok:
            adj = ntok - width
        adj = max(adj, 0)
        if score > best_score:
            best, best_score = adj, score
        if ntok > width:
            prior = [st for st in starts if st <= s]
            sst = prior[-1] if prior else 0
            if sst < s:
                sc2 = _window_score(hits, sst, width)[0] + (120 if sst == 0 else 100)
                if sc2 > best_score:
                    best, best_score = sst, sc2
    w1 = min(ntok, best + width)
    out = [ELLIPSIS] if best > 0 else []
    cur = spans[best][0]
    for t in range(best, w1):
        s0, e0, _ = spans[t]
        out.append(text[cur:s0])
        out.append(MARK_OPEN + text[s0:e0] + MARK_CLOSE if hit[t] else text[s0:e0])
        cur = e0
    out.append(ELLIPSIS if w1 < ntok else text[cur:])
    return "".join(out)


def snippet_col(text_col: Column, q, width: int = SNIPPET_TOKENS, fold: bool = False, stem: bool = False) -> Column:
    import pandas as pd
    matchers = _query_matchers(normalize_query(q, fold, stem))

    @F.pandas_udf(T.StringType())
    def _snip(s: pd.Series) -> pd.Series:
        return s.map(lambda t: snippet_text(t, matchers, width, fold, stem))
    return _snip(text_col)


# ------------------------------------------------------- index upkeep (X9) ---
@dataclass
class ChangeSet:
    """Row-level changes since the last index version.

    Every frame is optional; link frames carry ``paper_id`` (NEW rows) and
    ``old_paper_id`` (OLD rows of updates/deletes); text frames carry the id
    whose text changed.  Inserts/updates/deletes of papers carry paper_id (and
    old_paper_id for a key change).
    """
    papers_upserted: DataFrame | None = None      # X9a/X9b (paper_id, old_paper_id?)
    papers_deleted: DataFrame | None = None       # X9c (paper_id)
    keyword_links: DataFrame | None = None        # X9d-f (paper_id?, old_paper_id?)
    author_links: DataFrame | None = None         # X9g-i (paper_id?, old_paper_id?)
    keywords_renamed: DataFrame | None = None     # X9j (keyword_id)
    authors_renamed: DataFrame | None = None      # X9k (author_id)


def affected_papers(changes: ChangeSet, keyword_links: DataFrame,
                    author_links: DataFrame) -> DataFrame:
    """Distinct paper ids whose search document must be recomputed."""
    ids = []

    def cols(df, names):
        for n in names:
            if df is not None and n in df.columns:
                ids.append(df.select(F.col(n).alias("paper_id")))
    cols(changes.papers_upserted, ["paper_id", "old_paper_id"])
    cols(changes.papers_deleted, ["paper_id"])
    cols(changes.keyword_links, ["paper_id", "old_paper_id"])
    cols(changes.author_links, ["paper_id", "old_paper_id"])
    if changes.keywords_renamed is not None:
        ids.append(keyword_links.join(changes.keywords_renamed.select("keyword_id").distinct(),
                                      "keyword_id", "left_semi").select("paper_id"))
    if changes.authors_renamed is not None:
        ids.append(author_links.join(changes.authors_renamed.select("author_id").distinct(),
                                     "author_id", "left_semi").select("paper_id"))
    if not ids:
        return keyword_links.sparkSession.createDataFrame([], "paper_id long")
    out = ids[0]
    for d in ids[1:]:
        out = out.unionByName(d)
    return out.filter(F.col("paper_id").isNotNull()).distinct()


def refresh_search_docs(old_docs: DataFrame, changes: ChangeSet, papers: DataFrame,
                        authors: DataFrame, keywords: DataFrame, author_links: DataFrame,
                        keyword_links: DataFrame) -> DataFrame:
    """New search-docs version = old docs minus affected ids, plus the
    affected ids recomputed from the *current* relations (deleted papers
    simply do not come back).  Equals a full rebuild (X10) by construction
    of the affected-id rules; only affected ids are recomputed.
    """
    aff = write_once(affected_papers(changes, keyword_links, author_links), "affected-ids")
    keep = old_docs.join(aff, "paper_id", "left_anti")
    p = papers.join(aff, "paper_id", "left_semi")
    fresh = build_search_docs(p, authors, keywords,
                              author_links.join(aff, "paper_id", "left_semi"),
                              keyword_links.join(aff, "paper_id", "left_semi"))
    return keep.unionByName(fresh)


def refresh_index(index: SearchIndex, new_docs_for_ids: DataFrame, affected: DataFrame) -> SearchIndex:
    """Postings upkeep for a refreshed id set: drop the affected ids' postings
    and append postings of their new documents."""
    part = build_postings(new_docs_for_ids, fold=index.fold, stem=index.stem)
    post = index.postings.drop("bucket").join(affected, "paper_id", "left_anti").unionByName(part.postings)
    dl = index.doclen.join(affected, "paper_id", "left_anti").unionByName(part.doclen)
    docs = index.docs.join(affected, "paper_id", "left_anti").unionByName(new_docs_for_ids)
    return SearchIndex(docs, post, dl, fold=index.fold, stem=index.stem)


def rebuild_search_index(papers, authors, keywords, author_links, keyword_links,
                         fold: bool = False, stem: bool = False) -> SearchIndex:
    """Full recompute."""
    return build_postings(build_search_docs(papers, authors, keywords, author_links,
                                            keyword_links), fold=fold, stem=stem)


def corpus_stats(index: SearchIndex) -> DataFrame:
    """Per term: document frequency and collection frequency, with the
    corpus size N and mean document length as (scalar-subquery) columns."""
    st = index.corpus_stats()
    counts = _by_paper(index.docs, index.fold, index.stem).mapInArrow(_term_counts, "term string, df long, ids long, cf long, field_df array<bigint>")
    # papers without an id are in the occurrences, not among the papers
    per_term = counts.groupBy("term").agg(F.sum("ids").alias("df"), F.sum("cf").alias("cf"))
    return per_term.select("term", "df", "cf", st["n_docs"].cast("long").alias("n_docs"),
                           st["avgdl"].cast("double").alias("avgdl"))

