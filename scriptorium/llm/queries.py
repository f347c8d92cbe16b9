"""The registered queries of this subpackage, with DuckDB SQL where SQL can
express them.  Each reads its whole tables with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, hard_negatives, language_id, line_dedup, mix_sources, ngram_join, one_bit_codes, pii, ppm,
               simhash, spelling_variants, suffix_dedup, warc_zip)
from .common import is_in_fold, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# ------------------------------------------------------------ line dedup ---
OP1_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM lines),
owners AS (
  SELECT k, min(doc_id) AS lo FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)),
marked AS (
  SELECT keyed.*, coalesce(doc_id > lo, false) AS dropped FROM keyed LEFT JOIN owners USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op1_line_dedup", OP1_SQL)
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op2_pii")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_pii(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


@query("op3_simhash")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = materialize(simhash.fingerprints(docs), "fingerprints")
    near = simhash.near_counts(prints, F.col("doc_id") % 50 == 0)
    return near.select("doc_id", "n_chars", "edited_sha256", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"),
                       simhash.fingerprint_text(F.col("edited_fp")).alias("edited_fingerprint"),
                       simhash.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                       simhash.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near")


# ---------------------------------------------------------- n-gram join ---
OP4_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM words WHERE len(w) > 0),
cells AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM shingles),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o
  FROM cells a JOIN cells b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * o >= 80 * (na + nb - o)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT a, b FROM both_ways UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON reach.r = both_ways.a)
SELECT words.doc_id, coalesce(len(s), 0)::BIGINT AS n_shingles, least(words.doc_id, min(r)) AS component_id
FROM words LEFT JOIN shingles USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY words.doc_id, s
"""


@query("op4_ngram_jaccard", OP4_SQL)
def op4(spark, sf_dir):
    return ngram_join.near_duplicate_groups(table(spark, sf_dir, "documents"))


# ---------------------------------------------------- suffix-array dedup ---
OP5_SQL = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
chunks AS (
  SELECT doc_id, n, c, substr(x, 1000 * c + 1, 1400) AS x
  FROM (SELECT doc_id, x, len(x) // 2 AS n, unnest(range(0, len(x) // 1000 + 1)) AS c FROM bytes)),
windows AS (
  SELECT doc_id, 500 * c + i AS p, md5(substr(x, 2 * i + 1, 400)) AS h
  FROM (SELECT *, unnest(range(0, least(greatest(n - 500 * c - 199, 0), 500))) AS i FROM chunks)),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
starts AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM windows WHERE h IN (FROM again)),
marks AS (SELECT doc_id, p, sum((q IS NULL OR p > q + 200)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM starts),
runs AS (SELECT doc_id, min(p) AS lo, max(p) + 200 AS hi FROM marks GROUP BY doc_id, k),
pieces AS (
  SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER w AS from_, max(hi) OVER (PARTITION BY doc_id) AS last FROM runs
  WINDOW w AS (PARTITION BY doc_id ORDER BY lo)),
cut AS (
  SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, any_value(last) AS last,
         string_agg(substr(x, 2 * from_ + 1, 2 * (lo - from_)), '' ORDER BY lo) AS head
  FROM pieces JOIN bytes USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head || substr(x, 2 * last + 1), x))) AS kept_sha256
FROM bytes LEFT JOIN cut USING (doc_id)
"""


@query("op5_suffix_dedup", OP5_SQL)
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# ------------------------------------------------------- decontamination ---
_OP6_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
OP6_SQL = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_OP6_WORDS}') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_OP6_WORDS}') AS w FROM benchmark),
tests AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM tests),
windows AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs JOIN sizes ON len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM windows JOIN tests USING (n, t)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


@query("op6_decontaminate", OP6_SQL)
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
                        decontaminate.contaminated().alias("contaminated"))


# ------------------------------------------------------------------ WARC ---
OP7_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, upper(sha1(coalesce(html, ''))) AS x
  FROM pages),
firsts AS (SELECT x, min(page_id) AS first FROM p GROUP BY x),
digits AS (
  SELECT page_id, string_agg('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(v >> s) % 32 + 1], '' ORDER BY i, s DESC) AS payload_digest
  FROM (SELECT page_id, i, unnest([15, 10, 5, 0]) AS s, ('0x' || substr(x, 5 * i + 1, 5))::BIGINT AS v
        FROM (SELECT page_id, x, unnest(range(8)) AS i FROM p)) GROUP BY page_id)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p JOIN firsts USING (x) JOIN digits USING (page_id)
"""


@query("op7_warc_zip", OP7_SQL)
def op7(spark, sf_dir):
    manifest = warc_zip.write_packages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc_zip.read_records(manifest, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# ------------------------------------------------------------ source mix ---
OP8_SQL = """
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS src, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(doc_id::VARCHAR || ':mix-1') AS h FROM documents),
per AS (
  SELECT src, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY src) - 1) % 3 + 1] AS w FROM d GROUP BY src),
flow AS (
  SELECT *, 2 * source_size AS top,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER before, 0)::DOUBLE AS left_words,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS left_w,
         row_number() OVER (ORDER BY 2 * source_size / w::DOUBLE, src) AS k
  FROM per WINDOW before AS (ORDER BY 2 * source_size / w::DOUBLE, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rated AS (SELECT *, left_words / left_w::DOUBLE AS rate FROM flow),
final_rate AS (SELECT arg_min(rate, k) AS r FROM rated WHERE rate * w <= top),
targets AS (
  SELECT src, source_size, CASE WHEN rate * w > top THEN top::DOUBLE ELSE r * w END AS target FROM rated, final_rate),
spans AS (SELECT src, target, sum(target) OVER (ORDER BY src) AS hi FROM targets WHERE target > 0),
total AS (SELECT coalesce(sum(target), 0) AS t, ceil(coalesce(sum(target), 0) / 2048)::BIGINT AS n FROM targets),
points AS (
  SELECT slot, ((slot + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE - floor((slot + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE)) * t AS point
  FROM (SELECT t, unnest(range(n)) AS slot FROM total)),
ranked AS (
  SELECT src, slot, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rank
  FROM points JOIN spans ON point >= hi - target AND point < hi),
short AS (
  SELECT spans.src, coalesce(have, 0) AS have, ceil(floor(target) / 2048)::BIGINT AS needed
  FROM spans LEFT JOIN (SELECT src, count(*) AS have FROM ranked GROUP BY src) USING (src)
  WHERE ceil(floor(target) / 2048) > coalesce(have, 0)),
tail AS (
  SELECT src, rank, n + before + rank - have AS slot FROM total,
    (SELECT src, have, coalesce(sum(needed - have) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
            unnest(range(have, needed)) AS rank FROM short)),
slots AS (SELECT src, rank, slot FROM ranked UNION ALL SELECT src, rank, slot FROM tail),
laid AS (
  SELECT row_number() OVER () AS row, doc_id, src, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY src ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM d JOIN targets USING (src)),
runs AS (
  SELECT row, src, off + e * source_size AS a, least(off + e * source_size + size, floor(target)::BIGINT) AS z
  FROM (SELECT *, unnest([0, 1]) AS e FROM laid WHERE size > 0)),
pieces AS (
  SELECT row, src, block, least(z, 2048 * (block + 1)) - greatest(a, 2048 * block) AS words
  FROM (SELECT *, unnest(range(a // 2048, (z - 1) // 2048 + 1)) AS block FROM runs WHERE z > a)),
took AS (
  SELECT row, sum(words) AS taken, min(slot) AS first_slot FROM pieces JOIN slots ON pieces.src = slots.src AND block = rank GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot FROM laid LEFT JOIN took USING (row)
"""


@query("op8_mix_sources", OP8_SQL)
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources.taken_words(docs)


@query("op9_ppm")
def op9(spark, sf_dir):
    return ppm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_language_id")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = is_in_fold(F.col("doc_id"), 3, 1)
    model = language_id.fit(docs.filter(~held_out))
    return language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score", "ambiguous")


# ------------------------------------------------------ spelling variants ---
_MISSPELT = 97      # of the runs of letters, one in so many loses a letter
OP11_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda k: list_reduce(list_prepend(k, range(8)),
           lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, w, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents)
  WHERE length(w) >= 5 GROUP BY ALL),
hashed AS (
  SELECT w, k, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || w, ''),
           lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT]
                           ELSE [192 | (unicode(ch)::BIGINT >> 6), 128 | (unicode(ch)::BIGINT & 63)] END))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM runs, crc_table),
spelt AS (
  SELECT CASE WHEN h % {_MISSPELT} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM hashed),
counts AS (SELECT word, sum(k)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cuts AS (
  SELECT word, n, length(word) AS size, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM counts)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN counts b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN counts b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
forms AS (
  SELECT counts.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form,
         CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM counts LEFT JOIN best USING (word)),
up(word, top) AS (
  SELECT word, word FROM forms UNION ALL SELECT up.word, forms.form FROM up JOIN forms ON up.top = forms.word WHERE forms.form IS NOT NULL),
roots AS (SELECT up.word, top AS root FROM up JOIN forms ON up.top = forms.word WHERE forms.form IS NULL)
SELECT word, n, n_near, form, form_n, root FROM forms JOIN roots USING (word)
"""


def _misspelt(doc_id):
    """The planted misspellings of a document; rows without an id have none."""
    if doc_id is None:
        return None
    start = zlib.crc32(f"{doc_id}:".encode())

    def change(run: bytes) -> bytes:
        h = zlib.crc32(run, start)
        if h % _MISSPELT:
            return run
        word = run.decode()
        at = h % len(word)
        return (word[:at] + word[at + 1:]).encode()
    return change


@query("op11_spelling_variants", OP11_SQL)
def op11(spark, sf_dir):
    counts = spelling_variants.word_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), respell=_misspelt)
    return spelling_variants.spelling_forms(counts)


# --------------------------------------------------------- hard negatives ---
OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor, a.label AS label_a, b.vec_id AS id, b.label AS label_b, list_inner_product(a.e, b.e)::BIGINT AS s
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor, id AS positive, s AS p FROM scores WHERE label_a = label_b
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY s DESC, id) <= 5),
negatives AS (
  SELECT anchor, positive, p, id, s, row_number() OVER (PARTITION BY anchor, positive ORDER BY s DESC, id) AS rank
  FROM positives JOIN scores USING (anchor) WHERE label_a <> label_b AND 50 * p <= 100 * s AND 100 * s <= 95 * p)
SELECT anchor AS anchor_id, positive AS positive_id, rank::INTEGER AS rank, id AS negative_id, p AS positive_score, s AS negative_score
FROM negatives WHERE rank <= 3
"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, moved)


# ------------------------------------------------------ nearest neighbours ---
#: Exact neighbours; what the bounds lose is below one row in many thousands (README), none on the small tables.
OP13_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scores AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scores
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""


@query("op13_one_bit_ann", OP13_SQL)
def op13(spark, sf_dir):
    found = one_bit_codes.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
