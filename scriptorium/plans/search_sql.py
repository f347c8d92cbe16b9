"""Independent SQL formulation of the search operators, for the DuckDB oracle.

Phrases are matched with positional self-joins and the boolean expression
with left joins - deliberately a different plan from the Spark operator
(which pivots leaf hits in one aggregation), so agreement means something.
"""

from __future__ import annotations

from ..operators.search import (BM25_B, BM25_K1, FIELDS, IDF_FLOOR, And, Near, Not, Or,
                                Phrase, _leaves, normalize_query)
from ..sources.tables import (AUTHOR_LINKS_SQL, AUTHORS_SQL, DOCS_SQL, KEYWORD_LINKS_SQL,
                              KEYWORDS_SQL)
from .stem_sql import stem_ctes

TOKENS_SQL = r"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"

SEARCH_DOCS_SQL = """sd AS (
  SELECT d.paper_id, d.archive_id, d.paper_title AS title, coalesce(d.abstract, '') AS abstract,
    coalesce((SELECT string_agg(k.keyword, ' ' ORDER BY k.keyword)
              FROM keyword_links kl JOIN keywords k ON k.keyword_id = kl.keyword_id
              WHERE kl.paper_id = d.paper_id), '') AS keywords,
    coalesce((SELECT string_agg(trim(coalesce(a.first_name, '') || ' ' || coalesce(a.last_name, '')),
                                ' ' ORDER BY al.author_position)
              FROM author_links al JOIN authors a ON a.author_id = al.author_id
              WHERE al.paper_id = d.paper_id), '') AS authors
  FROM docs d)"""


def _arr_union():
    parts = []
    for f in FIELDS:
        parts.append(f"SELECT paper_id, '{f}' AS field, {TOKENS_SQL.format(c=f)} AS arr FROM sd")
    return " UNION ALL ".join(parts)


TOK_SQL = f"""fa AS ({_arr_union()}),
tok AS (SELECT paper_id, field, unnest(arr) AS term, unnest(range(len(arr))) AS pos FROM fa),
doclen AS (SELECT paper_id, CAST(sum(len(arr)) AS BIGINT) AS n_tokens FROM fa GROUP BY paper_id)"""

BASE_CTES = [DOCS_SQL, AUTHORS_SQL, KEYWORDS_SQL, KEYWORD_LINKS_SQL, AUTHOR_LINKS_SQL,
             SEARCH_DOCS_SQL, TOK_SQL]


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _match(alias: str, tok: str, is_prefix: bool) -> str:
    return (f"starts_with({alias}.term, {_lit(tok)})" if is_prefix
            else f"{alias}.term = {_lit(tok)}")


def _field_filter(alias: str, ph: Phrase) -> str:
    if ph.fields is None:
        return "TRUE"
    return f"{alias}.field IN ({', '.join(_lit(f) for f in ph.fields)})"


def leaf_sql(leaf) -> str:
    if isinstance(leaf, Near):
        raise NotImplementedError("near() has no SQL oracle")
    n = len(leaf.tokens)
    frm = ["tok t0"]
    conds = [_match("t0", leaf.tokens[0], leaf.prefix and n == 1), _field_filter("t0", leaf)]
    for k in range(1, n):
        frm.append(f"JOIN tok t{k} ON t{k}.paper_id = t0.paper_id AND t{k}.field = t0.field "
                   f"AND t{k}.pos = t0.pos + {k}")
        conds.append(_match(f"t{k}", leaf.tokens[k], leaf.prefix and k == n - 1))
    if leaf.initial:
        conds.append("t0.pos = 0")
    return (f"SELECT t0.paper_id, CAST(count(*) AS BIGINT) AS hits FROM {' '.join(frm)} "
            f"WHERE {' AND '.join(conds)} GROUP BY t0.paper_id")


def _bool(q, leaves) -> str:
    if isinstance(q, (Phrase, Near)):
        return f"(h{leaves.index(q)} > 0)"
    if isinstance(q, And):
        return "(" + " AND ".join(_bool(p, leaves) for p in q.parts) + ")"
    if isinstance(q, Or):
        return "(" + " OR ".join(_bool(p, leaves) for p in q.parts) + ")"
    if isinstance(q, Not):
        return f"({_bool(q.keep, leaves)} AND NOT {_bool(q.drop, leaves)})"
    raise TypeError(q)


def match_ctes(q) -> str:
    """CTEs l0..ln (leaf hits), cand (hit columns), m (matching ids + hits)."""
    leaves = _leaves(q)
    out = [f"l{i} AS ({leaf_sql(leaf)})" for i, leaf in enumerate(leaves)]
    ids = " UNION ".join(f"SELECT paper_id FROM l{i}" for i in range(len(leaves)))
    hs = ", ".join(f"coalesce(l{i}.hits, 0) AS h{i}" for i in range(len(leaves)))
    joins = " ".join(f"LEFT JOIN l{i} ON l{i}.paper_id = c.paper_id" for i in range(len(leaves)))
    out.append(f"cand AS (SELECT c.paper_id, {hs} FROM ({ids}) c {joins})")
    out.append(f"m AS (SELECT * FROM cand WHERE {_bool(q, leaves)})")
    return ",\n".join(out)


def bm25_cte(q, k1=BM25_K1, b=BM25_B) -> str:
    leaves = _leaves(q)
    terms = []
    for i in range(len(leaves)):
        idf = (f"(CASE WHEN ln(((SELECT count(*) FROM doclen) - (SELECT count(*) FROM l{i}) + 0.5)"
               f" / ((SELECT count(*) FROM l{i}) + 0.5)) <= 0 THEN {IDF_FLOOR} ELSE "
               f"ln(((SELECT count(*) FROM doclen) - (SELECT count(*) FROM l{i}) + 0.5)"
               f" / ((SELECT count(*) FROM l{i}) + 0.5)) END)")
        terms.append(f"{idf} * (m.h{i} * {k1 + 1}) / (m.h{i} + {k1} * ({1 - b} + {b} * dl.n_tokens"
                     f" / (SELECT avg(n_tokens) FROM doclen)))")
    return (f"ranked AS (SELECT m.paper_id, -({' + '.join(terms)}) AS rank "
            f"FROM m JOIN doclen dl ON dl.paper_id = m.paper_id)")


def search_sql(q, select: str, with_rank: bool = True) -> str:
    ctes = BASE_CTES + [match_ctes(q)] + ([bm25_cte(q)] if with_rank else [])
    return "WITH " + ",\n".join(ctes) + "\n" + select


def stemmed_ctes() -> list[str]:
    """The base CTEs with folded and stemmed terms in ``tok``."""
    raw = TOK_SQL.replace("tok AS (", "raw_tok AS (", 1)
    tok = "tok AS (SELECT r.paper_id, r.field, v.w AS term, r.pos FROM raw_tok r JOIN voc v ON v.term = r.term)"
    return [*BASE_CTES[:-1], raw, stem_ctes("raw_tok", "voc"), tok]


def stemmed_search_sql(q, select: str) -> str:
    q = normalize_query(q, True, True)
    return "WITH " + ",\n".join([*stemmed_ctes(), match_ctes(q), bm25_cte(q)]) + "\n" + select
