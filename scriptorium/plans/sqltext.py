"""SQL (DuckDB / RE2) spellings of the text functions, for oracles."""

from __future__ import annotations

import re

from ..functions.text import (BASE_URL, CTRL, KEYWORD_RESPLIT, PAPER_PATH, REFERENCE_PREFIX,
                              WS_CLASS)


def re2(p: str) -> str:
    """Java-regex \\uXXXX escapes -> RE2 \\x{XXXX}; quote for SQL."""
    return re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", p).replace("'", "''")


WS = re2(WS_CLASS)


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse_sql(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def normalize_sql(x: str) -> str:
    return trim_sql(collapse_sql(f"replace(regexp_replace({x}, '{re2(CTRL)}', '', 'g'), '\"', '''')"))


def abstract_sql(x: str) -> str:
    return trim_sql(collapse_sql(f"replace(replace({x}, '\"', ''''), chr(10), ' ')"))


RESPLIT_SQL = re2(KEYWORD_RESPLIT)

PAPER_URL_SQL = "'" + BASE_URL + PAPER_PATH + "'"          # SQL literal: paper URL prefix
REFERENCE_SQL = "'" + REFERENCE_PREFIX + "'"               # SQL literal: reference prefix
