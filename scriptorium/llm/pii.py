"""Personal data: patterns propose spans, checksums confirm, context scores.

Every proposal has a kind, a span in code points and a score:

* base kinds ``email``, ``ip``, ``card``, ``phone`` follow fixed patterns and
  validators (parts at most 255, Luhn, digit counts).  They are kept whatever
  their score;
* added kinds ``iban`` (mod-97), ``ssn`` and ``local_phone`` (no country code)
  start from a prior, gain when a context word (a whole word, or its plural)
  stands within ``window`` code points and are kept from ``threshold`` on.  A bare digit pattern therefore
  needs its context; a checksum alone is enough for an IBAN.  An added span
  that overlaps a base span is dropped.

A null or empty text has no span.  Rows are independent: repeated rows, null
ids and extra columns pass through; a clashing input column is replaced.
Matching is linear in the text: patterns are entered at an ``@``, a ``+`` or
the start of a digit run, so a long run of word characters is not rescanned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "local_phone")
WINDOW = 40
THRESHOLD = 0.6

#: Prior score, and the words that raise it when they stand near.
PRIORS = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.8, "ssn": 0.35, "local_phone": 0.3}
CONTEXT = {
    "email": ("email", "mail", "contact", "write"),
    "ip": ("ip", "server", "host", "address"),
    "card": ("card", "visa", "credit", "payment", "carte", "tarjeta", "karte"),
    "phone": ("call", "phone", "telephone", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security"),
    "local_phone": ("call", "phone", "telephone", "tel", "mobile", "fax"),
}
GAIN = 0.35
_CONTEXT = {k: re.compile(rf"(?<![^\W_])(?:{'|'.join(map(re.escape, v))})s?(?![^\W_])", re.IGNORECASE) for k, v in CONTEXT.items()}

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_SEP = str.maketrans("", "", " -")
#: Characters of an IBAN by country; other countries' codes may have any length.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22,
                "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}


def luhn_ok(digits: str) -> bool:
    """The Luhn check over a digit string."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def iban_ok(code: str) -> bool:
    """mod-97 over the rearranged code, letters as 10..35."""
    s = code.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ibans(t: str) -> list[tuple[int, int]]:
    """Confirmed codes.  A proposal may reach into upper-case text after the code, so its shorter group ends are
    tried too: the country's length first, then the longest.  A rejected start does not hide later ones."""
    out, m = [], _IBAN.search(t)
    while m:
        code, s = m.group(), m.start()
        ends = [i for i in range(len(code), 14, -1) if i == len(code) or code[i] == " "]
        ends.sort(key=lambda i: i - code.count(" ", 0, i) != IBAN_LENGTHS.get(code[:2]))
        end = next((s + i for i in ends if iban_ok(code[:i])), None)
        if end:
            out.append((s, end))
        m = _IBAN.search(t, end or s + 1)
    return out


def _emails(t: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, t.find("@")
    while at >= 0:
        start = end + len(t[end:at].rstrip(_LOCAL_CHARS))
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        end = m.end() if m else at + 1      # no local part reaches over an @
        at = t.find("@", end)
    return out


def base_spans(t: str) -> list[tuple[int, int, str]]:
    """Base spans by start, then kind as listed."""
    out = []
    if "@" in t:
        out += [(s, e, 0) for s, e in _emails(t)]
    for m in _IP.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 14:
            d = m.group().translate(_SEP)
            if 14 <= len(d) <= 19 and luhn_ok(d):
                out.append((m.start(), m.end(), 2))
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((m.start(), m.end(), 3))
    return [(s, e, BASE_KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


def score(t: str, start: int, end: int, kind: str, window: int = WINDOW) -> float:
    """Prior plus gain when a context word of the kind stands near."""
    word = _CONTEXT[kind]
    # one character more on the far sides shows whether a word begins or ends there
    near = word.search(t[max(0, start - window - 1):start], 1 if start > window else 0)
    if not near:
        near = next((m for m in word.finditer(t[end:end + window + 1]) if m.end() <= window), None)
    return min(1.0, PRIORS[kind] + (GAIN if near else 0.0))


def added_spans(t: str, taken: list[tuple[int, int, str]], window: int = WINDOW,
                threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """Confirmed and well-scored spans of the added kinds that touch no base span."""
    found = [(s, e, "iban") for s, e in _ibans(t)]
    if "-" in t:
        found += [(m.start(), m.end(), "ssn") for m in _SSN.finditer(t)
                  if m.group()[:3] not in ("000", "666") and m.group()[0] != "9"
                  and m.group()[4:6] != "00" and m.group()[7:] != "0000"]
    found += [(m.start(), m.end(), "local_phone") for m in _LOCAL_PHONE.finditer(t)]
    if not found:
        return []
    out, base, i = [], taken, 0
    for s, e, k in sorted(found):
        while i < len(base) and base[i][1] <= s:
            i += 1
        if any(b[0] < e and b[1] > s for b in base[i:i + 4]) or (out and out[-1][1] > s):
            continue
        if score(t, s, e, k, window) >= threshold:
            out.append((s, e, k))
    return out


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def join_spans(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_pii(df: DataFrame, text_col: str = "text", window: int = WINDOW,
             threshold: float = THRESHOLD) -> DataFrame:
    """All columns plus ``pii`` (array of kind, start, end, score, by start),
    n_email, n_ip, n_card, n_phone, base_sha256 and spans (text forms)."""
    new = ["pii", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    df = df.drop(*[c for c in new if c in df.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = {k: i for i, k in enumerate(BASE_KINDS + ADDED_KINDS)}
        for rb in batches:
            pii, counts, digests, texts = [], {k: [] for k in BASE_KINDS}, [], []
            for v in rb.column(rb.schema.get_field_index(text_col)):
                t = v.as_py() or ""
                base = base_spans(t)
                both = sorted(base + added_spans(t, base, window, threshold), key=lambda x: (x[0], rank[x[2]]))
                pii.append([{"kind": k, "start": s, "end": e, "score": score(t, s, e, k, window)}
                            for s, e, k in both])
                for kind in BASE_KINDS:
                    counts[kind].append(sum(k == kind for _, _, k in base))
                digests.append(sha256(join_spans(base).encode()).hexdigest())
                texts.append(join_spans(both))
            arrays = [pa.array(pii, pa.list_(_ARROW_SPAN)), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS),
                      pa.array(digests, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*rb.columns, *arrays], names=[*rb.schema.names, *new])

    schema = T.StructType([*df.schema.fields, T.StructField("pii", T.ArrayType(SPAN)),
                           *[T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS],
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return df.mapInArrow(run, schema)
