"""Language identification with error-correcting output codes.

Every language gets a codeword of bits; one binary classifier per bit
separates the languages whose codeword has the bit from the others.  Features
are hashed byte trigrams of the case-folded text, ASCII non-letters made
blanks.  A bit's classifier is linear: the log ratio of the trigram's mean
smoothed frequency on its two sides, fitted from trigram counts per language
over ALL training rows (summed by Spark; languages x dims numbers reach the
driver).  A second pass counts how often each bit is right on the training
rows.  Decoding sums, per codeword, the logistic losses of the bit margins,
each weighted by its bit's log odds of being right, and takes the codeword of
least loss; the score is that codeword's share of exp(-loss), and a text whose
two best codewords are closer than ``margin`` is flagged ambiguous.

Inputs out of the ordinary: null text or text without a letter is ``und``,
score 0; without any learned language every text is ``und``; null labels are
not learned from; ties go to the language first in code point order; rows are
independent, so repeated rows, null ids and extra columns don't matter;
clashing input columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

DIMS = 1 << 14
MAX_LANGUAGES = 2048            # codewords x dims must fit the tasks; more is an error, not a cut
SMOOTH = 0.5
SHARPNESS = 8.0
MARGIN = 0.25
UNDETERMINED = "und"
NEW = ("lang_pred", "score", "ambiguous", "bits")

_NORM = np.full(256, 32, np.uint8)
_NORM[128:] = np.arange(128, 256)
_NORM[97:123] = np.arange(97, 123)
_NORM[65:91] = np.arange(97, 123)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def code_book(n: int) -> np.ndarray:
    """(n, bits) of 0/1.  Up to 7 codewords: all splits of the languages into
    two sides.  Beyond: rows of a Sylvester-Hadamard matrix without its
    constant column, any two of which differ in half of the places."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        splits = np.arange(1, 1 << (n - 1))
        rest = (splits[None, :] >> np.arange(n - 1)[:, None]) & 1
        return np.concatenate((np.zeros((1, len(splits)), np.int64), rest)).astype(np.int8)
    h = np.ones((1, 1), np.int8)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return (h[:n, 1:] < 0).astype(np.int8)


def trigrams(b: np.ndarray, offs: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text number) of each byte trigram with at most one blank; a
    text counts as having a blank on both sides."""
    n = len(offs) - 1
    lens = np.diff(offs)
    of = np.repeat(np.arange(n), lens)
    padded = np.full(len(b) + 2 * n, 32, np.uint8)
    padded[np.arange(len(b)) + 2 * of + 1] = _NORM[b]
    if len(padded) < 3:
        z = np.zeros(0, np.int64)
        return z, z
    doc = np.repeat(np.arange(n), lens + 2)
    x, y, z = padded[:-2], padded[1:-1], padded[2:]
    blank = (x == 32).astype(np.int8) + (y == 32) + (z == 32)
    ok = np.flatnonzero((blank <= 1) & (doc[:-2] == doc[2:]))
    key = (x[ok].astype(np.uint32) << 16) | (y[ok].astype(np.uint32) << 8) | z[ok]
    feature = (key * np.uint32(2654435761)) >> np.uint32(32 - (dims.bit_length() - 1))
    return feature.astype(np.int64), doc[ok]


def has_letter(b: np.ndarray, offs: np.ndarray) -> np.ndarray:
    seen = np.concatenate(([0], np.cumsum(_ASCII_LETTER[b])))
    out = seen[offs[1:]] > seen[offs[:-1]]
    wide = np.concatenate(([0], np.cumsum(b >= 128)))
    for i in np.flatnonzero(~out & (wide[offs[1:]] > wide[offs[:-1]])):
        out[i] = any(c.isalpha() for c in b[offs[i]:offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray            # (languages, bits) 0/1
    weights: np.ndarray         # (bits, dims) float32
    trust: np.ndarray           # (bits,) weight of a bit's loss

    def margins(self, b: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(texts, bits): mean weight of the text's trigrams."""
        feature, doc = trigrams(b, offs, self.weights.shape[1])
        n = np.bincount(doc, minlength=len(offs) - 1)
        out = np.zeros((len(offs) - 1, len(self.weights)))
        full = np.flatnonzero(n)
        if len(full):
            firsts = np.searchsorted(doc, full)
            for k, w in enumerate(self.weights):
                out[full, k] = np.add.reduceat(w[feature], firsts, dtype=np.float64) / n[full]
        return out

    def losses(self, m: np.ndarray) -> np.ndarray:
        """(texts, languages): trust-weighted logistic loss per codeword."""
        right = np.logaddexp(0, -SHARPNESS * m) * self.trust
        wrong = np.logaddexp(0, SHARPNESS * m) * self.trust
        return right @ self.code.T.astype(float) + wrong @ (1 - self.code.T.astype(float))


def _language_counts(train: DataFrame, text_col: str, lang_col: str, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for rb in batches:
            langs = rb.column(1).to_pylist()
            for i, j, b, offs in text_slices(rb.column(0)):
                own = np.array(langs[i:j], object)
                feature, doc = trigrams(b, offs, dims)
                for lang in set(langs[i:j]):
                    mine = (own == lang)[doc]
                    sums[lang] = sums.get(lang, 0) + np.bincount(feature[mine], minlength=dims)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "f": at.astype(np.int32), "n": s[at]},
                                             schema=pa.schema([("lang", pa.string()), ("f", pa.int32()), ("n", pa.int64())]))

    return (train.select(F.col(text_col), F.col(lang_col)).mapInArrow(run, "lang string, f int, n long")
            .groupBy("lang", "f").agg(F.sum("n").alias("n")))


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = DIMS) -> Model:
    """Fit on all rows of ``train`` with text and label."""
    train = train.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = _language_counts(train, text_col, lang_col, dims).toPandas()
    languages = sorted(set(rows["lang"]), key=lambda s: s.encode())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages, at most {MAX_LANGUAGES}")
    code = code_book(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((1, dims), np.float32), np.ones(1))
    counts = np.zeros((len(languages), dims))
    counts[rows["lang"].map({x: i for i, x in enumerate(languages)}), rows["f"]] = rows["n"]
    freq = (counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * dims)
    on = code.T.astype(float)
    weights = np.log(on @ freq / on.sum(1, keepdims=True)) - np.log((1 - on) @ freq / (1 - on).sum(1, keepdims=True))
    model = Model(languages, code, weights.astype(np.float32), np.ones(code.shape[1]))
    right, n = _bit_accuracy(train, model, text_col, lang_col)
    share = (right + 1) / (n + 2)
    model.trust = np.clip(np.log(share / (1 - share)), 0.05, None)
    model.trust /= model.trust.mean()
    return model


def _bit_accuracy(train: DataFrame, model: Model, text_col: str, lang_col: str) -> tuple[np.ndarray, int]:
    shared = train.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, right, n = shared.value, 0, 0
        place = {x: i for i, x in enumerate(m.languages)}
        for rb in batches:
            own = np.array([place[x] for x in rb.column(1).to_pylist()], np.int64)
            for i, j, b, offs in text_slices(rb.column(0)):
                right = right + ((m.margins(b, offs) > 0) == (m.code[own[i:j]] > 0)).sum(0)
                n += j - i
        if n:
            yield pa.RecordBatch.from_pydict({"bit": np.arange(len(right), dtype=np.int32), "ok": right, "n": np.full(len(right), n)},
                                             schema=pa.schema([("bit", pa.int32()), ("ok", pa.int64()), ("n", pa.int64())]))

    got = (train.select(F.col(text_col), F.col(lang_col)).mapInArrow(run, "bit int, ok long, n long")
           .groupBy("bit").agg(F.sum("ok").alias("ok"), F.sum("n").alias("n")).orderBy("bit").collect())
    return np.array([r["ok"] for r in got], float), got[0]["n"] if got else 0


def predict(docs: DataFrame, model: Model, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """All columns plus lang_pred, score (0 to 1), ambiguous, and the bits as 0/1 text."""
    docs = docs.drop(*[c for c in NEW if c in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rb in batches:
            col = rb.column(rb.schema.get_field_index(text_col))
            langs, scores, unsure, bits = [], [], [], []
            for _, _, b, offs in text_slices(col):
                known = has_letter(b, offs) & (len(m.languages) > 0)
                if not m.languages:
                    k = len(known)
                    langs, scores = langs + [UNDETERMINED] * k, scores + [0.0] * k
                    unsure, bits = unsure + [True] * k, bits + [""] * k
                    continue
                got = m.margins(b, offs)
                loss = m.losses(got)
                best = loss.argmin(1)
                e = np.exp(loss.min(1, keepdims=True) - loss)
                p = 1.0 / e.sum(1)
                two = np.sort(loss, 1)[:, :2]
                near = (two[:, 1] - two[:, 0] < margin) if loss.shape[1] > 1 else np.zeros(len(loss), bool)
                for i in range(len(known)):
                    langs.append(m.languages[best[i]] if known[i] else UNDETERMINED)
                    scores.append(float(p[i]) if known[i] else 0.0)
                    unsure.append(bool(near[i] or not known[i]))
                    bits.append("".join("1" if x > 0 else "0" for x in got[i]) if known[i] else "")
            yield pa.RecordBatch.from_arrays(
                [*rb.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(unsure, pa.bool_()), pa.array(bits, pa.string())], names=[*rb.schema.names, *NEW])

    return docs.mapInArrow(run, T.StructType([
        *docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("ambiguous", T.BooleanType()), T.StructField("bits", T.StringType())]))


def rejected() -> Column:
    """Documents without an identified language."""
    return F.col("lang_pred") == UNDETERMINED
