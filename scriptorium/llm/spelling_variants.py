"""Groups of spelling variants: words one edit apart, each led to the most
frequent spelling near it.

1. Words.  Maximal runs of letters `[A-Za-z\\u00C0-\\u00FF]+`, A-Z lower-cased,
   are counted in each batch of documents and the counts summed.
2. Blocks.  A word is a vector of letter counts.  Letters fall into a few
   groups; a block holds the words of one length and one count per group.
   One edit changes the length by at most one and moves at most one letter
   between groups, so a block meets only blocks of the same length with one
   letter moved, or of the next length with one letter more.  The number of
   groups follows from the vocabulary, so that blocks stay near ``BLOCK``
   words; larger blocks are cut into even parts that meet one another.
3. Gram product.  For two blocks, NumPy multiplies the letter counts; the
   squared distances |a|^2 + |b|^2 - 2ab that are at most two are kept: one
   edit makes exactly 2 (a letter replaced) or 1 (a letter more).
4. Those pairs are verified on the letters themselves.
5. Of a word's near words the most frequent one (ties: the first in code-point
   order) is its form if it is at least ``RATIO`` times as frequent; roots are
   found by doubling the steps along forms, and as counts at least double at
   every step there are few.

Inputs out of the ordinary: a null or empty text has no words; rows that
repeat an id are documents of their own; without words the result is empty;
texts and words may be of any length (long words make smaller blocks, and
products beyond float32 use float64); extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize

MIN_CHARS = 5
MIN_TIMES = 3
RATIO = 2
BLOCK = 1024                # words of a block, about
BLOCK_CHARS = 1 << 18       # characters of a block
HELD_WORDS = 100_000        # distinct words a task counts before it sends them on
SLICE = 1 << 20             # characters of a text read at once
ALPHABET = 90               # a-z and U+00C0..U+00FF
EXACT32 = 1 << 24           # whole numbers up to here are exact in float32

_RUN = re.compile(rb"(?:[a-z]|\xC3[\x80-\xBF])+")             # UTF-8; A-Z are lower-cased before
_NOT_LETTER = re.compile(rb"[^a-z\x80-\xFF]")
_LOWERED = bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
_PAIRS = "word string, n long, near string, near_n long"

#: Given a document's id, None or a function from its lower-cased runs (UTF-8) to the spellings to count.
Respell = Callable[[object], Callable[[bytes], bytes] | None]


def _slices(text: bytes) -> Iterator[bytes]:
    """A text in pieces that end between runs of letters."""
    i = 0
    while i < len(text):
        gap = _NOT_LETTER.search(text, i + SLICE) if len(text) - i > SLICE else None
        j = gap.start() if gap else len(text)
        yield text[i:j] if i or j < len(text) else text
        i = j


def _counted(respell: Respell | None, min_chars: int):
    """Word counts of the documents of a task, a few rows per distinct word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out():
            words = [(w.decode(), n) for w, n in held.items() if len(w) >= min_chars]
            words = [x for x in words if len(x[0]) >= min_chars]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())],
                                              names=["word", "n"])

        for rb in batches:
            for doc, text in zip(rb.column(0).to_pylist(), rb.column(1)):
                own: Counter[bytes] = Counter()
                for piece in _slices((text.as_py() or b"").translate(_LOWERED)):
                    own.update(_RUN.findall(piece))
                change = respell(doc) if respell else None
                if change:
                    for w, n in own.items():
                        held[change(w)] += n
                else:
                    held.update(own)
                if len(held) > HELD_WORDS:
                    yield out()
        if held:
            yield out()
    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                respell: Respell | None = None, min_chars: int = MIN_CHARS,
                min_times: int = MIN_TIMES) -> DataFrame:
    """(word, n) of the words with at least ``min_chars`` characters and ``min_times`` occurrences."""
    runs = docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(_counted(respell, min_chars), "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_times)


def group_count(n_words: int) -> int:
    """How many groups of letters keep blocks near BLOCK words, judged by words of eight letters."""
    g = 2
    while n_words > BLOCK * comb(7 + g, g - 1) and g < 32:
        g += 1
    return g


def letters(words: list[str], length: int) -> np.ndarray:
    """Code points, a row per word of ``length`` characters."""
    return np.array(words, dtype=f"U{length}").view(np.int32).reshape(len(words), length)


def letter_counts(points: np.ndarray) -> np.ndarray:
    at = np.where(points < 0xC0, points - ord("a"), points - 0xC0 + 26)
    row = np.arange(len(points))[:, None] * ALPHABET
    counts = np.bincount((row + at).reshape(-1), minlength=len(points) * ALPHABET).reshape(len(points), ALPHABET)
    return counts.astype(np.float32 if points.shape[1] ** 2 < EXACT32 else np.float64)


def near_pairs(a: list[str], b: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the words of two lists that are one edit apart; the words of a list have one length, b's is the same
    or one more.  Without b: the pairs i < j within a."""
    n = len(a[0])
    m = n if b is None else len(b[0])
    pa_ = letters(a, n)
    pb = pa_ if b is None else letters(b, m)
    ca = letter_counts(pa_)
    cb = ca if b is None else letter_counts(pb)
    if ca.dtype != cb.dtype:
        ca, cb = ca.astype(np.float64), cb.astype(np.float64)
    gram = ca @ cb.T
    far = (ca * ca).sum(axis=1)[:, None] + (cb * cb).sum(axis=1)[None, :] - 2 * gram
    i, j = np.nonzero(far <= 2)
    if b is None:
        i, j = i[i < j], j[i < j]
    good = np.zeros(len(i), bool)
    step = max(1, (1 << 20) // m)
    for k in range(0, len(i), step):
        x, y = pa_[i[k:k + step]], pb[j[k:k + step]]
        if n == m:
            good[k:k + step] = (x != y).sum(axis=1) == 1
        else:       # equal before and, one place later, after the letter more
            head = np.logical_and.accumulate(x == y[:, :n], axis=1).sum(axis=1)
            tail = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            good[k:k + step] = head + tail >= n
    return i[good], j[good]


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        cols: list[list] = [[], [], [], []]
        for key, part, words, n, key2, part2, words2, n2 in zip(*rb.columns):
            same = key.as_py() == key2.as_py() and part.as_py() == part2.as_py()
            a, na = words.as_py().split("\n"), n.values.to_numpy()
            b, nb = (a, na) if same else (words2.as_py().split("\n"), n2.values.to_numpy())
            i, j = near_pairs(a, None if same else b)
            if len(i):
                wa, wb = np.array(a, object), np.array(b, object)
                for c, v in zip(cols, ((wa[i], wb[j]), (na[i], nb[j]), (wb[j], wa[i]), (nb[j], na[i]))):
                    c += v
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, object if t == pa.string() else np.int64), *c]), t)
                                          for c, t in zip(cols, (pa.string(), pa.int64()) * 2)], names=["word", "n", "near", "near_n"])


def _key(size, sums: Column) -> Column:
    return F.concat_ws(",", F.col(size) if isinstance(size, str) else size, sums.cast("array<string>"))


def _meets(groups: int) -> Column:
    """The keys of the blocks that a block meets, each two blocks once: itself, the next length with a letter more in
    a group, and the same length with a letter moved from a later group to an earlier one."""
    def changed(by: dict[int, int]) -> Column:
        return F.array(*[F.col("sums")[i] + by.get(i, 0) for i in range(groups)])

    more = [_key(F.col("size") + 1, changed({i: 1})) for i in range(groups)]
    moved = [F.when(F.col("sums")[j] > 0, _key("size", changed({i: 1, j: -1}))) for j in range(groups) for i in range(j)]
    return F.array_compact(F.array(_key("size", F.col("sums")), *more, *moved))


def near_words(counts: DataFrame) -> DataFrame:
    """(word, n, near, near_n): both directions of every two words one edit apart; ``counts`` is a written table."""
    groups = group_count(counts.count())
    points = F.transform(F.filter(F.split("word", ""), lambda c: c != ""), lambda c: F.pmod(F.ascii(c), F.lit(groups)))
    sums = [F.size(F.filter("g", lambda x: x == i)) for i in range(groups)]
    sized = counts.withColumn("g", points).select("word", "n", F.length("word").alias("size"), F.array(*sums).alias("sums"))
    shape = ["size", "sums"]
    per = sized.groupBy(*shape).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_CHARS)).alias("parts"))
    placed = sized.join(per, shape).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")))
    blocks = placed.groupBy(*shape, "part").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("x"))
    blocks = materialize(blocks.select(_key("size", F.col("sums")).alias("key"), "part", F.array_join("x.word", "\n").alias("words"),
                                       F.col("x.n").alias("n"), _meets(groups).alias("meets")), "word-blocks")
    left = blocks.select("key", "part", "words", "n", F.explode("meets").alias("key2"))
    right = blocks.select(F.col("key").alias("key2"), F.col("part").alias("part2"), F.col("words").alias("words2"), F.col("n").alias("n2"))
    pairs = left.join(right, "key2").filter("key <> key2 or part <= part2")
    return pairs.select("key", "part", "words", "n", "key2", "part2", "words2", "n2").mapInArrow(_products, _PAIRS)


def spelling_forms(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of every row of ``counts`` (word, n)."""
    counts = materialize(counts, "word-counts")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near_words(counts).groupBy("word").agg(F.count("*").alias("n_near"), best)
    is_form = -F.col("best.less") >= ratio * F.col("n")
    forms = materialize(counts.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    # doubling: ``up`` is the word that 1, 2, 4 ... steps lead to; words that have reached their root wait
    up = forms.filter("form is not null").select("word", F.col("form").alias("up"))
    has_form = up.select(F.col("word").alias("up"), F.lit(False).alias("at_root"))
    steps = materialize(up.join(has_form, "up", "left").select("word", "up", F.coalesce("at_root", F.lit(True)).alias("at_root")), "steps")
    while not (active := steps.filter(~F.col("at_root"))).isEmpty():
        onward = steps.select(F.col("word").alias("up"), F.col("up").alias("next"), F.col("at_root").alias("ended"))
        moved = active.join(onward, "up").select("word", F.col("next").alias("up"), F.col("ended").alias("at_root"))
        steps = materialize(moved.unionByName(steps.filter("at_root")), "steps")
    return forms.join(steps.select("word", F.col("up").alias("root")), "word", "left").withColumn("root", F.coalesce("root", "word"))
