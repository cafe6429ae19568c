"""Quality rules by distribution divergence.

A document's histogram of character classes and of common words is compared with the reference of its language
by the Jensen-Shannon distance (base 2, square root, 0 to 1). The references are learned from all documents: for each
language, the mean over documents of their normalised histograms, held as integers so that the order of summing
cannot change a verdict (a word of a text of n words weighs 1 / n to within n / ``SCALE`` of itself). Common words are found among ``WORD_BINS`` hashed bins: the ``COMMON`` heaviest bins of a
language, all others together in one more.

Sizes: a language has a reference if it has at least ``LEAST`` documents with words, however large the rest of the corpus is, and a
reference is under a kilobyte; those of all languages are sent to the tasks. A document whose language has none, or is null,
is not judged by distance.

Guards: texts with fewer than ``min_chars`` characters or ``min_words`` words are not judged by distance.
Null or empty texts have no words and fail the base rule; repeated rows and ties each get their own, equal, verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec

WORD_BINS, COMMON, SCALE, LEAST = 4096, 64, 10**12, 20
#: Classes of characters by their first byte: lower, upper, digit, blank, line end, stop, symbol, other ASCII, beyond ASCII.
CLASSES = 9
_CLASS = np.full(256, 8, np.int64)
_CLASS[:128] = 7
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 3, 4
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 5
_CLASS[[ord(c) for c in "#*$%&|<>!?@^~=+_{}[]\\/`"]] = 6
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

FIELDS = T.StructType(
    [T.StructField(n, T.LongType(), False) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType(), False), T.StructField("kept", T.BooleanType(), False)]
    + [T.StructField(n, T.DoubleType(), True) for n in ("class_distance", "word_distance")]
)


def _histograms(buf, offs, starts, ends, rows) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character classes and of word bins for each text of a chunk."""
    n = len(offs) - 1
    doc = np.repeat(np.arange(n), np.diff(offs))
    lead = (buf & 0xC0) != 0x80
    classes = np.bincount(doc[lead] * CLASSES + _CLASS[buf[lead]], minlength=n * CLASSES).reshape(n, CLASSES)
    bins = (vec.word_hashes(buf, starts, ends) % np.uint64(WORD_BINS)).astype(np.int64)
    return classes, bins


def _learn(text: str, lang: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}
        held = 0

        def out():
            for name, v in sums.items():
                at = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(v[at])], ["lang", "bin", "mass"])
            sums.clear()

        for batch in batches:
            for part, buf, offs in vec.chunks(batch, text):
                starts, ends, rows = vec.words(buf, offs)
                classes, bins = _histograms(buf, offs, starts, ends, rows)
                n_words, names = vec.counts_by_row(rows, len(offs) - 1), part.column(lang).to_pylist()
                share = SCALE // np.maximum(n_words, 1)
                by_class = classes * (SCALE // np.maximum(classes.sum(1, keepdims=True), 1))
                for name in dict.fromkeys(names):
                    mine = np.array([x == name for x in names]) & (n_words > 0)
                    v = sums.setdefault(name, np.zeros(CLASSES + WORD_BINS + 1, np.int64))
                    of = mine[rows]
                    v[:CLASSES] += by_class[mine].sum(0)
                    np.add.at(v, CLASSES + bins[of], share[rows[of]])
                    v[-1] += int(mine.sum())
                # a sum of 64 bits holds SCALE for each of some million texts
                held += len(names)
                if len(sums) > 200 or held > 2_000_000:
                    yield from out()
                    held = 0
        yield from out()

    return run


class Reference:
    """The references of all languages, as arrays: under a kilobyte for each. ``top`` has the bins of common words, -1 where there are fewer."""

    def __init__(self, names: list[str], classes: np.ndarray, words: np.ndarray, top: np.ndarray):
        self.names, self.classes, self.words, self.top = names, classes, words, top

    def places(self, k: int) -> np.ndarray:
        """The place of each word bin among the common ones of a language."""
        out, top = np.full(WORD_BINS, COMMON, np.int64), self.top[k][self.top[k] >= 0]
        out[top] = np.arange(len(top))
        return out


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Reference:
    """References of the languages in ``docs``: one pass, at most 4106 sums for each task and language to the shuffle."""
    sums = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(_learn("text", "lang"), "lang string, bin long, mass long")
    sums = sums.where("lang is not null").groupBy("lang", "bin").agg(F.sum(F.col("mass").cast("decimal(19,0)")).alias("mass"))
    by_lang = sums.groupBy("lang").agg(
        F.max(F.when(F.col("bin") == CLASSES + WORD_BINS, F.col("mass"))).alias("n"),
        F.slice(F.sort_array(F.collect_list(F.when((F.col("bin") >= CLASSES) & (F.col("bin") < CLASSES + WORD_BINS), F.struct("mass", "bin"))), False), 1, COMMON).alias("top"),
        F.collect_list(F.when(F.col("bin") < CLASSES, F.struct("bin", "mass"))).alias("classes"),
    )
    found = by_lang.where(F.col("n") >= LEAST).orderBy("lang").collect()
    k = len(found)
    classes, words, top = np.zeros((k, CLASSES)), np.zeros((k, COMMON + 1)), np.full((k, COMMON), -1, np.int16)
    for i, r in enumerate(found):
        for b, m in r["classes"]:
            classes[i, b] = int(m) / (SCALE * int(r["n"]))
        for j, (m, b) in enumerate(r["top"]):
            words[i, j], top[i, j] = int(m) / (SCALE * int(r["n"])), b - CLASSES
        words[i, COMMON] = max(0.0, 1 - words[i].sum())
    return Reference([r["lang"] for r in found], classes, words, top)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` from ``q``; both are normalised here."""
    p, q = p / np.maximum(p.sum(-1, keepdims=True), 1e-12), q / np.maximum(q.sum(-1, keepdims=True), 1e-12)
    m = (p + q) / 2

    def kl(a):
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0.0).sum(-1)

    return np.sqrt(np.clip((kl(p) + kl(q)) / 2, 0, 1))


def _judge(text: str, lang: str, out: str, ref: Reference, limits: tuple[tuple[float, float], tuple[float, float]], min_chars: int, min_words: int):
    place = {name: i for i, name in enumerate(ref.names)}
    space = np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in vec.chunks(batch, text):
                n = len(offs) - 1
                starts, ends, rows = vec.words(buf, offs)
                classes, bins = _histograms(buf, offs, starts, ends, rows)
                n_words = vec.counts_by_row(rows, n)
                lead = (buf & 0xC0) != 0x80
                word_chars, symbols, chars = vec.per_row(lead & ~vec.IS_SPACE[buf], offs), vec.per_row(_SYMBOL[buf], offs), classes.sum(1)
                # words in triples that a text has twice or more
                tri, of = vec.shingles(vec.word_hashes(buf, starts, ends, fold=False), rows, n, 3)
                whole = n_words[of] >= 3
                key = vec.mix(tri[whole] ^ (of[whole].astype(np.uint64) + np.uint64(1)) * space)
                ordered = np.sort(key)
                twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
                begin = np.flatnonzero(rows[: max(len(rows) - 2, 0)] == rows[2:])
                if len(twice):
                    hit = begin[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
                    marked = np.zeros(len(rows), bool)
                    for j in range(3):
                        marked[hit + j] = True
                    repeats = vec.counts_by_row(rows[marked], n)
                else:
                    repeats = np.zeros(n, np.int64)
                raw, dup = buf.tobytes(), np.zeros(n, np.int64)
                for i in range(n):
                    lines = [x for x in raw[offs[i] : offs[i + 1]].split(b"\n") if x.strip()]
                    dup[i] = len(lines) - len(set(lines))
                failed = (n_words < 50) | (100 * repeats > 50 * n_words)
                far_c, far_w = np.full(n, np.inf), np.full(n, np.inf)
                names = part.column(lang).to_pylist()
                own = np.array([place.get(x, -1) for x in names])
                for k in np.unique(own[own >= 0]):
                    mine = np.flatnonzero(own == k)
                    at = np.full(n, -1)
                    at[mine] = np.arange(len(mine))
                    sel = at[rows] >= 0
                    hist = np.bincount(at[rows[sel]] * (COMMON + 1) + ref.places(k)[bins[sel]], minlength=len(mine) * (COMMON + 1)).reshape(len(mine), COMMON + 1)
                    far_c[mine], far_w[mine] = distance(classes[mine], ref.classes[k]), distance(hist, ref.words[k])
                judged = (chars >= min_chars) & (n_words >= min_words) & np.isfinite(far_c)
                noise = 1 / np.sqrt(np.maximum(n_words, 1))
                (c0, c1), (w0, w1) = limits
                bad = judged & ((far_c > c0 + c1 * noise) | (far_w > w0 + w1 * noise))
                values = [n_words, word_chars, symbols, dup, repeats, failed, ~failed & ~bad]
                arrays = [pa.array(v) for v in values] + [pa.array(v, mask=~np.isfinite(v)) for v in (far_c, far_w)]
                got = pa.StructArray.from_arrays(arrays, [f.name for f in FIELDS])
                yield pa.RecordBatch.from_arrays([*part.columns, got], [*part.schema.names, out])

    return run


def assess(docs: DataFrame, out: str = "assessment", text: str = "text", lang: str = "lang", class_limit: tuple[float, float] = (0.17, 1.0), word_limit: tuple[float, float] = (0.38, 0.6), min_chars: int = 200, min_words: int = 50, reference: Reference | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with a struct column ``out`` (see ``FIELDS``; a column of that name is replaced).

    ``kept`` is false for texts that fail the base rule (under 50 words, or over half of them in repeated triples) and
    for those farther from their language than either limit. One map over the rows; nothing is shuffled but the sums of ``learn``.
    """
    ref = reference or learn(docs, text, lang)
    docs = docs.drop(out) if out in docs.columns else docs
    schema = T.StructType([*docs.schema.fields, T.StructField(out, FIELDS, False)])
    if docs.schema[lang].dataType != T.StringType():
        raise TypeError(f"{lang} has to be a string column")
    return docs.mapInArrow(_judge(text, lang, out, ref, (class_limit, word_limit), min_chars, min_words), schema)
