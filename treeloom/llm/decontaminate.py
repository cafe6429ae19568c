"""Benchmark decontamination by latent semantic retrieval.

1. Word weights are inverse frequencies over all documents (hashed to ``2**BITS`` bins, summed per task).
2. The benchmark's passages as a TF-IDF matrix A get a randomised SVD, computed over the partitions: with a random matrix W the
   sketch Y = A W is made orthonormal by the eigenvectors of Y'Y (a sum of small squares), B = Q'A is summed by word, and the
   eigenvectors of BB' turn it into the latent axes.
3. Documents are scanned for candidates. A passage of a text is one if its latent cosine with an item is ``min_cosine`` or more. An index says which passages
   are worth projecting: a paraphrase that could pass the checks below holds enough of the item's rarest words close together, and this bound leaves
   none out. Passages of the item's length are projected, a quarter of it apart, and the best one counts.
4. A candidate is a hit if the longest common subsequence of words covers ``min_lcs`` of the item and the answer (the item's last
   quarter, or its own column) is covered by half. Runs of ``verbatim`` words (of all words of a shorter item) are looked up exactly, and are
   hits whatever their cosine.

The benchmark is taken in scans of about ``BLOCK`` items and ``BLOCK_BYTES`` bytes; what goes to the tasks for a scan is bounded by that.
A scan's items lie in latent blocks of about ``rank`` items, and a block has as many axes as items: no part of an item is left out.
Documents never move; hits are rows (document, item). Words are letters and digits, A-Z folded. Null or empty texts and items have no
words and no hits; repeated rows each have theirs; an empty benchmark gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import keep, text_of

BITS, WINDOW, REGION = 17, 12, 160
BLOCK, BLOCK_BYTES, SLICE = 2000, 4 << 20, 64


def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = vec.words(buf, offs, vec.IS_BREAK)
    return vec.word_hashes(buf, starts, ends), rows


def _bin(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for _, buf, offs in vec.chunks(batch, "text"):
            total += np.bincount(_bin(_tokens(buf, offs)[0]), minlength=1 << BITS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bin", "n"])


def weights(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Inverse frequency of each word bin over all texts; at most ``2**BITS`` numbers come to the driver."""
    got = docs.select(F.col(text).alias("text")).mapInArrow(_frequencies, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(1 << BITS)
    n[got.column("bin").to_numpy()] = got.column("n").to_numpy()
    return np.log((n.sum() + 2) / (n + 1)).astype(np.float64)


def _rows(batch: pa.RecordBatch, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word bins and normalised TF-IDF of each passage."""
    for _, buf, offs in vec.chunks(batch, "text"):
        h, rows = _tokens(buf, offs)
        at = np.searchsorted(rows, np.arange(len(offs)))
        for a, b in zip(at[:-1], at[1:], strict=True):
            bins, times = np.unique(_bin(h[a:b]), return_counts=True)
            v = times * idf[bins]
            yield bins, v / max(np.sqrt((v**2).sum()), 1e-12)


def _omega(bins: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Rows of the random matrix, made from their number so that every task has the same."""
    x = vec.mix(bins[:, None].astype(np.uint64) * np.uint64(width + 1) + np.arange(1, width + 1, dtype=np.uint64)[None, :] + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
    return np.where(x >> np.uint64(63), 1.0, -1.0)


def _square(width: int, of):
    """Sum over a partition of v v' for the vectors that ``of`` makes of a batch, as rows (i, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for v in of(batch):
                total += np.outer(v, v)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    return run


def _summed(parts: DataFrame, width: int) -> np.ndarray:
    out = np.zeros((width, width))
    for r in parts.select("i", F.posexplode("v").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        out[r["i"], r["j"]] = r["x"]
    return out


def randomised_svd(passages: DataFrame, idf: np.ndarray, rank: int, extra: int = 8, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Word bins and their latent coordinates (bins x rank) from a table with a column ``text``."""
    width = rank + extra
    fixed = seed

    def sketch(batch):
        return (v @ _omega(b, width, fixed) for b, v in _rows(batch, idf))

    gram = _summed(passages.mapInArrow(_square(width, sketch), "i int, v array<double>"), width)
    values, vectors = np.linalg.eigh(gram)
    good = values > 1e-9 * max(values.max(), 1e-12)
    whiten = vectors[:, good] / np.sqrt(values[good])
    size = whiten.shape[1]

    def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, v in _rows(batch, idf):
                q = (v @ _omega(b, width, fixed)) @ whiten
                for x, y in zip(b.tolist(), v.tolist(), strict=True):
                    total[x] = total.get(x, 0) + y * q
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([list(v) for v in total.values()], pa.list_(pa.float64()))], ["bin", "v"])

    b = passages.mapInArrow(by_word, "bin long, v array<double>").groupBy("bin").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(size)])
    got = b.toArrow()
    bins = got.column("bin").to_numpy()
    matrix = np.stack([got.column(f"v{i}").to_numpy() for i in range(size)], 1) if size else np.zeros((len(bins), 0))
    order = np.argsort(bins)
    bins, matrix = bins[order], matrix[order]
    left, singular, _ = np.linalg.svd(matrix.T @ matrix) if size else (np.zeros((0, 0)), np.zeros(0), None)
    top = singular[:rank] > 1e-9 * max(singular.max(initial=0), 1e-12)
    return bins, matrix @ left[:, :rank][:, top] / np.sqrt(singular[:rank][top])


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by words of bits."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        m = masks.get(x, 0)
        u = row & m
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest run of words that both have."""
    same = a[:, None] == b[None, :]
    best, run = 0, np.zeros(len(b) + 1, np.int64)
    for row in same:
        run[1:] = np.where(row, run[:-1] + 1, 0)
        best = max(best, int(run.max()))
    return best


class Index:
    """One latent block of items, the first at ``start`` of all, and what is needed to project a region."""

    def __init__(self, start: int, words: list[np.ndarray], idf: np.ndarray, bins: np.ndarray, axes: np.ndarray):
        self.start, self.idf, self.bins, self.axes = start, idf.astype(np.float32), bins, axes.astype(np.float32)
        rows = [self.project(w) for w in words]
        self.items = np.stack(rows) if rows else np.zeros((0, axes.shape[1]), np.float32)

    def project(self, words: np.ndarray) -> np.ndarray:
        """Latent coordinates of length 1: with as many axes as items an item's own are all of its vector, and words of no item do not count."""
        b, times = np.unique(_bin(words), return_counts=True)
        v = times * self.idf[b]
        at = np.minimum(np.searchsorted(self.bins, b), len(self.bins) - 1)
        known = self.bins[at] == b
        x = v[known] @ self.axes[at[known]]
        return (x / max(np.sqrt((x**2).sum()), 1e-12)).astype(np.float32)


    def nearest(self, item: int, words: np.ndarray, size: int) -> float:
        """Largest cosine of an item of the block with a passage of ``size`` words."""
        b = _bin(words)
        at = np.minimum(np.searchsorted(self.bins, b), len(self.bins) - 1)
        each = np.where((self.bins[at] == b)[:, None], self.axes[at] * self.idf[b][:, None], 0)
        sums = np.zeros((len(b) + 1, each.shape[1]))
        np.cumsum(each, 0, out=sums[1:])
        first = np.unique(np.append(np.arange(0, max(1, len(b) - size + 1), max(1, size // 4)), max(0, len(b) - size)))
        x = sums[np.minimum(first + size, len(b))] - sums[first]
        return float((x @ self.items[item] / np.maximum(np.sqrt((x**2).sum(1)), 1e-12)).max())


class Runs:
    """Every run of ``verbatim`` words of the items (of all words of a shorter item), to be looked up in texts."""

    def __init__(self, words: list[np.ndarray], verbatim: int):
        by_width: dict[int, tuple[list, list]] = {}
        for i, w in enumerate(words):
            keys, items = by_width.setdefault(min(verbatim, len(w)), ([], []))
            key = np.unique(self.hashes(w, min(verbatim, len(w))))
            keys.append(key)
            items.append(np.full(len(key), i))
        self.tables = {}
        for width, (keys, items) in by_width.items():
            key, item = np.concatenate(keys), np.concatenate(items)
            order = np.argsort(key, kind="stable")
            self.tables[width] = key[order], item[order]

    @staticmethod
    def hashes(h: np.ndarray, width: int) -> np.ndarray:
        acc = np.zeros(max(len(h) - width + 1, 0), np.uint64)
        for j in range(width):
            acc = acc * vec.U(0xC2B2AE3D27D4EB4F) + h[j : j + len(acc)]
        return vec.mix(acc)

    def find(self, h: np.ndarray, rows: np.ndarray, known: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(position, item, width) of every run; ``known`` marks words that some item has."""
        sums = np.append(0, np.cumsum(known))
        for width, (keys, items) in self.tables.items():
            if len(h) < width:
                continue
            at = np.flatnonzero((sums[width:] - sums[:-width] == width) & (rows[: len(h) - width + 1] == rows[width - 1 :]))
            got = self.hashes(h, width)[at]
            left, right = np.searchsorted(keys, got), np.searchsorted(keys, got, "right")
            for k in np.flatnonzero(right > left).tolist():
                for j in range(left[k], right[k]):
                    yield int(at[k]), int(items[j]), width


class Signatures:
    """Which items may be paraphrased where: a bound that no window within an item's reach with enough of its words fails.

    Of an item's L words, ``need`` have to be matched, so of its ``L - need + k`` rarest at least k. k is the least with which chance seldom
    does that. Items are taken ``SLICE`` at a time, which bounds the pairs (word of a text, item) held at once.
    """

    def __init__(self, numbers: list[np.ndarray], needs: list[int], reaches: list[int], idf: np.ndarray, vocabulary: np.ndarray):
        self.reaches, self.least, self.slices = np.array(reaches), np.ones(len(numbers), np.int64), []
        rate = np.exp(-idf[_bin(vocabulary)])
        for start in range(0, len(numbers), SLICE):
            word, item = [], []
            for i in range(start, min(start + SLICE, len(numbers))):
                x, need = numbers[i], needs[i]
                x = x[np.argsort(rate[x], kind="stable")]
                first = np.append(True, x[1:] != x[:-1])  # a word that the item repeats is met once
                k = np.arange(1, need + 1)
                mean = np.cumsum(np.where(first, rate[x], 0))[len(x) - need :] * reaches[i]
                chance = np.where(k > mean, np.exp(k - mean - k * np.log(k / np.maximum(mean, 1e-12))), 1.0)
                self.least[i] = k[np.argmax(chance < 1e-6)] if (chance < 1e-6).any() else k[np.argmin(chance)]
                own = np.unique(x[: len(x) - need + self.least[i]])
                word.append(own)
                item.append(np.full(len(own), i))
            words, items = np.concatenate(word), np.concatenate(item)
            order = np.argsort(words, kind="stable")
            self.slices.append((np.searchsorted(words[order], np.arange(len(vocabulary) + 1)), items[order]))

    def find(self, rows: np.ndarray, number: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first, last) of ranges of words; a window with enough of the item lies within reach of one."""
        at = np.flatnonzero(number >= 0)
        for begin, items in self.slices:
            count = (begin[1:] - begin[:-1])[number[at]]
            pos = np.repeat(at, count)
            if not len(pos):
                continue
            # the place of each pair in ``items``: its word's begin and how many of that word's come before
            item = items[np.repeat(begin[number[at]] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(len(pos))]
            order = np.argsort((item - items.min()).astype(np.uint8), kind="stable")
            pos, item = pos[order], item[order]
            end = np.arange(len(pos)) + self.least[item] - 1
            ok = end < len(pos)
            end = np.minimum(end, len(pos) - 1)
            hit = np.flatnonzero(ok & (item[end] == item) & (rows[pos[end]] == rows[pos]) & (pos[end] - pos < self.reaches[item]))
            if not len(hit):
                continue
            p, q, i = pos[hit], pos[end[hit]], item[hit]
            new = np.append(True, (i[1:] != i[:-1]) | (rows[p[1:]] != rows[p[:-1]]) | (p[1:] - p[:-1] > self.reaches[i[1:]]))
            for a, b in zip(np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(p)) - 1, strict=True):
                yield int(i[a]), int(p[a]), int(q[b])


class Items:
    """All items of a scan: words, answers, runs and latent blocks."""

    def __init__(self, ids: list, words: list[np.ndarray], answers: list[np.ndarray], blocks: list[Index], verbatim: int, min_lcs: float):
        self.ids, self.words, self.answers, self.blocks, self.runs = ids, words, answers, blocks, Runs(words, verbatim)
        self.vocabulary = np.unique(np.concatenate(words))
        self.numbers = [np.searchsorted(self.vocabulary, w) for w in words]
        needs = [min(len(w), max(1, int(np.ceil(min_lcs * len(w) - 1e-9)))) for w in words]
        self.signatures = Signatures(self.numbers, needs, [self.reach(i) for i in range(len(words))], blocks[0].idf, self.vocabulary)

    def reach(self, item: int) -> int:
        """How many words of a text an item's copy may take: twice its own, and ``REGION + 2 * WINDOW`` at least."""
        return max(REGION + 2 * WINDOW, 2 * len(self.words[item]))

    def cosine(self, item: int, words: np.ndarray) -> float:
        """Latent cosine of the item with the best passage of its length among ``words``."""
        block = next(x for x in reversed(self.blocks) if x.start <= item)
        return block.nearest(item - block.start, words, len(self.words[item]))

    def judge(self, item: int, h: np.ndarray, number: np.ndarray, lo: int, hi: int, min_lcs: float, min_cosine: float, sure: bool) -> tuple[float, float, int] | None:
        """Cosine, LCS share and longest run of the best window of words ``lo`` to ``hi``, if one is a hit or ``sure``.

        Windows hold ``reach`` words and one begins at every word of the item: no other could hold more of it.
        """
        words, answer, best = self.words[item], self.answers[item], None
        if not sure:
            # the longest common subsequence has no more words than are there at all
            present = np.zeros(len(self.vocabulary) + 1, bool)
            present[number[lo:hi]] = True
            there = present[self.numbers[item]].sum() / len(words)
            # both have to hold, and the common subsequence of so few words is told faster than the cosine
            if there < min_lcs or common_subsequence(words, h[lo:hi]) / len(words) < min_lcs or self.cosine(item, h[lo:hi]) < min_cosine:
                return None
        present = np.zeros(len(self.vocabulary) + 1, bool)
        present[self.numbers[item]] = True
        own = lo + np.flatnonzero(present[number[lo:hi]])
        size = self.reach(item)
        held = np.searchsorted(own, own + size) - np.arange(len(own))
        for s in own[held >= (1 if sure else min_lcs * len(words))].tolist():
            window = h[s : min(s + size, hi)]
            if best is not None and best[0] == 1:
                break
            share = common_subsequence(words, window) / len(words)
            if (best is None or share > best[0]) and (sure or (share >= min_lcs and common_subsequence(answer, window) / max(len(answer), 1) >= 0.5)):
                best = share, window
        return best and (self.cosine(item, best[1]), best[0], longest_run(words, best[1]))


def _scan(items: Items, min_lcs: float, min_cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in vec.chunks(batch, "text"):
                h, rows = _tokens(buf, offs)
                if not len(h):
                    continue
                number = np.minimum(np.searchsorted(items.vocabulary, h), len(items.vocabulary) - 1)
                known = items.vocabulary[number] == h
                number[~known] = -1
                found: dict[tuple[int, int], tuple[float, float, int]] = {}

                def look(item: int, first: int, last: int, sure: bool = False) -> None:
                    """Judge what lies within the item's reach of words ``first`` to ``last``."""
                    doc, reach = int(rows[first]), items.reach(item)
                    lo, hi = max(first - reach, int(np.searchsorted(rows, doc))), min(last + reach, int(np.searchsorted(rows, doc, "right")))
                    got, old = items.judge(item, h, number, lo, hi, min_lcs, min_cosine, sure), found.get((doc, item))
                    if got and (old is None or got[1:] > old[1:]):
                        found[doc, item] = got

                past: dict[tuple[int, int], int] = {}
                for at, item, width in items.runs.find(h, rows, known):
                    if at >= past.get((int(rows[at]), item), 0):
                        past[int(rows[at]), item] = at + items.reach(item)
                        look(item, at, at + width, True)
                for item, first, last in items.signatures.find(rows, number):
                    look(item, first, last + 1)
                keys = list(found)
                ids = pa.array([items.ids[i] for _, i in keys], pa.int64())
                out = [part.column(0).take(pa.array([d for d, _ in keys], pa.int64())), ids, *[pa.array([found[x][j] for x in keys], t) for j, t in enumerate((pa.float64(), pa.float64(), pa.int64()))]]
                yield pa.RecordBatch.from_arrays(out, ["doc", "item", "cosine", "lcs_share", "verbatim_words"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None, rank: int = 160, min_lcs: float = 0.6, min_cosine: float = 0.3, verbatim: int = 13) -> DataFrame:
    """(id, item id, cosine, lcs_share, verbatim_words) of every leak found; ids keep the document's type, items are long."""
    kind = docs.schema[id_col].dataType.simpleString()
    fields = "doc " + kind + ", item long, cosine double, lcs_share double, verbatim_words long"
    rows = docs.select(F.col(id_col).alias("doc"), text_of(text).alias("text"))
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    items = keep(benchmark.select(F.col(item_col).cast("long").alias("item"), text_of(item_text).alias("text"), answer.alias("answer")), "leak-items")
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    idf = weights(rows) if n else None
    scans, out = max(1, -(-n // BLOCK), -(-size // BLOCK_BYTES)), None
    per = max(1, -(-n // scans // rank))
    for k in range(scans if n else 0):
        ids, words, answers, blocks = [], [], [], []
        for j in range(per):
            mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(scans * per)) == k * per + j) if scans * per > 1 else items
            got = mine.orderBy("item", "text").collect()
            split = [(r, w) for r in got if len(w := _tokens(*vec.flat(pa.array([r["text"]])))[0])]
            if not split:
                continue
            bins, axes = randomised_svd(mine.select("text"), idf, len(got))
            blocks.append(Index(len(ids), [w for _, w in split], idf, bins, axes))
            ids += [r["item"] for r, _ in split]
            words += [w for _, w in split]
            answers += [_tokens(*vec.flat(pa.array([r["answer"]])))[0] if r["answer"] else w[-max(3, len(w) // 4) :] for r, w in split]
        if not blocks:
            continue
        part = rows.mapInArrow(_scan(Items(ids, words, answers, blocks, verbatim, min_lcs), min_lcs, min_cosine), fields)
        out = part if out is None else out.unionByName(part)
    out = rows.sparkSession.createDataFrame([], fields) if out is None else out
    return out.withColumnsRenamed({"doc": id_col, "item": item_col})
