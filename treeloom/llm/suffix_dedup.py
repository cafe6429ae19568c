"""Repeated long substrings by run-length indexes.

Every byte covered by a string of ``length`` bytes that also starts elsewhere (in any text, this one included) is removed. The answer is exact.

Dealing the work. A window of ``length`` bytes has a least k-mer by hash, leftmost on ties: its anchor, which its content alone decides.
Neighbouring windows of one anchor make a snippet, so each window lies in one snippet, and equal windows
have equal anchors. Only snippets of one anchor can hold equal windows, and most anchors are met once. Equal snippets
are one row with a count; all windows of a snippet met twice are repeated.

The index. Different snippets of one anchor go to a block, for which is built: the suffix order (prefix doubling, a sentinel of its own
after each snippet), its Burrows-Wheeler transform as runs, and samples at run ends: the text position and its common prefix with the
neighbour in the order. Inside a run a position's value is that of the position before less one, so the samples
give, streamed along the text, the longest match that starts there and anywhere else (the larger of both neighbours).
Where it reaches ``length``, the window is repeated.

An anchor with more than ``BLOCK`` different snippets does not go to one task: its snippets are taken as texts and dealt again by anchors of
longer k-mers (``LEVELS``), which fewer of them share. At the last level an anchor is a whole window, and counting is all.

Texts are bytes of UTF-8, each of less than 2**28 (a longer one is an error); null is empty. Repeated rows are texts of their own, so all they have in common goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec
from .common import free, fresh, keep, text_of

BLOCK, BLOCK_BYTES = 32_768, 256 << 10
POSITION = 28
U = np.uint64
_TABLES = np.random.Generator(np.random.PCG64(23)).integers(1, 2**63, (2, 256), np.uint64) | U(1)


def levels(length: int) -> list[int]:
    """K-mer lengths: anchors that ever fewer windows share, at last whole windows."""
    return [min(16, length), *sorted({length // 2, length * 4 // 5, length} - {min(16, length)} - {0})]


def _sums(buf: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(table[buf] * vec.powers(len(buf)), out=out[1:])
    return out


def snippets(buf: np.ndarray, offs: np.ndarray, length: int, k: int):
    """Text number, first and last window start, anchor and snippet hashes, and the anchor's position, of every snippet."""
    n = len(buf) - length + 1
    z = np.zeros(0, np.int64)
    if n <= 0:
        return z, z, z, z, z, z
    if len(buf) >> POSITION:
        raise ValueError(f"a text of {len(buf)} bytes: positions have {POSITION} bits")
    inverse = vec.powers(len(buf) + 1, True)
    sums = _sums(buf, _TABLES[0])
    kmers = vec.mix((sums[k:] - sums[:-k]) * inverse[: len(sums) - k] + U(k))
    # least of each length - k + 1 neighbours, hash above position: running minima of blocks from both sides
    w = length - k + 1
    value = (kmers >> U(POSITION) << U(POSITION)) | np.arange(len(kmers), dtype=np.uint64)
    if w > 1:
        padded = np.full(-(-len(value) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(value)] = value
        left = np.minimum.accumulate(padded.reshape(-1, w), 1).ravel()
        right = np.minimum.accumulate(padded.reshape(-1, w)[:, ::-1], 1)[:, ::-1].ravel()
        value = np.minimum(right[:n], left[w - 1 : w - 1 + n])
    at = (value & U((1 << POSITION) - 1)).astype(np.int64)
    size = np.diff(offs)
    inside = np.zeros(len(buf) + 1, np.int64)
    has = size >= length
    inside[offs[:-1][has]] += 1
    np.subtract.at(inside, offs[1:][has] - length + 1, 1)
    valid = np.flatnonzero(np.cumsum(inside)[:n])
    if not len(valid):
        return z, z, z, z, z, z
    new = np.ones(len(valid), bool)
    new[1:] = (at[valid[1:]] != at[valid[:-1]]) | (valid[1:] != valid[:-1] + 1)
    doc = np.searchsorted(offs, valid, "right") - 1
    new[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(new)
    lo, hi = valid[first], valid[np.append(first[1:], len(valid)) - 1]
    other = _sums(buf, _TABLES[1])
    body = vec.mix((other[hi + length] - other[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))
    # where the anchor lies is part of what tells snippets apart
    body = vec.mix(body ^ ((at[lo] - lo).astype(np.uint64) * U(0x9E3779B97F4A7C15)))
    return doc[first], lo, hi, kmers[at[lo]].view(np.int64), body.view(np.int64), at[lo]


def _pack(lo: np.ndarray, hi: np.ndarray) -> bytes:
    return np.stack([lo, hi], 1).astype("<i4").tobytes()


def _occurrences(length: int, k: int):
    """Rows (a, s, row, start, windows, times, ranges): one for each distinct snippet of a text, and one with ranges for the windows that the text itself repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "s", "row", "start", "windows", "times", "ranges"]
        for batch in batches:
            for part, buf, offs in vec.chunks(batch, "text"):
                row = part.column(0).to_numpy()
                doc, lo, hi, a, s, _ = snippets(buf, offs, length, k)
                if not len(doc):
                    continue
                key = vec.mix(a.view(np.uint64) ^ vec.mix(s.view(np.uint64) ^ vec.mix(doc.astype(np.uint64))))
                _, one, back, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                start = (lo - offs[doc])[one]
                out = [a[one], s[one], row[doc[one]], start.astype(np.int32), (hi - lo + 1)[one].astype(np.int32), np.minimum(times, 2).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.nulls(len(one), pa.binary())], names)
                again = np.flatnonzero(times[back] > 1)
                if len(again):
                    d, b, e = doc[again], (lo - offs[doc])[again], (hi - offs[doc])[again]
                    cut = np.flatnonzero(np.diff(d)) + 1
                    ranges = [_pack(x, y) for x, y in zip(np.split(b, cut), np.split(e, cut), strict=True)]
                    m = len(ranges)
                    nothing = [pa.nulls(m, t) for t in (pa.int64(), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*nothing, pa.array(row[d[np.append(0, cut)]]), pa.array(np.zeros(m, np.int32)), *[pa.nulls(m, pa.int32())] * 2, pa.array(ranges, pa.binary())], names)

    return run


def _fetch(length: int):
    """Rows (a, s, m, bytes) of the snippets in ``wanted`` of each text, cut out of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in vec.chunks(batch, "text"):
                wanted = part.column(part.schema.get_field_index("wanted"))
                a, s, m, start, windows = wanted.flatten().flatten()
                lo = start.to_numpy() + np.repeat(offs[:-1], wanted.value_lengths().to_numpy())
                hi = lo + windows.to_numpy() + (length - 1)
                raw = buf.tobytes()
                yield pa.RecordBatch.from_arrays([a, s, m, pa.array([raw[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())], ["a", "s", "m", "bytes"])

    return run


class RunIndex:
    """Run-length index of a block of texts, for the longest match of each position with any other."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        text = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        n = len(text)
        rest = np.repeat(self.ends, sizes + 1) - np.arange(n)
        # seven symbols of nine bits in a word: bytes are 1 to 256, what lies behind a text's end is 0
        symbol = np.zeros(n + 7, np.uint64)
        symbol[:n] = text + np.uint64(1)
        symbol[self.ends] = 0
        word = np.zeros(n, np.uint64)
        for j in range(7):
            word |= np.where(rest > j, symbol[j : j + n], U(0)) << U(54 - 9 * j)
        order = np.argsort(word)
        short = rest < 7
        # texts that end within a word are unlike any other: equal ones stand in the order of their positions
        place = np.flatnonzero(short[order])
        own = order[place]
        order[place] = own[np.lexsort((own, word[own]))]
        new = np.ones(n, bool)
        new[1:] = (word[order[1:]] != word[order[:-1]]) | short[order[1:]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        ranks, h = [(7, rank.astype(np.int32))], 7
        while not new.all():
            # only ties need another look; a tie has h bytes left at least, so position + h is in its text or on its end
            tied = ~new
            tied[:-1] |= ~new[1:]
            at = np.flatnonzero(tied)
            own = order[at]
            key = (rank[own].astype(np.uint64) << U(32)) | rank[np.minimum(own + h, n - 1)].astype(np.uint64)
            by = np.argsort(key)
            key, own = key[by], own[by]
            order[at] = own
            differs = np.ones(len(at), bool)
            differs[1:] = key[1:] != key[:-1]
            new[at] = differs
            rank[order] = np.cumsum(new) - 1
            h *= 2
            ranks.append((h, rank.astype(np.int32)))
        self.n, self.order, self.ranks, self.word = n, order, ranks, word
        before = np.where(order > 0, text[order - 1].astype(np.int64), 0)
        first = np.zeros(n, bool)
        first[self.starts] = True
        before[first[order]] = 256 + np.arange(first.sum())
        #: run heads of the transform; what precedes a text's first byte is unlike everything
        self.head = np.ones(n, bool)
        self.head[1:] = before[1:] != before[:-1]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefix lengths of the suffixes at ``i`` and ``j``."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for h, rank in reversed(self.ranks):
            same = rank[i] == rank[j]
            out += h * same
            i, j = np.minimum(i + h * same, self.n - 1), np.minimum(j + h * same, self.n - 1)
        rest = self.word[i] ^ self.word[j]
        lead = np.zeros(len(i), np.int64)
        for b in range(1, 8):
            lead += rest >> U(63 - 9 * b) == 0
        left = np.repeat(self.ends, self.ends - self.starts + 1) - np.arange(self.n)
        return out + np.minimum(lead, np.minimum(left[i], left[j]))

    def matches(self) -> np.ndarray:
        """For each position the longest match with another start, streamed from the samples at run ends."""
        best = np.zeros(self.n, np.int64)
        tail = np.append(self.head[1:], True)
        for sampled, step in ((self.head, -1), (tail, 1)):
            at = np.flatnonzero(sampled)
            value = np.zeros(len(at), np.int64)
            near = at + step
            fine = (near >= 0) & (near < self.n)
            value[fine] = self.common(self.order[at[fine]], self.order[near[fine]])
            sample, last = np.zeros(self.n, np.int64), np.full(self.n, -1)
            sample[self.order[at]] = value
            last[self.order[at]] = self.order[at]
            last = np.maximum.accumulate(last)
            best = np.maximum(best, sample[last] - (np.arange(self.n) - last))
        return best

    def repeated(self, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Text number and the runs (first, last) of starts whose match reaches ``length``."""
        hit = np.flatnonzero(self.matches() >= length)
        if not len(hit):
            return
        text = np.searchsorted(self.ends, hit)
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        lo, hi, text = hit[first], hit[np.append(first[1:], len(hit)) - 1], text[first]
        cut = np.flatnonzero(np.diff(text)) + 1
        for t, x, y in zip(text[np.append(0, cut)], np.split(lo, cut), np.split(hi, cut), strict=True):
            yield int(t), x - self.starts[t], y - self.starts[t]


def _index(length: int):
    """Rows (a, s, bytes) by a and s: indexes of whole anchors, together about ``BLOCK_BYTES``. A snippet that comes again is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes]] = []
        size = 0

        def flush():
            out = [(rows[t][0], rows[t][1], _pack(lo, hi)) for t, lo, hi in RunIndex([r[2] for r in rows]).repeated(length)] if len(rows) > 1 else []
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["a", "s", "ranges"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and row[:2] == rows[-1][:2]:
                    continue
                if size > BLOCK_BYTES and row[0] != rows[-1][0]:
                    yield flush()
                    size = 0
                rows.append(row)
                size += len(row[2])
        if rows:
            yield flush()

    return run


def repeated(texts: DataFrame, length: int, level: int = 0) -> DataFrame:
    """(row, start, ranges): runs of repeated window starts, counted from ``start`` in the text of ``row`` (row long, text string or binary)."""
    k, whole = levels(length)[level], "occurrences"
    occ = keep(texts.mapInArrow(_occurrences(length, k), "a long, s long, row long, start int, windows int, times int, ranges binary"), f"suffix-{whole}{level}")
    local = occ.where("a is null").select("row", "start", "ranges")
    found = occ.where("a is not null")
    # row and start of one occurrence: both see the same rows in the same order, so both are of the same one
    one = [F.first(c).alias(c) for c in ("row", "start")]
    distinct = keep(found.groupBy("a", "s").agg(F.sum("times").alias("times"), F.max("windows").alias("windows"), *one), f"suffix-distinct{level}")
    anchors = distinct.groupBy("a").agg(F.count(F.lit(1)).alias("m"), F.min("times").alias("least")).where("m > 1 and least = 1").drop("least")
    # the snippets to index are cut out of one text that has them: the texts move once, and nothing passes the driver
    asked = distinct.join(anchors, "a").groupBy("row").agg(F.collect_list(F.struct("a", "s", "m", "start", "windows")).alias("wanted"))
    fetched = texts.hint("merge").join(asked.hint("merge"), "row").select("text", "wanted").mapInArrow(_fetch(length), "a long, s long, m long, bytes binary")
    fetched = keep(fetched, f"suffix-snippets{level}")
    # rows that share id and text are told by one number and bring a snippet each
    some = fetched.where(F.col("m") <= BLOCK).select("a", "s", "bytes")
    indexed = some.repartition("a").sortWithinPartitions("a", "s").mapInArrow(_index(length), "a long, s long, ranges binary")
    by_count = distinct.where("times > 1").select("a", "s", F.unhex(F.lpad(F.hex(F.lit(0)), 8, "0")).alias("zero"), (F.col("windows") - 1).alias("last"))
    by_count = by_count.select("a", "s", F.concat("zero", _little(F.col("last"))).alias("ranges"))
    result = by_count.unionByName(indexed.join(distinct.where("times > 1").select("a", "s"), ["a", "s"], "left_anti"))
    many = fetched.where(F.col("m") > BLOCK)
    if level + 1 < len(levels(length)) and many.limit(1).count():
        deeper = keep(many.dropDuplicates(["a", "s"]).withColumn("row", F.xxhash64("a", "s")), f"suffix-many{level}")
        below = repeated(deeper.select("row", F.col("bytes").alias("text")), length, level + 1)
        below = below.join(deeper.select("row", "a", "s"), "row").select("a", "s", "start", "ranges")
        result = result.withColumn("shift", F.lit(0)).unionByName(below.withColumnRenamed("start", "shift"))
    else:
        result = result.withColumn("shift", F.lit(0))
    result = keep(result, f"suffix-result{level}")
    free(distinct, fetched)
    hits = found.select("a", "s", "row", "start").hint("merge").join(result.hint("merge"), ["a", "s"]).select("row", (F.col("start") + F.col("shift")).alias("start"), "ranges")
    return hits.unionByName(local)


def _little(x):
    """Four bytes of an int, least first."""
    h = F.lpad(F.hex(x), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))


OUT = T.StructType([T.StructField("kept", T.BinaryType(), False), T.StructField("n_bytes", T.LongType(), False), T.StructField("n_removed", T.LongType(), False), T.StructField("n_spans", T.LongType(), False), T.StructField("spans", T.BinaryType(), False)])


def _remove(length: int, text: str, n: int, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in vec.chunks(batch, text):
                raw, rows = buf.tobytes(), []
                for i, hits in enumerate(part.column(n).to_pylist()):
                    body = raw[offs[i] : offs[i + 1]]
                    if not hits:
                        rows.append((body, len(body), 0, 0, b""))
                        continue
                    spans = np.concatenate([np.frombuffer(h["ranges"], "<i4").reshape(-1, 2).astype(np.int64) + h["start"] for h in hits])
                    spans = spans[np.argsort(spans[:, 0], kind="stable")]
                    spans[:, 1] += length
                    reach = np.maximum.accumulate(spans[:, 1])
                    new = np.ones(len(spans), bool)
                    new[1:] = spans[1:, 0] > reach[:-1]
                    first = np.flatnonzero(new)
                    lo, hi = spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]
                    left = b"".join(body[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(body)], strict=True))
                    rows.append((left, len(body), int((hi - lo).sum()), len(lo), np.stack([lo, hi], 1).astype("<i8").tobytes()))
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                got = pa.StructArray.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], OUT.names)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], got], [*part.schema.names[:n], out])

    return run


def dedup_spans(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text: str = "text", out: str = "deduped") -> DataFrame:
    """All rows and columns of ``docs`` with a struct ``out``: kept (bytes left, joined), n_bytes, n_removed, n_spans, and spans as pairs of 64-bit ends."""
    docs = docs.drop(out) if out in docs.columns else docs
    row = F.xxhash64(F.col(id_col), F.col(text))
    hits = repeated(docs.select(row.alias("row"), text_of(text).alias("text")), length)
    key, found = fresh(docs, "__row", "__hits")
    by_row = hits.groupBy("row").agg(F.collect_list(F.struct("start", "ranges")).alias(found)).withColumnRenamed("row", key)
    joined = docs.withColumn(key, row).hint("merge").join(by_row.hint("merge"), key, "left").select(*[F.col(f"`{c}`") for c in docs.columns], found)
    return joined.mapInArrow(_remove(length, text, len(docs.columns), out), T.StructType([*docs.schema.fields, T.StructField(out, OUT, False)]))
