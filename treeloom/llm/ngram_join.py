"""Similarity join of documents on sets of word shingles (Jaccard), with count-vector R-trees.

Documents with equal sets are one class; what follows is about classes, so exact copies cost one row each. A class is a point: counts
of its shingles in ``DIMS`` hashed groups. The overlap of two sets is at most the sum of coordinate minima, and that of a set with all below
a tree node at most the sum with the node's maxima. All candidates come from searches of such trees.

1. Signatures: each document's set size, a 128-bit hash of its set (the class), four min-hashes and its point.
2. Groups that hold all that may link. Those of one min-hash have most near copies. Those of one shingle are complete: with a common order of
   shingles two sets of Jaccard 0.75 share one of their first n - ceil(0.75 n) + 1 (prefix filter). Shingles found often come last in the
   order (a list of at most ``HOT``, which affects cost only). Groups whose members all are in one component have nothing to add and go.
3. Rounds: in each group a few pivots search the group's tree, each member takes the best pivot that found it, and that pair is verified. So a
   round has at most as many pairs as members, also among thousands of near copies. Rounds go on while more than one pair in ``ROUND`` is a new link
   and ``_spared`` exceeds the members (that affects cost only): a round reads all members, and spares completion about the pairs among those
   that a pivot links. Many small families that meet in a group would take a round each.
4. Completion, exact: in the groups that still hold several components all members search, and all pairs of different
   components that the trees let pass and no round has tried are verified.
5. Verification compares finer counts, then whole sets; components are the answer.

A group of more than ``BLOCK`` members lies in several trees, each in a task of its own; those that search pass by them as a stream, so no
task holds more than a block. In completion of such a group its largest component does not search: one end of each pair is outside it. The cost
there is the product of the other members and the blocks.

Documents without words (null, empty) have no shingles and link with nothing. Repeated rows are members of their class. A document's
component is the smallest id in it; null ids count as larger than all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import free, keep
from .graph import components, files_for

HOT, DIMS, BLOCK, LEAF, KEYS, ROUND, DRAWN = 4096, 512, 4096, 32, 4, 4, 4
BITS, TALLY = 24, 1 << 20
U = np.uint64


def sets_of(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their text numbers, by text and hash."""
    starts, ends, rows = vec.words(buf, offs)
    h, at = vec.shingles(vec.word_hashes(buf, starts, ends), rows, len(offs) - 1, width)
    # text number and the hash's upper bits in one word sort several times faster than two keys
    spare = max(1, int(len(offs)).bit_length())
    key = (at.astype(np.uint64) << U(64 - spare)) | (h >> U(spare))
    order = np.argsort(key)
    key, h, at = key[order], h[order], at[order]
    if ((key[1:] == key[:-1]) & (h[1:] != h[:-1])).any():
        order = np.lexsort((h, at))
        h, at = h[order], at[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    return h[new], at[new]


def _class(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Set size, class (two 64-bit sums of hashes) and first position for each text; the class of an empty set is 0."""
    size = vec.counts_by_row(at, n)
    first = np.searchsorted(at, np.arange(n))
    sums, out = np.zeros(len(h) + 1, np.uint64), []
    for seed in (0xA5A5A5A5A5A5A5A5, 0x3C6EF372FE94F82B):
        np.cumsum(vec.mix(h ^ U(seed)), out=sums[1:])
        total = vec.mix(sums[first + size] - sums[first] + size.astype(np.uint64) * U(0x9E3779B97F4A7C15))
        total[size == 0] = 0
        out.append(total.view(np.int64))
    return size, (out[0], out[1]), first


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often: dict[int, int] = {}
        names = ["kind", "doc", "t", "n", "h1", "h2", *[f"k{i}" for i in range(KEYS)], "counts"]
        id_type = pa.int64()

        def tallies():
            best = sorted(often.items(), key=lambda x: (-x[1], x[0]))[:HOT]
            z = pa.array([0] * len(best), pa.int64())
            out = [pa.array([1] * len(best), pa.int32()), pa.nulls(len(best), id_type), pa.nulls(len(best), id_type), pa.array([n for _, n in best], pa.int64()), pa.array([h for h, _ in best], pa.int64()), *[z] * (KEYS + 1), pa.nulls(len(best), pa.binary())]
            often.clear()
            return pa.RecordBatch.from_arrays(out, names)

        def tally():
            distinct, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *waiting]), return_counts=True)
            seen = times >= 3
            for x, t in zip(distinct[seen].view(np.int64).tolist(), times[seen].tolist(), strict=True):
                often[x] = often.get(x, 0) + t

        # shingles of about TALLY bytes are counted together: few are met three times in less
        waiting, held = [], 0
        for batch in batches:
            for part, buf, offs in vec.chunks(batch, "text"):
                n = len(offs) - 1
                h, at = sets_of(buf, offs, width)
                size, c, first = _class(h, at, n)
                keys = []
                for k in range(KEYS):
                    v = vec.mix(h ^ U(0x1234567 * (k + 1))).view(np.int64)
                    out = np.zeros(n, np.int64)
                    has = size > 0
                    if has.any():
                        out[has] = np.minimum.reduceat(v, first[has])
                    keys.append(pa.array(out))
                coarse, place = [], (h >> U(64 - DIMS.bit_length() + 1)).astype(np.int64)
                for lo in range(0, n, 512):  # a chunk may have very many short texts
                    own, hi = slice(*np.searchsorted(at, (lo, lo + 512))), min(lo + 512, n)
                    group = np.bincount((at[own] - lo) * DIMS + place[own], minlength=(hi - lo) * DIMS).reshape(-1, DIMS)
                    coarse += [x.tobytes() for x in np.minimum(group, 255).astype(np.uint8)]
                coarse = pa.array(coarse, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), part.column(0), part.column(1), pa.array(size), *map(pa.array, c), *keys, coarse], names)
                waiting.append(h)
                held += len(buf)
                if held >= TALLY:
                    tally()
                    waiting, held = [], 0
                if len(often) > 50 * HOT:
                    yield tallies()
            tally()
            waiting, held = [], 0
        yield tallies()

    return run


def _prefixes(width: int, percent: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, offs in vec.chunks(batch, "text"):
                h, at = sets_of(buf, offs, width)
                if not len(h):
                    continue
                size, c, first = _class(h, at, len(offs) - 1)
                late = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)
                order = np.argsort(at * 2 + late, kind="stable")
                least = -(-percent * size // 100)
                mine = np.arange(len(h)) - first[at] < (size - least + 1)[at]
                yield pa.RecordBatch.from_arrays([pa.array(h[order][mine].view(np.int64)), pa.array(c[0][at[mine]])], ["sh", "h1"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows by (sh, h1): distinct ones of shingles that two classes have. Holds one row back, whatever a group's size."""
    last: tuple[int, int] | None = None
    told = True
    for batch in batches:
        if not batch.num_rows:
            continue
        sh, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if last is not None:
            sh, c = np.append(last[0], sh), np.append(last[1], c)
        new = np.ones(len(sh), bool)
        new[1:] = (sh[1:] != sh[:-1]) | (c[1:] != c[:-1])
        if last is None:
            told = False
        sh, c = sh[new], c[new]
        before = np.zeros(len(sh), bool)
        before[1:] = sh[1:] == sh[:-1]
        before[0] = told
        after = np.zeros(len(sh), bool)
        after[:-1] = before[1:]
        out = before | after
        # the first row may have been told with the last batch; the last row waits for the next
        if last is not None and told:
            out[0] = False
        end = len(sh) - 1
        last_told = bool(before[end])
        yield pa.RecordBatch.from_arrays([pa.array(sh[out]), pa.array(c[out])], ["sh", "h1"])
        last, told = (sh[end], c[end]), last_told
    return


def _fine(h: np.ndarray) -> bytes:
    """Counts of one sorted set in a number of hashed groups that grows with it, about four shingles each."""
    bits = max(7, int(len(h) // 4).bit_length())
    while True:
        counts = np.bincount((h >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
        if counts.max() < 256:
            return counts.astype(np.uint8).tobytes()
        bits += 1


def _sets(width: int, bits: bytes, fine: bool):
    wanted = np.frombuffer(bits, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(1).to_numpy()
            batch = batch.filter(pa.array((wanted[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0))
            for _, buf, offs in vec.chunks(batch, "text"):
                h, at = sets_of(buf, offs, width)
                size, c, first = _class(h, at, len(offs) - 1)
                own = np.flatnonzero(size > 0)
                each = [h[first[i] : first[i] + size[i]] for i in own]
                yield pa.RecordBatch.from_arrays([pa.array(c[0][own]), pa.array(c[1][own]), pa.array([_fine(x) if fine else x.tobytes() for x in each], pa.binary())], ["h1", "h2", "body"])

    return run


def _reach(most, q, x, percent: int):
    """Whether an overlap of ``most`` lets sets of q and x elements reach the threshold: o >= percent * (q + x - o) / 100."""
    return (100 + percent) * most >= percent * (q + x)


def _bodies(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of the third and fourth column, row by row, as views of the batch."""
    (x, xs), (y, ys) = vec.flat(batch.column(2)), vec.flat(batch.column(3))
    for i in range(batch.num_rows):
        yield x[xs[i] : xs[i + 1]], y[ys[i] : ys[i + 1]]


def _kept_pairs(batch: pa.RecordBatch, ok: list[bool]) -> pa.RecordBatch:
    keepers = pa.array(np.flatnonzero(ok))
    return pa.RecordBatch.from_arrays([batch.column(0).take(keepers), batch.column(1).take(keepers)], ["u", "v"])


def _bound(percent: int):
    """Pairs whose fine counts allow the threshold."""

    def allows(x: np.ndarray, y: np.ndarray) -> bool:
        if max(x.max(), y.max()) == 255:  # as far as counted: no bound
            return True
        width = min(len(x), len(y))
        x, y = x.reshape(width, -1).sum(1), y.reshape(width, -1).sum(1)
        return bool(_reach(int(np.minimum(x, y).sum()), int(x.sum()), int(y.sum()), percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _kept_pairs(batch, [allows(x, y) for x, y in _bodies(batch)])

    return run


def _verify(percent: int):
    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            return False
        both = len(np.intersect1d(np.frombuffer(x.tobytes(), np.uint64), np.frombuffer(y.tobytes(), np.uint64), assume_unique=True))
        return 100 * both >= percent * ((len(x) + len(y)) // 8 - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _kept_pairs(batch, [linked(x, y) for x, y in _bodies(batch)])

    return run


class CountTree:
    """R-tree over count vectors, packed by repeated halving along the coordinate of most variance.

    A node holds the maxima of its points' coordinates and their least size, which is all that a bound on overlap needs.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.counts, self.sizes = counts, sizes
        self.order = np.arange(len(sizes))
        self.nodes: list[tuple[int, int, int, int, np.ndarray, int]] = []
        self._build(0, len(sizes))

    def _build(self, lo: int, hi: int) -> int:
        at, own = len(self.nodes), self.order[lo:hi]
        self.nodes.append((lo, hi, -1, -1, self.counts[own].max(0), int(self.sizes[own].min())))
        if hi - lo > LEAF:
            axis = int(self.counts[own].var(0).argmax())
            self.order[lo:hi] = own[np.argsort(self.counts[own, axis], kind="stable")]
            mid = (lo + hi) // 2
            left, right = self._build(lo, mid), self._build(mid, hi)
            self.nodes[at] = (lo, hi, left, right, *self.nodes[at][4:])
        return at

    def search(self, counts: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of queries and of points whose overlap may reach the threshold."""
        stack = [(0, np.arange(len(sizes)))]
        while stack:
            node, q = stack.pop()
            lo, hi, left, right, most, least = self.nodes[node]
            q = q[_reach(np.minimum(counts[q], most).sum(1, dtype=np.int64), sizes[q], least, percent)]
            if not len(q):
                continue
            if left >= 0:
                stack += [(left, q), (right, q)]
                continue
            own = self.order[lo:hi]
            if len(q) < len(own):
                for x in q:
                    hit = own[_near(counts[x], self.counts[own], sizes[x], self.sizes[own], percent)]
                    yield np.full(len(hit), x), hit
            else:
                for p in own:
                    hit = q[_near(self.counts[p], counts[q], self.sizes[p], sizes[q], percent)]
                    yield hit, np.full(len(hit), p)


def _near(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and the sum of coordinate minima allow the threshold; ``a`` and ``b`` are rows of counts, or one of them a single row."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & _reach(np.minimum(a, b).sum(1, dtype=np.int64), n, m, percent)


class Members:
    """Rows of a batch as arrays."""

    def __init__(self, table: pa.Table):
        column = lambda name: table.column(name).to_numpy()
        self.asks, self.lies, self.c, self.label, self.met, self.n = (column(k) for k in ("asks", "lies", "c", "label", "met", "n"))
        self.counts = vec.flat(table.column("counts").combine_chunks())[0].reshape(-1, DIMS)

    def without_end(self) -> np.ndarray:
        """Counts, those as far as counted read as without end."""
        return np.where(self.counts == 255, 1 << 30, self.counts.astype(np.int64)) if self.counts.max(initial=0) == 255 else self.counts


def _fits(a: Members, x: np.ndarray, b: Members, y: np.ndarray) -> np.ndarray:
    """Pairs to be told: of different components, and once where both ask."""
    return (a.label[x] != b.label[y]) & (~b.asks[y] | (a.c[x] < b.c[y]))


def _searched(percent: int):
    """Rows (u, v, met): u asks in a block (sh, b) and v lies there, and their counts allow the threshold.

    Rows come sorted by sh, b and then those that lie there before those that only ask, which thus pass by; what is held is a
    block's tree. Blocks of a leaf's size need no tree: their pairs are taken together, over all such blocks of a batch.
    """

    def leaves(rows: Members, first: np.ndarray, last: np.ndarray) -> list[tuple]:
        """Pairs of the blocks ``first`` to ``last`` (excluded), all of whose rows lie there."""
        block = np.repeat(np.arange(len(first)), last - first)
        at = np.repeat(first - np.append(0, np.cumsum(last - first)[:-1]), last - first) + np.arange(len(block))
        asks = rows.asks[at]
        who, mine = at[asks], block[asks]
        size, out = (last - first)[mine], []
        step = np.append(0, np.cumsum(size))
        for begin in range(0, len(who), 512):
            some = slice(begin, min(begin + 512, len(who)))
            x = np.repeat(who[some], size[some])
            y = np.arange(len(x)) - np.repeat(step[some] - step[begin] - first[mine[some]], size[some])
            fine = _fits(rows, x, rows, y)
            x, y = x[fine], y[fine]
            endless = (rows.counts[x].max(1, initial=0) == 255) | (rows.counts[y].max(1, initial=0) == 255)
            ok = endless | _near(rows.counts[x], rows.counts[y], rows.n[x], rows.n[y], percent)
            out.append((rows.c[x[ok]], rows.c[y[ok]], rows.met[x[ok]]))
        return out

    def query(tree: CountTree, held: Members, rows: Members) -> list[tuple]:
        out, who, counts = [], np.flatnonzero(rows.asks), rows.without_end()
        for begin in range(0, len(who), 1024):
            q = who[begin : begin + 1024]
            for x, y in tree.search(counts[q], rows.n[q], percent):
                fine = _fits(rows, q[x], held, y)
                out.append((rows.c[q[x[fine]]], held.c[y[fine]], rows.met[q[x[fine]]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, tree, held = None, [], None, None

        def build() -> list[tuple]:
            nonlocal tree, held
            if tree is not None or not parts:
                return []
            held = Members(pa.concat_tables(parts))
            tree = CountTree(held.without_end(), held.n)
            return query(tree, held, held)

        for batch in batches:
            if not batch.num_rows:
                continue
            table, rows = pa.Table.from_batches([batch]), Members(pa.Table.from_batches([batch]))
            sh, b = batch.column("sh").to_numpy(), batch.column("b").to_numpy()
            new = np.ones(len(sh), bool)
            new[1:] = (sh[1:] != sh[:-1]) | (b[1:] != b[:-1])
            turn = new.copy()
            turn[1:] |= rows.lies[1:] != rows.lies[:-1]
            first = np.flatnonzero(turn)
            last = np.append(first[1:], len(sh))
            # whole blocks of this batch: neither the first (it may have begun before), nor the last, nor followed by those who only ask
            whole = new[first] & rows.lies[first] & (last - first <= LEAF) & (np.arange(len(first)) > 0) & (np.arange(len(first)) < len(first) - 1)
            whole[:-1] &= new[first[1:]]
            out = leaves(rows, first[whole], last[whole])
            for s, e in zip(first[~whole].tolist(), last[~whole].tolist(), strict=True):
                if (sh[s], b[s]) != key:
                    out += build()
                    key, parts, tree, held = (sh[s], b[s]), [], None, None
                if rows.lies[s]:
                    parts.append(table.slice(s, e - s))
                else:
                    out += build()
                    if tree is not None:
                        out += query(tree, held, Members(table.slice(s, e - s)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["u", "v", "met"])
        if out := build():
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["u", "v", "met"])

    return run


def searched(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v, met) by trees over the groups of ``members`` (sh, c, n, label, m, asks, met).

    Members of a group lie in blocks of about ``BLOCK``; who asks is sent to each block of the group.
    """
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("c"), blocks).cast("int")
    rows = members.withColumn("own", own).withColumn("b", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("own"))))
    rows = rows.withColumn("lies", F.col("b") == F.col("own")).join(classes.select("c", "counts"), "c")
    rows = rows.select("sh", "b", "asks", "lies", "c", "label", "met", "n", "counts")
    return rows.repartition("sh", "b").sortWithinPartitions("sh", "b", F.desc("lies")).mapInArrow(_searched(percent), "u long, v long, met long")


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int, likely: bool = False) -> DataFrame:
    """The pairs (u, v) of classes whose sets reach the threshold: first by finer counts (unless most are ``likely`` to), then by the sets."""
    given, parts = pairs, files_for(pairs.count())
    for step, test in (("fine", _bound(percent)), ("set", _verify(percent)))[likely:]:
        body = _read(docs, classes, pairs, width, step == "fine", parts)
        a, b = (body.select(F.col("c").alias(k), F.col("body").alias(f"{k}_")) for k in "uv")
        left = keep(pairs.join(a, "u").join(b, "v").select("u", "v", "u_", "v_").mapInArrow(test, "u long, v long"), f"join-{step}")
        free(body, *([pairs] if pairs is not given else []))
        pairs = left
    return pairs


def _read(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, fine: bool, parts: int) -> DataFrame:
    """(c, body) of the classes in ``pairs``, fine counts or whole sets, read off their least document.

    A bit map of fixed size picks those documents, and some others that the join drops again, where they are read.
    """
    asked = pairs.select(F.explode(F.array("u", "v")).alias("c")).distinct()
    asked = keep(asked.join(classes.select("c", "h1", "h2", "doc"), "c").coalesce(parts), "join-asked")
    place = F.pmod(F.xxhash64("doc"), F.lit(1 << BITS))
    words = asked.select(place.alias("b")).groupBy(F.shiftright("b", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(b, 32) as int))")).alias("x")).collect()
    bits = np.zeros(1 << (BITS - 5), "<u4")
    for r in words:
        bits[r["w"]] = r["x"]
    sets = docs.select("doc", place.alias("place"), "text").mapInArrow(_sets(width, bits.tobytes(), fine), "h1 long, h2 long, body binary")
    out = keep(sets.join(asked.select("c", "h1", "h2"), ["h1", "h2"]).select("c", "body").dropDuplicates(["c"]), "join-sets")
    free(asked)
    return out


def _alike(n: str | Column, m: str | Column, percent: int) -> Column:
    """Whether the sizes of two sets allow the threshold."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _mixed(members: DataFrame, roots: DataFrame | None, percent: int) -> DataFrame:
    """Members (sh, c, n, label, m) of the groups that hold two components or more, m of them.

    Groups of the same members say the same: one of them stays, told by number, sum and exclusive or of hashes. Two members whose sizes are too far
    apart have nothing to say.
    """
    if roots is None:
        labelled = members.select("sh", "c", "n", F.col("c").alias("label"))
    else:
        labelled = members.select("sh", "c", "n").join(roots.withColumnRenamed("u", "c"), "c", "left")
        labelled = keep(labelled.select("sh", "c", "n", F.coalesce("root", "c").alias("label")), "join-labelled")
    h = F.xxhash64(F.lit(1), F.col("c"))
    mixed = labelled.groupBy("sh").agg(
        F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("m"), F.sum(F.shiftright(h, 24)).alias("s"), F.bit_xor(h).alias("x"),
        F.min("n").alias("least"), F.max("n").alias("most"),
    )
    mixed = mixed.where("a <> b").where((F.col("m") > 2) | _alike("least", "most", percent))
    mixed = mixed.groupBy("m", "s", "x").agg(F.min("sh").alias("sh")).select("sh", "m")
    out = keep(labelled.join(mixed, "sh"), "join-mixed")
    if roots is not None:
        free(labelled)
    return out


def _stars(members: DataFrame, classes: DataFrame, tried: DataFrame | None, percent: int, turn: int) -> DataFrame:
    """At most one pair (u, v) for each member v: its best pivot among those that found it.

    A few members of a group ask: the one that meets most others, as that is likely the text of which the others are copies, and up to ``DRAWN`` of
    other components, drawn anew each ``turn``, as families of copies may meet in a group. Members of a size that none can link with stay out.
    """
    popular = members.groupBy("c").agg(F.sum("m").alias("met"))
    ranked = keep(members.join(popular, "c"), "join-ranked")
    first = ranked.groupBy("sh").agg(F.max(F.struct("met", "c", "label", "n")).alias("p"))
    apart = ranked.join(first, "sh").where("label <> p.label")
    drawn = [F.max_by(F.struct("c", "label", "n"), F.xxhash64("c", F.lit(turn * DRAWN + i))).alias(f"q{i}") for i in range(DRAWN)]
    second = apart.groupBy("sh").agg(*drawn)
    asking = ["p", *[f"q{i}" for i in range(DRAWN)]]
    rows = ranked.join(first.join(second, "sh"), "sh").withColumn("asks", F.col("c").isin(*[F.col(f"{q}.c") for q in asking]))
    near = F.col("asks")
    for q in asking:
        near |= _alike("n", f"{q}.n", percent) & (F.col("label") != F.col(f"{q}.label"))
    found = searched(rows.where(near).select(*ranked.columns, "asks"), classes, percent)
    if tried is not None:
        found = found.withColumns({"lo": F.least("u", "v"), "hi": F.greatest("u", "v")}).join(tried.select(F.col("u").alias("lo"), F.col("v").alias("hi")), ["lo", "hi"], "left_anti")
    best = found.groupBy("v").agg(F.max_by("u", "met").alias("u"))
    out = keep(best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "join-stars")
    free(ranked)
    return out


def _spared(links: DataFrame, n: int) -> int:
    """Squares of the numbers of links that each class has, summed: about the pairs that completion would try without them."""
    each = links.select(F.explode(F.array("u", "v")).alias("c")).coalesce(files_for(n)).groupBy("c").agg(F.count(F.lit(1)).alias("k"))
    return each.agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0


def _rest(members: DataFrame, classes: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that the trees let pass and that were not tried.

    In a group of one block everyone asks; in a larger one all but its largest component, since one end of each pair is outside that.
    """
    size = members.where(F.col("m") > BLOCK).groupBy("sh", "label").agg(F.count(F.lit(1)).alias("k"))
    largest = size.groupBy("sh").agg(F.max_by("label", "k").alias("largest"))
    rows = members.join(largest, "sh", "left").withColumns({"asks": F.coalesce(F.col("label") != F.col("largest"), F.lit(True)), "met": F.lit(0).cast("long")})
    found = searched(rows, classes, percent).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return keep(found.join(tried.select("u", "v"), ["u", "v"], "left_anti"), "join-pairs")


def link(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``docs``: id, n_shingles, class_id (equal sets; null without words), component_id (smallest id linked, itself included).

    And root, which is a component's own number even where ids repeat (null without words), and text_hash, ``xxhash64`` of the text.
    """
    if docs.schema[id_col].dataType.typeName() not in ("long", "integer"):
        raise TypeError(f"{id_col} has to be an integer")
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))
    keys = [f"k{i}" for i in range(KEYS)]
    fields = "kind int, doc long, t long, n long, h1 long, h2 long, " + ", ".join(f"{k} long" for k in keys) + ", counts binary"
    signed = keep(docs.mapInArrow(_signatures(width), fields), "join-signatures")
    own = signed.where("kind = 0")
    hot = signed.where("kind = 1").groupBy("h1").agg(F.sum("n").alias("n")).where("n >= 20").orderBy(F.desc("n"), "h1").limit(HOT).select("h1").collect()
    hot = np.sort(np.array([r["h1"] for r in hot], np.int64).view(np.uint64))
    first = F.min(F.struct(F.isnull("doc").alias("x"), "doc", "n", *keys, "counts")).alias("first")
    classes = own.where("n > 0").groupBy("h1", "h2").agg(first).select("h1", "h2", "first.*").drop("x")
    # numbered where they are written, so the numbers stay
    classes = keep(classes.withColumn("c", F.monotonically_increasing_id()), "join-classes")
    # groups of one min-hash, for most of the links between near copies
    keyed = classes.select("c", "n", F.posexplode(F.array(*keys)).alias("i", "key")).select(F.xxhash64("i", "key").alias("sh"), "c", "n")
    members = _mixed(keyed, None, percent)
    tried = _stars(members, classes, None, percent, 0)
    free(members)
    sure = verified(docs, classes, tried, width, percent, likely=True)
    roots = components(sure)
    # groups of one shingle of the prefix filter, for all links
    prefixes = docs.mapInArrow(_prefixes(width, percent, hot), "sh long, h1 long")
    shared = keep(prefixes.repartition("sh").sortWithinPartitions("sh", "h1").mapInArrow(_shared, "sh long, h1 long"), "join-shared")
    members, turn = shared.join(classes.select("h1", "c", "n"), "h1").select("sh", "c", "n"), 0
    while True:
        before, members, turn = members, _mixed(members, roots, percent), turn + 1
        free(shared if turn == 1 else before)
        stars = _stars(members, classes, tried, percent, turn)
        asked = stars.count()
        tried = tried.unionByName(stars)
        more = verified(docs, classes, stars, width, percent, likely=True)
        found = more.count()
        if found:
            sure = sure.unionByName(more)
            roots = components(sure)
        if found * ROUND <= asked or _spared(more, found) <= members.count():
            break
    last = _mixed(members, roots, percent)
    free(members)
    more = verified(docs, classes, _rest(last, classes, tried, percent), width, percent)
    free(last)
    roots = components(sure.unionByName(more))
    tree = classes.join(roots.withColumnRenamed("u", "c"), "c", "left").select("h1", "h2", "c", "doc", F.coalesce("root", "c").alias("root"))
    least = tree.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = tree.join(least, "root").select("h1", "h2", "c", "root", "component_id")
    out = own.join(named, ["h1", "h2"], "left").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("class_id"), F.coalesce("component_id", "doc").alias("component_id"), "root", F.col("t").alias("text_hash"))
    return out
