"""What concerns one sentence, on tables whose sentences stand together: all rows of one are neighbours in one partition.

A token's row then holds both annotations, and the rows go through Arrow in the order they are read: no shuffle, no join, nothing sent to the driver.
What follows from a sentence's shape (its ids and heads) is computed once for each shape that a task has met lately; all else is columns at a time.
Rows: sent_id, id, head_ud, head_str, punct, and columns that a function names. A table of other order has to be brought into it (``arranged``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import matching as M
from .correspondence import CANDIDATES, FAMILIES, MATCHES, RESOLVED
from .edges import _above
from .resolve import swap_inverted

#: Shapes that a task holds at most, and the number that stands for null.
SHAPES, NULL = 8000, np.iinfo(np.int64).min
TREES = ("sent_id", "id", "head_ud", "head_str", "punct")
#: Whole sentences of a batch, and where each begins, the end of the last one included.
Work = Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]


def arranged(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with the sentences together, in order within."""
    return rows.repartition("sent_id").sortWithinPartitions("sent_id", *order)


def over_runs(rows: DataFrame, make: Callable[[], Work], schema: str) -> DataFrame:
    """What a task's ``make()`` gives for whole sentences; one that goes on in the next batch waits for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, kept, last = make(), [], None

        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            return work(whole, np.concatenate([[0], _changes(whole.column("sent_id")), [whole.num_rows]]).astype(np.int64))

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("sent_id")
            new = _changes(key)
            if kept and key[0].as_py() != last:
                new = np.concatenate([[0], new])
            last = key[-1].as_py()
            if len(new):
                cut = int(new[-1])
                whole = [*kept, batch.slice(0, cut)] if cut else kept
                if whole:
                    yield done(whole)
                kept = [batch.slice(cut)]
            else:
                kept.append(batch)
        if kept:
            yield done(kept)

    return rows.mapInArrow(run, schema)


def _changes(key: pa.Array) -> np.ndarray:
    """Places of a column whose value is not the one before."""
    key = pc.fill_null(key, "")
    return np.flatnonzero(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)) + 1


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return pc.fill_null(batch.column(name), NULL).to_numpy(zero_copy_only=False)


def _flags(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return pc.fill_null(batch.column(name), False).to_numpy(zero_copy_only=False)


def _array(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == NULL)


def _take(column: pa.Array, at: np.ndarray) -> pa.Array:
    """Values at places, null where a place is below 0."""
    return column.take(pa.array(at, pa.int64(), mask=at < 0))


class Words:
    """Numbers for a few texts."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> int:
        return self.known.setdefault(text, len(self.known))

    def array(self, codes: np.ndarray) -> pa.Array:
        return pa.array(list(self.known), pa.string()).take(pa.array(codes, pa.int64()))


class Shapes:
    """Rows of ``f`` for each sentence, as ``width`` columns of numbers; ``f`` gets a pair of trees and the place of each token in its sentence.

    With ``punct`` a shape is also which tokens are punctuation, of those that hang on an edge that only one tree has: no others count.
    """

    def __init__(self, f: Callable[[M.Pair, dict[int, int]], list[tuple]], width: int, punct: bool = False):
        self.f, self.width, self.punct, self.seen, self.loose = f, width, punct, {}, {}

    def __call__(self, batch: pa.RecordBatch, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows, and the number of each one's sentence."""
        trees = np.column_stack([_longs(batch, c) for c in ("id", "head_ud", "head_str")])
        marks = _flags(batch, "punct") if self.punct else None
        out = []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            mine = trees[a:b]
            key, some = mine.tobytes(), ()
            if self.punct:
                if key not in self.loose:
                    if len(self.loose) >= SHAPES:
                        self.loose.clear()
                    self.loose[key] = self.where(mine)
                at = self.loose[key]
                some = at[marks[a:b][at]]
                key = key, some.tobytes()
            if key not in self.seen:
                if len(self.seen) >= SHAPES:
                    self.seen.clear()
                ids = mine[:, 0].tolist()
                got = self.f(_pair(mine, frozenset(ids[i] for i in some)), {x: i for i, x in enumerate(ids)})
                self.seen[key] = np.array(got, np.int64).reshape(-1, self.width)
            out.append(self.seen[key])
        return np.concatenate(out) if out else np.empty((0, self.width), np.int64), np.repeat(np.arange(len(out)), [len(x) for x in out])

    @staticmethod
    def where(mine: np.ndarray) -> np.ndarray:
        p = _pair(mine, frozenset())
        deps = {p.ud.arcs[e][1] for e in p.open} | {d for e, (_, d) in p.st.arcs.items() if e not in p.ud.arcs}
        return np.array([i for i, x in enumerate(mine[:, 0].tolist()) if x in deps], np.int64)


def _pair(mine: np.ndarray, punct: frozenset[int]) -> M.Pair:
    rows = sorted(mine.tolist(), key=lambda r: r[0])
    return M.Pair(M.Tree((i, u) for i, u, _ in rows if u != NULL), M.Tree((i, s) for i, _, s in rows if s != NULL), punct)


#: Columns of a matcher's rows: those of ``MATCHES``, and the places of the two dependents.
FOUND = [x.split()[0] for x in MATCHES.split(", ")[1:]] + ["ud_at", "str_at"]


class Matcher:
    """Matches of a mode of ``matching`` as columns."""

    def __init__(self, mode: str = "strict", **options):
        self.words = Words()

        def rows(p: M.Pair, at: dict[int, int]) -> list[tuple]:
            out = []
            for m in M.MODES[mode](p, **options):
                h, d = p.ud.arcs[m.ud]
                sh, sd = p.st.arcs[m.st] if m.st else (NULL, NULL)
                texts = [self.words(x) for x in (m.status, m.certification, m.detail)]
                out.append((*m.ud, d, h, *(m.st or (NULL, NULL)), sd, sh, *texts, m.candidates, m.support, at[d], at[sd] if m.st else -1))
            return out

        self.shapes = Shapes(rows, len(FOUND), mode == "certified")

    def __call__(self, batch: pa.RecordBatch, starts: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Columns of ``FOUND``, with places in the batch, and each row's sentence."""
        rows, sent = self.shapes(batch, starts)
        out = dict(zip(FOUND, rows.T, strict=True))
        base = starts[sent]
        return out | {"ud_at": out["ud_at"] + base, "str_at": np.where(out["str_at"] < 0, -1, out["str_at"] + base)}, sent

    def column(self, found: dict[str, np.ndarray], name: str) -> pa.Array:
        return self.words.array(found[name]) if name in ("status", "certification", "detail") else _array(found[name])

    def is_(self, found: dict[str, np.ndarray], *statuses: str) -> np.ndarray:
        return np.isin(found["status"], [self.words(x) for x in statuses])


def matches(rows: DataFrame, mode: str = "strict", **options) -> DataFrame:
    """As ``correspondence.matches``."""
    names = [x.split()[0] for x in MATCHES.split(", ")]

    def make() -> Work:
        find = Matcher(mode, **options)

        def work(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
            found, sent = find(batch, starts)
            return pa.RecordBatch.from_arrays([_take(batch.column("sent_id"), starts[sent]), *[find.column(found, c) for c in names[1:]]], names)

        return work

    return over_runs(rows.select(*TREES), make, MATCHES)


COMPARED = "sent_id string, ud_id long, ud_form string, ud_head long, ud_deprel string, str_id long, str_form string, str_head long, str_deprel string, status string, certification string, detail string, candidate_count long, support_count long, comparable boolean"


def comparison(rows: DataFrame, mode: str = "strict", exclude_punct: bool = True, columns: tuple[str, ...] | None = None) -> DataFrame:
    """As ``correspondence.comparison``, or ``columns`` of it; ``rows`` has form, ud_deprel and str_deprel too."""
    kinds = [x for x in COMPARED.split(", ") if not columns or x.split()[0] in columns]
    names = [x.split()[0] for x in kinds]
    texts = [c for c in ("form", "ud_deprel", "str_deprel") if any(n.endswith(c) for n in names)]

    def make() -> Work:
        find = Matcher(mode)

        def work(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
            found, _ = find(batch, starts)
            if exclude_punct:
                stays = ~_flags(batch, "punct")[found["ud_at"]]
                found = {k: v[stays] for k, v in found.items()}

            def column(name: str) -> pa.Array:
                if name == "sent_id":
                    return _take(batch.column(name), found["ud_at"])
                if name == "comparable":
                    return pa.array(find.is_(found, *RESOLVED))
                if name in ("ud_form", "str_form"):
                    return _take(batch.column("form"), found[f"{name[:-5]}_at"])
                return _take(batch.column(name), found[f"{name[:-7]}_at"]) if name.endswith("deprel") else find.column(found, name)

            return pa.RecordBatch.from_arrays([column(n) for n in names], names)

        return work

    return over_runs(rows.select(*TREES, *texts), make, ", ".join(kinds))


def _aligned(p: M.Pair, at: dict[int, int]) -> list[tuple]:
    """(0, id, aligned id) from ud to str and (1, id, aligned id) back, of the strict mode; see ``correspondence.alignment``."""
    forth = {d: p.st.arcs[e][1] for e, (_, d) in p.ud.arcs.items() if e in p.st.arcs}
    a, b = ([i for i, h in t.heads.items() if h <= 0] for t in (p.ud, p.st))
    top = {a[0]: b[0]} if len(a) == len(b) == 1 else {i: i for i in a if i in b}
    forth |= {i: j for i, j in top.items() if i not in forth}
    claims: dict[int, list[int]] = {}
    for i, j in forth.items():
        claims.setdefault(j, []).append(i)
    return [(0, i, j) for i, j in forth.items()] + [(1, j, i[0]) for j, i in claims.items() if len(i) == 1]


def alignment(rows: DataFrame) -> DataFrame:
    """Both maps of ``correspondence.alignment`` of the strict matches, told by ``side``: ud, str."""

    def make() -> Work:
        maps = Shapes(_aligned, 3)

        def work(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
            got, sent = maps(batch, starts)
            side = pa.array(["ud", "str"]).take(pa.array(got[:, 0]))
            return pa.RecordBatch.from_arrays([_take(batch.column("sent_id"), starts[sent]), _array(got[:, 1]), _array(got[:, 2]), side], ["sent_id", "id", "aligned_id", "side"])

        return work

    return over_runs(rows.select(*TREES), make, "sent_id string, id long, aligned_id long, side string")


def with_aligned(rows: DataFrame, *columns: str) -> DataFrame:
    """The str tokens, with text ``columns`` and the ud token that alone is aligned with each."""
    names = ["sent_id", "id", *columns, "aligned_id"]

    def back(p: M.Pair, at: dict[int, int]) -> list[tuple]:
        of = {i: j for k, i, j in _aligned(p, at) if k == 1}
        return [(of.get(i, NULL),) for i in sorted(at, key=at.get)]

    def make() -> Work:
        maps = Shapes(back, 1)

        def work(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:-1]], _array(maps(batch, starts)[0][:, 0])], names)

        return work

    return over_runs(rows.select(*TREES, *columns), make, f"sent_id string, id long, {''.join(f'{c} string, ' for c in columns)}aligned_id long")


def units(rows: DataFrame, mode: str = "strict", include_punct: bool = False, include_root: bool = True, mask: str | None = None) -> DataFrame:
    """As ``correspondence.units``; ``mask`` is a column of ``rows`` that says which tokens count."""
    names = ["sent_id", "ud_id", "status", "certification"]

    def make() -> Work:
        find = Matcher(mode)

        def work(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
            found, _ = find(batch, starts)
            counts = np.ones(batch.num_rows, bool) if include_punct else ~_flags(batch, "punct")
            if mask:
                counts &= _flags(batch, mask)
            stays = counts[found["ud_at"]]
            at, status, sure = (found[k][stays] for k in ("ud_at", "status", "certification"))
            if include_root:
                tops = np.flatnonzero(counts & _is_root(batch, "head_ud"))
                both = _is_root(batch, "head_str")[tops]
                code = lambda yes, no: np.where(both, find.words(yes), find.words(no))
                at, status, sure = np.concatenate([at, tops]), np.concatenate([status, code("exact_same_dir", "unresolved")]), np.concatenate([sure, code("strict", "candidate_gap")])
            return pa.RecordBatch.from_arrays([_take(batch.column("sent_id"), at), _take(batch.column("id"), at), find.words.array(status), find.words.array(sure)], names)

        return work

    return over_runs(rows.select(*TREES, *([mask] if mask else [])), make, "sent_id string, ud_id long, status string, certification string")


def _is_root(batch: pa.RecordBatch, head: str) -> np.ndarray:
    heads = _longs(batch, head)
    return (heads <= 0) & (heads != NULL)


DIAGNOSED = "sent_id string, category long, meaningful long, case_1 long, case_2 long, case_3 long, case_4 long, case_5 long"


def diagnosis(rows: DataFrame, first: str, second: str | Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """As ``correspondence.diagnosis`` of two modes. A function for ``second`` says of the ids and of whether the first leaves them open which are still open."""
    names = [x.split()[0] for x in DIAGNOSED.split(", ")]

    def make() -> Work:
        one, two = Matcher(first), Matcher(second) if isinstance(second, str) else None

        def work(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
            found, sent = one(batch, starts)
            same, solved, undone = one.is_(found, "exact_same_dir"), one.is_(found, *RESOLVED), one.is_(found, "unresolved")
            if two:
                other, _ = two(batch, starts)
                solved_2, undone_2 = two.is_(other, *RESOLVED), two.is_(other, "unresolved")
            else:
                undone_2 = second(found["ud_id"], undone)
                solved_2 = solved | (undone & ~undone_2)
            n = len(starts) - 1
            many = lambda flags: np.bincount(sent[flags], minlength=n)
            open_1, other_1, open_2 = many(undone), many(~same), many(undone_2)
            category = np.select([other_1 == 0, (open_1 == 0) & (open_2 == 0), open_2 == 0, open_1 == 0], [1, 2, 3, 4], 5)
            case = np.select([same, solved & solved_2, solved_2, solved], [1, 2, 3, 4], 5)
            words = ~_flags(batch, "punct")
            stays = words[found["ud_at"]]
            tops = np.flatnonzero(words & _is_root(batch, "head_ud"))
            where = np.concatenate([sent[stays], np.searchsorted(starts, tops, "right") - 1])
            case = np.concatenate([case[stays], np.where(_is_root(batch, "head_str")[tops], 1, 5)])
            cases = [np.bincount(where[case == k], minlength=n) for k in range(1, 6)]
            has = np.flatnonzero(np.bincount(sent, minlength=n))
            columns = [pa.array(x[has].astype(np.int64)) for x in (category, np.bincount(where, minlength=n), *cases)]
            return pa.RecordBatch.from_arrays([_take(batch.column("sent_id"), starts[has]), *columns], names)

        return work

    return over_runs(rows.select(*TREES), make, DIAGNOSED)


CHECKED = "sent_id string, ud_id long, ud_form string, expected_str_id long, expected_str_form string, actual_str_id long, actual_str_form string, ok boolean"


def gold_check(rows: DataFrame, mode: str = "strict") -> DataFrame:
    """As ``correspondence.gold_check`` of ``token_links``; ``rows`` has form, gold (the str token expected, or null) and punct_str too."""
    names = [x.split()[0] for x in CHECKED.split(", ")]

    def make() -> Work:
        find = Matcher(mode)

        def work(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
            found, _ = find(batch, starts)
            ids, gold, sent = _longs(batch, "id"), _longs(batch, "gold"), np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            ud_mark, str_mark = _flags(batch, "punct"), _flags(batch, "punct_str")
            linked = np.full(len(ids), NULL)
            yes = (found["str_at"] >= 0) & ~ud_mark[found["ud_at"]] & ~str_mark[found["str_at"]]
            linked[found["ud_at"][yes]] = found["str_id"][yes]
            tops = [_least(_longs(batch, c) == 0, ids, sent, len(starts) - 1) for c in ("head_ud", "head_str")]
            both = (tops[0] >= 0) & (tops[1] >= 0)
            linked[tops[0][both]] = ids[tops[1][both]]
            wanted = np.bincount(sent[gold != NULL], minlength=len(starts) - 1) > 0
            at = np.flatnonzero(wanted[sent] & ((gold != NULL) | (linked != NULL)))
            place = {}
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                place |= {(a, x): a + i for i, x in enumerate(ids[a:b].tolist())}
            form = lambda of: _take(batch.column("form"), np.array([place.get((a, x), -1) for a, x in zip(starts[sent[at]].tolist(), of[at].tolist(), strict=True)], np.int64))
            columns = [_array(ids[at]), _take(batch.column("form"), at), _array(gold[at]), form(gold), _array(linked[at]), form(linked), pa.array(gold[at] == linked[at])]
            return pa.RecordBatch.from_arrays([_take(batch.column("sent_id"), at), *columns], names)

        return work

    return over_runs(rows.select(*TREES, "form", "gold", "punct_str"), make, CHECKED)


def _least(some: np.ndarray, ids: np.ndarray, sent: np.ndarray, n: int) -> np.ndarray:
    """For each sentence the place of the least id of ``some``, -1 without any."""
    at = np.flatnonzero(some)
    at = at[np.lexsort((ids[at], sent[at]))][::-1]
    out = np.full(n, -1)
    out[sent[at]] = at
    return out


def candidates(rows: DataFrame, *families: str) -> DataFrame:
    """As ``correspondence.candidates``."""

    def make() -> Work:
        words = Words()

        def found(p: M.Pair, at: dict[int, int]) -> list[tuple]:
            names: dict[tuple, list[str]] = {}
            for name in sorted(families):
                for u, pool in FAMILIES[name](p).items():
                    for s in pool:
                        names.setdefault((*u, *s), []).append(name)
            return [(*key, words(",".join(x))) for key, x in names.items()]

        return _listed(Shapes(found, 5, "order_residual" in families), CANDIDATES, words)

    return over_runs(rows.select(*TREES), make, CANDIDATES)


def listed(rows: DataFrame, f: Callable[[M.Pair, dict[int, int]], list[tuple]], schema: str) -> DataFrame:
    """Rows of numbers that ``f`` gives for a shape, under the sentence's id: columns ``schema`` after it."""
    full = f"sent_id string, {schema}"
    return over_runs(rows.select(*TREES), lambda: _listed(Shapes(f, len(schema.split(", "))), full), full)


def _listed(shapes: Shapes, schema: str, words: Words | None = None) -> Work:
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        got, sent = shapes(batch, starts)
        columns = [words.array(x) if words and k == len(got.T) - 1 else _array(x) for k, x in enumerate(got.T)]
        return pa.RecordBatch.from_arrays([_take(batch.column("sent_id"), starts[sent]), *columns], names)

    return work


def cross_lca(rows: DataFrame) -> DataFrame:
    """As ``edges.cross_lca``."""

    def nearest(p: M.Pair, at: dict[int, int]) -> Iterator[tuple]:
        for i in p.st.ids:
            wanted = set(_above(i, p.ud.heads))
            meet = next(((a, d) for d, a in enumerate(_above(i, p.st.heads), 1) if a in wanted), None)
            if meet:
                yield i, *meet

    return listed(rows, lambda p, at: list(nearest(p, at)), "id long, lca long, d long")


def inverted(rows: DataFrame) -> DataFrame:
    """As ``edges.inverted``."""
    return listed(rows, lambda p, at: list(p.mirrored), "lo long, hi long")


def swap_rows(rows: DataFrame, *columns: str) -> DataFrame:
    """As ``resolve.swap_rows`` on the str tree, the pairs being those that ud turns round; text ``columns`` go with the words."""
    names = ["sent_id", "id", "head", *columns]

    def moved(p: M.Pair, at: dict[int, int]) -> list[tuple]:
        new, words = swap_inverted({i: h or 0 for i, h in p.st.heads.items()}, sorted(p.mirrored))
        return [(i, new[i], at[words[i]]) for i in p.st.heads]

    def make() -> Work:
        shapes = Shapes(moved, 3)

        def work(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
            got, sent = shapes(batch, starts)
            at = got[:, 2] + starts[sent]
            return pa.RecordBatch.from_arrays([_take(batch.column("sent_id"), at), _array(got[:, 0]), _array(got[:, 1]), *[_take(batch.column(c), at) for c in columns]], names)

        return work

    return over_runs(rows.select(*TREES, *columns), make, f"sent_id string, id long, head long{''.join(f', {c} string' for c in columns)}")


def joined(rows: DataFrame, column: str, sign: str) -> DataFrame:
    """(sent_id, column): a sentence's texts in the order they stand, with ``sign`` between."""

    def make() -> Work:
        def work(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
            texts = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), batch.column(column))
            return pa.RecordBatch.from_arrays([_take(batch.column("sent_id"), starts[:-1]), pc.binary_join(texts, sign)], ["sent_id", column])

        return work

    return over_runs(rows.select("sent_id", column), make, f"sent_id string, {column} string")


def dependents(rows: DataFrame, wanted: str, trees: dict[str, tuple[str, str]]) -> DataFrame:
    """The rows where ``wanted`` holds, with the dependents that they have in each tree: for a name and its columns (head, relation)
    <name>_ids and <name>_rels, joined by commas in order of id, empty without any."""
    plain = [c for c in rows.columns if c != wanted]
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in plain], *[f"{t}_{x} string" for t in trees for x in ("ids", "rels")]])

    def make() -> Work:
        def work(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(_flags(batch, wanted))
            first = np.searchsorted(starts, at, "right") - 1
            ids, out = _longs(batch, "id"), []
            spans = list(zip(at.tolist(), starts[first].tolist(), starts[first + 1].tolist(), strict=True))
            for head, rel in trees.values():
                heads, rels, lists = _longs(batch, head), batch.column(rel), ([], [])
                for i, a, b in spans:
                    mine = a + np.flatnonzero(heads[a:b] == ids[i]) if ids[i] > 0 else []
                    named = sorted((int(ids[j]), rels[j].as_py()) for j in mine)
                    lists[0].append(",".join(str(x) for x, _ in named))
                    lists[1].append(",".join(x for _, x in named if x is not None))
                out += [pa.array(x, pa.string()) for x in lists]
            return pa.RecordBatch.from_arrays([*[_take(batch.column(c), at) for c in plain], *out], [x.split()[0] for x in schema.split(", ")])

        return work

    return over_runs(rows, make, schema)
