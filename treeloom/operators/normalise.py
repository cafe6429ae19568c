"""One annotation's trees on the other's tokens.

The source's words are matched to the target's from left to right: quotes come off, a negative pronoun written apart is one word, ellipses are as
many as the target has, and a word may stand for several or in another place nearby. Heads follow the matches; punctuation is the target's. A
sentence that does not match gives its reason instead. Words refer to their heads, so nothing has to be renumbered on the way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DASHES, EDGE_QUOTES, STRIPPED

#: Negative pronouns, which may be written apart after the particle.
NEGATIVES = frozenset("незачем нечего некуда неоткуда некого некогда непочем нечем негде некому нечему".split())
PARTICLE, PLUS, AHEAD, GLUED, NEARBY = "не", frozenset("+＋±"), 3, 5, 6
_ROMAN, _WORDS = re.compile("[IVXLCDM]+", re.I), re.compile("[A-Za-zА-Яа-яЁё0-9]+")


@dataclass(eq=False)
class Word:
    form: str | None
    lemma: str | None = None
    upos: str | None = None
    feats: str | None = None
    rel: str | None = None
    head: Word | None = None

    @property
    def punct(self) -> bool:
        bare = (self.form or "").strip()
        if bare.lower() == "x" or bare == "×":
            return bare == "×"
        return not ("NumForm=Roman" in (self.feats or "") or _ROMAN.fullmatch(bare)) and (self.upos or "").upper() == "PUNCT"

    @property
    def elided(self) -> bool:
        return self.form in (None, "", "_") and not self.punct

    def hang(self, head: Word | None) -> None:
        """Under another word, where nothing is called root."""
        self.head = None if head is self else head
        if self.head is not None and (self.rel or "").lower() == "root":
            self.rel = "dep"


def _bare(form: str, dots: bool) -> str:
    gone = str.maketrans("", "", STRIPPED + DASHES + ("" if dots else "."))
    return re.sub(r"\s+", "", form.lower()).translate(gone)


def same_form(a: str | None, b: str | None) -> bool:
    """As ``columns.same_form``, for two strings."""
    x, y = ("_" if f in (None, "_") else f.strip(EDGE_QUOTES) for f in (a, b))
    bare = _bare(x, False), _bare(y, False)
    return {x, y} in ({"с", "со"}, {"к", "ко"}) or set(bare) in ({"е", "есть"}, {"к", "как"}) or bare[0] == bare[1] or _bare(x, True) == _bare(y, True)


def detach_quotes(words: list[Word]) -> list[Word]:
    """Quotes at the ends of a form as tokens of their own."""
    out = []
    for w in words:
        core = (w.form or "").strip(EDGE_QUOTES)
        if not w.form or core == w.form:
            out.append(w)
            continue
        lead = len(w.form) - len(w.form.lstrip(EDGE_QUOTES))
        quote = lambda c: Word(c, upos="PUNCT", rel="punct")
        out += map(quote, w.form[:lead])
        if core:
            tail = w.form[lead + len(core) :]
            w.form = core
            out += [w, *map(quote, tail)]
    return out


def _plain(form: str | None) -> str:
    return (form or "").lower().replace("ё", "е").strip("\"'“”«»„‚()[]{}.,;:!? \t\r\n")


def _absorb(words: list[Word], first: Word, second: Word, form: str | None) -> None:
    """``first`` becomes ``second``, which goes; what hung on it hangs on the first."""
    if first.head is second:
        first.head, first.rel = (None, "root") if second.head in (first, None) else (second.head, second.rel)
    first.form, first.lemma, first.upos, first.feats = form, second.lemma, second.upos, second.feats
    for w in words:
        if w.head is second and w is not first:
            w.hang(first)
    words.remove(second)


def merge_negatives(words: list[Word], target: list[Word]) -> list[Word]:
    """An ellipsis just before a negative pronoun takes its place, and a particle and its pronoun are one word, unless the target has them so too."""
    words = list(words)
    blank = lambda w: w.form in (None, "", "_") or (w.form or "").strip().lower() == "<x>"
    mark = lambda w: w.upos == "PUNCT" and (w.form or "").lower() not in ("x", "×")
    if not (any(w.elided for w in target) and any(map(blank, words))):
        for first in [w for w in words if blank(w)]:
            i = words.index(first)
            ahead = [w for w in words[i + 1 : i + 1 + AHEAD] if not mark(w)]
            second = next((w for w in ahead if _plain(w.form) in NEGATIVES), None)
            if second:
                _absorb(words, first, second, second.form)
    core = [_plain(w.form) for w in target if (w.upos or "") != "PUNCT"]
    if not any(a == PARTICLE and a + b in NEGATIVES for a, b in zip(core, core[1:], strict=False)):
        i = 0
        while i < len(words) - 1:
            first, second = words[i], words[i + 1]
            whole = PARTICLE + _plain(second.form)
            if not mark(first) and not mark(second) and _plain(first.form) == PARTICLE and whole in NEGATIVES:
                _absorb(words, first, second, whole)
            i += 1
    return words


def elided_runs(words: list[Word]) -> list[list[Word]]:
    """Ellipses that only punctuation stands between."""
    out, near = [], False
    for w in words:
        if w.elided:
            if near:
                out[-1].append(w)
            else:
                out.append([w])
            near = True
        elif (w.upos or "") != "PUNCT":
            near = False
    return out


def reconcile(words: list[Word], target: list[Word]) -> list[Word]:
    """As many ellipses in each run as the target's run of the same number has.

    Those stay that most words hang on, that hang on something, and that stand in the middle. What hung on one that goes hangs on the best one that
    stays, or where it hung; under a root that goes, the word that is root in the target takes over.
    """
    wanted = [len(r) for r in elided_runs(target)]
    top = next((w.form for w in target if w.head is None and not w.punct), None)
    gone: set[Word] = set()
    for k, run in enumerate(elided_runs(words)):
        want = wanted[k] if k < len(wanted) else 0
        if want >= len(run):
            continue
        below = {w: [c for c in words if c.head is w] for w in run}
        outside = lambda w: w.head is not None and w.head not in run
        rank = {w: (sum(c not in run and not c.elided for c in below[w]), outside(w), -abs(i - (len(run) - 1) / 2)) for i, w in enumerate(run)}
        ranked = sorted(run, key=lambda w: rank[w]) if want else run
        keep = ranked[len(run) - want :]
        best = next((w for w in reversed(keep) if outside(w)), keep[-1] if keep else None)
        for w in ranked[: len(run) - want]:
            gone.add(w)
            outer, inner = [c for c in below[w] if c not in run], [c for c in below[w] if c in (keep if want else run)]
            if w.head is None or (w.rel or "").lower() == "root":
                heirs = [c for c in outer if not c.punct and _plain(c.form) == _plain(top)] or [c for c in outer if not c.punct] or outer
                for c in outer + inner:
                    c.hang(heirs[0] if heirs else None)
                if heirs:
                    heirs[0].head, heirs[0].rel = None, "root"
            elif not want:
                for c in outer + inner:
                    c.hang(w.head if outside(w) else None)
            else:
                for c in outer:
                    c.hang(best)
                for c in inner:
                    c.hang(w.head if w.head in keep or outside(w) else best)
    for w in words:
        head, seen = w.head, set()
        while head in gone and head not in seen:
            seen.add(head)
            head = head.head
        if w not in gone and head is not w.head:
            w.hang(None if head in gone else head)
    return [w for w in words if w not in gone]


def _taken(word: Word, rest: list[Word]) -> int:
    """How many of the next source words make up a target word; 0 if none do."""
    bare = lambda w: (w.form or "").strip(EDGE_QUOTES)
    goal = bare(word)
    if same_form(bare(rest[0]), goal):
        return 1
    for n in (2, 3):
        some = rest[:n]
        if len(some) == n and not any(w.elided for w in some):
            if same_form("".join(map(bare, some)), goal):
                return n
            if n == 2 and any(d in (word.form or "") for d in DASHES) and same_form(bare(some[1]) + bare(some[0]), goal):
                return n
    spoken = lambda f: [x.lower() for x in _WORDS.findall(f or "")]
    if re.search("[\"«»,]", word.form or "") and len(spoken(word.form)) >= 2:
        for n in range(GLUED, 1, -1):
            some = rest[:n]
            if len(some) == n and not any(w.elided for w in some) and sorted(x for w in some for x in spoken(w.form)) == sorted(spoken(word.form)):
                return n
    return 0


def match(target: list[Word], words: list[Word]) -> tuple[list[list[Word]], str | None]:
    """The source words of each target word that is no punctuation, and why there are none."""
    core, rest, out = [w for w in target if not w.punct], [w for w in words if not w.punct], []
    marks = {(w.form or "").strip() for w in target if w.punct}
    while len(out) < len(core):
        u = core[len(out)]
        if not rest:
            return [], f"source ends before word {len(out)}"
        s = rest[0]
        if ((s.form or "").strip() in PLUS or (s.form or "").strip() in marks) and not same_form(s.form, u.form):
            rest.pop(0)
        elif u.elided and not s.elided:
            return [], f"no ellipsis for word {len(out)}, but {s.form!r}"
        elif n := 1 if u.elided else _taken(u, rest):
            out.append(rest[:n])
            del rest[:n]
        else:
            # the word may stand a little later, before any ellipsis
            near = rest[1:NEARBY]
            near = near[: next((i for i, w in enumerate(near) if w.elided), len(near))]
            later = next((w for w in near if same_form(w.form, u.form)), None)
            if later is None:
                return [], f"word {len(out)} {u.form!r} meets {s.form!r}"
            rest.remove(later)
            rest.insert(0, later)
    return (out, None) if not rest else ([], f"{len(rest)} source words are left")


def normalise(target: list[Word], words: list[Word]) -> tuple[list[Word], str | None]:
    """The source's tree on the target's tokens: words with heads among themselves, or a reason."""
    words = reconcile(merge_negatives(detach_quotes(words), target), target)
    groups, why = match(target, words)
    if why:
        return [], why
    core = [w for w in target if not w.punct]
    owner = {s: k for k, group in enumerate(groups) for s in group}
    made = {u: Word(u.form, g[-1].lemma, g[-1].upos, g[-1].feats, g[-1].rel) for u, g in zip(core, groups, strict=True)}
    for k, (u, group) in enumerate(zip(core, groups, strict=True)):
        head, seen = group[-1].head, set()
        while head is not None and head not in seen and owner.get(head, k) == k:
            seen.add(head)
            head = head.head
        new = made[u]
        if head is not None and head in owner and owner[head] != k:
            new.hang(made[core[owner[head]]])
        elif (group[-1].form or "").strip().lower() == "x" and u.head in made:
            new.head, new.rel = made[u.head], u.rel
        else:
            new.rel = "root"
    out = []
    for i, u in enumerate(target):
        if u in made:
            out.append(made[u])
            continue
        beside = [w for w in target[i + 1 :] if w in made] or [w for w in reversed(target[:i]) if w in made]
        out.append(Word(u.form, upos="PUNCT", rel="punct", head=made.get(u.head) or (made[beside[0]] if beside else None)))
    return out, None


def _read(rows: list[dict]) -> list[Word]:
    rows = sorted(rows, key=lambda r: r["id"])
    words = {r["id"]: Word(r["form"], r["lemma"], r["upos"], r["feats"], r["deprel"]) for r in rows}
    for r in rows:
        words[r["id"]].head = words.get(r["head"])
    return list(words.values())


def normalise_tokens(target: DataFrame, source: DataFrame) -> DataFrame:
    """(sent_id, id, form, lemma, upos, feats, head, deprel, reason) from two tables of these columns: one shuffle brings a sentence's rows together.

    A sentence that does not match, or that only the target has, is one row with a reason and no token.
    """
    fields = ["id", "form", "lemma", "upos", "feats", "head", "deprel"]
    side = lambda t, k: t.select("sent_id", F.struct(F.lit(k).alias("side"), *[F.col(c).cast("long").alias(c) if c in ("id", "head") else F.col(c) for c in fields]).alias("x"))
    packed = side(target, 0).unionByName(side(source, 1)).groupBy("sent_id").agg(F.collect_list("x").alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sent, rows in zip(batch.column("sent_id").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                goal, words = (_read([r for r in rows if r["side"] == k]) for k in (0, 1))
                if not goal:
                    continue
                got, why = normalise(goal, words) if words else ([], "no source")
                place = {w: i for i, w in enumerate(got, 1)}
                out += [(sent, i, w.form, w.lemma, w.upos, w.feats, place[w.head] if w.head else 0, w.rel, None) for w, i in place.items()] or [(sent, *[None] * 7, why)]
            columns = list(zip(*out, strict=True)) if out else [()] * 9
            kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), *[pa.string()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["sent_id", *fields, "reason"])

    return packed.mapInArrow(run, "sent_id string, id long, form string, lemma string, upos string, feats string, head long, deprel string, reason string")
