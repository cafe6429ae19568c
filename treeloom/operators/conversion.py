"""Enhanced graphs as trees with ellipsis nodes, and relations of former roots."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grams import QUANTITY, relation

#: Relations that a tree knows, without subtypes.
BASIC = frozenset(
    "acl advcl advmod amod appos aux case cc ccomp compound conj cop csubj dep det discourse dislocated expl fixed flat iobj list mark nmod nsubj nummod obj obl orphan parataxis punct root vocative xcomp".split()
)


def _place(token: str) -> tuple[int, int]:
    whole, _, part = token.partition(".")
    return (int(whole), int(part or 0)) if whole.isdigit() and (not part or part.isdigit()) else (10**9, 10**9)


def _basic(rel: str | None) -> str | None:
    base = (rel or "").strip().split(":")[0]
    return base if base in BASIC else None


def _empty(token: str) -> bool:
    return "." in token


class _Sentence:
    """Heads and relations on the way from an enhanced graph to a tree; ids are strings, those of ellipsis nodes hold a point."""

    def __init__(self, rows: Iterable[tuple[str, str | None, str | None, str | None]]):
        self.head: dict[str, str | None] = {}
        self.rel: dict[str, str | None] = {}
        self.deps: dict[str, list[tuple[str, str]]] = {}
        for token, head, rel, deps in rows:
            self.head[token], self.rel[token] = head, rel
            pairs = [d.split(":", 1) for d in (deps or "").split("|") if ":" in d]
            self.deps[token] = [(h, base) for h, r in pairs if (base := _basic(r))]
        plain = [t for t in self.head if not _empty(t)]
        self.top = next((t for t in plain if self.head[t] == "0"), min(plain, key=_place, default="1"))
        #: where ellipsis nodes hang already
        self.hung: dict[str, str] = {}

    def cycles(self, start: str | None, target: str, hung: dict[str, str]) -> bool:
        """Whether the way up from ``start`` comes to ``target`` or never ends."""
        seen = set()
        while start and start != "0":
            if start == target or start in seen:
                return True
            seen.add(start)
            start = hung.get(start) if _empty(start) else self.head.get(start)
        return False

    def offers(self, token: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
        """Enhanced heads of a token that are ellipsis nodes, and others; one that repeats the token's own relation counts only at its own head or an ellipsis."""
        own = _basic(self.rel[token]) or (self.rel[token] or "dep").split(":")[0]
        elided, plain = [], []
        for h, r in self.deps[token]:
            at_home = h == self.head[token]
            if _empty(h) and not (r == own and at_home):
                elided.append((h, r))
            elif r != own or at_home or self.head[token] is None:
                plain.append((h, r))
        return sorted(elided, key=lambda x: _place(x[0])), sorted(plain, key=lambda x: _place(x[0]))

    def convert(self) -> None:
        plain = [t for t in self.head if not _empty(t)]
        nodes = sorted((t for t in self.head if _empty(t)), key=_place)
        below: dict[str, list[tuple[str, str]]] = {e: [] for e in nodes}
        offers = {t: self.offers(t) for t in plain}
        heads_of = {e: {h for h, _ in self.deps[e] if h in self.head} for e in nodes}
        for t in plain:
            elided, others = offers[t]
            own = (self.rel[t] or "dep").split(":")[0]
            if not elided:
                if own == "orphan" and others:
                    self.head[t], self.rel[t] = next((x for x in others if x[1] != "case"), others[0])
                continue
            # an ellipsis that hangs on the token alone cannot be its head
            elided = [x for x in elided if heads_of.get(x[0]) != {t}]
            if elided:
                e, rel = next((x for x in elided if x[1] == own), elided[0])
                below.get(e, []).append((t, rel))
        for e in nodes:
            self.hang(e, [t for t, _ in below[e]])
            for t, rel in below[e]:
                self.attach(t, e, rel, offers[t][1])
        roots = [t for t in self.head if self.head[t] == "0"]
        elided = [t for t in roots if _empty(t)]
        if len(roots) > 1 and elided and len(elided) < len(roots):
            for t in roots:
                if not _empty(t):
                    self.head[t], self.rel[t] = elided[0], "TEMP"

    def hang(self, node: str, below: list[str]) -> None:
        """The head of an ellipsis node: none of its future dependents, without a cycle if possible; other ellipses before words, conjuncts first."""
        known = [(h, r) for h, r in self.deps[node] if h in self.head]
        free = [x for x in known if x[0] not in below]
        safe = [x for x in free if not self.cycles(x[0], node, self.hung | {node: x[0]})] or free or known
        wants_top = ("0", "root") in self.deps[node]
        if safe:
            head, rel = min(safe, key=lambda x: (not _empty(x[0]), x[1] != "conj", _place(x[0])))
        elif wants_top:
            head, rel = "0", "root"
            self.top = node
        else:
            head, rel = self.top, "dep"
        self.head[node], self.rel[node] = head, rel
        self.hung[node] = head

    def attach(self, token: str, node: str, rel: str, others: list[tuple[str, str]]) -> None:
        """Under the ellipsis node, or what keeps a tree: its head, another enhanced head, the old place, the root."""
        old = self.head[token], (self.rel[token] or "dep").split(":")[0]
        other = next((x for x in others if x[1] != "case"), None)
        ways = [(node, rel), (self.hung.get(node), rel), *([other] if other else []), *([old] if old[1] in BASIC else [])]
        for head, how in ways:
            if head and not self.cycles(head, token, self.hung):
                self.head[token], self.rel[token] = head, how
                return
        self.head[token], self.rel[token] = self.top, "dep"


def enhanced_to_basic(tokens: DataFrame) -> DataFrame:
    """``tokens`` (sent_id, id, head, deprel, deps, ...; ids and heads strings, deps ``head:rel|head:rel``) with head and deprel of a tree, ellipsis nodes included.

    A second root beside an elided one hangs on that, as ``TEMP``; ``repair_roots`` names it. One shuffle by sentence, and a join back.
    """
    packed = tokens.groupBy("sent_id").agg(F.collect_list(F.struct("id", "head", "deprel", "deps")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sent, rows in zip(batch.column("sent_id").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                s = _Sentence((r["id"], r["head"], r["deprel"], r["deps"]) for r in sorted(rows, key=lambda r: _place(r["id"])))
                s.convert()
                out += [(sent, t, s.head[t], s.rel[t]) for t in s.head]
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["sent_id", "id", "head", "deprel"])

    trees = packed.mapInArrow(run, "sent_id string, id string, head string, deprel string")
    rest = tokens.select("sent_id", "id", *[c for c in tokens.columns if c not in ("sent_id", "id", "head", "deprel")])
    return trees.join(rest, ["sent_id", "id"]).select(*tokens.columns)


def repair_roots(tokens: DataFrame, partners: DataFrame, feature: Callable | None = None) -> DataFrame:
    """``tokens`` (sent_id, id, form, lemma, upos, feats, head, deprel) with a relation for each ``TEMP`` whose head has a partner (sent_id, id, upos, lemma).

    Whether a token has a relative pronoun or a preposition below it, and whether its sentence has a word of quantity, are aggregates over its sentence.
    """
    from ..functions.columns import last_feature

    value = feature or last_feature
    named = lambda name: F.nullif(value(F.col("feats"), name), F.lit("∅"))
    below = tokens.groupBy("sent_id", F.col("head").alias("id")).agg(
        F.coalesce(F.bool_or(named("PronType") == "Rel"), F.lit(False)).alias("has_relative"),
        F.coalesce(F.bool_or((F.col("upos") == "ADP") & (F.col("deprel") == "case")), F.lit(False)).alias("has_preposition"),
    )
    words = tokens.groupBy("sent_id").agg(F.coalesce(F.bool_or(F.lower(F.coalesce("lemma", "form")).isin(*QUANTITY)), F.lit(False)).alias("has_quantity"))
    heads = partners.select("sent_id", F.col("id").alias("head"), F.col("upos").alias("head_upos"), F.coalesce("lemma", F.lit("")).alias("head_lemma"), F.lit(True).alias("known"))
    j = tokens.join(below, ["sent_id", "id"], "left").join(words, "sent_id").join(heads, ["sent_id", "head"], "left")
    j = j.fillna(False, ["has_relative", "has_preposition", "known"]).withColumns({"gcase": named("Case"), "verbform": named("VerbForm"), "voice": named("Залог")})
    new = F.when((F.upper("deprel") == "TEMP") & F.col("known"), relation()).otherwise(F.col("deprel"))
    return j.withColumn("deprel", new).select(*tokens.columns)
