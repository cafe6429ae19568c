"""Trees rewritten where two annotations turn an edge round."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edges import _by_sentence


def swap_inverted(heads: dict[int, int], pairs: list[tuple[int, int]]) -> tuple[dict[int, int], dict[int, int]]:
    """Heads after each pair in turn has changed places, and which token's words now stand where.

    The two exchange all but their ids. If one hangs on the other, the lower one now hangs where the upper one did, the upper one hangs on it, and
    what hung on either hangs on the other.
    """
    heads, words = dict(heads), {i: i for i in heads}
    for a, b in pairs:
        if a not in heads or b not in heads:
            continue
        words[a], words[b] = words[b], words[a]
        if heads[a] == b:
            low, up = a, b
        elif heads[b] == a:
            low, up = b, a
        else:
            continue
        top, other = heads[up], {low: up, up: low}
        heads = {i: other.get(h, h) for i, h in heads.items()}
        heads[up], heads[low] = low, top
    return heads, words


def swap_rows(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """``tokens`` (sent_id, id, head, ...) with each pair (sent_id, lo, hi) exchanged, sentence by sentence, in the order of pairs."""
    none = F.lit(None).cast("long")
    rows = tokens.select("sent_id", "id", "head", none.alias("hi")).unionByName(pairs.select("sent_id", F.col("lo").alias("id"), none.alias("head"), F.col("hi")))

    def rewrite(ids: list[int], heads: list[int], his: list[int]) -> Iterator[tuple]:
        tree = {i: h or 0 for i, h, other in zip(ids, heads, his, strict=True) if other is None}
        new, words = swap_inverted(tree, sorted((i, o) for i, o in zip(ids, his, strict=True) if o is not None))
        return ((i, words[i], new[i]) for i in tree)

    placed = _by_sentence(rows, ["id", "head", "hi"], rewrite, "id long, source long, head long")
    rest = tokens.select("sent_id", F.col("id").alias("source"), *[c for c in tokens.columns if c not in ("sent_id", "id", "head")])
    return placed.join(rest, ["sent_id", "source"]).select(*tokens.columns)
