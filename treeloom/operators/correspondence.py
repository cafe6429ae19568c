"""Correspondence of the edges of two annotations, and the tables made from it.

The tokens of a sentence become one row (one shuffle, by sentence); a matcher of ``matching`` sees one sentence at a time, as Arrow columns. Its
result is a table of matches, and everything after it is joins and aggregates again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import percent
from . import matching as M

SHAPES = 2000
RESOLVED = ("exact_same_dir", "exact_mirrored", "restructured")
MATCHES = "sent_id string, ud_lo long, ud_hi long, ud_id long, ud_head long, str_lo long, str_hi long, str_id long, str_head long, status string, certification string, detail string, candidate_count long, support_count long"
CANDIDATES = "sent_id string, ud_lo long, ud_hi long, str_lo long, str_hi long, sources string"


def punct(upos: Column, deprel: Column) -> Column:
    # lengths first: to fold a token's case costs more than all else of its row
    return F.coalesce((F.length(deprel) == 5) & (F.lower(deprel) == "punct"), F.lit(False)) | F.coalesce((F.length(upos) == 5) & (F.upper(upos) == "PUNCT"), F.lit(False))


def both(ud: DataFrame, st: DataFrame) -> DataFrame:
    """Rows (sent_id, id, head_ud, head_str, punct) of two tables (sent_id, id, head, deprel, upos); the other side's head is null.

    No join: packing brings the sides together.
    """
    none = F.lit(None).cast("long")
    head = F.coalesce(F.col("head").cast("long"), F.lit(0))
    a = ud.select("sent_id", F.col("id").cast("long").alias("id"), head.alias("head_ud"), none.alias("head_str"), punct(F.col("upos"), F.col("deprel")).alias("punct"))
    return a.unionByName(st.select("sent_id", F.col("id").cast("long").alias("id"), none.alias("head_ud"), head.alias("head_str"), F.lit(False).alias("punct")))


def packed(rows: DataFrame) -> DataFrame:
    """One row for each sentence: sent_id, tokens."""
    return rows.groupBy("sent_id").agg(F.collect_list(F.struct("id", "head_ud", "head_str", "punct")).alias("tokens"))


def over_sentences(sentences: DataFrame, f: Callable[[M.Pair], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows of ``f`` for each sentence, the sentence's id before them."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string() if x.split()[1] == "string" else pa.int64() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, out = batch.column("tokens"), []
            flat = tokens.flatten()
            ids, uds, sts, flags = (flat.field(k).to_pylist() for k in range(4))
            at = 0
            for sent, size in zip(batch.column("sent_id").to_pylist(), tokens.value_lengths().to_pylist(), strict=True):
                mine = sorted(range(at, at + size), key=lambda i: ids[i])
                at += size
                ud, st = M.Tree((ids[i], uds[i]) for i in mine if uds[i] is not None), M.Tree((ids[i], sts[i]) for i in mine if sts[i] is not None)
                out += [(sent, *row) for row in f(M.Pair(ud, st, frozenset(ids[i] for i in mine if flags[i])))]
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return sentences.select("sent_id", "tokens").mapInArrow(run, schema)


def matches(sentences: DataFrame, mode: str = "strict", **options) -> DataFrame:
    """Every ud edge with its str edge under a mode of ``matching.MODES``; ``options`` go to the matcher."""

    seen: dict[tuple, list[tuple]] = {}

    def rows(p: M.Pair) -> list[tuple]:
        # short sentences often are alike: of a shape that a task has met lately the result is at hand
        shape = tuple(p.ud.heads.items()), tuple(p.st.heads.items()), p.punct if mode == "certified" else None
        if shape not in seen:
            if len(seen) >= SHAPES:
                seen.clear()
            out = seen[shape] = []
            for m in M.MODES[mode](p, **options):
                h, d = p.ud.arcs[m.ud]
                sh, sd = p.st.arcs[m.st] if m.st else (None, None)
                out.append((*m.ud, d, h, *(m.st or (None, None)), sd, sh, m.status, m.certification, m.detail, m.candidates, m.support))
        return seen[shape]

    return over_sentences(sentences, rows, MATCHES)


FAMILIES: dict[str, Callable[[M.Pair], M.Family]] = {
    "strict_plus": M.chain, "head_bridge": M.head_bridge, "mirror_swap": M.mirror_swap, "mirror_relative": M.mirror_relative, "root_path": M.root_path,
    "order_residual": lambda p: M.order_residual(p, p.open, p.shared), "lca": M.lca,
}


def candidates(sentences: DataFrame, *families: str) -> DataFrame:
    """Candidate edges with the names of the families that propose them, in order, joined by commas."""

    def rows(p: M.Pair) -> Iterator[tuple]:
        found: dict[tuple, list[str]] = {}
        for name in sorted(families):
            for u, pool in FAMILIES[name](p).items():
                for s in pool:
                    found.setdefault((*u, *s), []).append(name)
        for key, names in found.items():
            yield (*key, ",".join(names))

    return over_sentences(sentences, rows, CANDIDATES)


def lca_candidates(sentences: DataFrame, most: int | None = 3) -> DataFrame:
    """Candidates on the paths to the nearest common ancestor, of at most ``most`` + 1 edges."""
    return over_sentences(sentences, lambda p: ((*u, *s, "lca") for u, pool in M.lca(p, most).items() for s in pool), CANDIDATES).drop("sources")


def comparison(found: DataFrame, ud: DataFrame, st: DataFrame, exclude_punct: bool = True) -> DataFrame:
    """Each ud token that depends on another with what its edge's counterpart has in str: 15 columns."""
    left = ud.select("sent_id", F.col("id").alias("ud_id"), F.col("form").alias("ud_form"), F.col("deprel").alias("ud_deprel"), punct(F.col("upos"), F.col("deprel")).alias("__p"))
    right = st.select("sent_id", F.col("id").alias("str_id"), F.col("form").alias("str_form"), F.col("deprel").alias("str_deprel"))
    out = found.join(left.where(~F.col("__p")) if exclude_punct else left, ["sent_id", "ud_id"]).join(right, ["sent_id", "str_id"], "left")
    return out.withColumn("comparable", F.col("status").isin(*RESOLVED)).select(
        "sent_id", "ud_id", "ud_form", "ud_head", "ud_deprel", "str_id", "str_form", "str_head", "str_deprel",
        "status", "certification", "detail", "candidate_count", "support_count", "comparable",
    )


def label_confusion(table: DataFrame, certification: tuple[str, ...] | None = None) -> DataFrame:
    """Pairs of relations over the comparable rows of ``comparison``, null relations included."""
    rows = table.where("comparable")
    if certification is not None:
        rows = rows.where(F.col("certification").isin(*certification))
    return rows.groupBy("str_deprel", "ud_deprel").agg(F.count(F.lit(1)).alias("n"))


def roots(rows: DataFrame) -> DataFrame:
    """Tokens of ``both`` that depend on none in ud, and whether they do not in str either: a root has no head above 0 in its row."""
    by = rows.groupBy("sent_id", "id").agg(F.max("head_ud").alias("u"), F.max("head_str").alias("s"), F.max("punct").alias("punct"))
    return by.where("u <= 0").select("sent_id", F.col("id").alias("ud_id"), (F.coalesce(F.col("s"), F.lit(1)) <= 0).alias("in_both"), "punct")


def units(found: DataFrame, rows: DataFrame, include_punct: bool = False, include_root: bool = True, mask: DataFrame | None = None) -> DataFrame:
    """(sent_id, ud_id, status, certification) of the tokens that coverage counts: those with an edge and, if wanted, the roots."""
    out = found.select("sent_id", "ud_id", "status", "certification")
    if not include_punct:
        out = out.join(rows.where("punct").select("sent_id", F.col("id").alias("ud_id")), ["sent_id", "ud_id"], "left_anti")
    if include_root:
        top = roots(rows)
        top = top if include_punct else top.where("not punct")
        status, sure = F.when(F.col("in_both"), "exact_same_dir").otherwise("unresolved"), F.when(F.col("in_both"), "strict").otherwise("candidate_gap")
        out = out.unionByName(top.select("sent_id", "ud_id", status.alias("status"), sure.alias("certification")))
    return out if mask is None else out.join(mask.select("sent_id", F.col("id").alias("ud_id")), ["sent_id", "ud_id"], "left_semi")


def coverage(counted: DataFrame, mode: str) -> DataFrame:
    """One row of 14 columns: counts by status and by certification, and the shares resolved and with the same head."""
    n = lambda column, value: F.count_if(F.col(column) == value)
    out = counted.agg(
        F.count(F.lit(1)).alias("total"),
        *[n("status", s).alias(s) for s in (*RESOLVED, "ambiguous", "candidate_gap", "unresolved")],
        n("certification", "strict").alias("strict"), n("certification", "heuristic").alias("heuristic"),
        n("certification", "ambiguous").alias("ambiguous_cert"), n("certification", "candidate_gap").alias("candidate_gap_cert"),
    )
    share = lambda x: F.coalesce(percent(x, F.col("total")), F.lit(0.0))
    done = F.col("exact_same_dir") + F.col("exact_mirrored") + F.col("restructured")
    return out.select(F.lit(mode).alias("mode"), "*", share(done).alias("resolved_pct"), share(F.col("exact_same_dir")).alias("baseline_pct"))


def certification_shares(counted: DataFrame, mode: str) -> DataFrame:
    """One row: counts and percentages by certification."""
    names = ("strict", "heuristic", "ambiguous", "candidate_gap")
    out = counted.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("certification") == x).alias(x) for x in names])
    return out.select(F.lit(mode).alias("mode"), "*", *[F.coalesce(percent(F.col(x), F.col("total")), F.lit(0.0)).alias(f"{x}_pct") for x in names])


def diagnosis(first: DataFrame, second: DataFrame, rows: DataFrame) -> DataFrame:
    """Per sentence the category 1 to 5 that two match tables of the same edges give, and how many tokens fall into each.

    1: the first has all edges the same way; 2: it has all, and so has the second; 3: only the second has all; 4: only the first; 5: neither.
    A token's case is the same question about its own edge; punctuation is left out of these and roots count by both trees.
    """
    a = first.groupBy("sent_id").agg(F.count_if(F.col("status") == "unresolved").alias("open_1"), F.count_if(F.col("status") != "exact_same_dir").alias("other_1"))
    b = second.groupBy("sent_id").agg(F.count_if(F.col("status") == "unresolved").alias("open_2"))
    category = F.when(F.col("other_1") == 0, 1).when((F.col("open_1") == 0) & (F.col("open_2") == 0), 2).when(F.col("open_2") == 0, 3).when(F.col("open_1") == 0, 4).otherwise(5)
    tokens = units(first, rows).select("sent_id", "ud_id", F.col("status").alias("s1")).join(units(second, rows).select("sent_id", "ud_id", F.col("status").alias("s2")), ["sent_id", "ud_id"], "full_outer")
    done = lambda c: F.coalesce(F.col(c).isin(*RESOLVED), F.lit(False))
    case = F.when(F.col("s1") == "exact_same_dir", 1).when(done("s1") & done("s2"), 2).when(done("s2"), 3).when(done("s1"), 4).otherwise(5)
    cases = tokens.withColumn("case", case).groupBy("sent_id").agg(F.count(F.lit(1)).alias("meaningful"), *[F.count_if(F.col("case") == k).alias(f"case_{k}") for k in range(1, 6)])
    out = a.join(b, "sent_id").select("sent_id", category.cast("long").alias("category")).join(cases, "sent_id", "left")
    return out.fillna(0, ["meaningful", *[f"case_{k}" for k in range(1, 6)]])


def category_summary(diagnosed: DataFrame) -> DataFrame:
    """Five rows: sentences and tokens of each category with their percentages; 0 for those that do not occur."""
    spark = diagnosed.sparkSession
    total = diagnosed.agg(F.count(F.lit(1)).alias("all_sentences"), F.coalesce(F.sum("meaningful"), F.lit(0)).alias("all_tokens"), *[F.coalesce(F.sum(f"case_{k}"), F.lit(0)).alias(f"t{k}") for k in range(1, 6)])
    by = diagnosed.groupBy("category").agg(F.count(F.lit(1)).alias("sentences"))
    out = spark.range(1, 6).select(F.col("id").alias("category")).join(by, "category", "left").crossJoin(F.broadcast(total))
    tokens = F.element_at(F.array(*[F.col(f"t{k}") for k in range(1, 6)]), F.col("category").cast("int"))
    out = out.withColumns({"sentences": F.coalesce("sentences", F.lit(0)), "tokens": tokens})
    share = lambda x, y: F.coalesce(percent(F.col(x), F.col(y)), F.lit(0.0))
    return out.select("category", "sentences", share("sentences", "all_sentences").alias("sentences_pct"), "tokens", share("tokens", "all_tokens").alias("tokens_pct"))


def examples(diagnosed: DataFrame, sizes: DataFrame, per_category: int = 1, least: int = 4, most: int = 12) -> DataFrame:
    """The shortest sentences of each category among those of ``least`` to ``most`` tokens; ``sizes``: sent_id, n."""
    some = diagnosed.select("sent_id", "category").join(sizes.where(F.col("n").between(least, most)), "sent_id")
    w = Window.partitionBy("category").orderBy("n", "sent_id")
    return some.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= per_category)


def alignment(found: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Maps (sent_id, id, aligned_id) from ud to str and back: dependents of matched edges, a single root to a single root, or equal roots.

    Back goes only what one ud token claims.
    """
    m = found.where("str_id is not null").select("sent_id", F.col("ud_id").alias("id"), F.col("str_id").alias("aligned_id"))
    by = rows.groupBy("sent_id", "id").agg(F.max("head_ud").alias("u"), F.max("head_str").alias("s"))
    tops = by.where("u <= 0 or s <= 0").groupBy("sent_id").agg(F.collect_set(F.when(F.col("u") <= 0, F.col("id"))).alias("a"), F.collect_set(F.when(F.col("s") <= 0, F.col("id"))).alias("b"))
    single = (F.size("a") == 1) & (F.size("b") == 1)
    pairs = F.when(single, F.arrays_zip(F.col("a").alias("x"), F.col("b").alias("y"))).otherwise(F.transform(F.array_intersect("a", "b"), lambda x: F.struct(x.alias("x"), x.alias("y"))))
    top = tops.select("sent_id", F.explode(pairs).alias("p")).select("sent_id", F.col("p.x").alias("id"), F.col("p.y").alias("aligned_id"))
    forth = m.unionByName(top.join(m.select("sent_id", "id"), ["sent_id", "id"], "left_anti"))
    back = forth.groupBy("sent_id", "aligned_id").agg(F.count_distinct("id").alias("k"), F.min("id").alias("id")).where("k = 1")
    return forth, back.select("sent_id", F.col("aligned_id").alias("id"), F.col("id").alias("aligned_id"))


def with_aligned(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """``table`` (sent_id, id, ...) with ``aligned_id``, null where there is none."""
    return table.join(pairs, ["sent_id", "id"], "left")


def token_links(found: DataFrame, ud: DataFrame, st: DataFrame, include_root: bool = True) -> DataFrame:
    """(sent_id, ud_id, str_id) as pictures show them: the dependents of matched edges without punctuation on either side, and the first roots joined."""
    marks = lambda t, name: t.where(punct(F.col("upos"), F.col("deprel"))).select("sent_id", F.col("id").alias(name))
    out = found.where("str_id is not null").select("sent_id", "ud_id", "str_id")
    out = out.join(marks(ud, "ud_id"), ["sent_id", "ud_id"], "left_anti").join(marks(st, "str_id"), ["sent_id", "str_id"], "left_anti")
    if not include_root:
        return out.select("sent_id", "ud_id", "str_id")
    top = lambda t, name: t.where("head = 0").groupBy("sent_id").agg(F.min("id").alias(name))
    tops = top(ud, "ud_id").join(top(st, "str_id"), "sent_id")
    # the roots' link takes the place of one that the ud root has already
    rest = out.join(tops.select("sent_id", "ud_id"), ["sent_id", "ud_id"], "left_anti")
    return rest.select("sent_id", "ud_id", "str_id").unionByName(tops)


def gold_check(gold: DataFrame, links: DataFrame, ud: DataFrame, st: DataFrame) -> DataFrame:
    """Every link that ``gold`` expects or ``links`` has (both: sent_id, ud_id, str_id), in gold's sentences, with forms and whether they agree."""
    mine = links.join(gold.select("sent_id").distinct(), "sent_id", "left_semi")
    both_ = gold.withColumnRenamed("str_id", "expected_str_id").join(mine.withColumnRenamed("str_id", "actual_str_id"), ["sent_id", "ud_id"], "full_outer")
    form = lambda t, key, name: t.select("sent_id", F.col("id").alias(key), F.col("form").alias(name))
    out = both_.join(form(ud, "ud_id", "ud_form"), ["sent_id", "ud_id"], "left")
    for side in ("expected", "actual"):
        out = out.join(form(st, f"{side}_str_id", f"{side}_str_form"), ["sent_id", f"{side}_str_id"], "left")
    ok = F.col("expected_str_id").eqNullSafe(F.col("actual_str_id"))
    return out.select("sent_id", "ud_id", "ud_form", "expected_str_id", "expected_str_form", "actual_str_id", "actual_str_form", ok.alias("ok"))
