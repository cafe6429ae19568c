"""Result sets as files: tables, listings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import correspondence as P
from ..operators import together as T
from .conllu import read_blocks

MORPH, SYNTAX = ("UPOS", "Feats", "AllTags"), ("UAS", "LAS", "UCM", "LCM", "UAS_ELL", "LAS_ELL")


def write_csv(df: DataFrame, path: str, force: bool = False) -> None:
    """Comma separated with a header; what exists stays, unless ``force``."""
    df.write.mode("overwrite" if force else "ignore").option("header", True).option("escape", '"').csv(path)


def write_outcomes(df: DataFrame, path: str, outcome: str = "outcome") -> None:
    """Rows appended under a folder for each outcome (aligned, unaligned, not a tree, no source)."""
    df.write.mode("append").partitionBy(outcome).parquet(path)


def arcs(quad: DataFrame) -> DataFrame:
    """Twelve columns: both annotations' heads and relations, gold and predicted, of every token."""
    names = [F.col(f"{c}_{s}_{r}").alias(f"{s}_{role}_{c}") for s in ("ud", "str") for r, role in (("g", "test"), ("p", "preds")) for c in ("head", "deprel")]
    elided = F.when(F.col("upos_ud_g").isNotNull() & (F.col("upos_ud_g") != "_"), 0).otherwise(1)
    return quad.select(F.lower(F.coalesce("form", F.lit("_"))).alias("word"), *names, elided.alias("ellipsis"), "text", "sent_id")


def ellipsis_dump(quad: DataFrame, together: bool = False) -> DataFrame:
    """Each elided token with its head, relation and dependents in all four trees: one pass for each tree's dependents, by their heads.

    Where the rows of a sentence stand ``together`` there is one pass in all, and no join.
    """
    kinds = [(s, r) for s in ("ud", "str") for r in "gp"]
    named = lambda s, r: f"{s}_{'test' if r == 'g' else 'pred'}"
    if together:
        trees = {named(s, r): (f"head_{s}_{r}", f"deprel_{s}_{r}") for s, r in kinds}
        rows = quad.select("sent_id", "id", *[c for x in trees.values() for c in x], F.expr("coalesce(upos_ud_g, '_') = '_'").alias("elided"))
        each = [c for t, (h, r) in trees.items() for c in (F.col(h).alias(f"{t}_head"), F.col(r).alias(f"{t}_deprel"), F.col(f"{t}_ids").alias(f"{t}_deps_id"), F.col(f"{t}_rels").alias(f"{t}_deps_deprel"))]
        return T.dependents(rows, "elided", trees).select("id", *each, "sent_id")
    out = quad.where("coalesce(upos_ud_g, '_') = '_'")
    for s, r in kinds:
        kids = quad.where(F.col(f"head_{s}_{r}") > 0).groupBy("sent_id", F.col(f"head_{s}_{r}").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", F.col(f"deprel_{s}_{r}").alias("rel")))).alias(f"__{s}_{r}"))
        out = out.join(kids, ["sent_id", "id"], "left")
    listed = lambda s, r, field: F.coalesce(F.array_join(F.transform(f"__{s}_{r}", lambda x: x[field].cast("string")), ","), F.lit(""))
    each = [c for s, r in kinds for c in (F.col(f"head_{s}_{r}").alias(f"{named(s, r)}_head"), F.col(f"deprel_{s}_{r}").alias(f"{named(s, r)}_deprel"), listed(s, r, "id").alias(f"{named(s, r)}_deps_id"), listed(s, r, "rel").alias(f"{named(s, r)}_deps_deprel"))]
    return out.select("id", *each, "sent_id")


def listing(rows: DataFrame, title: str, fields: list[str]) -> DataFrame:
    """(sent_id, id, entry): a readable entry for each row, ``name: value`` lines under a title."""
    lines = [F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit("_"))) for f in fields]
    return rows.select("sent_id", "id", F.concat_ws("\n", F.lit(title), *lines, F.lit("-" * 10)).alias("entry"))


def write_listing(entries: DataFrame, path: str) -> None:
    entries.repartitionByRange("sent_id", "id").sortWithinPartitions("sent_id", "id").select(F.col("entry").alias("value")).write.text(path)


def write_correspondence(found: DataFrame, ud: DataFrame, st: DataFrame, path: str, mode: str, exclude_punct: bool = True) -> dict[str, str]:
    """Four tables under ``path``: comparison (11 columns), detailed matches (10), label confusion and coverage. Returns their places."""
    table = P.comparison(found, ud, st, exclude_punct)
    base = table.select("sent_id", "ud_id", "ud_form", "ud_head", "ud_deprel", "str_id", "str_form", "str_head", "str_deprel", "status", "comparable")
    detailed = found.select("sent_id", "ud_id", "ud_head", "str_id", "str_head", "status", "certification", "detail", "candidate_count", "support_count")
    rows = P.both(ud, st)
    sets = {
        f"compare_{mode}": base, f"compare_{mode}_detailed": detailed, f"label_confusion_{mode}": P.label_confusion(table).orderBy(F.desc("n"), "str_deprel", "ud_deprel"),
        f"coverage_{mode}": P.coverage(P.units(found, rows, include_punct=not exclude_punct), mode),
    }
    for name, df in sets.items():
        write_csv(df, f"{path}/{name}", force=True)
    return {name: f"{path}/{name}" for name in sets}


def write_aligned(found: DataFrame, ud: DataFrame, st: DataFrame, path: str) -> None:
    """Both annotations with ``aligned_id``, the partner's token, under ``path``."""
    forth, back = P.alignment(found, P.both(ud, st))
    write_csv(P.with_aligned(ud, forth), f"{path}/ud-aligned", force=True)
    write_csv(P.with_aligned(st, back), f"{path}/str-aligned", force=True)


def report(scores: DataFrame) -> DataFrame:
    """(run, corpus, block): a report's block for each corpus of a run, from rows (run, corpus, metric, value); the metrics in their fixed order."""
    order = F.array_position(F.array(*[F.lit(m) for m in (*MORPH, *SYNTAX)]), F.col("metric"))
    line = F.format_string("%-8s | %6.2f", "metric", F.bround("value", 2))
    by = scores.where(order > 0).groupBy("run", "corpus").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("line")))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: x["line"]), "\n")
    return by.select("run", "corpus", F.concat_ws("\n", F.concat(F.lit("Corpus: "), F.col("corpus")), F.lit("Metric   | Value"), F.lit("-" * 9 + "+" + "-" * 10), body).alias("block"))


def report_over_runs(summary: DataFrame) -> DataFrame:
    """(corpus, metric, line) from rows (corpus, metric, runs, mean, std)."""
    return summary.select("corpus", "metric", F.format_string("%-8s | %6.2f ± %.2f  (n=%d)", "metric", F.bround("mean", 2), F.bround("std", 2), "runs").alias("line"))


def concatenate(spark, paths: str | list[str], path: str) -> None:
    """All sentences of many CoNLL-U files as one set of files, in the order of files."""
    blocks = read_blocks(spark, paths)
    blocks.repartitionByRange("file", "part", "block_no").sortWithinPartitions("file", "part", "block_no").select(F.col("block").alias("value")).write.option("lineSep", "\n\n").text(path)
