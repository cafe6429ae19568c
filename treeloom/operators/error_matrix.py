"""Error matrices over subsets of data, ranks and label confusions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import correct, percent, wrong
from .written import written


def with_full(rows: DataFrame, subset: str = "subset") -> DataFrame:
    """Each row once more under the subset 'full'; one pass, no union of scans."""
    return rows.withColumn(subset, F.explode(F.array(F.col(subset), F.lit("full"))))


def _within(subset: str, column: Column | None = None) -> Column:
    """Whether a row is of a subset; 'full' has all."""
    own = F.lit(True) if subset == "full" else F.col("subset") == subset
    return own if column is None else own & column


def matrix(quad: DataFrame, keys: list[str], whole: list[str], is_error: Column, subsets: tuple[str, ...] = ("full", "old", "new"), judged: tuple[str, ...] | None = None, min_count: int = 10, min_percent: float = 1.0) -> DataFrame:
    """Errors by ``keys`` with a count and a percentage of the ``whole`` group in each subset; ``whole`` are some of the keys.

    A cell is 0 where the whole group exists without errors and null where it does not; ``total`` adds the counts before that.
    Kept are rows with more than ``min_count`` errors in a judged subset and more than ``min_percent`` in one. Null keys drop out.
    Tokens are read and aggregated once; sizes of whole groups are sums over the cells.
    """
    judged = judged or subsets
    cells = quad.groupBy(*keys).agg(*[F.count_if(_within(s, is_error)).alias(f"{s}_n") for s in subsets], *[F.count_if(_within(s)).alias(f"{s}_k") for s in subsets])
    w = Window.partitionBy(*whole)
    out = cells.withColumns({f"{s}_all": F.sum(f"{s}_k").over(w) for s in subsets}).withColumn("total", reduce(lambda a, b: a + b, [F.col(f"{s}_n") for s in subsets]))
    out = out.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys]) & (F.col("total") > 0))
    for s in subsets:
        out = out.withColumn(f"{s}_pct", percent(F.col(f"{s}_n"), F.col(f"{s}_all"))).withColumn(f"{s}_n", F.when(F.col(f"{s}_all") > 0, F.col(f"{s}_n")))
    enough = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"{s}_n") > min_count, F.lit(False)) for s in judged])
    share = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"{s}_pct") > min_percent, F.lit(False)) for s in judged])
    return out.where(enough & share).select(*keys, *[f"{s}_n" for s in subsets], *[f"{s}_pct" for s in subsets], "total")


def triplets(quad: DataFrame, tag: str, judged: tuple[str, ...] | None = None) -> DataFrame:
    """Where str is right and ud is wrong: by gold str, gold ud, predicted ud; percent of the two golds."""
    c = lambda s: F.col(f"{tag}_{s}")
    return matrix(quad, [f"{tag}_str_g", f"{tag}_ud_g", f"{tag}_ud_p"], [f"{tag}_str_g", f"{tag}_ud_g"], correct(c("str_g"), c("str_p")) & wrong(c("ud_g"), c("ud_p")), judged=judged)


def duplets(quad: DataFrame, tag: str) -> DataFrame:
    """Where ud is wrong: by gold and predicted; percent of the gold."""
    return matrix(quad, [f"{tag}_ud_g", f"{tag}_ud_p"], [f"{tag}_ud_g"], wrong(F.col(f"{tag}_ud_g"), F.col(f"{tag}_ud_p")))


def noise(quad: DataFrame, tag: str) -> DataFrame:
    """Of ud errors in each subset, how many have str right (clean) and wrong (noisy)."""
    right = correct(F.col(f"{tag}_str_g"), F.col(f"{tag}_str_p"))
    errors = quad.where(wrong(F.col(f"{tag}_ud_g"), F.col(f"{tag}_ud_p"))).groupBy("subset").agg(F.count(F.lit(1)).alias("errors"), F.count_if(right).alias("clean"))
    out = with_full(errors).groupBy("subset").agg(F.sum("errors").alias("errors"), F.sum("clean").alias("clean"))
    return out.withColumn("noisy", F.col("errors") - F.col("clean")).withColumn("clean_pct", percent(F.col("clean"), F.col("errors")))


def ranked(quad: DataFrame, tag: str, top: int, min_count: int = 10, min_percent: float = 1.0) -> DataFrame:
    """The commonest triplets of each subset, side by side by rank: a report of ``top`` rows."""
    keys, subsets = [f"{tag}_str_g", f"{tag}_ud_g", f"{tag}_ud_p"], ("full", "old", "new")
    bad = correct(F.col(keys[0]), F.col(f"{tag}_str_p")) & wrong(F.col(keys[1]), F.col(keys[2]))
    cells = quad.groupBy("subset", *keys).agg(F.count_if(bad).alias("n"), F.count(F.lit(1)).alias("k"))
    cells = with_full(cells).groupBy("subset", *keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    both = cells.withColumn("whole", F.sum("k").over(Window.partitionBy("subset", *keys[:2]))).withColumn("pct", percent(F.col("n"), F.col("whole")))
    both = both.where((F.col("n") >= min_count) & (F.col("pct") >= min_percent) & reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    placed = both.withColumn("rank", F.row_number().over(Window.partitionBy("subset").orderBy(F.desc("n"), *keys))).where(F.col("rank") <= top)
    label = F.concat_ws("/", *keys)
    cell = lambda s, x: F.max(F.when(F.col("subset") == s, x))
    return placed.groupBy("rank").agg(*[e for s in subsets for e in (cell(s, label).alias(f"{s}_label"), cell(s, F.col("n")).alias(f"{s}_n"), cell(s, F.col("pct")).alias(f"{s}_pct"))])


def cascade(rows: DataFrame, steps: list[tuple[str, int]], keys: list[str]) -> DataFrame:
    """The first rows by one column, then of the rest by the next, and so on: columns step and rank, for small result tables.

    The table is written once, as every step reads it again.
    """
    rows = written(rows, "cascade")
    out, rest = None, rows
    for i, (by, n) in enumerate(steps, 1):
        w = Window.orderBy(F.desc_nulls_last(by), *keys)
        some = rest.orderBy(F.desc_nulls_last(by), *keys).limit(n).withColumn("rank", F.row_number().over(w)).withColumn("step", F.lit(i))
        out = some if out is None else out.unionByName(some)
        rest = rest.join(some.select(*keys), keys, "left_anti")
    return out
