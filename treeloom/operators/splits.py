"""Splits, folds and packages of sentences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .written import written


def placed(sents: DataFrame, *order: str | Column, place: str = "place") -> tuple[DataFrame, int]:
    """``sents`` with each row's place from 0 in ``order``, and how many there are.

    Rows are ranged by the order and written with their partition and their number in it, so that what is counted is what is numbered;
    no task has to order the whole table.
    """
    spark = sents.sparkSession
    ranged = sents.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()}), "placed")
    sizes = [(r["__p"], r["n"]) for r in ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).orderBy("__p").collect()]
    starts, before = [], 0
    for p, n in sizes:
        starts.append((p, before))
        before += n
    offsets = spark.createDataFrame(starts, "__p int, __start long")
    row = F.col("__m").bitwiseAND((1 << 33) - 1)
    return ranged.join(F.broadcast(offsets), "__p").withColumn(place, F.col("__start") + row).drop("__p", "__m", "__start"), before


def folds(sents: DataFrame, k: int, *order: str) -> DataFrame:
    """Contiguous folds 1 to k in order, the first ones longer by one if it does not divide."""
    ranked, total = placed(sents, *order, place="__i")
    longer, size = total % k, total // k
    cut = longer * (size + 1)
    fold = F.when(F.col("__i") < cut, F.floor(F.col("__i") / (size + 1))).otherwise(longer + F.floor((F.col("__i") - cut) / max(size, 1))) + 1
    return ranked.withColumn("fold", fold.cast("long")).drop("__i")


def cross_validation(folded: DataFrame, k: int, dev: DataFrame | None = None, test: DataFrame | None = None) -> DataFrame:
    """Each sentence in each of k data sets: test in its own, train in the others.

    With ``dev`` (a table without fold) every set has its copy. With ``test`` too there is one more set, k + 1, in which the folds are train, ``dev`` is
    test and ``test`` is dev.
    """
    sets = lambda n: F.explode(F.sequence(F.lit(1), F.lit(n)))
    out = folded.withColumn("dataset", sets(k)).withColumn("role", F.when(F.col("fold") == F.col("dataset"), "test").otherwise("train"))
    alone = lambda t, n, role: t.withColumns({"fold": F.lit(None).cast("long"), "dataset": n, "role": F.lit(role)})
    if dev is not None:
        out = out.unionByName(alone(dev, sets(k), "dev"))
    if test is not None:
        swap = F.lit(k + 1)
        out = out.unionByName(folded.withColumns({"dataset": swap, "role": F.lit("train")})).unionByName(alone(dev, swap, "test")).unionByName(alone(test, swap, "dev"))
    return out


def shuffled(sents: DataFrame, seed: int = 1, train: float = 0.85, dev: float = 0.05) -> DataFrame:
    """A seeded shuffle cut at exactly these shares of the rows, rounded down; ties of the hash go by id."""
    ranked, total = placed(sents.withColumn("__h", F.xxhash64(F.lit(seed), "sent_id")), "__h", "sent_id", place="__i")
    first, second = int(train * total), int((train + dev) * total)
    split = F.when(F.col("__i") < first, "train").when(F.col("__i") < second, "dev").otherwise("test")
    return ranked.withColumn("split", split).drop("__h", "__i")


def packages(rows: DataFrame, key: str, *order: str, by: str) -> DataFrame:
    """Runs of equal ``key`` in order within ``by`` are numbered from 1."""
    w = Window.partitionBy(by).orderBy(*order)
    new = (~F.coalesce(F.col(key).eqNullSafe(F.lag(key).over(w)), F.lit(False)) | (F.row_number().over(w) == 1)).cast("int")
    return rows.withColumn("__new", new).withColumn("package", F.sum("__new").over(w)).drop("__new")


def runs_between(tokens: DataFrame, member: Column, skip: Column, by: str = "sent_id", order: str = "id") -> DataFrame:
    """Members with the number of their run: members that only tokens to ``skip`` stand between are one run."""
    w = Window.partitionBy(by).orderBy(order)
    seen = tokens.where(member | ~skip).withColumn("__member", member)
    new = F.col("__member") & ~F.coalesce(F.lag("__member").over(w), F.lit(False))
    return seen.withColumn("__new", new.cast("int")).withColumn("run", F.sum("__new").over(w)).where("__member").drop("__member", "__new")


def repeated_ids(sents: DataFrame, key: str = "sent_id") -> DataFrame:
    return sents.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def without_repeats(sents: DataFrame, key: str = "sent_id") -> DataFrame:
    """``sents``; an id that occurs twice is an error when the rows are read."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return sents.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit(f"{key} occurs twice: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))).drop("__n")


def consistent(runs: DataFrame) -> DataFrame:
    """Tokens whose predicted head and relation are one and the same in all runs; all-null predictions are not."""
    by = runs.groupBy("sent_id", "id").agg(F.count_distinct("head_p").alias("h"), F.count_distinct("deprel_p").alias("r"))
    return by.where("h = 1 and r = 1").select("sent_id", "id")


def consistent_wide(*runs: list[Column]) -> Column:
    """The same of a row that holds all runs: of each list, a column of predictions for each run, the known ones are one and the same."""
    # what is no null, each once
    return reduce(lambda a, b: a & b, [F.size(F.array_except(F.array(*x), F.array(F.lit(None)))) == 1 for x in runs])


def consistent_in_both(ud_runs: DataFrame, str_runs: DataFrame) -> DataFrame:
    """Tokens that all runs of both annotations agree on: one aggregation over both, no join."""
    both = ud_runs.select("sent_id", "id", F.lit(0).alias("s"), "head_p", "deprel_p").unionByName(str_runs.select("sent_id", "id", F.lit(1).alias("s"), "head_p", "deprel_p"))
    one = lambda c, s: F.count_distinct(F.when(F.col("s") == s, F.col(c))) == 1
    flags = both.groupBy("sent_id", "id").agg(*[one(c, s).alias(f"{c}{s}") for c in ("head_p", "deprel_p") for s in (0, 1)])
    return flags.where("head_p0 and head_p1 and deprel_p0 and deprel_p1").select("sent_id", "id")
