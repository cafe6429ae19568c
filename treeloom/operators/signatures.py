"""Morphological error sets and signatures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MISSING, correct, last_feature, percent
from .error_matrix import with_full
from .written import written

POS = "UPOS"


def error_set(gold: Column, pred: Column, upos_gold: Column, upos_pred: Column, names: list[str], tag: str) -> Column:
    """Sorted names of the features that differ, missing ones included, and ``tag`` if the part of speech does."""
    each = {n: F.when(last_feature(gold, n) != last_feature(pred, n), F.lit(n)) for n in names}
    each[tag] = F.when(~correct(upos_gold, upos_pred), F.lit(tag))
    # put in order here, and nulls taken away by a set's difference: a sort and a filter by lambda functions cost a token several times as much
    return F.array_except(F.array(*[each[n] for n in sorted(each)]), F.array(F.lit(None).cast("string")))


def signature(names: list[str], control: bool = False) -> Column:
    """Sorted 'name:str gold:ud gold:ud predicted' of the features that both golds have, where ud is wrong and str right (control: wrong too).

    Reads the columns of ``values``.
    """
    parts = []
    for n in names:
        sg, sp, ug, up = (F.col(f"{n}_{s}") for s in ("str_g", "str_p", "ud_g", "ud_p"))
        other = sg != sp if control else sg == sp
        parts.append(F.when(_in_both(n) & other & (ug != up), F.concat_ws(":", F.lit(n), sg, ug, up)))
    return F.array_sort(F.filter(F.array(*parts), lambda x: x.isNotNull()))


def _in_both(name: str) -> Column:
    """Both golds have the category; a part of speech they always have."""
    return F.lit(True) if name == POS else (F.col(f"{name}_str_g") != MISSING) & (F.col(f"{name}_ud_g") != MISSING)


def values(quad: DataFrame, names: list[str], str_names: dict[str, str] | None = None) -> DataFrame:
    """Subset and a column ``<name>_<scheme>_<role>`` for each category: strings are parsed once, before rows are doubled.

    ``names`` may hold ``UPOS``; ``str_names`` has the names that features have in str, where those differ.
    """

    def value(n: str, s: str) -> Column:
        if n == POS:
            return F.coalesce(F.col(f"upos_{s}"), F.lit(MISSING))
        return last_feature(F.col(f"feats_{s}"), (str_names or {}).get(n, n) if s.startswith("str") else n)

    return quad.select("subset", *[value(n, s).alias(f"{n}_{s}") for n in names for s in ("str_g", "str_p", "ud_g", "ud_p")])


def cross_split(table: DataFrame, subsets: tuple[str, ...] = ("full", "old", "new"), min_count: int = 10, min_percent: float = 1.0, only_common: bool = True) -> DataFrame:
    """A signature's counts and shares side by side, 0 where a subset lacks it, with their total.

    ``only_common`` keeps signatures with more than ``min_count`` tokens in a subset and more than ``min_percent`` in one.
    """
    cell = lambda c, s: F.coalesce(F.max(F.when(F.col("subset") == s, F.col(c))), F.lit(0))
    out = table.groupBy("sig").agg(*[cell(c, s).alias(f"{s}_{c}") for s in subsets for c in ("n", "pct")])
    out = out.withColumn("total", reduce(lambda a, b: a + b, [F.col(f"{s}_n") for s in subsets]))
    some = lambda c, least: reduce(lambda a, b: a | b, [F.col(f"{s}_{c}") > least for s in subsets])
    return out.where(some("n", min_count) & some("pct", min_percent)) if only_common else out


def signature_table(quad: DataFrame, names: list[str], control: bool = False, str_names: dict[str, str] | None = None) -> DataFrame:
    """Each signature's tokens and share of the tokens whose golds contain it, for each subset (full, old, new).

    Containment is a relational division: a signature's parts meet the parts of gold annotations on equality, and a group
    of tokens contains it if all its parts met. Tokens are first grouped by annotation, so the join sees distinct ones.
    """
    # distinct combinations of values are few: tokens are counted once and written, and the counts doubled
    rows = values(quad, names, str_names)
    rows = with_full(written(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("k")), "signature-values"))
    sig = F.array_join(signature(names, control), ",")
    found = rows.withColumn("sig", sig).where("sig <> ''").groupBy("subset", "sig").agg(F.sum("k").alias("n"))
    gold = [F.when(_in_both(n), F.concat_ws(":", F.lit(n), f"{n}_str_g", f"{n}_ud_g")) for n in names]
    kinds = rows.withColumn("gold", F.array_join(F.filter(F.array(*gold), lambda x: x.isNotNull()), ",")).groupBy("subset", "gold").agg(F.sum("k").alias("m"))
    needs = found.select("sig").distinct().withColumn("parts", F.transform(F.split("sig", ","), lambda p: F.substring_index(p, ":", 3)))
    wanted = needs.select("sig", F.size("parts").alias("k"), F.explode("parts").alias("part"))
    has = kinds.select("gold").distinct().select("gold", F.explode(F.split("gold", ",")).alias("part"))
    holds = wanted.join(has, "part").groupBy("sig", "gold", "k").agg(F.count(F.lit(1)).alias("met")).where("met = k")
    size = holds.join(kinds, "gold").groupBy("subset", "sig").agg(F.sum("m").alias("n_gold"))
    return found.join(size, ["subset", "sig"]).withColumn("pct", percent(F.col("n"), F.col("n_gold"), 1))
