"""Tagging and parsing scores, runs and paired tests."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import coarse, correct, feature, normal_feats, punct_by_tag, wrong


def tagging(pairs: DataFrame, *by: str) -> DataFrame:
    """Accuracy of upos, feats and both, over tokens that are no ellipsis. Columns upos_g/p, feats_g/p, ellipsis."""
    g, p = F.col("feats_g"), F.col("feats_p")
    # equal strings are the rule, and need no parsing
    u, f = correct(F.col("upos_g"), F.col("upos_p")), F.when(F.coalesce(g == p, F.lit(False)), F.lit(True)).otherwise(correct(normal_feats(g), normal_feats(p)))
    real = pairs.where("ellipsis = 0").select(*by, u.cast("int").alias("u"), f.cast("int").alias("f"))
    return real.groupBy(*by).agg(F.count(F.lit(1)).alias("tokens"), F.avg("u").alias("upos"), F.avg("f").alias("feats"), F.avg(F.col("u") * F.col("f")).alias("all_tags"))


def attachment(pairs: DataFrame, *by: str, full: bool = False, punct: bool = True) -> DataFrame:
    """UAS and LAS; ``full`` compares relations with their subtypes, ``punct=False`` leaves punctuation out."""
    rel = (lambda c: c) if full else coarse
    rows = pairs if punct else pairs.where(~punct_by_tag(F.col("upos_g")))
    head = correct(F.col("head_g"), F.col("head_p"))
    both = head & correct(rel(F.col("deprel_g")), rel(F.col("deprel_p")))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("tokens"), F.avg(head.cast("int")).alias("uas"), F.avg(both.cast("int")).alias("las"))


def complete_match(pairs: DataFrame, *by: str, full: bool = False) -> DataFrame:
    """Share of sentences whose every token, punctuation apart, has its head (UCM), and its relation too (LCM)."""
    rel = (lambda c: c) if full else coarse
    skip, head = punct_by_tag(F.col("upos_g")), correct(F.col("head_g"), F.col("head_p"))
    both = head & correct(rel(F.col("deprel_g")), rel(F.col("deprel_p")))
    sents = pairs.groupBy(*by, "sent_id").agg(F.min((skip | head).cast("int")).alias("u"), F.min((skip | both).cast("int")).alias("l"))
    return sents.groupBy(*by).agg(F.count(F.lit(1)).alias("sentences"), F.avg("u").alias("ucm"), F.avg("l").alias("lcm"))


def ellipsis_attachment(pairs: DataFrame, *by: str) -> DataFrame:
    """Scores of the tokens whose gold head is an ellipsis."""
    heads = pairs.where("ellipsis = 1").select("sent_id", F.col("id").alias("head_g"))
    return attachment(pairs.join(heads, ["sent_id", "head_g"], "left_semi"), *by)


def over_runs(scores: DataFrame, *by: str) -> DataFrame:
    """Mean and sample deviation of ``value`` over runs; a single run deviates by 0."""
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its power series on the side where that converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    total = term = 1.0
    for i in range(1, 2000):
        term *= x * (a + b + i - 1) / (a + i)
        total += term
        if term < 1e-17 * total:
            break
    return front * total


def paired_test(scores: DataFrame, *by: str, alpha: float = 0.05) -> DataFrame:
    """Two-sided paired t-test of columns a and b over the rows of a group: n, mean_difference, t, p, significant.

    Differences that do not vary give no t and no p, and are not significant.
    """
    d = F.col("a") - F.col("b")
    stat = scores.where(d.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("__s"))
    stat = stat.withColumn("t", F.when(F.col("__s") > 1e-12, F.col("mean_difference") / (F.col("__s") / F.sqrt("n")))).drop("__s")

    @F.pandas_udf("double")
    def p_value(t, n):
        import pandas as pd

        return pd.Series([None if x is None or np.isnan(x) else _beta_fraction((m - 1) / 2, 0.5, (m - 1) / (m - 1 + x * x)) for x, m in zip(t, n, strict=True)], dtype="float64")

    out = stat.withColumn("p", p_value("t", "n"))
    return out.withColumn("p", F.when(~F.isnan("p"), F.col("p"))).withColumn("significant", F.coalesce(F.col("p") < alpha, F.lit(False)))


def deprel_mismatches(quad: DataFrame, str_label: str | None = None, gold: str | None = None, predicted: str | None = None) -> DataFrame:
    """Tokens whose ud relation is wrong. ``str_label``: a gold relation of str, ``any``, or ``anyBut``, which asks for a wrong one there; ud labels narrow further."""
    out = quad.where(wrong(F.col("deprel_ud_g"), F.col("deprel_ud_p")))
    if str_label == "anyBut":
        out = out.where(wrong(F.col("deprel_str_g"), F.col("deprel_str_p")))
    elif str_label not in (None, "any"):
        out = out.where(F.col("deprel_str_g") == str_label)
    return _labelled(out, deprel_ud_g=gold, deprel_ud_p=predicted)


def _labelled(rows: DataFrame, **labels: str | None) -> DataFrame:
    for column, value in labels.items():
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows


def morph_mismatches(quad: DataFrame, tag: str, str_gold: str, gold: str, predicted: str) -> DataFrame:
    """Tokens whose str value of ``tag`` (upos or a feature's name) is right and whose ud value is wrong, with these values."""
    value = (lambda s: F.col(f"upos_{s}")) if tag == "upos" else (lambda s: feature(F.col(f"feats_{s}"), tag))
    right = correct(value("str_g"), value("str_p")) & wrong(value("ud_g"), value("ud_p"))
    return quad.where(right & (value("str_g") == str_gold) & (value("ud_g") == gold) & (value("ud_p") == predicted))


def noisy_triplets(quad: DataFrame, str_predicted: str, gold: str | None, predicted: str | None) -> DataFrame:
    """Tokens that str wrongly gives ``str_predicted`` and ud ``predicted`` for ``gold``; None asks for no such label."""
    rows = quad.where(wrong(F.col("deprel_str_g"), F.col("deprel_str_p")))
    return _labelled(rows, deprel_str_p=str_predicted, deprel_ud_g=gold, deprel_ud_p=predicted)


def inconsistent_labels(quad: DataFrame, str_gold: str, labels: tuple[str, ...], each: int = 3) -> DataFrame:
    """The first tokens of each subset and ud label for one str relation, in the order of sentences."""
    rows = quad.where((F.col("deprel_str_g") == str_gold) & F.col("deprel_ud_g").isin(*labels))
    w = Window.partitionBy("subset", "deprel_ud_g").orderBy("sent_id", "id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= each)
