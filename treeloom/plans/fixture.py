"""A treebank made from ``documents``: two annotations (str, ud), gold and predicted, of every token of every text.

A line is cut into sentences of 40 tokens. Everything follows from integer formulas that Spark and DuckDB read alike; ``COLUMNS``
is the one place that holds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SENTENCE = 40

COLUMNS = {
    "subset": "CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END",
    "upos_ud_g": "CASE WHEN form LIKE '%.' THEN 'PUNCT' WHEN k % 97 = 0 THEN NULL ELSE 'P' || (L % 5) END",
    "upos_ud_p": "CASE WHEN form LIKE '%.' THEN 'PUNCT' WHEN k % 7 = 0 THEN 'P' || ((L + 1) % 5) ELSE 'P' || (L % 5) END",
    "upos_str_g": "CASE WHEN form LIKE '%.' THEN 'PUNCT' ELSE 'S' || (L % 4) END",
    "upos_str_p": "CASE WHEN form LIKE '%.' THEN 'PUNCT' WHEN k % 11 = 0 THEN 'S' || ((L + 1) % 4) ELSE 'S' || (L % 4) END",
    "deprel_str_g": "'s' || (L % 6)",
    "deprel_str_p": "CASE WHEN k % 11 = 0 THEN 's' || ((L + 1) % 6) ELSE 's' || (L % 6) END",
    "deprel_ud_g": "'u' || ((L + k % 3) % 8) || CASE WHEN k % 6 = 0 THEN ':sub' ELSE '' END",
    "deprel_ud_p": "CASE WHEN k % 7 = 0 THEN 'u' || ((L + k % 3 + 1 + k % 2) % 8) ELSE 'u' || ((L + k % 3) % 8) || CASE WHEN k % 6 = 0 THEN ':sub' ELSE '' END END",
    "feats_ud_g": "'Case=c' || (k % 4) || '|Number=n' || (k % 2) || CASE WHEN k % 5 = 0 THEN '' ELSE '|Gender=g' || (L % 3) END",
    "feats_ud_p": "'Case=c' || (CASE WHEN k % 17 = 0 THEN (k + 1) % 4 ELSE k % 4 END) || '|Number=n' || (CASE WHEN k % 23 = 0 THEN (k + 1) % 2 ELSE k % 2 END) || CASE WHEN k % 5 = 0 THEN '' ELSE '|Gender=g' || (L % 3) END",
    "feats_str_g": "'Case=c' || (k % 4) || '|Number=n' || (k % 2) || '|Gender=g' || (L % 2)",
    "feats_str_p": "'Case=c' || (CASE WHEN k % 34 = 0 THEN (k + 1) % 4 ELSE k % 4 END) || '|Number=n' || (k % 2) || '|Gender=g' || (L % 2)",
    "head_ud_g": "CAST(floor(id / 2) AS BIGINT)",
    "head_ud_p": "CASE WHEN k % 9 = 0 THEN id - 1 ELSE CAST(floor(id / 2) AS BIGINT) END",
    "head_str_g": "CASE WHEN n = 1 THEN 0 WHEN id = 1 THEN 2 WHEN id = 2 THEN 0 WHEN id % 3 = 0 THEN id - 1 ELSE CAST(floor(id / 2) AS BIGINT) END",
    "head_str_p": "CASE WHEN k % 10 = 0 THEN id - 1 WHEN n = 1 THEN 0 WHEN id = 1 THEN 2 WHEN id = 2 THEN 0 WHEN id % 3 = 0 THEN id - 1 ELSE CAST(floor(id / 2) AS BIGINT) END",
    "ellipsis": "CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END",
}
BASE = ["doc_id", "ln", "seg", "sent_id", "id", "n", "form", "L", "k"]

#: The same for DuckDB, as the head of a query.
SQL = f"""WITH lines AS (
  SELECT doc_id, unnest(range(1, len(ls) + 1)) AS ln, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
forms AS (
  SELECT doc_id, ln, len(fs) AS total, unnest(fs) AS form, unnest(range(0, len(fs))) AS pos
  FROM (SELECT doc_id, ln, list_filter(string_split(line, ' '), lambda x: x <> '') AS fs FROM lines)),
placed AS (
  SELECT doc_id, ln, pos // {SENTENCE} AS seg, pos % {SENTENCE} + 1 AS id, least({SENTENCE}, total - pos // {SENTENCE} * {SENTENCE}) AS n, form, length(form) AS L FROM forms),
keyed AS (
  SELECT *, doc_id || '_' || ln || '_' || seg AS sent_id, (doc_id * 31 + ln * 17 + seg * 13 + id * 7 + L) % 1000 AS k FROM placed),
tok AS (
  SELECT *, {", ".join(f"{v} AS {k}" for k, v in COLUMNS.items())} FROM keyed)
"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token table; columns that a query does not use are pruned. Only texts are shuffled: a file of one row group would leave all tokens to one task."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition("doc_id")
    # outer explosions, as for others the optimiser asks first whether the array is empty, and splits the text twice for that; the parts of sent_id that a line's tokens share are made once
    lines = docs.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("ln", "line")).withColumn("ln", F.col("ln").cast("long") + 1)
    words = lines.select("doc_id", "ln", F.expr("doc_id || '_' || ln || '_'").alias("of_line"), F.array_remove(F.split("line", " "), "").alias("fs"))
    forms = words.select("doc_id", "ln", "of_line", F.size("fs").cast("long").alias("total"), F.posexplode_outer("fs").alias("pos", "form")).where("form is not null")
    forms = forms.withColumn("pos", F.col("pos").cast("long"))
    placed = forms.selectExpr("doc_id", "ln", "of_line", f"pos div {SENTENCE} AS seg", f"pos % {SENTENCE} + 1 AS id", f"least({SENTENCE}L, total - pos div {SENTENCE} * {SENTENCE}) AS n", "form", "cast(length(form) AS BIGINT) AS L")
    keyed = placed.selectExpr("*", "of_line || seg AS sent_id", "(doc_id * 31 + ln * 17 + seg * 13 + id * 7 + L) % 1000 AS k")
    return keyed.selectExpr(*BASE, *[f"{v} AS {k}" for k, v in COLUMNS.items()])


def stands_together(spark: SparkSession, sf_dir: str) -> bool:
    """Whether the rows of a sentence are neighbours in ``tokens``: they are if every document has an id, and one of its own."""
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return ids.where("doc_id is null or n > 1").limit(1).isEmpty()


def tree(tok: DataFrame, scheme: str, role: str = "g") -> DataFrame:
    """One annotation as (sent_id, id, head, deprel, upos)."""
    return tok.select("sent_id", "id", F.col(f"head_{scheme}_{role}").alias("head"), F.col(f"deprel_{scheme}_{role}").alias("deprel"), F.col(f"upos_{scheme}_{role}").alias("upos"))
