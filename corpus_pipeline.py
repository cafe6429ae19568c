"""A corpus pipeline of five stages: quality rules, line dedup, near-duplicate join, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of documents.
``run`` writes each stage's rows to the shared folder and reads them back, so a lost executor repeats no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules
from treeloom.llm.common import fresh, keep, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; null and empty texts are rejected."""
    (own,) = fresh(docs, "__assessment")
    return quality_rules.assess(docs, own).where(F.col(own)["kept"]).drop(own)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that ten of them share; n_chars follows the text, and null becomes empty."""
    (own,) = fresh(docs, "__deduped")
    left = F.col(own)["text"]
    got = line_dedup.dedup_lines(docs, out=own).withColumns({"text": left, "n_chars": F.length(left).cast("long")})
    return got.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each component of similar ones, and all those without words.

    A row is told by id and text: of rows that share both one stays, and of those that share only the id each goes with its own component. A
    component with several texts of the least id keeps the text of the least hash; a null id counts as larger than all.
    """
    linked = keep(ngram_join.link(docs), "pipeline-links")
    row = F.struct(F.isnull("doc_id").alias("x"), "doc_id", "text_hash")
    first = linked.where("root is not null").groupBy("root").agg(F.min(row).alias("r")).select("r.doc_id", "r.text_hash")
    stays = first.unionByName(linked.where("root is null").select("doc_id", "text_hash").distinct())
    key, digest, own = fresh(docs, "__id", "__hash", "__t")
    stays = stays.select(F.col("doc_id").alias(key), F.col("text_hash").alias(digest))
    named = docs.withColumn(own, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(digest))
    return named.join(stays, same, "left_semi").dropDuplicates(["doc_id", own]).drop(own)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; rows that share an id share the verdict. An empty benchmark leaves all."""
    (key,) = fresh(docs, "__id")
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(keep(leaks, "pipeline-leaks"), F.col("doc_id").eqNullSafe(F.col(key)), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens; null and empty texts are one piece each."""
    return packing.pack(docs, with_ids=False)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("decontamination", decontaminated), ("packing", packed)]

#: No SQL can say what the near-duplicate, retrieval and tokenising stages do; a test holds ``run`` against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
