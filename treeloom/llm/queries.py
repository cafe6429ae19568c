"""Queries over the ten operators and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, line_dedup, ngram_join, packing, quality_rules, secret_scan, sharding, suffix_dedup, toxicity
from .common import keep, table, text_of

N_SHARDS = 40


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    got = quality_rules.assess(docs)
    return got.select("doc_id", "assessment.*")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_of("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    placed = sharding.shard(rows, N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "deduped.n_bytes", "deduped.n_removed", "deduped.n_spans", F.sha2("deduped.kept", 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "deduped.n_lines", "deduped.n_dropped", F.sha2(F.col("deduped.text").cast("binary"), 256).alias("kept_sha256"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.concat_ws("/", "source", "lang").alias("repository"), F.col("source").alias("owner"))
    got = secret_scan.find_secrets(docs)
    names = F.array(*[F.lit(k[0]) for k in secret_scan.KINDS])
    say = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
    count = lambda field, value: F.size(F.filter("secrets", lambda x: x[field] == value)).cast("long")
    kinds = [count("kind", k).alias(f"n_{secret_scan.KINDS[k][0]}") for k in range(secret_scan.N_BASE)]
    classes = [count("class", c).alias(f"n_{c}") for c in ("live", "shared", "copied")]
    base = say(F.filter("secrets", lambda x: x["kind"] < secret_scan.N_BASE))
    return got.select("doc_id", *kinds, F.sha2(base.cast("binary"), 256).alias("base_sha256"), say(F.col("secrets")).alias("spans"), *classes)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    ex = chat_format.examples(turns.unionByName(probe))
    digest = F.array_join(F.transform(chat_format.parse(F.col("formatted")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    narrow = ex.select(
        "conv_id", "example", F.length("formatted").cast("long").alias("chars"),
        F.struct("example", chat_format.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss")).alias("reply"),
        F.when(F.col("is_last"), F.size(chat_format.parse(F.col("formatted"))).cast("long")).alias("n_turns"),
        F.when(F.col("is_last"), F.sha2(digest.cast("binary"), 256)).alias("turns_sha256"),
    )
    by = narrow.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), F.array_join(F.transform(F.array_sort(F.collect_list("reply")), lambda x: x["loss"]), "").alias("loss"), F.sum("chars").alias("formatted_chars"))
    return by.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    known = keep(labels.where(~held_out), "toxic-labels")
    prior = known.agg(F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0))).first()[0] or 0.1
    learnable = docs.where(~held_out)
    keys = learnable.select("doc_id").join(known, "doc_id", "left").select(F.xxhash64("doc_id").alias("key"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("positive"))
    weights = toxicity.train(keys, learnable.select(F.xxhash64("doc_id").alias("key"), "text"), min(max(prior, 0.01), 0.5))
    got = toxicity.score(docs, weights)
    return got.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_sharding, op3_decontaminate, op4_suffix_dedup, op5_line_dedup, op6_ngram_join, op7_secret_scan, op8_chat_format, op9_toxicity, op10_packing)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.SQL
