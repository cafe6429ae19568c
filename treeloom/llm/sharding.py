"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

1. The rows are written once with the number of their partition and of the row, which then stay what they are.
2. The matrix says how many rows each partition sends to each shard. Its law is that of a uniform shuffle: each row of it is a multivariate
   hypergeometric draw from the room that is left. The driver draws it for at most ``COARSE`` blocks of partitions; each block then draws the rows
   of its partitions in a task, from the room that the block was given. So neither the driver nor a task holds more than a bounded part.
3. Each partition permutes its rows (by a hash of row number and seed, which contents do not enter) and deals them by its row of the matrix.
4. In each shard the rows are permuted again. Rows draw one of ``blocks`` blocks, blocks are counted, and a slot is the
   block's offset plus the rank in it: no task sorts a whole shard.

Shard sizes differ by one at most. Every row gets a place, nulls and repeated rows included; equal rows are placed independently. An
empty table gives an empty result. Columns of any name pass through; those that are named as the two new ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

COARSE = 1024


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` drawn without return are good.

    numpy's generator ends at 1e9. Beyond, the law is inverted: its weights follow from that of the mode by their exact ratios, out to 12
    deviations on each side, where what is left is far below what the uniform number can tell apart.
    """
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    total, low, high = good + bad, max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    reach = 100 + int(12 * np.sqrt(n * (good / total) * (bad / total) * (total - n) / (total - 1)))
    up, down = np.arange(mode, min(high, mode + reach), dtype=np.float64), np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    above = np.cumprod((good - up) * (n - up) / ((up + 1) * (bad - n + up + 1)))
    below = np.cumprod(down * (bad - n + down) / ((good - down + 1) * (n - down + 1)))
    weights = np.concatenate([below[::-1], [1.0], above])
    sums = np.cumsum(weights)
    return mode - len(below) + int(np.searchsorted(sums, rng.random() * sums[-1], "right"))


def communication_matrix(rows: np.ndarray, room: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rows that partition i sends to shard j: margins are ``rows`` and ``room``, which have one sum."""
    room = room.copy()
    out = np.zeros((len(rows), len(room)), np.int64)
    for i, n in enumerate(rows.tolist()):
        left, need = int(room.sum()), n
        for j in range(len(room)):
            left -= int(room[j])
            out[i, j] = hypergeometric(rng, int(room[j]), left, need) if need and room[j] and left else min(need, int(room[j]))
            need -= int(out[i, j])
        room -= out[i]
    return out


def _rows_of_block(seed: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("p")
        rng = np.random.Generator(np.random.PCG64([seed, int(block["block"].iloc[0])]))
        matrix = communication_matrix(block["n"].to_numpy(), np.array(block["room"].iloc[0], np.int64), rng)
        return pd.DataFrame({"p": block["p"].to_numpy(), "ends": list(np.cumsum(matrix, 1))})

    return run


def shard(df: DataFrame, shards: int, seed: int = 17, block_rows: int = 50_000) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in a shard), both long.

    Two narrow shuffles of what ``df`` selects: one by partition for the deal, one by shard and block for the slots.
    """
    spark, names = df.sparkSession, [c for c in df.columns if c.lower() not in ("shard", "slot")]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    stable = keep(df.select(row, F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("number")), "shard")
    counts = stable.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    total, last = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("p"), F.lit(0))).first()
    counts = counts.withColumn("block", F.floor(F.col("p") / -(-(last + 1) // COARSE)).cast("long"))
    coarse = counts.groupBy("block").agg(F.sum("n").alias("n")).orderBy("block").collect()
    room = np.full(shards, total // shards, np.int64)
    room[: total % shards] += 1
    given = communication_matrix(np.array([r["n"] for r in coarse], np.int64), room, np.random.Generator(np.random.PCG64(seed)))
    given = spark.createDataFrame([(r["block"], x.tolist()) for r, x in zip(coarse, given, strict=True)], "block long, room array<long>")
    matrix = counts.join(F.broadcast(given), "block").groupBy("block").applyInPandas(_rows_of_block(seed), "p int, ends array<long>")
    matrix = keep(matrix, "shard-matrix")
    local = Window.partitionBy("p").orderBy(F.xxhash64(F.lit(seed), "number"), "number")
    dealt = stable.withColumn("rank", F.row_number().over(local).cast("long")).join(matrix, "p")
    # the shard is the first whose running total reaches the rank
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))).cast("long"))
    blocks = max(1, -(-total // (shards * block_rows)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "number"), F.lit(blocks)))
    dealt = keep(dealt.select("row", "number", "shard", "block"), "shard-dealt")
    sizes = dealt.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    # shards x blocks rows, one for every block_rows rows of the input
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    again = Window.partitionBy("shard", "block").orderBy(F.xxhash64(F.lit(seed + 2), "number"), "number")
    placed = dealt.withColumn("r", F.row_number().over(again) - 1).join(offsets, ["shard", "block"])
    out = placed.select(*[F.col("row")[c].alias(c) for c in names], "shard", (F.col("offset") + F.col("r")).alias("slot"))
    return out
