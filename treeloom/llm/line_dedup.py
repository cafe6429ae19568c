"""Line deduplication over levelled sorted runs of line hashes.

The runs are tables of (h1, h2, n): 128 bits of a line's key and the number of documents that held it, sorted
by key within hash partitions. Documents come in batches. A batch is counted, merge-anti-joined with the run of
settled keys (those that reached ``min_docs`` earlier; their lines go whatever follows), and the rest is added as a run of level 0. When a level
has ``fan_in`` runs they are merged into one run of the next level; keys that reach ``min_docs`` in a merge move to the settled run.
The last merge takes all levels. Every batch thus costs its own size, and a key is rewritten once a level.

Lines that are settled go in all documents, earlier ones included, so the outcome does not depend on the order of batches.

Only DataFrame operations. Counting is pre-aggregated before each shuffle, which a line in a third of all documents
passes as one row a task; the join that finds which documents hold settled lines can split such a key (a plain inner sort-merge join).

Null or empty text is one empty line; empty keys never go. Rows are told apart by a hash of id and text: repeated
rows count as documents of their own, and get the same outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh, keep, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case. Letters beyond ASCII stay."""
    bare = F.trim(line, F.lit(SPACES))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def key_hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(5), key).alias("h2"))


class LineRuns:
    """Settled keys and levels of runs, each a written table."""

    def __init__(self, min_docs: int, fan_in: int = 2):
        self.min_docs, self.fan_in = min_docs, fan_in
        self.settled: DataFrame | None = None
        self.levels: list[list[DataFrame]] = []

    def add(self, keys: DataFrame) -> None:
        """Add a batch: a row (h1, h2) for each document and distinct key."""
        run = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        if self.settled is not None:
            run = run.hint("merge").join(self.settled.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self._put(0, run)

    def _put(self, level: int, run: DataFrame) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(keep(run.sortWithinPartitions("h1", "h2"), f"lines-run{level}"))
        if len(self.levels[level]) >= self.fan_in:
            runs, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merge(runs))

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        """One run of what is not settled; settled keys move."""
        merged = self._summed(runs)
        done = keep(merged.where(F.col("n") >= self.min_docs).sortWithinPartitions("h1", "h2"), "lines-settled")
        self.settled = done if self.settled is None else self.settled.unionByName(done)
        return merged.where(F.col("n") < self.min_docs)

    @staticmethod
    def _summed(runs: list[DataFrame]) -> DataFrame:
        union = runs[0]
        for r in runs[1:]:
            union = union.unionByName(r)
        return union.groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame | None:
        """All keys of ``min_docs`` documents or more (h1, h2), distinct; None before the first batch."""
        runs = [r for level in self.levels for r in level]
        out = None if self.settled is None else self.settled.select("h1", "h2")
        if runs:
            last = self._summed(runs).where(F.col("n") >= self.min_docs).select("h1", "h2")
            out = last if out is None else out.unionByName(last)
        return None if out is None else out.distinct()


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_key_chars: int = 1, batches: int = 3, id_col: str = "doc_id", text: str = "text", out: str = "deduped") -> DataFrame:
    """All rows and columns of ``docs`` with a struct column ``out``: text (without the frequent lines), n_lines, n_dropped.

    A row whose every line goes gets an empty text. Moves 24 bytes a distinct line of a document, and every text
    once, to meet its document's frequent lines.
    """
    base = docs.drop(out) if out in docs.columns else docs
    row = F.xxhash64(F.col(id_col), F.col(text))
    lines = F.split(text_of(text), "\n")
    wanted = F.array_distinct(F.transform(F.filter(F.transform(lines, line_key), lambda k: F.length(k) >= min_key_chars), key_hashes))
    keys = base.select(row.alias("row"), F.explode(wanted).alias("k")).select("row", "k.h1", "k.h2", F.pmod(F.col("row"), F.lit(batches)).cast("int").alias("batch"))
    keys = keep(keys, "lines-keys")
    runs = LineRuns(min_docs)
    for b in range(batches):
        runs.add(keys.where(F.col("batch") == b).select("h1", "h2"))
    # written, so that the join below has a plain exchange on either side and can split the rows of a hot line
    frequent = keep(runs.frequent(), "lines-frequent")
    hits = keys.select("row", "h1", "h2").hint("merge").join(frequent.hint("merge"), ["h1", "h2"])
    key, found, split, left = fresh(base, "__row", "__hits", "__lines", "__stay")
    hits = hits.groupBy("row").agg(F.collect_set(F.struct("h1", "h2")).alias(found))
    joined = base.withColumn(key, row).hint("merge").join(hits.withColumnRenamed("row", key).hint("merge"), key, "left")
    stay = F.filter(split, lambda x: ~F.array_contains(F.col(found), key_hashes(line_key(x))))
    joined = joined.withColumn(split, lines).withColumn(left, F.when(F.col(found).isNull(), F.col(split)).otherwise(stay))
    got = F.struct(F.array_join(left, "\n").alias("text"), F.size(split).cast("long").alias("n_lines"), (F.size(split) - F.size(left)).cast("long").alias("n_dropped"))
    return joined.withColumn(out, got).select(*[F.col(f"`{c}`") for c in base.columns], out)
