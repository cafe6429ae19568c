"""Secret scan with corpus-wide ownership frequency.

Every candidate (three base kinds and two more that only add spans) is found with its position in code points; then its value's hash is counted
over the corpus by distinct repositories and owners. A value that ``copied_owners`` owners or more have, or two owners in ``copied_repositories`` repositories, is a widely copied example; one
of a single owner that looks random (digits and letters, 16 characters or more) is a live-looking credential; the rest is shared.

Only DataFrame expressions: a pattern's matches come from ``regexp_extract_all``, the text between them from ``split``, and
positions are running sums of their lengths. Only candidates leave the scan (ids, positions, hashes), texts never move. Ownership is counted over distinct
(value, repository, owner), pre-aggregated, so a value that a third of all documents holds is one row a task.

Null or empty text has no candidate. Null repositories or owners count as one more name. Repeated rows each get their result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, keep, row_hash, text_of

#: Base kinds as listed, then those that this scan adds: name, pattern, group of the value, least characters of it, a string every match has.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    ("assign", ASSIGN, 1, 6, None),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20, "AKIA"),
    ("hex", r"[0-9a-f]{24,}", 0, 24, None),
    ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0, "PRIVATE KEY-----"),
    ("prefixed", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{20,})", 0, 20, None),
)
N_BASE, BLOCK = 3, 256


def _matches(text: Column, kind: int) -> Column:
    """array<struct<start, end, kind, value>> of one kind's matches in order; starts count code points from 0."""
    _, pattern, group, least, must = KINDS[kind]
    pat = F.lit(pattern)
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, pat, F.lit(0)).alias("m"), F.regexp_extract_all(text, pat, F.lit(group)).alias("v"))
    span = "struct<start:bigint,end:bigint,kind:int,value:string>"
    none = F.lit(None).cast(f"array<{span}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        hit = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value"))
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.cast("long").alias("at"), F.concat(acc["got"], F.array(hit)).alias("got")))

    def block(acc: Column, i: Column) -> Column:
        # appending to an array copies it: blocks keep that linear for texts with very many matches
        part = F.aggregate(F.slice(pieces, i, F.lit(BLOCK)), F.struct(acc["at"].alias("at"), F.array().cast(f"array<{span}>").alias("got")), step)
        return F.struct(part["at"].alias("at"), F.concat(acc["got"], F.array(part["got"])).alias("got"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<array<{span}>>").alias("got"))
    found = F.flatten(F.aggregate(F.sequence(F.lit(1), F.size(pieces), F.lit(BLOCK)), start, block)["got"])
    any_match = text.rlike(pattern) if must is None else F.contains(text, F.lit(must)) & text.rlike(pattern)
    found = F.when(any_match, found).otherwise(none)
    found = F.coalesce(found, F.array().cast(f"array<{span}>"))
    return F.filter(found, lambda x: F.length(x["value"]) >= least)


def scan(docs: DataFrame, text: str = "text", out: str = "candidates") -> DataFrame:
    """``docs`` without the text, with array<struct<start, end, kind, value>> by start, then kind."""
    t = text_of(text)
    found = F.concat(*[_matches(t, k) for k in range(len(KINDS))])
    by_start = lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(a["kind"] - b["kind"])
    return docs.withColumn(out, F.array_sort(found, by_start)).drop(text)


def ownership(candidates: DataFrame, repository: str, owner: str) -> DataFrame:
    """(h1, h2, n_repositories, n_owners) for each distinct value."""
    distinct = candidates.groupBy("h1", "h2", repository, owner).agg(F.count(F.lit(1)).alias("n"))
    by_owner = distinct.groupBy("h1", "h2", owner).agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("h1", "h2").agg(F.sum("repositories").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))


def find_secrets(docs: DataFrame, repository: str = "repository", owner: str = "owner", text: str = "text", copied_owners: int = 3, copied_repositories: int = 10, out: str = "secrets") -> DataFrame:
    """The columns of ``docs`` but the text, with array<struct<start, end, kind, class>> ``out``; class is 'live', 'shared' or 'copied'.

    ``kind`` is a position in ``KINDS``. A repository counts within its owner.
    """
    docs = docs.drop(out) if out in docs.columns else docs
    names = [c for c in docs.columns if c != text]
    row, spans, told, table = fresh(docs, "__row", "__found", "__classed", "__map")
    found = scan(docs, text, spans).withColumn(row, row_hash(docs.select(*[F.col(f"`{c}`") for c in names]), 1))
    hashed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.xxhash64(x["value"]).alias("h1"), F.xxhash64(F.lit(9), x["value"]).alias("h2"), ((F.length(x["value"]) >= 16) & x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")).alias("random")))
    found = keep(found.withColumn(spans, hashed), "secrets")
    rows = found.select(F.col(row).alias("row"), F.col(repository).alias("repository"), F.col(owner).alias("owner"), F.explode(spans).alias("c")).select("row", "repository", "owner", "c.*")
    owned = ownership(rows, "repository", "owner")
    widely = (F.col("n_owners") >= copied_owners) | ((F.col("n_owners") > 1) & (F.col("n_repositories") >= copied_repositories))
    kind = F.when(widely, "copied").when((F.col("n_owners") == 1) & F.col("random"), "live").otherwise("shared")
    # equal rows (every column but the text) share a hash and so each other's candidates; position and value keep them apart
    classed = rows.select("row", "start", "end", "kind", "h1", "h2", "random").distinct().hint("merge").join(owned.hint("merge"), ["h1", "h2"]).withColumn("class", kind)
    by_row = classed.groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind", "h1", "h2", "class")).alias(told))
    joined = found.join(by_row.withColumnRenamed("row", row), row, "left")
    key = lambda x: F.struct(x["start"], x["end"], x["kind"], x["h1"], x["h2"])
    looked_up = F.map_from_entries(F.transform(told, lambda x: F.struct(key(x), x["class"])))
    got = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.col(table)[key(x)].alias("class")))
    return joined.withColumn(table, looked_up).withColumn(out, got).select(*[F.col(f"`{c}`") for c in names], out)
