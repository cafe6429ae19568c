"""Shared folder, written tables and null-safe column helpers for the operators of this folder."""

from __future__ import annotations

import contextlib
import re
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as all operators here understand it: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    A local session that names none (a test) gets a temporary one; on a cluster that would be a folder of the driver alone, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="treeloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Removes a written query's shuffle files as soon as it has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_LOCK, _WRITES = threading.Lock(), {}


@contextlib.contextmanager
def _cleaning(spark: SparkSession):
    """``CLEANUP`` is on while any write of the session runs, and then what it was: writes may overlap."""
    with _LOCK:
        n, before = _WRITES.get(spark, (0, None))
        before = before if n else spark.conf.get(CLEANUP, "false")
        _WRITES[spark] = n + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITES.pop(spark)
            if n > 1:
                _WRITES[spark] = n - 1, before
            else:
                spark.conf.set(CLEANUP, before)


def keep(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends here.

    A lost executor then costs a re-read of files, not a recomputation, and the rows, their order in a file
    and their split into partitions no longer change between uses.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    with _cleaning(spark):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def free(*kept: DataFrame) -> None:
    """Delete tables of ``keep`` that nothing reads any more."""
    for df in kept:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def row_hash(df: DataFrame, seed: int) -> Column:
    """64 bits of all columns of a row, from ``seed``; maps and variants go through their JSON form."""
    parts = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if f.dataType.typeName() in ("map", "variant") else F.col(f"`{f.name}`") for f in df.schema.fields]
    return F.xxhash64(F.lit(seed), *parts)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until ``df`` has no column of it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
