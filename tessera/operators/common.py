"""Helpers of the operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

#: Rows, and bytes, up to which a side may be sent to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def _width(field: T.StructField) -> Column:
    """Bytes that a value takes, roughly."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, T.AtomicType):
        return F.lit(16)
    return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the frame has no more than so many rows and bytes; else leave the join to the optimizer."""
    width = F.lit(0)
    for f in df.schema.fields:
        width = width + _width(f)
    n, found = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and found <= size else df


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where all runs on this machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return f"{found.rstrip('/')}/tessera-engine"
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="tessera-engine-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc._jsc.sc().conf().set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}/tessera-engine"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, so that what uses it twice computes it once."""
    path = f"{scratch(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal a frame that comes in fewer partitions than the session shuffles with, as one small file does."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n) if df.rdd.getNumPartitions() < min(n, 8) else df


def ranked(df: DataFrame, group: list[str], order: list[Column], k: int | None = None, offset: int = 0, name: str = "rank") -> DataFrame:
    """Rank within groups from 1; with ``k``, only ranks offset+1 to offset+k."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return out if k is None else out.where((F.col(name) > offset) & (F.col(name) <= offset + k))
