"""Helpers shared by the training-data operators.

Intermediate results that must outlive an executor are written as Parquet below
the folder the session names in ``spark.checkpoint.dir`` and read back, which
cuts lineage without any executor-local copy.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

#: Internal columns start with this; ``shielded`` moves columns of the caller out of the way.
OWN = "_tessera_"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows in an Arrow batch sent to Python while tables are staged, unless the session has its own value.
#: Spark bounds a batch's bytes too (``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB), so many long texts are split.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where none is set, a temporary one, but only if everything runs on this machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    done = sc._jsc.sc().getCheckpointDir()
    if done.isDefined():
        return done.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(f"file://{made}")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Session settings for as long as a job runs; what was there before comes back."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession):
    """Bound the rows of an Arrow batch while a job runs, as single texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    return settings(spark, {key: str(BATCH_ROWS)} if spark.conf.get(key) == "10000" else {})


#: The folder that intermediate tables go to now, if ``workspace`` has set one.
_workspace: ContextVar[str | None] = ContextVar("workspace", default=None)


@contextmanager
def workspace(spark: SparkSession, label: str):
    """A folder of its own for all intermediate tables that are made within; who opens it deletes it, once what reads them is written."""
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    before = _workspace.set(path)
    try:
        yield path
    finally:
        _workspace.reset(before)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_workspace.get() or shared_dir(spark) + '/tessera'}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with columns that look like internal ones renamed, and from each of its names to the one it has now."""
    taken = {c.lower() for c in docs.columns}
    names: dict[str, str] = {c: c for c in docs.columns}
    for i, c in enumerate(docs.columns):
        if c.lower().startswith(OWN):
            new = f"moved{i}"
            while new in taken:
                new += "_"
            names[c] = new
            taken.add(new)
    return (docs.withColumnsRenamed({c: new for c, new in names.items() if c != new}) if any(c != n for c, n in names.items()) else docs), names


def unshielded(names: dict[str, str]) -> list:
    """The caller's columns, under their own names."""
    return [F.col(quoted(new)).alias(c) for c, new in names.items()]


#: Rows of one number up to which a side may be sent to every executor, some 24 MB there.
BROADCAST_ROWS = 1_000_000


def if_small(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a narrow frame that has no more than ``rows`` rows, counted; beyond that both sides are shuffled."""
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys


def text_of(name: str = "text"):
    """A text column as string, null as empty."""
    return F.coalesce(F.col(quoted(name)).cast("string"), F.lit(""))


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def ascii_lower(col):
    """Lower-case the letters A to Z only."""
    return F.translate(col, UPPER, LOWER)


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def group_index(keys: np.ndarray, seen: dict) -> np.ndarray:
    """Number the rows of each key in order of arrival, going on from ``seen``."""
    out = np.empty(len(keys), np.int64)
    if not len(keys):
        return out
    order = np.argsort(keys, kind="stable")
    ks = keys[order]
    starts = np.flatnonzero(np.r_[True, ks[1:] != ks[:-1]])
    sizes = np.diff(np.r_[starts, len(ks)])
    base = np.array([seen.get(k, 0) for k in ks[starts].tolist()], np.int64)
    out[order] = np.arange(len(ks)) - np.repeat(starts, sizes) + np.repeat(base, sizes)
    for k, n in zip(ks[starts].tolist(), (base + sizes).tolist()):
        seen[k] = n
    return out


PART, INDEX = OWN + "part", OWN + "index"


def numbered(df: DataFrame, key: str, label: str) -> DataFrame:
    """Stage ``df`` with the number of its partition and of each row among its key there.

    Rows with the same key need not meet in one task: ``with_rank`` turns the two
    numbers into a gapless rank by the running totals of (key, partition).
    """
    schema = T.StructType(df.schema.fields + [T.StructField(PART, T.IntegerType()), T.StructField(INDEX, T.LongType())])

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            index = group_index(b.column(key).to_numpy(zero_copy_only=False), seen)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(index), part, np.int32)), pa.array(index)], names=[*b.schema.names, PART, INDEX])

    return staged(df.mapInArrow(run, schema), label)


def with_rank(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Replace the numbers of ``numbered`` by a rank within the key, gapless from 0.

    The window runs over one row per (key, partition), never over the rows.
    """
    counts = rows.groupBy(key, PART).agg((F.max(INDEX) + 1).alias(OWN + "n"))
    before = F.sum(OWN + "n").over(Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(key, PART, F.coalesce(before, F.lit(0)).alias(OWN + "before"))
    return rows.join(offsets, [key, PART]).withColumn(name, F.col(INDEX) + F.col(OWN + "before")).drop(PART, INDEX, OWN + "before")
