"""Writers. Each is safe to run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_rows(rows: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """One row of each key: the first by ``order``, else by the row's content; counted together before the shuffle."""
    order = order if order is not None else F.to_json(F.struct(*rows.columns))
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")


def append_new(rows: DataFrame, path: str, key: str = "id", overwrite: bool = False, order: Column | None = None) -> None:
    """Append rows whose key isn't stored yet, one of each key (see ``first_rows``); with ``overwrite`` store them all."""
    spark = rows.sparkSession
    if overwrite:
        rows.write.mode("overwrite").parquet(path)
        return
    if _exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
    first_rows(rows, key, order).write.mode("append").parquet(path)


def append_urls(rows: DataFrame, path: str, key: Column | None = None, order: Column | None = None) -> None:
    """Append a block of seed URLs, each once: those stored already stay out. The whole trimmed line counts; ``key``: another form to compare, as ``T.normal_url``."""
    from ..functions import text as T

    append_new(rows.withColumn("url_key", key if key is not None else T.stripped("url")), path, "url_key", order=order)


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_vectors(vectors: DataFrame, path: str, tolerance: float = 1e-3) -> int:
    """Store unit vectors; refuse the lot if any has another norm or isn't a number. The commit protocol makes it atomic."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    bad = vectors.where(F.isnan(norm) | (F.abs(norm - 1) > tolerance)).count()
    if bad:
        raise ValueError(f"{bad} vectors aren't unit vectors")
    vectors.write.mode("overwrite").parquet(path)
    return vectors.sparkSession.read.parquet(path).count()


def write_raw_vectors(vectors: DataFrame, path: str, order: str = "doc_id") -> int:
    """Store vectors as little-endian 32-bit floats in order of ``order``, one ``.f32`` file a task; the number of rows.

    A file is written under another name and renamed, so a task that runs again leaves
    one whole file of the same rows. The folder must be one that ``pyarrow.fs`` opens.
    """
    from .readers import _qualified

    folder = _qualified(vectors.sparkSession, path)
    ordered = vectors.select(order, F.col("vector").cast("array<float>").alias("vector")).repartitionByRange(order).sortWithinPartitions(order)

    def run(batches):
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, own, n = f"{root}/part-{TaskContext.get().partitionId():06d}.f32", f"{root}/.{uuid.uuid4().hex}", 0
        with store.open_output_stream(own) as out:
            for b in batches:
                out.write(b.column("vector").flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes())
                n += b.num_rows
        store.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return ordered.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def append_events(events: DataFrame, path: str) -> None:
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def write_run(metrics: DataFrame, path: str, stamp: str) -> None:
    """A run under its stamp, and a copy under ``latest``."""
    metrics.write.mode("overwrite").json(f"{path}/runs/run={stamp}")
    metrics.withColumn("run", F.lit(stamp)).write.mode("overwrite").json(f"{path}/latest")


def review_rows(candidates: DataFrame) -> DataFrame:
    """``doc_id, candidates``: one row per record that has candidates."""
    return candidates.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("label", "confidence"))).alias("candidates")).where(F.size("candidates") > 0)


def review_queue(candidates: DataFrame, path: str) -> None:
    review_rows(candidates).write.mode("overwrite").json(path)


def split_rejects(rows: DataFrame, reasons: list[tuple[str, Column]], path: str) -> DataFrame:
    """Store rows with the first reason that holds; return the others."""
    why = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in reasons])
    marked = rows.withColumn("reason", why)
    marked.where("reason is not null").write.mode("overwrite").parquet(path)
    return marked.where("reason is null").drop("reason")


def enqueue(pending: DataFrame, new: DataFrame, stamp: str) -> DataFrame:
    """The queue with unseen ids added and stamped."""
    return pending.unionByName(new.select("id").distinct().join(pending, "id", "left_anti").withColumn("first_seen", F.lit(stamp)))


def drain(pending: DataFrame, found: DataFrame) -> DataFrame:
    return pending.join(found.select("id"), "id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New values where there are any, old ones elsewhere; nothing is deleted."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc("_new"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def merge_owned(sheet: DataFrame, own: DataFrame, key: str, owned: list[str]) -> DataFrame:
    """Update only the owned columns of rows that exist, append rows that don't, delete none."""
    fresh = own.select(key, *[F.col(c).alias(f"_own_{c}") for c in owned], F.lit(True).alias("_there"))
    rows = sheet.join(fresh, key, "full")
    return rows.select(key, *[F.when(F.col("_there"), F.col(f"_own_{c}")).otherwise(F.col(c)).alias(c) if c in owned else F.col(c) for c in sheet.columns if c != key])


def replace_blocks(rows: DataFrame, path: str, block: str) -> None:
    """Replace the blocks that rows have; other blocks stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(block).parquet(path)
