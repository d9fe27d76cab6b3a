"""A corpus digest that leads to what changed: digests of ranges of ids, of ranges of ranges, and so on.

A leaf has the records of LEAF consecutive ids: their number, and the sums of the
halves of their digests, so that no order matters. A node above has the sums of
FANOUT nodes below. An artifact stores its records by ranges together with this tree. Two
artifacts are compared from the top: only below nodes that differ the next level is
looked at, and only the ranges whose leaves differ are read. No task sees the corpus, and the top has few nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import bounded_broadcast
from .curate import artifact_drift

LEAF, FANOUT, LEVELS = 64, 16, 8
#: Levels of nodes whose records are stored in one folder: a folder is a node of this level.
FOLDER_LEVEL = 1
NODE = ("n", "h1", "h2")


def _half(at: int) -> Column:
    return F.conv(F.substring(F.sha2("digest", 256), at, 15), 16, 10).cast("decimal(38,0)")


def node_of(doc_id: str, level: int) -> Column:
    """The node of a level that an id is below."""
    return F.floor(F.col(doc_id) / (LEAF * FANOUT**level)).cast("long")


def tree(records: DataFrame) -> DataFrame:
    """``level, node, n, h1, h2`` of ``doc_id, digest``; each level is added up from the one below."""
    level = records.groupBy(node_of("doc_id", 0).alias("node")).agg(F.count("*").alias("n"), F.sum(_half(1)).cast("decimal(38,0)").alias("h1"), F.sum(_half(16)).cast("decimal(38,0)").alias("h2"))
    out = level.withColumn("level", F.lit(0))
    for k in range(1, LEVELS):
        level = level.groupBy(F.floor(F.col("node") / FANOUT).cast("long").alias("node")).agg(F.sum("n").alias("n"), *[F.sum(h).cast("decimal(38,0)").alias(h) for h in ("h1", "h2")])
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out.select("level", "node", *NODE)


@dataclass
class Artifact:
    """Records ``doc_id, digest`` stored by ranges of ids, with their tree."""

    spark: SparkSession
    path: str

    @classmethod
    def write(cls, records: DataFrame, path: str) -> "Artifact":
        rows = records.select("doc_id", "digest", node_of("doc_id", FOLDER_LEVEL).alias("folder"))
        rows.repartition("folder").sortWithinPartitions("folder", "doc_id").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/records")
        stored = records.sparkSession.read.parquet(f"{path}/records").select("doc_id", "digest")
        tree(stored).repartition("level").sortWithinPartitions("level", "node").write.mode("overwrite").partitionBy("level").parquet(f"{path}/tree")
        return cls(records.sparkSession, path)

    def level(self, k: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/tree/level={k}")

    def digest(self) -> DataFrame:
        """One row: the digest of all records."""
        return self.level(LEVELS - 1).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.sum(h).cast("decimal(38,0)").alias(h) for h in ("h1", "h2")])

    def records(self, leaves: DataFrame) -> DataFrame:
        """``doc_id, digest`` of some leaves (node), from their folders: Spark prunes the others when it runs."""
        # the comparison tells Spark that this side selects, without which it doesn't prune by it
        folders = bounded_broadcast(leaves.select(F.floor(F.col("node") / FANOUT**FOLDER_LEVEL).cast("long").alias("folder")).where(F.col("folder") > -(1 << 62)).distinct())
        rows = self.spark.read.schema("doc_id long, digest string, folder long").parquet(f"{self.path}/records").join(folders, "folder", "left_semi")
        return rows.withColumn("node", node_of("doc_id", 0)).join(bounded_broadcast(leaves), "node", "left_semi").select("doc_id", "digest")


def differing(a: Artifact, b: Artifact, path: str) -> DataFrame:
    """``node``: the leaves that differ. Each level's differing nodes are stored below ``path``, and the descent ends where there are none."""
    nodes = None
    for k in reversed(range(LEVELS)):
        x, y = a.level(k), b.level(k)
        if nodes is not None:
            below = bounded_broadcast(nodes.withColumnRenamed("node", "above"))
            x, y = (t.withColumn("above", F.floor(F.col("node") / FANOUT).cast("long")).join(below, "above", "left_semi").drop("above") for t in (x, y))
        same = F.lit(True)
        for c in NODE:
            same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
        found = x.alias("x").join(y.alias("y"), "node", "full").where(~same).select("node")
        found.write.mode("overwrite").parquet(f"{path}/{k}")
        nodes = a.spark.read.schema("node long").parquet(f"{path}/{k}")
        if nodes.isEmpty():
            break
    return nodes


def drift(a: Artifact, b: Artifact, path: str) -> DataFrame:
    """``doc_id, fault`` as ``curate.artifact_drift`` of all records, read from the ranges that differ alone."""
    leaves = differing(a, b, path)
    return artifact_drift(a.records(leaves), b.records(leaves))
