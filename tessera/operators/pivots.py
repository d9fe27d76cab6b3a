"""Exact vector search that rules blocks of vectors out before it multiplies them.

Vectors go to the nearest of at most PIVOTS pivots and, ordered by their distance from
it, into blocks. A block knows its pivot, the least and the largest distance of its
vectors from the pivot, and their largest length. By the triangle inequality a query's distance from any
vector of the block is at least its distance from the pivot less the largest, and at
least the least less its distance from the pivot; so no product can be larger than
half of what the squared lengths exceed that distance squared. A block is multiplied only with the queries
for which that reaches the k-th best product they have found in their own pivot's blocks.

The pivots are a bounded sample; they decide what is skipped and never what is found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ranked

PIVOTS, BLOCK = 256, 512
#: Queries that are sent to every executor at once; more are searched in turns by the caller.
MOST_QUERIES = 20_000
SLACK = 1e-6
FOUND = "qid long, doc_id long, score double, done long, pairs long"
BLOCKS = "pivot int, near double, far double, length double, ids binary, vectors binary"


@dataclass
class PivotIndex:
    spark: SparkSession
    path: str
    pivots: np.ndarray

    @classmethod
    def build(cls, vectors: DataFrame, path: str, pivots: int = PIVOTS, block: int = BLOCK) -> "PivotIndex":
        """From ``doc_id, vector``; vectors of one length, others than null."""
        rows = vectors.where("vector is not null and size(vector) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("vector").cast("array<double>").alias("vector"))
        some = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(pivots).toArrow()  # a bounded sample
        centres = np.array(some.column("vector").to_pylist(), np.float64)
        if not len(centres):
            rows.sparkSession.createDataFrame([], BLOCKS).write.mode("overwrite").parquet(path)
            return cls(rows.sparkSession, path, centres.reshape(0, 1))
        sent = rows.sparkSession.sparkContext.broadcast(centres)  # PIVOTS vectors

        def deal(batches):
            c = sent.value
            for b in batches:
                x = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                d = (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T
                own = d.argmin(1)
                away = np.sqrt(((x - c[own]) ** 2).sum(1))  # not from d, which is less exact
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(away), b.column("doc_id"), b.column("vector")], names=["pivot", "away", "doc_id", "vector"])

        dealt = rows.mapInArrow(deal, "pivot int, away double, doc_id long, vector array<double>")
        # in order of distance within a pivot; a frequent pivot is in several tasks, each with blocks of its own range
        ordered = dealt.repartitionByRange("pivot", "away").sortWithinPartitions("pivot", "away", "doc_id")

        def pack(batches):
            held: list[pa.RecordBatch] = []

            def out(t: pa.Table):
                p = t.column("pivot").to_numpy()
                cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]
                for a, b in zip(cuts, cuts[1:]):
                    for i in range(a, b, block):
                        part = t.slice(i, min(block, b - i))
                        x, away = part.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), part.column("away").to_numpy()
                        yield pa.RecordBatch.from_arrays([pa.array([int(p[i])], pa.int32()), pa.array([away.min()]), pa.array([away.max()]), pa.array([np.sqrt((x * x).sum(1)).max()]), pa.array([part.column("doc_id").to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([x.astype("<f8").tobytes()], pa.binary())], names=["pivot", "near", "far", "length", "ids", "vectors"])

            for b in batches:
                held.append(b)
                if sum(x.num_rows for x in held) >= 16 * block:
                    yield from out(pa.Table.from_batches(held))
                    held = []
            if held:
                yield from out(pa.Table.from_batches(held))

        ordered.mapInArrow(pack, BLOCKS).write.mode("overwrite").parquet(path)
        return cls(rows.sparkSession, path, centres)

    def _asked(self, queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = queries.where("vector is not null and size(vector) > 0").select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<double>").alias("vector")).limit(MOST_QUERIES + 1).toArrow()
        if got.num_rows > MOST_QUERIES:
            raise ValueError(f"more than {MOST_QUERIES} queries; search them in turns, or all pairs by dense.search")
        return got.column("qid").to_numpy(), np.array(got.column("vector").to_pylist(), np.float64)

    def _best(self, qids: np.ndarray, q: np.ndarray, most: int, exclude_self: bool, least: np.ndarray | None) -> DataFrame:
        """``qid, doc_id, score, done, pairs``: each block's best; of the queries' own pivots' blocks only where ``least`` is None, else of all blocks that may reach it."""
        if not len(q) or not len(self.pivots):
            return self.spark.createDataFrame([], FOUND)
        away = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * q @ self.pivots.T, 0))
        sent = self.spark.sparkContext.broadcast((qids, q, away, (q * q).sum(1), least))  # at most MOST_QUERIES vectors

        def run(batches):
            qids, q, away, square, least = sent.value
            own = away.argmin(1)
            for b in batches:
                for p, near, far, length, ids, raw in zip(*(b.column(c).to_pylist() for c in ("pivot", "near", "far", "length", "ids", "vectors"))):
                    ids = np.frombuffer(ids, "<i8")
                    if least is None:
                        who = np.flatnonzero(own == p)
                    else:
                        gap = np.maximum(0, np.maximum(away[:, p] - far, near - away[:, p]) - SLACK)
                        who = np.flatnonzero((square + length * length - gap * gap) / 2 + SLACK >= least)
                    if not len(who):
                        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.float64()), pa.array([0], pa.int64()), pa.array([len(ids) * len(q)], pa.int64())], names=["qid", "doc_id", "score", "done", "pairs"])
                        continue
                    s = np.round(q[who] @ np.frombuffer(raw, "<f8").reshape(len(ids), -1).T, 9)
                    if exclude_self:
                        s[qids[who][:, None] == ids[None, :]] = -np.inf
                    order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :most]
                    best = np.take_along_axis(s, order, 1).reshape(-1)
                    keep = best > -np.inf
                    n = int(keep.sum())
                    done, pairs = np.zeros(n, np.int64), np.zeros(n, np.int64)
                    done[:1], pairs[:1] = len(ids) * len(who), len(ids) * len(q)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids[who], order.shape[1])[keep]), pa.array(ids[order].reshape(-1)[keep]), pa.array(best[keep]), pa.array(done), pa.array(pairs)], names=["qid", "doc_id", "score", "done", "pairs"])

        return self.spark.read.schema(BLOCKS).parquet(self.path).mapInArrow(run, FOUND)

    def candidates(self, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
        qids, q = self._asked(queries)
        first = self._best(qids, q, k, exclude_self, None).where("qid is not null")
        bound = ranked(first, ["qid"], [F.col("score").desc()], 1, k - 1).select("qid", "score").toArrow()  # a number a query
        least = dict(zip(bound.column("qid").to_pylist(), bound.column("score").to_pylist()))
        return self._best(qids, q, k, exclude_self, np.array([least.get(i, -np.inf) for i in qids.tolist()], np.float64))

    def search(self, queries: DataFrame, k: int = 10, offset: int = 0, exclude_self: bool = False) -> DataFrame:
        """As ``dense.search``: the same rows."""
        found = self.candidates(queries, k + offset, exclude_self).where("qid is not null")
        return ranked(found, ["qid"], [F.col("score").desc(), F.col("doc_id")], k, offset).select("qid", "rank", "doc_id", F.round("score", 6).alias("score"))

    def skipped(self, queries: DataFrame, k: int = 10) -> float:
        """The share of products that a search rules out."""
        r = self.candidates(queries, k).agg(F.sum("done"), F.sum("pairs")).first()
        return 1 - r[0] / r[1] if r[1] else 0.0
