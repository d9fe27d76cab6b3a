"""Vector ranking: exact scans, nearest neighbours, fusion and comparison of rankers.

Products accumulate in double precision. Vectors and queries are packed into rows
of many each; every block of queries meets every block of vectors, in numpy, and
a task gives back each query's best only. Few query blocks are broadcast, which is checked; more
of them meet the vectors in Spark's own blocks. Nothing passes the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from .common import bounded_broadcast, ranked, staged

RRF_K, RRF_DEPTH = 60, 100
#: Vectors, and query vectors, that travel in one row, and that are multiplied at once; they bound a task's memory.
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 4096
TILE_VECTORS, TILE_QUERIES = 2048, 512
#: Query blocks in one partition, where they are more than can be sent to every executor.
PART_BLOCKS = 16
#: Products are ranked by so many digits.
DIGITS = 9
NEIGHBOURS_MOST = 50


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(T.col(a).cast("array<double>"), T.col(b).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def packed(rows: DataFrame, id_col: str, most: int, prefix: str) -> DataFrame:
    """``<prefix>ids, <prefix>vectors``: up to ``most`` rows' ids and vectors, as little-endian 64-bit numbers, in each row."""

    def run(batches):
        for b in batches:
            for i in range(0, len(b), most):
                part = b.slice(i, most)
                ids, x = part.column(0).to_numpy(), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1).astype("<f8")
                yield pa.RecordBatch.from_arrays([pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=[f"{prefix}ids", f"{prefix}vectors"])

    return rows.where("vector is not null and size(vector) > 0").select(F.col(id_col).cast("long"), "vector").mapInArrow(run, f"{prefix}ids binary, {prefix}vectors binary")


class Best:
    """The ``most`` best hits of each query of a block, so far: highest product first, ties to the lower id."""

    def __init__(self, qids: np.ndarray, most: int):
        self.qids, self.most = qids, most
        self.row, self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.least = np.full(len(qids), -np.inf)  # the last of a query's hits, once it has all

    def add(self, at: int, s: np.ndarray, ids: np.ndarray, exclude_self: bool) -> None:
        """Products of the queries from ``at`` on with some vectors; only those are sorted that may be among the best."""
        own, least = self.qids[at : at + len(s)], self.least[at : at + len(s)]
        if exclude_self and len(cols := np.flatnonzero(np.isin(ids, own))):
            s[:, cols] = np.where(own[:, None] == ids[cols], -np.inf, s[:, cols])
        if s.shape[1] > self.most and np.isneginf(least).any():
            if np.isnan(s).any():
                s[np.isnan(s)] = -np.inf
            least = np.maximum(least, np.partition(s, -self.most, axis=1)[:, -self.most])
        row, col = np.nonzero(s >= (least - 10.0**-DIGITS)[:, None])
        score = np.round(s[row, col], DIGITS)
        fine = score > -np.inf
        if not fine.any():
            return
        row, found, score = (np.concatenate(x) for x in ((self.row, row[fine] + at), (self.ids, ids[col[fine]]), (self.scores, score[fine])))
        order = np.lexsort((found, -score, row))
        row, found, score = row[order], found[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.most
        self.row, self.ids, self.scores = row[keep], found[keep], score[keep]
        last = place == self.most - 1
        self.least[row[last]] = score[last]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, offset: int = 0, exclude_self: bool = False) -> DataFrame:
    """``qid, rank, doc_id, score``: highest product first, ties to the lower id; queries without a vector give nothing.

    Queries are packed once and stored. A task multiplies its vectors with them, some
    at a time, and keeps each query's best; those alone leave the task.
    """
    most = k + offset
    n = queries.where("vector is not null and size(vector) > 0").count()
    dealt = queries.select("qid", "vector").repartition(max(1, -(-n // (BLOCK_QUERIES * PART_BLOCKS))))
    asked = staged(packed(dealt, "qid", BLOCK_QUERIES, "q").withColumn("block", F.monotonically_increasing_id()), "asked")
    blocks = packed(vectors, "doc_id", BLOCK_VECTORS, "v").crossJoin(bounded_broadcast(asked))

    def run(batches):
        best: dict[int, Best] = {}
        for b in batches:
            for vi, vx, qi, qx, block in zip(*(b.column(c) for c in ("vids", "vvectors", "qids", "qvectors", "block"))):
                ids, qids = (np.frombuffer(x.as_buffer(), "<i8") for x in (vi, qi))
                v, q = (np.frombuffer(x.as_buffer(), "<f8").reshape(len(i), -1) for x, i in ((vx, ids), (qx, qids)))
                if (number := block.as_py()) not in best:
                    best[number] = Best(qids.copy(), most)
                for i in range(0, len(ids), TILE_VECTORS):
                    for j in range(0, len(qids), TILE_QUERIES):
                        best[number].add(j, q[j : j + TILE_QUERIES] @ v[i : i + TILE_VECTORS].T, ids[i : i + TILE_VECTORS], exclude_self)
        for x in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(x.qids[x.row]), pa.array(x.ids), pa.array(x.scores)], names=["qid", "doc_id", "score"])

    found = blocks.mapInArrow(run, "qid long, doc_id long, score double")
    return ranked(found, ["qid"], [F.col("score").desc(), F.col("doc_id")], k, offset).select("qid", "rank", "doc_id", F.round("score", 6).alias("score"))


def with_total(hits: DataFrame, vectors: DataFrame) -> DataFrame:
    """``total`` beside each hit: a dense search ranks every vector there is."""
    total = vectors.where("vector is not null and size(vector) > 0").agg(F.count("*").alias("total"))
    return hits.crossJoin(F.broadcast(total))  # one row


def similar(vectors: DataFrame, ids: DataFrame, k: int = 10) -> DataFrame:
    """Nearest neighbours of stored vectors, themselves left out; unknown ids give nothing."""
    queries = vectors.join(bounded_broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi").select(F.col("doc_id").alias("qid"), "vector")
    return search(vectors, queries, min(k, NEIGHBOURS_MOST), exclude_self=True)


def explain(hits: DataFrame) -> DataFrame:
    return hits.withColumn("angle_deg", F.round(T.angle_degrees("score"), 4))


def hashed_vectors(docs: DataFrame, tokens: str = "tokens", dims: int = 64) -> DataFrame:
    """``doc_id, vector``: signed hashing of tokens, unit length; a stand-in where no embedding model is at hand."""
    rows = docs.select("doc_id", F.explode(tokens).alias("t")).withColumn("h", F.xxhash64("t"))
    rows = rows.groupBy("doc_id", F.pmod("h", F.lit(dims)).cast("int").alias("slot")).agg(F.sum(F.when(F.shiftright("h", 40) % 2 == 0, 1.0).otherwise(-1.0)).alias("v"))
    norm = rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return norm.where("norm > 0").select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm")).cast("array<float>").alias("vector"))


def fuse(lexical: DataFrame, dense: DataFrame, k: int = 10, offset: int = 0, depth: int = RRF_DEPTH) -> DataFrame:
    """Reciprocal-rank fusion of two ranked legs: ``qid, rank, doc_id, score, lex_rank, dense_rank, total``, and the lexical leg's ``matched_terms`` where it has them."""
    depth = max(depth, k + offset)
    terms = ["matched_terms"] if "matched_terms" in lexical.columns else []
    left = lexical.where(F.col("rank") <= depth).select("qid", "doc_id", F.col("rank").alias("lex_rank"), *terms)
    right = dense.where(F.col("rank") <= depth).select("qid", "doc_id", F.col("rank").alias("dense_rank"))
    both = left.join(right, ["qid", "doc_id"], "full").withColumn("score", rrf_part("lex_rank") + rrf_part("dense_rank"))
    both = both.withColumn("total", F.count("*").over(Window.partitionBy("qid")))  # at most twice ``depth`` rows a query
    top = ranked(both, ["qid"], [F.round("score", 12).desc(), F.col("lex_rank").asc_nulls_last(), F.col("doc_id")], k, offset)
    out = top.select("qid", "rank", "doc_id", F.round("score", 9).alias("score"), "lex_rank", "dense_rank", "total", *terms)
    return out.withColumn("matched_terms", F.coalesce("matched_terms", F.array().cast("array<string>"))) if terms else out


def rrf_part(rank: str) -> Column:
    """What a leg adds for a rank; nothing where it hasn't the document."""
    return F.coalesce(1.0 / (RRF_K + F.col(rank)), F.lit(0.0))


def explain_fused(fused: DataFrame) -> DataFrame:
    """``qid, rank, doc_id, lex_rank, dense_rank, lex_contribution, dense_contribution, total``."""
    a, b = rrf_part("lex_rank"), rrf_part("dense_rank")
    return fused.select("qid", "rank", "doc_id", "lex_rank", "dense_rank", F.round(a, 9).alias("lex_contribution"), F.round(b, 9).alias("dense_contribution"), F.round(a + b, 9).alias("total"))


HITS = "ranker string, qid long, rank int, doc_id long, score double"


def compare(runs: dict[str, DataFrame | Callable[[], DataFrame]], path: str) -> tuple[DataFrame, DataFrame]:
    """The rankers' results in one frame with the ranker's name, and ``ranker, error`` of those that failed.

    Each ranker is a job of its own, whose result is stored below ``path``: one that
    fails, while its plan is made or while it runs, leaves its error and takes nobody else's rows with it.
    """
    done, errors, spark = [], [], None
    for name, run in runs.items():
        try:
            part = (run() if callable(run) else run).select(F.lit(name).alias("ranker"), F.col("qid").cast("long").alias("qid"), F.col("rank").cast("int").alias("rank"), F.col("doc_id").cast("long").alias("doc_id"), F.col("score").cast("double").alias("score"))
            spark = part.sparkSession
            part.write.mode("overwrite").parquet(f"{path}/{name}")
            done.append(f"{path}/{name}")
        except Exception as e:  # a ranker may fail in any way
            errors.append((name, str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__))
    spark = spark or SparkSession.getActiveSession()
    return (spark.read.schema(HITS).parquet(*done) if done else spark.createDataFrame([], HITS)), spark.createDataFrame(errors, "ranker string, error string")


def legs(lexical: DataFrame, dense: DataFrame, k: int = 10) -> DataFrame:
    """``leg, qid, rank, doc_id, score``: what each leg of a fused search had first."""
    part = lambda hits, name: hits.where(F.col("rank") <= k).select(F.lit(name).alias("leg"), "qid", "rank", "doc_id", "score")
    return part(lexical, "lexical").unionByName(part(dense, "dense"))


def rank_delta(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """``qid, doc_id, rank_a, rank_b, move``: absent, same, up or down from a to b."""
    x = a.where(F.col("rank") <= k).select("qid", "doc_id", F.col("rank").alias("rank_a"))
    y = b.where(F.col("rank") <= k).select("qid", "doc_id", F.col("rank").alias("rank_b"))
    move = F.when(F.col("rank_a").isNull() | F.col("rank_b").isNull(), "absent").when(F.col("rank_a") == F.col("rank_b"), "same").when(F.col("rank_b") < F.col("rank_a"), "up").otherwise("down")
    return x.join(y, ["qid", "doc_id"], "full").withColumn("move", move)
