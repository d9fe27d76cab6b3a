"""Vectors of texts: a truncated singular value decomposition of TF-IDF, fitted by passes over the texts.

Terms are hashed to FEATURES columns, so all that is held is of that size, whatever the
vocabulary. The texts are read once: what is stored of them is their terms' columns, and
every pass reads that. A pass counts the documents of each column. Then each of PASSES passes
multiplies the matrix of all documents, row by row in numpy, with a basis of DIMS
columns and back: tasks add up what their rows give, Spark adds up the tasks' sums in
blocks of columns, and the driver orthogonalises the result, FEATURES by DIMS numbers. What
comes out spans the directions in which documents differ most. A text's vector is its
TF-IDF row in that basis, at length one.

Null texts, and texts without a term that tells anything, have no vector and are left out by ``embedded``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from .common import spread, staged

FEATURES, DIMS, PASSES = 1 << 13, 64, 3
#: Columns whose sums travel in one row; texts of an Arrow batch.
BLOCK, BATCH = 256, 32
TOLERANCE = 1e-3


def counted(docs: DataFrame, features: int) -> DataFrame:
    """``doc_id, all``: the columns of each document's terms in order, as often as they occur; from ``doc_id, tokens``."""
    return docs.select("doc_id", F.array_sort(F.transform("tokens", lambda t: F.pmod(F.xxhash64(t), F.lit(features)).cast("int"))).alias("all"))


def _rows(batch: pa.RecordBatch, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, weight) of a batch's TF-IDF rows, each row of length one."""
    lists = batch.column("all")
    size = np.diff(np.frombuffer(lists.buffers()[1], "<i4")[lists.offset : lists.offset + len(lists) + 1]) if len(lists) else np.empty(0, int)
    size = np.where(np.array(lists.is_valid()), size, 0)
    row, column = np.repeat(np.arange(len(lists)), size), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    key = row * len(idf) + column
    if (key[1:] < key[:-1]).any():  # as ``counted`` has them, they are in order
        key = np.sort(key)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
    n = np.diff(np.r_[first, len(key)])
    row, column = key[first] // len(idf), key[first] % len(idf)
    w = (1 + np.log(n)) * idf[column]
    norm = np.sqrt(np.bincount(row, w * w, len(lists)))
    return row, column, w / np.where(norm[row] > 0, norm[row], 1)


def _times(row: np.ndarray, column: np.ndarray, w: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """The rows times the basis."""
    out = np.zeros((n, basis.shape[1]))
    cuts = np.searchsorted(row, np.arange(n + 1))
    for i in range(n):
        a, b = cuts[i], cuts[i + 1]
        if b > a:
            out[i] = w[a:b] @ basis[column[a:b]]
    return out


def _gather(total: np.ndarray, batch: pa.RecordBatch, own: "Embedder") -> None:
    """Add the rows' products with the basis to their columns; BATCH texts at a time, as each entry takes a row of the basis."""
    for at in range(0, batch.num_rows, BATCH):
        part = batch.slice(at, BATCH)
        row, column, w = _rows(part, own.idf)
        y = _times(row, column, w, own.basis, part.num_rows)
        cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            total[column[a:b]] += w[a:b, None] * y[i]  # a row has a column once


@dataclass
class Embedder:
    """Weights of the columns and a basis; sent to tasks as it is, some megabytes."""

    idf: np.ndarray
    basis: np.ndarray

    @classmethod
    def fit(cls, docs: DataFrame, dims: int = DIMS, features: int = FEATURES, passes: int = PASSES, seed: int = 0) -> "Embedder":
        """From ``doc_id, tokens`` (see ``lexical.tokenized``), or from what ``counted`` makes of it, which each pass reads."""
        spark, rows = docs.sparkSession, docs if "all" in docs.columns else staged(counted(docs, features), "counted")
        df = rows.select(F.explode(F.array_distinct("all")).alias("at")).groupBy("at").agg(F.count("*").alias("df")).toArrow()  # one row a column
        n = rows.where(F.size("all") > 0).count()
        idf = np.zeros(features)
        idf[df.column("at").to_numpy()] = np.log(n / df.column("df").to_numpy()) if n else 0
        basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((features, dims)))[0]
        for _ in range(passes):
            sent = spark.sparkContext.broadcast(cls(idf, basis))  # FEATURES by DIMS numbers

            def run(batches, sent=sent):
                own, total = sent.value, np.zeros((features, dims))
                for b in batches:
                    _gather(total, b, own)
                for k in range(0, features, BLOCK):
                    if total[k : k + BLOCK].any():
                        yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([total[k : k + BLOCK].tobytes()], pa.binary())], names=["block", "sums"])

            def add(key, table):
                return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([sum(np.frombuffer(x.as_py(), "<f8") for x in table.column("sums")).tobytes()], pa.binary())})

            sums = np.zeros((features, dims))
            got = rows.select("all").mapInArrow(run, "block int, sums binary").groupBy("block").applyInArrow(add, "block int, sums binary")
            for r in got.collect():  # FEATURES by DIMS numbers
                part = np.frombuffer(bytes(r["sums"]), "<f8").reshape(-1, dims)
                sums[r["block"] * BLOCK : r["block"] * BLOCK + len(part)] = part
            basis = np.linalg.qr(sums)[0] if sums.any() else basis
        return cls(idf, basis)

    def embedded(self, docs: DataFrame) -> DataFrame:
        """``doc_id, vector array<float>`` of ``doc_id, tokens``, or of these counted: unit vectors, checked in the pass that makes them."""
        rows, sent = docs if "all" in docs.columns else counted(docs, len(self.idf)), docs.sparkSession.sparkContext.broadcast(self)
        kind = rows.schema["doc_id"].dataType.simpleString()

        def run(batches):
            own = sent.value
            for b in batches:
                for at in range(0, b.num_rows, BATCH):
                    part = b.slice(at, BATCH)
                    y = _times(*_rows(part, own.idf), own.basis, part.num_rows)
                    norm = np.sqrt((y * y).sum(1))
                    some = norm > 1e-9
                    x = (y[some] / norm[some, None]).astype(np.float32)
                    if (np.abs(np.sqrt((x.astype(np.float64) ** 2).sum(1)) - 1) > TOLERANCE).any() or not np.isfinite(x).all():
                        raise ValueError("a vector isn't of length one")
                    ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").filter(pa.array(some)), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["doc_id", "vector"])

        return rows.select("doc_id", "all").mapInArrow(run, f"doc_id {kind}, vector array<float>")

    def queries(self, queries: DataFrame, text: str = "query") -> DataFrame:
        """``qid, vector`` of texts."""
        tokens = spread(queries).select(F.col("qid").alias("doc_id"), T.tokenize(text).alias("tokens"))
        return self.embedded(tokens).withColumnRenamed("doc_id", "qid")
