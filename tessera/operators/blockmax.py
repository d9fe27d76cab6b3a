"""A stored index that answers top-k searches without reading most postings.

Documents lie in blocks of GRID * GRIDS, each block in GRIDS *cells* of GRID
documents. A row of the index is a term in a block: the largest contribution that
the term makes in each cell it is in, and its postings, as packed numbers. The
row of the empty term has the block's ids and lengths. A task makes the rows of
its blocks by itself, so postings are shuffled once, packed, to their buckets.

A search first adds up the cells' largest contributions over the query's terms,
without any posting. The documents of the cells that do best are scored in full,
and the k-th of these scores is a bound; a cell whose sum is below it can't hold
a hit. Only the postings of the other cells are taken and scored. No hit is lost:
a document's score is at most its cell's sum. All rows of a block meet in one
group, so sums and scores arise where the block is.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import lexical
from .common import bounded_broadcast, ranked, staged

#: Documents of a cell, and cells of a block.
GRID, GRIDS = 8, 32
#: Folders that terms are dealt to; documents for each further file of a folder, so that a frequent term is in several.
BUCKETS, FILE_DOCUMENTS = 64, 200_000
#: For each hit wanted, the cells whose documents are scored for the bound.
TRIALS = 2
#: Scores are decided by nine places; bounds are taken lower by this.
SLACK = 1e-6
PACKED = "term string, block long, cells binary, bm25 binary, tfidf binary, at binary, tf binary, ids binary"


def weights(ranker: str, tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    """What a posting contributes, but for its term's idf."""
    return tf * (lexical.K1 + 1) / (tf + lexical.K1 * (1 - lexical.B + lexical.B * dl / avgdl)) if ranker == "bm25" else tf / dl


def packed(block: int, ids: list[int], texts: list[str], avgdl: float) -> pa.RecordBatch:
    """The rows of one block, from its documents' ids and space-joined tokens."""
    counts = [Counter(x.split()) for x in texts]
    dl = np.array([c.total() for c in counts], float)
    terms = sorted(set().union(*counts))
    number = {x: i for i, x in enumerate(terms)}
    at = np.repeat(np.arange(len(ids)), [len(c) for c in counts])
    term = np.array([number[w] for c in counts for w in c], np.int64)
    tf = np.array([n for c in counts for n in c.values()], np.int64)
    order = np.lexsort((at, term))
    term, at, tf = term[order], at[order], tf[order]
    cell = at // GRID
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (cell[1:] != cell[:-1])]) if len(term) else np.zeros(0, np.int64)
    most = [np.maximum.reduceat(weights(r, tf.astype(float), dl[at], avgdl), first) if len(term) else np.zeros(0) for r in lexical.RANKERS]
    ends, cut = np.searchsorted(term, np.arange(len(terms) + 1)), np.searchsorted(term[first], np.arange(len(terms) + 1))

    def binary(x, kind, offsets):
        raw = np.ascontiguousarray(x, kind)
        return pa.array([raw[a:b].tobytes() for a, b in zip(offsets, offsets[1:])], pa.binary())

    rows = [pa.array(terms, pa.string()), pa.array([block] * len(terms), pa.int64()), binary(cell[first], "<u1", cut), *(binary(m, "<f8", cut) for m in most), binary(at, "<u1", ends), binary(tf, "<i4", ends), pa.nulls(len(terms), pa.binary())]
    own = ["", block, b"", b"", b"", np.arange(len(ids)).astype("<u1").tobytes(), dl.astype("<i4").tobytes(), np.array(ids, "<i8").tobytes()]
    names = [x.split()[0] for x in PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([x, pa.array([y], x.type)]) for x, y in zip(rows, own)], names=names)


@dataclass
class BlockIndex:
    spark: SparkSession
    path: str

    @staticmethod
    def bucket(term: str = "term") -> Column:
        return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")

    @classmethod
    def build(cls, docs: DataFrame, path: str) -> "BlockIndex":
        """From ``doc_id, tokens, dl`` (see ``lexical.tokenized``)."""
        spark = docs.sparkSession
        words = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "dl", F.array_join("tokens", " ").alias("words")), "words")
        lexical.corpus_stats(words).coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")
        n, avgdl = spark.read.parquet(f"{path}/corpus").first()

        def run(batches):
            from pyspark import TaskContext

            block, ids, texts = TaskContext.get().partitionId() << 32, [], []
            for b in batches:
                ids, texts = ids + b.column(0).to_pylist(), texts + b.column(1).to_pylist()
                while len(ids) >= GRID * GRIDS:
                    yield packed(block, ids[: GRID * GRIDS], texts[: GRID * GRIDS], avgdl)
                    block, ids, texts = block + 1, ids[GRID * GRIDS :], texts[GRID * GRIDS :]
            if ids:
                yield packed(block, ids, texts, avgdl)

        blocks = words.select("doc_id", "words").mapInArrow(run, PACKED).withColumn("bucket", cls.bucket())
        files = 1 + n // FILE_DOCUMENTS
        blocks.repartition(F.col("bucket"), F.pmod(F.xxhash64("block"), F.lit(files))).sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
        sizes = spark.read.parquet(f"{path}/blocks").where("term <> ''").groupBy("term").agg(F.sum(F.octet_length("at")).alias("df"))
        sizes.write.mode("overwrite").parquet(f"{path}/terms")
        return cls(spark, path)

    def candidates(self, tokens: DataFrame, ranker: str = "bm25", k: int = 10) -> DataFrame:
        """``qid, pos, term, doc_id, contribution``: the postings of the cells that may hold one of each query's first ``k``."""
        shares, out = 1 + tokens.count() // lexical.SENT_TOKENS, None
        for i in range(shares):  # each share of the queries can be sent to every task
            part = self._candidates(tokens if shares == 1 else tokens.where(F.pmod(F.xxhash64("qid"), F.lit(shares)) == i), ranker, k)
            out = part if out is None else out.unionByName(part)
        return out

    def _candidates(self, tokens: DataFrame, ranker: str, k: int) -> DataFrame:
        n, avgdl = self.spark.read.parquet(f"{self.path}/corpus").first()
        words = tokens.select("term").distinct()
        df = {r["term"]: r["df"] for r in self.spark.read.parquet(f"{self.path}/terms").join(bounded_broadcast(words), "term", "left_semi").collect()}  # no more rows than tokens
        idf = {w: float(np.log(1 + (n - x + 0.5) / (x + 0.5)) if ranker == "bm25" else np.log(n / x)) for w, x in df.items()}
        terms = sorted(w for w, x in idf.items() if x > 0)
        number, own, kind = {w: i for i, w in enumerate(terms)}, {}, dict(tokens.dtypes)["qid"]
        for r in sorted(tokens.select("qid", "pos", "term").collect(), key=lambda r: r["pos"]):
            if r["term"] in number:
                own.setdefault(r["qid"], []).append((r["pos"], number[r["term"]]))
        qids, places = list(own), [np.array(x) for x in own.values()]
        buckets = [r["b"] for r in words.unionByName(self.spark.sql("SELECT '' AS term")).select(self.bucket().alias("b")).distinct().collect()]  # at most BUCKETS rows
        wanted = bounded_broadcast(self.spark.createDataFrame([(w,) for w in ["", *terms]], "term string"))
        blocks = self.spark.read.parquet(f"{self.path}/blocks").where(F.col("bucket").isin(buckets)).join(wanted, "term", "left_semi")
        scale = np.array([idf[w] for w in terms])

        def sums(table):
            """Each cell's and query's sum of largest contributions."""
            asked, w = np.zeros((len(terms), len(places))), np.zeros((GRIDS, len(terms)))
            for q, x in enumerate(places):
                np.add.at(asked[:, q], x[:, 1], scale[x[:, 1]])
            for term, cells, most in zip(*(table.column(c).to_pylist() for c in ("term", "cells", ranker))):
                if term:
                    w[np.frombuffer(cells, "<u1"), number[term]] = np.frombuffer(most, "<f8")
            return w @ asked

        def best_cells(table):
            s, block = sums(table), table.column("block")[0].as_py()
            order = np.argsort(-s, axis=0, kind="stable")[: TRIALS * k]
            cell, q = order.reshape(-1), np.tile(np.arange(len(places)), len(order))
            keep = s[cell, q] > 0
            return pa.table({"q": pa.array(q[keep], pa.int32()), "block": pa.array(np.full(keep.sum(), block)), "cell": pa.array(cell[keep], pa.int32()), "most": pa.array(s[cell, q][keep])})

        def postings(table):
            """Ids of the block's documents, and each document's and term's contribution."""
            rows = {x["term"]: x for x in table.select(["term", "at", "tf", "ids"]).to_pylist()}
            dl, ids = np.frombuffer(rows[""]["tf"], "<i4").astype(float), np.frombuffer(rows[""]["ids"], "<i8")
            w = np.zeros((len(ids), len(terms)))
            for term, x in rows.items():
                if term:
                    at = np.frombuffer(x["at"], "<u1")
                    w[at, number[term]] = weights(ranker, np.frombuffer(x["tf"], "<i4").astype(float), dl[at], avgdl) * idf[term]
            return ids, w

        def trial_scores(table):
            (_, w), q, s = postings(table), [], []
            for i, cells in trials[table.column("block")[0].as_py()].items():
                d = np.flatnonzero(np.isin(np.arange(len(w)) // GRID, cells))
                score = np.sort(w[d][:, places[i][:, 1]].sum(1))[::-1][:k]
                s += (score := score[score > 0]).tolist()
                q += [i] * len(score)
            return pa.table({"q": pa.array(q, pa.int32()), "score": pa.array(s, pa.float64())})

        def kept(table):
            may, (ids, w), found = sums(table) >= bounds, postings(table), []
            cell = np.arange(len(ids)) // GRID
            for i in np.flatnonzero(may.any(0)):
                d = np.flatnonzero(may[cell, i])
                x = w[d][:, places[i][:, 1]]
                a, b = np.nonzero(x)
                found.append((np.full(len(a), i), places[i][b, 0], places[i][b, 1], ids[d[a]], x[a, b]))
            q, pos, term, doc, c = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 5
            return pa.Table.from_arrays([pa.array([qids[i] for i in q.tolist()], id_type), pa.array(pos.astype(np.int32)), pa.array([terms[i] for i in term.tolist()], pa.string()), pa.array(doc.astype(np.int64)), pa.array(c.astype(float))], names=["qid", "pos", "term", "doc_id", "contribution"])

        id_type = {"string": pa.string(), "int": pa.int32()}.get(kind, pa.int64())
        heads = blocks.select("term", "block", "cells", ranker)
        top = ranked(heads.groupBy("block").applyInArrow(best_cells, "q int, block long, cell int, most double"), ["q"], [F.col("most").desc(), F.col("block"), F.col("cell")], TRIALS * k)
        trials: dict[int, dict[int, list[int]]] = {}
        for r in top.select("q", "block", "cell").collect():  # TRIALS * k rows a query
            trials.setdefault(r["block"], {}).setdefault(r["q"], []).append(r["cell"])
        bounds = np.full(len(places), 1e-300)  # a cell without any of the terms holds no hit
        tried = blocks.join(F.broadcast(self.spark.createDataFrame([(b,) for b in trials], "block long")), "block", "left_semi")  # as few
        scored = tried.select("term", "block", "at", "tf", "ids").groupBy("block").applyInArrow(trial_scores, "q int, score double")
        for r in ranked(scored, ["q"], [F.col("score").desc()], 1, k - 1).collect():  # a row a query
            bounds[r["q"]] = max(r["score"] - SLACK, 1e-300)
        return blocks.select("term", "block", "cells", ranker, "at", "tf", "ids").groupBy("block").applyInArrow(kept, f"qid {kind}, pos int, term string, doc_id long, contribution double")

    def search(self, tokens: DataFrame, ranker: str = "bm25", k: int = 10, offset: int = 0) -> DataFrame:
        """As ``lexical.search``, the same rows; without ``total``, which would take all postings."""
        return lexical.top_hits(self.candidates(tokens, ranker, k + offset), k, offset, totals=False, tokens=tokens)
