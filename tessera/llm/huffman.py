"""Token ids on disk, in canonical length-limited Huffman code.

A stored corpus is a folder of two Parquet tables, so that Spark's own writers
commit it on any file system and lost or repeated tasks leave no half files:

``codebook``  one row: ``limit`` and ``lengths``, an unsigned byte for each id
              (0: the id doesn't occur). Codes are canonical: ascending by
              (length, id).
``blocks``    ``part, block, start, n_ids, body`` in ascending order of id. A
              body holds whole documents and is decoded on its own:

    magic ``THB2``, then little-endian u32: documents D, checkpoints C, ids per checkpoint
    D * (i64 document id, u8 is-null, u32 tokens)
    C * u64 bit offset of every ``CHECKPOINT``-th id
    the code bits, first bit highest, padded to 32-bit words

Decoding looks up ``limit`` bits in a table of 2**limit entries. All stretches
between checkpoints are decoded side by side, one id of each in every step.

Ids wait for their code in a staged table, as wide as the vocabulary needs
(16 bits here) and compressed once, by Parquet. They are counted while they are
encoded: each task adds one row with its counts to that table.

Null texts count as empty: the end id alone. Document ids must be integers; null
ids come first. Rows that repeat an id keep their own entries, next to each
other, by rising length and then by their ids. A text of any length is one
entry; a block ends only after a whole document. An empty table gives no blocks;
further columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from . import words as W
from .common import new_path, quoted, small_batches, staged, text_of, texts

MAGIC = b"THB2"
CHECKPOINT = 256
BLOCK_IDS = 1 << 18
END_ID = 1
#: What ``n_tokens`` is on a row of counts.
COUNTS = -1
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")])


def code_lengths(counts: np.ndarray, limit: int | None = None) -> tuple[np.ndarray, int]:
    """Optimal code lengths of at most ``limit`` bits (package-merge), and the limit."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    limit = limit or max(16, int(np.ceil(np.log2(max(2, len(used))))) + 1)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths, limit
    if len(used) > 1 << limit:
        raise ValueError("the limit is too low for so many ids")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64) if counts.max() > 2**52 else counts[order].astype(np.int64)
    # level by level, only how many of the items are leaves among the cheapest needs to be known
    packages = np.empty(0, weights.dtype)
    levels: list[np.ndarray] = []
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        leaf = np.concatenate([np.ones(len(weights), bool), np.zeros(len(packages), bool)])
        at = np.argsort(merged, kind="stable")
        merged, leaf = merged[at], leaf[at]
        levels.append(leaf)
        m = len(merged) // 2 * 2
        packages = merged[0:m:2] + merged[1:m:2]
    take = 2 * (len(order) - 1)
    bits = np.zeros(len(order), np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = bits
    return lengths, limit


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id, from the lengths alone."""
    codes = np.zeros(len(lengths), np.uint32)
    ids = np.flatnonzero(lengths)
    order = ids[np.lexsort((ids, lengths[ids]))]
    code, before = 0, 0
    for i in order.tolist():
        code <<= int(lengths[i]) - before
        before = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


class Codebook:
    def __init__(self, lengths: np.ndarray, limit: int):
        self.lengths, self.limit = lengths, limit
        self.codes = canonical_codes(lengths)
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window of ``limit`` bits, the id it starts with and that id's length."""
        if self._table is None:
            ids, sizes = np.zeros(1 << self.limit, np.uint32), np.ones(1 << self.limit, np.uint8)
            used = np.flatnonzero(self.lengths)
            order = used[np.lexsort((used, self.lengths[used]))]
            spans = np.left_shift(1, self.limit - self.lengths[order].astype(np.int64))
            n = int(spans.sum())
            ids[:n], sizes[:n] = np.repeat(order, spans), np.repeat(self.lengths[order], spans)
            self._table = ids, sizes
        return self._table

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The code bits, and the bit offset of every CHECKPOINT-th id."""
        if not len(ids):
            return b"", np.empty(0, np.uint64)
        n = self.lengths[ids].astype(np.int64)
        at = np.cumsum(n) - n
        total = int(at[-1] + n[-1])
        wide = self.codes[ids].astype(np.uint64) << (64 - (at & 31) - n).astype(np.uint64)
        word = at >> 5
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out = np.zeros((total + 31) // 32 + 1, np.uint64)
        out[word[first]] += np.add.reduceat(wide >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
        return out[: (total + 31) // 32].astype(">u4").tobytes(), at[::CHECKPOINT].astype(np.uint64)

    def unpack(self, bits: bytes, marks: np.ndarray, n: int, every: int) -> np.ndarray:
        """The inverse, all stretches between checkpoints in step."""
        ids_at, size_at = self.table()
        raw = np.frombuffer(bits, ">u4").astype(np.uint64)
        pairs = (raw << np.uint64(32)) | np.r_[raw[1:], np.zeros(1, np.uint64)] if len(raw) else raw
        lanes = len(marks)
        out = np.zeros((lanes, every), np.uint32)
        at = marks.astype(np.int64)
        mask = np.uint64((1 << self.limit) - 1)
        last = n - (lanes - 1) * every
        for k in range(min(every, n)):
            live = lanes if k < last else lanes - 1
            p = at[:live]
            window = ((pairs[p >> 5] >> (64 - self.limit - (p & 31)).astype(np.uint64)) & mask).astype(np.int64)
            out[:live, k] = ids_at[window]
            at[:live] += size_at[window]
        return out.reshape(-1)[:n]

    def write_block(self, docs: list[tuple[int | None, np.ndarray]]) -> bytes:
        head = np.array([(i or 0, i is None, len(x)) for i, x in docs], _DOC)
        bits, marks = self.pack(np.concatenate([x for _, x in docs]) if docs else np.empty(0, np.uint32))
        return MAGIC + struct.pack("<III", len(docs), len(marks), CHECKPOINT) + head.tobytes() + marks.astype("<u8").tobytes() + bits

    def read_block(self, body: bytes) -> list[tuple[int | None, np.ndarray]]:
        if body[:4] != MAGIC:
            raise ValueError("not a block of this format")
        d, c, every = struct.unpack_from("<III", body, 4)
        at = 16
        head = np.frombuffer(body, _DOC, d, at)
        at += d * _DOC.itemsize
        marks = np.frombuffer(body, "<u8", c, at)
        ids = self.unpack(body[at + 8 * c :], marks, int(head["n"].sum()), every)
        ends = np.cumsum(head["n"].astype(np.int64))
        return [(None if null else int(i), ids[e - n : e]) for i, null, n, e in zip(head["id"].tolist(), head["null"].tolist(), head["n"].tolist(), ends.tolist())]


def encode_ids(docs: DataFrame, path: str, id_col: str, text_col: str, end: int) -> DataFrame:
    """``doc_id, n_tokens, ids`` with ids as the encoder holds them, and one row a task of ``n_tokens`` -1 with its counts of ids."""
    if docs.schema[id_col].dataType not in (T.LongType(), T.IntegerType(), T.ShortType(), T.ByteType()):
        raise TypeError(f"{id_col} must be an integer column; it is {docs.schema[id_col].dataType.simpleString()}")
    base = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches):
        e = W.encoder(path)
        total, last, width = np.zeros(e.vocab_size, "<i8"), np.array([end], e.dtype).tobytes(), e.dtype.itemsize
        for b in batches:
            out = [ids + last for ids in e.encode_many(texts(b.column("text")))]
            total += np.bincount(e.ids(b"".join(out)), minlength=len(total))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // width for x in out], pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "n_tokens", "ids"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([COUNTS], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return base.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def id_counts(encoded: DataFrame, vocab: int) -> np.ndarray:
    """How often each id occurs: the sum of the tasks' counts, taken in parallel and then by id; a table of the vocabulary's size comes back."""

    def run(batches):
        total = np.zeros(vocab, np.int64)
        for b in batches:
            for x in b.column("ids").to_pylist():
                total += np.frombuffer(x, "<i8")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = encoded.where(F.col("n_tokens") == COUNTS).select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(vocab, np.int64)
    got = rows.toArrow()  # at most one row per id of the vocabulary
    out[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return out


def write_tokens(docs: DataFrame, out: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, block_ids: int = BLOCK_IDS) -> str:
    """Encode whole texts, append the end id, and write the folder described above in ascending id order."""
    spark = docs.sparkSession
    path = path or W.default_path()
    encoded = staged(encode_ids(docs, path, id_col, text_col, END_ID), "ids")
    vocab, dtype = W.encoder(path).vocab_size, W.encoder(path).dtype
    lengths, limit = code_lengths(id_counts(encoded, vocab))
    spark.createDataFrame([(limit, bytearray(lengths.tobytes()))], "limit int, lengths binary").coalesce(1).write.parquet(f"{out}/codebook")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").asc_nulls_first()
    ordered = encoded.where(F.col("n_tokens") >= 0).repartitionByRange(parts, order, "n_tokens").sortWithinPartitions(order, "n_tokens", "ids")

    def run(batches):
        from pyspark import TaskContext

        book = Codebook(lengths, limit)
        part, block, start, held, n = TaskContext.get().partitionId(), 0, 0, [], 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([start], pa.int64()), pa.array([n], pa.int64()), pa.array([book.write_block(held)], pa.binary())], names=["part", "block", "start", "n_ids", "body"])

        for b in batches:
            for i, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                ids = np.frombuffer(x, dtype)
                held.append((i, ids))
                n += len(ids)
                if n >= block_ids:
                    yield done()
                    block, start, held, n = block + 1, start + n, [], 0
        if held:
            yield done()

    with small_batches(spark):
        ordered.mapInArrow(run, "part int, block long, start long, n_ids long, body binary").write.option("compression", "none").parquet(f"{out}/blocks")
    return out


def read_codebook(spark: SparkSession, out: str) -> Codebook:
    limit, lengths = spark.read.parquet(f"{out}/codebook").first()
    return Codebook(np.frombuffer(bytes(lengths), np.uint8), limit)


def read_tokens(spark: SparkSession, out: str, ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each stored document, with its ``ids`` if wanted.

    ``start`` counts the ids of all documents before it. Only the totals of the
    parts, as many rows as the folder has parts, are summed in one place.
    """
    book = read_codebook(spark, out)
    blocks = spark.read.parquet(f"{out}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def run(batches):
        for b in batches:
            for start, body in zip(b.column("start").to_pylist(), b.column("body").to_pylist()):
                got = book.read_block(body)
                n = np.array([len(x) for _, x in got], np.int64)
                out = [pa.array([i for i, _ in got], pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(x.astype("<u4", copy=False).tobytes()) for _, x in got], pa.int64())]
                if ids:
                    out.append(pa.array([x.tolist() for _, x in got], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + ids])

    return blocks.join(F.broadcast(before), "part").select((F.col("start") + F.col("before")).alias("start"), "body").mapInArrow(run, schema)  # one row per part: bounded by the number of parts written


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' ids to a folder of their own and read them back."""
    out = write_tokens(docs, new_path(docs.sparkSession, "tokens"), path, id_col, text_col)
    return read_tokens(docs.sparkSession, out, ids=False)
