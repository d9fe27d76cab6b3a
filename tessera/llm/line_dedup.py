"""Line dedup: lines that many documents share are dropped from all of them.

A line's key is the line without white space at its ends, A to Z lower-cased; keys
without characters are never dropped. Each task counts the documents of its lines by
a 128-bit hash of the key, a document once, and sends one row for each hash it met,
so a line of a third of all documents is one row a task. The hashes of as many
documents as make a line common go into a sharded minimal perfect hash with a compact
fingerprint and the count for each (``perfect_hash``). Documents are then read
again and probe the arrays where they are: no line is joined or shuffled. Lines
that aren't in the index, the most by far, are told by the fingerprint.

With ``indexed_from`` below ``least`` the index also has rarer lines; the count
array then decides which of them go, with the same result.

Two keys count as one if 128 bits of hash agree; a rare line is taken for a common
one if its slot and a 64-bit fingerprint agree.

Defined results: a null or empty text is one empty line, which stays; each row counts
as a document of its own, repeated rows and null ids too; a text of any length is
handled whole, in its Arrow batch; an empty table gives an empty frame; further
columns pass through ``without_common_lines`` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import perfect_hash
from .common import quoted, shielded, small_batches, text_of, unshielded

LEAST = 10
#: White space that is taken off a line's ends.
SPACE = " \t\n\x0b\x0c\r"
#: Bytes of texts whose lines are held at once; a longer text is held alone.
HELD_BYTES = 2 << 20


def in_pieces(batch: pa.RecordBatch, name: str):
    """A batch in pieces of about HELD_BYTES of text each."""
    ends = np.cumsum(pc.binary_length(batch.column(name)).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def cut(column: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """All lines of the texts, the places where each text's lines begin and the last ends, and the lines' keys."""
    lists = pc.split_pattern(column, "\n")
    starts = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)]
    lines = lists.flatten()
    return lines, starts, pc.ascii_lower(pc.ascii_trim(lines, characters=SPACE))


def hashed(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which lines have a key with characters, and the hashes of those."""
    some = pc.greater(pc.binary_length(keys), 0)
    return np.flatnonzero(some.to_numpy(zero_copy_only=False)), perfect_hash.digests(keys.filter(some).to_pylist())


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows together, and the places in it where another row begins."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for x in columns:
        s = x[order]
        new[1:] |= s[1:] != s[:-1]
    new[:1] = True
    return order, np.flatnonzero(new)


def document_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``first, second, number``: each key's hash and the documents that have it."""

    def run(batches):
        for b in (x for b in batches for x in in_pieces(b, "text")):
            _, starts, keys = cut(b.column("text"))
            at, h = hashed(keys)
            doc = np.searchsorted(starts, at, side="right")
            order, first = _runs(doc, h[:, 1], h[:, 0])
            once = h[order[first]]  # a document's repeats of a line count once
            order, first = _runs(once[:, 1], once[:, 0])
            kept = once[order[first]]
            yield pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1]), pa.array(np.diff(np.r_[first, len(order)]))], names=["first", "second", "number"])

    counted = docs.select(text_of(text_col).alias("text")).mapInArrow(run, "first long, second long, number long")
    return counted.groupBy("first", "second").agg(F.sum("number").alias("number"))


def common_lines(docs: DataFrame, text_col: str = "text", least: int = LEAST, indexed_from: int | None = None) -> perfect_hash.Index:
    """The index of the lines of at least ``indexed_from`` documents (default: ``least``), with their counts."""
    with small_batches(docs.sparkSession):
        return perfect_hash.build(document_counts(docs, text_col).where(F.col("number") >= (indexed_from or least)), "lines")


def probed(index: perfect_hash.Index, least: int, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of each text: its lines, how many of them go, the documents of the commonest indexed one, and what stays."""
    lines, starts, keys = cut(column)
    at, h = hashed(keys)
    n_docs = np.zeros(len(lines), np.int64)
    n_docs[at] = index.look_up(h)[1]
    drop = n_docs >= least
    dropped = np.add.reduceat(drop.astype(np.int64), starts[:-1])  # every text has a line
    out = column.to_pylist()
    for i in np.flatnonzero(dropped).tolist():
        a, b = int(starts[i]), int(starts[i + 1])
        out[i] = "\n".join(lines.slice(a, b - a).filter(pa.array(~drop[a:b])).to_pylist())
    return np.diff(starts), dropped, np.maximum.reduceat(n_docs, starts[:-1]), out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, indexed_from: int | None = None) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256, max_docs`` for each row; ``max_docs``: of the document's indexed lines, the documents of the commonest."""
    index = common_lines(docs, text_col, least, indexed_from)
    base = docs.select(F.col(quoted(id_col)).alias("doc_id"), text_of(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in (x for b in batches for x in in_pieces(b, "text")):
            n, dropped, most, kept = probed(index, least, b.column("text"))
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(dropped), pa.array(sha, pa.string()), pa.array(most)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "max_docs"])

    return base.mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string, max_docs long")


def without_common_lines(docs: DataFrame, text_col: str = "text", least: int = LEAST, index: perfect_hash.Index | None = None) -> DataFrame:
    """The rows as they came, each text without its common lines; ``index``: one made before, perhaps of more documents than these."""
    docs, now = shielded(docs)
    own = now[text_col]
    index = index or common_lines(docs, own, least)
    rows = docs.withColumn(own, text_of(own))

    def run(batches):
        for b in (x for b in batches for x in in_pieces(b, own)):
            yield b.set_column(b.schema.get_field_index(own), own, pa.array(probed(index, least, b.column(own))[3], pa.string()))

    return rows.mapInArrow(run, rows.schema).select(*unshielded(now))
