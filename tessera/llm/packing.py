"""Packing pieces into sequences of fixed length by exact complements, then best fit.

The plan is made from the histogram of piece lengths alone, which has at most as
many entries as a sequence has tokens, however large the corpus. A sequence is
opened with the longest length left. If its gap equals an available length, or a
sum of two or three of them, those are consumed, and as many further sequences
are filled in the same way as counts allow, in one step; of several fillings the
one with the largest small member is taken, so that short pieces, which fit
anywhere, last longest. If no combination fills the gap exactly, the longest
piece that fits goes in and the smaller gap is tried. What then remains is placed
by best fit, the longest first. The exact phase may end before its last filling,
where best fit does better with what is left; its first sixteenth always holds.

Pieces get their sequence by their rank within their length. The rank comes from
running totals per (length, partition), so a length that half the corpus shares
needs no task of its own.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .common import INDEX, PART, group_index, quoted, staged, text_of, texts, with_rank

CAPACITY = 2048
#: Ends of the exact phase that are tried.
PHASES = 16
END_ID = 0


class SumIndex:
    """Which gaps one, two or three available lengths fill exactly.

    ``pairs`` and ``triples`` count the ordered pairs and triples of available
    lengths for each sum. When a length runs out they follow from the old ones:
    with H for the lengths and x**a for the one that goes, H**2 and H**3 lose the
    terms of the binomial that have x**a in them.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for k, v in counts.items():
            self.n[k] = v
        self.capacity = capacity
        have = (self.n > 0).astype(np.int64)
        self.pairs = np.convolve(have, have)[: capacity + 1]
        self.triples = np.convolve(self.pairs, have)[: capacity + 1]

    def _shifted(self, a: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(self.capacity + 1, np.int64)
        if by <= self.capacity:
            out[by:] = a[: self.capacity + 1 - by]
        return out

    def take(self, length: int, k: int) -> None:
        self.n[length] -= k
        if k and self.n[length] == 0:
            have, one = (self.n > 0).astype(np.int64), np.zeros(self.capacity + 1, np.int64)
            one[0] = 1
            self.pairs -= 2 * self._shifted(have, length) + self._shifted(one, 2 * length)
            self.triples -= 3 * self._shifted(self.pairs, length) + 3 * self._shifted(have, 2 * length) + self._shifted(one, 3 * length)

    def longest(self, at_most: int) -> int:
        found = np.flatnonzero(self.n[: at_most + 1] > 0)
        return int(found[-1]) if len(found) else 0

    def pair(self, gap: int) -> tuple[int, ...] | None:
        low = np.arange(1, gap // 2 + 1)
        ok = (self.n[low] > 0) & (self.n[gap - low] > np.where(2 * low == gap, 1, 0))
        found = np.flatnonzero(ok)
        return (int(low[found[-1]]), gap - int(low[found[-1]])) if len(found) else None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        if self.n[gap] > 0:
            return (gap,)
        if self.pairs[gap] > 0 and (two := self.pair(gap)):
            return two
        if self.triples[gap] > 0:
            low = np.arange(1, gap // 3 + 1)
            for a in low[(self.n[low] > 0) & (self.pairs[gap - low] > 0)][::-1].tolist():
                self.n[a] -= 1
                two = self.pair(gap - a)
                self.n[a] += 1
                if two:
                    return (a, *two)
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of the pieces in a sequence, how many such sequences), covering all counts."""
    index, out = SumIndex(counts, capacity), []
    while top := index.longest(capacity):
        took, gap, full = [top], capacity - top, capacity == top
        index.n[top] -= 1  # held back while the rest is sought
        while gap and not full:
            if filling := index.fill(gap):
                took += filling
                full = True
            elif more := index.longest(gap):
                took.append(more)
                index.n[more] -= 1
                gap -= more
            else:
                break
        for x in set(took):  # give back what was held
            held = took.count(x) - (filling.count(x) if full and top != capacity else 0)
            index.n[x] += held
        need = Counter(took)
        times = min(int(index.n[x]) // k for x, k in need.items()) if full else 1
        if not full and times:
            # no exact filling from here on for this opening: leave all of it to best fit
            index.take(top, int(index.n[top]))
            continue
        for x, k in need.items():
            index.take(x, k * times)
        out.append((tuple(sorted(took, reverse=True)), times))
    # Consumed exact fillings can leave worse residuals than they save: the exact phase ends where the whole takes fewest sequences.
    best = None
    for end in sorted({-(-len(out) * i // PHASES) for i in range(1, PHASES + 1)}, reverse=True):
        left = Counter({n: k for n, k in counts.items() if k})
        for content, k in out[:end]:
            for x in content:
                left[x] -= k
        whole = out[:end] + best_fit(+left, capacity)
        if best is None or sum(k for _, k in whole) < sum(k for _, k in best):
            best = whole
    return best or best_fit(Counter(counts), capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing, many equal pieces at a time; equal to placing them one by one."""
    room: list[int] = []  # sorted rooms
    bins: dict[int, Counter] = {}  # room -> sequences with that room
    def add(r: int, content: tuple[int, ...], k: int) -> None:
        if r not in bins:
            bisect.insort(room, r)
            bins[r] = Counter()
        bins[r][content] += k

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(room, length)
            if i < len(room):
                r = room[i]
                content, k = next(iter(bins[r].items()))
            else:
                r, content, k = capacity, (), -(-left // (capacity // length))
            q = r // length
            whole, odd = min(k, left // q), 0
            if whole < k and left - whole * q:
                odd = left - whole * q
            if content or r != capacity:
                bins[r][content] -= whole + bool(odd)
                if not bins[r][content]:
                    del bins[r][content]
                if not bins[r]:
                    del bins[r]
                    room.pop(i)
            if whole:
                add(r - q * length, content + (length,) * q, whole)
            if odd:
                add(r - odd * length, content + (length,) * odd, 1)
            left -= whole * q + odd
    return [(content, k) for r in sorted(bins) for content, k in bins[r].items()]


class Placement:
    """For each length, which ranks go to which sequence and offset."""

    def __init__(self, plan_: list[tuple[tuple[int, ...], int]]):
        runs: dict[int, list[tuple[int, int, int]]] = {}
        used: Counter = Counter()
        sequence = 0
        for content, k in plan_:
            offset = 0
            for length in content:
                runs.setdefault(length, []).append((used[length], sequence, offset))
                used[length] += k
                offset += length
            sequence += k
        self.runs = {n: np.array(v, np.int64) for n, v in runs.items()}
        self.sequences = sequence

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            run = self.runs[n]
            i = np.searchsorted(run[:, 0], rank[at], "right") - 1
            sequence[at], offset[at] = run[i, 1] + rank[at] - run[i, 0], run[i, 2]
        return sequence, offset


def pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, digests: bool = False) -> DataFrame:
    """Encode, append the end id, cut what is longer than a sequence; staged, numbered by length.

    With ``digests``, ``ids_crc32`` in place of ``ids``, so that ids are neither written nor moved.
    """
    base = docs.select(F.col(quoted(id_col)).alias("doc_id"), text_of(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    name, held = ("ids_crc32", "long") if digests else ("ids", "binary")

    def run(batches):
        from pyspark import TaskContext

        e, part, seen = W.encoder(path), TaskContext.get().partitionId(), {}
        end = np.array([END_ID], e.dtype).tobytes()
        for b in batches:
            row, number, length, ids = [], [], [], []
            for i, x in enumerate(e.encode_many(texts(b.column("text")))):
                wide = e.ids(x + end).astype("<u4").tobytes()
                for at in range(0, len(wide), 4 * capacity):
                    cut = wide[at : at + 4 * capacity]
                    row.append(i)
                    number.append(at // (4 * capacity))
                    length.append(len(cut) // 4)
                    ids.append(zlib.crc32(cut) if digests else cut)
            number, length = np.array(number, np.int32), np.array(length, np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(number), pa.array(number.astype(np.int64) * capacity), pa.array(length), pa.array(ids, pa.int64() if digests else pa.binary()), pa.array(np.full(len(row), part, np.int32)), pa.array(group_index(length, seen))], names=["doc_id", "piece", "start", "length", name, PART, INDEX])

    return staged(base.mapInArrow(run, f"doc_id {kind}, piece int, start long, length int, {name} {held}, {PART} int, {INDEX} long"), "pieces")


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, digests: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset``, one row for each piece.

    ``ids`` are little-endian unsigned 32-bit; with ``digests`` their ``ids_crc32`` comes instead. A null or empty
    text is one piece of the end id; a text of any length is cut into pieces of ``capacity`` and a shorter last one.
    Repeated rows are packed each; an empty table packs nothing; further columns are not read.
    """
    rows = pieces(docs, path or W.default_path(), id_col, text_col, capacity, digests)
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    where = Placement(plan(counts, capacity))
    ranked = with_rank(rows, "length", "rank")

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        s, o = where.of(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": s, "offset": o})

    placed = ranked.withColumn("at", place("length", "rank"))
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32" if digests else "ids", "at.sequence_id", "at.offset")
