"""Shards of near-equal bytes from indivisible groups, by best-fit-decreasing bin packing.

Rows of equal text are one group and stay together. Groups are counted by size
class: sizes below 2**11 exactly, larger ones rounded up to eleven significant
bits, so there are at most some 60 thousand classes however many groups there
are. On that histogram best-fit decreasing is exact and runs many equal groups
at a time: each class goes to the bin whose remaining capacity is the tightest
that still takes it, found in a height-balanced tree. The smallest capacity for
which no more than the wanted number of bins open is then found by bisection;
groups of at least an even share have bins of their own before, and bins that a
few large groups leave uneven are packed anew without the fullest.
Groups find their bin by their rank within their class; ranks and slots come
from running totals per (key, partition), never from a sort of one key in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import numbered, quoted, staged, text_of, with_rank

EXACT_BITS = 11
#: Bins that differ by no more than this share of their mean are even.
EVEN = 0.01


class _Node:
    __slots__ = ("key", "bins", "left", "right", "height")

    def __init__(self, key: int, bin_: int):
        self.key, self.bins, self.left, self.right, self.height = key, [bin_], None, None, 1


class RoomTree:
    """An AVL tree of bins by remaining capacity."""

    def __init__(self):
        self.root: _Node | None = None

    @staticmethod
    def _h(n: _Node | None) -> int:
        return n.height if n else 0

    def _fixed(self, n: _Node) -> _Node:
        lean = self._h(n.left) - self._h(n.right)
        if lean > 1:
            if self._h(n.left.left) < self._h(n.left.right):
                n.left = self._turn(n.left, "right", "left")
            return self._turn(n, "left", "right")
        if lean < -1:
            if self._h(n.right.right) < self._h(n.right.left):
                n.right = self._turn(n.right, "left", "right")
            return self._turn(n, "right", "left")
        n.height = 1 + max(self._h(n.left), self._h(n.right))
        return n

    def _turn(self, n: _Node, up: str, other: str) -> _Node:
        top = getattr(n, up)
        setattr(n, up, getattr(top, other))
        setattr(top, other, n)
        for x in (n, top):
            x.height = 1 + max(self._h(x.left), self._h(x.right))
        return top

    def add(self, key: int, bin_: int) -> None:
        def put(n):
            if n is None:
                return _Node(key, bin_)
            if key == n.key:
                n.bins.append(bin_)
                return n
            if key < n.key:
                n.left = put(n.left)
            else:
                n.right = put(n.right)
            return self._fixed(n)

        self.root = put(self.root)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) of least room of at least ``size``; of equals the lowest bin."""
        best, n = None, self.root
        while n:
            if n.key >= size:
                best, n = n, n.left
            else:
                n = n.right
        if best is None:
            return None
        key = best.key
        bin_ = min(best.bins)
        best.bins.remove(bin_)
        if not best.bins:
            self.root = self._without(self.root, key)
        return key, bin_

    def _without(self, n: _Node, key: int) -> _Node | None:
        if key < n.key:
            n.left = self._without(n.left, key)
        elif key > n.key:
            n.right = self._without(n.right, key)
        elif not n.left or not n.right:
            return n.left or n.right
        else:
            least = n.right
            while least.left:
                least = least.left
            n.key, n.bins = least.key, least.bins
            n.right = self._without(n.right, least.key)
        return self._fixed(n)


def best_fit_decreasing(classes: dict[int, int], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """(class size, how many, bin) in order; None if more than ``most`` bins would open."""
    tree, out, opened = RoomTree(), [], 0
    for size in sorted(classes, reverse=True):
        left = classes[size]
        while left:
            found = tree.take_tightest(size)
            if found is None:
                if opened == most or size > capacity:
                    return None
                found = capacity, opened
                opened += 1
            room, bin_ = found
            k = min(left, room // size)
            out.append((size, k, bin_))
            left -= k
            tree.add(room - k * size, bin_)
    return out


def smallest_capacity(classes: dict[int, int], bins: int) -> tuple[int, list[tuple[int, int, int]]]:
    """The least capacity for which best-fit decreasing opens no more than ``bins`` bins, within one in 2**16."""
    total = sum(k * v for k, v in classes.items())
    low = max(-(-total // bins), max(classes, default=0), 1)
    if (done := best_fit_decreasing(classes, low, bins)) is not None:
        return low, done
    step, high = max(1, low >> 16), low
    while (done := best_fit_decreasing(classes, high := high + step, bins)) is None:
        low, step = high, step * 2
    while high - low > max(1, high >> 16):
        mid = (low + high) // 2
        if (got := best_fit_decreasing(classes, mid, bins)) is None:
            low = mid
        else:
            high, done = mid, got
    return high, done


def near_equal(classes: dict[int, int], bins: int) -> list[tuple[int, int, int]]:
    """(class size, how many, bin), with all ``bins`` bins as near-equal as whole groups allow.

    A group of at least the even share of what remains gets a bin of its own.
    The rest is packed by the smallest capacity; where that leaves bins uneven,
    as few large groups do, the fullest bin stays and the others are packed anew.
    """
    rest, out, at = dict(classes), [], 0
    while rest and at < bins:
        total, largest = sum(k * v for k, v in rest.items()), max(rest)
        if largest * (bins - at) >= total:
            fixed = {largest: 1}
        else:
            _, placed = smallest_capacity(rest, bins - at)
            loads = [0] * (bins - at)
            for size, k, bin_ in placed:
                loads[bin_] += size * k
            if max(loads) - min(loads) <= EVEN * total / (bins - at):
                return out + [(size, k, at + bin_) for size, k, bin_ in placed]
            fullest, fixed = loads.index(max(loads)), {}
            for size, k, bin_ in placed:
                if bin_ == fullest:
                    fixed[size] = fixed.get(size, 0) + k
        for size, k in fixed.items():
            out.append((size, k, at))
            rest[size] -= k
            if not rest[size]:
                del rest[size]
        at += 1
    return out


def size_class(size):
    """The column's class: itself below 2**11, else rounded up to eleven significant bits."""
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(size)) - EXACT_BITS, F.lit(0))).cast("long")
    return ((size + step - 1) / step).cast("long") * step


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row, under the law ``bytes``.

    Null and empty texts are one group of size 1 a row. A group of at least an
    even share has a shard of its own; the others share the rest evenly. Repeated rows count each; an empty table gives an empty frame;
    further columns are not read.
    """
    text = text_of(text_col)
    base = docs.select(F.col(quoted(id_col)).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("group"))
    rows = staged(base, "sized")
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes")).withColumn("class", size_class(F.col("bytes")))
    groups = numbered(groups.select("group", "class"), "class", "groups")
    classes = {r["class"]: r["n"] for r in groups.groupBy("class").agg(F.count("*").alias("n")).collect()}  # bounded: see above
    placed = near_equal(classes, shards)
    runs: dict[int, tuple[list[int], list[int]]] = {}
    used: dict[int, int] = {}
    for size, k, bin_ in placed:
        starts, bins = runs.setdefault(size, ([], []))
        starts.append(used.get(size, 0))
        bins.append(bin_)
        used[size] = starts[-1] + k
    where = {k: (np.array(s, np.int64), np.array(b, np.int32)) for k, (s, b) in runs.items()}

    @F.pandas_udf("int")
    def bin_of(cls, rank):
        import pandas as pd

        out = np.empty(len(cls), np.int32)
        c, r = cls.to_numpy(), rank.to_numpy()
        order = np.argsort(c, kind="stable")
        cuts = np.flatnonzero(np.r_[True, c[order][1:] != c[order][:-1]]) if len(c) else []
        for at in np.split(order, cuts[1:]) if len(c) else []:
            starts, bins = where[int(c[at[0]])]
            out[at] = bins[np.searchsorted(starts, r[at], "right") - 1]
        return pd.Series(out)

    homes = with_rank(groups, "class", "rank").select("group", bin_of("class", "rank").alias("shard"))
    homed = numbered(rows.join(homes, "group").drop("group"), "shard", "sharded")
    slots = with_rank(homed, "shard", "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
