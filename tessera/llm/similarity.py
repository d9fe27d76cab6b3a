"""Near copies by word overlap: MinHash bands for candidates, exact Jaccard for the verdict.

A text is the set of its five-word shingles, lower-cased and with white space
evened. Each of ``BANDS`` bands joins ``ROWS`` least hash values; texts that agree
in a band are candidates, so of pairs of similarity 0.8 one in some 4500 is
missed, and fewer above. Only candidates' shingles are shuffled. Within a band a
breadth-first search compares each reached text with those not reached yet, on
the sets themselves, and gives the edges of a spanning forest, never all pairs.

A band whose sets would not fit a task (over HOT_ROWS texts or HOT_BYTES) is taken
apart first. All its texts are compared with one of them, the pivot, wherever they
lie; those alike are linked to it. Jaccard distance is a metric, so a text alike to
one of these has at most twice the distance from the pivot, and pairs are left only
between the alike and such texts, and among all texts that aren't alike to the
pivot. Both are compared in blocks that fit a task, every pair of blocks once: for
one large group of near copies next to nothing is left, and no pair is lost for any.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import if_small, quoted, staged, text_of, texts
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
#: What a task compares at once, at most.
HOT_ROWS, HOT_BYTES = 4000, 32 << 20
_CHUNK = 1 << 13
_MIX = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of a shorter text the one of all its words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    found = set(map(b" ".join, zip(*(words[i:] for i in range(width))))) if len(words) >= width else {b" ".join(words)}
    return np.sort(np.fromiter(map(xxh64_intdigest, found, repeat(0)), np.uint64, len(found)))


def bands(text: str) -> np.ndarray:
    """A key for each band, none for a text without words."""
    h = shingles(text)
    if not len(h):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(h), _CHUNK):
        x = (h[i : i + _CHUNK] ^ _MIX[0]) * _MIX[1]
        least = np.minimum(least, (x ^ x >> np.uint64(29)).min(1))
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets, neither empty."""
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def alike(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``least`` or more."""
    return min(len(a), len(b)) >= least * max(len(a), len(b)) and jaccard(a, b) >= least - 1e-9


def forest(sets: list[np.ndarray], least: float = SIMILARITY) -> list[tuple[int, int]]:
    edges, left = [], list(range(len(sets)))
    while left:
        todo = [left.pop()]
        while todo:
            x, rest = todo.pop(), []
            for y in left:
                if alike(sets[x], sets[y], least):
                    edges.append((x, y))
                    todo.append(y)
                else:
                    rest.append(y)
            left = rest
    return edges


def between(left: list[np.ndarray], right: list[np.ndarray], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """One alike member of ``left`` for each member of ``right`` that has any."""
    return [(i, j) for j, y in enumerate(right) if (i := next((i for i, x in enumerate(left) if alike(x, y, least)), None)) is not None]


def compared(rows: DataFrame, keys: list[str], at_once: int) -> DataFrame:
    """Edges ``a, b`` of ``loc, set`` rows within each group of ``keys``; rows of one ``side`` only with the other's, if it isn't 0."""

    def compare(batches):
        group, locs, held, sides = None, [], [], []

        def out():
            if any(sides):
                left, right = ([i for i, s in enumerate(sides) if s == k] for k in (1, 2))
                found = [(left[i], right[j]) for i, j in between([held[i] for i in left], [held[j] for j in right])]
            else:
                found = forest(held)
            at, own = np.array(found, np.int64).reshape(-1, 2), np.array(locs, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(own[at[:, 0]]), pa.array(own[at[:, 1]])], names=["a", "b"])

        for b in batches:
            for *key, at, x, side in zip(*(b.column(k).to_pylist() for k in (*keys, "loc", "set", "side"))):
                if key != group:
                    if len(held) > 1:
                        yield out()
                    group, locs, held, sides = key, [], [], []
                locs.append(at)
                held.append(np.frombuffer(x, np.uint64))
                sides.append(side)
        if len(held) > 1:
            yield out()

    return rows.select(*keys, "loc", "set", "side").repartition(at_once, *keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")


def taken_apart(members: DataFrame, at_once: int, hot_rows: int, hot_bytes: int) -> DataFrame:
    """Edges ``a, b`` of ``band, loc, set`` rows whose bands are too large for one task."""
    pivots = members.groupBy("band").agg(F.min_by(F.struct("loc", "set"), "loc").alias("pivot")).select("band", F.col("pivot")["loc"].alias("p_loc"), F.col("pivot")["set"].alias("p_set"))

    def measure(batches):
        for b in batches:
            s = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column("set").to_pylist(), b.column("p_set").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("band"), b.column("loc"), b.column("set"), b.column("p_loc"), pa.array(s, pa.float64())], names=["band", "loc", "set", "p_loc", "s"])

    measured = staged(members.join(pivots, "band").mapInArrow(measure, "band long, loc long, set binary, p_loc long, s double"), "measured")
    measured = measured.withColumn("kind", F.when(F.col("s") >= SIMILARITY - 1e-9, "alike").when(F.col("s") >= 2 * SIMILARITY - 1 - 1e-6, "ring").otherwise("far"))
    blocks = lambda which: F.greatest(F.lit(1), F.ceil(F.count_if(which) * 2 / hot_rows), F.ceil(F.sum(F.when(which, F.octet_length("set"))) * 2 / hot_bytes)).cast("int")
    near, ring = F.col("kind") == "alike", F.col("kind") == "ring"
    sizes = measured.groupBy("band").agg(blocks(near).alias("n_alike"), blocks(ring).alias("n_ring"), blocks(~near).alias("n_other"))
    rows = measured.join(sizes, "band")
    own = lambda n: F.pmod(F.xxhash64("loc"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # alike texts against the ring: block i of the one with block j of the other
    first = rows.where(near).withColumn("i", own("n_alike")).withColumn("j", F.explode(every("n_ring"))).withColumn("side", F.lit(1))
    second = rows.where(ring).withColumn("j", own("n_ring")).withColumn("i", F.explode(every("n_alike"))).withColumn("side", F.lit(2))
    # all that aren't alike to the pivot: each pair of blocks once
    pair = F.array_sort(F.array(F.col("x"), F.col("y")))
    third = rows.where(~near).withColumn("x", own("n_other")).withColumn("y", F.explode(every("n_other"))).withColumn("i", pair[0]).withColumn("j", pair[1] - F.col("n_other")).withColumn("side", F.lit(0))
    both = first.unionByName(second).select("band", "i", "j", "loc", "set", "side").unionByName(third.select("band", "i", "j", "loc", "set", "side"))
    return measured.where(near & (F.col("loc") != F.col("p_loc"))).select(F.col("p_loc").alias("a"), F.col("loc").alias("b")).unionByName(compared(both, ["band", "i", "j"], at_once))


def links(rows: DataFrame, loc: str, bands_col: str, text_col: str, hot_rows: int = HOT_ROWS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Edges ``a, b`` between values of ``loc`` that span every component of alike texts."""
    spark = rows.sparkSession
    sent = rows.select(F.col(loc).alias("loc"), F.explode(bands_col).alias("band"))
    shared = sent.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    met = staged(sent.join(shared, "band"), "bands")

    def sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x).tobytes() for x in texts(b.column(1))], pa.binary())], names=["loc", "set"])

    of = rows.join(if_small(met.select(F.col("loc").alias(loc)).distinct()), loc, "left_semi").select(F.col(loc).alias("loc"), text_of(text_col).alias("text"))
    of = staged(of.mapInArrow(sets, "loc long, set binary"), "sets")
    sizes = met.join(of.select("loc", F.octet_length("set").alias("size")), "loc").groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    hot = staged(sizes.where((F.col("n") > hot_rows) | (F.col("bytes") > hot_bytes)).select("band"), "hot-bands")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if hot.isEmpty():
        return compared(met.join(of, "loc").withColumn("side", F.lit(0)), ["band"], n)
    cold = met.join(hot, "band", "left_anti").join(of, "loc").withColumn("side", F.lit(0))
    return compared(cold, ["band"], n).unionByName(taken_apart(met.join(hot, "band", "left_semi").join(of, "loc"), n, hot_rows, hot_bytes))


def dropped(rows: DataFrame, id_col: str, loc: str, bands_col: str, text_col: str) -> DataFrame:
    """``loc`` of the rows that are not the one of least id of their component."""
    roots = components(links(rows, loc, bands_col, text_col))
    rooted = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct().withColumnRenamed("node", loc)
    row_id = F.col(quoted(id_col))
    nodes = staged(rows.select(loc, row_id.isNull().alias("none"), row_id.alias("id")).join(rooted, loc), "alike")
    first = nodes.groupBy("root").agg(F.min(F.struct("none", "id", loc)).alias("first")).select("root", F.col("first")[loc].alias("kept"))
    return nodes.join(first, "root").where(F.col(loc) != F.col("kept")).select(loc)
