"""SimHash near-duplicates by covering-code anchors.

Two 64-bit fingerprints that differ in at most three bits differ in at most one
bit of their upper or of their lower 32. For each half the anchors are a covering
code: the perfect Hamming code on 31 bits, covering radius 1, times the 32nd bit.
A half lies within 1 of its home anchor, and any half one bit away from it has
that anchor within 1 + 1, so each fingerprint is sent to every anchor within
covering radius plus threshold: 17 at most for a half, 33 in all on average.
Every pair to be found meets at the home anchor of either side. There are 2**27
anchors a half, so the fingerprints that share one stay few as the corpus grows;
a code on all 64 bits with threshold 3 would need hundreds of copies for that.

Equal fingerprints are one row before they are sent. An anchor whose home
fingerprints are many is split once more: the other half differs in three bits
at most, so one of its four bytes agrees. Within an anchor a breadth-first
search compares each reached fingerprint with those not reached yet and gives
the edges of a spanning forest, never all pairs.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import similarity
from .common import OWN, if_small, quoted, shielded, staged, text_of, texts, unshielded
from .components import components

WIDTH, BITS = 3, 3
#: Home fingerprints from which an anchor is split by the bytes of the other half.
HOT_HOMES = 4000
FP, LOC, BANDS = OWN + "fingerprint", OWN + "locator", OWN + "bands"


def fingerprint(text: str, width: int = WIDTH) -> int:
    """Bits set in over half of the shingles' XXH64 values, as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8").lower().split()  # on bytes: A to Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    set_ = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        set_ += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * set_ > n, bitorder="little").view(np.int64)[0])


def _syndromes(shift: int) -> np.ndarray:
    out = np.zeros(1 << 16, np.uint8)
    for i in range(16):
        if i + shift < 31:
            out[np.arange(1 << 16) >> i & 1 == 1] ^= i + shift + 1
    return out


_SYN_LOW, _SYN_HIGH = _syndromes(0), _syndromes(16)
#: For each syndrome, what to flip to reach the anchors within two bits: the home anchor first.
_FLIPS = np.zeros((32, 16), np.uint32)
for _s in range(1, 32):
    _FLIPS[_s, 0] = 1 << (_s - 1)
    _FLIPS[_s, 1:] = [1 << (i - 1) | 1 << ((i ^ _s) - 1) for i in range(1, 32) if i < i ^ _s]
_TOP = np.uint32(1 << 31)


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) for 32-bit values: every anchor within covering radius plus one bit."""
    s = _SYN_LOW[half & 0xFFFF] ^ _SYN_HIGH[half >> 16]
    home = half ^ _FLIPS[s, 0]
    far = np.flatnonzero(s)
    pairs = half[far, None] ^ _FLIPS[s[far], 1:]
    rows = np.arange(len(half))
    return (np.concatenate([rows, rows, np.repeat(far, 15)]), np.concatenate([home, home ^ _TOP, pairs.reshape(-1)]), np.concatenate([np.ones(len(half), bool), np.zeros(len(half) + pairs.size, bool)]))


def _close(x: np.uint64, many: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(many ^ x) <= bits


def forest(fps: np.ndarray, home: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Edges (indices) that connect what links of a home fingerprint with any fingerprint connect."""
    edges: list[tuple[int, int]] = []
    homes, others = np.flatnonzero(home), np.flatnonzero(~home)
    while len(homes):
        start, homes = homes[0], homes[1:]
        todo = [(start, True)]
        while todo:
            x, is_home = todo.pop()
            near = _close(fps[x], fps[homes], bits)
            if near.any():
                edges += zip(repeat(int(x)), homes[near].tolist())
                todo += zip(homes[near], repeat(True))
                homes = homes[~near]
            if is_home and len(others):
                near = _close(fps[x], fps[others], bits)
                if near.any():
                    edges += zip(repeat(int(x)), others[near].tolist())
                    todo += zip(others[near], repeat(False))
                    others = others[~near]
    return edges


def _group_edges(keys: np.ndarray, fps: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges within each run of equal keys."""
    cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1) if keys.ndim > 1 else keys[1:] != keys[:-1], True])
    starts, sizes = cuts[:-1], np.diff(cuts)
    two = starts[sizes == 2]
    ok = (home[two] | home[two + 1]) & (np.bitwise_count(fps[two] ^ fps[two + 1]) <= bits)
    a, b = [fps[two[ok]]], [fps[two[ok] + 1]]
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        own = fps[s : s + n]
        if found := forest(own, home[s : s + n], bits):
            at = np.array(found, np.int64)
            a.append(own[at[:, 0]])
            b.append(own[at[:, 1]])
    return np.concatenate(a), np.concatenate(b)


def links(distinct: DataFrame, bits: int = BITS, hot_homes: int = HOT_HOMES) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (column ``fp``) that span every component of links."""
    if bits > 3:
        raise ValueError("two halves with one bit each cover three bits at most")

    def send(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            u = fp.view(np.uint64)
            for half, own in enumerate(((u & np.uint64(0xFFFFFFFF)).astype(np.uint32), (u >> np.uint64(32)).astype(np.uint32))):
                row, anchor, home = anchors(own)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64) | half << 32), pa.array(fp[row]), pa.array(home)], names=["anchor", "fp", "home"])

    sent = distinct.select("fp").mapInArrow(send, "anchor long, fp long, home boolean")
    hot = staged(sent.where("home").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot_homes).select("anchor", F.lit(True).alias("hot")), "hot")
    if hot.isEmpty():
        split = sent.withColumn("part", F.lit(-1))
    else:
        other = F.when(F.shiftrightunsigned("anchor", 32) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
        bytes_ = F.array(*[(F.shiftrightunsigned(other, 8 * i).bitwiseAND(255) + 256 * i).cast("int") for i in range(4)])
        split = sent.join(hot, "anchor", "left").select("anchor", "fp", "home", F.explode(F.when(F.col("hot"), bytes_).otherwise(F.array(F.lit(-1)))).alias("part"))
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = split.repartition(n, "anchor", "part").sortWithinPartitions("anchor", "part")

    def compare(batches):
        keys, fps, home = np.empty((0, 2), np.int64), np.empty(0, np.uint64), np.empty(0, bool)

        def out(k, f, h):
            a, b = _group_edges(k, f, h, bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            k = np.stack([batch.column("anchor").to_numpy(), batch.column("part").to_numpy().astype(np.int64)], axis=1)
            if not len(k):
                continue
            held.append((k, batch.column("fp").to_numpy().view(np.uint64), batch.column("home").to_numpy(zero_copy_only=False)))
            if (held[0][0][0] == k[-1]).all():
                continue  # one anchor goes on through all that is held
            keys, fps, home = (np.concatenate(x) for x in zip(*held))
            last = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1
            yield out(keys[:last], fps[:last], home[:last])
            held = [(keys[last:], fps[last:], home[last:])]
        if held:
            yield out(*(np.concatenate(x) for x in zip(*held)))

    return sorted_.mapInArrow(compare, "a long, b long")


def fingerprinted(docs: DataFrame, text_col: str, width: int, with_bands: bool = False, keep_text: bool = True) -> DataFrame:
    """The rows, on demand without their text, with fingerprint and locator in own columns, and on demand MinHash bands, staged."""

    @F.pandas_udf("long")
    def of(text):
        import pandas as pd

        return pd.Series([fingerprint(x, width) for x in text], dtype="int64")

    @F.pandas_udf("array<long>")
    def bands_of(text):
        import pandas as pd

        return pd.Series([similarity.bands(x) for x in text], dtype="object")

    own = {FP: of(text_of(text_col)), LOC: F.monotonically_increasing_id()}
    rows = docs.withColumns(own | ({BANDS: bands_of(text_of(text_col))} if with_bands else {}))
    return staged(rows if keep_text else rows.drop(text_col), "fingerprints")


def classes(rows: DataFrame, id_col: str, bits: int = BITS, hot_homes: int = HOT_HOMES) -> DataFrame:
    """``fp, component_id, keep`` for each distinct fingerprint: the least id, and the id and locator of the row that stays."""
    row_id = F.col(quoted(id_col))
    first = F.min(F.struct(row_id.isNull().alias("none"), row_id.alias("id"), F.col(LOC).alias("locator")))
    nodes = staged(rows.groupBy(F.col(FP).alias("fp")).agg(F.min(row_id).alias("least"), first.alias("first")), "nodes")
    roots = components(links(nodes, bits, hot_homes)).withColumnRenamed("node", "fp")
    rooted = staged(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("keep"))
    return rooted.select("fp", "root").join(best, "root").select("fp", "component_id", "keep")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bits: int = BITS, hot_homes: int = HOT_HOMES) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row.

    Null and empty texts have fingerprint zero and link like any other. Null ids
    are no component's least id unless it has no other. Repeated rows repeat; an
    empty table gives an empty frame; further columns are not read.
    """
    rows = fingerprinted(docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text")), "text", width, keep_text=False)
    found = classes(rows, "doc_id", bits, hot_homes).withColumnRenamed("fp", FP)
    return rows.join(found, FP).select("doc_id", F.lpad(F.lower(F.hex(FP)), 16, "0").alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bits: int = BITS) -> DataFrame:
    """The row of least id of each component, with the columns it came with.

    Of these, rows whose five-word shingles have a Jaccard similarity of at least
    0.8 are then one row each too, again that of least id.
    """
    docs, now = shielded(docs)
    rows = fingerprinted(docs, now[text_col], width, with_bands=True)
    own = rows.select(LOC, F.col(FP).alias("fp")).join(classes(rows, now[id_col], bits), "fp")
    gone = staged(own.where(F.col(LOC) != F.col("keep")["locator"]).select(LOC), "copies")
    left = rows.join(if_small(gone), LOC, "left_anti")
    gone = staged(gone.unionByName(similarity.dropped(left, now[id_col], LOC, BANDS, now[text_col])), "gone")
    return rows.join(if_small(gone), LOC, "left_anti").select(*unshielded(now))
