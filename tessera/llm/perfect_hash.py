"""Sharded minimal perfect hashes over keys of 128 bits, with a fingerprint and a number for each key.

Keys are dealt to shards by their first half, so shards are even. A shard's hash is
a cascade of bit arrays: on each level the keys still without a place are hashed to
bits; a key alone on its bit has its place there, the others go on. The rank of a
key's bit among all set bits is its slot, from 0 without gaps. A slot has the key's
fingerprint, by which keys that were never put in are told apart, and its number.

A shard is built by one task, from some SHARD_KEYS keys, and written by Spark as
one row of a Parquet table in the shared folder. Tasks that look keys up open the
shards they need themselves, by ``pyarrow.fs``, and keep CACHE_BYTES of them at
most; neither keys nor arrays pass the driver. So the shared folder has to be one
that pyarrow opens: a mounted one, HDFS or an object store.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import new_path, staged

#: Keys of a shard, on average; the least number of shards, so that few keys are dealt out too.
SHARD_KEYS, LEAST_SHARDS = 500_000, 32
#: Bytes of shards that a worker process holds.
CACHE_BYTES = 256 << 20
#: Bits of a level for each key that comes to it.
ROOM = 2
MAX_LEVELS = 200
SCHEMA = "shard int, n long, words array<int>, bits binary, fingerprints binary, numbers binary"
_U = np.uint64


def digests(keys) -> np.ndarray:
    """The 128-bit hashes of strings, as rows of two signed 64-bit integers."""
    from xxhash import xxh3_128_digest

    return np.frombuffer(b"".join(map(xxh3_128_digest, keys)), "<i8").reshape(-1, 2)


def number_digests(x: np.ndarray) -> np.ndarray:
    """Two well-mixed 64-bit integers for each 64-bit number, as ``digests`` gives them for strings."""
    out = np.empty((len(x), 2), np.int64)
    for i, seed in enumerate((0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)):
        h = x.astype(np.int64).view(_U) + _U(seed)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> _U(shift))) * _U(factor)
        out[:, i] = (h ^ (h >> _U(31))).view(np.int64)
    return out


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of both halves, another value for each seed."""
    u = keys.view(_U)
    x = u[:, 0] + u[:, 1] * _U((2 * seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> _U(shift))) * _U(factor)
    return x ^ (x >> _U(32))


def _places(keys: np.ndarray, level: int, words: int) -> np.ndarray:
    return ((_mixed(keys, level) >> _U(32)) * _U(words * 64) >> _U(32)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return _mixed(keys, MAX_LEVELS)


@dataclass
class PerfectHash:
    """``slots(keys)``: for each key that it was built of another number below their count; -1 or any such number for others."""

    words: list[int]  # words of each level
    bits: np.ndarray
    ranks: np.ndarray = field(init=False)

    def __post_init__(self):
        self.ranks = np.r_[0, np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)]

    @classmethod
    def of(cls, keys: np.ndarray) -> "PerfectHash":
        left, words, bits = keys, [], []
        while len(left):
            if len(words) == MAX_LEVELS:
                raise ValueError("keys are repeated")
            words.append(-(-ROOM * len(left) // 64))
            at = _places(left, len(words) - 1, words[-1])
            alone = np.bincount(at, minlength=64 * words[-1]) == 1
            bits.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(words, np.concatenate(bits) if bits else np.empty(0, "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, todo, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, words in enumerate(self.words):
            if not len(todo):
                break
            at = _places(keys[todo], level, words)
            word, bit = self.bits[start + (at >> 6)], (at & 63).astype(_U)
            found = (word >> bit & _U(1)).astype(bool)
            below = np.bitwise_count(word[found] & ((_U(1) << bit[found]) - _U(1)))
            out[todo[found]] = self.ranks[start + (at[found] >> 6)] + below
            todo, start = todo[~found], start + words
        return out


@dataclass
class Shard:
    perfect: PerfectHash
    fingerprints: np.ndarray
    numbers: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, numbers: np.ndarray) -> "Shard":
        perfect = PerfectHash.of(keys)
        at = perfect.slots(keys)
        marks, held = np.empty(len(keys), "<u8"), np.empty(len(keys), "<i8")
        marks[at], held[at] = fingerprints(keys), numbers
        return cls(perfect, marks, held)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, number) of each key, (-1, 0) where it isn't in."""
        at = self.perfect.slots(keys)
        at[at >= 0] = np.where(self.fingerprints[at[at >= 0]] == fingerprints(keys[at >= 0]), at[at >= 0], -1)
        return at, np.where(at >= 0, self.numbers[at] if len(self.numbers) else 0, 0)

    def nbytes(self) -> int:
        return self.perfect.bits.nbytes + self.perfect.ranks.nbytes + self.fingerprints.nbytes + self.numbers.nbytes


def shard_of(first_half: np.ndarray, shards: int) -> np.ndarray:
    return ((first_half.view(_U) >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


@dataclass
class Index:
    """A built table of shards; small, so that tasks are sent it. ``before``: the keys of all shards before each."""

    path: str
    before: list[int]

    @property
    def size(self) -> int:
        return self.before[-1]

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of two 64-bit integers its slot among all keys, from 0, and its number; -1 and 0 where it isn't in."""
        slots, numbers = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        if not len(keys) or not self.size:
            return slots, numbers
        shard = shard_of(np.ascontiguousarray(keys[:, 0]), len(self.before) - 1)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(len(self.before)))
        for k in np.unique(shard).tolist():
            if self.before[k + 1] > self.before[k]:
                own = order[cuts[k] : cuts[k + 1]]
                at, numbers[own] = _open(self.path, k).look_up(np.ascontiguousarray(keys[own]))
                slots[own] = np.where(at >= 0, at + self.before[k], -1)
        return slots, numbers


#: The shards that this process holds, those used last at the end.
_held: OrderedDict[tuple[str, int], Shard] = OrderedDict()


def _open(path: str, shard: int) -> Shard:
    key = (path, shard)
    if key not in _held:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(f"{path}/shard={shard}")
        files = [x.path for x in store.get_file_info(fs.FileSelector(root)) if x.base_name.endswith(".parquet") and not x.base_name.startswith((".", "_"))]
        row = pa.concat_tables([pq.ParquetFile(store.open_input_file(x)).read() for x in files]).to_pylist()[0]
        _held[key] = Shard(PerfectHash(row["words"], np.frombuffer(row["bits"], "<u8")), np.frombuffer(row["fingerprints"], "<u8"), np.frombuffer(row["numbers"], "<i8"))
        while len(_held) > 1 and sum(x.nbytes() for x in _held.values()) > CACHE_BYTES:
            _held.popitem(last=False)
    _held.move_to_end(key)
    return _held[key]


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, as other programs than Spark need it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def build(keys: DataFrame, label: str, shard_keys: int = SHARD_KEYS) -> Index:
    """Index distinct keys: ``first long, second long, number long``; both halves must be well mixed."""
    spark = keys.sparkSession
    keys = staged(keys.select("first", "second", "number"), label)
    shards = max(LEAST_SHARDS, -(-keys.count() // shard_keys))
    path = new_path(spark, f"{label}-index")

    def make(key, table):
        pairs = np.column_stack([table.column("first").to_numpy(), table.column("second").to_numpy()])
        s = Shard.of(pairs, table.column("number").to_numpy())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(pairs)], pa.int64()), "words": pa.array([s.perfect.words], pa.list_(pa.int32())), "bits": pa.array([s.perfect.bits.tobytes()], pa.binary()),
                         "fingerprints": pa.array([s.fingerprints.tobytes()], pa.binary()), "numbers": pa.array([s.numbers.tobytes()], pa.binary())})

    dealt = keys.withColumn("shard", F.shiftright(F.shiftrightunsigned("first", 32) * shards, 32).cast("int"))
    dealt.groupBy("shard").applyInArrow(make, SCHEMA).write.partitionBy("shard").option("compression", "none").parquet(path)
    sizes = {r["shard"]: r["n"] for r in spark.read.schema(SCHEMA).parquet(path).select("shard", "n").collect()}  # two numbers a shard
    return Index(qualified(spark, path), [0, *np.cumsum([sizes.get(k, 0) for k in range(shards)]).tolist()])
