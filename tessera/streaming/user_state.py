"""The user state as a stateful stream.

Changes arrive in any order and in any batches. For each user and problem the state
store holds one value, the state after all changes that the watermark has passed, and
the changes after it, in no order, packed as arrays. A batch appends its changes to those, carries all out
in order of (ts, seq) from the value, in numpy, and emits the state that results; what the
watermark has passed meanwhile becomes part of the value. So a recall is decided
against the row as it stood at the recall's own time, and a late change is put where it belongs.

``late`` says how far behind the latest change one may come; later ones are dropped by
Spark. Without it nothing is dropped and every change is held, 20 bytes each; a key's
changes are one value of the state store and are held by one task.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources.bucketed import BucketTable

CHANGES = "user_id long, problem_id long, ts timestamp, seq long, kind string, value string"
STATE = "user_id long, problem_id long, done boolean, done_at timestamp, bookmarked boolean, bookmarked_at timestamp, recall string, updated_at timestamp, present boolean"
#: In the state store times are microseconds.
_VALUE = "done boolean, done_at long, bookmarked boolean, bookmarked_at long, recall string, updated_at long"
NOTHING = (False, None, False, None, None, None)
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def step(value: tuple, change: tuple) -> tuple:
    """The state after one change ``(time, seq, kind, value)``."""
    done, done_at, marked, marked_at, recall, updated = value
    ts, _, kind, to = change
    if kind == "done":
        return to == "true", ts if to == "true" else None, marked, marked_at, recall, ts
    if kind == "bookmarked":
        return done, done_at, to == "true", ts if to == "true" else None, recall, ts
    if kind == "recall" and (done or marked or recall is not None):
        return done, done_at, marked, marked_at, None if to == "none" else to, ts
    return value


#: A change as a number: flags that are set or not, in the order that their values have, then recalls by their word. 6: no effect.
_FLAGS, NO_EFFECT, RECALL = {"bookmarked": 0, "done": 3}, 6, 7
NO_TIME = -(1 << 63)
#: Changes in one value of the state store, and such values of a key before they are put together.
PACK, PACKS = 1 << 18, 32
_EMPTY = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)


def code() -> Column:
    """``kind`` and ``value`` as a number; ties of (ts, seq) go by it, as they would by kind and value."""
    flag = lambda k: F.when((F.col("kind") == k) & (F.col("value") == "true"), n := _FLAGS[k] + 1).when((F.col("kind") == k) & (F.col("value") > "true"), n + 1).when(F.col("kind") == k, n - 1)
    return F.coalesce(flag("bookmarked"), flag("done"), F.when(F.col("kind") == "recall", RECALL), F.lit(NO_EFFECT)).cast("int")


def folded(start: tuple, at: np.ndarray, seq: np.ndarray, codes: np.ndarray, words: list) -> tuple:
    """The state after changes in any order, carried out by (at, seq, code) as ``step`` does one by one.

    A recall of a word takes hold if a flag is set, or if the last recall that surely took
    hold (one under a flag, or one that clears) left a word.
    """
    done, done_at, marked, marked_at, recall, updated = start
    order = np.lexsort((codes, seq, at))
    at, codes = at[order], codes[order]
    n = np.arange(len(at))

    def flag(kind: str, now: bool, when):
        first = _FLAGS[kind]
        mine = (codes >= first) & (codes < first + 3)
        last = np.maximum.accumulate(np.where(mine, n, -1))
        set_ = np.where(last < 0, now, codes[last] == first + 1)
        if len(n) and last[-1] >= 0:
            now = bool(set_[-1])
            when = int(at[last[-1]]) if now else None
        return mine, set_, now, when

    is_done, d, done, done_at = flag("done", done, done_at)
    is_marked, b, marked, marked_at = flag("bookmarked", marked, marked_at)
    is_recall = codes >= RECALL
    clears = is_recall & np.array([False] * RECALL + [w is None or w == "none" for w in words])[codes]
    sure = (is_recall & (d | b)) | clears
    last = np.maximum.accumulate(np.where(sure, n, -1))
    held = np.where(last < 0, recall is not None, ~clears[last])
    before = np.r_[recall is not None, held[:-1]] if len(n) else held  # a recall that clears is asked what it found
    holds = is_recall & (d | b | np.where(clears, before, held))
    told = np.flatnonzero(holds)
    if len(told):
        word = words[codes[told[-1]] - RECALL]
        recall = None if word is None or word == "none" else word
    moved = np.flatnonzero(is_done | is_marked | holds)
    return done, done_at, marked, marked_at, recall, int(at[moved[-1]]) if len(moved) else updated


def joined(packs: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Packs ``(at, seq, codes, words)`` as one, its words in order, so that codes are in the order of values."""
    words = sorted({w for p in packs for w in p[3]}, key=lambda w: (w is not None, w or ""))
    place = {w: RECALL + i for i, w in enumerate(words)}
    parts = [_EMPTY] + [(at, seq, np.array([*range(RECALL), *(place[w] for w in own)], np.int32)[codes]) for at, seq, codes, own in packs]
    return *(np.concatenate(x) for x in zip(*parts)), words


def pack(rows) -> tuple:
    """A frame of changes; of recalls each word once."""
    codes, words = rows["code"].to_numpy(np.int32), []
    recall = codes >= RECALL
    if recall.any():
        numbers, found = pd.factorize(rows["word"].to_numpy(object)[recall], use_na_sentinel=False)
        codes, words = codes.copy(), [None if pd.isna(w) else str(w) for w in found]
        codes[recall] = RECALL + numbers
    keep = codes != NO_EFFECT
    return rows["at"].to_numpy(np.int64)[keep], rows["seq"].to_numpy(np.int64)[keep], codes[keep], words


class Fold(StatefulProcessor):
    """Changes are held as arrays of bytes, 20 a change: a batch appends what came, and reads what is held, in numpy."""

    def __init__(self, late: bool):
        self.late = late

    def init(self, handle) -> None:
        self.settled = handle.getValueState("settled", _VALUE)
        self.open = handle.getListState("open", "at binary, seq binary, codes binary, words array<string>")

    @staticmethod
    def stored(at, seq, codes, words) -> list[tuple]:
        cuts = [slice(i, i + PACK) for i in range(0, len(at), PACK)]
        return [(at[c].tobytes(), seq[c].tobytes(), codes[c].tobytes(), list(words)) for c in cuts]

    def handleInputRows(self, key, rows, timerValues):
        held = [(np.frombuffer(a, "<i8"), np.frombuffer(s, "<i8"), np.frombuffer(c, "<i4"), list(w)) for a, s, c, w in self.open.get()]
        came = joined([pack(frame) for frame in rows])
        at, seq, codes, words = joined([*held, came]) if held else came
        value = tuple(self.settled.get()) if self.settled.exists() else NOTHING
        # without a bound on lateness nothing settles
        past = at < timerValues.getCurrentWatermarkInMs() * 1000 if self.late else np.zeros(len(at), bool)
        if past.any():
            value = folded(value, at[past], seq[past], codes[past], words)
            self.settled.update(value)
            at, seq, codes = at[~past], seq[~past], codes[~past]
        if past.any() or len(held) >= PACKS and sum(len(h[0]) for h in held) < PACK * len(held) // 2:
            self.open.clear()
            if len(at):
                self.open.put(self.stored(at, seq, codes, words))
        elif len(came[0]):
            self.open.appendList(self.stored(*came))
        now = folded(value, at, seq, codes, words)
        time = lambda t: None if t is None or t == NO_TIME else t
        out = {"user_id": [key[0]], "problem_id": [key[1]], "done": [now[0]], "done_at": [time(now[1])], "bookmarked": [now[2]], "bookmarked_at": [time(now[3])], "recall": [now[4]], "updated_at": [time(now[5])], "present": [bool(now[0] or now[2] or now[4] is not None)]}
        yield pd.DataFrame(out).astype({c: "Int64" for c in ("done_at", "bookmarked_at", "updated_at")})

    def close(self) -> None:
        pass


def states(changes: DataFrame, late: str | None = None) -> DataFrame:
    """STATE: the state of each user and problem that a batch of CHANGES touches, as a stream of updates."""
    rows = changes.select("user_id", "problem_id", F.col("ts").cast("timestamp").alias("ts"), "seq", "kind", "value")
    if late:
        rows = rows.withWatermark("ts", late)
    packed = rows.select("user_id", "problem_id", *(["ts"] if late else []), F.coalesce(F.unix_micros("ts"), F.lit(NO_TIME)).alias("at"), F.coalesce("seq", F.lit(NO_TIME)).alias("seq"), code().alias("code"), F.when(F.col("kind") == "recall", F.col("value")).alias("word"))
    out = packed.groupBy("user_id", "problem_id").transformWithStateInPandas(Fold(late is not None), f"user_id long, problem_id long, {_VALUE}, present boolean", "Update", "EventTime" if late else "None")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("done_at", "bookmarked_at", "updated_at")})


@contextmanager
def rocks(spark: SparkSession):
    """The state store that keyed state needs, as long as a stream starts; what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keep_table(changes: DataFrame, path: str, checkpoint: str, late: str | None = None, buckets: int = 16):
    """Keep a bucket table of states up to date: a batch's states are merged, those that are gone deleted. A repeated batch changes nothing more.

    Returns the running query; it ends when all that is there now is read.
    """
    spark = changes.sparkSession
    table = BucketTable(spark, path)
    if not table.versions():
        BucketTable.create(spark.createDataFrame([], f"id string, {STATE}"), path, "id", buckets)

    def save(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("id", F.concat_ws(":", "user_id", "problem_id")).persist()
        try:
            own = BucketTable(rows.sparkSession, path)
            own.upsert(rows.where("present"))
            own.delete(rows.where("NOT present"))
            own.vacuum()
        finally:
            rows.unpersist()

    with rocks(spark):
        return states(changes, late).writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
