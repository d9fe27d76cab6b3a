"""Masked pseudo-likelihood of documents by a bidirectional window network.

Every word is predicted from the two words on either side of it; the logarithms
of those conditional probabilities, summed, score the document. The probability
of a word is that of its class in its window, by the network, times that of the
word in its class. The OWN_CLASSES most frequent words are classes of their own;
all others share hashed classes, in which each word has its own probability, from
its count over all documents. The words that occur most, LISTED in all, are held by
every task; what occurrences of further words add to a document's score comes from
a join with their counts, by word. So probabilities add up to one over all words,
what each task holds is bounded, and scores don't depend on that bound. Words are
told apart by 64-bit hashes.

The network is small and written in numpy: an embedding for each place of the
window, one softsign layer, and a two-step softmax: over 32 groups, and, through a
gate on the hidden layer for each group, over the 32 classes of the group.

Training is data-parallel and reads every position of every document once. Documents
are dealt to *shares* of some SHARE_WORDS words by a hash of their id and content, so
shares follow from the corpus and not from how it lies in files and tasks. In each of
ROUNDS rounds a copy of the network is trained on each share's part of the positions,
every ROUNDS-th from another offset each round. The copies, and the squared gradients
by which Adagrad slows down, are averaged by what they have read, first in groups, so
that the driver receives at most GROUPS of them a round; the next round goes on from both.
The larger the corpus the more copies there are, each with as much to learn from.

Null and empty texts have no words: likelihood 0 and mean null. A text of any
length is scored whole; a batch holds its class numbers, two bytes a word.
Repeated rows have equal scores; an empty table gives an empty frame; further
columns are not read. Other partitions of the same rows give the same scores but for
the last digits of sums.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import quoted, settings, small_batches, staged, text_of, texts

SIDE = 32
CLASSES, OWN_CLASSES = SIDE * SIDE, 768
EDGE = CLASSES
DIM, REACH = 16, 2
ROUNDS, BATCH, RATE, START, GROUPS, SHARE_WORDS = 4, 4096, 0.2, 1e-6, 8, 2_000_000
#: Distinct words that a task holds while it counts.
FLUSH_WORDS = 300_000
#: What a task remembers: words that come so often in one group of texts, up to so many.
OFTEN, OFTEN_WORDS = 4, 30_000
#: Words of shared classes whose probabilities every task holds.
LISTED = 2_000_000
#: Occurrences that each word of a shared class, and the unseen ones together, are taken to have besides their own.
BASE = 0.5
#: Positions whose windows are held at once.
HELD = 1 << 16
_ONES = np.ones(SIDE, np.float32)
_OFFSETS = [k for k in range(-REACH, REACH + 1) if k]


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().split()


def keys_of(words) -> np.ndarray:
    """The words' hashes as signed 64-bit integers."""
    from xxhash import xxh64_intdigest

    words = list(words)
    return np.fromiter(map(xxh64_intdigest, words, repeat(0)), np.uint64, len(words)).view(np.int64)


def shared_class(keys):
    return OWN_CLASSES + keys % (CLASSES - OWN_CLASSES)


@dataclass
class Vocabulary:
    """Class and log p(word | class) of every word, by its key; plain arrays, so that tasks can be sent it."""

    frequent: np.ndarray  # keys in ascending order
    classes: np.ndarray  # and their classes
    listed: np.ndarray  # keys in ascending order
    within: np.ndarray  # and their log p
    rest: np.ndarray  # for each class the log p of a word that isn't listed, if nothing is known of it
    scale: np.ndarray  # for each class the log of what a word's count, plus BASE, is divided by
    complete: bool  # whether all words of shared classes are listed

    @classmethod
    def of(cls, frequent: np.ndarray, keys: np.ndarray, n: np.ndarray, totals: np.ndarray, kinds: np.ndarray) -> "Vocabulary":
        """``frequent``: keys by falling count; ``keys, n``: the listed words; ``totals, kinds``: occurrences and words of each class."""
        order, at = np.argsort(frequent), np.argsort(keys)
        keys, n = keys[at], n[at]
        whole = totals + BASE * (kinds + 1)
        own = shared_class(keys)
        left = whole - np.bincount(own, n + BASE, CLASSES)
        others = kinds - np.bincount(own, minlength=CLASSES) + 1
        rest = np.log(np.maximum(left, BASE) / others / whole)
        rest[: len(frequent)] = 0.0
        return cls(frequent[order], order.astype(np.int16), keys, (np.log(n + BASE) - np.log(whole[own])).astype(np.float32), rest.astype(np.float32), np.log(whole), len(keys) == kinds.sum())

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = shared_class(keys).astype(np.int16)
        p = self.rest[out]
        if len(self.listed):
            i = np.minimum(np.searchsorted(self.listed, keys), len(self.listed) - 1)
            found = self.listed[i] == keys
            p = np.where(found, self.within[i], p)
        if len(self.frequent):
            i = np.minimum(np.searchsorted(self.frequent, keys), len(self.frequent) - 1)
            found = self.frequent[i] == keys
            out, p = np.where(found, self.classes[i], out), np.where(found, np.float32(0), p)
        return out, p


    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each word is a class of its own or listed."""
        out = np.zeros(len(keys), bool)
        for own in (self.listed, self.frequent):
            if len(own):
                out |= own[np.minimum(np.searchsorted(own, keys), len(own) - 1)] == keys
        return out


class Reader:
    """Turns texts into class numbers; remembers a bounded number of words that come often, and looks others up by key.

    With ``by_join`` the keys of words that aren't listed come along, and the sums
    lack the logarithm of those words' counts.
    """

    def __init__(self, vocabulary: Vocabulary, by_join: bool = False):
        self.vocabulary, self.by_join = vocabulary, by_join
        self.slot: dict[bytes, int] = {}
        self.cls, self.within = np.empty(0, np.int16), np.empty(0, np.float32)

    def read(self, many: list[str]):
        """(classes, summed log p(word | class), keys of words whose counts are still to be joined) of each text."""
        at = 0
        while at < len(many):
            size, end = 0, at
            while end < len(many) and (size < 4 * HELD or end == at):
                size += len(many[end])
                end += 1
            cut = [words_of(x) for x in many[at:end]]
            ends = np.cumsum([len(x) for x in cut])
            cls, within, at_join, keys = self._look_up(list(chain.from_iterable(cut)))
            sums = np.r_[0.0, np.cumsum(within, dtype=np.float64)]
            cuts = np.searchsorted(at_join, np.r_[0, ends])
            for i, (start, stop) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                yield cls[start:stop], float(sums[stop] - sums[start]), keys[cuts[i] : cuts[i + 1]]
            at = end

    def _look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at_join, joined_keys = np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.fromiter(map(self.slot.get, words, repeat(-1)), np.int32, len(words))
        missed = np.flatnonzero(at < 0)
        cls, within = np.empty(len(words), np.int16), np.empty(len(words), np.float32)
        known = at >= 0
        cls[known], within[known] = self.cls[at[known]], self.within[at[known]]
        if len(missed):
            rare = [words[i] for i in missed.tolist()]
            keys, first, inverse, n = np.unique(keys_of(rare), return_index=True, return_inverse=True, return_counts=True)
            own_cls, own_within = self.vocabulary.look_up(keys)
            here = np.ones(len(keys), bool)
            if self.by_join:
                here = self.vocabulary.has(keys)
                own_within = np.where(here, own_within, -self.vocabulary.scale[own_cls])
                away = ~here[inverse]
                at_join, joined_keys = missed[away], keys[inverse[away]]
            cls[missed], within[missed] = own_cls[inverse], own_within[inverse]
            often = np.flatnonzero(here & (n >= OFTEN))[: OFTEN_WORDS - len(self.slot)]
            self.slot.update(zip((rare[i] for i in first[often].tolist()), range(len(self.slot), len(self.slot) + len(often))))
            self.cls, self.within = np.concatenate([self.cls, own_cls[often]]), np.concatenate([self.within, own_within[often]])
        return cls, within, at_join, joined_keys


def joined(many: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts' classes in a row with edge marks around each, and the places of the words."""
    edge = np.full(REACH, EDGE, np.int16)
    row = np.concatenate([edge, *(x for one in many for x in (one, edge))])
    return row, np.flatnonzero(row != EDGE)


def windows(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, target) classes of the words at these places; the context place by place."""
    return np.stack([row[at + k] for k in _OFFSETS]), row[at].astype(np.int64)


class WindowNetwork:
    """log p(class | words on both sides)."""

    SHAPES = {"embed": (2 * REACH, CLASSES + 1, DIM), "bias": (DIM,), "high": (DIM, SIDE), "high_bias": (SIDE,), "low": (DIM, SIDE), "group": (SIDE, DIM), "low_bias": (SIDE, SIDE)}

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, counts: np.ndarray) -> "WindowNetwork":
        """Small random weights; the output biases start from the classes' overall frequencies."""
        r = np.random.default_rng(1)
        w = {k: (r.standard_normal(s) * 0.05).astype(np.float32) for k, s in cls.SHAPES.items()}
        p = (counts + 1.0).reshape(SIDE, SIDE)
        w["high_bias"] = np.log(p.sum(1) / p.sum()).astype(np.float32)
        w["low_bias"] = np.log(p / p.sum(1, keepdims=True)).astype(np.float32)
        w["group"] += 1
        return cls(w)

    def to_bytes(self) -> bytes:
        return b"".join(self.w[k].astype("<f4").tobytes() for k in self.SHAPES)

    @classmethod
    def from_flat(cls, flat: np.ndarray) -> "WindowNetwork":
        out, at = {}, 0
        for k, s in cls.SHAPES.items():
            n = int(np.prod(s))
            out[k] = flat[at : at + n].reshape(s).astype(np.float32)
            at += n
        return cls(out)

    def _hidden(self, context: np.ndarray) -> np.ndarray:
        w = self.w
        x = w["embed"][0].take(context[0], axis=0)
        for p in range(1, 2 * REACH):
            x += w["embed"][p].take(context[p], axis=0)
        x += w["bias"]
        x /= 1 + np.abs(x)
        return x

    @staticmethod
    def _exp(x: np.ndarray) -> np.ndarray:
        """Exponentials up to a common factor a row; logits are rarely so large that one is needed."""
        if np.abs(x).max(initial=0) > 60:
            x -= x.max(1, keepdims=True)
        return np.exp(x)

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        w, r = self.w, np.arange(len(target))
        h = self._hidden(context)
        g = target // SIDE
        total = np.zeros(len(target), np.float32)
        for x, pick in ((h @ w["high"] + w["high_bias"], g), ((h * w["group"].take(g, axis=0)) @ w["low"] + w["low_bias"].take(g, axis=0), target % SIDE)):
            e = self._exp(x)
            total += x[r, pick] - np.log(e @ _ONES)
        return total

    def train(self, context: np.ndarray, target: np.ndarray, squares: dict[str, np.ndarray]) -> None:
        """One pass in batches, by Adagrad."""
        for i in range(0, len(target), BATCH):
            self._step(context[:, i : i + BATCH], target[i : i + BATCH], squares)

    def gradients(self, c: np.ndarray, t: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean log-loss, for all weights but the embeddings; and for each row's hidden input."""
        w, r, g, n = self.w, np.arange(len(t)), t // SIDE, np.float32(len(t))
        h = self._hidden(c)
        gate = w["group"].take(g, axis=0)
        z = h * gate
        dh, dl = self._exp(h @ w["high"] + w["high_bias"]), self._exp(z @ w["low"] + w["low_bias"].take(g, axis=0))
        for d, pick in ((dh, g), (dl, t % SIDE)):
            d /= (d @ _ONES)[:, None] * n
            d[r, pick] -= 1 / n
        dz = dl @ w["low"].T
        dx = (dh @ w["high"].T + dz * gate) * np.square(1 - np.abs(h))
        one = np.zeros((SIDE, len(t)), np.float32)
        one[g, r] = 1
        return {"high": h.T @ dh, "high_bias": dh.sum(0), "low": z.T @ dl, "group": one @ (dz * h), "low_bias": one @ dl, "bias": dx.sum(0)}, dx

    def _step(self, c: np.ndarray, t: np.ndarray, squares: dict[str, np.ndarray]) -> None:
        grads, dx = self.gradients(c, t)
        for k, d in grads.items():
            squares[k] += d * d
            self.w[k] -= RATE * d / np.sqrt(squares[k] + 1e-8)
        for p in range(2 * REACH):
            order = np.argsort(c[p], kind="stable")
            own = c[p][order]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            rows, d = own[starts], np.add.reduceat(dx.take(order, axis=0), starts, axis=0)
            s = squares["embed"][p].take(rows, axis=0) + d * d
            squares["embed"][p][rows] = s
            self.w["embed"][p][rows] -= RATE * d / np.sqrt(s + 1e-8)


def count_words(base: DataFrame) -> DataFrame:
    """``key, n`` over all documents; tasks count before the shuffle, in bounded memory."""

    def run(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(keys_of(held)), pa.array(np.fromiter(held.values(), np.int64, len(held)))], names=["key", "n"])

        for b in batches:
            for x in texts(b.column("text")):
                held.update(words_of(x))
                if len(held) > FLUSH_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return base.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def least_count(words: DataFrame, limit: int) -> int:
    """The least count such that no more than ``limit`` words have it or a larger one."""
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin("n")) - 11, F.lit(0))).cast("long")
    rows = words.groupBy((F.floor(F.col("n") / step) * step).alias("n")).agg(F.count("*").alias("kinds")).collect()  # eleven significant bits: some 50,000 rows at most
    least, seen = 1 << 62, 0
    for r in sorted(rows, reverse=True):
        seen += r["kinds"]
        if seen > limit:
            break
        least = r["n"]
    return least


def vocabulary_of(base: DataFrame, listed: int = LISTED) -> tuple[Vocabulary, np.ndarray, DataFrame]:
    """The vocabulary, the occurrences of each class, and ``key, n`` of the words of shared classes that aren't listed."""
    words = staged(count_words(base), "words")
    top = words.orderBy(F.desc("n"), "key").limit(OWN_CLASSES).toArrow()
    frequent = top.column("key").to_numpy()
    shared = words
    if len(frequent) == OWN_CLASSES:
        n, key = int(top.column("n")[-1].as_py()), int(frequent[-1])
        shared = words.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("key") > key)))
    else:
        shared = words.where("false")
    totals, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    totals[: len(top)] = top.column("n").to_numpy()
    cls = F.lit(OWN_CLASSES) + F.pmod("key", F.lit(CLASSES - OWN_CLASSES))
    for r in shared.groupBy(cls.cast("int").alias("class")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():  # one row per shared class
        totals[r["class"]], kinds[r["class"]] = r["n"], r["kinds"]
    least = least_count(shared, listed)
    known = shared.where(F.col("n") >= least).toArrow()  # at most ``listed`` rows of two numbers
    return Vocabulary.of(frequent, known.column("key").to_numpy(), known.column("n").to_numpy().astype(np.float64), totals, kinds), totals, shared.where(F.col("n") < least)


def numbered_classes(docs: DataFrame, id_col: str, text_col: str, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, row, within, classes, keys``, staged: classes as little-endian 16-bit numbers, keys of words not listed."""
    base = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_of(text_col).alias("text"))
    kind, sent = base.schema["doc_id"].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(vocabulary)  # 12 bytes for each of at most LISTED words

    def run(batches):
        reader = Reader(sent.value, by_join=not sent.value.complete)
        for b in batches:
            got = list(reader.read(texts(b.column("text"))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array([p for _, p, _ in got], pa.float64()), pa.array([c.astype("<i2", copy=False).tobytes() for c, _, _ in got], pa.binary()), pa.array([k for _, _, k in got], pa.list_(pa.int64()))], names=["doc_id", "row", "within", "classes", "keys"])

    return staged(base.mapInArrow(run, f"doc_id {kind}, row long, within double, classes binary, keys array<long>"), "classes")


def joined_counts(data: DataFrame, unlisted: DataFrame) -> DataFrame:
    """``row, more``: the summed logarithms of the counts of a row's words that aren't listed.

    None of these words is frequent, or it were listed, so no key is hot; a row's
    repeats of a word are counted before they are shuffled.
    """
    met = data.select("row", F.explode("keys").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    return met.join(unlisted, "key").groupBy("row").agg(F.sum(F.col("times") * F.log(F.col("n") + BASE)).alias("more"))


def in_groups(batch: pa.RecordBatch):
    """The class arrays of a batch's rows, some rows at a time with about HELD words."""
    held, n = [], 0
    for x in batch.column("classes").to_pylist():
        held.append(np.frombuffer(x, "<i2"))
        n += len(held[-1])
        if n >= HELD:
            yield held
            held, n = [], 0
    if held:
        yield held


def shares_of(data: DataFrame, share_words: int = SHARE_WORDS) -> DataFrame:
    """``share, classes, lengths``, staged: a row for each share, its documents' class numbers behind each other, in order of their hash.

    Rows of one id and content are counted before they are shuffled and dealt to shares by their number, so that
    many of them don't meet in one.
    """
    words = data.agg(F.coalesce(F.sum(F.length("classes")), F.lit(0))).first()[0] // 2
    shares = max(1, -(-words // share_words))
    equal = data.where(F.length("classes") > 0).groupBy(F.col("doc_id").cast("string").alias("id"), "classes").agg(F.count("*").alias("n"))
    rows = equal.select("id", "classes", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).withColumn("h", F.xxhash64("id", "classes", "i"))
    dealt = rows.select(F.pmod("h", F.lit(shares)).cast("int").alias("share"), "h", "classes")

    def pack(key, table):
        order = np.lexsort((np.array([len(x) for x in table.column("classes").to_pylist()]), table.column("h").to_numpy()))
        parts = table.column("classes").to_pylist()
        parts = [parts[i] for i in order.tolist()]
        return pa.table({"share": pa.array([key[0].as_py()], pa.int32()), "classes": pa.array([b"".join(parts)], pa.binary()), "lengths": pa.array([np.array([len(x) // 2 for x in parts], "<i4").tobytes()], pa.binary())})

    return staged(dealt.groupBy("share").applyInArrow(pack, "share int, classes binary, lengths binary"), "shares")


def groups_of(classes: bytes, lengths: bytes):
    """The class arrays of a share's documents, some at a time with about HELD words."""
    flat, ends = np.frombuffer(classes, "<i2"), np.cumsum(np.frombuffer(lengths, "<i4"), dtype=np.int64)
    at = 0
    while at < len(ends):
        start = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, start + HELD)))
        yield np.split(flat[start : ends[to - 1]], ends[at : to - 1] - start)
        at = to


def train_round(shares: DataFrame, state: np.ndarray, number: int, rounds: int) -> np.ndarray:
    """A copy for each share goes on from ``state``, weights and squares in a row, with this round's positions; the average weighted by what they read comes back."""

    def run(batches):
        for b in batches:
            for share, classes, lengths in zip(b.column("share").to_pylist(), b.column("classes"), b.column("lengths")):
                own = WindowNetwork.from_flat(state[: len(state) // 2])
                squares = WindowNetwork.from_flat(state[len(state) // 2 :]).w
                n, random = 0, np.random.default_rng((number, share))
                for group in groups_of(classes.as_py(), lengths.as_py()):
                    row, at = joined(group)
                    at = at[number::rounds]
                    if len(at):
                        own.train(*windows(row, random.permutation(at)), squares)
                        n += len(at)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([share % GROUPS], pa.int32()), pa.array([share], pa.int32()), pa.array([n], pa.int64()), pa.array([own.to_bytes() + WindowNetwork(squares).to_bytes()], pa.binary())], names=["part", "share", "n", "state"])

    def average(batches):
        total, n, part = None, 0, 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([(total / n).tobytes()], pa.binary())], names=["part", "n", "state"])

        for b in batches:
            for p, k, blob in zip(b.column("part").to_pylist(), b.column("n").to_pylist(), b.column("state")):
                if n and p != part:
                    yield out()
                    total, n = None, 0
                x, part = np.frombuffer(blob.as_py(), "<f4").astype(np.float64) * k, p
                total, n = x if total is None else total + x, n + k
        if n:
            yield out()

    few = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}  # rows are large
    with settings(shares.sparkSession, few):
        copies = shares.mapInArrow(run, "part int, share int, n long, state binary").repartition(GROUPS, "part").sortWithinPartitions("part", "share")
        got = sorted(copies.drop("share").mapInArrow(average, "part int, n long, state binary").collect())  # GROUPS rows at most
    if not got:
        return state
    n = sum(r["n"] for r in got)
    return sum(np.frombuffer(bytes(r["state"]), "<f8") * (r["n"] / n) for r in got).astype("<f4")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, passes: int = 1, listed: int = LISTED, share_words: int = SHARE_WORDS) -> tuple[Vocabulary, WindowNetwork, DataFrame, DataFrame]:
    """The vocabulary, the network trained on every position ``passes`` times, the documents as class numbers, and the words not listed."""
    with small_batches(docs.sparkSession):
        vocabulary, totals, unlisted = vocabulary_of(docs.select(text_of(text_col).alias("text")), listed)
    data = numbered_classes(docs, id_col, text_col, vocabulary)
    network = WindowNetwork.fresh(totals)
    weights = np.frombuffer(network.to_bytes(), "<f4")
    shares, state = shares_of(data, share_words), np.r_[weights, np.full(len(weights), START, "<f4")].astype("<f4")
    for k in range(rounds * passes):
        state = train_round(shares, state, k % rounds, rounds)
    return vocabulary, WindowNetwork.from_flat(state[: len(weights)]), data, unlisted


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, passes: int = 1, listed: int = LISTED, share_words: int = SHARE_WORDS) -> DataFrame:
    """``doc_id, mean_log_likelihood, log_likelihood, n_words`` for each row."""
    vocabulary, network, data, unlisted = train(docs, id_col, text_col, rounds, passes, listed, share_words)
    kind = data.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            n, total = [], []
            for group in in_groups(b):
                row, at = joined(group)
                p = np.concatenate([network.log_probabilities(*windows(row, at[i : i + BATCH])) for i in range(0, len(at), BATCH)] or [np.empty(0, np.float32)])
                ends = np.cumsum([len(x) for x in group])
                sums = np.r_[0.0, np.cumsum(p, dtype=np.float64)]
                n += [len(x) for x in group]
                total += (sums[ends] - sums[ends - np.array(n[-len(group):])]).tolist()
            total = np.array(total, np.float64) + b.column("within").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(total), pa.array(n, pa.int64())], names=["doc_id", "row", "log_likelihood", "n_words"])

    scored = data.select("doc_id", "row", "within", "classes").mapInArrow(run, f"doc_id {kind}, row long, log_likelihood double, n_words long")
    if not vocabulary.complete:
        scored = scored.join(joined_counts(data, unlisted), "row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("more", F.lit(0.0)))
    return scored.select("doc_id", F.try_divide("log_likelihood", "n_words").alias("mean_log_likelihood"), "log_likelihood", "n_words")
