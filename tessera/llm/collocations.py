"""Phrase collocations by pivot partitioning.

A phrase of two to five words that occurs often has only frequent words, and all its
pairs of neighbours are frequent. The rarest of its words (least count, then least
number of the word) is its pivot, and each occurrence belongs to the first place of
its pivot in it. So each frequent word in a text, taken as pivot, needs only its
surroundings: up to four words to the left that are commoner, up to four to the right
that are no rarer, as far as each neighbouring pair is frequent and the piece goes on.
All else is cut away, which leaves most words without a fragment. Equal fragments of
a stretch of texts are one with a count.

Pivots are dealt to buckets, so many that each has about BUCKET_ROWS fragments, and a
stretch's fragments for a bucket travel as one block. A bucket is mined at once, and
emits only phrases that its pivots own, so no other task has them. A pivot that
occurs more than PIVOT_ROWS times is split by its neighbours: what it owns with its
right neighbour goes by that word, what it owns as the last word by the left one, so
that each phrase still has one place. Where a pair alone is that frequent, fragments
are dealt by their hash, and Spark adds up the parts' counts of a phrase.

Words and pairs are counted by passes that count in each task before they shuffle.
Frequent words get their numbers and counts from a sharded minimal perfect hash
(``perfect_hash``), and another one tells frequent pairs; tasks read both by the shard
from the shared folder, so no task and no broadcast holds the vocabulary. Fragments
are rows of numbers; words come back at the end.

Everything is within a language: a word of two languages is two words. Scores are
computed in decimals of 38 digits.

Defined results: null texts count as empty, a null language as ``und``; each row
counts, repeated rows too; texts of any length are read whole, each at once; ties are
broken as stated in ``collocations``; an empty table gives an empty frame; further
columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import perfect_hash
from .common import LOWER, UPPER, quoted, small_batches, staged, text_of

LEAST, LONGEST, TOP = 100, 5, 2000
REACH = LONGEST - 1
SPAN = 2 * REACH + 1
#: Occurrences of a pivot whose fragments one group holds at most, on average.
PIVOT_ROWS = 50_000
#: Distinct words, and pairs, that a task holds while it counts, and words that it remembers the numbers of.
FLUSH_WORDS, FLUSH_PAIRS, KNOWN_WORDS = 300_000, 1_000_000, 300_000
#: Bytes of texts that are read at once, and fragments of a bucket.
HELD_BYTES, BUCKET_ROWS = 2_000_000, 200_000
#: A byte that no UTF-8 text has stands for the end of a piece. What ends pieces is fixed; A to Z become small letters.
END = b"\xff"
_TABLE = bytes.maketrans(UPPER.encode() + b".,;:!?\n\x0b\x0c\r", LOWER.encode() + END * 10)


def tokens_of(text: bytes) -> list[bytes]:
    """Words and ends of pieces, in order."""
    return text.translate(_TABLE).replace(END, b" \xff ").split()


#: What a fragment is for: all phrases that its pivot owns, or those with the right neighbour; and whether other groups may have the same.
RIGHT_ONLY, SHARED = 1, 2
#: A block of fragments: for each a byte of its mode, how many words stand before the pivot, and how many it has; 32 bits for each word; 64 for its count.
BLOCK = "bucket int, modes binary, befores binary, lengths binary, words binary, counts binary"
_KINDS = {"modes": "i1", "befores": "i1", "lengths": "i1", "words": "<i4", "counts": "<i8"}


def by_language(batch: pa.RecordBatch):
    """(language, its texts) of a batch."""
    own: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
        own.setdefault(lang, []).append(text)
    return own.items()


def count_words(base: DataFrame) -> DataFrame:
    """``lang, word, n``; with the word null, the language's occurrences of any word."""

    def run(batches):
        held: dict[str, Counter] = {}

        def out():
            langs, words, n = [], [], []
            for lang, c in held.items():
                c.pop(END, None)
                langs += [lang] * (len(c) + 1)
                words += [None, *c]
                n += [sum(c.values()), *c.values()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

        for b in batches:
            for lang, own in by_language(b):
                for text in own:
                    held.setdefault(lang, Counter()).update(tokens_of(text))
            if sum(map(len, held.values())) > FLUSH_WORDS:
                yield out()
        yield out()

    return base.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_keys(langs, words) -> np.ndarray:
    return perfect_hash.digests([f"{len(x)}:{x}".encode() + w for x, w in zip(langs, words)])


def keyed(words: DataFrame) -> DataFrame:
    """``first, second, number`` for the index, from ``lang, word, n``."""

    def run(batches):
        for b in batches:
            h = word_keys(b.column("lang").to_pylist(), b.column("word").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), b.column("n")], names=["first", "second", "number"])

    return words.mapInArrow(run, "first long, second long, number long")


def numbered(words: DataFrame, index: perfect_hash.Index) -> DataFrame:
    """``word_id, lang, word, n``: the number that each word has in fragments."""

    def run(batches):
        for b in batches:
            h = word_keys(b.column("lang").to_pylist(), b.column("word").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(index.look_up(h)[0].astype(np.int32)), b.column("lang"), b.column("word"), b.column("n")], names=["word_id", "lang", "word", "n"])

    return words.mapInArrow(run, "word_id int, lang string, word string, n long")


class Numberer:
    """Turns texts of one language into numbers of words; remembers a bounded number of them."""

    def __init__(self, index: perfect_hash.Index, lang: str):
        self.index, self.lang = index, lang
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.number, self.count = np.empty(0, np.int64), np.empty(0, np.int64)

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, ranks) of all words and ends in order, with an end after each text; -1 for rare words and ends, and rarer words have lower ranks."""
        tokens: list[bytes] = []
        for x in texts:
            tokens += tokens_of(x)
            tokens.append(END)
        distinct = set(tokens)
        if len(self.known) + len(distinct) > KNOWN_WORDS:
            self._forget()
        if new := list(distinct.difference(self.known)):
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            number, count = self.index.look_up(word_keys([self.lang] * len(new), new))
            self.number, self.count = np.r_[self.number, number], np.r_[self.count, count]
        some = np.flatnonzero(self.number >= 0)
        rank = np.full(len(self.number), -1, np.int64)
        rank[some[np.lexsort((self.number[some], self.count[some]))]] = np.arange(len(some))
        at = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        return self.number[at], rank[at]

    def counts_of(self, numbers: np.ndarray) -> np.ndarray:
        """The counts of words that were read, by their numbers."""
        order = np.argsort(self.number, kind="stable")
        return self.count[order[np.searchsorted(self.number, numbers, sorter=order)]]


def pairs_of(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose word and the next are both frequent, and those pairs as one number each."""
    at = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0))
    return at, number[at] << 32 | number[at + 1]


def fragments_of(number: np.ndarray, rank: np.ndarray, linked: np.ndarray | None = None) -> np.ndarray:
    """A row of SPAN numbers for each word that may own a phrase; the word in the middle, -1 beyond the fragment.

    ``linked``: whether each word and the next may stand in one phrase; default: all.
    """
    edge = np.full(REACH, -1, np.int64)
    linked = np.r_[np.zeros(REACH, bool), np.ones(len(number), bool) if linked is None else linked, np.zeros(REACH, bool)]
    rank, number = np.r_[edge, rank, edge], np.r_[edge, number, edge]
    at = np.flatnonzero((number >= 0) & (linked | np.r_[False, linked[:-1]]))
    out = np.full((len(at), SPAN), -1, np.int32)
    out[:, REACH] = number[at]
    for step, beats in ((-1, np.greater), (1, np.greater_equal)):
        going = np.arange(len(at))
        for k in range(1, REACH + 1):
            to = at[going] + step * k
            going = going[linked[np.minimum(to, to - step)] & beats(rank[to], rank[at[going]])]
            out[going, REACH + step * k] = number[at[going] + step * k]
    return out[(out[:, REACH - 1] >= 0) | (out[:, REACH + 1] >= 0)]


def _mixed(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of numbers."""
    h = np.full(len(rows), 0x9E3779B97F4A7C15, np.uint64)
    for i in range(rows.shape[1]):
        h = (h ^ (rows[:, i].astype(np.uint32).astype(np.uint64) + np.uint64(1))) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def added_up(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their counts."""
    if not len(rows):
        return rows, n
    h = _mixed(rows)
    order = np.argsort(h, kind="stable")
    rows, h, n = rows[order], h[order], n[order]
    same_hash = h[1:] == h[:-1]
    same = (rows[1:] == rows[:-1]).all(1)
    if (same_hash & ~same).any():  # two rows of one hash: order by the rows themselves
        order = np.lexsort(rows.T)
        rows, n = rows[order], n[order]
        same = (rows[1:] == rows[:-1]).all(1)
    first = np.flatnonzero(np.r_[True, ~same])
    return rows[first], np.add.reduceat(n, first)


def packed(bucket: np.ndarray, mode: np.ndarray, rows: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A block for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, mode, rows, n = bucket[order], mode[order], rows[order], n[order]
    some = rows >= 0
    length = some.sum(1)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
    cuts = np.r_[first, len(bucket)]
    word_cuts = np.r_[0, np.cumsum(length, dtype=np.int64)][cuts]

    def blocks(values: np.ndarray, at: np.ndarray, kind: str) -> pa.Array:
        raw, ends = np.ascontiguousarray(values, kind).tobytes(), (at * np.dtype(kind).itemsize).tolist()
        return pa.array([raw[a:b] for a, b in zip(ends, ends[1:])], pa.binary())

    parts = {"modes": (mode, cuts), "befores": (some[:, :REACH].sum(1), cuts), "lengths": (length, cuts), "words": (rows[some], word_cuts), "counts": (n, cuts)}
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), *(blocks(x, at, _KINDS[k]) for k, (x, at) in parts.items())], names=["bucket", *_KINDS])


def unpacked(blocks: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(modes, rows, counts) of the fragments of blocks."""
    x = {k: np.frombuffer(b"".join(b[k] for b in blocks), kind) for k, kind in _KINDS.items()}
    size = x["lengths"].astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(REACH - x["befores"].astype(np.int64), size)
    rows = np.full((len(size), SPAN), -1, np.int32)
    rows[row, place] = x["words"]
    return x["modes"], rows, x["counts"]


def stretches(batches, index: perfect_hash.Index):
    """(reader, numbers, ranks) of the texts of a language, some HELD_BYTES at a time."""
    readers: dict[str, Numberer] = {}
    held: dict[str, list[bytes]] = {}
    size = 0

    def out():
        for lang, texts in held.items():
            reader = readers.setdefault(lang, Numberer(index, lang))
            yield reader, *reader.read(texts)
        held.clear()

    for b in batches:
        for lang, own in by_language(b):
            for text in own:
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size > HELD_BYTES:
                    yield from out()
                    size = 0
    yield from out()


def frequent_pairs(base: DataFrame, index: perfect_hash.Index, least: int) -> DataFrame:
    """``pair, n``: pairs of neighbouring words of at least ``least`` occurrences; tasks count before the shuffle."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            pairs, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(pairs, kind="stable")
            pairs, n = pairs[order], n[order]
            first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
            return (pairs[first], np.add.reduceat(n, first)) if len(pairs) else (pairs, n)

        def out():
            pairs, n = merged()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

        for _, number, _ in stretches(batches, index):
            held.append(np.unique(pairs_of(number)[1], return_counts=True))
            if sum(len(x) for x, _ in held) > 2 * FLUSH_PAIRS:
                held[:] = [merged()]
                if len(held[0][0]) > FLUSH_PAIRS:
                    yield out()
        if held:
            yield out()

    return base.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def pair_keys(pairs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            h = perfect_hash.number_digests(b.column("pair").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), b.column("n")], names=["first", "second", "number"])

    return pairs.mapInArrow(run, "first long, second long, number long")


def fragments(base: DataFrame, index: perfect_hash.Index, pairs: perfect_hash.Index, buckets: int, pivot_rows: int = PIVOT_ROWS) -> DataFrame:
    """All fragments in blocks by the buckets of their pivots, equal ones of a stretch of texts as one."""

    def run(batches):
        for reader, number, rank in stretches(batches, index):
            at, pair = pairs_of(number)
            distinct, inverse = np.unique(pair, return_inverse=True)
            _, pair_n = pairs.look_up(perfect_hash.number_digests(distinct))
            linked = np.zeros(len(number), bool)
            linked[at] = (pair_n > 0)[inverse]
            f = fragments_of(number, rank, linked)
            rows, n = added_up(f, np.ones(len(f), np.int64))
            hot = reader.counts_of(rows[:, REACH]) > pivot_rows if len(rows) else np.empty(0, bool)
            ended = rows.copy()
            ended[:, REACH + 1 :] = -1
            right, left = hot & (rows[:, REACH + 1] >= 0), hot & (rows[:, REACH - 1] >= 0)
            for own, times, by, mode in ((rows[~hot], n[~hot], None, 0), (rows[right], n[right], REACH, RIGHT_ONLY), (*added_up(ended[left], n[left]), REACH - 1, 0)):
                if not len(own):
                    continue
                route, shared = [own[:, REACH]], np.zeros(len(own), bool)
                if by is not None:
                    parts = -(-pair_n[np.searchsorted(distinct, own[:, by].astype(np.int64) << 32 | own[:, by + 1])] // pivot_rows)
                    shared = parts > 1
                    route += [own[:, 2 * by - REACH + 1], np.full(len(own), by), (_mixed(own) % parts.astype(np.uint64)).astype(np.int64)]
                yield packed((_mixed(np.column_stack(route)) % np.uint64(buckets)).astype(np.int64), mode + SHARED * shared, own, times)

    return base.mapInArrow(run, BLOCK)


def phrases_of(rows: np.ndarray, n: np.ndarray, right_only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The phrases that the pivots of fragments own, or only those with the pivot's right neighbour, as rows of LONGEST numbers with -1 behind the end, and their occurrences."""
    found, times = [], []
    for left in range(REACH + 1):
        for right in range(REACH + 1 - left):
            if left + right:
                own = (rows[:, REACH - left] >= 0) & (rows[:, REACH + right] >= 0)
                if right_only is not None and not right:
                    own &= ~right_only
                p = np.full((int(own.sum()), LONGEST), -1, np.int32)
                p[:, : left + right + 1] = rows[own, REACH - left : REACH + right + 1]
                found.append(p)
                times.append(n[own])
    return added_up(np.concatenate(found), np.concatenate(times))


def frequent_phrases(blocks: DataFrame, least: int = LEAST) -> DataFrame:
    """``p array<int>, a long``: the phrases of at least ``least`` occurrences, from blocks of fragments."""

    def mined(held: list[dict]):
        mode, rows, n = unpacked(held)
        shared = (mode & SHARED) > 0
        for part in (shared, ~shared):
            p, a = phrases_of(rows[part], n[part], (mode[part] & RIGHT_ONLY) > 0)
            if part is not shared:  # nobody else has occurrences of these
                p, a = p[a >= least], a[a >= least]
            some = p >= 0
            ends = np.r_[0, np.cumsum(some.sum(1))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(p[some])), pa.array(a)], names=["p", "a"])

    def run(batches):
        held, bucket = [], None
        for b in batches:
            for block in b.to_pylist():
                if held and block["bucket"] != bucket:
                    yield from mined(held)
                    held = []
                bucket = block["bucket"]
                held.append(block)
        if held:
            yield from mined(held)

    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = blocks.repartition(n, "bucket").sortWithinPartitions("bucket")
    return routed.mapInArrow(run, "p array<int>, a long").groupBy("p").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, p, phrase, a, l, r, n, score`` of each phrase, by its lowest-scoring cut; ties by the smallest first part.

    ``words``: ``word_id, lang, word, n``; ``totals``: ``lang, n``.
    """
    counts = phrases.unionByName(words.select(F.array("word_id").alias("p"), F.col("n").alias("a")))
    cuts = phrases.select("p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k")).withColumns({"first": F.slice("p", F.lit(1), F.col("k")), "rest": F.slice("p", F.col("k") + 1, F.size("p"))})
    cuts = cuts.join(counts.select(F.col("p").alias("first"), F.col("a").alias("l")), "first").join(counts.select(F.col("p").alias("rest"), F.col("a").alias("r")), "rest")
    spelt = phrases.select("p", F.posexplode("p").alias("at", "word_id")).join(words.select("word_id", "lang", "word"), "word_id").groupBy("p").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = cuts.join(spelt, "p").join(totals, "lang")
    wide = lambda c: f"cast({c} as decimal(38, 0))"
    rows = rows.withColumn("score", F.expr(f"{wide('1000')} * {wide('a')} * {wide('n')} div ({wide('l')} * {wide('r')})"))
    best = rows.groupBy("lang", "p", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "p", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def without_parts(phrases: DataFrame) -> DataFrame:
    """``p, a`` of the phrases that no longer one with as many occurrences holds."""
    spans = [(i, m) for m in range(2, LONGEST) for i in range(LONGEST - m + 1)]
    inner = F.array(*[F.when(F.size("p") >= F.lit(i + m + (i == 0)), F.slice("p", i + 1, m)) for i, m in spans])
    held = phrases.where(F.size("p") > 2).select(F.explode(F.filter(inner, lambda x: x.isNotNull())).alias("p"), F.col("a").alias("longer")).groupBy("p").agg(F.max("longer").alias("longer"))
    return phrases.join(held, "p", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).select("p", "a")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, pivot_rows: int = PIVOT_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases by falling score, then falling ``a``, then phrase in byte order."""
    base = docs.select(F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        counted = staged(count_words(base).where(F.col("word").isNull() | (F.col("n") >= least)), "words")
        totals, frequent = counted.where("word IS NULL").select("lang", "n"), counted.where("word IS NOT NULL")
        index = perfect_hash.build(keyed(frequent), "words")
        words = staged(numbered(frequent, index), "numbered")
        counted = staged(frequent_pairs(base, index, least), "pairs")
        pairs = perfect_hash.build(pair_keys(counted), "pairs")
        met = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # no word has a fragment without a frequent pair
        buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-met // bucket_rows))
        phrases = staged(frequent_phrases(fragments(base, index, pairs, buckets, pivot_rows), least), "phrases")
    left = without_parts(phrases)
    rows = scored(phrases, words, totals).join(left.select("p"), "p", "left_semi")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
