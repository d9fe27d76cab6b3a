"""Quality classifier by importance resampling.

Two generative models of hashed word and word-pair counts are fitted, one to
target text (labelled good and not toxic) and one to all raw text. A document's
weight is the mean log-ratio of target to raw probability over its n-grams, drawn
towards 0 where they are few, times ``SHARPNESS``; adding Gumbel noise and keeping the top ``k`` samples documents
without replacement in proportion to their weights. ``k`` is the number of
documents whose mean log-ratio passes the cutoff that best separates held-out
labelled documents, so it follows the corpus.

The counts have ``2 * 2**BUCKET_BITS`` entries, however large the corpus, and
come from every text of the table, each counted once however many rows repeat it:
rows are brought together by digest first, so neither hot texts nor the way rows
fall into tasks change the models. Labels are the one sampled input: of the labelled rows
at most ``MAX_LABELS``, those of lowest hash, are used; half of them fit the
target model and half choose the cutoff. The ``k``-th key is found exactly by two
rounds of histograms, not by a global sort.

A text without words has log-ratio 0; one of any length is scored whole. Null labels count as absent, and may be
boolean. Ids may be strings, on either side. Rows that tie
with the ``k``-th are all kept; repeated rows share their noise and so their fate;
an empty table gives an empty frame. Without labels of both kinds nothing is
rejected. Further columns pass through ``keep_sampled`` untouched.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import OWN, quoted, shielded, small_batches, staged, text_of, texts, unshielded

BUCKET_BITS = 16
SMOOTHING = 0.5
SHARPNESS = 400.0
#: N-grams of ratio 1 that every text is taken to have besides its own: short texts say little.
PRIOR_NGRAMS = 64
MAX_LABELS = 20_000
SEED = 7
#: What losing a held-out good document weighs against keeping a bad one.
GOOD_WEIGHT = 20.0
SCORE, KEY = OWN + "score", OWN + "key"
_FINE = 1 << 16


def buckets(text: str, bits: int = BUCKET_BITS) -> np.ndarray:
    """Hash buckets of the words, then, ``2**bits`` further, of the pairs of neighbouring words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8").lower().split()
    h = np.fromiter(map(xxh64_intdigest, words, repeat(0)), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    shift = np.uint64(64 - bits)
    return np.concatenate([(h >> shift).astype(np.int64), (pairs >> shift).astype(np.int64) + (1 << bits)])


class RatioModel:
    """Log-ratio of target to raw probability for each bucket."""

    def __init__(self, raw: np.ndarray, target: np.ndarray, bits: int = BUCKET_BITS):
        self.bits = bits
        self.log_ratio = np.concatenate([self._logs(target[s]) - self._logs(raw[s]) for s in (slice(0, 1 << bits), slice(1 << bits, None))])
        self.cutoff = -np.inf

    @staticmethod
    def _logs(counts: np.ndarray) -> np.ndarray:
        return np.log(counts + SMOOTHING) - np.log(counts.sum() + SMOOTHING * len(counts))

    def score(self, text: str) -> float:
        b = buckets(text, self.bits)
        return float(self.log_ratio[b].sum()) / (len(b) + PRIOR_NGRAMS)

    def calibrate(self, scores: np.ndarray, good: np.ndarray) -> None:
        """Choose the cutoff on held-out documents; between two scores it lies half-way."""
        if not good.any() or good.all():
            return
        order = np.argsort(scores, kind="stable")
        s, g = scores[order], good[order]
        lost = np.r_[0, np.cumsum(g)] / g.sum()
        caught = np.r_[0, np.cumsum(~g)] / (~g).sum()
        worth = caught - GOOD_WEIGHT * lost
        worth[1:-1][s[1:] == s[:-1]] = -np.inf
        i = int(np.argmax(worth))
        self.cutoff = -np.inf if i == 0 else float(s[i - 1] + 1e-9) if i == len(s) else float((s[i - 1] + s[i]) / 2)


def same_id(docs: DataFrame, labelled: DataFrame):
    """``doc_id`` equals ``labelled``; where one alone is a string, it is read as the other's type, if it can be."""
    pair = [(F.col("doc_id"), docs.schema["doc_id"].dataType), (F.col("labelled"), labelled.schema["labelled"].dataType)]
    kinds = [kind for _, kind in pair if not isinstance(kind, T.StringType)]
    a, b = (col.try_cast(kinds[0]) if len(kinds) == 1 and isinstance(kind, T.StringType) else col for col, kind in pair)
    return a == b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labels: int = MAX_LABELS) -> RatioModel:
    """Fit to all distinct texts and a bounded number of labelled ones."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    number = F.col("doc_id").try_cast("long")
    mix = F.when(number.isNotNull(), F.xxhash64(number, F.lit(SEED))).otherwise(F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED)))
    labels = labels.withColumns({c: F.col(c).cast("int") for c in ("quality", "toxic") if isinstance(labels.schema[c].dataType, T.BooleanType)})
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    sample = rows.select(F.col("doc_id").alias("labelled"), F.when(F.pmod(mix, 2) == 1, F.when(good, 1)).otherwise(F.when(good, 2).when(F.col("quality") == 0, 3)).alias("role"), mix.alias("mix")).orderBy("mix", "labelled").limit(max_labels).drop("mix")
    sample = staged(sample, "labels")
    text = text_of(text_col)
    base = docs.select(F.col(quoted(id_col)).alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))
    rows = base.join(F.broadcast(sample), same_id(base, sample), "left").select("text", "digest", "role")  # broadcast: at most max_labels rows
    # a text that many rows repeat is one row a task before it is shuffled, and one in all when it is counted
    distinct = rows.groupBy("digest").agg(F.first("text").alias("text"), F.max(F.coalesce(F.col("role") == 1, F.lit(False))).alias("target")).select("text", "target")

    def count(batches):
        raw, target = np.zeros(2 << BUCKET_BITS, np.int64), np.zeros(2 << BUCKET_BITS, np.int64)
        for b in batches:
            found = [buckets(x) for x in texts(b.column("text"))]
            raw += np.bincount(np.concatenate(found), minlength=len(raw)) if found else 0
            if own := [x for x, t in zip(found, b.column("target").to_pylist()) if t]:
                target += np.bincount(np.concatenate(own), minlength=len(target))
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])

    with small_batches(docs.sparkSession):
        got = distinct.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # one row per bucket
    raw, target = np.zeros(2 << BUCKET_BITS), np.zeros(2 << BUCKET_BITS)
    at = got.column("bucket").to_numpy()
    raw[at], target[at] = got.column("raw").to_numpy(), got.column("target").to_numpy()
    model = RatioModel(raw, target)

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([model.score(x) for x in texts(b.column("text"))], pa.float64()), b.column("role")], names=["digest", "score", "role"])

    held = rows.where("role IS NOT NULL").mapInArrow(score, "digest binary, score double, role int").groupBy("digest").agg(F.min("role").alias("role"), F.first("score").alias("score")).where("role > 1").orderBy("digest").toArrow()  # at most max_labels ids; no text of the target among them
    model.calibrate(held.column("score").to_numpy(), held.column("role").to_numpy() == 2)
    return model


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The ``k``-th largest of the column KEY (long), exactly, by histograms of 16 bits each."""
    coarse = sorted(keys.groupBy(F.shiftright(KEY, 16).alias("b")).agg(F.count("*").alias("n")).collect(), reverse=True)
    for b, n in coarse:
        if k <= n:
            fine = sorted(keys.where(F.shiftright(KEY, 16) == b).groupBy(KEY).agg(F.count("*").alias("n")).collect(), reverse=True)
            for value, m in fine:
                if k <= m:
                    return value
                k -= m
        k -= n
    return None


def resampled(docs: DataFrame, model: RatioModel, id_col: str, text_col: str, keep_text: bool = True) -> tuple[DataFrame, int]:
    """The rows with mean log-ratio and perturbed key in own columns, staged, and the key from which rows are kept."""
    top = 2.0**14

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        return pd.Series([model.score(x) for x in text], dtype="float64")

    rows = docs.withColumn(SCORE, score(text_of(text_col)))
    rows = staged(rows if keep_text else rows.drop(text_col), "scores")
    # noise from the id alone: a lost task that runs again draws the same
    uniform = (F.pmod(F.xxhash64(F.col(quoted(id_col)).cast("string"), F.lit(SEED)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    key = F.col(SCORE) * SHARPNESS - F.log(-F.log(uniform))
    rows = rows.withColumn(KEY, F.round(F.greatest(F.lit(-top), F.least(F.lit(top), key)) * _FINE).cast("long"))
    k = rows.where(F.col(SCORE) >= float(max(model.cutoff, -1e300))).count()
    found = kth_largest(rows.select(KEY), k) if k else None
    return rows, found if found is not None else 1 << 62


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, log_ratio, sample_key, kept`` for each row."""
    model = fit(docs, labels, id_col, text_col)
    rows, least = resampled(docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text")), model, "doc_id", "text", keep_text=False)
    return rows.select("doc_id", F.col(SCORE).alias("log_ratio"), (F.col(KEY) / _FINE).alias("sample_key"), (F.col(KEY) >= least).alias("kept"))


def keep_sampled(docs: DataFrame, model: RatioModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are sampled, with the columns they came with."""
    docs, now = shielded(docs)
    rows, least = resampled(docs, model, now[id_col], now[text_col])
    return rows.where(F.col(KEY) >= least).select(*unshielded(now))
