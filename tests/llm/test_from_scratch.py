"""The classifier and the pipeline's stages recounted from their definitions, without the code under test."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm import common, importance
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BITS = 16


def ngrams(text):
    """Bucket numbers of words and pairs of words, one by one."""
    out, before = [], None
    for w in (text or "").encode().lower().split():
        h = xxh64_intdigest(w, 0)
        out.append(h >> (64 - BITS))
        if before is not None:
            mixed = ((before * 0x9E3779B97F4A7C15 + h) * 0xC2B2AE3D27D4EB4F) % (1 << 64)
            out.append((mixed >> (64 - BITS)) + (1 << BITS))
        before = h
    return out


def recount(spark, docs, labels):
    """(scores by id, cutoff) by counting every distinct text once."""
    told = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["quality"] is not None:
            q, t = told.get(r["doc_id"], (9, 0))
            told[r["doc_id"]] = min(q, r["quality"]), max(t, r["toxic"] or 0)
    ids = spark.createDataFrame([(i,) for i in told], "doc_id long").select("doc_id", F.xxhash64("doc_id", F.lit(7)).alias("mix")).collect()
    role = {}
    for r in ids:
        q, t = told[r["doc_id"]]
        good = q == 1 and t == 0
        if r["mix"] % 2 == 1:
            role[r["doc_id"]] = "fit" if good else None
        else:
            role[r["doc_id"]] = "good" if good else "bad" if q == 0 else None
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["text"] or "", []).append(r["doc_id"])
    raw, target = Counter(), Counter()
    for text, own in texts.items():
        n = Counter(ngrams(text))
        raw.update(n)
        if any(role.get(i) == "fit" for i in own):
            target.update(n)
    total = {name: [sum(v for k, v in c.items() if (k >> BITS) == side) for side in (0, 1)] for name, c in (("raw", raw), ("target", target))}
    half = 1 << BITS

    def ratio(b):
        side = b >> BITS
        return np.log((target[b] + 0.5) / (total["target"][side] + 0.5 * half)) - np.log((raw[b] + 0.5) / (total["raw"][side] + 0.5 * half))

    known = {}
    score = {text: sum(known.setdefault(b, ratio(b)) for b in g) / (len(g) + 64) for text in texts for g in [ngrams(text)]}
    held = []
    for text, own in texts.items():
        roles = [role[i] for i in own if role.get(i)]
        if roles and "fit" not in roles:
            held.append((score[text], "good" in roles))
    held.sort()
    good, bad = sum(g for _, g in held), sum(not g for _, g in held)
    best, cutoff = 0.0, -np.inf
    for i in range(1, len(held) + 1):
        if i < len(held) and held[i][0] == held[i - 1][0]:
            continue
        worth = sum(not g for _, g in held[:i]) / max(bad, 1) - 20 * sum(g for _, g in held[:i]) / max(good, 1)
        if worth > best + 1e-12:
            best, cutoff = worth, held[i - 1][0] + 1e-9 if i == len(held) else (held[i - 1][0] + held[i][0]) / 2
    return {i: score[text] for text, own in texts.items() for i in own}, cutoff if good and bad else -np.inf


def test_classifier_recounted(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scores, cutoff = recount(spark, docs, labels)
    assert np.isfinite(cutoff)  # labels of both kinds are held out
    model = importance.fit(docs, labels)
    assert model.cutoff == pytest.approx(cutoff, abs=1e-9)
    got = QUERIES["op7_importance_resampling"](spark, SF).collect()
    assert all(r["log_ratio"] == pytest.approx(scores[r["doc_id"]], abs=1e-9) for r in got)
    # the noise comes from the id alone; the k largest keys stay, k the number of scores that reach the cutoff
    noise = {r["doc_id"]: r["u"] for r in docs.select("doc_id", ((F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(1 << 40)) + 0.5) / float(1 << 40)).alias("u")).collect()}
    keys = {i: round(min(max(400 * s - np.log(-np.log(noise[i])), -(2.0**14)), 2.0**14) * (1 << 16)) for i, s in scores.items()}
    k = sum(s >= cutoff for s in scores.values())
    least = sorted(keys.values(), reverse=True)[k - 1]
    for r in got:
        assert r["sample_key"] * (1 << 16) == pytest.approx(keys[r["doc_id"]], abs=2)
        if abs(keys[r["doc_id"]] - least) > 2:
            assert r["kept"] == (keys[r["doc_id"]] >= least)


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def simhash(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low(text)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(items, linked):
    """For each item the least index it is connected with."""
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def shingled(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({b" ".join(words)} if words else set())


def alike(a, b):
    return bool(a and b) and len(a & b) >= 0.8 * len(a | b)


def test_each_stage_of_the_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    # near copies of some documents: another word in twenty, and a changed end
    planted = {}
    for n, (i, text) in enumerate(sorted((i, t) for i, t in rows.items() if t and 150 < len(t.split()) < 500)[:12]):
        w = text.split(" ")
        planted[10_000 + n] = " ".join([*w[: len(w) // 2], "otherword", *w[len(w) // 2 + 1 :]])
        planted[20_000 + n] = " ".join(w[: -max(2, len(w) // 40)])
    more = spark.createDataFrame([(i, t) for i, t in planted.items()], "doc_id long, text string")
    source = common.staged(docs.unionByName(more, allowMissingColumns=True), "source")
    rows |= planted

    kept = {}
    frame = source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = common.staged(stage(spark, frame, SF), "stage")
        kept[name] = {r["doc_id"] for r in frame.collect()}
    # rules: the query's verdict, itself tested against definitions, on the same rows
    from tessera.llm.quality_rules import quality_rules

    assert kept["quality rules"] == {r["doc_id"] for r in quality_rules(source).where("kept").collect()}
    # classifier: models of the whole table, applied to what the rules left
    scores, cutoff = recount(spark, docs, spark.read.parquet(f"{SF}/labels.parquet"))
    sure = {i for i in kept["quality rules"] if i in scores and abs(scores[i] - cutoff) > 0.04}
    assert len(sure) > 0.7 * len(kept["quality rules"] & set(scores))
    assert {i for i in sure if i in kept["quality classifier"]} == {i for i in sure if scores[i] > cutoff}
    # exact: the largest id of each text
    largest = {}
    for i in sorted(kept["quality classifier"]):
        largest[low(rows[i])] = i
    assert kept["exact dedup"] == set(largest.values())
    # near: the least id of each component by fingerprints, then of each by shingles
    ids = sorted(kept["exact dedup"])
    fps = [simhash(rows[i]) for i in ids]
    left = [i for i, c in zip(ids, classes(fps, lambda a, b: (a ^ b).bit_count() <= 3)) if ids[c] == i]
    sets = [shingled(rows[i]) for i in left]
    want = [i for i, c in zip(left, classes(sets, alike)) if left[c] == i]
    assert kept["near-duplicates"] == set(want)
    assert len(ids) - len(want) >= 8  # the planted copies that came so far went
    # packing: each document's ids in order, gapless, in as few sequences as the sum allows or one more
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()
    assert {r["doc_id"] for r in packed} == kept["near-duplicates"]
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 2048
    assert len(by_sequence) <= -(-sum(r["length"] for r in packed) // 2048) + 1
