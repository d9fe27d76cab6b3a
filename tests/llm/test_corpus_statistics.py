"""Line dedup, whitening, collocations and the perfect hash: awkward rows, brute force and SQL."""

import hashlib
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations, line_dedup, perfect_hash, whitening
from tessera.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    ours, theirs = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    rows = lambda x: sorted(map(tuple, x[sorted(x.columns)].astype(str).values.tolist()))
    assert rows(ours) == rows(theirs) and len(ours)


@pytest.mark.parametrize("n", [0, 1, 63, 5000])
def test_perfect_hash_numbers_keys_without_gaps(n):
    keys = perfect_hash.digests([f"k{i}" for i in range(n)])
    assert sorted(perfect_hash.PerfectHash.of(keys).slots(keys).tolist()) == list(range(n))
    shard = perfect_hash.Shard.of(keys, np.arange(n) * 3)
    at, numbers = shard.look_up(keys)
    assert sorted(at.tolist()) == list(range(n)) and numbers.tolist() == [3 * i for i in range(n)]
    others = perfect_hash.digests([f"x{i}" for i in range(2000)])
    assert (shard.look_up(others)[0] == -1).all() and not shard.look_up(others)[1].any()
    assert (keys == perfect_hash.digests([f"k{i}" for i in range(n)])).all()


def test_perfect_hash_refuses_repeated_keys():
    with pytest.raises(ValueError):
        perfect_hash.PerfectHash.of(perfect_hash.digests(["a", "a"]))


def test_index_of_many_shards_under_a_small_cache(spark, monkeypatch):
    monkeypatch.setattr(perfect_hash, "CACHE_BYTES", 1)
    words = [f"w{i}" for i in range(3000)]
    keys = perfect_hash.digests(words)
    frame = spark.createDataFrame([(int(a), int(b), i) for i, (a, b) in enumerate(keys)], "first long, second long, number long").repartition(3)
    index = perfect_hash.build(frame, "test", shard_keys=50)
    slots, numbers = index.look_up(perfect_hash.digests([*words, "absent"]))
    assert len(index.before) == 61 and index.size == 3000 and sorted(slots.tolist()) == list(range(-1, 3000)) and numbers.tolist() == [*range(3000), 0]
    none = perfect_hash.build(frame.where("false"), "test")
    assert none.size == 0 and none.look_up(keys[:2])[0].tolist() == [-1, -1]


LINES = [
    (1, "Hot Line\nown a\n\nHOT line\t"), (2, " hot line\r\nown b"), (3, None), (4, ""), (5, "\n"), (6, "hot line"), (6, "hot line"), (None, "x\nhot line\nx"), (7, "É\né\n\x0b\x0chot line "), (8, "x\nx\nx"), (9, "É\n " + "long line " * 20_000 + "\nhot line"),
]


def brute_lines(rows, least):
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < least]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("least,indexed_from", [(2, None), (5, None), (5, 2), (100, None)])
def test_line_dedup(spark, least, indexed_from):
    odd = spark.createDataFrame([(i, t, 7, "z") for i, t in LINES], "doc_id long, text string, n_lines long, _tessera_r string").repartition(4)
    want = brute_lines(LINES, least)
    got = line_dedup.line_dedup(odd, least=least, indexed_from=indexed_from).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got) == sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in want)
    kept = line_dedup.without_common_lines(odd, least=least)
    assert kept.columns == odd.columns and sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted((i, t) for i, _, _, t in want)
    assert {(r["n_lines"], r["_tessera_r"]) for r in kept.collect()} == {(7, "z")}
    assert line_dedup.line_dedup(odd.where("false"), least=least).count() == 0


def test_line_dedup_with_an_index_of_other_documents(spark):
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = line_dedup.common_lines(table([(i, "shared\nown" + str(i)) for i in range(12)]), least=10)
    assert index.size == 1
    assert [r["text"] for r in line_dedup.without_common_lines(table([(1, "a\nShared\nb"), (2, "own1")]), index=index).orderBy("doc_id").collect()] == ["a\nb", "own1"]


def brute_whitening(vectors, dims, components=32):
    use = [(i, v) for i, v in vectors if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in use]
    n, S = len(x), [sum(col) for col in zip(*x)]
    centred = [[Fraction(a) - Fraction(s, n) for a, s in zip(row, S)] for row in x]
    V = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(dims)] for i in range(dims)])
    dev = [sum((n * a - s) ** 2 for a, s in zip(row, S)) for row in x]
    e, u = np.linalg.eigh(V)
    order = np.argsort(-e)[:components]
    return use, dev, e[order], np.array([[float(c) for c in r] for r in centred]) @ u[:, order] / np.sqrt(e[order]), e[order] / np.trace(V)


def test_whitening_equals_brute_force(spark):
    r = np.random.default_rng(3)
    vectors = [(i, (r.standard_normal(6) * [1, 2, 3, 4, 5, 6]).astype(np.float32).tolist()) for i in range(40)]
    vectors += [(3, vectors[3][1]), (None, vectors[4][1]), (50, None), (51, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (52, [float("nan")] * 6), (53, [1.0, 2.0, 3.0, float("inf"), 1.0, 1.0]), (54, []), (55, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, "c") for i, v in vectors], "vec_id long, embedding array<float>, component string").repartition(7)
    use, dev, e, white, share = brute_whitening(vectors, 6)
    got = whitening.whitening(frame).toPandas()
    assert len(got) == 6 * len(use) and set(got.n) == {len(use)} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-12
    for k in range(6):
        own = got[got.component == k + 1]
        a = sorted(zip(own.vec_id.fillna(-1), own.deviation, own.whitened))
        b = sorted((-1 if i is None else i, d, w) for (i, _), d, w in zip(use, dev, white[:, k]))
        assert [x[:2] for x in a] == [x[:2] for x in b] and np.allclose(own.explained, share[k], rtol=1e-12)
        s = [x[2] for x in sorted(zip(own.vec_id.fillna(-1), own.deviation, own.whitened))]
        w = [x[2] for x in b]
        assert np.allclose(s, w, rtol=1e-8, atol=1e-9) or np.allclose(s, [-x for x in w], rtol=1e-8, atol=1e-9)


def test_whitening_of_few_flat_and_huge_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whitening(frame([])).count() == 0 and whitening.whitening(frame([(1, None), (2, [])])).count() == 0
    one = whitening.whitening(frame([(1, [0.5, 1.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 2
    flat = whitening.whitening(frame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)])).orderBy("component").collect()
    assert [r["whitened"] is None for r in flat] == [False] * 5 + [True] * 10 and abs(flat[0]["identity_error"]) < 1e-12 and flat[0]["explained"] == pytest.approx(1)
    huge = whitening.whitening(frame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 3.0])])).collect()
    assert len(huge) == 6 and {r["deviation"] for r in huge if r["vec_id"] == 1} == {None}


def test_moments_do_not_lose_digits_by_the_mean():
    r = np.random.default_rng(5)
    x = r.integers(0, 3, (1000, 4)) + (1 << 50)
    whole = whitening.Moments.of_integers(x)
    parts = whitening.Moments.of_integers(x[:1])
    for a, b in ((1, 10), (10, 500), (500, 1000)):
        parts = parts.merged(whitening.Moments.of_integers(x[a:b]))
    assert parts.total == whole.total and np.allclose(parts.scatter, whole.scatter, rtol=1e-13) and np.allclose(whole.covariance(), np.cov((x - (1 << 50)).T, bias=True), rtol=1e-12)


def brute_collocations(rows, least, top):
    f, n = {}, Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", low(text)):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang or "und"] += len(w)
            for s in range(1, 6):
                for i in range(len(w) - s + 1):
                    f.setdefault(lang or "und", Counter())[tuple(w[i : i + s])] += 1
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        best = []
        for p, a in found.items():
            if any(b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("pivot_rows,bucket_rows,top", [(50_000, 200_000, 2000), (7, 50, 2000), (1, 1, 3)])
def test_collocations_equal_brute_force(spark, monkeypatch, pivot_rows, bucket_rows, top):
    monkeypatch.setattr(collocations, "FLUSH_PAIRS", bucket_rows)
    r = np.random.default_rng(11)
    words = ["the", "of", "Of", "a", "b", "c", "É", "é", "d#", "e", "zz"]
    rows = [(("en", "de", None)[int(r.integers(3))], " ".join(words[min(int(r.exponential(3)), 10)] + ("", "", "", ".", "\n", ",\t")[int(r.integers(6))] for _ in range(int(r.integers(0, 40))))) for _ in range(150)]
    rows += [("en", None), ("en", ""), ("fr", "one"), ("en", "New York City hall\tagain"), *[("en", "new york  city hall")] * 12, ("de", "the " * 3000), (None, ".,;"), ("und", "the of")]
    frame = spark.createDataFrame([(lang, t, "x") for lang, t in rows], "lang string, text string, phrase string").repartition(5)
    got = collocations.collocations(frame, least=10, top=top, pivot_rows=pivot_rows, bucket_rows=bucket_rows).collect()
    assert sorted(map(tuple, got)) == brute_collocations(rows, 10, top)
    assert collocations.collocations(frame.where("false")).count() == 0


def test_fragments_cover_each_occurrence_once():
    number = np.array([3, 1, 2, 1, -1, 2, 2, 2, 1, 3])
    rank = np.where(number < 0, -1, 5 - number)  # 3 is rarest
    rows = collocations.fragments_of(number, rank)
    p, n = collocations.phrases_of(rows, np.ones(len(rows), np.int64))
    got = {tuple(x for x in row if x >= 0): int(k) for row, k in zip(p.tolist(), n.tolist())}
    want = Counter(tuple(number[i : i + s].tolist()) for s in range(2, 6) for i in range(len(number) - s + 1) if (number[i : i + s] >= 0).all())
    assert got == dict(want)
    linked = np.array([True, True, False, True, False, True, True, False, True, False])
    p, n = collocations.phrases_of(cut := collocations.fragments_of(number, rank, linked), np.ones(len(cut), np.int64))
    got = {tuple(x for x in row if x >= 0): int(k) for row, k in zip(p.tolist(), n.tolist())}
    assert got == dict(Counter(tuple(number[i : i + s].tolist()) for s in range(2, 6) for i in range(len(number) - s + 1) if (number[i : i + s] >= 0).all() and linked[i : i + s - 1].all()))
    bucket, mode, times = np.arange(len(rows)) % 3, np.arange(len(rows)) % 4, np.arange(len(rows)) * 10
    blocks = collocations.packed(bucket, mode, rows, times).to_pylist()
    assert [b["bucket"] for b in blocks] == [0, 1, 2]
    order = np.argsort(bucket, kind="stable")
    for got, want in zip(collocations.unpacked(blocks), (mode[order], rows[order], times[order])):
        assert (got == want).all()
    assert not collocations.packed(bucket[:0], mode[:0], rows[:0], times[:0]).num_rows


def test_long_texts_of_lines_and_phrases(spark):
    text = "common words here. " * 40_000 + "\n" + "x" * 2_000_000
    frame = spark.createDataFrame([(1, "en", text), (2, "en", text)], "doc_id long, lang string, text string")
    got = {r["phrase"]: r["a"] for r in collocations.collocations(frame).collect()}
    assert got == {"common words here": 80_000}
    assert line_dedup.line_dedup(frame, least=2).agg(F.sum("n_dropped")).first()[0] == 4
