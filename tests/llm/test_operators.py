"""The operators on Spark: awkward rows, brute force, and the contracts of the registered queries."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, components, exact_dedup, huffman, importance, masked_lm, packing, quality_rules, sharding, similarity, simhash, token_count, words
from tessera.llm import common
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000 + "end"
ROWS = [(1, "Hello World one two three"), (2, "hello world ONE two three"), (3, None), (4, ""), (5, "É hello"), (6, "é hello"), (7, LONG), (7, LONG), (None, "hello world one two three"), (8, " \n\t "), (9, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long, tied and repeated rows, and columns whose names the operators use."""
    rows = [(i, t, "c", i, True, i) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_tokens long, length boolean, `sequence.id` long").repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_exact_dedup(spark, odd, empty):
    got = exact_dedup.exact_dedup(odd).collect()
    best, size = {}, {}
    for i, t in ROWS:
        best[low(t)] = max(best.get(low(t), -1), i or -1)
        size[low(t)] = size.get(low(t), 0) + 1
    want = sorted((str(i), best[low(t)], size[low(t)], hashlib.sha256(low(t).encode()).hexdigest()) for i, t in ROWS)
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(best)
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.keep_unique(odd)
    assert kept.columns == odd.columns and kept.count() == len(best)


def test_exact_dedup_with_colliding_digests_and_many_batches(spark, odd):
    weak = exact_dedup.exact_dedup(odd, digest=lambda x: F.lit("same"), files_at_once=1)
    strong = exact_dedup.exact_dedup(odd)
    assert sorted(map(str, weak.collect())) == sorted(map(str, strong.collect()))


def test_exact_dedup_goes_on_from_a_kept_state(spark, tmp_path):
    folder = f"file://{tmp_path}/kept"
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert exact_dedup.keep_unique(table([(1, "A b"), (2, "x"), (3, "x")]), folder=folder).count() == 2
    got = exact_dedup.exact_dedup(table([(9, "a B"), (4, "new")]), folder=folder).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == [(1, 9, 2, False), (2, 3, 2, False), (3, 3, 2, True), (4, 4, 1, True), (9, 9, 2, True)]


def test_columns_that_look_like_internal_ones_come_back_as_they_were(spark):
    rows = spark.createDataFrame([(1, "one " * 30, "a", "b"), (2, "two " * 3, "c", "d")], "doc_id long, text string, _tessera_id string, _TESSERA_locator string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = importance.fit(rows, labels)
    for got in (exact_dedup.keep_unique(rows), simhash.keep_one_each(rows), importance.keep_sampled(rows, model)):
        assert got.columns == rows.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    assert quality_rules.keep_sound(rows).columns == rows.columns


def test_session_settings_come_back(spark):
    before = {k: spark.conf.get(k, None) for k in [*exact_dedup.STATE_SETTINGS, "spark.sql.execution.arrow.maxRecordsPerBatch"]}
    exact_dedup.exact_dedup(spark.createDataFrame([(1, "x")], "doc_id long, text string")).count()
    assert before == {k: spark.conf.get(k, None) for k in before}


def test_packing(spark, odd, empty):
    e = words.encoder(words.default_path())
    got = packing.pack(odd).collect()
    assert sum(r["length"] for r in got) == sum(len(e.ids(x)) + 1 for x in e.encode_many([t or "" for _, t in ROWS]))
    for s in {r["sequence_id"] for r in got}:
        own = sorted((r["offset"], r["length"]) for r in got if r["sequence_id"] == s)
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    assert packing.pack(empty).count() == 0
    whole = [np.frombuffer(r["ids"], "<u4") for r in sorted((r for r in got if r["doc_id"] == 5), key=lambda r: r["piece"])]
    assert np.concatenate(whole).tolist() == e.full.encode("É hello", add_special_tokens=False).ids + [0]


def test_packing_query(spark):
    got = QUERIES["op2_best_fit_packing"](spark, SF).toPandas()
    e = words.encoder(words.default_path())
    for i, text in [(r["doc_id"], r["text"]) for r in docs(spark).collect()][:60]:
        ids = np.array(e.full.encode(text, add_special_tokens=False).ids + [0], "<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(own.start, own.length, own.ids_crc32))
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


def brute_components(fps, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return [least[find(i)] for i in range(len(fps))]


@pytest.mark.parametrize("hot_homes", [4000, 0])
def test_links_span_every_component(spark, hot_homes):
    r = np.random.default_rng(0)
    fps = []
    for base in r.integers(0, 2**63, 25, dtype=np.uint64):
        fps.append(int(base))
        for _ in range(12):  # chains: each within three bits of some other
            x = fps[-1 - int(r.integers(0, min(len(fps), 3)))]
            for b in r.choice(64, int(r.integers(0, 5)), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(distinct, hot_homes=hot_homes)).collect()}
    assert [roots.get(x, x) for x in signed] == brute_components(fps, signed)


def test_near_duplicates(spark, odd, empty):
    got = simhash.near_duplicates(odd).collect()
    fps = [simhash.fingerprint(t or "") & (2**64 - 1) for _, t in ROWS]
    want = brute_components(fps, [10**9 if i is None else i for i, _ in ROWS])
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == sorted((str(i), f"{f:016x}", c) for (i, _), f, c in zip(ROWS, fps, want))
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one_each(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(want))


def test_near_stage_finds_alike_texts_beyond_three_bits(spark):
    words_ = [f"w{i}" for i in range(400)]
    near = [" ".join(w if i % 97 != 50 else f"x{k}{i}" for i, w in enumerate(words_)) for k in range(2)]
    far = " ".join(w if i % 9 else f"y{i}" for i, w in enumerate(words_))
    fps = [np.uint64(simhash.fingerprint(x) & (2**64 - 1)) for x in [*near, far]]
    assert np.bitwise_count(fps[0] ^ fps[1]) > 3 and similarity.alike(*map(similarity.shingles, near)) and not similarity.alike(similarity.shingles(near[0]), similarity.shingles(far))
    got = simhash.keep_one_each(spark.createDataFrame([(5, near[0]), (3, near[1]), (4, far), (6, "other words " * 9), (7, None)], "doc_id long, text string"))
    assert got.columns == ["doc_id", "text"] and sorted(r["doc_id"] for r in got.collect()) == [3, 4, 6, 7]


def test_hot_bands_taken_apart_lose_no_link(spark):
    r = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(90):  # near copies of one text, of its near copies, and others that share a part
        w = list(base)
        for i in r.choice(24, int(r.integers(0, 9)), replace=False):
            w[5 * int(i)] = f"x{int(r.integers(0, 6))}y{int(i)}"
        texts.append(" ".join(w if k % 5 else w[: 40 + k]))
    rows = spark.createDataFrame(list(enumerate(texts)), "loc long, text string").withColumn("bands", F.array(F.lit(7).cast("long"), F.lit(8).cast("long"))).repartition(3)
    sets = [similarity.shingles(x) for x in texts]
    edges = [(i, j) for i in range(90) for j in range(i) if similarity.alike(sets[i], sets[j])]

    def parts(pairs):
        root = list(range(90))

        def find(x):
            return x if root[x] == x else find(root[x])

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(x) for x in range(90)]

    whole = parts(edges)
    assert len(set(whole)) > 2
    for hot_rows in (1000, 89, 20, 8):
        got = [(e["a"], e["b"]) for e in similarity.links(rows, "loc", "bands", "text", hot_rows=hot_rows).collect()]
        assert all(similarity.alike(sets[a], sets[b]) for a, b in got) and parts(got) == whole


def test_token_output(spark, odd, empty, tmp_path):
    e = words.encoder(words.default_path())
    out = huffman.write_tokens(odd, f"file://{tmp_path}/t", parts=3, block_ids=50)
    got = huffman.read_tokens(spark, out).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9]
    text = dict(ROWS)
    at = 0
    for r in got:
        ids = e.full.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        assert (r["ids"], r["start"], r["n_tokens"], r["ids_crc32"]) == (ids, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert huffman.round_trip(empty).count() == 0


def test_byte_bpe(spark, odd, empty):
    got = bpe.encode_decode(odd).collect()
    assert sorted(bytes(r["decoded"]).decode() for r in got) == sorted(t or "" for _, t in ROWS)
    digests = {r["doc_id"]: r for r in bpe.encode_decode(odd, digests=True).collect()}
    c = bpe.codec(bpe.default_path())
    assert digests[5]["ids_sha256"] == hashlib.sha256(",".join(map(str, c.encode("É hello"))).encode()).hexdigest() and digests[3]["n_tokens"] == 0
    assert bpe.encode_decode(empty).count() == 0


def test_sharding(spark, odd, empty):
    got = sharding.shard(odd, 4).toPandas()
    assert len(got) == len(ROWS) and (got["size"].sum() == sum(len((t or "").encode()) + 1 for _, t in ROWS))
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    homes = {}
    for r in got.itertuples():
        assert homes.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    assert sharding.shard(empty).count() == 0
    whole = QUERIES["op6_sharding"](spark, SF).toPandas()
    load = whole.groupby("shard")["size"].sum()
    assert sorted(load.index) == list(range(16)) and load.max() <= max(whole.groupby(["size", "text_crc32"])["size"].sum().max(), 1.05 * load.mean())


def test_sharding_spreads_the_rest_beside_one_large_group(spark):
    rows = [(i, "the same text " * 20) for i in range(400)] + [(i, f"text {i} " * (10 + i % 23)) for i in range(400, 1200)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and sorted(load.index) == list(range(16))
    home = set(got.shard[got.doc_id < 400])
    rest = load.drop(list(home))
    assert len(home) == 1 and rest.min() > 0.97 * rest.mean() and rest.max() < 1.03 * rest.mean()
    for classes in ({100: 17}, {100: 5}, {1000: 1, 400: 3, 1: 50}, {7: 1}, {}):
        loads, used = [0] * 16, {}
        for size, k, bin_ in sharding.near_equal(classes, 16):
            loads[bin_] += size * k
            used[size] = used.get(size, 0) + k
        assert used == classes and sum(x > 0 for x in loads) == min(16, sum(classes.values()))


def test_registered_queries_equal_the_libraries(spark):
    """Every row of the smallest tables: op4 and op9 by the tokenizers library, op5 by tiktoken, op3 by brute force."""
    import public_tokenizers
    import tiktoken

    text = {r["doc_id"]: r["text"] or "" for r in docs(spark).collect()}
    full = words.encoder(words.default_path()).full
    ids = {i: full.encode(x, add_special_tokens=False).ids for i, x in text.items()}
    at, want = 0, {}
    for i in sorted(text):
        own = np.array(ids[i] + [1], "<u4")
        want[i] = (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op4_token_output"](spark, SF).collect()} == want
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op9_token_counts"](spark, SF).collect()}
    assert got == {i: (len(x.encode()), len(ids[i]), len(ids[i]) > 2048) for i, x in text.items()}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_path()), special_tokens={})
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op5_byte_bpe"](spark, SF).collect()}
    for i, x in text.items():
        e = t.encode_ordinary(x)
        assert got[i] == (len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest())
    order = sorted(text)
    fps = [simhash.fingerprint(text[i]) & (2**64 - 1) for i in order]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op3_simhash"](spark, SF).collect()}
    assert got == {i: (f"{f:016x}", c) for i, f, c in zip(order, fps, brute_components(fps, order))}


def test_token_output_refuses_ids_that_are_no_integers(spark):
    with pytest.raises(TypeError):
        huffman.round_trip(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_token_counts(spark, odd, empty):
    e = words.encoder(words.default_path())
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_count.token_counts(odd).collect())
    want = []
    for i, t in ROWS:
        n = len(e.full.encode(t or "", add_special_tokens=False).ids)
        want.append((str(i), len((t or "").encode()), n, n > 2048))
    assert got == sorted(want) and token_count.token_counts(empty).count() == 0


def test_quality_rules(spark, odd, empty):
    got = quality_rules.quality_rules(odd).collect()
    assert len(got) == len(ROWS) and all(r["base_failed"] and not r["kept"] for r in got)
    assert quality_rules.quality_rules(empty).count() == 0 and quality_rules.keep_sound(odd).columns == odd.columns
    judged = QUERIES["op10_quality_rules"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r["quality"]: r["kept"] for r in judged}
    assert share[1] > 0.97 and share[0] < 0.2


def test_quality_classifier(spark, odd, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert importance.quality_classifier(odd, labels.where("false")).where("kept").count() == len(ROWS)
    assert importance.quality_classifier(empty, labels).count() == 0
    nulls = spark.createDataFrame([(None, 1, 0), (1, None, None), (2, 1, None), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert importance.quality_classifier(odd, nulls).count() == len(ROWS)
    keys = spark.createDataFrame([(x,) for x in [5, 5, -3, 9, 1 << 20, -(1 << 30)]], f"`{importance.KEY}` long")
    ordered = sorted([5, 5, -3, 9, 1 << 20, -(1 << 30)], reverse=True)
    assert [importance.kth_largest(keys, k) for k in range(1, 7)] == ordered
    judged = QUERIES["op7_importance_resampling"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r["quality"]: r["kept"] for r in judged}
    assert share[1] > 0.97 and share[0] < 0.2


def test_importance_models_do_not_depend_on_partitions_or_copies(spark):
    source = docs(spark)
    copies = source.union(source.limit(5).crossJoin(spark.range(40)).drop("id"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    one, many, plain = importance.fit(copies.repartition(1), labels), importance.fit(copies.repartition(16), labels), importance.fit(source, labels)
    assert np.array_equal(one.log_ratio, many.log_ratio) and one.cutoff == many.cutoff
    assert np.array_equal(one.log_ratio, plain.log_ratio) and one.cutoff == plain.cutoff


def test_classifier_takes_ids_of_strings_and_boolean_labels(spark):
    source, labels = docs(spark).limit(400), spark.read.parquet(f"{SF}/labels.parquet")
    plain = importance.fit(source, labels)
    flags = labels.withColumns({"quality": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    digits = labels.withColumn("doc_id", F.col("doc_id").cast("string"))
    for other in (flags, digits):
        model = importance.fit(source, other)
        assert model.cutoff == plain.cutoff and (model.log_ratio == plain.log_ratio).all()
    named = importance.fit(*(x.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))) for x in (source, labels)))
    assert np.isfinite(named.cutoff) and (named.log_ratio != plain.log_ratio).any()  # other halves of the labels
    # one side's names are no numbers: no label is of any row
    assert importance.fit(source.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))), labels).cutoff == -np.inf


def test_importance_equals_brute_force(spark):
    source, labels = docs(spark), spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op7_importance_resampling"](spark, SF).toPandas()
    model = importance.fit(source, labels)
    text = {r["doc_id"]: r["text"] or "" for r in source.collect()}
    raw = np.zeros(2 << importance.BUCKET_BITS)
    for x in set(text.values()):
        w = x.encode().lower().split()
        for b in importance.buckets(x).tolist():
            raw[b] += 1
        assert len(importance.buckets(x)) == len(w) + max(0, len(w) - 1)
    half = 1 << importance.BUCKET_BITS
    for part in (slice(0, half), slice(half, None)):  # the raw model is what the ratio divides by: where no target text has a bucket, it alone differs
        p = np.log(raw[part] + importance.SMOOTHING) - np.log(raw[part].sum() + importance.SMOOTHING * half)
        unseen = model.log_ratio[part] + p
        assert np.isclose(unseen.min(), unseen[raw[part] == 0], atol=1e-9).all()
    scores = np.array([model.score(text[i]) for i in got.doc_id])
    assert np.allclose(scores, got.log_ratio)
    k = int((scores >= model.cutoff).sum())
    kth = np.sort(got.sample_key.to_numpy())[::-1][k - 1]
    assert (got.kept == (got.sample_key >= kth)).all() and got.kept.sum() >= k


def test_masked_lm(spark, odd, empty):
    got = {r["doc_id"]: r for r in masked_lm.lm_scores(odd).collect()}
    assert got[3]["n_words"] == 0 and got[3]["mean_log_likelihood"] is None and got[3]["log_likelihood"] == 0 and got[1]["log_likelihood"] < 0
    assert masked_lm.lm_scores(empty).count() == 0
    easy = spark.createDataFrame([(i, "red green blue cyan " * 40) for i in range(60)] + [(100, "cyan red blue green " * 40)], "doc_id long, text string")
    means = {r["doc_id"]: r["mean_log_likelihood"] for r in masked_lm.lm_scores(easy, passes=20).collect()}
    assert means[0] > means[100]


def slow_score(text, vocabulary, network):
    """The score by definition: for each word the softmax over all classes, and the word's share of its class."""
    w, words_ = network.w, text.encode().lower().split()
    cls, within = vocabulary.look_up(masked_lm.keys_of(words_))
    total = float(within.sum(dtype=np.float64))
    for i in range(len(words_)):
        x = w["bias"].astype(np.float64)
        for p, k in enumerate((-2, -1, 1, 2)):
            x = x + w["embed"][p][cls[i + k] if 0 <= i + k < len(words_) else masked_lm.EDGE]
        h = x / (1 + abs(x))
        high = np.exp(h @ w["high"] + w["high_bias"])
        p = np.zeros(masked_lm.CLASSES)
        for g in range(32):
            low = np.exp((h * w["group"][g]) @ w["low"] + w["low_bias"][g])
            p[32 * g : 32 * g + 32] = high[g] / high.sum() * low / low.sum()
        assert abs(p.sum() - 1) < 1e-6
        total += np.log(p[cls[i]])
    return total


def test_masked_lm_scores_equal_the_definition(spark):
    source = docs(spark).limit(60)
    vocabulary, network, data, unlisted = masked_lm.train(source)
    few, _, _, further = masked_lm.train(source, listed=2000)
    scored = {r["doc_id"]: r for r in masked_lm.lm_scores(source, listed=2000).collect()}
    assert data.count() == len(scored) == 60 and vocabulary.complete and unlisted.isEmpty()
    assert not few.complete and 0 < len(few.listed) <= 2000 and len(few.listed) + further.count() == len(vocabulary.listed)
    for i, r in {r["doc_id"]: r for r in masked_lm.lm_scores(source).collect()}.items():  # how many are listed changes no score
        assert scored[i]["log_likelihood"] == pytest.approx(r["log_likelihood"], rel=1e-5, abs=1e-3)
    text = {r["doc_id"]: r["text"] for r in source.collect()}
    for i in sorted(text, key=lambda i: len(text[i]))[:25]:
        assert scored[i]["n_words"] == len(text[i].split()) and scored[i]["log_likelihood"] == pytest.approx(slow_score(text[i], vocabulary, network), rel=2e-3, abs=0.05)


def test_masked_lm_reads_every_position_once(spark, monkeypatch):
    seen = []
    at = np.arange(7)
    for k in range(masked_lm.ROUNDS):
        seen += at[k :: masked_lm.ROUNDS].tolist()
    assert sorted(seen) == at.tolist()
    row, places = masked_lm.joined([np.array([5, 6], np.int16), np.array([], np.int16), np.array([7], np.int16)])
    context, target = masked_lm.windows(row, places)
    e = masked_lm.EDGE
    assert target.tolist() == [5, 6, 7] and context.T.tolist() == [[e, e, 6, e], [e, 5, e, e], [e, e, e, e]]


def test_masked_lm_scores_do_not_depend_on_partitions(spark):
    source = docs(spark).select("doc_id", "text")
    copies = source.unionByName(source.where("doc_id = 3").withColumn("doc_id", F.lit(3)).crossJoin(spark.range(300)).select("doc_id", "text"))
    one, many = (sorted((r["doc_id"], r["log_likelihood"]) for r in masked_lm.lm_scores(copies.repartition(n), share_words=8_000).collect()) for n in (1, 16))
    assert len(one) == source.count() + 300 and max(abs(a[1] - b[1]) for a, b in zip(one, many)) < 1e-6
    _, _, data, _ = masked_lm.train(copies.repartition(5), rounds=1, share_words=8_000)
    shares = masked_lm.shares_of(data, 8_000).collect()
    sizes = [len(r["classes"]) // 2 for r in shares]
    assert len(shares) > 5 and sum(sizes) == sum(len(r["classes"]) // 2 for r in data.select("classes").collect()) and max(sizes) < 5 * np.mean(sizes)  # 300 equal rows don't meet in one


def test_masked_lm_query(spark):
    got = QUERIES["op8_masked_lm"](spark, SF).toPandas()
    source = docs(spark).toPandas()
    assert sorted(got.doc_id) == sorted(source.doc_id) and (got.log_likelihood < 0).all()
    shuffled = spark.createDataFrame([(int(i), " ".join(np.random.default_rng(1).permutation(t.split()))) for i, t in zip(source.doc_id, source.text)] + [(int(i) + 10**6, t) for i, t in zip(source.doc_id, source.text)], "doc_id long, text string")
    means = masked_lm.lm_scores(shuffled, passes=4).toPandas().set_index("doc_id").mean_log_likelihood
    assert means[means.index >= 10**6].mean() > means[means.index < 10**6].mean()  # word order counts


def test_masked_lm_tells_words_of_one_class_apart(spark):
    common = [f"c{i}" for i in range(masked_lm.OWN_CLASSES)] * 6
    by_class = {}
    for i in range(2000):
        by_class.setdefault(int(masked_lm.shared_class(masked_lm.keys_of([b"r%d" % i]))[0]), []).append(f"r{i}")
    usual, odd_one = next(x for x in by_class.values() if len(x) > 1)[:2]
    table = spark.createDataFrame([(0, " ".join(common)), (1, f"c1 c2 {usual} c3 c4"), (2, f"c1 c2 {odd_one} c3 c4"), (3, f"c9 {usual} " * 3)], "doc_id long, text string")
    for listed, share in ((masked_lm.LISTED, 4.5 / 1.5), (1, 4.5 / 1.5), (0, 4.5 / 1.5)):
        got = {r["doc_id"]: r["log_likelihood"] for r in masked_lm.lm_scores(table, listed=listed).collect()}
        assert abs(got[1] - got[2] - np.log(share)) < 1e-3


def test_pipeline_stages(spark, odd, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "exact dedup", "near-duplicates", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns
        assert stage(spark, empty, SF).count() == 0
    source = docs(spark)
    got = corpus_pipeline.run(spark, SF).toPandas()
    judged = QUERIES["op10_quality_rules"](spark, SF).where("kept").select("doc_id")
    ids = {r["doc_id"] for r in judged.collect()}
    assert set(got.doc_id) <= ids and 0.6 * len(ids) < got.doc_id.nunique()
    texts = {r["doc_id"]: low(r["text"]) for r in source.collect()}
    kept = [texts[i] for i in set(got.doc_id)]
    assert len(set(kept)) == len(kept)
    fps = [simhash.fingerprint(x) & (2**64 - 1) for x in kept]
    assert len(set(brute_components(fps, list(range(len(fps)))))) == len(fps)


def test_stages_delete_their_own_folders_alone(spark, odd):
    there = lambda path: (p := spark._jvm.org.apache.hadoop.fs.Path(path)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{common.shared_dir(spark)}/tessera")
    common.staged(docs(spark).limit(1), "some")
    before = {s.getPath().getName() for s in top.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(top)}
    other = QUERIES["op4_token_output"](spark, SF)  # built before, read afterwards
    first = corpus_pipeline.rules(spark, docs(spark), SF)
    folder = corpus_pipeline._folders["rules"]
    assert there(folder)
    kept = common.staged(first, "kept")
    second = corpus_pipeline.classifier(spark, kept, SF)
    assert not there(folder) and second.count() <= kept.count()
    third = corpus_pipeline.exact(spark, second, SF)  # reads what the stage before left
    assert there(corpus_pipeline._folders["classifier"]) and third.count() > 0
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert other.count() == docs(spark).count() and kept.count() > 0
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{common.shared_dir(spark)}/tessera")
    left = {s.getPath().getName() for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)}
    own = {x for x in left - before if x.startswith(("rules-", "classifier-", "exact-", "near-", "pack-"))}
    # of this test's stages the last two called by themselves keep their folders; a run leaves none but its result's
    assert sorted(x.partition("-")[0] for x in own) == ["classifier", "exact"]


def test_no_swallowed_imports_and_no_local_checkpoint():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent
    for f in [*(root / "tessera" / "llm").glob("*.py"), root / "corpus_pipeline.py"]:
        source = f.read_text()
        assert "ImportError" not in source and "localCheckpoint" not in source
    for f in (root / "tessera").rglob("*.py"):
        if "llm" not in f.parts:
            assert "tessera.llm" not in f.read_text() and "from ..llm" not in f.read_text()
