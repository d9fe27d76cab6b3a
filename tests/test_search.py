import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import dense, embed, evaluate, facets, lexical, rewrite


def corpus(spark, rows):
    return lexical.tokenized(spark.createDataFrame(rows, "doc_id long, text string"), F.col("text"))


def hits(spark, docs, query, **more):
    q = spark.createDataFrame([(1, query)], "qid long, query string")
    return lexical.search(docs, lexical.query_tokens(q), **more).orderBy("rank").collect()


def test_idf_is_zero_for_a_term_in_every_document(spark):
    docs = corpus(spark, [(0, "tree node"), (1, "tree leaf")])
    assert hits(spark, docs, "tree", ranker="tfidf") == []
    assert len(hits(spark, docs, "tree", ranker="bm25")) == 2


def test_rare_beats_common_and_paging(spark):
    docs = corpus(spark, [(0, "tree deep"), (1, "tree tree wide"), (2, "graph"), (3, None)])
    got = hits(spark, docs, "tree deep")
    assert [r["doc_id"] for r in got] == [0, 1] and got[0]["total"] == 2 and got[0]["matched_terms"] == ["tree", "deep"]
    assert [r["doc_id"] for r in hits(spark, docs, "tree deep", offset=1)] == [1]
    assert hits(spark, docs, "the of and") == []


def test_saturation_and_repeated_query_words(spark):
    docs = corpus(spark, [(0, "alpha " * 2 + "x " * 99), (1, "alpha " * 101), (2, "beta")])
    got = hits(spark, docs, "alpha")
    assert got[0]["score"] / got[1]["score"] < 5
    assert hits(spark, docs, "alpha alpha")[0]["score"] == pytest.approx(2 * got[0]["score"], abs=1e-5)


def test_ties_go_to_the_earlier_token_then_the_lower_id(spark):
    docs = corpus(spark, [(0, "beta"), (1, "alpha"), (2, "beta"), (3, "gamma")])
    assert [r["doc_id"] for r in hits(spark, docs, "alpha beta")][0] == 1
    assert [r["doc_id"] for r in hits(spark, docs, "beta")] == [0, 2]


def test_title_bonus(spark):
    titles = spark.createDataFrame([(0, "Two Sum"), (1, "Sum two more sum"), (2, "other")], "doc_id long, title string")
    q = spark.createDataFrame([(1, "2 sum"), (2, "twosum"), (3, "sum")], "qid long, query string")
    assert {tuple(r) for r in lexical.exact_title_hits(titles, q).collect()} == {(1, 0), (2, 0)}


def test_stored_index_gives_the_same(spark, tmp_path):
    docs = corpus(spark, [(i, f"alpha w{i % 3} w{i % 5} beta{i}") for i in range(40)])
    q = spark.createDataFrame([(1, "w1 w2 beta7")], "qid long, query string")
    tokens = lexical.query_tokens(q)
    a = lexical.search(docs, tokens).select("qid", "rank", "doc_id", "score").collect()
    index = lexical.StoredIndex.build(docs, str(tmp_path / "index"))
    assert sorted(a) == sorted(index.search(tokens).select("qid", "rank", "doc_id", "score").collect())
    plan = index.postings(tokens)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]  # only the terms' folders are read


VECTORS = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [0.8, 0.6, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [0.0, 0.0, 1.0, 0.0])]


def test_dense_order_ties_and_neighbours(spark):
    v = spark.createDataFrame(VECTORS, "doc_id long, vector array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0, 0.0, 0.0]), (8, None)], "qid long, vector array<float>")
    got = dense.explain(dense.search(v, q)).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [0, 1, 2, 3] and got[0]["angle_deg"] == 0 and got[3]["angle_deg"] == 90
    near = dense.similar(v, spark.createDataFrame([(0,), (77,)], "doc_id long")).orderBy("rank").collect()
    assert [r["doc_id"] for r in near] == [1, 2, 3]


def test_fusion(spark):
    lex = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "qid long, rank int, doc_id string")
    den = spark.createDataFrame([(1, 1, "c"), (1, 2, "d"), (1, 3, "a")], "qid long, rank int, doc_id string")
    got = dense.fuse(lex, den).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == ["a", "c", "b", "d"] and got[0]["total"] == 4
    assert got[0]["score"] == pytest.approx(1 / 61 + 1 / 63, abs=1e-9)


def test_expansion_rules():
    rules = [rewrite.Alias("shortest path", "dijkstra algorithm", True), rewrite.Alias("bfs", "breadth first search"), rewrite.Alias("two pointer", "sliding window", True)]
    e = rewrite.Expander(rules)
    assert e.expand("BFS grid").query == "bfs grid breadth first search"
    assert e.expand("a shortest-path b").query == "a b dijkstra algorithm"
    assert e.expand("bfsx").expanded is False and e.expand("  ").query == "  " and e.expand("x" * 400).expanded is False
    assert e.expand("breadth first search bfs").expanded is False
    assert e.expand("3 sum").added == ["three"]
    known = rewrite.Expander([rewrite.Alias("short path", "dijkstra algorithm", True), rewrite.Alias("bfs", "breadth first"), *[rewrite.Alias(f"a{i}", f"x{i} y{i} z{i}") for i in range(4)]])
    assert known.expand("short path Dijkstra algorithm") == rewrite.Expansion("short path Dijkstra algorithm", False, [], ["short path"])
    assert known.expand("BFS  breadth first").matches == ["bfs"] and known.expand("BFS  breadth first").query == "BFS  breadth first"
    full = known.expand("a0 a1 a2 a3 2")
    assert len(full.added) == 8 and full.matches == ["a0", "a1", "a2"]


def test_spelling(spark):
    vocab = spark.createDataFrame([("tree", 900), ("pre", 12), ("deep", 40), ("dijkstra", 30), ("three", 5), ("rare", 2), ("trek", 900)], "term string, df long")
    tokens = spark.createDataFrame([(1, 0, "tre"), (2, 0, "djikstra"), (3, 0, "rarr"), (4, 0, "tree"), (5, 0, "zz")], "qid long, pos int, term string")
    got = {r["qid"]: (r["correction"], r["distance"]) for r in rewrite.corrections(tokens, vocab).collect()}
    assert got == {1: ("tree", 1), 2: ("dijkstra", 1)}


def test_spelling_equals_brute_force(spark):
    import random

    from test_engine import osa

    r = random.Random(6)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randint(3, 10)))
    vocab = {word(): r.randint(1, 9) for _ in range(250)}
    tokens = [(q, p, word()) for q in range(60) for p in range(4)]
    want = {}
    for q in range(60):
        fixes, seen = [], set()
        for _, _, x in (t for t in tokens if t[0] == q):
            if x in vocab or x in seen:
                continue
            seen.add(x)
            budget = 2 if len(x) >= 8 else 1
            near = [(osa(x, v), -n, v) for v, n in vocab.items() if n >= 3 and abs(len(v) - len(x)) <= budget and (v[0] == x[0] or v[-1] == x[-1]) and osa(x, v) <= budget]
            if near and len(fixes) < 2:
                fixes.append((x, min(near)[2]))
        want[q] = fixes
    got = rewrite.corrections(spark.createDataFrame(tokens, "qid long, pos int, term string"), spark.createDataFrame(list(vocab.items()), "term string, df long"))
    assert sorted((x["qid"], x["term"], x["correction"]) for x in got.collect()) == sorted((q, *f) for q, fs in want.items() for f in fs) and sum(map(len, want.values())) > 20
    typed = spark.createDataFrame([(1, "zeta alpha")], "qid long, query string")
    fixes = spark.createDataFrame([(1, 1, "aaa"), (1, 0, "zzz")], "qid long, pos int, correction string")
    assert rewrite.apply_corrections(typed, fixes).first()["query"] == "zeta alpha zzz aaa"


def test_umbrellas(spark):
    names = spark.createDataFrame([("Range Queries", "ranges"), ("range query family", "ranges"), ("Trees", "trees"), ("tree dp things", "dp")], "name string, label string")
    q = spark.createDataFrame([(1, "trees"), (2, "range"), (3, "quer"), (4, "fam"), (5, "ees"), (6, "dp")], "qid long, query string")
    assert {tuple(r) for r in facets.resolve_label(q, names).collect()} == {(1, "trees"), (2, "ranges"), (3, "ranges"), (4, "ranges"), (6, "dp")}
    there = spark.createDataFrame([("interval dp",)], "name string")
    assert {r["qid"] for r in facets.resolve_label(q, names, there).collect()} == {1, 2, 3, 4}


def test_guard(spark):
    vocab = spark.createDataFrame([("tree", 9)], "term string, df long")
    q = spark.createDataFrame([(1, "zz yy zz"), (2, "tree zz"), (3, "the")], "qid long, query string")
    got = {r["qid"]: (r["refused"], r["unknown_terms"]) for r in rewrite.guard(q, lexical.query_tokens(q), vocab).collect()}
    assert got == {1: (True, ["zz", "yy"]), 2: (False, []), 3: (False, [])}


def test_metrics(spark):
    runs = spark.createDataFrame([("x", 1, 1, 10), ("x", 1, 2, 11), ("x", 1, 3, 12)], "ranker string, qid long, rank int, doc_id long")
    qrels = spark.createDataFrame([(1, 11), (1, 99), (2, 5)], "qid long, doc_id long")
    queries = spark.createDataFrame([(1, "a"), (2, "b")], "qid long, slice string")
    got = {r["qid"]: r for r in evaluate.per_query(runs, qrels, queries, ["x"]).collect()}
    assert (got[1]["p_at_1"], got[1]["p_at_5"], got[1]["rr"], got[1]["recall_100"]) == (0, 0.2, 0.5, 0.5)
    assert got[1]["ndcg_10"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3))) and got[2]["rr"] == 0
    assert {(r["slice"], r["n"]) for r in evaluate.by_slice(evaluate.per_query(runs, qrels, queries, ["x"])).collect()} == {("all", 2), ("a", 1), ("b", 1)}


@pytest.mark.parametrize("ranker", ["bm25", "tfidf"])
def test_block_index_gives_the_same_from_fewer_postings(spark, tmp_path, ranker):
    import random

    from tessera.operators import blockmax

    r = random.Random(3)
    words = lambda n: " ".join(f"w{min(int(r.expovariate(0.02)), 400)}" if r.random() < 0.7 else f"r{r.randint(0, 2000)}" for _ in range(n))
    texts = [words(r.randint(1, 60)) for _ in range(3000)]
    docs = corpus(spark, [(7 * i - 500, x) for i, x in enumerate(texts)] + [(10**12, None)])
    queries = spark.createDataFrame([(i, " ".join(texts[97 * i].split()[:6])) for i in range(20)] + [(30, "w1 w1 w2"), (31, "absent"), (32, ""), (33, "w400")], "qid long, query string")
    tokens = lexical.query_tokens(queries)
    index = blockmax.BlockIndex.build(docs, str(tmp_path / "index"))
    for k, offset in ((10, 0), (3, 4)):
        want = lexical.search(docs, tokens, ranker, k, offset).drop("total")
        assert sorted(map(str, index.search(tokens, ranker, k, offset).collect())) == sorted(map(str, want.collect()))
    assert index.candidates(tokens, ranker).count() < 0.35 * lexical.contributions(docs, tokens, ranker).count()


class PatternExpander(rewrite.Expander):
    """The same rules by one pattern for each, tried on each query."""

    class Patterns:
        def __init__(self, aliases):
            import re

            self.patterns = [re.compile(r"(?:^|[^a-z0-9])" + r"[\s-]+".join(map(re.escape, w)) + r"(?![a-z0-9])") for w in aliases]

        def found(self, text):
            return {i: m.span() for i, p in enumerate(self.patterns) if (m := p.search(text))}

    def __init__(self, rules):
        super().__init__(rules)
        self.trie = self.Patterns([self._words(r.alias) for r in self.rules])


def test_alias_trie_equals_patterns():
    import random

    r = random.Random(8)
    words = ["a", "b", "ab", "dp", "c++", "two", "sum", "x1", "'s", "tree", "é", "3"]
    some = lambda n, sep: sep.join(r.choice(words) for _ in range(r.randint(1, n)))
    for _ in range(60):
        rules = [rewrite.Alias(some(4, r.choice("- ")), some(3, " "), r.random() < 0.5) for _ in range(r.randint(1, 25))]
        fast, slow = rewrite.Expander(rules), PatternExpander(rules)
        for _ in range(60):
            q = "".join(r.choice(words + [" ", " ", "-", "--", "\t", ".", "\u00a0", "2"]) + r.choice(["", " ", " ", "-"]) for _ in range(r.randint(0, 14)))
            assert fast.expand(q) == slow.expand(q), (rules, q)


def test_alias_trie_time_follows_the_query_and_not_the_rules(spark):
    import random
    import time

    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    some = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rules = list({x: rewrite.Alias(x, some(r.randint(1, 3)), r.random() < 0.3) for x in (some(r.randint(1, 3)) for _ in range(5000))}.values())
    queries = [some(r.randint(1, 20)) for _ in range(1000)]
    queries = [" ".join([q, r.choice(rules).alias, q[:20]]) for q in queries]
    few, many = rewrite.Expander(rules[:50]), rewrite.Expander(rules)

    def seconds(expander):
        start = time.perf_counter()
        for q in queries:
            expander.expand(q)
        return time.perf_counter() - start

    assert min(seconds(many) for _ in range(3)) < 6 * min(seconds(few) for _ in range(3))
    slow = PatternExpander(rules)
    assert [many.expand(q) for q in queries[:40]] == [slow.expand(q) for q in queries[:40]]
    # every word of 100,000 queries leads the same way in batches
    frame = spark.createDataFrame([(i, queries[i % len(queries)] + f" {i % 5}") for i in range(100_000)], "qid long, query string")
    got = rewrite.expand(frame, rules).where("qid % 997 = 0").collect()
    assert len(got) == 101 and all((x["query"], x["expanded"], x["added"], x["matches"]) == ((e := many.expand(queries[x["qid"] % len(queries)] + f" {x['qid'] % 5}")).query, e.expanded, e.added, e.matches) for x in got)


def test_embedder_equals_a_decomposition_and_recalls_neighbours(spark):
    import numpy as np

    from tessera.operators import embed
    from tessera.plans import tables

    docs = lexical.tokenized(tables.documents(spark, "/root/testdata/sf0.001"), F.col("text"))
    model = embed.Embedder.fit(docs, passes=4)
    got = {r["doc_id"]: np.array(r["vector"]) for r in model.embedded(docs).collect()}
    rows = {r["doc_id"]: r["all"] for r in embed.counted(docs, embed.FEATURES).collect()}
    x = np.zeros((len(rows), embed.FEATURES))
    for i, k in enumerate(sorted(rows)):
        at, n = np.unique(rows[k], return_counts=True)
        x[i, at] = 1 + np.log(n)
    x *= np.log(len(rows) / np.maximum((x > 0).sum(0), 1)) * (x > 0).any(0)
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    assert len(got) == sum(x.any(1)) and all(abs(np.linalg.norm(v) - 1) < 1e-5 for v in got.values())
    # the subspace holds nearly as much of the rows as the best one does
    kept, best = (np.linalg.norm(x @ model.basis) ** 2, (np.linalg.svd(x, compute_uv=False)[: embed.DIMS] ** 2).sum())
    assert kept > 0.97 * best
    # of the nearest by the whole rows, where they are near at all, the vectors find nearly all
    ids, whole = sorted(rows), x @ x.T
    v = np.array([got[k] for k in ids])
    near = found = 0
    for i in range(len(ids)):
        close = [j for j in range(len(ids)) if j != i and whole[i, j] > 0.5]
        first = [j for j in np.argsort(-(v @ v[i])) if j != i][:10]
        near, found = near + len(close[:10]), found + len(set(close[:10]) & set(first))
    assert near and found >= 0.9 * near
    odd = spark.createDataFrame([(1, None), (2, []), (3, ["zzz"]), (4, rows and ["the"])], "doc_id long, tokens array<string>")
    assert {r["doc_id"] for r in model.embedded(odd).collect()} <= {3, 4}
    q = model.queries(spark.createDataFrame([(7, tables.documents(spark, "/root/testdata/sf0.001").where("doc_id = 5").first()["text"])], "qid long, query string"))
    assert dense.search(model.embedded(docs), q, 1).first()["score"] > 0.999


def test_pivot_search_equals_the_full_scan_and_skips(spark, tmp_path):
    import numpy as np

    from tessera.operators import pivots

    r = np.random.default_rng(6)
    centres = r.standard_normal((40, 16))
    x = np.concatenate([centres[r.integers(0, 40, 6000)] + 0.1 * r.standard_normal((6000, 16)), r.standard_normal((50, 16)) * [[3]], np.zeros((2, 16))]).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(9001, x[5].tolist()), (9002, None), (9003, [])]
    v = spark.createDataFrame(rows, "doc_id long, vector array<float>").repartition(5)
    q = v.where("doc_id % 97 = 0 OR doc_id > 9000").select(F.col("doc_id").alias("qid"), "vector")
    for n, block in ((32, 64), (1, 7000)):
        index = pivots.PivotIndex.build(v, str(tmp_path / f"p{n}"), n, block)
        for k, offset, own in ((10, 0, False), (5, 3, True)):
            assert sorted(map(str, index.search(q, k, offset, own).collect())) == sorted(map(str, dense.search(v, q, k, offset, own).collect()))
        if n > 1:
            assert index.skipped(q) > 0.4
    empty = pivots.PivotIndex.build(v.where("false"), str(tmp_path / "none"))
    assert empty.search(q).count() == 0 and index.search(q.where("false")).count() == 0


def test_drift_reads_only_ranges_that_differ(spark, tmp_path):
    import shutil

    from tessera.operators import curate, merkle

    a = spark.range(-3000, 20_000).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("digest"))
    b = a.where("doc_id <> 5000").withColumn("digest", F.when(F.col("doc_id").isin(-2500, 12_345), "new").otherwise(F.col("digest"))).unionByName(spark.createDataFrame([(10**10, "far")], "doc_id long, digest string"))
    x, y = merkle.Artifact.write(a, str(tmp_path / "x")), merkle.Artifact.write(b, str(tmp_path / "y"))
    want = sorted(map(tuple, curate.artifact_drift(a, b).collect()))
    assert sorted(r["node"] for r in merkle.differing(x, y, str(tmp_path / "n")).collect()) == sorted({-2500 // 64, 5000 // 64, 12_345 // 64, 10**10 // 64})
    touched = {i // (64 * 16) for i in (-2500, 5000, 12_345, 10**10)}
    for side in ("x", "y"):
        for f in (tmp_path / side / "records").iterdir():
            if f.name.startswith("folder=") and int(f.name[7:]) not in touched:
                for part in f.iterdir():
                    part.write_bytes(b"not parquet any more")  # would fail if it were read
    spark.catalog.clearCache()
    assert sorted(map(tuple, merkle.drift(x, y, str(tmp_path / "m")).collect())) == want
    same = merkle.Artifact.write(a.repartition(7), str(tmp_path / "z"))
    assert merkle.differing(x, same, str(tmp_path / "o")).count() == 0 and [tuple(r) for r in x.digest().collect()] == [tuple(r) for r in same.digest().collect()]
    shutil.rmtree(tmp_path / "z")


def test_wanted_rows_read_only_their_pages(spark, tmp_path):
    from tessera.sources import readers

    rows = spark.range(5000).select(F.col("id"), (F.col("id") * 2).alias("offset"), F.concat(F.lit("r"), "id").alias("v"))
    readers.write_pages(rows, str(tmp_path / "s"))
    wanted = spark.createDataFrame([(3,), (4,), (4999,), (99_999,)], "id long")
    got = readers.read_wanted(spark, str(tmp_path / "s"), wanted)
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    for f in (tmp_path / "s" / "pages").iterdir():
        if f.name.startswith("page=") and f.name not in ("page=0", "page=99"):
            for part in f.iterdir():
                part.write_bytes(b"not parquet any more")
    assert sorted((r["id"], r["v"], r["page"]) for r in got.collect()) == [(3, "r3", 0), (4, "r4", 0), (4999, "r4999", 99)]


def test_matched_terms_by_marks_equal_lists(spark):
    import random

    r = random.Random(1)
    docs = corpus(spark, [(i, " ".join(f"w{r.randint(0, 150)}" for _ in range(60))) for i in range(80)])
    for n in (5, 62, 63, 130, 600):
        tokens = lexical.query_tokens(spark.createDataFrame([(1, " ".join(f"w{r.randint(0, 150)}" for _ in range(n))), (2, "w1"), (3, "")], "qid long, query string"))
        scored = lexical.contributions(docs, tokens)
        assert sorted(map(str, lexical.top_hits(scored, 10, tokens=tokens).collect())) == sorted(map(str, lexical.top_hits(scored, 10).collect()))


def test_route_of_requests(spark):
    from tessera.operators import serve

    docs = corpus(spark, [(i, x) for i, x in enumerate(["tree path", "tree graph", "graph", "tree", "sum"])])
    rows = spark.createDataFrame([(0, "leetcode", "Hard", None, 40.0, ["p"]), (1, "leetcode", "Easy", None, 70.0, ["p"]), (2, "codeforces", None, 1500, None, []), (3, "leetcode", "Medium", None, 50.0, []), (4, "cses", None, None, None, ["p"])], "doc_id long, platform string, tier string, rating int, acceptance double, patterns array<string>")
    q = spark.createDataFrame([(1, "tree"), (2, " "), (3, "zzzz"), (4, None)], "qid long, query string")
    mine = spark.createDataFrame([(3, True, False, "hard")], "doc_id long, done boolean, bookmarked boolean, recall string")
    v = spark.createDataFrame([(i, [float(i == j) + 0.1 * i for j in range(5)]) for i in range(5)], "doc_id long, vector array<float>")
    qv = spark.createDataFrame([(1, [0.0, 1.0, 0.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0, 0.0, 1.0])], "qid long, vector array<float>")
    run = lambda f=serve.Filters(), **more: serve.serve_requests(docs, rows, q, [], lexical.vocabulary(docs), f, **{"sortable": {"leetcode", "codeforces"}, **more})
    ids = lambda out: {k: [r["doc_id"] for r in sorted(out["hits"].collect(), key=lambda r: r["rank"]) if r["qid"] == k] for k in (1, 2, 3, 4)}
    assert ids(run()) == {1: [3, 0, 1], 2: [], 3: [], 4: []}
    only = serve.Filters({"leetcode"})
    assert ids(run(only, sort="difficulty")) == {1: [1, 3, 0], 2: [1, 3, 0], 3: [], 4: [1, 3, 0]}
    assert ids(run(only, sort="difficulty", k=1, offset=1)) == {1: [3], 2: [3], 3: [], 4: [3]}  # a search sorts its first k, browsing goes on by pages
    refused = run(serve.Filters({"leetcode", "cses"}), sort="difficulty-desc")
    assert refused["sort_refused"] and ids(refused)[1] == [3, 0, 1] and not run(only, sort="difficulty")["sort_refused"] and not run(only, sort="junk")["sort_refused"]
    done = run(serve.Filters(done="done"), state=mine)
    assert ids(done) == {1: [3], 2: [3], 3: [], 4: [3]} and {(r["done"], r["recall"]) for r in done["hits"].collect()} == {(True, "hard")}
    assert ids(run(serve.Filters(done="notdone", pattern="p"), state=mine))[2] == [0, 1, 4]
    near = ids(run(only, ranker="dense", vectors=v, query_vectors=qv))
    assert near[1][0] == 1 and set(near[1]) == {0, 1, 3} and near[3] == []  # a query of unknown words is refused for any ranker
    assert set(ids(run(ranker="hybrid", vectors=v, query_vectors=qv))[1]) == {0, 1, 2, 3, 4}


def test_search_shuffles_texts_once_and_its_parts_follow_the_documents(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PART_DOCUMENTS", 10)
    rows = spark.range(120).select(F.col("id").alias("doc_id"), F.concat(F.lit("tree path "), F.col("id").cast("string")).alias("text"))
    docs = lexical.tokenized(rows, F.col("text"))
    tokens = lexical.query_tokens(spark.createDataFrame([(1, "tree path 7"), (2, "path 3 tree")], "qid long, query string"))
    assert docs.rdd.getNumPartitions() == 12
    hits = lexical.contributions(docs, tokens).groupBy("qid", "doc_id").agg(F.sum("contribution").alias("score"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert [x.split(",")[0].split("#")[0] for x in plan.split("Exchange hashpartitioning(")[1:] if "REPARTITION_BY_NUM" in x.split("\n")[0]] == ["doc_id"]
    assert "hashpartitioning(qid" not in plan and "hashpartitioning(term" not in plan.split("BroadcastExchange")[0]
    top = lexical.search(docs, tokens, k=2).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["doc_id"], r["total"]) for r in top] == [(1, 7, 120), (1, 0, 120), (2, 3, 120), (2, 0, 120)]


def test_fitting_vectors_holds_few_texts_at_once():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(1)
    own = embed.Embedder(np.ones(512), r.standard_normal((512, 64)))
    batch = pa.RecordBatch.from_pydict({"all": [r.integers(0, 512, 200).tolist() for _ in range(1000)]})
    total, want = np.zeros((512, 64)), np.zeros((512, 64))
    tracemalloc.start()
    embed._gather(total, batch, own)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    row, column, w = embed._rows(batch, own.idf)
    x = np.zeros((1000, 512))
    x[row, column] = w
    want = x.T @ (x @ own.basis)
    assert np.allclose(total, want) and most < 20 << 20


def test_counted_search_equals_the_join_and_moves_no_text(spark, monkeypatch):
    import random

    r = random.Random(9)
    rows = [(i, " ".join(f"W{int(r.paretovariate(0.6)) % 90}" for _ in range(r.randint(0, 40)))) for i in range(400)] + [(400, None), (401, ""), (402, "the of"), (403, "w1 w1"), (404, "w1 w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    q = spark.createDataFrame([(i, " ".join(f"w{r.randint(0, 95)}" for _ in range(n))) for i, n in enumerate((1, 3, 9, 80, 2, 2))] + [(6, ""), (7, "nowhere"), (8, "w1")], "qid long, query string")
    tokens, keep = lexical.query_tokens(q), docs.where("doc_id % 3 <> 0").select("doc_id")
    texts = lexical.Texts(docs, F.col("text"))
    monkeypatch.setattr(lexical, "BLOCK_CELLS", 3_000)  # several blocks a task
    for ranker in ("bm25", "tfidf"):
        for k, offset, kept in ((4, 0, None), (3, 5, None), (600, 0, None), (5, 0, keep)):
            want = lexical.search(texts.tokenized(), tokens, ranker, k, offset, keep=kept)
            assert sorted(map(str, lexical.search(texts, tokens, ranker, k, offset, keep=kept).collect())) == sorted(map(str, want.collect()))
    counted = texts.counted(tokens)
    assert "Exchange" not in counted.hits("bm25", 4)._jdf.queryExecution().executedPlan().toString()
    part = docs.where("doc_id % 5 <> 0")
    assert sorted(map(str, counted.where("doc_id % 5 <> 0").search("tfidf", 5).collect())) == sorted(map(str, lexical.search(lexical.tokenized(part, F.col("text")), tokens, "tfidf", 5).collect()))
    monkeypatch.setattr(lexical, "SENT_TOKENS", 5)  # too many queries to be sent: the join
    assert texts.counted(tokens) is None and lexical.search(texts, tokens, k=2).count() == lexical.search(texts.tokenized(), tokens, k=2).count()


@pytest.mark.parametrize("name", ("e8_run_diff", "r16_compare"))
def test_several_runs_count_the_texts_once(spark, monkeypatch, name):
    from tessera.plans import search

    calls = []
    of = lexical.Texts.counted
    monkeypatch.setattr(lexical.Texts, "counted", lambda self, tokens: calls.append(1) or of(self, tokens))
    monkeypatch.setattr(lexical, "tokenized", lambda *a, **b: pytest.fail("texts are dealt and tokenized again"))
    assert search.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0 and len(calls) == 1


def test_block_index_stores_packed_rows_once(spark, tmp_path):
    import os
    from collections import Counter

    from tessera.operators import blockmax

    texts = {i: " ".join(f"w{(i * j) % 37}" for j in range(i % 23)) for i in range(700)}
    docs = corpus(spark, list(texts.items()))
    index = blockmax.BlockIndex.build(docs, str(tmp_path / "index"))
    assert sorted(os.listdir(index.path)) == ["blocks", "corpus", "terms"]  # neither postings nor champions beside the blocks
    want = Counter(w for x in texts.values() for w in set(x.split()))
    assert {r["term"]: r["df"] for r in spark.read.parquet(f"{index.path}/terms").collect()} == want
    rows = spark.read.parquet(f"{index.path}/blocks").where("term = ''").collect()
    assert sum(len(r["ids"]) // 8 for r in rows) == 700 and max(len(r["ids"]) // 8 for r in rows) <= blockmax.GRID * blockmax.GRIDS


def test_dense_search_keeps_each_querys_best_of_many_blocks(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(3)
    x = r.integers(-2, 3, (700, 4)).astype(float)  # many ties
    x[5], x[6] = np.nan, np.inf
    made = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (701, [])], "doc_id long, vector array<double>").repartition(3)
    asked = made.where("doc_id % 10 < 3").select(F.col("doc_id").alias("qid"), "vector")
    for name, n in {"BLOCK_VECTORS": 90, "BLOCK_QUERIES": 40, "TILE_VECTORS": 30, "TILE_QUERIES": 7, "PART_BLOCKS": 2}.items():
        monkeypatch.setattr(dense, name, n)
    rows, plain = [], dense.packed
    for limit in (True, False):
        if not limit:
            monkeypatch.setattr(dense, "bounded_broadcast", lambda df: df)
        for own in (True, False):
            want = {}
            with np.errstate(invalid="ignore"):
                s = np.round(x @ x.T, 9)
            for q in (i for i in range(700) if i % 10 < 3):
                best = sorted((-s[q, i], i) for i in range(700) if s[q, i] > -np.inf and not (own and i == q))[2:12]
                want[q] = [(i, round(-v, 6)) for v, i in best]
            got = {}
            for h in dense.search(made, asked, 10, 2, exclude_self=own).orderBy("qid", "rank").collect():
                got.setdefault(h["qid"], []).append((h["doc_id"], h["score"]))
            assert got == {q: h for q, h in want.items() if h}
    # a task returns each query's best once, however many blocks it met
    with monkeypatch.context() as m:
        m.setattr(dense, "ranked", lambda found, *a, **k: found.withColumn("rank", F.lit(0)))
        n = dense.search(made.coalesce(1), asked, 10).where("qid = 10").count()
    assert n == 10
