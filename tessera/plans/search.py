"""Search, vector and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dense, evaluate, facets, lexical, rewrite, serve
from ..operators.common import scratch, staged
from . import tables as t

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def _tok(x: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains({_STOP}, w))"


_BASE = f"""WITH d AS (SELECT doc_id, {_tok('text')} AS toks FROM documents),
    dl AS (SELECT doc_id, len(toks) AS dl FROM d), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
    q AS (SELECT item_id AS qid, {_tok('text')} AS qt FROM benchmark),
    qt AS (SELECT qid, unnest(range(0, len(qt))) AS pos, unnest(qt) AS term FROM q),
    p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY term)"""
_IDF = {"bm25": "ln(1 + (n - df + 0.5) / (df + 0.5))", "tfidf": "ln(n / df)"}
_WEIGHT = {"bm25": "idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))", "tfidf": "tf / dl * idf"}


def _ranked_sql(ranker: str, name: str, k: int = 10) -> str:
    return f"""{name}_c AS (SELECT *, {_WEIGHT[ranker]} AS contribution FROM (SELECT qid, pos, term, doc_id, tf, dl, df, n, avgdl, {_IDF[ranker]} AS idf
            FROM qt JOIN p USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st) WHERE idf > 0),
    {name}_s AS (SELECT qid, doc_id, sum(contribution) AS score, min(pos) AS first_pos, string_agg(term, ' ' ORDER BY pos) AS matched_terms FROM {name}_c GROUP BY ALL),
    {name}_r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, first_pos, doc_id) AS rank, doc_id, round(score, 6) AS score, matched_terms,
            count(*) OVER (PARTITION BY qid) AS total FROM {name}_s),
    {name} AS (SELECT * FROM {name}_r WHERE rank <= {k})"""


def _texts(spark, d):
    return lexical.Texts(t.documents(spark, d), F.col("text"))


def _search(spark, d, ranker, k=10, **more):
    return lexical.search(_texts(spark, d), lexical.query_tokens(t.queries(spark, d)), ranker, k, **more)


def _flat(df):
    return df.withColumn("matched_terms", F.array_join("matched_terms", " ")).withColumn("rank", F.col("rank").cast("long"))


def r1_postings(spark, d):
    docs = lexical.tokenized(t.documents(spark, d), F.col("text"))
    return lexical.postings(docs, lexical.query_tokens(t.queries(spark, d))).select("term", "doc_id", "tf")


def r2_term_stats(spark, d):
    docs = lexical.tokenized(t.documents(spark, d), F.col("text"))
    return lexical.vocabulary(docs).crossJoin(F.broadcast(lexical.corpus_stats(docs))).select("term", "df", F.round(lexical.tfidf_idf(), 6).alias("tfidf_idf"), F.round(lexical.bm25_idf(), 6).alias("bm25_idf"))


def r3_tfidf_top10(spark, d):
    return _flat(_search(spark, d, "tfidf"))


def r5_bm25_top10(spark, d):
    return _flat(_search(spark, d, "bm25"))


def r5_bm25_page2(spark, d):
    return _flat(_search(spark, d, "bm25", 10, offset=10))


def r13_bm25_explain(spark, d):
    docs = lexical.tokenized(t.documents(spark, d), F.col("text"))
    c = lexical.contributions(docs, lexical.query_tokens(t.queries(spark, d)))
    norm = 1 - lexical.B + lexical.B * F.col("dl") / F.col("avgdl")
    return c.select("qid", "pos", "term", "doc_id", F.col("tf").alias("count"), F.col("dl").cast("long").alias("doc_length"), F.round(norm, 6).alias("norm"), F.round("idf", 6).alias("idf"), F.round("contribution", 6).alias("contribution"))


def r15_index_dump(spark, d):
    dump = lexical.index_dump(lexical.tokenized(t.documents(spark, d), F.col("text")))
    return dump.select("term", "df", F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"], p["tf"])), " ").alias("postings"))


def r19_title_bonus(spark, d):
    parts = t.parts(spark, d)
    docs = lexical.tokenized(parts, F.concat_ws(" ", "title", "brand", "type"))
    queries = parts.groupBy(F.col("title").alias("query")).agg(F.min("doc_id").alias("qid"))
    exact = lexical.exact_title_hits(parts, queries)
    return _flat(lexical.search(docs, lexical.query_tokens(queries), "bm25", 10, exact_titles=exact))


def r8_dense_top10(spark, d):
    v = t.vectors(spark, d)
    hits = dense.search(v, v.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "vector"))
    return dense.with_total(hits, v).withColumn("rank", F.col("rank").cast("long"))


def r9_similar(spark, d):
    v = t.vectors(spark, d)
    return dense.similar(v, v.where("doc_id % 50 = 0")).withColumn("rank", F.col("rank").cast("long"))


def r14_dense_explain(spark, d):
    v = t.vectors(spark, d)
    q = v.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "vector")
    return dense.explain(dense.search(v, q, 20)).withColumn("rank", F.col("rank").cast("long")).withColumn("angle_deg", F.round("angle_deg", 2))


def _dense(spark, d, k=10):
    """Each benchmark item searched with the vector of its number."""
    v = t.vectors(spark, d)
    items = t.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"))
    return dense.search(v, items.join(v.select(F.col("doc_id").alias("qid"), "vector"), "qid"), k)


def _hybrid(spark, d, k=10):
    return dense.fuse(_search(spark, d, "bm25", 100), _dense(spark, d, 100), k)


def _longs(df, *names):
    return df.withColumns({c: F.col(c).cast("long") for c in names})


def r12_rrf(spark, d):
    return _longs(_hybrid(spark, d), "rank", "lex_rank", "dense_rank").withColumn("matched_terms", F.array_join("matched_terms", " "))


def r14_hybrid_explain(spark, d):
    return _longs(dense.explain_fused(_hybrid(spark, d, 20)), "rank", "lex_rank", "dense_rank")


def r14_hybrid_legs(spark, d):
    """What each leg of the fused search had first."""
    return _longs(dense.legs(_search(spark, d, "bm25"), _dense(spark, d)), "rank").withColumn("score", F.round("score", 6))


def r16_compare(spark, d):
    """Four rankers and one that isn't there: its error is a row too. The texts are counted once for all; the two legs are searched once, for themselves and for the fused ranker."""
    import uuid

    path = f"{scratch(spark)}/compare-{uuid.uuid4().hex}"
    counted = _texts(spark, d).counted(lexical.query_tokens(t.queries(spark, d)))
    words = lambda name, k: _search(spark, d, name, k) if counted is None else counted.search(name, k)
    legs, _ = dense.compare({"bm25": lambda: words("bm25", 100), "dense": lambda: _dense(spark, d, 100)}, f"{path}/legs")
    leg = lambda name: legs.where(F.col("ranker") == name)
    runs = {"bm25": leg("bm25").where("rank <= 10"), "tfidf": lambda: words("tfidf", 10), "dense": leg("dense").where("rank <= 10"), "hybrid": lambda: dense.fuse(leg("bm25"), leg("dense")), "broken": lambda: leg("bm25").withColumn("score", F.raise_error(F.lit("no such ranker")).cast("double"))}
    hits, errors = dense.compare(runs, f"{path}/all")
    rows = hits.withColumn("rank", F.col("rank").cast("long")).withColumn("score", F.round("score", 6)).withColumn("failed", F.lit(False))
    return rows.unionByName(errors.select("ranker", F.lit(True).alias("failed")), allowMissingColumns=True)


def r17_rank_delta(spark, d):
    return _longs(dense.rank_delta(_search(spark, d, "bm25"), _hybrid(spark, d)), "rank_a", "rank_b")


def r13_tfidf_explain(spark, d):
    docs = lexical.tokenized(t.documents(spark, d), F.col("text"))
    c = lexical.contributions(docs, lexical.query_tokens(t.queries(spark, d)), "tfidf")
    return c.select("qid", "pos", "term", "doc_id", F.col("tf").alias("count"), F.col("dl").cast("long").alias("doc_length"), F.round(F.col("tf") / F.col("dl"), 6).alias("tf"), F.round("idf", 6).alias("idf"), F.round("contribution", 6).alias("contribution"))


def stored(spark, d, name, build):
    """What ``build(path)`` stores of a folder's documents, once for each content: the place's name has a digest of the files."""
    import hashlib

    jvm, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    told = sorted((f, (s := (p := jvm(f)).getFileSystem(conf).getFileStatus(p)).getLen(), s.getModificationTime()) for f in t.documents(spark, d).inputFiles())
    path = f"{scratch(spark)}/{name}-{hashlib.sha256(repr(told).encode()).hexdigest()[:20]}-{spark.sparkContext.applicationId}"
    done = jvm(f"{path}.done")
    if not done.getFileSystem(conf).exists(done):
        build(path)
        done.getFileSystem(conf).create(done).close()
    return path


def _index(spark, d):
    """The stored index of a table folder."""
    tokens = lambda: lexical.tokenized(t.documents(spark, d), F.col("text"))
    return lexical.StoredIndex(spark, stored(spark, d, "index", lambda path: lexical.StoredIndex.build(tokens(), path)))


def r5_stored_index(spark, d):
    """The same hits as ``r5_bm25_top10``, from the stored index."""
    return _flat(_index(spark, d).search(lexical.query_tokens(t.queries(spark, d)), "bm25"))


ASKED = ("bm25", " TFIDF ", "dense", "Hybrid", "nope", None)


def r18_ranker_pick(spark, d):
    """Each benchmark query by the ranker it asks for; what isn't there is the default."""
    docs, vectors = _texts(spark, d), t.vectors(spark, d)
    queries = t.queries(spark, d).withColumn("asked", F.element_at(F.array(*[F.lit(x) for x in ASKED]), (F.col("qid") % len(ASKED) + 1).cast("int")))

    def words(ranker, k):
        return lambda q: lexical.search(docs, lexical.query_tokens(q), ranker, k)

    def meaning(k):
        return lambda q: dense.search(vectors, q.select("qid").join(vectors.select(F.col("doc_id").alias("qid"), "vector"), "qid"), k)

    runs = {"bm25": words("bm25", 3), "tfidf": words("tfidf", 3), "dense": meaning(3), "hybrid": lambda q: dense.fuse(words("bm25", 100)(q), meaning(100)(q), 3)}
    return serve.search_as_asked(queries, runs).withColumn("score", F.round("score", 6))


def _runs(docs, tokens, k, condition=None):
    """``ranker, qid, rank, doc_id`` of both rankers, stored: at most ``k`` rows a query and ranker. ``docs``: texts, or texts that are counted; of those under ``condition`` only."""
    counted = docs.counted(tokens) if isinstance(docs, lexical.Texts) else docs
    if counted is None:
        rows = docs.tokenized() if condition is None else lexical.tokenized(docs.docs.where(condition), docs.text)
        stats = lexical.statistics(rows, tokens)  # one count for both
        found = lambda name: lexical.top_hits(lexical.contributions(rows, tokens, name, stats=stats), k, totals=False, tokens=tokens)
    else:
        rows = counted if condition is None else counted.where(condition)
        found = lambda name: rows.search(name, k)
    one = lambda name: found(name).select(F.lit(name).alias("ranker"), "qid", "rank", "doc_id")
    return staged(one("bm25").unionByName(one("tfidf")), "runs")


def _scores(spark, d):
    runs = _runs(_texts(spark, d), lexical.query_tokens(t.queries(spark, d)), 100)
    return evaluate.per_query(runs, t.qrels(spark, d), t.queries(spark, d), ["bm25", "tfidf"])


def e1_e4_metrics(spark, d):
    return _scores(spark, d).select("ranker", "qid", "slice", *[F.round(m, 6).alias(m) for m in evaluate.METRICS])


def e6_by_slice(spark, d):
    return evaluate.by_slice(_scores(spark, d))


def e7_ranker_diff(spark, d):
    return evaluate.ranker_diff(_scores(spark, d), "bm25", "tfidf").select("qid", "slice", *[F.round(c, 6).alias(c) for c in ("rr_a", "rr_b", "delta")], "outcome")


def e7_totals(spark, d):
    return evaluate.diff_totals(evaluate.ranker_diff(_scores(spark, d), "bm25", "tfidf"))


def e7_most_changed(spark, d):
    return evaluate.most_changed(evaluate.ranker_diff(_scores(spark, d), "bm25", "tfidf"), 5).select("side", "qid", F.round("delta", 6).alias("delta"))


def e8_metric_deltas(spark, d):
    """The TF-IDF run as the newer one, under BM25's name."""
    means = evaluate.by_slice(_scores(spark, d))
    return evaluate.metric_deltas(means.where("ranker = 'bm25'"), means.where("ranker = 'tfidf'").withColumn("ranker", F.lit("bm25")))


def _two_runs(spark, d):
    """A run of two rankers over four fifths of the documents, and one over all; the documents are counted once for both."""
    docs, tokens = _texts(spark, d), lexical.query_tokens(t.queries(spark, d))
    docs = docs.counted(tokens) or docs
    return _runs(docs, tokens, 5, "doc_id % 5 <> 0"), _runs(docs, tokens, 5)


def e8_run_diff(spark, d):
    return evaluate.run_diff(*_two_runs(spark, d), t.qrels(spark, d))


def e8_displacement(spark, d):
    return evaluate.displacement(e8_run_diff(spark, d))


def _vocabulary(spark, d):
    return lexical.vocabulary(lexical.tokenized(t.documents(spark, d), F.col("text")))


def _typos(spark, d):
    """Query tokens with their last two letters swapped."""
    rows = lexical.query_tokens(t.queries(spark, d)).where("length(term) >= 4")
    return rows.select("qid", "pos", F.expr("concat(left(term, length(term) - 2), right(term, 1), substring(term, length(term) - 1, 1))").alias("term"))


def q7_spellfix(spark, d):
    return rewrite.corrections(_typos(spark, d), _vocabulary(spark, d)).drop("pos").withColumn("distance", F.col("distance").cast("long"))


def q9_guard(spark, d):
    q = t.queries(spark, d)
    tokens = _typos(spark, d)
    return rewrite.guard(q, tokens, _vocabulary(spark, d)).withColumn("unknown_terms", F.array_join("unknown_terms", " "))


RULES = [rewrite.Alias("the shortest path", "dijkstra algorithm", True), rewrite.Alias("bfs", "breadth first search"), rewrite.Alias("dp", "dynamic programming"), rewrite.Alias("two pointer", "sliding window", True)]


PHRASES = ("BFS  grid", "the shortest path in a graph", "two-pointer 3 sum", "dp", "breadth first search bfs", "shortest path dijkstra algorithm the shortest path")


def q1_expand(spark, d):
    """One of PHRASES before a passage: consuming, appending and idle rules, and numbers; passages that are too long stay as they are."""
    q = t.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.concat_ws(" ", F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("item_id") % len(PHRASES) + 1).cast("int")), F.array_join(T.tokenize("text"), " ")).alias("query"))
    return rewrite.expand(q, RULES).select("qid", "query", "expanded", F.array_join("added", " ").alias("added"), F.array_join("matches", ",").alias("matches"))


def _typed(spark, d):
    """Queries whose words of four letters and more have their last two letters swapped."""
    rows = _typos(spark, d).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]), " ").alias("query"))
    return rows


def q8_corrected(spark, d):
    return serve.serve(_texts(spark, d), _typed(spark, d), RULES, _vocabulary(spark, d))["rewritten"].select("qid", "query")


def q8_serve(spark, d):
    """Mistyped queries through the whole path, English documents only."""
    keep = facets.facet_filter(t.corpus(spark, d), {"en"})
    out = serve.serve(_texts(spark, d), _typed(spark, d), RULES, _vocabulary(spark, d), "bm25", keep)["hits"]
    return out.select("qid", F.col("rank").cast("long").alias("rank"), "doc_id", "score", "total")


QUERIES = {f.__name__: f for f in (r1_postings, r2_term_stats, r3_tfidf_top10, r5_bm25_top10, r5_bm25_page2, r13_bm25_explain, r15_index_dump, r19_title_bonus, r8_dense_top10, r9_similar, r14_dense_explain, r12_rrf, r13_tfidf_explain, r14_hybrid_explain, r14_hybrid_legs, r16_compare, r17_rank_delta, r5_stored_index, r18_ranker_pick, e1_e4_metrics, e6_by_slice, e7_ranker_diff, e7_totals, e7_most_changed, e8_run_diff, e8_displacement, e8_metric_deltas, q1_expand, q7_spellfix, q8_corrected, q8_serve, q9_guard)}

_DOT = "list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: z[1] * z[2]))"


def _dense_sql(k: int, other: str = "true", extra: str = "") -> str:
    return f"""SELECT qid, rank, doc_id, round(s, 6) AS score{extra} FROM (
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id) AS rank FROM (
            SELECT a.vec_id AS qid, b.vec_id AS doc_id, round({_DOT}, 9) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND {other}))
        WHERE rank <= {k}"""


_HYBRID = f"""{_ranked_sql('bm25', 'a', 100)},
    den AS (SELECT * FROM (SELECT qid, doc_id, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id) AS rank FROM (SELECT a.vec_id AS qid, b.vec_id AS doc_id, round({_DOT}, 9) AS s FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark))) WHERE rank <= 100),
    f AS (SELECT qid, doc_id, a.rank AS lex_rank, den.rank AS dense_rank, matched_terms, coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + den.rank), 0) AS s FROM a FULL JOIN den USING (qid, doc_id)),
    g AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(s, 12) DESC, lex_rank ASC NULLS LAST, doc_id) AS rank, doc_id, s, lex_rank, dense_rank, matched_terms, count(*) OVER (PARTITION BY qid) AS total FROM f)"""
_QRELS = "rel AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_SCORES = f"""{_BASE}, {_ranked_sql('bm25', 'a', 100)}, {_ranked_sql('tfidf', 'b', 100)}, {_QRELS},
    nr AS (SELECT qid, count(*) AS nr FROM rel GROUP BY qid),
    runs AS (SELECT 'bm25' AS ranker, qid, rank, doc_id FROM a UNION ALL SELECT 'tfidf', qid, rank, doc_id FROM b),
    hit AS (SELECT ranker, qid, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 5) AS h5, min(rank) AS f, sum(1 / log2(rank + 1)) FILTER (rank <= 10) AS dcg, count(*) AS found FROM runs JOIN rel USING (qid, doc_id) GROUP BY ALL),
    sc AS (SELECT ranker, qid, CASE WHEN qid % 2 = 0 THEN 'even' ELSE 'odd' END AS slice, coalesce(h1 / 1.0, 0) AS p_at_1, coalesce(h5 / 5.0, 0) AS p_at_5, coalesce(1.0 / f, 0) AS rr,
        coalesce(dcg / list_sum(list_transform(range(1, least(10, nr) + 1), lambda i: 1 / log2(i + 1))), 0) AS ndcg_10, coalesce(found / nr, 0) AS recall_100
        FROM nr CROSS JOIN (SELECT unnest(['bm25', 'tfidf']) AS ranker) LEFT JOIN hit USING (ranker, qid))"""
_R = "round({0}, 6) AS {0}"
_M = ", ".join(_R.format(m) for m in evaluate.METRICS)
_AVG = ", ".join(f"round(avg({m}), 6) AS {m}" for m in evaluate.METRICS)
_VOCAB = "v AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(toks) AS term FROM d) GROUP BY term)"
_TYPO = "ty AS (SELECT qid, pos, left(term, length(term) - 2) || right(term, 1) || substring(term, length(term) - 1, 1) AS term FROM qt WHERE length(term) >= 4)"

ORACLES = {
    "r1_postings": f"{_BASE} SELECT term, doc_id, tf FROM p",
    "r2_term_stats": f"{_BASE}, {_VOCAB} SELECT term, df, round(ln(n / df), 6) AS tfidf_idf, round({_IDF['bm25']}, 6) AS bm25_idf FROM v CROSS JOIN st",
    "r3_tfidf_top10": f"{_BASE}, {_ranked_sql('tfidf', 'a')} SELECT * FROM a",
    "r5_bm25_top10": f"{_BASE}, {_ranked_sql('bm25', 'a')} SELECT * FROM a",
    "r5_bm25_page2": f"{_BASE}, {_ranked_sql('bm25', 'a')} SELECT * FROM a_r WHERE rank BETWEEN 11 AND 20",
    "r13_bm25_explain": f"{_BASE}, {_ranked_sql('bm25', 'a')} SELECT qid, pos, term, doc_id, tf AS count, dl AS doc_length, round(0.25 + 0.75 * dl / avgdl, 6) AS norm, round(idf, 6) AS idf, round(contribution, 6) AS contribution FROM a_c",
    "r15_index_dump": f"{_BASE} SELECT term, count(*) AS df, string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id) AS postings FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM d) GROUP BY ALL) GROUP BY term",
    "r19_title_bonus": f"""WITH d AS (SELECT p_partkey AS doc_id, p_name, {_tok("p_name || ' ' || lower(replace(p_brand, '#', '-')) || ' ' || p_type")} AS toks FROM part),
        dl AS (SELECT doc_id, len(toks) AS dl FROM d), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
        q AS (SELECT min(p_partkey) AS qid, p_name, {_tok('p_name')} AS qt FROM part GROUP BY p_name),
        qt AS (SELECT qid, unnest(range(0, len(qt))) AS pos, unnest(qt) AS term FROM q),
        p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        c AS (SELECT *, {_WEIGHT['bm25']} AS w FROM (SELECT qid, pos, term, doc_id, tf, dl, avgdl, {_IDF['bm25']} AS idf FROM qt JOIN p USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st) WHERE idf > 0),
        s AS (SELECT qid, c.doc_id, sum(w) + max(CASE WHEN q.p_name = d.p_name THEN 1000 ELSE 0 END) AS score, min(pos) AS first_pos, string_agg(term, ' ' ORDER BY pos) AS matched_terms FROM c JOIN q USING (qid) JOIN d ON d.doc_id = c.doc_id GROUP BY ALL),
        r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, first_pos, doc_id) AS rank, doc_id, round(score, 6) AS score, matched_terms, count(*) OVER (PARTITION BY qid) AS total FROM s)
        SELECT * FROM r WHERE rank <= 10""",
    "r8_dense_top10": _dense_sql(10, extra=", (SELECT count(*) FROM embeddings) AS total"),
    "r14_hybrid_legs": f"{_BASE}, {_HYBRID} SELECT 'lexical' AS leg, qid, rank, doc_id, score FROM a WHERE rank <= 10 UNION ALL SELECT 'dense', qid, rank, doc_id, round(s, 6) FROM den WHERE rank <= 10",
    "r9_similar": _dense_sql(10, "a.vec_id <> b.vec_id"),
    "r14_dense_explain": _dense_sql(20, "true", ", round(round(degrees(acos(greatest(-1, least(1, round(s, 6))))), 4), 2) AS angle_deg"),
    "r12_rrf": f"{_BASE}, {_HYBRID} SELECT qid, rank, doc_id, round(s, 9) AS score, lex_rank, dense_rank, total, coalesce(matched_terms, '') AS matched_terms FROM g WHERE rank <= 10",
    "r14_hybrid_explain": f"{_BASE}, {_HYBRID} SELECT qid, rank, doc_id, lex_rank, dense_rank, round(coalesce(1.0 / (60 + lex_rank), 0), 9) AS lex_contribution, round(coalesce(1.0 / (60 + dense_rank), 0), 9) AS dense_contribution, round(s, 9) AS total FROM g WHERE rank <= 20",
    "r13_tfidf_explain": f"{_BASE}, {_ranked_sql('tfidf', 'a')} SELECT qid, pos, term, doc_id, tf AS count, dl AS doc_length, round(tf / dl, 6) AS tf, round(idf, 6) AS idf, round(contribution, 6) AS contribution FROM a_c",
    "r5_stored_index": f"{_BASE}, {_ranked_sql('bm25', 'a')} SELECT * FROM a",
    "r18_ranker_pick": f"""{_BASE}, {_HYBRID}, {_ranked_sql('tfidf', 'b')} SELECT 'bm25' AS ranker, qid, rank, doc_id, score FROM a WHERE rank <= 3 AND qid % 6 IN (0, 4, 5) UNION ALL SELECT 'tfidf', qid, rank, doc_id, score FROM b WHERE rank <= 3 AND qid % 6 = 1
        UNION ALL SELECT 'dense', qid, rank, doc_id, round(s, 6) FROM den WHERE rank <= 3 AND qid % 6 = 2 UNION ALL SELECT 'hybrid', qid, rank, doc_id, round(s, 6) FROM g WHERE rank <= 3 AND qid % 6 = 3""",
    "r16_compare": f"""{_BASE}, {_HYBRID}, {_ranked_sql('tfidf', 'b')} SELECT 'bm25' AS ranker, qid, rank, doc_id, score, false AS failed FROM a WHERE rank <= 10 UNION ALL SELECT 'tfidf', qid, rank, doc_id, score, false FROM b
        UNION ALL SELECT 'dense', qid, rank, doc_id, round(s, 6), false FROM den WHERE rank <= 10 UNION ALL SELECT 'hybrid', qid, rank, doc_id, round(s, 6), false FROM g WHERE rank <= 10 UNION ALL SELECT 'broken', NULL, NULL, NULL, NULL, true""",
    "r17_rank_delta": f"""{_BASE}, {_HYBRID} SELECT qid, doc_id, x.rank AS rank_a, y.rank AS rank_b,
        CASE WHEN x.rank IS NULL OR y.rank IS NULL THEN 'absent' WHEN x.rank = y.rank THEN 'same' WHEN y.rank < x.rank THEN 'up' ELSE 'down' END AS move FROM (SELECT * FROM a WHERE rank <= 10) x FULL JOIN (SELECT * FROM g WHERE rank <= 10) y USING (qid, doc_id)""",
    "e1_e4_metrics": f"{_SCORES} SELECT ranker, qid, slice, {_M} FROM sc",
    "e6_by_slice": f"{_SCORES} SELECT ranker, 'all' AS slice, count(*) AS n, {_AVG} FROM sc GROUP BY ranker UNION ALL SELECT ranker, slice, count(*), {_AVG} FROM sc GROUP BY ranker, slice",
    "e7_ranker_diff": f"""{_SCORES} SELECT qid, a.slice, round(a.rr, 6) AS rr_a, round(b.rr, 6) AS rr_b, round(b.rr - a.rr, 6) AS delta, CASE WHEN b.rr - a.rr > 1e-9 THEN 'win' WHEN b.rr - a.rr < -1e-9 THEN 'loss' ELSE 'tie' END AS outcome
        FROM (SELECT * FROM sc WHERE ranker = 'bm25') a JOIN (SELECT * FROM sc WHERE ranker = 'tfidf') b USING (qid)""",
    "q7_spellfix": f"""{_BASE}, {_VOCAB}, {_TYPO},
        u AS (SELECT qid, term, min(pos) AS pos FROM ty WHERE term NOT IN (SELECT term FROM v) GROUP BY ALL),
        w AS (SELECT DISTINCT term, CASE WHEN length(term) >= 8 THEN 2 ELSE 1 END AS budget FROM u),
        c AS (SELECT w.term, budget, v.term AS correction, df, damerau_levenshtein(w.term, v.term) AS distance FROM w JOIN v ON abs(length(w.term) - length(v.term)) <= budget AND df >= 3 AND (left(w.term, 1) = left(v.term, 1) OR right(w.term, 1) = right(v.term, 1))),
        b AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY distance, df DESC, correction) AS r FROM c WHERE distance <= budget)
        SELECT qid, term, correction, distance FROM (SELECT qid, u.term, correction, distance, row_number() OVER (PARTITION BY qid ORDER BY pos) AS k FROM u JOIN b ON u.term = b.term AND r = 1) WHERE k <= 2""",
    "q9_guard": f"""{_BASE}, {_VOCAB}, {_TYPO},
        m AS (SELECT qid, bool_and(df IS NULL) AS refused, list(term ORDER BY pos) FILTER (df IS NULL) AS unk FROM (SELECT qid, term, min(pos) AS pos, any_value(df) AS df FROM ty LEFT JOIN v USING (term) GROUP BY qid, term) GROUP BY qid)
        SELECT qid, coalesce(refused, false) AS refused, CASE WHEN refused THEN array_to_string(unk[1:5], ' ') ELSE '' END AS unknown_terms FROM q LEFT JOIN m USING (qid)""",
}
_E7 = ORACLES["e7_ranker_diff"]
ORACLES["e7_totals"] = f"SELECT count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'loss') AS losses, count(*) FILTER (outcome = 'tie') AS ties, round(avg(rr_a), 6) AS mean_a, round(avg(rr_b), 6) AS mean_b FROM ({_E7})"
ORACLES["e7_most_changed"] = f"WITH x AS ({_E7}) (SELECT 'win' AS side, qid, delta FROM x WHERE outcome = 'win' ORDER BY delta DESC, qid LIMIT 5) UNION ALL (SELECT 'loss', qid, delta FROM x WHERE outcome = 'loss' ORDER BY delta, qid LIMIT 5)"
ORACLES["e8_metric_deltas"] = f"WITH m AS ({ORACLES['e6_by_slice']}) SELECT 'bm25' AS ranker, a.slice, {', '.join(f'round(b.{m} - a.{m}, 6) AS {m}' for m in evaluate.METRICS)} FROM m a JOIN m b ON a.slice = b.slice AND a.ranker = 'bm25' AND b.ranker = 'tfidf'"
# by hand from the rules: what each phrase turns into before the passage's tokens, of which none but the phrases' own are in a rule
ORACLES["q1_expand"] = f"""WITH y AS (SELECT item_id AS qid, item_id % 6 AS i, array_to_string({_tok('text')}, ' ') AS w FROM benchmark),
    x AS (SELECT *, ['BFS  grid', 'the shortest path in a graph', 'two-pointer 3 sum', 'dp', 'breadth first search bfs', 'shortest path dijkstra algorithm the shortest path'][i + 1] || ' ' || w AS typed FROM y)
    SELECT qid, CASE WHEN length(typed) > 300 THEN typed ELSE CASE i WHEN 0 THEN 'bfs grid ' || w || ' breadth first search' WHEN 1 THEN 'in a graph ' || w || ' dijkstra algorithm' WHEN 2 THEN '3 sum ' || w || ' sliding window three' WHEN 3 THEN 'dp ' || w || ' dynamic programming'
        ELSE typed END END AS query, i < 4 AND length(typed) <= 300 AS expanded,
        CASE WHEN length(typed) > 300 THEN '' ELSE CASE i WHEN 0 THEN 'breadth first search' WHEN 1 THEN 'dijkstra algorithm' WHEN 2 THEN 'sliding window three' WHEN 3 THEN 'dynamic programming' ELSE '' END END AS added,
        CASE WHEN length(typed) > 300 THEN '' ELSE CASE i WHEN 0 THEN 'bfs' WHEN 1 THEN 'the shortest path' WHEN 2 THEN 'two pointer,3' WHEN 3 THEN 'dp' WHEN 4 THEN 'bfs' ELSE 'the shortest path' END END AS matches FROM x"""
_TYPED = f"""tq AS (SELECT qid, string_agg(term, ' ' ORDER BY pos) AS query FROM ty GROUP BY qid),
    tt AS (SELECT qid, unnest(range(0, len(x))) AS pos, unnest(x) AS term FROM (SELECT qid, {_tok('query')} AS x FROM tq)),
    tu AS (SELECT qid, term, min(pos) AS pos FROM tt WHERE length(term) >= 3 AND term NOT IN (SELECT term FROM v) GROUP BY ALL),
    tw AS (SELECT DISTINCT term, CASE WHEN length(term) >= 8 THEN 2 ELSE 1 END AS budget FROM tu),
    tc AS (SELECT tw.term, budget, v.term AS correction, df, damerau_levenshtein(tw.term, v.term) AS distance FROM tw JOIN v ON abs(length(tw.term) - length(v.term)) <= budget AND df >= 3 AND (left(tw.term, 1) = left(v.term, 1) OR right(tw.term, 1) = right(v.term, 1))),
    tb AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY distance, df DESC, correction) AS r FROM tc WHERE distance <= budget),
    tf2 AS (SELECT * FROM (SELECT qid, tu.pos, correction, row_number() OVER (PARTITION BY qid ORDER BY tu.pos) AS k FROM tu JOIN tb ON tu.term = tb.term AND r = 1) WHERE k <= 2),
    rq AS (SELECT qid, query || coalesce(' ' || more, '') AS query FROM tq LEFT JOIN (SELECT qid, string_agg(correction, ' ' ORDER BY pos) AS more FROM tf2 GROUP BY qid) USING (qid))"""
ORACLES["q8_corrected"] = f"{_BASE}, {_VOCAB}, {_TYPO}, {_TYPED} SELECT * FROM rq"
ORACLES["q8_serve"] = f"""{_BASE}, {_VOCAB}, {_TYPO}, {_TYPED}, rt AS (SELECT qid, unnest(range(0, len(x))) AS pos, unnest(x) AS term FROM (SELECT qid, {_tok('query')} AS x FROM rq)),
    rp AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM rt) GROUP BY ALL),
    rs AS (SELECT qid, doc_id, sum({_WEIGHT['bm25']}) AS score, min(pos) AS first_pos FROM (SELECT *, {_IDF['bm25']} AS idf FROM rt JOIN rp USING (term) JOIN v USING (term) JOIN dl USING (doc_id) CROSS JOIN st) GROUP BY ALL)
    SELECT qid, rank, doc_id, round(score, 6) AS score, total FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, first_pos, doc_id) AS rank, doc_id, score, count(*) OVER (PARTITION BY qid) AS total FROM rs JOIN documents USING (doc_id) WHERE lang = 'en') WHERE rank <= 10"""
def _old_sql(ranker: str, name: str) -> str:
    return f"""{name}_os AS (SELECT qid, doc_id, sum({_WEIGHT[ranker]}) AS score, min(pos) AS first_pos FROM (SELECT *, {_IDF[ranker]} AS idf FROM qt JOIN op USING (term) JOIN odf USING (term) JOIN odl USING (doc_id) CROSS JOIN ost) WHERE idf > 0 GROUP BY ALL),
    {name}_o AS (SELECT * FROM (SELECT '{ranker}' AS ranker, qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, first_pos, doc_id) AS rank FROM {name}_os) WHERE rank <= 5)"""


ORACLES["e8_run_diff"] = f"""{_BASE}, {_ranked_sql('bm25', 'a', 5)}, {_ranked_sql('tfidf', 'b', 5)}, {_QRELS},
    od AS (SELECT * FROM d WHERE doc_id % 5 <> 0), odl AS (SELECT doc_id, len(toks) AS dl FROM od), ost AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM odl),
    op AS (SELECT * FROM p WHERE doc_id % 5 <> 0), odf AS (SELECT term, count(*) AS df FROM op GROUP BY term), {_old_sql('bm25', 'x')}, {_old_sql('tfidf', 'y')},
    o AS (SELECT * FROM x_o UNION ALL SELECT * FROM y_o), w AS (SELECT 'bm25' AS ranker, qid, doc_id FROM a UNION ALL SELECT 'tfidf', qid, doc_id FROM b)
    SELECT ranker, qid, (SELECT count(*) FROM w WHERE w.ranker = k.ranker AND w.qid = k.qid) AS slots, (SELECT count(*) FROM w WHERE w.ranker = k.ranker AND w.qid = k.qid AND w.doc_id NOT IN (SELECT doc_id FROM o)) AS entered,
        (SELECT count(*) FROM o WHERE o.ranker = k.ranker AND o.qid = k.qid AND EXISTS (SELECT 1 FROM rel WHERE rel.qid = o.qid AND rel.doc_id = o.doc_id) AND NOT EXISTS (SELECT 1 FROM w WHERE w.ranker = o.ranker AND w.qid = o.qid AND w.doc_id = o.doc_id)) AS lost_relevant
    FROM (SELECT DISTINCT ranker, qid FROM o INTERSECT SELECT ranker, qid FROM w) k"""
ORACLES["e8_displacement"] = f"SELECT ranker, CAST(sum(entered) AS BIGINT) AS entered, CAST(sum(slots) AS BIGINT) AS slots, round(100.0 * sum(entered) / sum(slots), 1) AS share, count(*) FILTER (lost_relevant > 0) AS hurt FROM ({ORACLES['e8_run_diff']}) GROUP BY ranker"
