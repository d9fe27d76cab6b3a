"""Stored indexes, tables that are merged into, streams that keep state, and split files, over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import blockmax, dense, embed, facets, lexical, merkle, pivots, serve, state
from ..operators.common import scratch, staged
from ..sources import readers, writers
from ..sources.bucketed import BucketTable
from ..streaming import user_state
from . import browse, quality, search
from . import tables as t


def _folder(spark, name):
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _blocks(spark, d):
    build = lambda path: blockmax.BlockIndex.build(lexical.tokenized(t.documents(spark, d), F.col("text")), path)
    return blockmax.BlockIndex(spark, search.stored(spark, d, "blocks", build))


def r5_block_top10(spark, d):
    """The hits of ``r5_bm25_top10`` from an index of blocks with their largest contributions; most postings stay unread."""
    return search._flat(_blocks(spark, d).search(lexical.query_tokens(t.queries(spark, d)), "bm25"))


def r3_block_top10(spark, d):
    return search._flat(_blocks(spark, d).search(lexical.query_tokens(t.queries(spark, d)), "tfidf"))


def u1_state_stream(spark, d):
    """``u1_state_fold`` as a stream with keyed state, over changes in files of no order; the states are merged into a bucket table."""
    path = _folder(spark, "stream")
    changes = t.changes(spark, d).select("user_id", "problem_id", F.col("ts").cast("timestamp").alias("ts"), "seq", "kind", "value")
    changes.repartition(6, F.xxhash64("seq", "kind")).write.parquet(f"{path}/in")
    source = spark.readStream.schema(user_state.CHANGES).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    user_state.keep_table(source, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return BucketTable(spark, f"{path}/table").read().select("user_id", "problem_id", "done", F.col("done_at").cast("string").alias("done_at"), "bookmarked", F.col("bookmarked_at").cast("string").alias("bookmarked_at"), "recall", F.col("updated_at").cast("string").alias("updated_at"))


def k8_stored_upsert(spark, d):
    """Parts stored in buckets, then three merges: other statements, new parts, and some taken away."""
    p = t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("statement"), "p_size")
    table = BucketTable.create(p.where("id % 2 = 0"), _folder(spark, "k8"), "id", 16)
    table.upsert(p.where("id % 3 = 0").withColumn("statement", F.upper("statement")))
    table.upsert(p.where("id % 10 = 1"))
    table.delete(p.where("id % 7 = 0").select("id"))
    return table.read()


def k11_stored_owned(spark, d):
    """A stored sheet of which one column is ours: three merges update that alone, and append."""
    p = t.table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    table = BucketTable.create(p.where("p_partkey % 2 = 0"), _folder(spark, "k11"), "p_partkey", 16)
    for k in (3, 5, 7):
        table.merge_owned(p.where(F.col("p_partkey") % k == 0).select("p_partkey", F.lit("ours").alias("p_name"), (F.col("p_size") + 100 * k).cast("int").alias("p_size")), ["p_size"])
    return table.read()


def k8_untouched_buckets(spark, d):
    """Which buckets a merge of one part in fifty left as they were: those of which no part was merged."""
    p = t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    table = BucketTable.create(p, _folder(spark, "k8u"), "id", 4096)
    before = table.manifest()["folders"]
    new = p.where("id % 50 = 0").withColumn("p_size", F.lit(0))
    table.upsert(new)
    after = table.manifest()["folders"]
    same = spark.createDataFrame([(int(b), before[b] == after[b]) for b in before], "bucket int, same boolean")
    parts = p.withColumn("bucket", BucketTable.bucket("id", 4096))
    merged = parts.where("id % 50 = 0").select("bucket").distinct().withColumn("merged", F.lit(True))
    rows = parts.join(same, "bucket").join(merged, "bucket", "left")
    return rows.agg(F.count("*").alias("parts"), F.count_if(F.col("same") == F.col("merged").isNull()).alias("as_expected"))


def s4_raw_vectors(spark, d):
    """Vectors written as raw 32-bit floats and read back in splits of 4 KB, numbered in order of id."""
    path = _folder(spark, "s4")
    writers.write_raw_vectors(t.vectors(spark, d).select("doc_id", "vector"), path)
    rows = readers.read_vectors(spark, f"{path}/*.f32", 64, split_bytes=4096)
    return rows.select("row", *[F.round(F.col("vector")[i].cast("double"), 6).alias(f"v{i}") for i in (0, 31, 63)], F.size("vector").cast("long").alias("dims"))


def _embedded(spark, d):
    """Documents and the embedder fitted to them; vectors are stored, with the check of their length."""
    docs = staged(embed.counted(lexical.tokenized(t.documents(spark, d), F.col("text")), embed.FEATURES), "counted")
    model = embed.Embedder.fit(docs)
    path = _folder(spark, "vectors")
    writers.write_vectors(model.embedded(docs), path)
    return model, spark.read.parquet(path)


def r10_query_vectors(spark, d):
    """Benchmark queries as vectors of the embedder, and the documents next to them."""
    model, vectors = _embedded(spark, d)
    return dense.search(vectors, model.queries(t.queries(spark, d))).withColumn("rank", F.col("rank").cast("long"))


def r11_similar_texts(spark, d):
    """For every fiftieth document those whose vectors are next to its own."""
    _, vectors = _embedded(spark, d)
    return dense.similar(vectors, vectors.where("doc_id % 50 = 0")).withColumn("rank", F.col("rank").cast("long"))


def f13_route(spark, d):
    """Benchmark passages, every fifth left blank, through the whole route: one language, nothing done yet, hardest first."""
    own = state.fold(t.changes(spark, d)).where("user_id = 3").withColumnRenamed("problem_id", "doc_id").select("doc_id", "done", "bookmarked", "recall")
    docs = search._texts(spark, d)
    asked = t.queries(spark, d).withColumn("query", F.when(F.col("qid") % 5 == 0, " \t").otherwise(F.col("query")))
    words = lexical.vocabulary(lexical.tokenized(docs.docs, docs.text))
    known = staged(words.unionByName(lexical.query_tokens(asked).select("term", F.lit(1).cast("long").alias("df"))).groupBy("term").agg(F.sum("df").alias("df")), "vocabulary")  # nothing is corrected
    out = serve.serve_requests(docs, t.corpus(spark, d), asked, search.RULES, known, serve.Filters({"en"}, done="notdone"), own, sort="difficulty-desc", sortable={"en"})
    return out["hits"].select("qid", F.col("rank").cast("long").alias("rank"), "doc_id", "score", "total", "done", "bookmarked", "recall")


def s5_artifact(spark, d):
    """Raw vectors checked against a manifest and put in the documents' terms."""
    path, v = _folder(spark, "s5"), t.vectors(spark, d).select("doc_id", "vector")
    n = writers.write_raw_vectors(v, path)
    ids = v.select("doc_id").join(readers.read_vectors(spark, f"{path}/*.f32", 64).select("row"), F.col("doc_id") == F.col("row")).select("row", "doc_id")
    out = readers.checked_artifact(readers.read_vectors(spark, f"{path}/*.f32", 64), {"dims": 64, "count": n, "model": "given"}, v.select("doc_id"), ids, {"model": "given"})
    return out.select("doc_id", *[F.round(F.col("vector")[i].cast("double"), 6).alias(f"v{i}") for i in (1, 62)])


def c5_tree_drift(spark, d):
    """Drift of an artifact with its tree: some ranges of documents changed, went and came; only those are read."""
    path, corpus = _folder(spark, "merkle"), quality.t16_digest(spark, d)
    hit = F.floor(F.col("doc_id") / 64) % 5 == 1
    other = corpus.where(~hit | (F.col("doc_id") % 50 != 7)).withColumn("digest", F.when(hit & (F.col("doc_id") % 40 == 1), "x").otherwise(F.col("digest"))).withColumn("doc_id", F.when(hit & (F.col("doc_id") % 9 == 3), F.col("doc_id") + 10**9).otherwise(F.col("doc_id")))
    a, b = merkle.Artifact.write(corpus, f"{path}/a"), merkle.Artifact.write(other, f"{path}/b")
    return merkle.drift(a, b, f"{path}/nodes")


def t16_tree_digest(spark, d):
    """The digest at the top of the tree is that of all records."""
    path = _folder(spark, "merkle")
    top = merkle.Artifact.write(quality.t16_digest(spark, d).withColumn("doc_id", F.col("doc_id") - 100), path).digest()
    return top.select("n", F.col("h1").cast("string").alias("h1"), F.col("h2").cast("string").alias("h2"))


def s14_wanted_rows(spark, d):
    """Parts in a paged store; the small ones of a stretch are wanted, and only their pages read."""
    path, p = _folder(spark, "s14"), t.table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 3).alias("offset"), "p_name", "p_size")
    readers.write_pages(rows, path)
    return readers.read_wanted(spark, path, rows.where("p_size < 20 AND id % 1000 BETWEEN 100 AND 160"))


def r8_pivot_top10(spark, d):
    """``r8_dense_top10`` from blocks that pivots rule out."""
    v = t.vectors(spark, d)
    index = pivots.PivotIndex.build(v, _folder(spark, "pivots"))
    return index.search(v.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "vector")).withColumn("rank", F.col("rank").cast("long"))


QUERIES = {f.__name__: f for f in (r5_block_top10, r3_block_top10, u1_state_stream, k8_stored_upsert, k11_stored_owned, k8_untouched_buckets, s4_raw_vectors, r10_query_vectors, r11_similar_texts, c5_tree_drift, t16_tree_digest, s14_wanted_rows, r8_pivot_top10, f13_route, s5_artifact)}

_TOP = "SELECT qid, rank, doc_id, score, matched_terms FROM a"
ORACLES = {
    "f13_route": f"""{search._BASE}, {search._ranked_sql('bm25', 'a')}, {browse._FOLD}, {t.CORPUS_SQL}, mine AS (SELECT problem_id, done, bookmarked, recall FROM us WHERE user_id = 3),
        ch2 AS (SELECT * FROM corpus WHERE platform = 'en' AND doc_id NOT IN (SELECT problem_id FROM mine WHERE done)),
        f AS (SELECT qid, doc_id, s.score, row_number() OVER (PARTITION BY qid ORDER BY round(s.score, 9) DESC, first_pos, doc_id) AS rank, count(*) OVER (PARTITION BY qid) AS total FROM a_s s SEMI JOIN ch2 USING (doc_id) WHERE qid % 5 <> 0),
        r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY {browse._KEY0} DESC NULLS LAST, -acceptance DESC NULLS LAST, rank) AS rank, doc_id, round(score, 6) AS score, total FROM f JOIN corpus USING (doc_id) WHERE rank <= 10),
        b AS (SELECT item_id AS qid, rank, doc_id, 0.0 AS score, total FROM benchmark CROSS JOIN (SELECT doc_id, row_number() OVER (ORDER BY {browse._KEY0} DESC NULLS LAST, -acceptance DESC NULLS LAST, doc_id) AS rank, count(*) OVER () AS total FROM ch2) WHERE rank <= 10 AND item_id % 5 = 0)
        SELECT x.*, coalesce(done, false) AS done, coalesce(bookmarked, false) AS bookmarked, recall FROM (SELECT * FROM r UNION ALL SELECT * FROM b) x LEFT JOIN mine ON doc_id = problem_id""",
    "s5_artifact": "SELECT vec_id AS doc_id, round(embedding[2]::DOUBLE, 6) AS v1, round(embedding[63]::DOUBLE, 6) AS v62 FROM embeddings",
    "c5_tree_drift": """WITH x AS (SELECT doc_id, doc_id // 64 % 5 = 1 AS hit FROM documents) SELECT doc_id, 'missing' AS fault FROM x WHERE hit AND (doc_id % 50 = 7 OR doc_id % 9 = 3)
        UNION ALL SELECT doc_id + 1000000000, 'extra' FROM x WHERE hit AND doc_id % 50 <> 7 AND doc_id % 9 = 3 UNION ALL SELECT doc_id, 'changed' FROM x WHERE hit AND doc_id % 50 <> 7 AND doc_id % 9 <> 3 AND doc_id % 40 = 1""",
    "t16_tree_digest": f"SELECT count(*) AS n, sum(('0x' || substr(h, 1, 15))::HUGEINT)::VARCHAR AS h1, sum(('0x' || substr(h, 16, 15))::HUGEINT)::VARCHAR AS h2 FROM (SELECT sha256({quality._DIG}) AS h FROM documents)",
    "s14_wanted_rows": "SELECT p_partkey * 3 // 100 AS page, p_partkey AS id, p_partkey * 3 AS offset, p_name, p_size FROM part WHERE p_size < 20 AND p_partkey % 1000 BETWEEN 100 AND 160",
    "r8_pivot_top10": search._dense_sql(10),
    "r5_block_top10": f"{search._BASE}, {search._ranked_sql('bm25', 'a')} {_TOP}",
    "r3_block_top10": f"{search._BASE}, {search._ranked_sql('tfidf', 'a')} {_TOP}",
    "u1_state_stream": browse.ORACLES["u1_state_fold"],
    "k8_stored_upsert": "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 10 <> 1 THEN upper(p_name) ELSE p_name END AS statement, p_size FROM part WHERE (p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 10 = 1) AND p_partkey % 7 <> 0",
    "k11_stored_owned": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'ours' END AS p_name, CASE WHEN p_partkey % 7 = 0 THEN p_size + 700 WHEN p_partkey % 5 = 0 THEN p_size + 500 WHEN p_partkey % 3 = 0 THEN p_size + 300 ELSE p_size END AS p_size
        FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0 OR p_partkey % 7 = 0""",
    "k8_untouched_buckets": "SELECT count(*) AS parts, count(*) AS as_expected FROM part",
    "s4_raw_vectors": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, round(embedding[1]::DOUBLE, 6) AS v0, round(embedding[32]::DOUBLE, 6) AS v31, round(embedding[64]::DOUBLE, 6) AS v63, len(embedding) AS dims FROM embeddings",
}
