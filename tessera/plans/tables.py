"""The driver's tables in the engine's terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators.common import bounded_broadcast, staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def corpus(spark, sf_dir) -> DataFrame:
    """Documents as a labelled corpus: language is the platform, source the pattern; English has tiers, German and French ratings, Spanish nothing."""
    n = F.col("n_chars")
    tier = F.when(F.col("lang") == "en", F.when(n < 800, "Easy").when(n < 2500, "Medium").otherwise("Hard"))
    return documents(spark, sf_dir).select(
        "doc_id", F.col("lang").alias("platform"), F.array("source").alias("patterns"), tier.alias("tier"),
        F.when(F.col("lang").isin("de", "fr") & (n % 7 != 0), n).cast("long").alias("rating"), F.when(F.col("lang") == "en", F.round(n % 1000 / 10.0, 1)).alias("acceptance"))


CORPUS_SQL = """corpus AS (
    SELECT doc_id, lang AS platform, source AS pattern,
           CASE WHEN lang = 'en' THEN CASE WHEN n_chars < 800 THEN 'Easy' WHEN n_chars < 2500 THEN 'Medium' ELSE 'Hard' END END AS tier,
           CASE WHEN lang IN ('de', 'fr') AND n_chars % 7 <> 0 THEN n_chars END AS rating,
           CASE WHEN lang = 'en' THEN round((n_chars % 1000) / 10.0, 1) END AS acceptance
    FROM documents)"""


def queries(spark, sf_dir) -> DataFrame:
    """The tokens of each benchmark passage."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(T.tokenize("text"), " ").alias("query"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("slice"))


def qrels(spark, sf_dir) -> DataFrame:
    return containing(documents(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage")))


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``qid, doc_id``: documents that hold a passage letter for letter.

    The inner words of a passage are whole words of any document that holds it. So the
    longest of them leads from a passage to the few documents that have it, and in
    those the passage itself is sought. Passages without inner words are sought in
    every document.
    """
    words = F.split("passage", r"[ \n]+")
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    passages = passages.where("passage <> ''").withColumn("word", longest)
    seen = docs.select("doc_id", F.explode(F.split("text", r"[ \n]+")).alias("word"))
    near = staged(seen.join(bounded_broadcast(passages.where("word IS NOT NULL").select("qid", "word")), "word").select("qid", "doc_id").distinct(), "near")
    sought = lambda rows: rows.where(F.col("text").contains(F.col("passage"))).select("qid", "doc_id")
    out = sought(docs.select("doc_id", "text").join(bounded_broadcast(near), "doc_id").join(bounded_broadcast(passages.select("qid", "passage")), "qid"))
    short = passages.where("word IS NULL").select("qid", "passage")
    if not short.isEmpty():
        out = out.unionByName(sought(docs.select("doc_id", "text").crossJoin(bounded_broadcast(short))))
    return out.distinct()


def events(spark, sf_dir) -> DataFrame:
    """The event table as telemetry; ``k`` and ``value`` stand for the properties, and errors for four more types."""
    kind = F.create_map(*[F.lit(x) for kv in (("view", "visit"), ("click", "open"), ("purchase", "search"), ("signup", "signup")) for x in kv])
    k = F.get_json_object("props", "$.k").try_cast("int")
    other = F.element_at(F.array(*[F.lit(x) for x in ("boot", "bookmark", "done", "feedback")]), k % 4 + 1)
    props = F.to_json(F.struct(
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("latencyMs"), F.element_at(F.array(F.lit("bm25"), F.lit("tfidf"), F.lit("dense")), k % 3 + 1).alias("ranker"),
        F.when(F.col("event_type") == "click", k).alias("position"), F.when(F.col("event_type") == "click", k % 2 == 0).alias("external"), F.when(F.col("event_type") == "error", F.col("value")).alias("ms"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("q"), k.cast("string"))).alias("q"), F.when(F.col("event_type") == "purchase", F.floor(F.col("value") / 10).cast("int")).alias("total"),
        F.when(F.col("event_type") == "error", k % 8 < 4).alias("on"), F.when(F.col("event_type") == "error", k % 8 < 4).alias("useful"), F.when((F.col("event_type") == "error") & (k % 3 > 0), F.concat(F.lit("because "), k.cast("string"))).alias("reason")))
    return table(spark, sf_dir, "events").select("event_id", "ts", F.coalesce(F.try_element_at(kind, F.col("event_type")), other).alias("type"), F.col("user_id").cast("string").alias("visitor"), "user_id", props.alias("props"))


AS_OF = "2024-01-20 00:00:00"

EVENTS_SQL = """e AS (
    SELECT event_id, ts, user_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k,
           CASE event_type WHEN 'view' THEN 'visit' WHEN 'click' THEN 'open' WHEN 'purchase' THEN 'search' WHEN 'signup' THEN 'signup' ELSE ['boot', 'bookmark', 'done', 'feedback'][CAST(json_extract_string(props, '$.k') AS INT) % 4 + 1] END AS type,
           ['bm25', 'tfidf', 'dense'][CAST(json_extract_string(props, '$.k') AS INT) % 3 + 1] AS ranker
    FROM events)"""


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


def changes(spark, sf_dir) -> DataFrame:
    """Order lines as state changes: the customer's flags and recalls on parts."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = l.join(o, l["l_orderkey"] == o["o_orderkey"])
    kind = F.when(F.col("l_returnflag") == "A", "done").when(F.col("l_returnflag") == "N", "bookmarked").otherwise("recall")
    value = F.when(F.col("l_returnflag") == "R", F.element_at(F.array(*[F.lit(x) for x in ("again", "hard", "medium", "easy", "none")]), (F.col("l_linenumber") % 5 + 1).cast("int"))).otherwise(F.when(F.col("l_linestatus") == "O", "true").otherwise("false"))
    seq = F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_linenumber") * 10 + F.when(F.col("l_linestatus") == "O", 1).otherwise(0)
    return rows.select((F.col("o_custkey") % 40).alias("user_id"), (F.col("l_partkey") % 50).alias("problem_id"), F.col("l_shipdate").alias("ts"), seq.alias("seq"), kind.alias("kind"), value.alias("value"))


CHANGES_SQL = """ch AS (
    SELECT o_custkey % 40 AS user_id, l_partkey % 50 AS problem_id, l_shipdate AS ts,
           l_orderkey * 100000000 + l_partkey * 1000 + l_linenumber * 10 + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS seq,
           CASE l_returnflag WHEN 'A' THEN 'done' WHEN 'N' THEN 'bookmarked' ELSE 'recall' END AS kind,
           CASE WHEN l_returnflag = 'R' THEN ['again', 'hard', 'medium', 'easy', 'none'][l_linenumber % 5 + 1] ELSE CASE WHEN l_linestatus = 'O' THEN 'true' ELSE 'false' END END AS value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def parts(spark, sf_dir) -> DataFrame:
    """Parts as titled records."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), F.lower(F.regexp_replace("p_brand", "#", "-")).alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


def submissions(spark, sf_dir) -> DataFrame:
    """Purchases and clicks as submissions."""
    e = table(spark, sf_dir, "events")
    return e.where("event_type in ('purchase', 'click')").select("user_id", F.col("event_id").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch"), (F.col("event_type") == "purchase").alias("ok"), F.get_json_object("props", "$.k").alias("problem_id"), F.col("value").alias("rating"))
