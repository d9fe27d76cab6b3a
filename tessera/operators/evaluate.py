"""Retrieval evaluation: runs against relevance judgements, and runs against runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _gain(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1)


def per_query(runs: DataFrame, qrels: DataFrame, queries: DataFrame, rankers: list[str], window: int = 100) -> DataFrame:
    """``ranker, qid, slice, p_at_1, p_at_5, rr, ndcg_10, recall_100`` for each of the rankers named and each judged query.

    Precision divides by k, not by the number of hits. Queries without hits score 0.
    """
    relevant = qrels.groupBy("qid").agg(F.count("*").alias("n_relevant"))
    judged = queries.select("qid", "slice").join(relevant, "qid").withColumn("ranker", F.explode(F.array(*[F.lit(r) for r in rankers])))
    hits = runs.where(F.col("rank") <= window).join(qrels.select("qid", "doc_id"), ["qid", "doc_id"]).groupBy("ranker", "qid").agg(
        F.count_if(F.col("rank") <= 1).alias("h1"), F.count_if(F.col("rank") <= 5).alias("h5"), F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= 10, _gain(F.col("rank")))).alias("dcg"), F.count("*").alias("found"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("n_relevant")).cast("int")), F.lit(0.0), lambda s, i: s + _gain(i))
    return judged.join(hits, ["ranker", "qid"], "left").select(
        "ranker", "qid", "slice", F.coalesce(F.col("h1") / 1.0, F.lit(0.0)).alias("p_at_1"), F.coalesce(F.col("h5") / 5.0, F.lit(0.0)).alias("p_at_5"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg_10"),
        F.coalesce(F.col("found") / F.col("n_relevant"), F.lit(0.0)).alias("recall_100"))


METRICS = ("p_at_1", "p_at_5", "rr", "ndcg_10", "recall_100")


def by_slice(scores: DataFrame) -> DataFrame:
    """Means for each ranker, over all queries and by slice, in one pass of grouping sets."""
    rows = scores.groupingSets([["ranker"], ["ranker", "slice"]], "ranker", "slice").agg(F.grouping("slice").alias("g"), F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS])
    return rows.select("ranker", F.when(F.col("g") == 1, "all").otherwise(F.col("slice")).alias("slice"), "n", *METRICS)


def nearest_rank(values: Column, p: float) -> Column:
    """The value at rank ceil(p n)."""
    return F.percentile_disc(p, values) if hasattr(F, "percentile_disc") else F.element_at(F.array_sort(F.collect_list(values)), F.greatest(F.ceil(F.count(values) * p).cast("int"), F.lit(1)))


def ranker_diff(scores: DataFrame, a: str, b: str) -> DataFrame:
    """``qid, slice, rr_a, rr_b, delta, outcome`` of b against a."""
    x = scores.where(F.col("ranker") == a).select("qid", "slice", F.col("rr").alias("rr_a"))
    y = scores.where(F.col("ranker") == b).select("qid", F.col("rr").alias("rr_b"))
    delta = F.col("rr_b") - F.col("rr_a")
    return x.join(y, "qid").withColumn("delta", delta).withColumn("outcome", F.when(delta > 1e-9, "win").when(delta < -1e-9, "loss").otherwise("tie"))


def diff_totals(diff: DataFrame) -> DataFrame:
    """One row of ``ranker_diff``'s wins, losses, ties and mean reciprocal ranks."""
    of = lambda x: F.count_if(F.col("outcome") == x)
    return diff.agg(of("win").alias("wins"), of("loss").alias("losses"), of("tie").alias("ties"), F.round(F.avg("rr_a"), 6).alias("mean_a"), F.round(F.avg("rr_b"), 6).alias("mean_b"))


def most_changed(diff: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest gains and the ``n`` largest losses, with ``side``."""
    part = lambda side, order: diff.where(F.col("outcome") == side).orderBy(order, "qid").limit(n).withColumn("side", F.lit(side))
    return part("win", F.desc("delta")).unionByName(part("loss", F.asc("delta")))


def metric_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """``ranker, slice`` and each metric's change between two tables of ``by_slice``."""
    old = before.select("ranker", "slice", *[F.col(m).alias(f"old_{m}") for m in METRICS])
    return after.join(old, ["ranker", "slice"]).select("ranker", "slice", *[F.round(F.col(m) - F.col(f"old_{m}"), 6).alias(m) for m in METRICS])


def run_diff(before: DataFrame, after: DataFrame, qrels: DataFrame, top: int = 5) -> DataFrame:
    """``ranker, qid, slots, entered, lost_relevant`` for each ranker and query of both runs (``ranker, qid, rank, doc_id``).

    ``entered``: slots of the new run's top taken by documents that no ranker and no query of the
    old run showed there; ``lost_relevant``: judged documents that left the query's top.
    """
    old, new = before.where(F.col("rank") <= top), after.where(F.col("rank") <= top)
    seen = old.select("doc_id").distinct()
    asked = before.select("ranker", "qid").distinct().join(after.select("ranker", "qid").distinct(), ["ranker", "qid"])
    slots = new.join(seen.withColumn("seen", F.lit(True)), "doc_id", "left").groupBy("ranker", "qid").agg(F.count("*").alias("slots"), F.count_if(F.col("seen").isNull()).alias("entered"))
    judged = old.join(qrels.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi")
    lost = judged.join(new.select("ranker", "qid", "doc_id"), ["ranker", "qid", "doc_id"], "left_anti").groupBy("ranker", "qid").agg(F.count("*").alias("lost_relevant"))
    return asked.join(slots, ["ranker", "qid"], "left").join(lost, ["ranker", "qid"], "left").fillna(0, ["slots", "entered", "lost_relevant"])


def displacement(diff: DataFrame) -> DataFrame:
    """``ranker, entered, slots, share``: how much of each ranker's top is new since the old run, in percent, and ``hurt``: queries that lost a judged document."""
    rows = diff.groupBy("ranker").agg(F.sum("entered").alias("entered"), F.sum("slots").alias("slots"), F.count_if(F.col("lost_relevant") > 0).alias("hurt"))
    return rows.select("ranker", "entered", "slots", F.round(F.coalesce(F.try_divide(100 * F.col("entered"), F.col("slots")), F.lit(0.0)), 1).alias("share"), "hurt")


#: Official tags and the labels that mean the same. Fixed values.
EQUIVALENTS: dict[str, list[str]] = {
    "binary search": ["binary-search", "binary-search-answer"],
    "bitmasks": ["bitmask", "bitmask-dp", "bit-manipulation"],
    "combinatorics": ["combinatorics"],
    "constructive algorithms": ["constructive-algorithm"],
    "dfs and similar": ["dfs", "depth-first-search"],
    "dp": ["dynamic-programming"],
    "dsu": ["union-find"],
    "flows": ["max-flow", "min-cut", "min-cost-flow"],
    "geometry": ["geometry"],
    "graph matchings": ["bipartite-matching"],
    "graphs": ["graph"],
    "greedy": ["greedy"],
    "hashing": ["rolling-hash", "hashing"],
    "math": ["math"],
    "number theory": ["number-theory"],
    "probabilities": ["probability-dp", "probability"],
    "shortest paths": ["shortest-path", "dijkstra", "bellman-ford"],
    "sortings": ["sorting"],
    "strings": ["string"],
    "trees": ["tree"],
    "two pointers": ["two-pointers"],
}


def with_equivalents(mine: DataFrame, equivalents: dict[str, list[str]] | None = None) -> DataFrame:
    """Our labels (doc_id, tag) in the terms of official tags: each tag that counts a label as meaning the same. Others go."""
    pairs = mine.sparkSession.createDataFrame([(x, tag) for tag, labels in (EQUIVALENTS if equivalents is None else equivalents).items() for x in labels], "tag string, official string")
    return mine.join(F.broadcast(pairs), "tag").select("doc_id", F.col("official").alias("tag")).distinct()  # a table kept by hand


def macro_means(agreement: DataFrame) -> DataFrame:
    """One row: mean precision and recall over tags, each tag counting once."""
    return agreement.agg(F.round(F.avg("precision"), 6).alias("macro_precision"), F.round(F.avg("recall"), 6).alias("macro_recall"), F.count("*").alias("tags"))


def label_agreement(gold: DataFrame, mine: DataFrame, min_support: int = 1) -> DataFrame:
    """``tag, gold, mine, hit, precision, recall, low_recall, low_precision`` from (doc_id, tag) tables.

    Records with an official tag are the frame: one without a label of ours is a miss,
    labels of other records don't count.
    """
    g = gold.select("doc_id", "tag").distinct().withColumn("g", F.lit(1))
    m = mine.select("doc_id", "tag").distinct().join(gold.select("doc_id"), "doc_id", "left_semi").withColumn("m", F.lit(1))
    rows = g.join(m, ["doc_id", "tag"], "full").groupBy("tag").agg(F.count("g").alias("gold"), F.count("m").alias("mine"), F.count(F.col("g") + F.col("m")).alias("hit"))
    p, r = F.round(F.coalesce(F.try_divide("hit", "mine"), F.lit(0.0)), 6), F.round(F.try_divide("hit", "gold"), 6)
    return rows.where((F.col("gold") >= min_support) & (F.col("gold") > 0)).select("tag", "gold", "mine", "hit", p.alias("precision"), r.alias("recall"), (r < 0.6).alias("low_recall"), (p < 0.5).alias("low_precision"))
