"""Per-user state as folds of a change log.

Changes have ``user_id, problem_id, ts, seq, kind, value``: kind ``done`` or
``bookmarked`` with value ``true`` or ``false``, or kind ``recall`` with again,
hard, medium, easy or none. (ts, seq) orders them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import facets

RECALL = ("again", "hard", "medium", "easy")
HANDLE_TTL_HOURS, REFRESH_FLOOR_MINUTES = 12, 10


def fold(changes: DataFrame) -> DataFrame:
    """``user_id, problem_id, done, done_at, bookmarked, bookmarked_at, recall, updated_at``.

    The last change of each flag holds. A row exists as long as a flag or a recall
    holds it up. A recall changes a row that exists and does nothing otherwise: with
    a flag set it always applies; without one, ``none`` leaves no recall either way,
    and another value applies if the row is held up by a recall, which is so if the
    last change that was not of this last kind set one. Rows that don't exist aren't
    returned.
    """
    key = ["user_id", "problem_id"]
    order = F.struct("ts", "seq")
    seen = Window.partitionBy(*key).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda k: F.last(F.when(F.col("kind") == k, F.col("value")), ignorenulls=True).over(seen)
    rows = changes.withColumns({"d": F.coalesce(last("done") == "true", F.lit(False)), "b": F.coalesce(last("bookmarked") == "true", F.lit(False))})
    recall = F.col("kind") == "recall"
    sure = recall & (F.col("d") | F.col("b") | (F.col("value") == "none"))
    rows = rows.withColumn("held", F.coalesce(F.last(F.when(sure, F.col("value")), ignorenulls=True).over(seen) != "none", F.lit(False)))
    latest = rows.where(~recall | F.col("d") | F.col("b") | (F.col("value") == "none") | F.col("held")).groupBy(*key).agg(
        F.max_by("value", F.when(F.col("kind") == "done", order)).alias("done_value"), F.max(F.when(F.col("kind") == "done", F.col("ts"))).alias("done_ts"),
        F.max_by("value", F.when(F.col("kind") == "bookmarked", order)).alias("bookmarked_value"), F.max(F.when(F.col("kind") == "bookmarked", F.col("ts"))).alias("bookmarked_ts"),
        F.max_by("value", F.when(recall, order)).alias("recall_value"), F.max("ts").alias("updated_at"))
    on = lambda k: F.coalesce(F.col(f"{k}_value") == "true", F.lit(False))
    out = latest.select(
        *key, on("done").alias("done"), F.when(on("done"), F.col("done_ts")).alias("done_at"), on("bookmarked").alias("bookmarked"),
        F.when(on("bookmarked"), F.col("bookmarked_ts")).alias("bookmarked_at"), F.nullif("recall_value", F.lit("none")).alias("recall"), "updated_at")
    return out.where("done or bookmarked or recall is not null")


def view_ts(view: str) -> Column:
    """The time a view shows: when done, when bookmarked, or the first of the two that is there."""
    return {"done": F.col("done_at"), "bookmarked": F.col("bookmarked_at")}.get(view, F.coalesce("done_at", "bookmarked_at"))


def library(state: DataFrame, corpus: DataFrame, view: str = "all", recall: str | None = None, aged_before: str | None = None, by_difficulty: str | None = None, oldest_first: bool = False, done: str = "all", platforms: set[str] | None = None, difficulty: Column | None = None) -> DataFrame:
    """Problems that are done or bookmarked and still in the corpus, newest first, oldest first, or by difficulty.

    ``aged_before``: only those whose time is that or earlier; a missing time is left
    out. ``done``: ``done`` or ``notdone`` within the view. ``platforms`` and
    ``difficulty`` are facets of the corpus as in a search.
    """
    rows = state.where("done or bookmarked")
    if view in ("done", "bookmarked"):
        rows = rows.where(F.col(view))
    if done in ("done", "notdone"):
        rows = rows.where(F.col("done") if done == "done" else ~F.col("done"))
    if recall:
        rows = rows.where(F.coalesce("recall", F.lit("none")) == recall)
    rows = rows.withColumn("view_ts", view_ts(view))
    if aged_before:
        rows = rows.where(F.col("view_ts") <= F.lit(aged_before).cast("timestamp_ntz"))
    rows = rows.join(facets.facet_filter(corpus, platforms, difficulty=difficulty).withColumnRenamed("doc_id", "problem_id"), "problem_id")
    sort_ts = F.coalesce(F.col("bookmarked_at") if view == "bookmarked" else F.col("done_at"), F.col("updated_at"))
    by_time = [sort_ts.asc_nulls_last() if oldest_first else sort_ts.desc_nulls_last(), F.col("problem_id")]
    order = [*facets.difficulty_order(by_difficulty == "desc", "problem_id")[:2], *by_time] if by_difficulty else by_time
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))


def sets(state: DataFrame) -> DataFrame:
    """``user_id, done, bookmarked`` as sorted lists."""
    return state.groupBy("user_id").agg(*[F.array_sort(F.collect_list(F.when(F.col(k), F.col("problem_id")))).alias(k) for k in ("done", "bookmarked")])


def set_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("user_id").agg(F.count_if("done").alias("done"), F.count_if("bookmarked").alias("bookmarked"), F.count_if(F.col("recall").isNotNull()).alias("recalled"))


def handles(changes: DataFrame) -> DataFrame:
    """``user_id, platform, handle``: the last of each; a null handle deletes."""
    return changes.groupBy("user_id", "platform").agg(F.max_by("handle", F.struct("ts", "seq")).alias("handle")).where("handle is not null")


def invalidate(cache: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Cached profiles whose handle is unchanged."""
    same = before.join(after, ["user_id", "platform", "handle"], "left_semi").select("user_id", "platform")
    return cache.join(same, ["user_id", "platform"], "left_semi")


def served(cache: DataFrame, fetched: DataFrame, as_of: str) -> DataFrame:
    """``user_id, platform, payload, stale``: a fresh entry as it is; an old one renewed by ``fetched`` (payload null where fetching failed), or served stale.

    Entries that are neither there nor fetched are absent.
    """
    old = cache_status(cache, as_of).select("user_id", "platform", F.col("payload").alias("_old"), (F.col("status") == "fresh").alias("_fresh"))
    new = fetched.where("payload is not null").select("user_id", "platform", F.col("payload").alias("_new"))
    both = old.join(new, ["user_id", "platform"], "full")
    keep = F.coalesce("_fresh", F.lit(False)) | F.col("_new").isNull()
    return both.select("user_id", "platform", F.when(keep, F.col("_old")).otherwise(F.col("_new")).alias("payload"), (keep & ~F.col("_fresh")).alias("stale"))


def cache_status(cache: DataFrame, as_of: str) -> DataFrame:
    """``fresh``, ``stale``, and whether a refresh may run."""
    age = F.expr(f"timestampdiff(MINUTE, fetched_at, timestamp_ntz'{as_of}')")
    return cache.withColumn("status", F.when(age < HANDLE_TTL_HOURS * 60, "fresh").otherwise("stale")).withColumn("may_refresh", age >= REFRESH_FLOOR_MINUTES)
