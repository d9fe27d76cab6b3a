"""Statistics over the event log, solving calendars and heat maps.

Events have ``event_id, ts, type, visitor, user_id, props`` (JSON). Times are
compared with an explicit ``as_of``; nothing reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from .common import bounded_broadcast


def prop(name: str, kind: str = "string") -> Column:
    x = F.get_json_object("props", f"$.{name}")
    return x if kind == "string" else x.try_cast(kind)


def within(days: int, as_of: str) -> Column:
    return F.col("ts") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")


def cards(events: DataFrame, as_of: str) -> DataFrame:
    """One row with the counters of the overview, in one pass: visitors, searches, signups, boots, opens, sets, feedback."""
    day, week = within(1, as_of), within(7, as_of)
    of = lambda t: F.col("type") == t
    on = prop("on") == "true"
    return events.agg(
        F.count_distinct(F.when(of("visit") & day, F.col("visitor"))).alias("visitors_day"),
        F.count_distinct(F.when(of("visit") & week, F.col("visitor"))).alias("visitors_week"),
        F.count_distinct(F.when(of("visit"), F.col("visitor"))).alias("visitors_total"),
        F.count_if(of("search") & week).alias("searches_week"), F.count_if(of("search")).alias("searches_total"),
        F.count_if(of("signup") & week).alias("signups_week"), F.count_if(of("signup")).alias("signups_total"),
        F.count_if(of("boot") & week).alias("boots_week"), F.round(F.avg(F.when(of("boot") & week, prop("ms", "double"))), 0).alias("boot_ms"),
        F.count_if(of("open")).alias("opens_total"), F.count_if(of("open") & (prop("external") == "true")).alias("opens_external"),
        F.round(F.avg(F.when(of("open"), prop("position", "double"))), 1).alias("open_position"),
        F.count_if(of("bookmark") & on).alias("bookmarks_set"), F.count_if(of("done") & on).alias("done_set"),
        F.count_if(of("feedback") & (prop("useful") == "true")).alias("feedback_useful"), F.count_if(of("feedback") & (prop("useful") == "false")).alias("feedback_not"))


def visitors(events: DataFrame, as_of: str) -> DataFrame:
    return cards(events, as_of).select("visitors_day", "visitors_week", "visitors_total")


def latency(events: DataFrame) -> DataFrame:
    """Per ranker: searches that carry a latency, median and 95th percentile, interpolated."""
    ms = prop("latencyMs", "double")
    rows = events.where((F.col("type") == "search") & ms.isNotNull()).groupBy(prop("ranker").alias("ranker"))
    return rows.agg(F.count("*").alias("n"), F.round(F.percentile(ms, F.lit(0.5)), 2).alias("p50"), F.round(F.percentile(ms, F.lit(0.95)), 2).alias("p95"))


def top_queries(events: DataFrame, as_of: str, limit: int = 10, zero_hits: bool = False) -> DataFrame:
    rows = events.where((F.col("type") == "search") & within(7, as_of))
    if zero_hits:
        rows = rows.where(prop("total", "bigint") == 0)
    q = prop("q")
    return rows.where(F.length(q) > 0).groupBy(q.alias("q")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "q").limit(limit)


def daily(events: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Visits and searches per day; days without either are absent."""
    rows = events.where(within(days, as_of) & F.col("type").isin("visit", "search"))
    return rows.groupBy(F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("type") == "visit").alias("visits"), F.count_if(F.col("type") == "search").alias("searches"))


def opens_by_ranker(events: DataFrame) -> DataFrame:
    return events.where("type = 'open'").groupBy(prop("ranker").alias("ranker")).agg(F.count("*").alias("opens"))


def click_through(events: DataFrame) -> DataFrame:
    """Opens per search for each ranker, 0 where it has no opens."""
    searches = events.where("type = 'search'").groupBy(prop("ranker").alias("ranker")).agg(F.count("*").alias("searches"))
    return searches.join(opens_by_ranker(events), "ranker", "left").select("ranker", "searches", F.coalesce("opens", F.lit(0)).alias("opens"), F.coalesce(F.round(F.col("opens") / F.col("searches"), 2), F.lit(0.0)).alias("ctr"))


def last_reasons(events: DataFrame, limit: int = 5) -> DataFrame:
    reason = prop("reason")
    return events.where((F.col("type") == "feedback") & (prop("useful") == "false") & (F.length(reason) > 0)).select("event_id", "ts", reason.alias("reason")).orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def solved(submissions: DataFrame) -> DataFrame:
    """Distinct accepted problems per user."""
    return submissions.groupBy("user_id").agg(F.count_distinct(F.when(F.col("ok"), F.col("problem_id"))).alias("solved"), F.count("*").alias("submissions"))


def calendar(submissions: DataFrame) -> DataFrame:
    """All submissions per user and UTC day."""
    return submissions.groupBy("user_id", T.day_bucket("epoch").alias("day")).agg(F.count("*").alias("n"))


def last_rating(history: DataFrame) -> DataFrame:
    return history.groupBy("user_id").agg(F.max_by("rating", F.struct("epoch", "seq")).alias("rating"))


def windowed(submissions: DataFrame, until: int, days: int = 371) -> DataFrame:
    return submissions.where((F.col("epoch") > until - days * 86400) & (F.col("epoch") <= until))


def by_tier(rows: DataFrame, tiers: list[str]) -> DataFrame:
    return rows.groupBy("user_id").pivot("tier", tiers).agg(F.sum("n")).fillna(0)


def compose(calendars: DataFrame, categories: DataFrame) -> DataFrame:
    """``category, day, n``: each source's calendar under its category, and all under ``overall``."""
    rows = calendars.join(bounded_broadcast(categories), "source")
    both = rows.select("category", "day", "n").unionByName(calendars.select(F.lit("overall").alias("category"), "day", "n"))
    return both.groupBy("category", "day").agg(F.sum("n").alias("n"))


def heatmap(days: DataFrame, last_day: int, weeks: int = 52) -> DataFrame:
    """``day, n, level`` for every day from the Sunday so many weeks back to ``last_day``; levels 0 to 4 from quartiles of the non-zero days (1, 2, 4 if there are fewer than four)."""
    weekday = (last_day // 86400 + 4) % 7  # day 0 was a Thursday
    spine = days.sparkSession.range(weeks * 7 + weekday + 1).select((F.lit(last_day) - F.col("id") * 86400).cast("bigint").alias("day"))
    rows = spine.join(days.groupBy("day").agg(F.sum("n").alias("n")), "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))
    busy = rows.where("n > 0").agg(F.array_sort(F.collect_list("n")).alias("v"))  # at most one value a day of the span
    size = F.size("v")
    cut = lambda p, few: F.when(size < 4, F.lit(few)).otherwise(F.element_at("v", (F.floor(size * p) + 1).cast("int")))
    cuts = busy.select(cut(0.25, 1).alias("c1"), cut(0.5, 2).alias("c2"), cut(0.75, 4).alias("c3"))
    n = F.col("n")
    level = F.when(n <= 0, 0).when(n <= F.col("c1"), 1).when(n <= F.col("c2"), 2).when(n <= F.col("c3"), 3).otherwise(4)
    return rows.crossJoin(F.broadcast(cuts)).select("day", "n", level.alias("level"))  # one row of cuts


def acceptance_summary(corpus: DataFrame) -> DataFrame:
    """Per tier: least, lower quartile, median, upper quartile and largest acceptance, by index floor(n p).

    Values are counted first, so the running counts have a row for each distinct value and not for each record.
    """
    rows = corpus.where("tier is not null and acceptance is not null").groupBy(F.lower("tier").alias("tier"), "acceptance").agg(F.count("*").alias("c"))
    w = Window.partitionBy("tier")
    rows = rows.withColumns({"upto": F.sum("c").over(w.orderBy("acceptance").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "m": F.sum("c").over(w)})
    at = lambda p: F.least(F.floor(F.col("m") * p), F.col("m") - 1)
    pick = lambda p: F.max(F.when((F.col("upto") - F.col("c") <= at(p)) & (at(p) < F.col("upto")), F.col("acceptance")))
    return rows.groupBy("tier").agg(F.min("acceptance").alias("low"), pick(0.25).alias("q1"), pick(0.5).alias("median"), pick(0.75).alias("q3"), F.max("acceptance").alias("high"))


def stratified_sample(corpus: DataFrame, step: int, each: int, seed: int = 0, curated: DataFrame | None = None) -> DataFrame:
    """The same number from each rating band, by a seeded hash of the id, and all rows whose id is in ``curated`` (doc_id); reproducible within Spark only."""
    w = Window.partitionBy("band").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    rows = corpus.where("rating is not null").withColumn("band", T.snap("rating", step).cast("long"))
    if curated is not None:
        sample = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= each).drop("r")
        chosen = curated.select("doc_id").distinct()
        own = corpus.withColumn("band", T.snap("rating", step).cast("long")).join(chosen, "doc_id", "left_semi")
        return sample.unionByName(own.join(sample.select("doc_id"), "doc_id", "left_anti"))
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= each).drop("r")
