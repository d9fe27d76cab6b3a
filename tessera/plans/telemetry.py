"""Event statistics, calendars and heat maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, stats
from . import tables as t

LAST_DAY = 1706486400  # 2024-01-29, within the table


def a1_visitors(spark, d):
    return stats.visitors(t.events(spark, d), t.AS_OF)


def a2_a12_cards(spark, d):
    return stats.cards(t.events(spark, d), t.AS_OF).select("searches_week", "searches_total", "signups_week", "signups_total", "boots_week", "boot_ms", "opens_total", "opens_external", "open_position", "bookmarks_set", "done_set", "feedback_useful", "feedback_not")


def a3_latency(spark, d):
    return stats.latency(t.events(spark, d))


def a4_top_queries(spark, d):
    return stats.top_queries(t.events(spark, d), t.AS_OF)


def a5_zero_hits(spark, d):
    return stats.top_queries(t.events(spark, d), t.AS_OF, zero_hits=True)


def a8_daily(spark, d):
    return stats.daily(t.events(spark, d), t.AS_OF)


def a10_opens_by_ranker(spark, d):
    return stats.opens_by_ranker(t.events(spark, d))


def a13b_ctr(spark, d):
    return stats.click_through(t.events(spark, d))


def a13_reasons(spark, d):
    return stats.last_reasons(t.events(spark, d)).select("event_id", F.col("ts").cast("string").alias("ts"), "reason")


def a14_solved(spark, d):
    return stats.solved(t.submissions(spark, d))


def a14_calendar(spark, d):
    return stats.calendar(t.submissions(spark, d))


def a15_last_rating(spark, d):
    return stats.last_rating(stats.windowed(t.submissions(spark, d), 1706000000, 10))


def _source_days(spark, d):
    e = t.table(spark, d, "events")
    return e.select(F.col("event_type").alias("source"), (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400) * 86400).cast("bigint").alias("day")).groupBy("source", "day").agg(F.count("*").alias("n"))


def a18_compose(spark, d):
    cats = spark.createDataFrame([("click", "dsa"), ("purchase", "dsa"), ("view", "dev")], "source string, category string")
    return stats.compose(_source_days(spark, d), cats)


def a19_heatmap(spark, d):
    return stats.heatmap(_source_days(spark, d).where("source = 'click'"), LAST_DAY)


def a20_agreement(spark, d):
    docs = t.documents(spark, d)
    gold = t.table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("tag"))
    mine = docs.where("doc_id % 7 > 0").select("doc_id", F.when(F.col("n_chars") > 400, "good").otherwise("bad").alias("tag"))  # a seventh has no label of ours
    return evaluate.label_agreement(gold, mine)


EQUIVALENTS = {"good": ["long", "middle"], "bad": ["short", "middle"]}


def a20_equivalents(spark, d):
    """Lengths as our labels; a middle length counts for both official tags."""
    gold = t.table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("tag"))
    mine = t.documents(spark, d).select("doc_id", F.when(F.col("n_chars") > 2000, "long").when(F.col("n_chars") > 400, "middle").otherwise("short").alias("tag"))
    return evaluate.macro_means(evaluate.label_agreement(gold, evaluate.with_equivalents(mine, EQUIVALENTS), 10))


def a22_acceptance(spark, d):
    return stats.acceptance_summary(t.corpus(spark, d))


def a24_stratified(spark, d):
    """A sample by bands and a list of its own beside it: its size and whether it fits its band, whether another order of rows draws the same, and whether the two together are those two and nothing else."""
    corpus = t.corpus(spark, d)
    listed = corpus.where("doc_id % 37 = 0").select("doc_id")
    one, two = (stats.stratified_sample(c, 1000, 5).select("doc_id", "band", "rating") for c in (corpus, corpus.repartition(7)))
    both = stats.stratified_sample(corpus, 1000, 5, curated=listed).select("doc_id", "band")
    rows = both.join(one.select("doc_id", F.lit(1).alias("sampled"), (F.floor(F.col("rating") / 1000) * 1000 == F.col("band")).alias("fits")), "doc_id", "left").join(two.select("doc_id", F.lit(1).alias("again")), "doc_id", "left").join(listed.withColumn("listed", F.lit(1)), "doc_id", "left")
    return rows.groupBy("band").agg(F.count("sampled").alias("sample"), F.count_if("fits").alias("fits"), F.count("again").alias("again"), F.count("listed").alias("listed"), F.count_if(F.col("sampled").isNull() & F.col("listed").isNull()).alias("others"))


QUERIES = {f.__name__: f for f in (a1_visitors, a2_a12_cards, a3_latency, a4_top_queries, a5_zero_hits, a8_daily, a10_opens_by_ranker, a13_reasons, a13b_ctr, a14_solved, a14_calendar, a15_last_rating, a18_compose, a19_heatmap, a20_agreement, a20_equivalents, a22_acceptance, a24_stratified)}

_E = f"WITH {t.EVENTS_SQL}"
_AT = f"TIMESTAMP '{t.AS_OF}'"
_W = lambda n: f"ts >= {_AT} - INTERVAL {n} DAY"
_SUB = "s AS (SELECT user_id, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, event_type = 'purchase' AS ok, json_extract_string(props, '$.k') AS problem_id, value AS rating FROM events WHERE event_type IN ('purchase', 'click'))"
_DAYS = "sd AS (SELECT event_type AS source, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS day, count(*) AS n FROM events GROUP BY ALL)"

ORACLES = {
    "a1_visitors": f"{_E} SELECT count(DISTINCT user_id) FILTER (type = 'visit' AND {_W(1)}) AS visitors_day, count(DISTINCT user_id) FILTER (type = 'visit' AND {_W(7)}) AS visitors_week, count(DISTINCT user_id) FILTER (type = 'visit') AS visitors_total FROM e",
    "a2_a12_cards": f"""{_E} SELECT count(*) FILTER (type = 'search' AND {_W(7)}) AS searches_week, count(*) FILTER (type = 'search') AS searches_total, count(*) FILTER (type = 'signup' AND {_W(7)}) AS signups_week, count(*) FILTER (type = 'signup') AS signups_total,
        count(*) FILTER (type = 'boot' AND {_W(7)}) AS boots_week, round(avg(value) FILTER (type = 'boot' AND {_W(7)}), 0) AS boot_ms, count(*) FILTER (type = 'open') AS opens_total, count(*) FILTER (type = 'open' AND k % 2 = 0) AS opens_external,
        round(avg(k) FILTER (type = 'open'), 1) AS open_position, count(*) FILTER (type = 'bookmark' AND k % 8 < 4) AS bookmarks_set, count(*) FILTER (type = 'done' AND k % 8 < 4) AS done_set,
        count(*) FILTER (type = 'feedback' AND k % 8 < 4) AS feedback_useful, count(*) FILTER (type = 'feedback' AND k % 8 >= 4) AS feedback_not FROM e""",
    "a3_latency": f"{_E} SELECT ranker, count(*) AS n, round(quantile_cont(value, 0.5) + 1e-9, 2) AS p50, round(quantile_cont(value, 0.95) + 1e-9, 2) AS p95 FROM e WHERE type = 'search' GROUP BY ranker",
    "a4_top_queries": f"{_E} SELECT 'q' || k AS q, count(*) AS n FROM e WHERE type = 'search' AND {_W(7)} GROUP BY 1 ORDER BY n DESC, q LIMIT 10",
    "a5_zero_hits": f"{_E} SELECT 'q' || k AS q, count(*) AS n FROM e WHERE type = 'search' AND {_W(7)} AND floor(value / 10) = 0 GROUP BY 1 ORDER BY n DESC, q LIMIT 10",
    "a8_daily": f"{_E} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (type = 'visit') AS visits, count(*) FILTER (type = 'search') AS searches FROM e WHERE type IN ('visit', 'search') AND {_W(14)} GROUP BY 1",
    "a10_opens_by_ranker": f"{_E} SELECT ranker, count(*) AS opens FROM e WHERE type = 'open' GROUP BY ranker",
    "a13b_ctr": f"{_E} SELECT ranker, count(*) FILTER (type = 'search') AS searches, count(*) FILTER (type = 'open') AS opens, round(count(*) FILTER (type = 'open') / count(*) FILTER (type = 'search'), 2) AS ctr FROM e GROUP BY ranker HAVING count(*) FILTER (type = 'search') > 0",
    "a13_reasons": f"{_E} SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0') END AS ts, 'because ' || k AS reason FROM e WHERE type = 'feedback' AND k % 8 >= 4 AND k % 3 > 0 ORDER BY e.ts DESC, event_id DESC LIMIT 5",
    "a14_solved": f"WITH {_SUB} SELECT user_id, count(DISTINCT problem_id) FILTER (ok) AS solved, count(*) AS submissions FROM s GROUP BY user_id",
    "a14_calendar": f"WITH {_SUB} SELECT user_id, CAST(floor(epoch / 86400) * 86400 AS BIGINT) AS day, count(*) AS n FROM s GROUP BY ALL",
    "a15_last_rating": f"WITH {_SUB} SELECT user_id, arg_max(rating, (epoch, seq)) AS rating FROM s WHERE epoch > 1706000000 - 864000 AND epoch <= 1706000000 GROUP BY user_id",
    "a18_compose": f"WITH {_DAYS} SELECT 'overall' AS category, day, sum(n) AS n FROM sd GROUP BY day UNION ALL SELECT CASE source WHEN 'view' THEN 'dev' ELSE 'dsa' END, day, sum(n) FROM sd WHERE source IN ('click', 'purchase', 'view') GROUP BY ALL",
    "a19_heatmap": f"""WITH {_DAYS}, sp AS (SELECT {LAST_DAY} - i * 86400 AS day FROM range(366) r(i)), r AS (SELECT day, coalesce(n, 0) AS n FROM sp LEFT JOIN (SELECT * FROM sd WHERE source = 'click') USING (day)),
        v AS (SELECT list(n ORDER BY n) AS v FROM r WHERE n > 0), c AS (SELECT CASE WHEN len(v) < 4 THEN 1 ELSE v[CAST(floor(len(v) * 0.25) AS BIGINT) + 1] END AS c1, CASE WHEN len(v) < 4 THEN 2 ELSE v[CAST(floor(len(v) * 0.5) AS BIGINT) + 1] END AS c2, CASE WHEN len(v) < 4 THEN 4 ELSE v[CAST(floor(len(v) * 0.75) AS BIGINT) + 1] END AS c3 FROM v)
        SELECT day, n, CASE WHEN n <= 0 THEN 0 WHEN n <= c1 THEN 1 WHEN n <= c2 THEN 2 WHEN n <= c3 THEN 3 ELSE 4 END AS level FROM r CROSS JOIN c""",
    "a20_agreement": """WITH j AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS g, CASE WHEN n_chars > 400 THEN 'good' WHEN n_chars <= 400 THEN 'bad' END AS m FROM labels LEFT JOIN (SELECT * FROM documents WHERE doc_id % 7 > 0) d USING (doc_id)),
        s AS (SELECT tag, count(*) FILTER (g = tag) AS gold, count(*) FILTER (m = tag) AS mine, count(*) FILTER (g = tag AND m = tag) AS hit FROM j CROSS JOIN (VALUES ('good'), ('bad')) v(tag) GROUP BY tag)
        SELECT tag, gold, mine, hit, round(hit / mine, 6) AS precision, round(hit / gold, 6) AS recall, hit / gold < 0.6 AS low_recall, hit / mine < 0.5 AS low_precision FROM s WHERE gold >= 1""",
    "a20_equivalents": """WITH j AS (SELECT quality = 1 AS good, n_chars > 400 AS for_good, n_chars <= 2000 AS for_bad FROM labels JOIN documents USING (doc_id)),
        s AS (SELECT count(*) FILTER (good) AS gold, count(*) FILTER (for_good) AS mine, count(*) FILTER (good AND for_good) AS hit FROM j UNION ALL SELECT count(*) FILTER (NOT good), count(*) FILTER (for_bad), count(*) FILTER (NOT good AND for_bad) FROM j)
        SELECT round(avg(round(hit / mine, 6)), 6) AS macro_precision, round(avg(round(hit / gold, 6)), 6) AS macro_recall, count(*) AS tags FROM s WHERE gold >= 10""",
    "a22_acceptance": f"""WITH {t.CORPUS_SQL}, l AS (SELECT lower(tier) AS tier, list(acceptance ORDER BY acceptance) AS v FROM corpus WHERE tier IS NOT NULL GROUP BY ALL)
        SELECT tier, v[1] AS low, v[least(CAST(floor(len(v) * 0.25) AS BIGINT) + 1, len(v))] AS q1, v[least(CAST(floor(len(v) * 0.5) AS BIGINT) + 1, len(v))] AS median, v[least(CAST(floor(len(v) * 0.75) AS BIGINT) + 1, len(v))] AS q3, v[-1] AS high FROM l""",
    "a24_stratified": f"""WITH {t.CORPUS_SQL}, r AS (SELECT *, CAST(floor(rating / 1000.0) * 1000 AS BIGINT) AS band FROM corpus), b AS (SELECT band, least(5, count(rating)) AS n, count(*) FILTER (doc_id % 37 = 0) AS listed FROM r GROUP BY band)
        SELECT band, n AS sample, n AS fits, n AS again, listed, 0 AS others FROM b WHERE n > 0 OR listed > 0""",
}
