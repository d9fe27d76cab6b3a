"""Facet, sorting, directory, level and user-state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import command, facets, lexical, state
from . import search
from . import tables as t

RATED = {"de": "de", "fr": "fr"}
_C = f"WITH {t.CORPUS_SQL}"


def f1_platforms(spark, d):
    return facets.facet_filter(t.corpus(spark, d), facets.parse_set("DE, fr,xx", ["en", "de", "fr", "es"])).select("doc_id", "platform")


def f2_pattern(spark, d):
    return facets.facet_filter(t.corpus(spark, d), pattern="src3").select("doc_id")


def f3_done(spark, d):
    s = state.fold(t.changes(spark, d)).where("user_id = 3 and done").select(F.col("problem_id").alias("doc_id"))
    c = t.corpus(spark, d)
    return facets.done_filter(c, s, "done").select("doc_id", F.lit("done").alias("side")).unionByName(facets.done_filter(c, s, "notdone").select("doc_id", F.lit("notdone").alias("side")))


def f5_difficulty(spark, d):
    sel = facets.Difficulty.parse("en-easy,en-hard,de:3000-500,de:400-2000,ac:20-80,junk", "en", RATED)
    return t.corpus(spark, d).where(sel.predicate("en")).select("doc_id", "platform")


def f6_tiers(spark, d):
    """English has tiers; Spanish could and shows none, so its counts are 0."""
    return facets.tier_counts(t.corpus(spark, d), ["en", "es"])


def f6_histogram(spark, d):
    return facets.rating_histogram(t.corpus(spark, d), 500)


def f6_acceptance(spark, d):
    return facets.acceptance_bounds(t.corpus(spark, d))


def f6_stops(spark, d):
    return facets.acceptance_stops(facets.acceptance_bounds(t.corpus(spark, d)))


def f8_sort(spark, d):
    c = t.corpus(spark, d)
    out = None
    for down in (False, True):
        part = facets.page(c, facets.difficulty_order(down), 200, 50).select("doc_id", F.lit(down).alias("descending"))
        out = part if out is None else out.unionByName(part)
    return out


def f10_sort_window(spark, d):
    hits = search.QUERIES["r5_bm25_top10"](spark, d)
    return facets.sort_window(hits, t.corpus(spark, d), 10).select("qid", "doc_id", F.col("rank").cast("long"), F.col("sorted_rank").cast("long"))


def f11_browse(spark, d):
    return facets.browse(t.corpus(spark, d), F.col("platform") == "fr", 25, 5).select("doc_id", "score", "total")


def f13_filtered_search(spark, d):
    keep = facets.facet_filter(t.corpus(spark, d), {"en"})
    hits = lexical.search(search._texts(spark, d), lexical.query_tokens(t.queries(spark, d)), "bm25", 10, keep=keep)
    return hits.select("qid", F.col("rank").cast("long").alias("rank"), "doc_id", "score", "total")


def f15_decorate(spark, d):
    s = state.fold(t.changes(spark, d)).where("user_id = 3").withColumnRenamed("problem_id", "doc_id")
    return facets.decorate(t.corpus(spark, d).select("doc_id"), s)


def _labels(spark):
    return spark.createDataFrame([("low" if i < 10 else "high", f"src{i}") for i in range(25) if i not in (4, 17)], "category string, label string")


def _aliases(spark):
    return spark.createDataFrame([("src4", "src3"), ("src17", "src16")], "alias string, canonical string")


def f16_directory(spark, d):
    return facets.directory(t.corpus(spark, d), _labels(spark), _aliases(spark))


def f16_groups(spark, d):
    """Umbrellas over sources: one of which the corpus has no member, one that has a member no label knows."""
    groups = spark.createDataFrame([("a", "Lower", ["src9", "src3", "src1"]), ("b", "Upper", ["src16", "src99", "src15"]), ("c", "None", ["src24"])], "id string, label string, members array<string>")
    return facets.directory_groups(f16_directory(spark, d), groups).select("id", "label", F.array_join("members", " ").alias("members"), "total")


SORT_WORDS = ("difficulty", "difficulty-asc", "Difficulty-Desc ", "-difficulty", "hardest", "")


def f9_sort_words(spark, d):
    """Each benchmark item with one of the words, told what order it asks for."""
    told = F.create_map(*[F.lit(x) for w in SORT_WORDS if facets.parse_sort(w) for x in (w, facets.parse_sort(w))])
    words = t.table(spark, d, "benchmark").select("item_id", F.element_at(F.array(*[F.lit(w) for w in SORT_WORDS]), (F.col("item_id") % len(SORT_WORDS) + 1).cast("int")).alias("word"))
    return words.select("item_id", "word", F.try_element_at(told, F.col("word")).alias("direction"))


def f17_resolve(spark, d):
    """Sources and their aliases as umbrellas; what the sources' names contain needs none."""
    q = spark.createDataFrame([(1, "src1"), (2, "SRC"), (3, "rc1"), (4, "src4"), (5, "zz"), (6, "Tree"), (7, "family of"), (8, "seg")], "qid int, query string")
    umbrellas = spark.createDataFrame([("tree family of things", "trees"), ("segment tree", "segments"), ("segments", "segments")], "name string, label string")
    names = _labels(spark).select(F.col("label").alias("name"), "label").unionByName(_aliases(spark).select(F.col("alias").alias("name"), F.col("canonical").alias("label"))).unionByName(umbrellas)
    return facets.resolve_label(q, names, t.documents(spark, d).select(F.col("source").alias("name")).distinct())


GRIDS = {"de": (100, 200), "fr": (200, 200)}


def f18_level_rated(spark, d):
    users = t.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.element_at(F.array(F.lit("de"), F.lit("fr"), F.lit("es")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("platform"), F.col("c_acctbal").alias("rating"))
    return facets.suggest_rated(t.corpus(spark, d), users, GRIDS)


def f19_level_ladder(spark, d):
    users = t.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 160).alias("medium"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_custkey") % 131).alias("hard"))
    return facets.suggest_tier(t.corpus(spark, d), users)


COMMANDS = (":help", ":h sheet", ":compare ", ":cmp", ":Bookmarks", "ls done", ":all", ":bo", "", " ", ":compared")


def f20_command(spark, d):
    """Each benchmark passage behind one of the commands' words, asked by somebody signed in or not."""
    x = t.table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 2 == 0).alias("signed_in"), F.concat(F.element_at(F.array(*[F.lit(c) for c in COMMANDS]), (F.col("item_id") % len(COMMANDS) + 1).cast("int")), F.when(F.col("item_id") % len(COMMANDS) == 2, F.col("text")).when(F.col("item_id") % len(COMMANDS) > 7, F.concat(F.lit(" "), "text")).otherwise("")).alias("text"))
    return command.commands(x).select("item_id", "signed_in", "kind", "argument")


def u1_state_fold(spark, d):
    return state.fold(t.changes(spark, d)).withColumns({c: F.col(c).cast("string") for c in ("done_at", "bookmarked_at", "updated_at")})


def u3_library(spark, d):
    s = state.fold(t.changes(spark, d))
    return state.library(s, t.corpus(spark, d).select("doc_id", "tier", "rating", "acceptance"), "done", aged_before="2001-06-01 00:00:00").select("user_id", "problem_id", F.col("position").cast("long").alias("position"), F.col("view_ts").cast("string").alias("view_ts"))


def u3_library_oldest(spark, d):
    """Bookmarked problems that aren't done, of two languages, oldest first."""
    s = state.fold(t.changes(spark, d))
    rows = state.library(s, t.corpus(spark, d), "bookmarked", oldest_first=True, done="notdone", platforms={"en", "de"})
    return rows.select("user_id", "problem_id", F.col("position").cast("long").alias("position"), F.col("view_ts").cast("string").alias("view_ts"))


def u3_library_sorted(spark, d):
    s = state.fold(t.changes(spark, d))
    return state.library(s, t.corpus(spark, d).select("doc_id", "tier", "rating", "acceptance"), by_difficulty="desc").select("user_id", "problem_id", F.col("position").cast("long").alias("position"))


def u5_sets(spark, d):
    return state.sets(state.fold(t.changes(spark, d))).select("user_id", *[F.array_join(c, " ").alias(c) for c in ("done", "bookmarked")])


QUERIES = {f.__name__: f for f in (f1_platforms, f2_pattern, f3_done, f5_difficulty, f6_tiers, f6_histogram, f6_acceptance, f6_stops, f8_sort, f10_sort_window, f11_browse, f13_filtered_search, f15_decorate, f16_directory, f16_groups, f9_sort_words, f17_resolve, f18_level_rated, f19_level_ladder, f20_command, u1_state_fold, u3_library, u3_library_oldest, u3_library_sorted, u5_sets)}

_KEY0 = "coalesce(CASE lower(tier) WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 WHEN 'hard' THEN 3 END, rating)"
# one change after another, as a list is reduced; the operator's windows say the same in another way
_STEP = """{'kind': x.kind, 'value': x.value, 'ts': x.ts, 'seq': x.seq,
        'd': CASE WHEN x.kind = 'done' THEN x.value = 'true' ELSE a.d END, 'dt': CASE WHEN x.kind <> 'done' THEN a.dt WHEN x.value = 'true' THEN x.ts END,
        'b': CASE WHEN x.kind = 'bookmarked' THEN x.value = 'true' ELSE a.b END, 'bt': CASE WHEN x.kind <> 'bookmarked' THEN a.bt WHEN x.value = 'true' THEN x.ts END,
        'r': CASE WHEN x.kind <> 'recall' THEN a.r WHEN a.d OR a.b OR a.r IS NOT NULL THEN nullif(x.value, 'none') END,
        'u': CASE WHEN x.kind <> 'recall' OR a.d OR a.b OR a.r IS NOT NULL THEN x.ts ELSE a.u END}"""
_NONE = "{'kind': NULL::VARCHAR, 'value': NULL::VARCHAR, 'ts': NULL::TIMESTAMP, 'seq': 0::BIGINT, 'd': false, 'dt': NULL::TIMESTAMP, 'b': false, 'bt': NULL::TIMESTAMP, 'r': NULL::VARCHAR, 'u': NULL::TIMESTAMP}"
_ONE = "{'kind': kind, 'value': value, 'ts': ts::TIMESTAMP, 'seq': seq::BIGINT, 'd': false, 'dt': NULL::TIMESTAMP, 'b': false, 'bt': NULL::TIMESTAMP, 'r': NULL::VARCHAR, 'u': NULL::TIMESTAMP}"
_FOLD = f"""{t.CHANGES_SQL},
    fd AS (SELECT user_id, problem_id, list_reduce(list_concat([{_NONE}], list({_ONE} ORDER BY ts, seq)), lambda a, x: {_STEP}) AS s FROM ch GROUP BY ALL),
    us AS (SELECT user_id, problem_id, s.d AS done, s.dt AS done_at, s.b AS bookmarked, s.bt AS bookmarked_at, s.r AS recall, s.u AS updated_at FROM fd WHERE s.d OR s.b OR s.r IS NOT NULL)"""
_LABELS = "lab AS (SELECT CASE WHEN i < 10 THEN 'low' ELSE 'high' END AS category, 'src' || i AS label FROM range(25) r(i) WHERE i NOT IN (4, 17))"
_DIRECTORY = f"{_C}, {_LABELS}, dir AS (SELECT category, label, coalesce(n, 0) AS n FROM lab LEFT JOIN (SELECT CASE pattern WHEN 'src4' THEN 'src3' WHEN 'src17' THEN 'src16' ELSE pattern END AS label, count(*) AS n FROM corpus GROUP BY 1) USING (label))"
_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"

ORACLES = {
    "f1_platforms": f"{_C} SELECT doc_id, platform FROM corpus WHERE platform IN ('de', 'fr')",
    "f2_pattern": f"{_C} SELECT doc_id FROM corpus WHERE pattern = 'src3'",
    "f3_done": f"WITH {_FOLD}, x AS (SELECT problem_id FROM us WHERE user_id = 3 AND done) SELECT doc_id, CASE WHEN doc_id IN (SELECT problem_id FROM x) THEN 'done' ELSE 'notdone' END AS side FROM documents",
    "f5_difficulty": f"{_C} SELECT doc_id, platform FROM corpus WHERE CASE platform WHEN 'en' THEN coalesce(tier IN ('Easy', 'Hard') AND acceptance BETWEEN 20 AND 80, false) WHEN 'de' THEN coalesce(rating BETWEEN 400 AND 2000, false) ELSE true END",
    "f6_tiers": f"{_C} SELECT p AS platform, y AS tier, (SELECT count(*) FROM corpus WHERE platform = p AND lower(tier) = y) AS n FROM (VALUES ('en'), ('es')) a(p) CROSS JOIN (VALUES ('easy'), ('medium'), ('hard')) b(y)",
    "f6_histogram": f"""{_C}, b AS (SELECT platform, CAST(floor(min(rating) / 500.0) * 500 AS BIGINT) AS lo, CAST(ceil(max(rating) / 500.0) * 500 AS BIGINT) AS hi FROM corpus WHERE rating IS NOT NULL GROUP BY platform),
        s AS (SELECT platform, unnest(range(lo, hi + 1, 500)) AS stop FROM b) SELECT s.platform, stop, count(rating) AS n FROM s LEFT JOIN corpus c ON c.platform = s.platform AND rating >= stop AND rating < stop + 500 GROUP BY ALL""",
    "f6_acceptance": f"""{_C}, a AS (SELECT lower(tier) AS tier, CAST(floor(min(acceptance) / 5) * 5 AS BIGINT) AS low, CAST(ceil(max(acceptance) / 5) * 5 AS BIGINT) AS high, count(*) AS n FROM corpus WHERE tier IS NOT NULL GROUP BY ALL)
        SELECT * FROM a UNION ALL SELECT 'all', min(low), max(high), CAST(sum(n) AS BIGINT) FROM a""",
    "f6_stops": f"{_C} SELECT unnest(range(CAST(floor(min(acceptance) / 5) * 5 AS BIGINT), CAST(ceil(max(acceptance) / 5) * 5 AS BIGINT) + 1, 5)) AS stop FROM corpus WHERE tier IS NOT NULL",
    "f8_sort": f"""{_C} (SELECT doc_id, false AS descending FROM corpus ORDER BY {_KEY0} ASC NULLS LAST, -acceptance ASC NULLS LAST, doc_id LIMIT 200 OFFSET 50)
        UNION ALL (SELECT doc_id, true FROM corpus ORDER BY {_KEY0} DESC NULLS LAST, -acceptance DESC NULLS LAST, doc_id LIMIT 200 OFFSET 50)""",
    "f10_sort_window": f"{search._BASE}, {search._ranked_sql('bm25', 'a')}, {t.CORPUS_SQL} SELECT qid, doc_id, rank, row_number() OVER (PARTITION BY qid ORDER BY {_KEY0} ASC NULLS LAST, -acceptance ASC NULLS LAST, rank) AS sorted_rank FROM a JOIN corpus USING (doc_id)",
    "f11_browse": f"{_C} SELECT doc_id, 0.0::DOUBLE AS score, (SELECT count(*) FROM corpus WHERE platform = 'fr') AS total FROM corpus WHERE platform = 'fr' ORDER BY doc_id LIMIT 25 OFFSET 5",
    "f13_filtered_search": f"""{search._BASE}, {search._ranked_sql('bm25', 'a')} SELECT qid, rank, doc_id, score, total FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(s.score, 9) DESC, first_pos, doc_id) AS rank, doc_id, round(s.score, 6) AS score, count(*) OVER (PARTITION BY qid) AS total
        FROM a_s s JOIN documents USING (doc_id) WHERE lang = 'en') WHERE rank <= 10""",
    "f15_decorate": f"WITH {_FOLD} SELECT doc_id, coalesce(done, false) AS done, coalesce(bookmarked, false) AS bookmarked, recall FROM documents LEFT JOIN (SELECT * FROM us WHERE user_id = 3) ON doc_id = problem_id",
    "f16_directory": f"{_DIRECTORY} SELECT * FROM dir",
    "f16_groups": f"""{_DIRECTORY}, g(id, label, pos, member) AS (VALUES ('a', 'Lower', 0, 'src9'), ('a', 'Lower', 1, 'src3'), ('a', 'Lower', 2, 'src1'), ('b', 'Upper', 0, 'src16'), ('b', 'Upper', 1, 'src99'), ('b', 'Upper', 2, 'src15'), ('c', 'None', 0, 'src24'))
        SELECT id, g.label, string_agg(member, ' ' ORDER BY pos) FILTER (n > 0) AS members, CAST(sum(n) AS BIGINT) AS total FROM g JOIN dir ON dir.label = member GROUP BY id, g.label HAVING sum(n) > 0""",
    "f9_sort_words": "SELECT item_id, word, CASE item_id % 6 WHEN 0 THEN 'asc' WHEN 1 THEN 'asc' WHEN 2 THEN 'desc' WHEN 3 THEN 'desc' END AS direction FROM (SELECT item_id, ['difficulty', 'difficulty-asc', 'Difficulty-Desc ', '-difficulty', 'hardest', ''][item_id % 6 + 1] AS word FROM benchmark)",
    "f17_resolve": "SELECT * FROM (VALUES (1, 'src1'), (4, 'src3'), (6, 'segments'), (7, 'trees'), (8, 'segments')) v(qid, label)",
    "f18_level_rated": f"""{_C}, g(platform, step) AS (VALUES ('de', 100), ('fr', 200)),
        b0 AS (SELECT platform, min(rating) AS lo, max(rating) AS hi FROM corpus WHERE rating IS NOT NULL GROUP BY platform), b AS (SELECT platform, step, floor(lo / step) * step AS lo, ceil(hi / step) * step AS hi FROM b0 JOIN g USING (platform)),
        u AS (SELECT c_custkey AS user_id, ['de', 'fr', 'es'][c_custkey % 3 + 1] AS platform, c_acctbal AS rating FROM customer),
        r AS (SELECT user_id, platform, hi, greatest(least(greatest(floor(rating / step) * step, lo), hi - 200), lo) AS low FROM u JOIN b USING (platform)),
        r2 AS (SELECT user_id, platform, CAST(low AS BIGINT) AS low, CAST(least(low + 200, hi) AS BIGINT) AS high FROM r)
        SELECT user_id, r2.platform, low, high, count(*) AS n FROM r2 JOIN corpus c ON r2.platform = c.platform AND c.rating BETWEEN low AND high GROUP BY ALL""",
    "f19_level_ladder": f"""{_C}, u AS (SELECT c_custkey AS user_id, c_custkey % 160 AS m, coalesce(CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 131 END, 0) AS h FROM customer),
        w AS (SELECT user_id, CASE WHEN h < 25 THEN 'medium' ELSE 'hard' END AS tier, CASE WHEN h < 10 AND m < 100 THEN 'upper' WHEN h < 25 THEN 'lower' WHEN h < 100 THEN 'upper' ELSE 'lower' END AS half FROM u WHERE m > 0 OR h > 0),
        q AS (SELECT lower(tier) AS tier, quantile_cont(acceptance, 0.5) AS mid, min(acceptance) AS lo, max(acceptance) AS hi FROM corpus WHERE tier IS NOT NULL GROUP BY ALL),
        r AS (SELECT user_id, tier, CAST(floor(CASE half WHEN 'upper' THEN mid ELSE lo END / 5) * 5 AS BIGINT) AS low, CAST(ceil(CASE half WHEN 'upper' THEN hi ELSE mid END / 5) * 5 AS BIGINT) AS high FROM w JOIN q USING (tier))
        SELECT user_id, tier, low, high, n FROM r JOIN (SELECT r3.tier AS t2, r3.low AS l2, r3.high AS h2, count(*) AS n FROM (SELECT DISTINCT tier, low, high FROM r) r3 JOIN corpus c ON lower(c.tier) = r3.tier AND c.acceptance BETWEEN r3.low AND r3.high GROUP BY ALL) ON tier = t2 AND low = l2 AND high = h2""",
    "f20_command": """WITH x AS (SELECT item_id, item_id % 11 AS i, item_id % 2 = 0 AS signed_in, text FROM benchmark)
        SELECT item_id, signed_in, CASE WHEN i IN (0, 1) THEN 'help' WHEN i IN (2, 3) THEN 'compare' WHEN i IN (4, 5, 6) THEN CASE WHEN signed_in THEN 'library' ELSE 'needs_account' END WHEN i IN (7, 10) THEN 'unknown' ELSE 'search' END AS kind,
            CASE i WHEN 1 THEN 'sheet' WHEN 2 THEN text WHEN 4 THEN 'bookmarked' WHEN 5 THEN 'done' WHEN 6 THEN 'all' WHEN 7 THEN ':bo' WHEN 8 THEN text WHEN 9 THEN text WHEN 10 THEN ':compared ' || text ELSE '' END AS argument FROM x""",
    "u1_state_fold": f"WITH {_FOLD} SELECT user_id, problem_id, done, {_TS.format('done_at')}, bookmarked, {_TS.format('bookmarked_at')}, recall, {_TS.format('updated_at')} FROM us",
    "u3_library": f"WITH {_FOLD} SELECT user_id, problem_id, row_number() OVER (PARTITION BY user_id ORDER BY done_at DESC, problem_id) AS position, strftime(done_at, '%Y-%m-%d %H:%M:%S') AS view_ts FROM us JOIN documents ON doc_id = problem_id WHERE done AND done_at <= TIMESTAMP '2001-06-01'",
    "u3_library_oldest": f"WITH {_FOLD} SELECT user_id, problem_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(bookmarked_at, updated_at), problem_id) AS position, strftime(bookmarked_at, '%Y-%m-%d %H:%M:%S') AS view_ts FROM us JOIN documents ON doc_id = problem_id WHERE bookmarked AND NOT done AND lang IN ('en', 'de')",
    "u3_library_sorted": f"WITH {_FOLD}, {t.CORPUS_SQL} SELECT user_id, problem_id, row_number() OVER (PARTITION BY user_id ORDER BY {_KEY0} DESC NULLS LAST, -acceptance DESC NULLS LAST, coalesce(done_at, updated_at) DESC, problem_id) AS position FROM us JOIN corpus ON doc_id = problem_id WHERE done OR bookmarked",
    "u5_sets": f"WITH {_FOLD} SELECT user_id, coalesce(string_agg(problem_id::VARCHAR, ' ' ORDER BY problem_id) FILTER (done), '') AS done, coalesce(string_agg(problem_id::VARCHAR, ' ' ORDER BY problem_id) FILTER (bookmarked), '') AS bookmarked FROM us GROUP BY user_id",
}
