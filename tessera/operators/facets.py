"""Filters, sorting, paging, directories and level suggestions over a labelled corpus.

A corpus has ``doc_id, platform, tier, rating, acceptance, patterns``. Difficulty is
a tier on tiered platforms, a rating on rated ones, and absent elsewhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

TIERS = ("easy", "medium", "hard")
_RANGE = re.compile(r"^(?P<name>[a-z]+):(?P<a>-?\d+)-(?P<b>-?\d+)$")


def parse_set(raw: str | None, known: list[str]) -> set[str]:
    """Comma-separated names; unknown ones are ignored, and all of them means none chosen."""
    chosen = {x for x in ((raw or "").lower().replace(" ", "").split(",")) if x in known}
    return set() if len(chosen) == len(known) else chosen


@dataclass
class Difficulty:
    """What a difficulty expression selects. Tiers add up; of two ranges for one platform the last holds."""

    tiers: set[str] = field(default_factory=set)
    ranges: dict[str, tuple[int, int]] = field(default_factory=dict)
    acceptance: tuple[int, int] | None = None

    @classmethod
    def parse(cls, raw: str | None, tiered: str, rated: dict[str, str]) -> "Difficulty":
        """``tiered``: prefix of tiers, as in ``lc-easy``; ``rated``: range prefix to platform."""
        out = cls()
        for token in (raw or "").lower().replace(" ", "").split(","):
            prefix, _, tier = token.partition("-")
            if prefix == tiered and tier in TIERS:
                out.tiers.add(tier)
            elif m := _RANGE.match(token):
                span = tuple(sorted((int(m["a"]), int(m["b"]))))
                if m["name"] == "ac":
                    out.acceptance = span
                elif m["name"] in rated:
                    out.ranges[rated[m["name"]]] = span
        return out

    def predicate(self, tiered_platform: str) -> Column:
        """Per platform; a platform without a selection passes, a missing value fails."""
        out = F.lit(True)
        for platform, (a, b) in self.ranges.items():
            out = F.when(F.col("platform") == platform, F.coalesce(F.col("rating").between(a, b), F.lit(False))).otherwise(out)
        own = F.lit(True)
        if self.tiers:
            own = own & F.coalesce(F.lower("tier").isin(*sorted(self.tiers)), F.lit(False))
        if self.acceptance:
            own = own & F.coalesce(F.col("acceptance").between(*self.acceptance), F.lit(False))
        return F.when(F.col("platform") == tiered_platform, own).otherwise(out)


def facet_filter(corpus: DataFrame, platforms: set[str] | None = None, pattern: str | None = None, difficulty: Column | None = None) -> DataFrame:
    """Keep what every chosen facet admits; an invalid pattern name is ignored."""
    if platforms:
        corpus = corpus.where(F.col("platform").isin(*sorted(platforms)))
    if pattern and re.match(T.SLUG, pattern):
        corpus = corpus.where(F.array_contains("patterns", pattern))
    return corpus if difficulty is None else corpus.where(difficulty)


def done_filter(corpus: DataFrame, done: DataFrame | None, mode: str = "all") -> DataFrame:
    """``done`` or ``notdone`` against a table of ids; anything else, or nobody signed in, is all."""
    if done is None or mode not in ("done", "notdone"):
        return corpus
    return corpus.join(done.select("doc_id").distinct(), "doc_id", "left_semi" if mode == "done" else "left_anti")


def decorate(hits: DataFrame, state: DataFrame) -> DataFrame:
    """Flags of the user's state beside each hit."""
    return hits.join(state.select("doc_id", "done", "bookmarked", "recall"), "doc_id", "left").withColumns({"done": F.coalesce("done", F.lit(False)), "bookmarked": F.coalesce("bookmarked", F.lit(False))})


def tier_rank() -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.lower("tier"))


def difficulty_order(descending: bool = False, then: str = "doc_id") -> list[Column]:
    """Tier or rating, then acceptance (lower is harder); nulls last either way; stable by ``then``."""
    first = F.coalesce(F.nullif(tier_rank(), F.lit(0)).cast("long"), F.col("rating").cast("long"))
    second = -F.col("acceptance")
    return [x.desc_nulls_last() if descending else x.asc_nulls_last() for x in (first, second)] + [F.col(then)]


def sort_allowed(platforms: set[str], sortable: set[str]) -> bool:
    """Difficulty scales differ: sorting needs exactly one platform that has one."""
    return len(platforms) == 1 and platforms <= sortable


def parse_sort(raw: str | None) -> str | None:
    return {"difficulty": "asc", "difficulty-asc": "asc", "difficulty-desc": "desc", "-difficulty": "desc"}.get(str(raw or "").lower().strip())


def parse_page(k, offset) -> tuple[int, int]:
    def number(x, default):
        try:
            return int(x)
        except (TypeError, ValueError):
            return default

    return number(k, 10) or 10, max(0, number(offset, 0))


def page(frame: DataFrame, order: list[Column], k: int = 10, offset: int = 0) -> DataFrame:
    return frame.orderBy(*order).offset(offset).limit(k)


def browse(corpus: DataFrame, predicate: Column, k: int = 10, offset: int = 0, order: list[Column] | None = None) -> DataFrame:
    """A blank query with filters: corpus order, score 0, the whole set's size beside each row."""
    chosen = corpus.where(predicate)
    total = chosen.agg(F.count("*").alias("total"))
    return page(chosen, order or [F.col("doc_id")], k, offset).crossJoin(F.broadcast(total)).withColumn("score", F.lit(0.0))  # one row


def sort_window(hits: DataFrame, corpus: DataFrame, k: int, descending: bool = False) -> DataFrame:
    """Reorder the first ``k`` by relevance by difficulty; the offset plays no part."""
    rows = hits.where(F.col("rank") <= k).join(corpus.select("doc_id", "tier", "rating", "acceptance"), "doc_id")
    return rows.withColumn("sorted_rank", F.row_number().over(Window.partitionBy("qid").orderBy(*difficulty_order(descending, "rank"))))


def tier_counts(corpus: DataFrame, platforms: list[str] | None = None) -> DataFrame:
    """``platform, tier, n`` for every tier of the tiered platforms, counts of 0 too; ``platforms``: those that have tiers, by default all that show one."""
    counts = corpus.where("tier is not null").groupBy("platform", F.lower("tier").alias("tier")).agg(F.count("*").alias("n"))
    own = corpus.sparkSession.createDataFrame([(p,) for p in platforms], "platform string") if platforms is not None else counts.select("platform").distinct()
    return own.select("platform", F.explode(F.array(*[F.lit(t) for t in TIERS])).alias("tier")).join(counts, ["platform", "tier"], "left").select("platform", "tier", F.coalesce("n", F.lit(0)).alias("n"))


def rating_histogram(corpus: DataFrame, step: int) -> DataFrame:
    """``platform, stop, n`` for every stop from the least rating's floor by ``step`` to the largest one's ceiling; empty stops too."""
    rated = corpus.where("rating is not null")
    counts = rated.groupBy("platform", T.snap("rating", step).cast("long").alias("stop")).agg(F.count("*").alias("n"), F.max("rating").alias("top"))
    spans = counts.groupBy("platform").agg(F.min("stop").alias("low"), T.snap(F.max("top"), step, up=True).cast("long").alias("high"))
    stops = spans.select("platform", F.explode(F.sequence("low", "high", F.lit(step).cast("long"))).alias("stop"))
    return stops.join(counts, ["platform", "stop"], "left").select("platform", "stop", F.coalesce("n", F.lit(0)).alias("n"))


def acceptance_bounds(corpus: DataFrame, step: int = 5) -> DataFrame:
    """``tier, low, high, n``: acceptance snapped outwards for each tier, and over all of them in a row of tier ``all``."""
    rows = corpus.where("acceptance is not null and tier is not null and tier <> ''").groupBy(F.lower("tier").alias("tier")).agg(T.snap(F.min("acceptance"), step).cast("long").alias("low"), T.snap(F.max("acceptance"), step, up=True).cast("long").alias("high"), F.count("*").alias("n"))
    whole = rows.agg(F.lit("all").alias("tier"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).where("n is not null")
    return rows.unionByName(whole)


def acceptance_stops(bounds: DataFrame, step: int = 5) -> DataFrame:
    """``stop``: the values a control over all tiers offers."""
    return bounds.where("tier = 'all'").select(F.explode(F.sequence("low", "high", F.lit(step).cast("long"))).alias("stop"))


def directory(corpus: DataFrame, labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """``category, label, n`` for every known label, aliases folded in, zero counts kept."""
    rows = corpus.select("doc_id", F.explode(F.array_distinct("patterns")).alias("name"))
    folded = rows.join(aliases.select(F.col("alias").alias("name"), "canonical"), "name", "left").select("doc_id", F.coalesce("canonical", "name").alias("label")).distinct()
    counts = folded.groupBy("label").agg(F.count("*").alias("n"))
    return labels.join(counts, "label", "left").select("category", "label", F.coalesce("n", F.lit(0)).alias("n"))


def directory_groups(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """``id, label, members, total``: the umbrella groups (id, label, members) with those of their members that some record carries, in the group's order, and how many carry them.

    ``entries``: ``label, n`` of a directory. Groups of which no member is carried are left out.
    """
    rows = groups.select("id", "label", F.posexplode("members").alias("at", "member")).join(entries.select(F.col("label").alias("member"), "n"), "member")
    kept = rows.groupBy("id", "label").agg(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("at", "member")))).alias("ms"), F.sum("n").alias("total"))
    return kept.where(F.size("ms") > 0).select("id", "label", F.transform("ms", lambda m: m["member"]).alias("members"), "total")


def _substrings(name: Column) -> Column:
    n = F.length(name)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substr(name, i, k)))))


def resolve_label(queries: DataFrame, names: DataFrame, literals: DataFrame | None = None) -> DataFrame:
    """``qid, label``: an exact label or alias wins; else, if no literal name contains the query, one that it starts, or starts a word of.

    The shortest name decides, then the alphabet. ``names`` (name, label) and
    ``literals`` (name) are lists of labels kept by hand: names of some sixty
    letters, so all their parts are listed and both joins are on equality.
    """
    q = queries.select("qid", T.slugify("query").alias("q")).where("q <> ''")
    keys = names.select(T.slugify("name").alias("name"), "label").where("name <> ''")
    exact = keys.select(F.col("name").alias("q"), "name", "label", F.lit(0).alias("priority"))
    starts = F.transform(F.filter(F.sequence(F.lit(1), F.length("name")), lambda i: (i == 1) | (F.substr("name", F.greatest(i - 1, F.lit(1)), F.lit(1)) == "-")), lambda i: F.substr("name", i, F.lit(1 << 10)))
    parts = F.array_distinct(F.flatten(F.transform(starts, lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda k: F.substr(x, F.lit(1), k)))))
    begun = keys.select(F.explode(parts).alias("q"), "name", "label").withColumn("priority", F.lit(1))
    if literals is not None:
        found = literals.select(F.explode(_substrings(T.slugify("name"))).alias("q")).distinct()
        begun = begun.join(found, "q", "left_anti")
    rows = q.join(exact.unionByName(begun), "q")
    w = Window.partitionBy("qid").orderBy("priority", F.length("name"), "name")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("qid", "label")


#: Grid and reach of the rated judges' suggestions. Fixed values.
LEVEL_GRIDS = {"codeforces": (100, 200), "atcoder": (200, 200)}
#: Rungs of the tiered judge: below so many hard ones solved, a tier and the half of it by acceptance. Fixed values.
RUNGS = ((10, "medium", "upper"), (25, "medium", "lower"), (100, "hard", "upper"), (None, "hard", "lower"))
FIRST_RUNG_MEDIUMS = 100


def suggest_rated(corpus: DataFrame, users: DataFrame, grids: dict[str, tuple[int, int]] = LEVEL_GRIDS) -> DataFrame:
    """``user_id, platform, low, high, n``: the rating snapped down, reaching so far, within the corpus's bounds snapped outwards; only where it selects any.

    ``rating`` must be numeric; nulls, and platforms without a grid or without rated records, give nothing.
    """
    rated = corpus.where("rating is not null")
    by_grid = lambda i: F.element_at(F.create_map(*[x for name, g in grids.items() for x in (F.lit(name), F.lit(g[i]))]), F.col("platform"))
    bounds = rated.where(F.col("platform").isin(*grids)).groupBy("platform").agg(F.min("rating").alias("least"), F.max("rating").alias("most"))
    bounds = bounds.withColumns({"step": by_grid(0), "reach": by_grid(1)}).withColumns({"floor": T.snap("least", F.col("step")), "ceil": T.snap("most", F.col("step"), up=True)})
    ranges = users.where("rating is not null").join(F.broadcast(bounds), "platform")  # one row per platform with a grid
    low = F.greatest("floor", F.least(F.greatest(T.snap("rating", F.col("step")), "floor"), F.col("ceil") - F.col("reach")))
    ranges = ranges.select("user_id", "platform", low.cast("long").alias("low"), F.least(low + F.col("reach"), "ceil").cast("long").alias("high"))
    counts = rated.groupBy("platform", F.col("rating").cast("long").alias("r")).agg(F.count("*").alias("c"))
    # few distinct ranges: users are counted against them once each
    spans = ranges.select("platform", "low", "high").distinct()
    sums = spans.join(counts, "platform").where(F.col("r").between(F.col("low"), F.col("high"))).groupBy("platform", "low", "high").agg(F.sum("c").alias("n"))
    return ranges.join(sums, ["platform", "low", "high"]).select("user_id", "platform", "low", "high", "n")


def suggest_tier(corpus: DataFrame, users: DataFrame, step: int = 5) -> DataFrame:
    """``user_id, tier, low, high, n`` from solved counts ``medium, hard``: a rung names a tier and the half of it, split at its median acceptance.

    The upper half has the higher acceptance. Bounds are snapped outwards; ``n`` counts what
    they select. Users without medium or hard ones, and tiers without records, give nothing.
    """
    rows = corpus.where("tier is not null and acceptance is not null").groupBy(F.lower("tier").alias("tier"), "acceptance").agg(F.count("*").alias("c"))
    ends = rows.groupBy("tier").agg(F.percentile("acceptance", F.lit(0.5), F.col("c")).alias("mid"), F.min("acceptance").alias("least"), F.max("acceptance").alias("most"))
    halves = ends.select("tier", F.explode(F.array(*[F.struct(F.lit(h).alias("half"), F.col(a).alias("a"), F.col(b).alias("b")) for h, a, b in (("upper", "mid", "most"), ("lower", "least", "mid"))])).alias("x"))
    halves = halves.select("tier", "x.half", T.snap("x.a", step).cast("long").alias("low"), T.snap("x.b", step, up=True).cast("long").alias("high"))
    n = halves.join(rows, "tier").where(F.col("acceptance").between(F.col("low"), F.col("high"))).groupBy("tier", "half", "low", "high").agg(F.sum("c").alias("n"))
    m, h = F.coalesce("medium", F.lit(0)), F.coalesce("hard", F.lit(0))
    rung = F.lit(len(RUNGS) - 1)
    for i, (below, _, _) in reversed(list(enumerate(RUNGS[:-1]))):
        rung = F.when(h < below, i).otherwise(rung)
    rung = F.when((h < RUNGS[0][0]) & (m >= FIRST_RUNG_MEDIUMS), 1).otherwise(rung)
    at = lambda k: F.element_at(F.array(*[F.lit(r[k]) for r in RUNGS]), rung + 1)
    chosen = users.where((m > 0) | (h > 0)).select("user_id", at(1).alias("tier"), at(2).alias("half"))
    return chosen.join(F.broadcast(n), ["tier", "half"]).select("user_id", "tier", "low", "high", "n")  # two rows a tier
