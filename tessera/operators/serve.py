"""The serving path as one plan over many queries: expand, correct, guard, rank, filter, page."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import dense, facets, lexical, rewrite
from .common import bounded_broadcast, ranked

#: The names a ranker may be asked for.
REGISTERED = ("bm25", "tfidf", "dense", "hybrid")


def picked(asked: Column | str, registered: tuple[str, ...] = REGISTERED, default: str = lexical.DEFAULT_RANKER) -> Column:
    """The ranker asked for, whatever its case and the space around it, if there is one of that name; else the default, else the first."""
    name = F.lower(F.regexp_replace(F.col(asked) if isinstance(asked, str) else asked, r"^\s+|\s+$", ""))
    return F.when(name.isin(*registered), name).otherwise(default if default in registered else registered[0])


def search_as_asked(queries: DataFrame, runs: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """``ranker, qid, rank, doc_id, score``: each of the queries (qid, query, asked) by the ranker it asks for, or the default.

    ``runs``: for each registered ranker its search of a table of queries. A ranker gets its own queries only.
    """
    told = queries.withColumn("ranker", picked("asked", tuple(runs)))
    out = None
    for name, run in runs.items():
        part = run(told.where(F.col("ranker") == name).drop("ranker")).select(F.lit(name).alias("ranker"), "qid", F.col("rank").cast("long").alias("rank"), "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def serve(docs: DataFrame, queries: DataFrame, rules: list[rewrite.Alias], vocabulary: DataFrame, ranker: str | None = None, keep: DataFrame | None = None, k: int = 10, offset: int = 0, titles: DataFrame | None = None) -> dict[str, DataFrame]:
    """``queries`` (qid, query) to ``hits``, ``guarded`` and ``rewritten``.

    Aliases expand the query; corrections of its unknown words are appended; a query
    of which no word is known then has no hits, for any ranker. The rest is ranked in
    full, filtered by ``keep``, and paged. Exact titles are sought with the query as typed.
    """
    name, _ = lexical.pick_ranker(ranker, lexical.RANKERS)
    expanded = rewrite.expand(queries, rules)
    fixes = rewrite.corrections(lexical.query_tokens(expanded), vocabulary)
    rewritten = rewrite.apply_corrections(expanded, fixes)
    tokens = lexical.query_tokens(rewritten)
    guarded = rewrite.guard(rewritten, tokens, vocabulary)
    exact = None if titles is None else lexical.exact_title_hits(titles, queries)
    # a refused query has no known word and so no contributions: the guard needs no join before ranking
    hits = lexical.search(docs, tokens, name, k, offset, exact, keep)
    return {"hits": hits, "guarded": guarded, "rewritten": rewritten}


@dataclass
class Filters:
    """The facets of a request. ``done``: done, notdone or all, by the state of who asks."""

    platforms: set[str] = field(default_factory=set)
    pattern: str | None = None
    difficulty: facets.Difficulty | None = None
    done: str = "all"

    def any(self) -> bool:
        return bool(self.platforms or self.pattern or self.difficulty or self.done in ("done", "notdone"))

    def chosen(self, corpus: DataFrame, state: DataFrame | None, tiered: str) -> DataFrame:
        rows = facets.facet_filter(corpus, self.platforms, self.pattern, self.difficulty.predicate(tiered) if self.difficulty else None)
        return facets.done_filter(rows, None if state is None else state.where("done"), self.done)


def serve_requests(docs: DataFrame, corpus: DataFrame, queries: DataFrame, rules: list[rewrite.Alias], vocabulary: DataFrame, filters: Filters, state: DataFrame | None = None, ranker: str | None = None, sort: str | None = None,
                   sortable: set[str] = frozenset(), tiered: str = "leetcode", k: int = 10, offset: int = 0, titles: DataFrame | None = None, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None) -> dict:
    """The whole route of a search for many queries (qid, query): ``hits``, ``guarded``, ``rewritten`` and ``sort_refused``.

    A blank query with any filter browses: everything chosen, in the corpus's order or
    by difficulty, with score 0; without a filter it has no hits. Other queries are
    expanded, corrected, guarded and ranked as by ``serve``, then filtered. Sorting by
    difficulty takes exactly one sortable platform, else it is refused; in a search it
    reorders the first ``k`` by relevance, and the offset plays no part. ``dense`` and
    ``hybrid`` rank by ``query_vectors`` (qid, vector) behind the same guard. ``state``
    (doc_id, done, bookmarked, recall) of who asks decorates the hits.
    """
    direction = facets.parse_sort(sort)
    allowed = direction is not None and facets.sort_allowed(filters.platforms, set(sortable))
    chosen = filters.chosen(corpus, state, tiered)
    is_blank = F.regexp_replace(F.coalesce("query", F.lit("")), r"\s+", "") == ""
    asked, blank = queries.where(~is_blank), queries.where(is_blank)
    start = 0 if allowed else offset
    name = (ranker or "").lower().strip()
    keep = chosen if filters.any() else None
    out = serve(docs, asked, rules, vocabulary, name if name in lexical.RANKERS else None, keep, k, start, titles)
    if name in ("dense", "hybrid") and vectors is not None and query_vectors is not None:
        known = query_vectors.join(out["guarded"].where("NOT refused").select("qid"), "qid", "left_semi")
        own = vectors if keep is None else vectors.join(keep.select("doc_id"), "doc_id", "left_semi")
        if name == "dense":
            hits = dense.with_total(dense.search(own, known, k, start), own)
        else:
            depth = max(dense.RRF_DEPTH, k + start)
            lex = lexical.search(docs, lexical.query_tokens(out["rewritten"]), "bm25", depth)
            fused = dense.fuse(lex, dense.search(vectors, known, depth), 2 * depth)  # filters come after the ranking
            fused = fused if keep is None else fused.join(keep.select("doc_id"), "doc_id", "left_semi")
            fused = fused.withColumn("total", F.count("*").over(Window.partitionBy("qid")))
            hits = ranked(fused.drop("rank"), ["qid"], [F.col("score").desc(), F.col("lex_rank").asc_nulls_last(), F.col("doc_id")], k, start)
    else:
        hits = out["hits"]
    hits = hits.select("qid", "rank", "doc_id", "score", "total")
    if allowed:
        hits = facets.sort_window(hits, corpus, k, direction == "desc").withColumn("rank", F.col("sorted_rank")).select("qid", "rank", "doc_id", "score", "total")
    if filters.any():
        order = facets.difficulty_order(direction == "desc") if allowed else [F.col("doc_id")]
        page = chosen.orderBy(*order).limit(k + offset)  # one page for all blank queries
        page = ranked(page.withColumn("_all", F.lit(1)), ["_all"], order, k, offset).crossJoin(F.broadcast(chosen.agg(F.count("*").alias("total"))))  # one row
        browsed = bounded_broadcast(blank.select("qid")).crossJoin(page).select("qid", (F.col("rank") - offset).cast("int").alias("rank"), "doc_id", F.lit(0.0).alias("score"), "total")
        hits = hits.unionByName(browsed)
    if state is not None:
        hits = facets.decorate(hits, state)
    return out | {"hits": hits, "sort_refused": direction is not None and not allowed}
