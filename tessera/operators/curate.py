"""Corpus checks, label cleaning, merges and ingest decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

MAX_BODY, MAX_LABELS = 600, 12


def rule_violations(corpus: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """``doc_id, level, rule`` for each rule (name: level, broken-if) that a row breaks."""
    found = F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.struct(F.lit(level).alias("level"), F.lit(name).alias("rule"))) for name, (level, broken) in rules.items()]), lambda x: x.isNotNull())
    return corpus.select("doc_id", F.explode(found).alias("v")).select("doc_id", "v.level", "v.rule")


#: Judges whose difficulty is a named tier, or a number; the tiers; and the easy records that a hard corpus keeps on purpose. Fixed values.
TIERED, RATED = ("leetcode",), ("codeforces", "atcoder")
TIER_NAMES = ("Easy", "Medium", "Hard")
ANCHORS = ("leetcode-two-sum", "leetcode-climbing-stairs", "leetcode-valid-parentheses", "leetcode-binary-search")


def record_rules(tiered: tuple[str, ...] = TIERED, rated: tuple[str, ...] = RATED, anchors: tuple[str, ...] = ANCHORS, max_labels: int = MAX_LABELS, max_body: int = MAX_BODY) -> dict[str, tuple[str, Column]]:
    """The rules for a record as its file has it.

    Columns: ``folder`` and ``basename`` of the file; ``id, title, slug, platform,
    source_url, statement, source_topic``; ``difficulty`` as text with its JSON type
    beside it in ``difficulty_type`` (``string``, ``number`` or null); ``tags`` and
    ``patterns`` (null: no arrays); ``version`` and ``confidence`` of the annotation.
    Labels outside the taxonomy are no violation but drift (see ``drift``).
    """
    none = F.array().cast("array<string>")
    empty = lambda c: T.stripped(F.coalesce(F.col(c), F.lit(""))) == ""
    of = lambda names: F.coalesce(F.col("folder").isin(*names), F.lit(False))
    rules = {f"{c}_missing": ("error", empty(c)) for c in ("id", "title", "slug", "platform", "source_url", "statement")}
    rules |= {
        "platform_not_folder": ("error", ~F.coalesce(F.col("platform") == F.col("folder"), F.lit(False))),
        "id_not_filename": ("error", ~F.coalesce(F.col("id") == F.col("basename"), F.lit(False))),
        "id_prefix": ("error", F.coalesce(~F.startswith(F.col("id"), F.concat("folder", F.lit("-"))), F.lit(False))),
        "tier_unknown": ("error", of(tiered) & ~F.coalesce((F.col("difficulty_type") == "string") & F.col("difficulty").isin(*TIER_NAMES), F.lit(False))),
        "easy_not_anchor": ("warning", of(tiered) & F.coalesce(F.col("difficulty") == "Easy", F.lit(False)) & ~F.coalesce(F.col("id").isin(*anchors), F.lit(False))),
        "rating_not_number": ("error", of(rated) & F.col("difficulty").isNotNull() & ~F.coalesce(F.col("difficulty_type") == "number", F.lit(False))),
        "slug_invalid": ("error", F.coalesce(~T.is_slug("slug"), F.lit(False))),
        "version_missing": ("error", F.col("version").isNull()),
    }
    for c in ("tags", "patterns"):
        labels = F.coalesce(c, none)
        rules |= {
            f"{c}_no_array": ("error", F.col(c).isNull()), f"{c}_many": ("error", F.size(labels) > max_labels), f"{c}_repeated": ("error", F.size(F.array_distinct(labels)) != F.size(labels)),
            f"{c}_invalid": ("error", F.exists(labels, lambda x: ~F.coalesce(T.is_slug(x), F.lit(False)))),
        }
    strays = F.array_except(F.coalesce(F.map_keys("confidence"), none), F.coalesce("patterns", none))
    return rules | {
        "confidence_stray": ("warning", F.size(strays) > 0), "statement_long": ("warning", F.coalesce(F.length("statement") > max_body, F.lit(False))), "topic_missing": ("warning", F.coalesce(F.col("source_topic"), F.lit("")) == ""),
    }


def duplicates(corpus: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key others share, with how many."""
    w = Window.partitionBy(*keys)
    return corpus.withColumn("copies", F.count("*").over(w)).where("copies > 1")


def duplicate_keys(corpus: DataFrame, *keys: str) -> DataFrame:
    """The shared keys alone: counted before the shuffle."""
    return corpus.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def dangling(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    return qrels.join(corpus.select("doc_id"), "doc_id", "left_anti")


SLICES = ("keyword", "paraphrase", "technique", "title")


def query_faults(queries: DataFrame, qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """``qid, fault``: blank queries, unknown slices, queries without a judgement, and judgements of records that aren't there."""
    blank = queries.where(F.length(F.trim(F.coalesce("query", F.lit("")))) == 0).select("qid", F.lit("query_blank").alias("fault"))
    odd = queries.where(F.col("slice").isNotNull() & ~F.col("slice").isin(*SLICES)).select("qid", F.lit("slice_unknown").alias("fault"))
    none = queries.join(qrels.select("qid"), "qid", "left_anti").select("qid", F.lit("no_relevant").alias("fault"))
    lost = dangling(qrels, corpus).select("qid", F.lit("relevant_unknown").alias("fault")).distinct()
    return blank.unionByName(odd).unionByName(none).unionByName(lost)


def taxonomy_faults(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases whose target isn't canonical, and names that are both."""
    names = labels.select(F.col("label"))
    lost = aliases.join(names, aliases["canonical"] == names["label"], "left_anti").select("alias", "canonical", F.lit("target_unknown").alias("fault"))
    both = aliases.join(names, aliases["alias"] == names["label"], "left_semi").select("alias", "canonical", F.lit("alias_is_canonical").alias("fault"))
    return lost.unionByName(both)


def artifact_drift(corpus: DataFrame, artifact: DataFrame) -> DataFrame:
    """``doc_id, fault`` for ids on one side only, and for other digests."""
    a, b = corpus.select("doc_id", F.col("digest").alias("a")), artifact.select("doc_id", F.col("digest").alias("b"))
    fault = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "doc_id", "full").select("doc_id", fault.alias("fault")).where("fault is not null")


def corpus_fingerprint(corpus: DataFrame) -> DataFrame:
    """An order-free digest of all records: sums of the halves of their digests, and their number. No single task sees the corpus."""
    half = lambda a: F.conv(F.substring("digest", a, 15), 16, 10).cast("decimal(38,0)")
    return corpus.agg(F.count("*").alias("n"), F.sum(half(1)).alias("h1"), F.sum(half(16)).alias("h2"))


def normalize_labels(rows: DataFrame, aliases: dict[str, str], cap: int = MAX_LABELS) -> DataFrame:
    """Tags, patterns and confidence keys canonical; first kept, largest confidence kept."""
    out = rows.withColumns({c: T.clean_labels(c, aliases, cap) for c in ("tags", "patterns") if c in rows.columns})
    return out.withColumn("confidence", T.clean_confidence("confidence", aliases)) if "confidence" in rows.columns else out


#: Judge tags that name a genre and say nothing about a record. Fixed values.
GENERIC = (
    "implementation", "brute-force", "constructive-algorithm", "data-structure", "simulation", "math", "greedy", "sorting", "two-pointers", "binary-search", "dynamic-programming", "dfs", "bfs",
    "divide-and-conquer", "bit-manipulation", "counting", "string", "array", "graph", "tree", "hash-map", "heap", "stack", "queue", "matrix", "recursion", "memoization", "number-theory", "combinatorics",
    "geometry", "probability", "game-theory", "interactive", "shortest-path",
)


def add_labels(rows: DataFrame, new: DataFrame, canonical: list[str], aliases: dict[str, str] | None = None, generic: tuple[str, ...] = GENERIC, cap: int = MAX_LABELS) -> DataFrame:
    """Append source tags (doc_id, labels) to ``tags``, as far as there is room.

    A tag becomes the canonical label of its slug, or of the alias that its slug is;
    others, generic ones, and those that the record has among ``tags`` or ``patterns``
    are left out. Tags stay in their order, the first of equal ones counts. Running it
    again changes nothing.
    """
    none = F.array().cast("array<string>")
    known = {a: c for a, c in (aliases or {}).items()} | {c: c for c in canonical}
    table = F.create_map(*[F.lit(x) for kv in known.items() if kv[1] not in generic for x in kv]) if known else F.create_map().cast("map<string,string>")
    more = new.groupBy("doc_id").agg(F.flatten(F.array_sort(F.collect_list("labels"))).alias("_raw"))
    out = rows.join(more, "doc_id", "left").withColumn("tags", F.coalesce("tags", none))
    fold = F.filter(F.transform(F.coalesce("_raw", none), lambda x: F.try_element_at(table, T.slugify(x))), lambda x: x.isNotNull())
    fresh = F.array_except(F.array_distinct(fold), F.concat("tags", F.coalesce("patterns", none)))
    return out.withColumn("tags", F.concat("tags", F.slice(fresh, 1, F.greatest(F.lit(cap) - F.size("tags"), F.lit(0))))).drop("_raw")


def merge_curated(rows: DataFrame, curated: DataFrame, topic_tags: dict[str, str], aliases: dict[str, str] | None = None, cap: int = MAX_LABELS, confidence: float = 0.9) -> DataFrame:
    """Labels (``doc_id, curated, topics``) merged into ``patterns, tags, confidence``: patterns as far as there is room, each new one with that confidence; every topic's tag. Running it again changes nothing."""
    one = curated.groupBy("doc_id").agg(F.flatten(F.array_sort(F.collect_list("curated"))).alias("_new"), F.array_distinct(F.flatten(F.array_sort(F.collect_list("topics")))).alias("_topics"))
    out = rows.join(one, "doc_id", "left").withColumns({"patterns": F.coalesce("patterns", F.array().cast("array<string>")), "tags": F.coalesce("tags", F.array().cast("array<string>"))})
    more = F.array_except(T.clean_labels("_new", aliases, 1 << 20), "patterns")
    out = out.withColumn("_more", F.slice(more, 1, F.greatest(F.lit(cap) - F.size("patterns"), F.lit(0))))
    table = F.create_map(*[F.lit(x) for kv in topic_tags.items() for x in kv]) if topic_tags else F.create_map().cast("map<string,string>")
    tags = F.filter(F.transform(F.coalesce("_topics", F.array().cast("array<string>")), lambda x: F.try_element_at(table, x)), lambda x: x.isNotNull())
    scores = F.map_concat(F.map_filter(F.coalesce("confidence", F.create_map().cast("map<string,double>")), lambda k, _: ~F.array_contains("_more", k)), F.map_from_arrays("_more", F.transform("_more", lambda _: F.lit(confidence))))
    return out.withColumns({"confidence": scores, "patterns": F.concat("patterns", "_more"), "tags": F.array_union("tags", tags)}).drop("_new", "_topics", "_more")


def merge_review(rows: DataFrame, queue: DataFrame, aliases: dict[str, str] | None = None, cap: int = MAX_LABELS) -> DataFrame:
    """A review queue (``doc_id, candidates`` of label and confidence, in order) merged into ``patterns, confidence``.

    Candidates are folded; those that are there, and those beyond the cap, are left
    out; the first of equal ones counts, its confidence rounded to 2 places.
    """
    c = queue.select("doc_id", F.posexplode("candidates").alias("_i", "c")).select("doc_id", "_i", T.canonical_label("c.label", aliases).alias("label"), F.round(F.coalesce(F.col("c.confidence").try_cast("double"), F.lit(0.0)), 2).alias("s")).where("label <> ''")
    one = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_i", "label", "s"))).alias("_c"))
    have = F.transform(F.coalesce("patterns", F.array().cast("array<string>")), lambda x: T.canonical_label(x, aliases))
    out = rows.join(one, "doc_id", "left").withColumn("patterns", F.coalesce("patterns", F.array().cast("array<string>")))
    new = F.filter(F.coalesce("_c", F.array().cast("array<struct<_i:int,label:string,s:double>>")), lambda x: ~F.array_contains(have, x["label"]))
    firsts = F.filter(new, lambda x: ~F.exists(new, lambda y: (y["label"] == x["label"]) & (y["_i"] < x["_i"])))
    out = out.withColumn("_m", F.slice(firsts, 1, F.greatest(F.lit(cap) - F.size("patterns"), F.lit(0))))
    names = F.transform("_m", lambda x: x["label"])
    scores = F.map_concat(F.map_filter(F.coalesce("confidence", F.create_map().cast("map<string,double>")), lambda k, _: ~F.array_contains(names, k)), F.map_from_arrays(names, F.transform("_m", lambda x: x["s"])))
    return out.withColumns({"confidence": scores, "patterns": F.concat("patterns", names)}).drop("_c", "_m")


def candidate_labels(candidates: DataFrame, rows: DataFrame, canonical: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, label, confidence, in_taxonomy`` of proposed labels (doc_id, label, confidence) that aren't among the record's patterns; each proposal is a row.

    A confidence that is no number counts as 0. Proposals without a label go.
    """
    c = candidates.select("doc_id", T.canonical_label("label", aliases).alias("label"), F.coalesce(T.unit_interval("confidence"), F.lit(0.0)).alias("confidence")).where("label <> ''")
    have = rows.select("doc_id", F.explode("patterns").alias("label")).select("doc_id", T.canonical_label("label", aliases).alias("label"))
    known = canonical.select("label").distinct().withColumn("in_taxonomy", F.lit(True))
    return c.join(have, ["doc_id", "label"], "left_anti").join(known, "label", "left").select("doc_id", "label", "confidence", F.coalesce("in_taxonomy", F.lit(False)).alias("in_taxonomy"))


def first_of(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_key", key).withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where("_r = 1").drop("_key", "_r")


def collapse_blank_lines(lines: DataFrame) -> DataFrame:
    """``file, line_no, line`` with one of each run of blank lines; one window per file."""
    blank = F.trim("line") == ""
    w = Window.partitionBy("file").orderBy("line_no")
    return lines.withColumn("_before", F.lag(F.trim("line") == "", 1, False).over(w)).where(~(blank & F.col("_before"))).drop("_before")


def dedupe_urls(lines: DataFrame) -> DataFrame:
    """``file, line_no, line`` with each URL once, where it comes first: whole lines count, without white space around them.

    Of runs of blank lines one stays, none at the end; other lines keep their indent.
    Only URLs meet in a window by their text, so blank lines don't gather in one task.
    """
    text = T.stripped("line")
    url = text.startswith("http://") | text.startswith("https://")
    key = F.struct("file", F.when(url, text).alias("url"), F.when(~url, F.col("line_no")).alias("no"))
    first = first_of(lines, key, [F.col("line_no")])
    shown = first.withColumn("line", F.when(url, text).otherwise(F.regexp_replace("line", r"\s+$", "")))
    end = shown.where("line <> ''").groupBy("file").agg(F.max("line_no").alias("_end"))
    return collapse_blank_lines(shown).join(end, "file").where(F.col("line_no") <= F.col("_end")).drop("_end")


def carry_down(lines: DataFrame, heading: Column) -> DataFrame:
    """Each line with the last heading at or before it in its file."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("topic", F.last(heading, ignorenulls=True).over(w))


def backfill(rows: DataFrame, lookup: DataFrame, key: str, column: str) -> DataFrame:
    """Fill a missing column from a lookup; ``missing`` says what neither has."""
    found = lookup.select(key, F.col(column).alias("_found"))
    out = rows.join(found, key, "left").withColumn(column, F.coalesce(column, "_found")).drop("_found")
    return out.withColumn("missing", F.col(column).isNull())


def bands(value: str, edges: list[tuple[float, str]], last: str) -> Column:
    out = F.lit(last)
    for edge, name in reversed(edges):
        out = F.when(F.col(value) < edge, name).otherwise(out)
    return F.when(F.col(value).isNotNull(), out)


def ingest_split(wanted: DataFrame, present: DataFrame, staged: DataFrame, skip: Column) -> DataFrame:
    """``id, decision``: present, staged, skipped or queued."""
    rows = wanted.join(present.select("id", F.lit(True).alias("_p")), "id", "left").join(staged.select("id", F.lit(True).alias("_s")), "id", "left")
    return rows.withColumn("decision", F.when(F.col("_p"), "present").when(skip, "skipped").when(F.col("_s"), "staged").otherwise("queued")).drop("_p", "_s")


def fold_topics(rows: DataFrame, key: str = "id", topic: str = "topic") -> DataFrame:
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(topic)).alias("topics"))


def drift(labels: DataFrame, canonical: DataFrame, samples: int = 3) -> DataFrame:
    """``label, n, mean_confidence, sample_ids`` of unknown labels, most frequent first."""
    w = Window.partitionBy("label").orderBy("doc_id")
    rows = labels.join(canonical.select("label"), "label", "left_anti").withColumn("_r", F.row_number().over(w))
    out = rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.array_sort(F.collect_list(F.when(F.col("_r") <= samples, F.col("doc_id")))).alias("sample_ids"))
    return out.orderBy(F.desc("n"), F.desc("mean_confidence"), "label")


@dataclass(frozen=True)
class Prop:
    """How a property of an event is cleaned: ``text`` cut to ``most``; ``whole`` between ``least`` and ``most``; ``number``; ``flag``; or one of ``values``."""

    kind: str
    least: int | None = None
    most: int | None = None
    values: tuple[str, ...] = ()


def _text(n: int) -> Prop:
    return Prop("text", most=n)


#: The types of events that are taken, and each one's properties. Fixed values.
EVENT_PROPS: dict[str, dict[str, Prop]] = {
    "result_open": {"problemId": _text(120), "ranker": _text(20), "position": Prop("whole", 1, 100_000), "kind": Prop("one", values=("external", "expand"))},
    "pattern_selected": {"pattern": _text(60)},
    "ranker_changed": {"from": _text(20), "to": _text(20)},
    "load_more": {"ranker": _text(20), "offset": Prop("whole", 0)},
    "search_feedback": {"useful": Prop("flag"), "reason": _text(200), "ranker": _text(20), "q": _text(100)},
    "platform_selected": {"platform": _text(20), "active": _text(60)},
    "difficulty_selected": {"tier": _text(20), "judge": _text(20), "acceptance": _text(20), "min": Prop("number"), "max": Prop("number")},
    "sort_changed": {"dir": _text(20)},
    "level_applied": {"judges": Prop("whole", 0, 10)},
    "level_cleared": {},
    "library_aged": {"days": Prop("whole", 0, 100_000)},
    "library_order": {"oldest": Prop("flag")},
    "library_recall": {"value": _text(20)},
    "recall_set": {"problemId": _text(120), "value": _text(20)},
    "note_saved": {"problemId": _text(120), "chars": Prop("whole", 0, 100_000)},
}
SEARCH_ID = r"^[a-fA-F0-9-]{8,40}$"


def _number(x: Column) -> Column:
    """What a JSON value is as a number: booleans are 0 and 1, null and blank text 0, other text what it says; null if none."""
    kind = F.schema_of_variant(x)
    text = T.stripped(F.try_variant_get(x, "$", "string"))
    told = F.when(text == "", F.lit(0.0)).when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    return F.when(kind == "VOID", F.lit(0.0)).when(kind == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("double")).when(kind == "STRING", told).when(~kind.rlike("^(ARRAY|OBJECT)"), F.try_variant_get(x, "$", "double"))


def _cleaned(x: Column, rule: Column) -> Column:
    """A property's JSON value as JSON text, or null if it isn't there or doesn't pass; ``rule``: a struct as ``Prop``, with the texts' kinds first."""
    kind = rule["kind"]
    text = F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    kept = F.when(kind == "one", F.when(F.array_contains(rule["values"], text), text)).otherwise(F.when(text != "", F.substr(text, F.lit(1), rule["most"].cast("int"))))
    shown = F.to_json(F.struct(kept.alias("v")))  # {"v":...}
    quoted = F.when(kept.isNotNull(), F.substr(shown, F.lit(6), F.length(shown) - 6))
    flag = F.when((F.schema_of_variant(x) == "BOOLEAN") & F.try_variant_get(x, "$", "boolean"), "true").otherwise("false")
    n = _number(x)
    fits = ~F.isnan(n) & (F.abs(n) < float("inf"))
    whole = F.when(fits & (n == F.floor(n)) & (n >= rule["least"].cast("double")) & (n <= F.coalesce(rule["most"].cast("double"), F.lit(2.0**53))), n.cast("long").cast("string"))
    number = F.when(fits, F.when((n == F.floor(n)) & (F.abs(n) < 1e15), n.cast("long").cast("string")).otherwise(n.cast("string")))
    return F.when(kind.isin("text", "one"), quoted).when(kind == "flag", flag).when(kind == "whole", whole).otherwise(number)


def clean_events(events: DataFrame, types: dict[str, dict[str, Prop]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): events of the listed types, each with its type's properties cleaned and the id of its search; all others as they came.

    ``props`` is JSON text before and after; what isn't an object has no properties. It is
    parsed once a row, and a row's properties go one by one through the rules of its type:
    the plan doesn't grow with types and properties.
    """
    types = EVENT_PROPS if types is None else types
    kind = F.col("type")
    ok = F.coalesce(kind.isin(*types), F.lit(False))
    order = list(dict.fromkeys((p, rule) for props in types.values() for p, rule in props.items()))
    lit = lambda v, t: F.lit(v).cast(t)
    row = lambda p, r: F.struct(F.lit(p).alias("name"), F.lit(r.kind).alias("kind"), lit(r.least, "long").alias("least"), lit(r.most, "long").alias("most"), F.array(*map(F.lit, r.values)).cast("array<string>").alias("values"))
    none = F.array().cast("array<struct<name:string,kind:string,least:bigint,most:bigint,values:array<string>>>")
    rules = F.create_map(*[x for name, props in types.items() for x in (F.lit(name), F.array(*[row(p, r) for p, r in order if props.get(p) == r]) if props else none)])
    found = F.try_element_at("_tessera_all", F.lit("searchId"))
    search = F.when(F.schema_of_variant(found).rlike("^(STRING|BIGINT)$"), F.try_variant_get(found, "$", "string"))
    first = F.when(search.rlike(SEARCH_ID), F.concat(F.lit('"searchId":"'), search, F.lit('"')))

    def entry(rule):
        return F.concat(F.lit('"'), rule["name"], F.lit('":'), _cleaned(F.try_element_at("_tessera_all", rule["name"]), rule))

    entries = F.concat(F.array(first), F.transform(F.try_element_at(rules, kind), entry))
    json = F.concat(F.lit("{"), F.array_join(F.array_compact(entries), ","), F.lit("}"))
    parsed = events.where(ok).withColumn("_tessera_all", F.try_variant_get(F.try_parse_json("props"), "$", "map<string,variant>"))
    return parsed.withColumn("props", json).drop("_tessera_all"), events.where(~ok)


def tag_additions(before: DataFrame, after: DataFrame, limit: int = 15) -> DataFrame:
    """The tags added most often."""
    rows = after.join(before.select("doc_id", F.col("tags").alias("_old")), "doc_id").select(F.explode(F.array_except("tags", "_old")).alias("tag"))
    return rows.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(limit)
