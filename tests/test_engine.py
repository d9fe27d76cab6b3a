import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import curate, facets, state, stats
from tessera.plans import more, quality
from tessera.sources import readers, writers
from tessera.streaming import events as streams


def osa(a, b):
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_osa_distance(spark):
    words = ["", "a", "ca", "abc", "djikstra", "dijkstra", "tree", "rtee", "abcdef", "badcfe"]
    rows = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string").withColumn("d", T.osa_distance("a", "b")).collect()
    assert all(r["d"] == osa(r["a"], r["b"]) for r in rows)


def test_text_functions(spark):
    row = spark.createDataFrame([("The Two-Sum & more!", "<p>a&lt;b</p><script>x</script> c")], "t string, h string").select(
        T.tokenize("t").alias("tok"), T.slugify("t").alias("slug"), T.html_to_text("h").alias("html"), T.has_usable_text("t").alias("ok"), T.day_bucket(F.lit(86401)).alias("day"), T.snap(F.lit(1234), 100, True).alias("up")).first()
    assert row["tok"] == ["two", "sum", "more"] and row["slug"] == "the-two-sum-more" and row["html"] == "a<b c" and row["ok"] is False and row["day"] == 86400 and row["up"] == 1300


def test_difficulty_and_paging():
    d = facets.Difficulty.parse("lc-easy,cf:1500-800,cf:900-1000,ac:80-20,nope,atc:-5-7", "lc", {"cf": "codeforces", "atc": "atcoder"})
    assert d.tiers == {"easy"} and d.ranges == {"codeforces": (900, 1000), "atcoder": (-5, 7)} and d.acceptance == (20, 80)
    assert facets.parse_page("x", -4) == (10, 0) and facets.parse_sort("-difficulty") == "desc" and facets.parse_sort("hardest") is None and not facets.sort_allowed({"a", "b"}, {"a", "b"})
    assert facets.parse_set("a,b", ["a", "b"]) == set() and facets.parse_set("A,zz", ["a", "b"]) == {"a"}


def test_text_values():
    assert len(T.STOPWORDS) == len(set(T.STOPWORDS)) == 69 and T.STOPWORDS[:4] == ["a", "an", "the", "and"] and {"given", "return", "yes", "such", "each", "some"} <= set(T.STOPWORDS) and not {"two", "all", "most", "other"} & set(T.STOPWORDS)


def test_pages_and_urls(spark):
    html = "<h1>A &amp;copy; b</h1><p>x<br>y # Input z # Note w &nbsp; 1 < 2</p><style>p{}</style><!-- c --><a title='a>b'>link</a>"
    r = spark.createDataFrame([(html, "https://codeforces.com/problemset/problem/0042/C2", " \t" + "x" * 39 + "\u00a0", "Please Enable JavaScript and cookies to go on with this page")], "h string, u string, short string, blocked string").select(
        T.html_to_text("h").alias("text"), T.trim_page("h").alias("page"), T.problem_id("u").alias("id"), T.platform(F.lit("http://www.X.org/a")).alias("p"), T.has_usable_text("short").alias("short"), T.has_usable_text("blocked").alias("blocked"), T.is_problem_id(F.lit("Two_Sum")).alias("bad")).first()
    assert r["text"] == "A \u00a9 b x y # Input z # Note w 1 < 2 link" and r["page"] == "A \u00a9 b x y Input: z # Note w 1 < 2 link"
    assert (r["id"], r["p"], r["short"], r["blocked"], r["bad"]) == ("codeforces-42-c2", "x.org", False, False, False)


def test_references_without_a_semicolon(spark, tmp_path):
    html = "<h1>A&&amp</h1><p>b &amp;amp; c &copy; &nosuch; &#39;&amp;lt;&copy d"
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert quality.t7_html(spark, str(tmp_path)).first()["text"] == "A&&amp b & c \u00a9 &nosuch; '<&copy d"
    assert more.t8_trim_page(spark, str(tmp_path)).first()["text"] == "A&&amp Output: b & c \u00a9 &nosuch; '<&copy d"
    r = spark.createDataFrame([(html,)], "h string").select(T.html_to_text("h").alias("text")).first()
    assert r["text"] == "A&& b & c \u00a9 &nosuch; '<\u00a9 d"


def test_event_cleaning_parses_a_row_once_whatever_the_types(spark):
    e = spark.createDataFrame([(1, "load_more", '{"offset": null, "ranker": "", "searchId": "abcdef12"}'), (2, "library_order", "[1]"), (3, "level_cleared", '{"oldest": true}'), (4, "none", "{"), (5, "difficulty_selected", '{"max": "1e3", "min": true, "tier": "' + "x" * 30 + '"}'), (6, "search_feedback", '{"q": "b", "useful": true, "reason": 1}')], "id long, type string, props string")
    ok, bad = curate.clean_events(e)
    assert {r["id"]: r["props"] for r in ok.collect()} == {1: '{"searchId":"abcdef12","offset":0}', 2: '{"oldest":false}', 3: "{}", 5: '{"tier":"' + "x" * 20 + '","min":1,"max":1000}', 6: '{"useful":true,"q":"b"}'}
    assert [tuple(r) for r in bad.collect()] == [(4, "none", "{")]
    size = lambda n: len(curate.clean_events(e, {f"t{i}": curate.EVENT_PROPS["load_more"] for i in range(n)})[0].select(F.col("props").alias("x"))._jdf.queryExecution().analyzed().toString().split("variant_get"))
    assert size(2) == size(30)
    assert ok._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "").count("parsejson") == 1


def lifecycle(*changes):
    """The state by carrying out one change after another."""
    row = None
    for kind, value in changes:
        if kind == "recall":
            if row and value == "none" and not row["done"] and not row["bookmarked"]:
                row = None
            elif row:
                row["recall"] = None if value == "none" else value
        elif value == "true":
            row = {"done": False, "bookmarked": False, "recall": None} | (row or {}) | {kind: True}
        elif row:
            row[kind] = False
            if not row["done"] and not row["bookmarked"] and row["recall"] is None:
                row = None
    return row and (row["done"], row["bookmarked"], row["recall"])


def test_state_lifecycle(spark):
    import random

    r = random.Random(5)
    steps = [("done", "true"), ("done", "false"), ("bookmarked", "true"), ("bookmarked", "false"), ("recall", "hard"), ("recall", "easy"), ("recall", "none")]
    cases = [[steps[i] for i in x] for x in ((0, 4, 1, 6), (0, 4, 1, 5), (4,), (2, 3), (0, 6), (0, 4, 1, 6, 5), (2, 4, 3, 2), (0, 4, 1, 5, 6, 0))] + [[r.choice(steps) for _ in range(r.randint(1, 12))] for _ in range(400)]
    rows = [(1, p, s, k, v) for p, case in enumerate(cases) for s, (k, v) in enumerate(case)]
    ch = spark.createDataFrame(rows, "user_id long, problem_id long, seq long, kind string, value string").withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,seq)"))
    got = {r["problem_id"]: (r["done"], r["bookmarked"], r["recall"]) for r in state.fold(ch).collect()}
    assert got == {p: x for p, case in enumerate(cases) if (x := lifecycle(*case)) is not None}
    assert 0 not in got and got[1] == (False, False, "easy")


def level_corpus(spark):
    rows = [("codeforces", None, float(r), None) for r in range(800, 3501, 100) for _ in range(3)] + [("atcoder", None, float(r), None) for r in range(0, 2401, 200) for _ in range(3)]
    rows += [("leetcode", "Medium", None, 15.0 + i % 70) for i in range(200)] + [("leetcode", "Hard", None, 14.0 + i % 66) for i in range(200)] + [("cses", None, None, None)] * 50
    return spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, platform string, tier string, rating double, acceptance double")


def test_level_suggestions(spark):
    c = level_corpus(spark)
    users = spark.createDataFrame([(1, "codeforces", 1834.0), (2, "codeforces", 1600.0), (3, "codeforces", 3600.0), (4, "codeforces", 400.0), (5, "atcoder", 1100.0), (6, "codechef", 1900.0), (7, "codeforces", None), (8, "cses", 900.0)], "user_id long, platform string, rating double")
    got = {r["user_id"]: (r["low"], r["high"], r["n"]) for r in facets.suggest_rated(c, users).collect()}
    assert got == {1: (1800, 2000, 9), 2: (1600, 1800, 9), 3: (3300, 3500, 9), 4: (800, 1000, 9), 5: (1000, 1200, 6)}
    odd = spark.createDataFrame([(1, "codeforces", 850.0), (2, "codeforces", 3550.0)], "doc_id long, platform string, rating double")
    ends = spark.createDataFrame([(1, "codeforces", 700.0), (2, "codeforces", 3600.0), (3, "codeforces", 2000.0)], "user_id long, platform string, rating double")
    assert {r["user_id"]: (r["low"], r["high"]) for r in facets.suggest_rated(odd, ends).collect()} == {1: (800, 1000), 2: (3400, 3600)}
    solved = spark.createDataFrame([(1, 40, 2), (2, 300, 5), (3, 400, 60), (4, 700, 250), (5, 0, 0), (6, 20, 1), (7, 400, 1), (8, None, 24), (9, 1, 100)], "user_id long, medium long, hard long")
    got = {r["user_id"]: (r["tier"], r["low"], r["high"], r["n"]) for r in facets.suggest_tier(c, solved).collect()}
    rates = {"medium": [15 + i % 70 for i in range(200)], "hard": [14 + i % 66 for i in range(200)]}
    assert all(n == sum(low <= x <= high for x in rates[tier]) > 0 for tier, low, high, n in got.values()) and set(got) == {1, 2, 3, 4, 6, 7, 8, 9}
    assert [got[i][0] for i in (1, 2, 3, 4)] == ["medium", "medium", "hard", "hard"] and len({got[i] for i in (1, 2, 3, 4)}) == 4
    assert got[4][1] < got[3][1] and got[6] == got[1] and got[7] == got[8] == got[2] and got[9] == got[4]


def test_containing_finds_passages_of_any_length(spark):
    from tessera.plans import tables

    text = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu"
    docs = spark.createDataFrame([(1, text), (2, "xalpha beta"), (3, "alpha  beta gamma"), (4, None), (5, "")], "doc_id long, text string")
    w = text.split()
    passages = [(n, " ".join(w[:n])) for n in range(1, 13)] + [(20, "lpha beta gam"), (21, "ta gamma delta eps zeta eta theta iota ka"), (22, "beta  gamma"), (23, ""), (24, "alpha  b")]
    got = {tuple(r) for r in tables.containing(docs, spark.createDataFrame(passages, "qid long, passage string")).collect()}
    assert got == {(q, i) for q, p in passages for i, x in ((1, text), (2, "xalpha beta"), (3, "alpha  beta gamma"), (5, "")) if p and p in x}


def test_no_limit_on_a_join_side():
    import pathlib
    import re

    root = pathlib.Path(facets.__file__).parent.parent
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"broadcast\([^()]*\.limit\(", f.read_text()), f


def test_commands():
    from tessera.operators import command

    assert command.parse_command(":d", False).kind == "needs_account" and command.parse_command(":nope").kind == "unknown" and command.parse_command(":CMP a  b").argument == "a  b"


def test_sinks(spark, tmp_path):
    p = str(tmp_path)
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    writers.append_new(rows, f"{p}/k1")
    writers.append_new(rows.unionByName(spark.createDataFrame([(3, "c")], rows.schema)), f"{p}/k1")
    assert spark.read.parquet(f"{p}/k1").count() == 3
    with pytest.raises(ValueError):
        writers.write_vectors(spark.createDataFrame([(1, [2.0, 0.0])], "doc_id long, vector array<float>"), f"{p}/v")
    assert writers.write_vectors(spark.createDataFrame([(1, [1.0, 0.0])], "doc_id long, vector array<float>"), f"{p}/v") == 1
    kept = writers.split_rejects(rows, [("odd", F.col("id") % 2 == 1)], f"{p}/rej")
    assert kept.count() == 1 and spark.read.parquet(f"{p}/rej").first()["reason"] == "odd"
    writers.replace_blocks(rows.withColumn("b", F.col("id")), f"{p}/blk", "b")
    writers.replace_blocks(rows.where("id = 1").withColumn("v", F.lit("new")).withColumn("b", F.col("id")), f"{p}/blk", "b")
    assert {(r["id"], r["v"]) for r in spark.read.parquet(f"{p}/blk").collect()} == {(1, "new"), (2, "b")}
    writers.write_run(rows, f"{p}/run", "t1")
    writers.append_events(spark.sql("select 1L event_id, timestamp'2024-01-01' ts"), f"{p}/ev")
    writers.review_queue(spark.createDataFrame([(1, "l", 0.5)], "doc_id long, label string, confidence double"), f"{p}/rq")
    assert spark.read.json(f"{p}/run/latest").count() == 2 and spark.read.json(f"{p}/rq").count() == 1


def test_record_source(spark, tmp_path):
    for platform, name, rec in (("a", "x.json", {"id": "1", "difficulty": "Easy"}), ("a", "b.json", {"id": "2", "difficulty": 1200}), ("b", "c.json", {"id": "3"})):
        (tmp_path / platform).mkdir(exist_ok=True)
        (tmp_path / platform / name).write_text(json.dumps(rec))
    rows = readers.read_records(spark, str(tmp_path), ["b", "a", "missing"]).orderBy("doc_ord").collect()
    assert [(r["id"], r["tier"], r["rating"]) for r in rows] == [("3", None, None), ("2", None, 1200), ("1", "Easy", None)]
    (tmp_path / "b" / "bad.json").write_text("{oops")
    loose = readers.read_records(spark, str(tmp_path), ["b", "a"], strict=False)
    assert readers.violations_of(loose).count() == 1


def test_seed_urls_and_blank_runs(spark, tmp_path):
    (tmp_path / "seed.txt").write_text("# A / B\nhttp://x/1\n\n\nhttp://x/2\n# C\nhttp://x/3\n# The a / b\nx/4\n## D / E\nhttp://x/5")
    got = readers.read_seed_urls(spark, str(tmp_path / "seed.txt")).orderBy("line_no").collect()
    assert [(r["url"], r["topic"]) for r in got] == [("http://x/1", "A / B"), ("http://x/2", "A / B"), ("http://x/3", "A / B"), ("x/4", "A / B"), ("http://x/5", "D / E")]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(["a", "", " ", "b"])], "file string, line_no int, line string")
    assert curate.collapse_blank_lines(lines).count() == 3


def test_raw_vectors_and_artifact(spark, tmp_path):
    import numpy as np

    np.eye(3, dtype="<f4").tofile(tmp_path / "v.f32")
    v = readers.read_vectors(spark, str(tmp_path / "v.f32"), 3)
    assert readers.read_vectors(spark, str(tmp_path / "none.f32"), 3) is None
    (2 * np.eye(3, dtype="<f4")).tofile(tmp_path / "w.f32")
    both = readers.read_vectors(spark, str(tmp_path / "*.f32"), 3).orderBy("row").collect()
    assert [r["row"] for r in both] == list(range(6)) and both[3]["vector"][0] == 2
    ids = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "row long, doc_id string")
    assert readers.checked_artifact(v, {"dims": 3, "count": 3}, ids.select("doc_id"), ids).count() == 3
    with pytest.raises(ValueError):
        readers.checked_artifact(v, {"dims": 4, "count": 3}, ids.select("doc_id"), ids)
    with pytest.raises(ValueError):
        readers.checked_artifact(v, {"dims": 3, "count": 3, "model": "a"}, ids.select("doc_id"), ids, {"model": "b"})


def test_workbook(spark, tmp_path):
    path = tmp_path / "b.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>Name</t></si><si><t>foo</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="m" xmlns:r="r"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c></row></sheetData><hyperlinks><hyperlink ref="A2" r:id="rId1"/></hyperlinks></worksheet>')
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", '<Relationships xmlns="p"><Relationship Id="rId1" Target="http://x"/></Relationships>')
    grid = readers.read_xlsx(spark, str(path))
    assert grid.where("row = 2").first()["link"] == "http://x"
    assert [tuple(r) for r in readers.by_header(grid).collect()] == [(2, "name", "foo")]


def test_heatmap_levels(spark):
    days = spark.createDataFrame([(86400 * i, n) for i, n in enumerate([1, 2, 3, 4, 8], 1)], "day long, n long")
    got = {r["day"] // 86400: r["level"] for r in stats.heatmap(days, 86400 * 6, 1).collect()}
    assert got == dict.fromkeys(range(-4, 1), 0) | {1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 0}  # from the Sunday before


def test_streams_equal_batches(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.unionByName(e).repartition(3).write.parquet(str(tmp_path / "in"))
    source = streams.read_events(spark, str(tmp_path / "in"))
    assert streams.run_to_end(streams.deduplicated(source, "60 days"), "dedup_events").count() == e.count()
    counts = streams.run_to_end(streams.daily_counts(source, "0 seconds"), "daily_events", "complete")
    want = e.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg((F.count("*") * 2).alias("n"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.collect()))
    ch = spark.readStream.schema("user_id long, problem_id long, seq long, kind string, value string, ts timestamp_ntz")
    spark.sql("select 1L user_id, 2L problem_id, 1L seq, 'done' kind, 'true' value, timestamp_ntz'2024-01-01' ts").write.parquet(str(tmp_path / "ch"))
    streams.fold_state(ch.parquet(str(tmp_path / "ch")), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert state.fold(spark.read.parquet(str(tmp_path / "log"))).count() == 1


def test_bucket_table_merges(spark, tmp_path):
    from tessera.sources.bucketed import BucketTable, Conflict

    rows = spark.createDataFrame([(i, f"n{i}", i % 3) for i in range(200)] + [(None, "null key", 1), (5, "later", 9)], "id long, name string, size int")
    table = BucketTable.create(rows, str(tmp_path / "t"), "id", 8, order=F.col("size"))
    assert table.versions() == [0, 1] and table.read().count() == 201 and table.read().where("id = 5").first()["name"] == "later"
    before = table.manifest()["folders"]
    with pytest.raises(Conflict):
        BucketTable.create(rows, str(tmp_path / "t"), "id", 8)
    new = spark.createDataFrame([(7, "seven", None), (1000, "new", 1)], rows.schema)
    assert table.upsert(new) == 2
    touched = {str(r["b"]) for r in new.select(BucketTable.bucket("id", 8).alias("b")).collect()}
    after = table.manifest()["folders"]
    assert all((before[b] == after[b]) == (b not in touched) for b in before)
    assert table.merge_owned(spark.createDataFrame([(7, "other", 70), (2000, "appended", 2)], rows.schema), ["size"]) == 3
    assert table.delete(spark.createDataFrame([(9,), (12345,)], "id long")) == 4
    got = {r["id"]: (r["name"], r["size"]) for r in table.read().collect()}
    assert got[7] == ("seven", 70) and got[1000] == ("new", 1) and got[2000] == ("appended", 2) and got[None] == ("null key", 1) and 9 not in got and len(got) == 202
    assert table.read(1).count() == 201 and {r["id"] for r in table.lookup(spark.createDataFrame([(7,), (9,), (8,)], "id long")).collect()} == {7, 8}
    # a merge that lost the race leaves no trace in what is read
    p, fs = table._file(f"{table.path}/versions/5.json")
    fs.create(p).close()
    table.versions, slow = (lambda: [0, 1, 2, 3, 4]), table.versions
    with pytest.raises(Conflict):
        table.upsert(new)
    fs.delete(p, False)
    table.versions = slow
    assert table.read().count() == 202
    table.vacuum(1)
    assert table.versions() == [4] and table.read().count() == 202 and len({f.split("/")[-3] for f in table.read().inputFiles()}) <= 4
    with pytest.raises(Exception):
        table.manifest(1)


def test_raw_vectors_are_split_and_numbered(spark, tmp_path):
    import numpy as np

    x = np.arange(5 * 1000, dtype="<f4").reshape(1000, 5)
    frame = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "doc_id long, vector array<float>").repartition(6)
    assert writers.write_raw_vectors(frame, str(tmp_path / "raw")) == 1000
    split = readers.read_vectors(spark, str(tmp_path / "raw" / "*.f32"), 5, split_bytes=400)
    assert split.rdd.getNumPartitions() >= 50
    got = split.orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(1000)) and np.array_equal(np.array([r["vector"] for r in got]), x)
    (tmp_path / "cut.f32").write_bytes(b"1234567")
    with pytest.raises(Exception, match="doesn't end with a row"):
        readers.read_vectors(spark, str(tmp_path / "cut.f32"), 1).count()


def test_a_raw_file_over_two_gigabytes_reads_in_many_tasks(spark, tmp_path):
    path, dims = tmp_path / "big.f32", 1 << 18
    with open(path, "wb") as f:
        f.seek(2200 * dims * 4 - 4)  # a file with holes takes no room
        f.write(b"\x00\x00\x80\x3f")
    v = readers.read_vectors(spark, str(path), dims, split_bytes=256 << 20)
    assert v.rdd.getNumPartitions() >= 9
    from tessera.sources.splits import RawVectorsReader

    reader = RawVectorsReader({"path": str(path), "dims": dims, "split_bytes": 1 << 20})
    parts = reader.partitions()
    assert len(parts) == 2200 and parts[-1].first == 2199
    batch = next(iter(reader.read(parts[-1])))
    assert batch.column("row").to_pylist() == [2199] and batch.column("vector")[0].values[-1].as_py() == 1.0


def test_workbook_sheets_are_tasks(spark, tmp_path):
    sheet = lambda *cells: '<worksheet xmlns="m"><sheetData>' + "".join(f'<row r="{i}"><c r="A{i}"><v>{c}</v></c></row>' for i, c in enumerate(cells, 1)) + "</sheetData></worksheet>"
    for book in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{book}.xlsx", "w") as z:
            z.writestr("xl/workbook.xml", '<workbook xmlns="m"><sheets><sheet name="First"/><sheet name="Second"/></sheets></workbook>')
            z.writestr("xl/worksheets/sheet1.xml", sheet("x", 1))
            z.writestr("xl/worksheets/sheet2.xml", sheet("y", 2, 3))
    every = readers.read_xlsx(spark, str(tmp_path / "*.xlsx"), None)
    assert every.rdd.getNumPartitions() == 4 and every.count() == 10
    second = readers.read_xlsx(spark, str(tmp_path / "b.xlsx"), "Second").orderBy("row").collect()
    assert [(r["file"], r["sheet"], r["row"], r["col"], r["value"]) for r in second] == [("b.xlsx", "Second", 1, "A", "y"), ("b.xlsx", "Second", 2, "A", "2"), ("b.xlsx", "Second", 3, "A", "3")]


def test_state_stream_equals_fold(spark, tmp_path):
    import random

    from tessera.plans import tables
    from tessera.sources.bucketed import BucketTable
    from tessera.streaming import user_state

    ch = tables.changes(spark, "/root/testdata/sf0.001").where("user_id < 4")
    want = sorted(map(str, state.fold(ch).select("user_id", "problem_id", "done", "bookmarked", "recall", F.col("updated_at").cast("string")).collect()))
    rows = ch.select("user_id", "problem_id", F.col("ts").cast("timestamp").alias("ts"), "seq", "kind", "value").collect()
    random.Random(2).shuffle(rows)
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    put = lambda part: spark.createDataFrame(part, user_state.CHANGES).coalesce(1).write.mode("append").parquet(source)
    read = lambda: spark.readStream.schema(user_state.CHANGES).option("maxFilesPerTrigger", 1).parquet(source)
    for i in range(3):
        put(rows[i :: 5])
    user_state.keep_table(read(), table, str(tmp_path / "cp"), buckets=4).awaitTermination()
    for i in (3, 4):  # another run goes on from the checkpoint
        put(rows[i :: 5])
    user_state.keep_table(read(), table, str(tmp_path / "cp")).awaitTermination()
    got = BucketTable(spark, table).read()
    assert sorted(map(str, got.select("user_id", "problem_id", "done", "bookmarked", "recall", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at")).collect())) == want


def test_state_steps_and_watermark(spark, tmp_path):
    import datetime
    import random

    from tessera.streaming import user_state

    r = random.Random(9)
    steps = [("done", "true"), ("done", "false"), ("bookmarked", "true"), ("bookmarked", "false"), ("recall", "hard"), ("recall", "easy"), ("recall", "none")]
    for _ in range(300):
        case = [r.choice(steps) for _ in range(r.randint(1, 12))]
        value = user_state.NOTHING
        for i, (k, v) in enumerate(case):
            value = user_state.step(value, (i, i, k, v))
        want = lifecycle(*case)
        assert (value[0], value[2], value[4]) == (want or (False, False, None))
    day = lambda n: datetime.datetime(2024, 1, n)
    source = str(tmp_path / "in")
    for part in ([(1, 2, day(2), 1, "done", "true"), (1, 3, day(2), 2, "recall", "hard")], [(1, 2, day(9), 4, "done", "false"), (1, 2, day(8), 3, "recall", "easy")], [(1, 2, day(10), 6, "bookmarked", "true")], [(1, 2, day(1), 5, "done", "true")]):
        spark.createDataFrame(part, user_state.CHANGES).coalesce(1).write.mode("append").parquet(source)
        with user_state.rocks(spark):
            q = user_state.states(spark.readStream.schema(user_state.CHANGES).parquet(source), "3 days").writeStream.foreachBatch(lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out"))).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    last = spark.read.parquet(str(tmp_path / "out")).where("problem_id = 2").orderBy(F.desc("updated_at")).first()
    assert (last["done"], last["bookmarked"], last["recall"]) == (False, True, "easy")


def test_state_folds_packed_changes_as_steps(spark, tmp_path):
    import datetime
    import random

    import pandas as pd

    from tessera.sources.bucketed import BucketTable
    from tessera.streaming import user_state

    r = random.Random(5)
    values = [("done", "true"), ("done", "false"), ("done", "yes"), ("bookmarked", "true"), ("bookmarked", "false"), ("bookmarked", None), ("recall", "hard"), ("recall", "easy"), ("recall", "none"), ("recall", None), ("other", "true")]
    cases = [(n, r.randint(-9, 9), i, *r.choice(values)) for n in range(150) for i in range(r.randint(0, 14))]
    rows = spark.createDataFrame(cases, "case int, at long, seq long, kind string, value string").select("case", "at", "seq", "value", user_state.code().alias("code"), F.when(F.col("kind") == "recall", F.col("value")).alias("word")).toPandas()
    start = (False, None, True, -50, "easy", -50)
    for n, own in rows.groupby("case"):
        mine, at = own.sample(frac=1, random_state=n), len(own) // 2
        packs = [user_state.pack(x) for x in (mine[:at], mine[at:])]
        stored = [tuple(pd.Series(x).tolist() for x in p) for p in packs]
        assert [len(p[0]) for p in stored] == [int((x["code"] != user_state.NO_EFFECT).sum()) for x in (mine[:at], mine[at:])]
        for first in (user_state.NOTHING, start):
            want = first
            for c in sorted((x for x in cases if x[0] == n), key=lambda x: x[1:3]):
                want = user_state.step(want, c[1:])
            assert user_state.folded(first, *user_state.joined(packs)) == want
    # nothing settles without a bound on lateness, not even what was before 1970
    source, table, day = str(tmp_path / "in"), str(tmp_path / "table"), lambda n: datetime.datetime(1960, 1, n)
    for part in ([(1, 2, day(5), 1, "recall", "hard"), (1, 3, day(5), 1, "other", "true")], [(1, 2, day(2), 1, "done", "true"), (1, 2, day(6), 1, "done", "false")]):
        spark.createDataFrame(part, user_state.CHANGES).coalesce(1).write.mode("append").parquet(source)
        user_state.keep_table(spark.readStream.schema(user_state.CHANGES).parquet(source), table, str(tmp_path / "cp"), buckets=2).awaitTermination()
    assert [(x["problem_id"], x["done"], x["recall"], x["updated_at"]) for x in BucketTable(spark, table).read().collect()] == [(2, False, "hard", day(6))]
