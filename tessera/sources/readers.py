"""Readers. Files are read by Spark, with explicit schemas, so any store that Spark reaches will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

RECORD = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("id", "title", "slug", "platform", "source_url", "source_topic", "statement")],
    *[T.StructField(c, T.ArrayType(T.StringType())) for c in ("source_tags", "tags", "patterns")],
    T.StructField("difficulty", T.VariantType()), T.StructField("rating", T.IntegerType()), T.StructField("acceptance_rate", T.DoubleType()), T.StructField("contest_slot", T.StringType()),
    T.StructField("annotation", T.StructType([T.StructField("version", T.StringType()), T.StructField("model", T.StringType()), T.StructField("generated_at_unix", T.LongType()), T.StructField("pattern_confidence", T.MapType(T.StringType(), T.DoubleType()))])),
])


def read_records(spark: SparkSession, root: str, platforms: list[str], strict: bool = True) -> DataFrame:
    """One JSON file per record below a folder per platform, in order of platform, then file name.

    Difficulty is a tier if it is a string and a rating if it is a number. ``strict``
    fails on a bad file; else its row has only ``file`` and ``corrupt``.
    """
    schema = RECORD if strict else T.StructType([*RECORD.fields, T.StructField("_corrupt_record", T.StringType())])
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    there = [p for p in platforms if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{p}"))]
    if not there:
        raise FileNotFoundError(f"none of {platforms} below {root}")
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json([f"{root}/{p}/*.json" for p in there])
    rows = rows.withColumns({"file": F.element_at(F.split("_metadata.file_path", "/"), -1), "folder": F.element_at(F.split("_metadata.file_path", "/"), -2)})
    kind = F.schema_of_variant("difficulty")
    rows = rows.withColumns({"tier": F.when(kind == "STRING", F.try_variant_get("difficulty", "$", "string")), "rating": F.coalesce("rating", F.when(kind != "STRING", F.try_variant_get("difficulty", "$", "int")))}).drop("difficulty")
    if not strict:
        # a parsed column beside it: Spark refuses queries on the corrupt record alone
        rows = rows.withColumn("corrupt", F.when(F.col("id").isNull(), F.col("_corrupt_record"))).drop("_corrupt_record")
    place = F.array_position(F.array(*[F.lit(p) for p in platforms]), F.col("folder"))
    # a corpus of hand-kept files; the order is global by definition
    return rows.withColumn("doc_ord", F.row_number().over(Window.orderBy(place, "file")) - 1)


def violations_of(rows: DataFrame) -> DataFrame:
    """Files that didn't parse."""
    return rows.where("corrupt is not null").select("file", F.lit("error").alias("level"), F.lit("bad_json").alias("rule"))


#: Kinds of stores that tasks can open by themselves.
OPENED = ("file", "hdfs", "s3", "s3a", "gs", "abfss")


def _qualified(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def read_vectors(spark: SparkSession, path: str, dims: int, split_bytes: int | None = None) -> DataFrame | None:
    """``row, vector`` from a parquet artifact, or from raw little-endian 32-bit floats (``.f32``); None if there is none.

    Rows of raw files are numbered through all files, in order of their names. A file is
    read in splits of ``split_bytes``; in a store that only Spark opens, a task takes a whole file.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p):
        return None
    if not path.endswith(".f32"):
        return spark.read.parquet(path)
    full = _qualified(spark, path)
    if full.partition(":")[0] in OPENED:
        from .splits import RawVectors, SPLIT_BYTES

        spark.dataSource.register(RawVectors)
        return spark.read.format(RawVectors.name()).options(path=full.replace("s3a:", "s3:", 1), dims=dims, split_bytes=split_bytes or SPLIT_BYTES).load()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for first, raw in zip(b.column("first").to_pylist(), b.column("content").to_pylist()):
                x = np.frombuffer(raw, "<f4").reshape(-1, dims)
                yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(x))), pa.array(list(x), pa.list_(pa.float32()))], names=["row", "vector"])

    files = spark.read.format("binaryFile").load(path)
    before = files.select("path", F.coalesce(F.sum(F.col("length") / (4 * dims)).over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("first"))  # one row a file
    return files.select("path", "content").join(before, "path").select("first", "content").mapInArrow(run, "row long, vector array<float>")


def checked_artifact(vectors: DataFrame, manifest: dict, corpus: DataFrame, ids: DataFrame, expected: dict | None = None) -> DataFrame:
    """``doc_id, vector`` in the corpus's terms; fails on other dimensions, counts, norms or ids.

    ``expected``: what the manifest must say of other things, as model, dtype and corpus hash.
    """
    wrong = {k: manifest.get(k) for k, v in (expected or {}).items() if manifest.get(k) != v}
    if wrong:
        raise ValueError(f"the artifact was made for something else: {wrong}")
    faults = vectors.agg(F.count("*").alias("n"), F.count_if(F.size("vector") != manifest["dims"]).alias("dims"), F.count_if(F.abs(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)) - 1) > 1e-3).alias("norm")).first()
    if faults["n"] != manifest["count"] or faults["dims"] or faults["norm"]:
        raise ValueError(f"artifact doesn't fit its manifest: {faults}")
    out = vectors.join(ids, "row").select("doc_id", "vector")
    if not corpus.join(out, "doc_id", "left_anti").isEmpty():
        raise ValueError("some records have no vector")
    return out


def read_taxonomy(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables ``labels`` (label, category), ``aliases`` (alias, canonical, consuming) and ``groups`` (id, label, aliases, members) of a JSON taxonomy, whose groups are an object by id."""
    schema = "canonical map<string, struct<category: string>>, aliases map<string, string>, consumingAliases array<string>, groups map<string, struct<label: string, aliases: array<string>, members: array<string>>>"
    t = spark.read.schema(schema).option("multiLine", True).json(path)
    none = F.array().cast("array<string>")
    consuming = F.coalesce("consumingAliases", F.array().cast("array<string>"))
    return {
        "labels": t.select(F.explode("canonical").alias("label", "x")).select("label", F.coalesce("x.category", F.lit("general")).alias("category")),
        "aliases": t.select(F.explode("aliases").alias("alias", "canonical"), consuming.alias("c")).select("alias", "canonical", F.array_contains("c", F.col("alias")).alias("consuming")),
        "groups": t.select(F.explode("groups").alias("id", "g")).select("id", "g.label", F.coalesce("g.aliases", none).alias("aliases"), F.coalesce("g.members", none).alias("members")),
    }


def profiles(sources: dict[str, DataFrame]) -> DataFrame:
    """``source, user_id, solved, by_tier, rating, calendar`` of all sources: what a source doesn't tell is null; rows without a user go.

    ``solved`` falls back to the sum of the tiers' counts; days without a count aren't in the calendar.
    """
    parts = []
    for name, df in sources.items():
        have = lambda c, kind, df=df: (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)
        parts.append(df.where("user_id is not null").select(F.lit(name).alias("source"), "user_id", have("solved", "long"), have("by_tier", "map<string,long>"), have("rating", "double"), have("calendar", "map<bigint,bigint>")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    total = F.aggregate(F.map_values("by_tier"), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return out.withColumns({"solved": F.coalesce("solved", total), "calendar": F.map_filter("calendar", lambda _, n: n > 0)})


#: What a heading that names no topic starts with.
NO_TOPIC = ("comments", "format", "the ")


def read_seed_urls(spark: SparkSession, path: str, no_topic: tuple[str, ...] = NO_TOPIC) -> DataFrame:
    """``file, line_no, url, topic``: a heading ``# A / B`` names the topic of the lines below; headings without a slash, and those that start with ``no_topic``, are remarks."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return seed_urls(lines, no_topic)


def seed_urls(lines: DataFrame, no_topic: tuple[str, ...] = NO_TOPIC) -> DataFrame:
    from ..operators.curate import carry_down

    line = F.trim("line")
    text = F.trim(F.regexp_replace(line, "^#+", ""))
    remark = F.lit(False)
    for x in no_topic:
        remark = remark | F.lower(text).startswith(x)
    heading = F.when(line.startswith("#") & text.contains("/") & ~remark, text)
    return carry_down(lines, heading).where((line != "") & ~line.startswith("#")).select("file", "line_no", line.alias("url"), "topic")


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_xlsx(spark: SparkSession, path: str, sheet: int | str | None = 1) -> DataFrame:
    """``file, sheet, row, col, value, link`` of one sheet of each workbook, or of all sheets (None), with hyperlinks from their relations; a task reads a sheet."""
    from .splits import Workbook

    spark.dataSource.register(Workbook)
    options = {"path": _qualified(spark, path)} | ({} if sheet is None else {"sheet": str(sheet)})
    return spark.read.format(Workbook.name()).options(**options).load()


def by_header(grid: DataFrame) -> DataFrame:
    """``row, name, value`` of a grid whose first row names the columns; the first of equal names counts."""
    head = grid.where("row = 1").groupBy(F.lower(F.trim("value")).alias("name")).agg(F.min_by("col", F.struct(F.length("col"), "col")).alias("col"))
    return grid.where("row > 1").join(head, "col").select("row", "name", "value")


def newest(rows: DataFrame, keep: Column, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` that pass, one per id."""
    from .writers import first_rows

    return first_rows(rows.where(keep), "id").orderBy(*order).limit(n)


def hard_or_recent(rows: DataFrame, n: int, hard: bool) -> DataFrame:
    """Of ``id, tier, paid, url``: all free hard ones by id; or, of the free ones that aren't easy, the ``n`` of largest id."""
    free = rows.where(~F.coalesce("paid", F.lit(False)))
    return free.where(F.lower("tier") == "hard").orderBy("id") if hard else newest(free, F.lower("tier") != "easy", [F.col("id").desc()], n)


def least_accepted(rows: DataFrame, n: int, tier: str = "medium") -> DataFrame:
    """Of ``id, tier, paid, acceptance, url``: the ``n`` free ones of a tier with the lowest acceptance; of equal URLs the first counts."""
    free = rows.where(~F.coalesce("paid", F.lit(False)) & (F.lower("tier") == tier) & F.col("acceptance").isNotNull())
    first = free.withColumn("_r", F.row_number().over(Window.partitionBy("url").orderBy("acceptance", "id"))).where("_r = 1").drop("_r")
    return first.orderBy("acceptance", "id").limit(n)


def needed_pages(index: DataFrame, wanted: DataFrame, page_rows: int = 100) -> DataFrame:
    """``page, offset``: the pages of a remote listing that hold wanted rows, from an index of ``id, offset``."""
    return index.join(wanted.select("id"), "id", "left_semi").select(F.floor(F.col("offset") / page_rows).cast("long").alias("page")).distinct().select("page", (F.col("page") * page_rows).alias("offset"))


def per_rating(rows: DataFrame) -> DataFrame:
    return rows.groupBy("rating").agg(F.sort_array(F.collect_set("url")).alias("urls"))


def merge_statements(index: DataFrame, staged: DataFrame) -> DataFrame:
    """Index rows with the staged statement where there is one, else their own."""
    s = staged.select("id", F.col("statement").alias("_s"))
    return index.join(s, "id", "left").withColumn("statement", F.coalesce("_s", "statement")).drop("_s")


def wanted_rows(remote: DataFrame, wanted: DataFrame, low: int, high: int, min_chars: int = 80, order: Column | None = None) -> DataFrame:
    """Remote rows that are wanted, long enough and in the rating window, the first of each id by ``order``, else by content."""
    from .writers import first_rows

    rows = remote.where((F.length(F.trim(F.coalesce("statement", F.lit("")))) >= min_chars) & F.col("rating").between(low, high))
    return first_rows(rows.join(wanted.select("id"), "id", "left_semi"), "id", order)


def fresh_index(index: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return index.where(F.col("seen_at") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))


def write_pages(rows: DataFrame, path: str, page_rows: int = 100) -> None:
    """Store rows with an ``offset`` in folders of ``page_rows`` offsets, and beside them the index ``id, offset``."""
    rows.withColumn("page", F.floor(F.col("offset") / page_rows).cast("long")).repartition("page").sortWithinPartitions("page", "offset").write.mode("overwrite").partitionBy("page").parquet(f"{path}/pages")
    rows.select("id", "offset").repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/index")


def read_wanted(spark: SparkSession, path: str, wanted: DataFrame, page_rows: int = 100) -> DataFrame:
    """The rows of a paged store that are wanted (id), from the pages alone that hold one: Spark finds out which when it runs, and reads no other folder."""
    import uuid

    from ..operators.common import bounded_broadcast, scratch

    told = f"{scratch(spark)}/wanted-{uuid.uuid4().hex}"
    needed_pages(spark.read.parquet(f"{path}/index"), wanted, page_rows).select("page").write.parquet(told)
    # the comparison tells Spark that this side selects, without which it doesn't prune by it
    pages = bounded_broadcast(spark.read.schema("page long").parquet(told).where("page >= 0"))
    # pages as long numbers, as they are in the index: a cast between the two would keep Spark from pruning
    schema = T.StructType([T.StructField(f.name, T.LongType() if f.name == "page" else f.dataType) for f in spark.read.parquet(f"{path}/pages").schema])
    return spark.read.schema(schema).parquet(f"{path}/pages").join(pages, "page", "left_semi").join(wanted.select("id"), "id", "left_semi")
