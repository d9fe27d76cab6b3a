"""Exact deduplication by a stateful stream.

Digests of the normalised texts are streamed through a keyed aggregation whose
state lives in RocksDB, on disk, and never expires. For each digest it keeps the
identifier of the row that stays, the locator of that row's content, and how many
rows came. The stream aggregates before it shuffles, so a text that half the
corpus repeats reaches its key as one row per task. Locators point into a staged
copy of the rows; every row that hits a digest is compared byte by byte with the
content its locator names. Rows whose bytes differ under one digest are classed
by their whole text instead, so results are exact for any digest.

With a ``folder`` the content and the state are kept there: a later call with
further rows feeds those alone to the state that is there, and its result is
about all rows so far.

Equal means identical after lower-casing A to Z; null counts as empty. Of equal
rows the largest id stays, null ids being smallest; rows that repeat both id and
text keep one of them. A text of any length is one value of its row and is never
held beside more than the other rows of a batch. An empty table gives an empty
frame. Further columns pass through ``keep_unique`` untouched, whatever their names.

Groups by size: the state has one row per text and task before it is shuffled;
the joins on the digest are plain sort-merge joins, of which Spark splits a hot
key's partition (``spark.sql.adaptive.skewJoin``), and the comparison of a hot
text's hits is dealt to as many tasks as it has thousands of hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import OWN, ascii_lower, new_path, quoted, settings, shielded, staged, text_of, unshielded

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Hits compared with one copy of the content they hit; larger groups are dealt to several tasks.
HITS_A_COPY = 1000
LOC, DIG, TEXT, NORM, SID, KEEP, N = (OWN + x for x in ("locator", "digest", "text", "norm", "id", "keep", "n"))
#: Each partition of the state is a database of its own. Without these its write buffer takes 8 MB as soon as one
#: row comes, and its log some MB of disk, however little the partition holds.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2", "spark.sql.streaming.stateStore.rocksdb.maxWriteBufferNumber": "2",
    "spark.sql.streaming.stateStore.rocksdb.blockCacheSizeMB": "2",
}


def sha256(text):
    return F.sha2(text.cast("binary"), 256)


def stream_state(content: str, schema, spark: SparkSession, checkpoint: str, files_at_once: int | None = None) -> None:
    """Feed all content not seen yet into the keyed state below ``checkpoint``."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    keyed = reader.parquet(content).select(DIG, SID, LOC).groupBy(DIG).agg(F.max(F.struct(F.col(SID).alias("id"), F.col(LOC).alias("locator"))).alias(KEEP), F.count("*").alias(N))
    keyed.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as a table: digest, id and locator that stay, rows so far."""
    rows = spark.read.format("statestore").load(checkpoint)
    value = [f.name for f in rows.schema["value"].dataType.fields]
    return rows.select(F.col(f"key.{DIG}").alias(DIG), F.col("value").getField(value[0]).alias(KEEP), F.col("value").getField(value[1]).alias(N))


def mismatches(content: DataFrame, state: DataFrame) -> DataFrame:
    """Rows whose text differs from the content retained for their digest."""
    repeated = state.where(F.col(N) > 1)
    rows = staged(content.select(LOC, SID, DIG, TEXT).join(repeated, DIG).withColumn(NORM, ascii_lower(F.col(TEXT))).drop(TEXT), "hits")
    copies = F.ceil(F.col(N) / HITS_A_COPY).cast("int")
    held = rows.where(F.col(LOC) == F.col(KEEP)["locator"]).select(DIG, F.explode(F.sequence(F.lit(0), copies - 1)).alias(OWN + "copy"), F.col(NORM).alias(OWN + "held"))
    hits = rows.where(F.col(LOC) != F.col(KEEP)["locator"]).withColumn(OWN + "copy", F.pmod(F.xxhash64(LOC), copies).cast("int"))
    return staged(hits.join(held, [DIG, OWN + "copy"]).where(F.col(NORM) != F.col(OWN + "held")).select(LOC, SID, DIG, NORM), "mismatches")


def _batches_there(spark: SparkSession, content: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(content)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return len([x for x in fs.listStatus(p) if x.getPath().getName().startswith("batch-")]) if fs.exists(p) else 0


def classified(docs: DataFrame, id_col: str, text_col: str, digest=sha256, files_at_once: int | None = None, folder: str | None = None) -> DataFrame:
    """The rows with their digest, locator, the (id, locator) that stays and the group's size, in own columns."""
    spark = docs.sparkSession
    base = folder or new_path(spark, "dedup")
    path, checkpoint = f"{base}/content", f"{base}/state"
    norm = ascii_lower(text_of(text_col))
    batch = _batches_there(spark, path)
    full = docs.withColumns({SID: F.col(quoted(id_col)), LOC: F.struct(F.lit(batch).alias("batch"), F.monotonically_increasing_id().alias("row")), DIG: digest(norm)})
    full.write.option("compression", "zstd").parquet(f"{path}/batch-{batch:06d}")
    content = spark.read.schema(full.schema).option("recursiveFileLookup", "true").parquet(path).withColumns({TEXT: text_of(text_col), NORM: norm})
    with settings(spark, STATE_SETTINGS):
        stream_state(path, full.schema, spark, checkpoint, files_at_once)
        state = staged(read_state(spark, checkpoint), "state")
    bad = mismatches(content, state)
    if bad.isEmpty():
        return content.join(state, DIG)
    # bytes differ under one digest: the retained text's class loses those rows, and each other text is a class
    fewer = bad.groupBy(DIG).agg(F.count("*").alias(OWN + "fewer"))
    best = F.max(F.struct(F.col(SID).alias("id"), F.col(LOC).alias("locator")))
    own = bad.groupBy(DIG, NORM).agg(best.alias(OWN + "keep2"), F.count("*").alias(OWN + "n2"))
    state = state.join(fewer, DIG, "left").withColumn(N, F.col(N) - F.coalesce(OWN + "fewer", F.lit(0))).drop(OWN + "fewer")
    # joined by whole text: only texts that have lost a comparison are there
    rows = content.join(state, DIG).join(own, [DIG, NORM], "left")
    return rows.withColumns({KEEP: F.coalesce(OWN + "keep2", KEEP), N: F.coalesce(OWN + "n2", N)}).drop(OWN + "keep2", OWN + "n2")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row."""
    docs, now = shielded(docs)
    rows = classified(docs.select(F.col(quoted(now[id_col])).alias("doc_id"), F.col(quoted(now[text_col])).alias("text")), "doc_id", "text", **options)
    sha = F.col(DIG) if options.get("digest", sha256) is sha256 else sha256(F.col(NORM))
    return rows.select("doc_id", F.col(KEEP)["id"].alias("keep_id"), F.col(N).alias("group_size"), (F.col(LOC) == F.col(KEEP)["locator"]).alias("kept"), sha.alias("text_sha256"))


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, with the columns they came with."""
    docs, now = shielded(docs)
    rows = classified(docs, now[id_col], now[text_col], **options)
    return rows.where(F.col(LOC) == F.col(KEEP)["locator"]).select(*unshielded(now))
