"""The event operators as streams: daily counts, deduplication, state folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events per UTC day and type, final once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, among those at most ``late`` behind."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def fold_state(changes: DataFrame, path: str, checkpoint: str):
    """Append changes batch by batch, each to its own folder, so that a repeated batch overwrites itself; ``state.fold`` of them all is the state."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(frame: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its rows; for tests and small jobs."""
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return frame.sparkSession.table(name)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(path)
