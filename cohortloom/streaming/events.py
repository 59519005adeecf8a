"""Structured Streaming over events: windows, deduplication, follow-up joins, impacted subjects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream of the event files of a folder, a number of files in each batch."""
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern)
    rows = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events once for each id, remembered up to the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def tumbling_counts(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events and value by type in tumbling windows."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def follow_up(events: DataFrame, index_type: str, outcome_type: str, days: int, delay: str = "1 hour") -> DataFrame:
    """Index events with each outcome of the user in (start, start + days]: an interval join."""
    index = events.where(F.col("event_type") == index_type).select("user_id", F.col("event_id").alias("index_id"), F.col("ts").alias("index_at")).withWatermark("index_at", delay)
    outcome = events.where(F.col("event_type") == outcome_type).select(F.col("user_id").alias("who"), F.col("event_id").alias("outcome_id"), F.col("ts").alias("outcome_at")).withWatermark("outcome_at", delay)
    inside = F.expr(f"user_id = who AND outcome_at > index_at AND outcome_at <= index_at + INTERVAL {days} DAYS")
    return index.join(outcome, inside).drop("who")


def sessions(events: DataFrame, gap: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user."""
    w = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("session_window.start").alias("session_start"), "user_id", "n")


def censored(rows: DataFrame, pairs: DataFrame, index_type: str, days: int) -> DataFrame:
    """Rows (index_id, followed, outcomes): outcomes of each index event, and whether the events
    seen reach beyond its follow-up window; where they do not it is right-censored."""
    end = rows.agg(F.max("ts").alias("covered_to"))
    index = rows.where(F.col("event_type") == index_type).select(F.col("event_id").alias("index_id"), "ts")
    counts = pairs.groupBy("index_id").agg(F.count("outcome_id").alias("outcomes"))
    followed = F.col("ts") + F.expr(f"INTERVAL {days} DAYS") < F.col("covered_to")
    # One row tells where coverage ends.
    return index.crossJoin(F.broadcast(end)).join(counts, "index_id", "left").select("index_id", followed.alias("followed"), F.coalesce("outcomes", F.lit(0)).alias("outcomes"))


#: Parts in which stored rows lie by subject, so that a batch reads those of its own subjects.
SLOTS = 64


def recompute_impacted(rows: DataFrame, path: str, subject: Column, compute: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Keep the rows of every batch and recompute the subjects it touches from all rows so far.

    ``path/rows`` has what came in, by batch and slot; ``path/subjects`` has, by subject, what
    ``compute`` makes of all rows (with subject_id) of the touched subjects. A batch that is
    run again replaces its own rows and the same subjects, so nothing counts twice, and a
    restart from the checkpoint goes on with what is stored.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark, own = batch.sparkSession, f"{path}/rows/batch={number}"
        placed = batch.withColumn("subject_id", subject).where("subject_id IS NOT NULL").withColumn("slot", F.pmod(F.xxhash64("subject_id"), F.lit(SLOTS)).cast("int"))
        shape = placed.schema
        placed.write.mode("overwrite").partitionBy("slot").parquet(own)
        if not (slots := [r.slot for r in spark.read.schema(shape).parquet(own).select("slot").distinct().collect()]):  # SLOTS at most
            return
        touched = spark.read.schema(shape).parquet(own).select("subject_id").distinct()
        stored = spark.read.schema(T.StructType([*shape, T.StructField("batch", T.LongType())])).parquet(f"{path}/rows")
        # Batches after this one are there only if it is run again; they will recompute their own.
        mine = stored.where(F.col("slot").isin(slots) & (F.col("batch") <= number)).drop("slot", "batch").join(touched, "subject_id", "left_semi")
        compute(mine).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("subject_id").parquet(f"{path}/subjects")

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_result(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Write the whole result of an aggregating stream once its input is used up, groups that no
    watermark has closed included: each batch replaces what the one before left."""
    replace = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    rows.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_table(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write a stream to Parquet until its input is used up."""
    rows.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
