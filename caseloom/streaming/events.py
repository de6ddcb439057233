"""Event streams: windowed counts with late data, repeats dropped, and an idempotent journal of attempts (L6 of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per window and type, each id once; rows later than the watermark are dropped."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users: events less than a gap apart."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors"))


def latest_states(attempts: DataFrame) -> DataFrame:
    """One row per event id: a success wins, else the latest attempt."""
    order = F.struct((F.col("event_type") != "error").cast("int"), F.col("ts"), F.col("event_type"))
    return attempts.groupBy("event_id").agg(F.max_by("event_type", order).alias("event_type"), F.max_by("ts", order).alias("ts"), F.count(F.lit(1)).alias("n_attempts"))


def journal(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes every micro-batch under its own number, so a batch that is run again replaces itself.

    Read the journal with latest_states(); state is resumed from the checkpoint.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
