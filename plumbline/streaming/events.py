"""Event streams: windows, sessions, and resumable work as structured streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.match import latest
from plumbline.storage import exists, is_file


def read_stream(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    """The Parquet files of a folder as a stream, a bounded number per micro-batch.

    Times without zone become times of the session's zone, which watermarks
    ask for.
    """
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if is_file(spark, path):  # a stream reads folders: take the file alone from its own
        folder, _, name = path.rstrip("/").rpartition("/")
        stream = stream.option("pathGlobFilter", name).parquet(folder)
    else:
        stream = stream.parquet(path)
    return stream.select(*(F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.simpleString() == "timestamp_ntz" else F.col(f.name) for f in schema.fields))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts and totals per window and type; rows later than `late` are dropped."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    agg = events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return agg.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    agg = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return agg.select("user_id", F.col("session_window.start").alias("first_ts"), F.col("session_window.end").alias("end_ts"), "n")


def distinct_events(events: DataFrame, late: str | None = "2 hours") -> DataFrame:
    """One row per event; repeats are known for as long as `late`, or in the whole run where that is None."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if late else events.dropDuplicates(["event_id"])


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Work off all files that are there and stop; a second run with the same checkpoint takes only new ones."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def upsert_latest(stream: DataFrame, target: str, key: str, checkpoint: str, order: list[str], buckets: int = 64) -> StreamingQuery:
    """Keep one row per key in the table at `target`, the one with the highest values of `order`; rows without key go.

    The table lies in `buckets` folders by hash of the key; a micro-batch
    rewrites only those that its keys are in.  A micro-batch that is run again
    changes nothing.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        by = [*(F.col(c).desc_nulls_last() for c in order), *(F.col(c).desc_nulls_last() for c in batch.columns if c not in (key, *order))]
        new = latest(batch, key, by).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most `buckets`
        if touched:
            old = spark.read.schema(new.schema).parquet(target).filter(F.col("_bucket").isin(touched)).select(*new.columns) if exists(spark, target) else None
            rows = latest(new.unionByName(old), key, by) if old is not None else new
            rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("_bucket").parquet(target)
        new.unpersist()

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def read_latest(spark: SparkSession, target: str) -> DataFrame:
    """The table that upsert_latest keeps."""
    return spark.read.parquet(target).drop("_bucket")
