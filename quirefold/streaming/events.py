"""Windows and sessions over the stream of events; each works on a batch and on a stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def timed(events: DataFrame, late: str | None = None) -> DataFrame:
    """Events with a zoned timestamp; a stream also gets its watermark."""
    held = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return held.withWatermark("ts", late) if late else held


def tumbling(events: DataFrame, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total): counts and sums by windows of event time."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return timed(events, late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, start, end, n): events of a user less than ``gap`` apart."""
    return timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"
    )


def latest_state(events: DataFrame, key: str, state: str) -> DataFrame:
    """(key, state, ts): the last state of each key."""
    return events.groupBy(key).agg(F.max(F.struct("ts", "event_id", state)).alias("m")).select(key, F.col(f"m.{state}").alias(state), F.col("m.ts").alias("ts"))


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files: int = 1) -> DataFrame:
    """A folder of parquet files as a stream with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(folder)


def keep_frequencies(docs: DataFrame, key: str, text: str, path: str, checkpoint: str) -> StreamingQuery:
    """Document frequencies of words kept up to date as documents arrive.

    Each micro-batch writes its own partial counts under its number, so a batch
    that is run again overwrites itself; readers add the parts up.
    """
    from quirefold.functions.text import latin_words

    def put(batch: DataFrame, number: int) -> None:
        each = batch.select(key, F.explode(F.array_distinct(latin_words(F.col(text)))).alias("word"))
        each.groupBy("word").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frequencies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("word").agg(F.sum("df").alias("df"))


def first_seen(stream: DataFrame, key: str, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """A stream with only the first event of a key within the delay; the state of older keys is dropped."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
