"""Streaming forms of batch operators, for logs that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.operators.review import content_hash


def read_log(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None, format: str = "json") -> DataFrame:  # noqa: A002
    """An append-only folder as a stream."""
    reader = spark.readStream.format(format).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def first_of_content(rows: DataFrame, text: str = "text", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows whose squashed lower-case text has not come within the watermark; state is dropped behind it."""
    return rows.withColumn("content_hash", content_hash(F.col(text))).withWatermark(time, late).dropDuplicatesWithinWatermark(["content_hash"])


def windowed_counts(rows: DataFrame, by: str, time: str = "ts", window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, end, by, n, mean value) per event-time window; later rows than the watermark are left out."""
    frame = F.window(time, window, slide) if slide else F.window(time, window)
    each = rows.withWatermark(time, late).groupBy(frame.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    return each.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "mean_value")


def sessions(rows: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(start, end, key, n) of sessions: rows of a key with no gap as long as ``gap`` between them."""
    each = rows.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return each.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def feedback_totals(rows: DataFrame) -> DataFrame:
    """Running totals per selected module of a feedback stream; complete or update mode."""
    each = rows.select(F.explode("selected_modules").alias("module"), "rating", "success")
    return each.groupBy("module").agg(F.count(F.lit(1)).alias("times_selected"), F.count_if(F.col("success")).alias("successes"), F.count_if(~F.col("success")).alias("failures"), F.avg("rating").alias("average_rating"))


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there into a table in memory, for tests and small results."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
