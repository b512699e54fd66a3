"""Streaming extensions (the batch pipeline needs none): landed records cleaned and deduplicated as they arrive, and windowed
counts of events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as X


def ingest(spark: SparkSession, path: str, schema: str, ts: str, late: str = "7 days") -> DataFrame:
    """Landed JSON lines as a stream of works, one for each DOI within the watermark."""
    raw = spark.readStream.schema(schema).json(path)
    return raw.withColumn("doi", X.normalize_doi(F.col("doi"))).withWatermark(ts, late).dropDuplicatesWithinWatermark(["doi"])


def windowed_counts(events: DataFrame, ts: str, by: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by time window; the same for a stream (with its watermark) and a batch."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, size, slide).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.session_window(ts, gap).alias("s"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
