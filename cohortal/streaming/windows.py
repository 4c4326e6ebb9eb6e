"""The event stream: watermarked windows and sessions that feed the series operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Events as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(schema).parquet(folder)


#: Values below this are added as decimals of 18 places.
_EXACT = 1e9


def mean(value: str) -> Column:
    """The mean of a column; of values all below _EXACT the same in any order of rows, as a stream adds them in another than a table."""
    v = F.col(value)
    exact = F.sum(F.when(F.abs(v) < _EXACT, v.cast("decimal(38,18)"))).cast("double") / F.count(v)
    return F.when(F.max(F.abs(v)) < _EXACT, exact).otherwise(F.avg(v))


def timed(events: DataFrame) -> DataFrame:
    """Events whose ``ts`` is a point in time, as watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """series_id, start, n, value (mean) of tumbling or sliding windows; events later than ``late`` are dropped by the watermark.

    Works on streams and tables alike; on a table nothing is late.
    """
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = timed(events).withWatermark("ts", late).groupBy(w.alias("w"), F.col("event_type").alias("series_id")).agg(F.count("*").alias("n"), mean("value").alias("value"))
    return g.select("series_id", F.col("w.start").alias("start"), "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """user_id, start, end, n of sessions that end after a gap."""
    g = timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
