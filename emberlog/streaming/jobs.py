"""Streams of entries: minute counts, sliding counts, deduplication and sessions. Rules that need rows in order are in
`emberlog.streaming.ordered`.

Entries carry `event_ts`. Rows later than the watermark are dropped by Spark; queries keep their offsets and state in
the checkpoint folder that the caller names, so a restart goes on where it ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WATERMARK = "10 minutes"


def minute_counts(e: DataFrame, late: str = WATERMARK) -> DataFrame:
    """Entries and failures in each minute."""
    w = e.withWatermark("event_ts", late).groupBy(F.window("event_ts", "1 minute"))
    return w.agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "failure").alias("failed")).select(F.col("window.start").alias("minute"), "n", "failed")


def sliding_failures(e: DataFrame, least: int = 10, width: str = "5 minutes", step: str = "1 minute", late: str = WATERMARK) -> DataFrame:
    """(ip, user) with `least` or more failures in a window that starts at a multiple of `step`."""
    f = e.filter("outcome = 'failure'").withWatermark("event_ts", late)
    g = f.groupBy(F.window("event_ts", width, step), "ip", "user").agg(F.count("*").alias("failures"))
    return g.filter(F.col("failures") >= least).select(F.col("window.start").alias("start"), "ip", "user", "failures")


def distinct_entries(e: DataFrame, late: str = WATERMARK) -> DataFrame:
    """Each id once within the watermark."""
    return e.withWatermark("event_ts", late).dropDuplicatesWithinWatermark(["id"])


def sessions(e: DataFrame, gap: str = "60 seconds", late: str = WATERMARK) -> DataFrame:
    """Bursts of an ip: events with pauses of less than `gap`."""
    g = e.withWatermark("event_ts", late).groupBy(F.session_window("event_ts", gap), "ip").agg(F.count("*").alias("n"))
    return g.select("ip", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def parse_stream(lines: DataFrame, sink, checkpoint: str, year: int | None = None):
    """Start a query that detects, parses and normalises each micro-batch of (source, line_no, line) and hands it to `sink(df, batch)`."""
    from emberlog.operators import detect

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        sink(detect.normalise(detect.parse(batch, detect.detect(batch)), year), number)
        batch.unpersist()

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
