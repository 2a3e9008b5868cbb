"""Counts, top lists and summaries of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(e: DataFrame) -> DataFrame:
    """(dimension, value, n) for severity, log_type and outcome, and the total, in one pass over grouping sets."""
    keys = [F.col(c) for c in ("severity", "log_type", "outcome")]
    g = e.groupingSets([[k] for k in keys] + [[]], *keys).agg(F.grouping_id(*keys).alias("g"), F.count("*").alias("n"))
    dim = F.when(F.col("g") == 3, "severity").when(F.col("g") == 5, "log_type").when(F.col("g") == 6, "outcome").otherwise("total")
    return g.select(dim.alias("dimension"), F.when(F.col("g") == 3, F.col("severity")).when(F.col("g") == 5, F.col("log_type")).when(F.col("g") == 6, F.col("outcome")).otherwise("all").alias("value"), "n")


def top(e: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent values of `key`; ties go to the one seen first."""
    return e.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).orderBy(F.desc("n"), "first_id").limit(k)


def minute_timeline(e: DataFrame, minutes: int = 1) -> DataFrame:
    """Events, normal and anomalous, for each minute (or several)."""
    width = minutes * 60_000_000
    return e.groupBy((F.floor(F.col("us") / width) * width).alias("minute_us")).agg(F.count("*").alias("n"), F.count_if("is_anomaly").alias("anomalies"), F.count_if(~F.col("is_anomaly")).alias("normal"))


def distinct_counts(e: DataFrame) -> DataFrame:
    return e.agg(F.count_distinct("ip").alias("ips"), F.count_distinct("user").alias("users"), F.count_distinct("action").alias("actions"))


def attack_summary(e: DataFrame) -> DataFrame:
    """Attacks, distinct types, anomalies and the risk score min(10 attacks + 5 anomalies, 100)."""
    s = e.agg(F.count("*").alias("total"), F.count("attack_type").alias("attacks"), F.count_distinct("attack_type").alias("types"), F.count_if("is_anomaly").alias("anomalies"))
    return s.withColumn("risk", F.least(10 * F.col("attacks") + 5 * F.col("anomalies"), F.lit(100)))


def severity_share(e: DataFrame) -> DataFrame:
    """Each severity's share of all entries, in percent."""
    from pyspark.sql import Window

    g = e.groupBy("severity").agg(F.count("*").alias("n"))  # a handful of rows: the window over all of them is small
    return g.select("severity", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("percent"))


def ip_risk(e: DataFrame) -> DataFrame:
    n = F.col("n")
    return e.groupBy("ip").agg(F.count("*").alias("n")).withColumn("risk", F.when(n > 100, "HIGH").when(n > 50, "MEDIUM").otherwise("LOW"))


def merge(parts: list[DataFrame]) -> DataFrame:
    """Counters of partial results (key, n, failed) added up."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("key").agg(F.sum("n").alias("n"), F.sum("failed").alias("failed")).withColumn("success_rate", F.round(1 - F.col("failed") / F.col("n"), 6))
