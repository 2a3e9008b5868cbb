"""Feedback on labels and model versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERDICTS = ("correct", "false_positive", "false_negative")


def stats(feedback: DataFrame, now_us: int) -> DataFrame:
    """Per verdict and predicted type: rows, and those of the last 24 hours."""
    recent = F.col("us") > now_us - 86_400_000_000
    return feedback.filter(F.col("verdict").isin(*VERDICTS)).groupBy("verdict", "predicted").agg(F.count("*").alias("n"), F.count_if(recent).alias("last_day"))


def compare(versions: DataFrame, a: str, b: str) -> DataFrame:
    """Differences of accuracy and feedback counts of two versions (version, accuracy, feedback)."""
    x = versions.filter(F.col("version") == a).select(F.col("accuracy").alias("a1"), F.col("feedback").alias("f1"))
    y = versions.filter(F.col("version") == b).select(F.col("accuracy").alias("a2"), F.col("feedback").alias("f2"))
    return x.crossJoin(y).select((F.col("a2") - F.col("a1")).alias("accuracy_gain"), (F.col("f2") - F.col("f1")).alias("more_feedback"))  # one row each


def activate(versions: DataFrame, version: str) -> DataFrame:
    """The versions with one of them active."""
    return versions.withColumn("active", F.col("version") == version)


def noisy_ip(df: DataFrame, epsilon: float, seed: int = 11) -> DataFrame:
    """Replace the last octet of ips with probability 1 / (1 + epsilon). This hides single hosts, but is no privacy guarantee."""
    draw = F.pmod(F.xxhash64("ip", "id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    octet = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(256)).cast("string")
    return df.withColumn("ip", F.when(draw < 1 / (1 + epsilon), F.concat(F.regexp_extract("ip", r"^(.*\.)\d+$", 1), octet)).otherwise(F.col("ip")))
