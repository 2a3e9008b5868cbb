"""Set operations and grouped picks over entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_and_last(e: DataFrame, key: str = "ip") -> DataFrame:
    """Per key: the ids of its first and last entry by time, of equal times by id."""
    at = F.struct("us", "id")
    return e.groupBy(key).agg(F.min_by("id", at).alias("first_id"), F.max_by("id", at).alias("last_id"))


def in_both(e: DataFrame, column: str, one: str, other: str) -> DataFrame:
    """Values of a column that have entries of both outcomes."""
    of = lambda o: e.filter(F.col("outcome") == o).select(column)
    return of(one).intersect(of(other))


def first_of_each(e: DataFrame, *keys: str) -> DataFrame:
    """The smallest id of each combination of keys."""
    return e.groupBy(*keys).agg(F.min("id").alias("id"))


def uncovered_anomalies(e: DataFrame) -> DataFrame:
    """Anomalies whose id no attack has."""
    return e.filter("is_anomaly").select("id", "ip").join(e.filter("attack_type is not null").select("id"), "id", "left_anti")


def ips_by_outcome(e: DataFrame) -> DataFrame:
    """Per user: how many ips failed and how many succeeded, 0 where none did."""
    g = lambda o, n: e.filter(F.col("outcome") == o).groupBy("user").agg(F.count_distinct("ip").alias(n))
    return g("failure", "failing").join(g("success", "succeeding"), "user", "full").na.fill(0)


def behaviour(e: DataFrame, key: str = "ip") -> DataFrame:
    """The feature vector of each key: entries, share of failures, users, ports, their logarithm, entries a minute and entries
    before six o'clock.
    """
    ports, n = F.count_distinct("port"), F.count("*")
    return e.groupBy(key).agg(
        n.alias("n"), F.round(F.count_if(F.col("outcome") == "failure") / n, 6).alias("failure_rate"), F.count_distinct("user").alias("users"), ports.alias("ports"),
        F.round(F.log2(1 + ports), 6).alias("log_ports"), F.round(n * 60_000_000 / F.greatest(F.max("us") - F.min("us"), F.lit(1)), 6).alias("per_minute"), F.count_if(F.expr("us div 3600000000 % 24") < 6).alias("off_hours"),
    )
