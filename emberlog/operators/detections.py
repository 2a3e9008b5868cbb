"""Windowed and grouped detections over entries (id, us, ip, user, port, action, outcome, severity, ...).

Sliding rules use range frames over microseconds within a key, so each needs one shuffle by that key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MINUTE = 60_000_000


def sliding_brute_force(e: DataFrame, least: int = 10, width: int = 5 * MINUTE) -> DataFrame:
    """Per (ip, user): the first start t whose failures in [t, t + width] number `least` or more."""
    w = Window.partitionBy("ip", "user").orderBy("us").rangeBetween(0, width)
    hits = e.filter("outcome = 'failure'").select("ip", "user", "us", F.count("*").over(w).alias("n")).filter(F.col("n") >= least)
    first = F.min(F.struct("us", "n"))
    return hits.groupBy("ip", "user").agg(first.alias("f"), F.max("n").alias("most")).select("ip", "user", F.col("f.us").alias("start_us"), F.col("f.n").alias("failures"), "most")


def password_spray(e: DataFrame, least: int = 10, width: int = 10 * MINUTE) -> DataFrame:
    """Per ip: the first start t with failures of `least` or more users in [t, t + width].

    A user counts in a window by its last failure there: each failure adds one at the starts after the user's previous
    failure, so distinct users are sums over (user, gap) intervals instead of sets held for every row.
    """
    f = e.filter("outcome = 'failure'").select("ip", "user", "us").distinct()
    # failure x is its user's last in [t, t + width] for t in (max(prev.., x - width)..x] while the next one lies beyond t + width
    nxt = F.lead("us").over(Window.partitionBy("ip", "user").orderBy("us"))
    spans = f.withColumn("next", nxt).select("ip", (F.col("us") - width).alias("lo"), F.least(F.col("us"), F.coalesce(F.col("next") - width - 1, F.col("us"))).alias("hi")).filter("lo <= hi")
    starts = f.select("ip", F.col("us").alias("t"), F.lit(0).alias("d"), F.lit(1).alias("kind")).distinct()
    marks = spans.select("ip", F.col("lo").alias("t"), F.lit(1).alias("d"), F.lit(0).alias("kind")).unionByName(spans.select("ip", (F.col("hi") + 1).alias("t"), F.lit(-1).alias("d"), F.lit(0).alias("kind")))
    w = Window.partitionBy("ip").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = marks.unionByName(starts).withColumn("users", F.sum("d").over(w)).filter(f"kind = 1 and users >= {least}")
    return counted.groupBy("ip").agg(F.min(F.struct("t", "users")).alias("f"), F.max("users").alias("most_users")).select("ip", F.col("f.t").alias("start_us"), F.col("f.users").alias("users"), "most_users")


def success_after_failures(e: DataFrame, least: int = 3, width: int = 10 * MINUTE) -> DataFrame:
    """Successes of a user with `least` or more failures in the `width` before."""
    w = Window.partitionBy("user").orderBy("us").rangeBetween(-width, -1)
    n = F.count(F.when(F.col("outcome") == "failure", 1)).over(w)
    return e.filter("outcome <> 'unknown'").select("id", "user", "us", "outcome", n.alias("failures")).filter((F.col("outcome") == "success") & (F.col("failures") >= least)).drop("outcome")


def privilege_use(e: DataFrame, most: int = 20) -> DataFrame:
    """Users with more than `most` privileged actions."""
    return e.groupBy("user").agg(F.count("*").alias("uses"), F.min("us").alias("first_us"), F.max("us").alias("last_us")).filter(F.col("uses") > most)


def ip_profile(e: DataFrame) -> DataFrame:
    """Per ip: events, failures, distinct users, ports and actions, and the last entry."""
    return e.groupBy("ip").agg(
        F.count("*").alias("events"), F.count_if(F.col("outcome") == "failure").alias("failed"), F.count_distinct("user").alias("users"), F.count_distinct("port").alias("ports"),
        F.concat_ws(",", F.array_sort(F.collect_set("action"))).alias("actions"), F.max_by("id", F.struct("us", "id")).alias("last_id"),
    )


def port_scan(profile: DataFrame, ports: int = 10) -> DataFrame:
    return profile.filter(F.col("ports") >= ports).select("ip", "ports", "last_id")


def brute_force(profile: DataFrame, least: int = 5, high: int = 15) -> DataFrame:
    return profile.filter(F.col("failed") >= least).select("ip", "failed", F.when(F.col("failed") >= high, "high").otherwise("medium").alias("severity"))


def credential_stuffing(profile: DataFrame, users: int = 3, failed: int = 5) -> DataFrame:
    return profile.filter((F.col("users") >= users) & (F.col("failed") >= failed)).select("ip", "users", "failed")


def burst(e: DataFrame, least: int = 10, width: int = MINUTE) -> DataFrame:
    """Ips with `least` or more events within `width` of their own first event."""
    first = F.min("us").over(Window.partitionBy("ip"))
    near = e.select("ip", "us", first.alias("first_us")).filter(F.col("us") - F.col("first_us") <= width)
    return near.groupBy("ip", "first_us").agg(F.count("*").alias("n"), F.max("us").alias("last_us")).filter(F.col("n") >= least)


def gaps(e: DataFrame, key: str) -> DataFrame:
    """Per key: events and the mean and population deviation of gaps between events, in seconds, and their ratio (burstiness, 2 at most)."""
    lag = F.col("us") - F.lag("us").over(Window.partitionBy(key).orderBy("us", "id"))
    g = e.select(key, (lag / F.lit(1e6)).alias("gap"))
    out = g.groupBy(key).agg(F.count("*").alias("events"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("sd_gap"))
    return out.withColumn("burstiness", F.when(F.col("mean_gap") > 0, F.least(F.col("sd_gap") / F.col("mean_gap"), F.lit(2.0))).otherwise(0.0))


def greedy_windows(e: DataFrame, key: str, width: int = 5 * MINUTE) -> DataFrame:
    """Entries (with `key` and us) with the start of their anchored window: a window opens at the first event later than
    the last start + width.

    Where a window starts depends on all starts before it, so a key's entries pass one task in order of time, a batch at
    a time; only the key and the open window are held.
    """
    fields = e.schema

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start = None, 0
        for b in batches:
            keys, us = b.column(fields.names.index(key)).to_pylist(), b.column(fields.names.index("us")).to_numpy(zero_copy_only=False)
            out, i = np.zeros(len(us), np.int64), 0
            ends = [j for j in range(1, len(keys)) if keys[j] != keys[j - 1]] + [len(keys)]
            for end in ends if keys else ():
                if keys[i] != last:
                    last, start = keys[i], int(us[i])
                while i < end:
                    if us[i] > start + width:
                        start = int(us[i])
                    stop = i + int(np.searchsorted(us[i:end], start + width, "right"))
                    out[i:stop], i = start, stop
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "window_start"])

    dealt = e.filter(F.col(key).isNotNull() & F.col("us").isNotNull()).repartition(F.col(key)).sortWithinPartitions(key, "us")
    return dealt.mapInArrow(walk, T.StructType([*fields.fields, T.StructField("window_start", T.LongType())]))


def windowed_brute_chains(e: DataFrame, least: int = 5, span: int = 10 * MINUTE, width: int = 5 * MINUTE) -> DataFrame:
    """Failures per (ip, user) in one anchored window of the ip."""
    g = greedy_windows(e.select("id", "us", "ip", "user", "outcome"), "ip", width).filter("outcome = 'failure'").groupBy("ip", "window_start", "user").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    return g.filter((F.col("n") >= least) & (F.col("last_us") - F.col("first_us") <= span)).withColumn("confidence", F.least(0.7 + F.col("n") / 50, F.lit(0.95)))


def windowed_spray_chains(e: DataFrame, least: int = 10, span: int = 15 * MINUTE, width: int = 5 * MINUTE) -> DataFrame:
    """Failures of `least` or more users of one ip in one anchored window of it."""
    g = greedy_windows(e.select("id", "us", "ip", "user", "outcome"), "ip", width).filter("outcome = 'failure'").groupBy("ip", "window_start").agg(F.count_distinct("user").alias("users"), F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    return g.filter((F.col("users") >= least) & (F.col("last_us") - F.col("first_us") <= span))
