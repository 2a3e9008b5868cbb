"""The driver's `events` table seen as normalised log entries, for Spark and as a SQL prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    bad = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("event_ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"), F.concat(F.lit("10.0.0."), F.pmod("user_id", F.lit(50)).cast("string")).alias("ip"),
        k.alias("port"), F.col("event_type").alias("action"), F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.when(bad, "failure").when(F.col("event_type").isin("signup", "purchase"), "success").otherwise("unknown").alias("outcome"),
        F.when(bad & (k >= 80), "critical").when(bad, "error").when(F.col("event_type") == "purchase", "warning").otherwise("info").alias("severity"),
        F.element_at(F.array(*map(F.lit, ("apache", "ssh_auth", "mysql_error", "iptables"))), (F.pmod("user_id", F.lit(4)) + 1).cast("int")).alias("log_type"),
        F.when(bad & (k % 5 == 0), "bruteforce").when((F.col("event_type") == "click") & (k % 25 == 0), "sql_injection").when((F.col("event_type") == "view") & (k % 40 == 0), "port_scan").alias("attack_type"),
        ((k % 5) * 10 + 50).cast("long").alias("confidence"), (F.col("value") >= 30).alias("is_anomaly"),
    )


SQL = """WITH e AS (
  SELECT event_id AS id, epoch_us(ts) AS us, 'u' || user_id AS "user", '10.0.0.' || (user_id % 50) AS ip, (props->>'$.k')::INTEGER AS port, event_type AS action,
    CAST(round(value * 100) AS BIGINT) AS cents,
    CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type IN ('signup', 'purchase') THEN 'success' ELSE 'unknown' END AS outcome,
    CASE WHEN event_type = 'error' AND (props->>'$.k')::INTEGER >= 80 THEN 'critical' WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'warning' ELSE 'info' END AS severity,
    CASE user_id % 4 WHEN 0 THEN 'apache' WHEN 1 THEN 'ssh_auth' WHEN 2 THEN 'mysql_error' ELSE 'iptables' END AS log_type,
    CASE WHEN event_type = 'error' AND (props->>'$.k')::INTEGER % 5 = 0 THEN 'bruteforce' WHEN event_type = 'click' AND (props->>'$.k')::INTEGER % 25 = 0 THEN 'sql_injection'
      WHEN event_type = 'view' AND (props->>'$.k')::INTEGER % 40 = 0 THEN 'port_scan' END AS attack_type,
    CAST((props->>'$.k')::INTEGER % 5 * 10 + 50 AS BIGINT) AS confidence, value >= 30 AS is_anomaly
  FROM events)
"""
