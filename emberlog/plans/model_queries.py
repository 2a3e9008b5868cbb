"""Auto-parsing, entry features and classifier measures over lines and entries made from the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.functions.attacks import DESKTOP_TACTICS, WEB_TACTICS
from emberlog.operators import autoparse as A
from emberlog.operators import descriptors as D
from emberlog.operators import labels as B
from emberlog.operators import models as M
from emberlog.operators import sized
from emberlog.plans.entries import SQL, entries
from emberlog.plans.log_queries import LINES

QUERIES: dict = {}
ORACLES: dict = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = SQL + sql
        return f

    return add


#: Sources by a user's number modulo 8, and the type of each.
_TYPES = ("Linux SSHD Failed", "Linux Syslog", "iptables", "Windows Event Viewer", "Windows Security CSV", "MySQL Slow Query", "Docker", "Custom / Raw")


@_query(""", l AS (SELECT *, CAST(substr("user", 2) AS BIGINT) % 8 AS f, us // 1000000 * 1000000 AS t FROM e WHERE id IS NOT NULL)
SELECT f AS source, id * 4 AS line_no, CASE f WHEN 2 THEN NULL WHEN 7 THEN NULL ELSE t END AS us, CASE WHEN f IN (0, 2, 4, 5, 6) THEN ip END AS source_ip, CASE WHEN f IN (0, 4, 5, 6) THEN "user" END AS "user",
  CASE f WHEN 0 THEN 'login' WHEN 2 THEN 'firewall_block' WHEN 6 THEN action END AS action, CASE f WHEN 0 THEN 'failure' WHEN 2 THEN 'blocked' WHEN 6 THEN outcome END AS outcome,
  CASE f WHEN 0 THEN 'warning' WHEN 1 THEN CASE WHEN severity IN ('error', 'warning', 'critical') THEN severity ELSE 'info' END WHEN 2 THEN 'warning' WHEN 3 THEN 'warning' WHEN 4 THEN CASE WHEN severity IN ('error', 'warning') THEN severity ELSE 'info' END WHEN 5 THEN 'warning' WHEN 6 THEN severity ELSE 'info' END AS severity,
  f <> 7 AS parsed, CASE WHEN f = 5 THEN 3 ELSE 1 END AS lines FROM l""")
def auto_parse(spark, sf_dir):
    """Entries of eight sources: four families of lines, exported rows, JSON, records of three lines and unknown text."""
    e = sized.spread(entries(spark, sf_dir).filter("id is not null"), LINES).withColumn("f", F.substring("user", 2, 20).cast("long") % 8)
    ts = lambda f: F.date_format("event_ts", f)
    text = lambda *parts: F.array(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    ip, user, sys = F.col("ip"), F.col("user"), ts("MMM dd HH:mm:ss")
    forms = [
        text(sys, " gate sshd[77]: Failed password for ", user, " from ", ip, " port 22 ssh2"), text(sys, " gate app[7]: level ", F.col("severity")), text("gw: IPTABLES-DROP: SRC=", ip, " DST=198.18.0.9"),
        text("Audit Failure ", ts("MM-dd-yyyy HH:mm:ss"), " logon"), text(ts("yyyy-MM-dd HH:mm:ss"), ",4625,", F.col("severity"), ",Security,PC7,logon failed,", user, ",3,", ip),
        F.concat(text("# Time: ", ts("yyyy-MM-dd'T'HH:mm:ss"), "Z"), text("# User@Host: ", user, "[", user, "] @ db1 [", ip, "]"), text("select 1;")),
        text('{"time":"', ts("yyyy-MM-dd'T'HH:mm:ss"), 'Z","sourceIp":"', ip, '","username":"', user, '","action":"', F.col("action"), '","status":"', F.col("outcome"), '","level":"', F.col("severity"), '"}'), text("free text of ", user),
    ]
    lines = e.select(F.col("f").cast("string").alias("source"), "id", F.posexplode(F.coalesce(*(F.when(F.col("f") == i, form) for i, form in enumerate(forms)))).alias("at", "line"))
    lines = lines.select("source", (F.col("id") * 4 + F.col("at")).alias("line_no"), "line")
    types = spark.createDataFrame([(str(i), t) for i, t in enumerate(_TYPES)], "source string, log_type string")
    out = A.auto_parse(lines, types, F.lit("2024-12-30 23:59:59").cast("timestamp"))
    return out.select(F.col("source").cast("long").alias("source"), "line_no", F.unix_micros("event_ts").alias("us"), "source_ip", "user", "action", "outcome", "severity", "parsed", "lines")


@_query(""", v AS (SELECT id, us, lower(log_type) AS log_type, lower(severity) AS severity, lower(action) AS action, lower(outcome) AS outcome, port, 'k ' || action || ' by ' || "user" AS message FROM e)
SELECT id, hour(make_timestamp(us)) AS hour, (dayofweek(make_timestamp(us)) + 6) % 7 AS day_of_week, dense_rank() OVER (ORDER BY log_type) - 1 AS log_type, dense_rank() OVER (ORDER BY severity) - 1 AS severity,
  dense_rank() OVER (ORDER BY action) - 1 AS action, dense_rank() OVER (ORDER BY outcome) - 1 AS outcome, coalesce(port, 0)::DOUBLE AS port, CASE WHEN port % 3 = 0 THEN port + 0.5 ELSE 0 END::DOUBLE AS bytes, length(message) AS msg_len FROM v""")
def entry_feature_rows(spark, sf_dir):
    """Times, categories, numbers and lengths of entries."""
    e = entries(spark, sf_dir)
    k = F.col("port")
    fields = F.create_map(F.lit("bytes"), F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(".5"))).otherwise("none"))
    out = M.entry_features(e.withColumn("fields", fields).withColumn("message", F.concat(F.lit("k "), "action", F.lit(" by "), "user")))
    return out.select("id", "hour", "day_of_week", "log_type", "severity", "action", "outcome", "port", "bytes", "msg_len")


@_query(""", p AS (SELECT action AS label, CASE WHEN port < 60 THEN action WHEN port < 80 THEN 'error' ELSE outcome END AS prediction FROM e),
c AS (SELECT DISTINCT label FROM (SELECT label FROM p UNION ALL SELECT prediction FROM p) x),
r AS (SELECT c.label, (SELECT count(*) FROM p WHERE p.label = c.label) AS support, (SELECT count(*) FROM p WHERE p.prediction = c.label) AS said, (SELECT count(*) FROM p WHERE p.label = c.label AND p.prediction = c.label) AS hits FROM c)
SELECT label, CASE WHEN said > 0 THEN hits / said ELSE 0 END::DOUBLE AS "precision", CASE WHEN support > 0 THEN hits / support ELSE 0 END::DOUBLE AS recall, CASE WHEN said + support > 0 THEN 2 * hits / (said + support) ELSE 0 END::DOUBLE AS f1, support FROM r
UNION ALL SELECT 'weighted', NULL, sum(hits) / sum(support), sum(CASE WHEN said + support > 0 THEN 2 * hits / (said + support) ELSE 0 END * support) / sum(support), sum(support)::BIGINT FROM r""")
def classifier_measures(spark, sf_dir):
    """Precision, recall and F1 of each class, and the accuracy and F1 weighted by support, of made predictions."""
    e = entries(spark, sf_dir)
    table = M.confusion(e.select(F.col("action").alias("label"), F.when(F.col("port") < 60, F.col("action")).when(F.col("port") < 80, "error").otherwise(F.col("outcome")).alias("prediction")))
    all_ = M.measures(table).select(F.lit("weighted").alias("label"), F.lit(None).cast("double").alias("precision"), F.col("accuracy").alias("recall"), F.col("weighted_f1").alias("f1"), F.col("rows").alias("support"))
    return M.class_report(table).unionByName(all_)


@_query(""", d AS (SELECT id, action, "user" AS u, ip, port FROM e WHERE id IS NOT NULL)
SELECT id, 'svc_' || action AS service_name, CASE WHEN port % 2 = 0 THEN u END AS cid_user, CASE WHEN port % 3 > 0 THEN ip END AS host, CASE WHEN port % 3 = 1 THEN port::VARCHAR END AS port, 'establish' AS action FROM d""")
def nested_descriptors(spark, sf_dir):
    """Services, users, hosts and ports of listener lines whose brackets nest in three ways."""
    e = entries(spark, sf_dir).filter("id is not null")
    k = F.col("port")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    cid = F.when(k % 2 == 0, text("(CID=(PROGRAM=app)(USER=", F.col("user"), "))")).otherwise("")
    address = F.when(k % 3 == 0, "").when(k % 3 == 1, text("(PROTOCOL=tcp)(HOST=", F.col("ip"), ")(PORT=", k, ")")).otherwise(text("(PORT=)(HOST=", F.col("ip"), ")"))
    line = text("01-JAN-2024 00:00:06 * (CONNECT_DATA=(SERVICE_NAME=svc_", F.col("action"), ")", cid, ") * (ADDRESS=", address, ") * establish * crm * 0")
    got = e.select("id", D.listener(line).alias("m"))
    return got.select("id", *(F.col("m")[c].alias(c) for c in ("service_name", "cid_user", "host", "port", "action")))


@_query(""", k AS (SELECT "user" AS u, attack_type AS t FROM e WHERE attack_type IS NOT NULL),
m AS (SELECT * FROM (VALUES ('bruteforce', 'Credential Access'), ('sql_injection', 'Initial Access'), ('sql_injection', 'Execution')) v(t, tactic)),
c AS (SELECT u, string_agg(DISTINCT tactic, ',' ORDER BY tactic) AS tactics FROM k LEFT JOIN m USING (t) GROUP BY u)
SELECT u AS "user", coalesce(tactics, 'Unknown') AS tactics, (SELECT min(CASE t WHEN 'bruteforce' THEN 'T1110 - Brute Force' WHEN 'sql_injection' THEN 'T1190 - Exploit Public-Facing Application' ELSE 'T1046 - Network Service Discovery' END) FROM k WHERE k.u = c.u) AS technique,
  (SELECT max(CASE t WHEN 'bruteforce' THEN 1 WHEN 'sql_injection' THEN 2 ELSE 1 END) FROM k WHERE k.u = c.u) AS web_tactics FROM c""")
def tactics_of_chains(spark, sf_dir):
    """Tactics of each user's attack types taken together, and what single types have in two tables."""
    e = entries(spark, sf_dir).filter("attack_type is not null")
    _, technique = B.tactics_of(F.col("attack_type"), DESKTOP_TACTICS, "TA0006 - Credential Access", "T1059 - Command and Scripting Interpreter")
    web, _ = B.tactics_of(F.col("attack_type"), WEB_TACTICS, "Unknown", "Unknown")
    g = e.groupBy("user").agg(F.collect_set("attack_type").alias("kinds"), F.min(technique).alias("technique"), F.max(F.size(web)).alias("web_tactics"))
    return g.select("user", F.array_join(B.chain_tactics(F.col("kinds")), ",").alias("tactics"), "technique", "web_tactics")
