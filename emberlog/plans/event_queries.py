"""Queries over the event stream as log entries: statistics, filters, joins, windows and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import correlation as C
from emberlog.operators import detections as D
from emberlog.operators import enrich as N
from emberlog.operators import feedback as K
from emberlog.operators import features as M
from emberlog.operators import filters as L
from emberlog.operators import labels as B
from emberlog.operators import stats as A
from emberlog.operators import sets as X
from emberlog.plans.entries import SQL, entries
from emberlog.sources import lines

QUERIES: dict = {}
ORACLES: dict = {}
HOUR = 3_600_000_000
DAY = 24 * HOUR


def _query(sql: str | None = None, prefix: str = SQL):
    """Register a function of entries under its name, with the SQL that follows the entries prefix."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(entries(spark, sf_dir))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql:
            ORACLES[f.__name__] = prefix + sql
        return f

    return add


# ---- windows


@_query(f""", w AS (SELECT ip, "user", us, count(*) OVER (PARTITION BY ip, "user" ORDER BY us RANGE BETWEEN CURRENT ROW AND {DAY} FOLLOWING) AS n FROM e WHERE outcome = 'failure'),
h AS (SELECT *, row_number() OVER (PARTITION BY ip, "user" ORDER BY us, n) AS r, max(n) OVER (PARTITION BY ip, "user") AS most FROM w WHERE n >= 2)
SELECT ip, "user", us AS start_us, n AS failures, most FROM h WHERE r = 1""")
def sliding_brute_force(e):
    return D.sliding_brute_force(e, 2, DAY)


@_query(f""", s AS (SELECT DISTINCT ip, us FROM e WHERE outcome = 'failure'),
c AS (SELECT s.ip, s.us, count(DISTINCT f."user") AS users FROM s JOIN e f ON f.ip = s.ip AND f.outcome = 'failure' AND f.us BETWEEN s.us AND s.us + {3 * DAY} GROUP BY 1, 2),
h AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY us) AS r, max(users) OVER (PARTITION BY ip) AS most_users FROM c WHERE users >= 2)
SELECT ip, us AS start_us, users::BIGINT AS users, most_users::BIGINT AS most_users FROM h WHERE r = 1""")
def password_spray(e):
    return D.password_spray(e, 2, 3 * DAY)


@_query(f""", w AS (SELECT id, "user", us, outcome, count(*) FILTER (WHERE outcome = 'failure') OVER (PARTITION BY "user" ORDER BY us RANGE BETWEEN {2 * DAY} PRECEDING AND 1 PRECEDING) AS failures FROM e WHERE outcome <> 'unknown')
SELECT id, "user", us, failures FROM w WHERE outcome = 'success' AND failures >= 2""")
def success_after_failures(e):
    return D.success_after_failures(e, 2, 2 * DAY)


@_query(f""", f AS (SELECT ip, us, min(us) OVER (PARTITION BY ip) AS first_us FROM e)
SELECT ip, first_us, count(*) AS n, max(us) AS last_us FROM f WHERE us - first_us <= {DAY} GROUP BY 1, 2 HAVING count(*) >= 3""")
def burst(e):
    return D.burst(e, 3, DAY)


@_query(""", g AS (SELECT "user", (us - lag(us) OVER (PARTITION BY "user" ORDER BY us, id)) / 1000000 AS gap FROM e)
SELECT "user", count(*) AS events, round(avg(gap), 4) AS mean_gap, round(stddev_pop(gap), 2) AS sd_gap, round(CASE WHEN avg(gap) > 0 THEN least(stddev_pop(gap) / avg(gap), 2.0) ELSE 0 END, 6) AS burstiness FROM g GROUP BY 1""")
def inter_arrival_gaps(e):
    g = D.gaps(e, "user")
    return g.select("user", "events", F.round("mean_gap", 4).alias("mean_gap"), F.round("sd_gap", 2).alias("sd_gap"), F.round("burstiness", 6).alias("burstiness"))


@_query()
def greedy_windows(e):
    """Anchored windows of an hour per ip; a fold, tested against brute force."""
    return D.greedy_windows(e.select("id", "us", "ip"), "ip", HOUR)


@_query()
def windowed_brute_chains(e):
    return D.windowed_brute_chains(e, 2, 2 * DAY, DAY)


@_query()
def windowed_spray_chains(e):
    return D.windowed_spray_chains(e, 2, 2 * DAY, DAY)


@_query(""" SELECT ip, min_by(id, us::HUGEINT * 100000000 + id) AS first_id, max_by(id, us::HUGEINT * 100000000 + id) AS last_id FROM e GROUP BY ip""")
def first_last_event(e):
    return X.first_and_last(e)


# ---- grouped rules

_PROFILE = """, p AS (SELECT ip, count(*) AS events, count(*) FILTER (WHERE outcome = 'failure') AS failed, count(DISTINCT "user") AS users, count(DISTINCT port) AS ports,
  string_agg(DISTINCT action, ',' ORDER BY action) AS actions, max_by(id, us::HUGEINT * 100000000 + id) AS last_id FROM e GROUP BY ip) """


@_query(_PROFILE + "SELECT * FROM p")
def ip_profile(e):
    return D.ip_profile(e)


@_query(_PROFILE + "SELECT ip, ports, last_id FROM p WHERE ports >= 10")
def port_scan(e):
    return D.port_scan(D.ip_profile(e))


@_query(_PROFILE + "SELECT ip, failed, CASE WHEN failed >= 15 THEN 'high' ELSE 'medium' END AS severity FROM p WHERE failed >= 5")
def brute_force(e):
    return D.brute_force(D.ip_profile(e))


@_query(_PROFILE + "SELECT ip, users, failed FROM p WHERE users >= 3 AND failed >= 5")
def credential_stuffing(e):
    return D.credential_stuffing(D.ip_profile(e))


@_query(""" SELECT "user", count(*) AS uses, min(us) AS first_us, max(us) AS last_us FROM e WHERE action = 'signup' GROUP BY 1 HAVING count(*) > 3""")
def privilege_use(e):
    return D.privilege_use(e.filter("action = 'signup'"), 3)


# ---- statistics


@_query(""" SELECT 'severity' AS dimension, severity AS value, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'log_type', log_type, count(*) FROM e GROUP BY 2
UNION ALL SELECT 'outcome', outcome, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM e""")
def entry_counts(e):
    return A.counts(e)


@_query(" SELECT ip, count(*) AS n, min(id) AS first_id FROM e GROUP BY ip ORDER BY n DESC, first_id LIMIT 10")
def top_ips(e):
    return A.top(e, "ip", 10)


@_query(' SELECT "user", count(*) AS n, min(id) AS first_id FROM e GROUP BY 1 ORDER BY n DESC, first_id LIMIT 20')
def top_users(e):
    return A.top(e, "user", 20)


@_query(" SELECT us // 60000000 * 60000000 AS minute_us, count(*) AS n, count(*) FILTER (WHERE is_anomaly) AS anomalies, count(*) FILTER (WHERE NOT is_anomaly) AS normal FROM e GROUP BY 1")
def minute_timeline(e):
    return A.minute_timeline(e)


@_query(' SELECT count(DISTINCT ip) AS ips, count(DISTINCT "user") AS users, count(DISTINCT action) AS actions FROM e')
def distinct_counts(e):
    return A.distinct_counts(e)


@_query(""" SELECT count(*) AS total, count(attack_type) AS attacks, count(DISTINCT attack_type) AS types, count(*) FILTER (WHERE is_anomaly) AS anomalies,
  least(10 * count(attack_type) + 5 * count(*) FILTER (WHERE is_anomaly), 100)::BIGINT AS risk FROM e""")
def attack_summary(e):
    return A.attack_summary(e)


@_query(" SELECT severity, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS percent FROM e GROUP BY 1")
def severity_share(e):
    return A.severity_share(e).withColumn("percent", F.col("percent").cast("double"))


@_query(" SELECT ip, count(*) AS n, CASE WHEN count(*) > 100 THEN 'HIGH' WHEN count(*) > 50 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM e GROUP BY 1")
def ip_risk(e):
    return A.ip_risk(e)


@_query(" SELECT ip AS key, count(*) AS n, count(*) FILTER (WHERE outcome = 'failure') AS failed, round(1 - count(*) FILTER (WHERE outcome = 'failure') / count(*), 6) AS success_rate FROM e GROUP BY 1")
def merged_counters(e):
    """Partial counters of each log type, merged by ip."""
    parts = [e.filter(F.col("log_type") == t).groupBy(F.col("ip").alias("key")).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "failure").alias("failed")) for t in ("apache", "ssh_auth", "mysql_error", "iptables")]
    return A.merge(parts)


@_query(""", g AS (SELECT *, (us - lag(us) OVER (PARTITION BY ip ORDER BY us, id)) / 1000000 AS gap FROM e)
SELECT ip, count(*) AS n, round(count(*) FILTER (WHERE outcome = 'failure') / count(*), 6) AS failure_rate, count(DISTINCT "user") AS users, count(DISTINCT port) AS ports, round(log2(1 + count(DISTINCT port)), 6) AS log_ports,
  round(count(*) * 60000000 / greatest(max(us) - min(us), 1), 6) AS per_minute, count(*) FILTER (WHERE us // 3600000000 % 24 < 6) AS off_hours FROM g GROUP BY ip""")
def batch_features(e):
    """The feature vector of each ip."""
    return X.behaviour(e)


# ---- filters, sorting, sets


@_query(""" SELECT id, ip, port, severity FROM e WHERE lower(severity) = 'error' AND contains(lower(ip), '10.0.0.1') AND port > 40""")
def structured_filter(e):
    fs = [L.Filter("severity", "equals", "ERROR"), L.Filter("ip", "contains", "10.0.0.1"), L.Filter("port", "greaterThan", 40)]
    return L.apply_filters(e, fs).select("id", "ip", "port", "severity")


@_query(""" SELECT id, attack_type FROM e WHERE attack_type IS NOT NULL AND attack_type <> 'normal'""")
def attack_filter(e):
    return L.attack_filter(e).select("id", "attack_type")


@_query(""" SELECT id, ip, "user", outcome FROM e WHERE ip = '10.0.0.7' AND outcome = 'failure'""")
def prompt_filter(e):
    return L.apply_filters(e, L.criteria("show failed sign-ins from 10.0.0.7")).select("id", "ip", "user", "outcome")


@_query(""" SELECT id, ip, "user", action FROM e WHERE contains(lower(ip), '.12') OR contains(lower("user"), '.12') OR contains(lower(action), '.12')""")
def text_search(e):
    return L.search(e, ".12", ("ip", "user", "action")).select("id", "ip", "user", "action")


@_query(" SELECT id, us, ip FROM e ORDER BY us DESC, id DESC LIMIT 100")
def newest_first(e):
    return L.newest(e).select("id", "us", "ip")


@_query(" SELECT id, us, ip FROM e ORDER BY us, id LIMIT 500 OFFSET 500")
def second_page(e):
    return L.page(e, 1).select("id", "us", "ip")


@_query(""" SELECT DISTINCT "user" FROM e WHERE outcome = 'failure' INTERSECT SELECT DISTINCT "user" FROM e WHERE outcome = 'success'""")
def users_failing_and_succeeding(e):
    return X.in_both(e, "user", "failure", "success")


@_query(""" SELECT "user", ip FROM e WHERE is_anomaly EXCEPT SELECT "user", ip FROM e WHERE attack_type IS NOT NULL""")
def anomalous_without_attack(e):
    return e.filter("is_anomaly").select("user", "ip").subtract(e.filter("attack_type is not null").select("user", "ip"))


@_query(""" SELECT 'web' AS source, count(*) AS n FROM e WHERE log_type = 'apache' UNION ALL SELECT 'auth', count(*) FROM e WHERE log_type = 'ssh_auth'""")
def union_sources(e):
    parts = {"web": e.filter("log_type = 'apache'"), "auth": e.filter("log_type = 'ssh_auth'")}
    return lines.tagged(parts).groupBy(F.col("log_source").alias("source")).agg(F.count("*").alias("n"))


@_query(""" SELECT ip, port, min(id) AS id FROM e GROUP BY ip, port""")
def dedupe_on_key(e):
    """The first entry of each (ip, port)."""
    return X.first_of_each(e, "ip", "port")


# ---- joins


@_query(f""", a AS (SELECT id, us FROM e WHERE log_type = 'apache' AND action = 'error'), b AS (SELECT id, us FROM e WHERE log_type = 'mysql_error'),
j AS (SELECT a.id AS left_id, b.id AS right_id, b.us - a.us AS gap_us, row_number() OVER (PARTITION BY a.id ORDER BY b.us, b.id) AS r FROM a JOIN b ON b.us > a.us AND b.us - a.us < {HOUR})
SELECT left_id, right_id, gap_us FROM j WHERE r = 1""")
def web_database_chain(e):
    """Web errors with the first database entry within an hour after."""
    return C.interval_chains(e.filter("log_type = 'apache' and action = 'error'"), e.filter("log_type = 'mysql_error'"), HOUR)


@_query(""" SELECT a.id, a.ip FROM e a WHERE a.is_anomaly AND NOT EXISTS (SELECT 1 FROM e b WHERE b.attack_type IS NOT NULL AND b.id = a.id)""")
def anomaly_alerts(e):
    """Anomalies that no attack alert has."""
    return X.uncovered_anomalies(e)


@_query(""" SELECT attack_type, tactic, technique, count(*) AS n FROM (SELECT attack_type FROM e WHERE attack_type IS NOT NULL) x LEFT JOIN
(VALUES ('bruteforce', 'Credential Access', 'T1110'), ('sql_injection', 'Initial Access', 'T1190'), ('xss_attack', 'Execution', 'T1059'), ('port_scan', 'Discovery', 'T1046'), ('privilege_escalation', 'Privilege Escalation', 'T1068')) m(attack_type, tactic, technique)
USING (attack_type) GROUP BY ALL""")
def mitre_counts(e):
    return B.with_mitre(e.filter("attack_type is not null").select("attack_type")).groupBy("attack_type", "tactic", "technique").agg(F.count("*").alias("n"))


@_query(""" SELECT attack_type, count(*) AS n, CASE attack_type WHEN 'bruteforce' THEN 'Lock out or slow down repeated sign-ins' WHEN 'sql_injection' THEN 'Use bound parameters and filter requests' WHEN 'port_scan' THEN 'Limit exposed ports and watch the source' END AS advice
FROM e WHERE attack_type IS NOT NULL GROUP BY 1""")
def recommendations(e):
    return B.recommendations(e.filter("attack_type is not null"))


# ---- correlation

_CHAINS = """, c AS (SELECT ip, count(attack_type) AS attacks, count(*) FILTER (WHERE is_anomaly) AS anomalies, count(*) AS n, min(us) AS first_us, max(us) AS last_us, coalesce(string_agg(DISTINCT attack_type, ',' ORDER BY attack_type), '') AS types
  FROM e WHERE attack_type IS NOT NULL OR is_anomaly GROUP BY ip),
k AS (SELECT *, round(0.75 + 0.02 * least(n, 10), 2)::DOUBLE AS confidence FROM c WHERE attacks >= 2 OR anomalies >= 2 OR attacks >= 1 AND anomalies >= 1) """


@_query(_CHAINS + "SELECT * FROM k")
def ip_chains(e):
    return C.ip_chains(e).withColumn("confidence", F.col("confidence").cast("double"))


@_query(_CHAINS + """, t AS (SELECT count(*) AS timeline FROM e WHERE attack_type IS NOT NULL)
SELECT count(*) AS chains, count(*) FILTER (WHERE confidence > 0.85) AS high, any_value(timeline) AS timeline, least(15 * count(*) + 2 * any_value(timeline), 100)::BIGINT AS risk FROM k, t""")
def correlation_summary(e):
    return C.summary(C.ip_chains(e), e.filter("attack_type is not null"))


@_query(""" SELECT "user", count(DISTINCT ip) AS ips, count(*) AS failures, 0.85::DOUBLE AS confidence FROM e WHERE outcome = 'failure' GROUP BY 1 HAVING count(DISTINCT ip) >= 1 AND count(*) >= 5""")
def user_targeting(e):
    return C.user_targeting(e, 1, 5)


@_query(""", p AS (SELECT "user", ip, count(*) FILTER (WHERE outcome = 'failure') AS f, count(*) FILTER (WHERE outcome = 'success') AS s FROM e GROUP BY 1, 2)
SELECT "user", sum(f)::BIGINT AS failures, sum(s)::BIGINT AS successes, count(*) FILTER (WHERE f > 0 AND s > 0) AS shared_ips FROM p GROUP BY 1 HAVING count(*) FILTER (WHERE f > 0 AND s > 0) > 0 OR sum(f) > 10 AND sum(s) > 0""")
def account_compromise(e):
    return C.account_compromise(e)


_RANKED = """, a AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY us, id) AS r FROM e WHERE attack_type IS NOT NULL),
ch AS (SELECT ip, count(*) AS n, round(avg(confidence), 4) AS mean_confidence, min(us) AS first_us, max(us) AS last_us, max(CASE WHEN r = 1 THEN attack_type END) AS chain_type, string_agg(CASE WHEN r <= 10 THEN id::VARCHAR END, ',' ORDER BY r) AS event_ids FROM a GROUP BY ip HAVING count(*) >= 3) """


@_query(_RANKED + "SELECT * FROM ch")
def attack_chains(e):
    return C.chains_of(e, "ip")


@_query(_RANKED + "SELECT a.id, a.ip FROM a WHERE a.ip IN (SELECT ip FROM ch)")
def chain_entries(e):
    return C.bridge(e, C.chains_of(e, "ip"), "ip")


@_query(_RANKED + """ SELECT "user", count(*) AS n FROM a WHERE ip NOT IN (SELECT ip FROM ch) GROUP BY 1""")
def uncovered_user_attacks(e):
    """Attacks of users over the entries that no ip chain covers."""
    covered = C.bridge(e, C.chains_of(e, "ip"), "ip").select("id")
    return e.filter("attack_type is not null").join(covered, "id", "left_anti").groupBy("user").agg(F.count("*").alias("n"))


@_query(""", g AS (SELECT ip AS key, count(*) FILTER (WHERE outcome = 'failure') AS f, count(*) FILTER (WHERE attack_type = 'sql_injection') AS q, count(*) FILTER (WHERE attack_type = 'port_scan') AS p, min(us) AS first_us, max(us) AS last_us FROM e GROUP BY ip),
u AS (SELECT "user" AS key, count(*) FILTER (WHERE outcome = 'failure') AS f, count(*) FILTER (WHERE outcome = 'success') AS s, min(us) AS first_us, max(us) AS last_us FROM e GROUP BY 1)
SELECT key, 'account_takeover' AS rule, f AS evidence, first_us, last_us FROM u WHERE f >= 5 AND s >= 1 UNION ALL SELECT key, 'data_breach', q, first_us, last_us FROM g WHERE q >= 2
UNION ALL SELECT key, 'reconnaissance', p, first_us, last_us FROM g WHERE p >= 1 UNION ALL SELECT key, 'brute_force', f, first_us, last_us FROM g WHERE f >= 5""")
def kill_chains(e):
    return C.kill_chains(e)


@_query(""" SELECT ip, count(*) AS n, count(DISTINCT attack_type) AS types, count(*) * count(DISTINCT attack_type) AS threat_score FROM e WHERE attack_type IS NOT NULL GROUP BY ip ORDER BY threat_score DESC, ip LIMIT 10""")
def threat_scores(e):
    return C.threat_scores(e)


# ---- features and scores

_VECTOR = """, v AS (SELECT ip, count(*) AS n, count(*) FILTER (WHERE outcome = 'failure') / count(*) AS failure_rate, count(DISTINCT port) AS ports FROM e GROUP BY ip),
s AS (SELECT *, (0.5 * least(greatest(failure_rate / 0.4, 0.0), 1.0) + 0.3 * least(greatest(ports / 100, 0.0), 1.0) + 0.2 * least(greatest(n / 250, 0.0), 1.0)) AS raw FROM v)
SELECT ip, round(raw, 6) AS raw, round(1 / (1 + exp(-10 * (raw - 0.5))), 6) AS score, raw >= 0.5 AS hit FROM s"""


def _vector(e):
    return e.groupBy("ip").agg(F.count("*").alias("n"), (F.count_if(F.col("outcome") == "failure") / F.count("*")).alias("failure_rate"), F.count_distinct("port").alias("ports"))


@_query(_VECTOR)
def linear_anomaly_score(e):
    s = M.linear_score(_vector(e), {"failure_rate": 0.5, "ports": 0.3, "n": 0.2}, {"failure_rate": 0.4, "ports": 100.0, "n": 250.0})
    return s.select("ip", F.round("raw", 6).alias("raw"), F.round("score", 6).alias("score"), "hit")


@_query()
def isolation_forest_scores(e):
    """Anomaly scores of ips by random split trees."""
    return M.isolation_forest(_vector(e), "ip", ["n", "failure_rate", "ports"])


# ---- enrichment, gates and feedback


@_query(""" SELECT CASE log_type WHEN 'apache' THEN 'web' WHEN 'ssh_auth' THEN 'auth' WHEN 'mysql_error' THEN 'database' WHEN 'iptables' THEN 'firewall' ELSE 'other' END AS category, severity, count(*) AS n FROM e GROUP BY ALL""")
def category_severity(e):
    return e.groupBy(N.category(F.col("log_type")).alias("category"), "severity").agg(F.count("*").alias("n"))


@_query(" SELECT id, ip || ' ' || action AS title FROM e")
def event_titles(e):
    return e.select("id", N.title(F.col("ip"), F.col("action"), F.col("user"), F.col("outcome"), F.col("severity")).alias("title"))


@_query(""", g AS (SELECT ip, count(*) AS n, count(*) FILTER (WHERE outcome = 'failure') AS failed FROM e GROUP BY ip)
SELECT ip, n, failed, n < 10 OR failed / n < 0.2 AS false_positive, CASE WHEN n < 10 THEN 'few events' WHEN failed / n < 0.2 THEN 'low failure rate' END AS reason FROM g""")
def false_positive_gate(e):
    return N.likely_false(e.groupBy("ip").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "failure").alias("failed")), 10, 0.2)


_FEEDBACK = """, f AS (SELECT us, CASE WHEN port % 3 = 0 THEN 'correct' WHEN port % 3 = 1 THEN 'false_positive' ELSE 'unclear' END AS verdict, attack_type AS predicted FROM e WHERE attack_type IS NOT NULL)"""


@_query(_FEEDBACK + """, m AS (SELECT max(us) AS now_us FROM e) SELECT verdict, predicted, count(*) AS n, count(*) FILTER (WHERE us > 1706659032194062 - 86400000000) AS last_day FROM f WHERE verdict <> 'unclear' GROUP BY 1, 2""")
def feedback_stats(e):
    """Verdicts derived from the port, as feedback rows."""
    verdict = F.when(F.col("port") % 3 == 0, "correct").when(F.col("port") % 3 == 1, "false_positive").otherwise("unclear")
    f = e.filter("attack_type is not null").select("us", verdict.alias("verdict"), F.col("attack_type").alias("predicted"))
    return K.stats(f, 1_706_659_032_194_062)


@_query(""" SELECT attack_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS percent FROM e WHERE attack_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, attack_type LIMIT 5""")
def attack_type_slices(e):
    from pyspark.sql import Window

    g = e.filter("attack_type is not null").groupBy("attack_type").agg(F.count("*").alias("n"))
    return g.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).cast("double")).orderBy(F.desc("n"), "attack_type").limit(5)


@_query(""" SELECT us // 300000000 * 300000000 AS minute_us, count(*) AS n, count(*) FILTER (WHERE is_anomaly) AS anomalies, count(*) FILTER (WHERE NOT is_anomaly) AS normal FROM e GROUP BY 1 ORDER BY 1 LIMIT 500""")
def capped_timeline(e):
    """The first 500 steps of the five-minute timeline."""
    return A.minute_timeline(e, 5).orderBy("minute_us").limit(500)


@_query(""", f AS (SELECT "user", ip FROM e WHERE outcome = 'failure'), s AS (SELECT "user", ip FROM e WHERE outcome = 'success')
SELECT "user", coalesce(f.n, 0) AS failing, coalesce(s.n, 0) AS succeeding FROM (SELECT "user", count(DISTINCT ip) AS n FROM f GROUP BY 1) f FULL JOIN (SELECT "user", count(DISTINCT ip) AS n FROM s GROUP BY 1) s USING ("user") """)
def ips_by_outcome(e):
    return X.ips_by_outcome(e)
