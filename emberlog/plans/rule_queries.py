"""The further forensic rules and set, join and sort operations, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import correlation as C
from emberlog.operators import rules as U
from emberlog.operators import sized
from emberlog.plans import forensic_queries as Q
from emberlog.plans.entries import SQL, entries

QUERIES: dict = {}
ORACLES: dict = {}
DAY = 86_400_000_000
AS_OF = 820_454_400_000_000  # 1996-01-01


def _files(spark, sf_dir):
    f = Q._files(spark, sf_dir)
    return f.withColumn("name", F.concat(F.when(F.col("dir") % 5 == 0, "$sys").when(F.col("dir") % 7 == 0, "Windows/").otherwise("doc"), F.col("record").cast("string")))


_SQL = Q._SQL.rstrip() + """, n AS (SELECT *, CASE WHEN dir % 5 = 0 THEN '$sys' WHEN dir % 7 = 0 THEN 'Windows/' ELSE 'doc' END || record AS name FROM f) """


def _rule(sql: str):
    """A rule over files and journal; the SQL selects record, severity and points, which are counted."""

    def add(f):
        def run(spark, sf_dir):
            out = f(_files(spark, sf_dir), Q._journal(spark, sf_dir))
            return out.groupBy("severity", "points").agg(F.count("*").alias("n"), F.sum("record").alias("records"))

        QUERIES[f.__name__] = run
        ORACLES[f.__name__] = _SQL + f", r AS ({sql}) SELECT severity, points::BIGINT AS points, count(*) AS n, sum(record)::BIGINT AS records FROM r GROUP BY ALL"
        return f

    return add


@_rule(f"SELECT record, CASE WHEN y > 1997 THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity, CASE WHEN y > 1997 THEN 20 ELSE 10 END AS points FROM (SELECT record, year(make_timestamp(created_us)) AS y FROM n) x WHERE y > year(make_timestamp({AS_OF}::BIGINT)) + 1 OR y = 1601")
def rule_outside_years(f, j):
    return U.outside_years(f, AS_OF)


@_rule(f"""SELECT record, CASE WHEN created_us > ls + {DAY} THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE WHEN created_us > ls + {DAY} THEN 15 ELSE 7 END AS points FROM n, (SELECT min(us) AS fs, max(us) AS ls FROM j WHERE file % 10 = 1 AND us < 850000000000000) a,
(SELECT max(us) AS ly FROM j WHERE file % 10 = 2 AND us < 840000000000000) b WHERE created_us > ls + {DAY} OR created_us > ly + {DAY} OR created_us < fs - 30 * {DAY}""")
def rule_after_event_logs(f, j):
    return U.after_event_logs(f, j.filter("file % 10 = 1 and us < 850000000000000"), j.filter("file % 10 = 2 and us < 840000000000000"))


@_rule("SELECT record, 'HIGH' AS severity, 15 AS points FROM n JOIN (SELECT record, min(us) AS seen FROM j WHERE reason = 2 GROUP BY 1) s USING (record) WHERE created_us > seen + 300000000")
def rule_event_order(f, j):
    return U.event_order(f, j.filter("reason = 2"))


@_rule("SELECT record, 'CRITICAL' AS severity, 100 AS points FROM n WHERE EXISTS (SELECT 1 FROM j WHERE lsn = 7)")
def rule_logs_cleared(f, j):
    return U.logs_cleared(f, j.filter("lsn = 7"))


@_rule("SELECT record, 'MEDIUM' AS severity, 25 AS points FROM n WHERE record NOT IN (SELECT record FROM j WHERE file % 3 = 0) AND year(make_timestamp(created_us)) < 1995")
def rule_not_in_journal(f, j):
    return U.not_in_journal(f, j.filter("file % 3 = 0"), 1995)


@_rule(f"SELECT record, 'HIGH' AS severity, 50 AS points FROM n, (SELECT min(created_us) AS v FROM n WHERE created_us >= {AS_OF}) b WHERE v - created_us >= 31 * {DAY} AND NOT contains(name, '$')")
def rule_before_volume(f, j):
    return U.before_volume(f, f.filter(F.col("created_us") >= AS_OF))


@_rule(f"SELECT record, CASE WHEN regexp_matches(lower(name), '^(windows|program files|[$])') THEN 'LOW' ELSE 'CRITICAL' END AS severity, CASE WHEN regexp_matches(lower(name), '^(windows|program files|[$])') THEN 5 ELSE 40 END AS points FROM n, (SELECT min(us) AS i FROM j WHERE us >= {AS_OF}) b WHERE created_us < i OR fn_created_us < i")
def rule_before_install(f, j):
    return U.before_install(f, j.filter(F.col("us") >= AS_OF))


@_rule("""SELECT record, 'HIGH' AS severity, 75 AS points FROM (SELECT record, row_number() OVER (PARTITION BY created_us // 60000000 ORDER BY record) AS k, created_us // 60000000 AS m FROM n) x
WHERE k <= 5 AND m IN (SELECT created_us // 60000000 FROM n GROUP BY 1 HAVING count(*) > 10 AND count(DISTINCT dir) > 5)""")
def rule_crowded_minutes(f, j):
    return U.crowded_minutes(f)


@_rule("SELECT record, 'CRITICAL' AS severity, 40 AS points FROM n JOIN (SELECT record, min(us) + 5000000000000 AS w FROM j WHERE CASE WHEN file % 2 = 0 THEN 1 ELSE 4 END = 1 GROUP BY 1) s USING (record) WHERE modified_us < w")
def rule_before_write(f, j):
    return U.before_write(f, j.withColumn("reason", F.when(F.col("file") % 2 == 0, 1).otherwise(4)).withColumn("us", F.col("us") + 5_000_000_000_000))


ORACLES["clock_rollbacks"] = _SQL + """, e AS (SELECT file AS source, record AS number, us, CASE WHEN lsn % 9 = 0 THEN 4616 ELSE 7 END AS event_id FROM j),
w AS (SELECT *, lag(us) OVER (PARTITION BY source ORDER BY number, us, event_id) AS b, lag(event_id) OVER (PARTITION BY source ORDER BY number, us, event_id) AS i FROM e) SELECT source, number, b - us AS back_us, event_id = 4616 OR coalesce(i = 4616, false) AS announced FROM w WHERE us < b"""


def clock_rollbacks(spark, sf_dir):
    j = Q._journal(spark, sf_dir)
    return U.clock_rollbacks(j.select(F.col("file").alias("source"), F.col("record").alias("number"), "us", F.when(F.col("lsn") % 9 == 0, 4616).otherwise(7).alias("event_id")))


ORACLES["weighted_scores"] = _SQL + """, i AS (SELECT record, 'CRITICAL' AS severity, 0.95::DOUBLE AS confidence, 1.5::DOUBLE AS weight FROM n WHERE modified_us < created_us + 864000000000 UNION ALL SELECT record, 'HIGH', 0.7, 1.2 FROM n WHERE fn_created_us > created_us
UNION ALL SELECT record, 'LOW', 0.5, 1.0 FROM n WHERE dir % 3 = 0),
g AS (SELECT record, least(100.0, 100 * sum(CASE severity WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 75 ELSE 25 END * confidence * weight) / sum(100 * weight))::DOUBLE AS s, count(*) FILTER (WHERE severity = 'CRITICAL') AS c, count(*) FILTER (WHERE severity = 'HIGH') AS h FROM i GROUP BY 1),
b AS (SELECT record, round(s, 6) AS score, CASE WHEN c > 0 OR s > 75 THEN 'CRITICAL' WHEN h > 0 OR s > 50 THEN 'HIGH' WHEN s > 25 THEN 'MEDIUM' ELSE 'INFO' END AS band FROM g) SELECT record, score, band, band IN ('CRITICAL', 'HIGH') AS tampered FROM b ORDER BY score DESC, record LIMIT 500"""


def weighted_scores(spark, sf_dir):
    """The 500 records with the highest weighted scores."""
    f = _files(spark, sf_dir)
    row = lambda cond, s, c, w: F.when(F.expr(cond), F.struct(F.lit(s).alias("severity"), F.lit(c).alias("confidence"), F.lit(w).alias("weight")))
    rows = F.array(row("modified_us < created_us + 864000000000", "CRITICAL", 0.95, 1.5), row("fn_created_us > created_us", "HIGH", 0.7, 1.2), row("dir % 3 = 0", "LOW", 0.5, 1.0))
    i = f.select("record", F.inline(rows)).filter("severity is not null").repartition(sized.parts(Q._journal(spark, sf_dir)), "record")
    return U.ranked(U.weighted_scores(i).withColumn("score", F.round("score", 6)))


_TRACED = {"shadow_copy": "vssadmin\\s+delete|shadowcopy\\s+delete|wbadmin\\s+delete", "log_clearing": "wevtutil\\s+cl|clear-eventlog|\\b(1102|104)\\b.*clear", "registry": "reg\\s+delete|DisablePrefetch|NtfsDisableLastAccessUpdate", "deletion": "sdelete|cipher\\s+/w|shred\\s|eraser", "timeline": "timestomp|SetFileTime|touch\\s+-[dt]", "mft": "[$]MFT.*(anomal|mismatch|zero)", "hidden_stream": "[^\\s:\\\\]+\\.\\w+:[^\\s:\\\\/]+(:[$]DATA)?$"}
_COMMANDS = ("vssadmin delete shadows", "wevtutil cl Security", "reg delete HKLM", "sdelete a.doc", "timestomp a.exe", "$MFT entry zero", "notes.txt:hidden", "dir", "event 1102 was clear", "copy a b")
ORACLES["trace_summary"] = f"""WITH t AS (SELECT ([{', '.join(f"'{c}'" for c in _COMMANDS)}])[event_id % 10 + 1] AS line FROM events)
SELECT {', '.join(f"count(*) FILTER (WHERE regexp_matches(line, '{p}', 'i')) AS {k}" for k, p in _TRACED.items())}, ({' + '.join(f"count(*) FILTER (WHERE regexp_matches(line, '{p}', 'i'))" for p in _TRACED.values())}) AS total, 'HIGH' AS risk FROM t"""


def trace_summary(spark, sf_dir):
    """Traces of hiding in commands that are dealt to the events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.element_at(F.array(*map(F.lit, _COMMANDS)), (F.pmod("event_id", F.lit(10)) + 1).cast("int"))
    return U.trace_summary(U.traces(e.select(line.alias("line")), "line"))


_WORDS = " ".join(f"WHEN {' OR '.join(f'contains(n, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{k}'" for k, ws in U.TRIAGE)
ORACLES["artefact_triage"] = f"""WITH a AS (SELECT lower(p_name || CASE p_partkey % 4 WHEN 0 THEN ' Security.evtx' WHEN 1 THEN ' Amcache.hve' WHEN 2 THEN ' none' ELSE '' END) AS n, p_partkey FROM part) SELECT CASE {_WORDS} ELSE 'standard' END AS importance, count(*) AS n FROM a GROUP BY 1"""


def artefact_triage(spark, sf_dir):
    k = F.col("p_partkey") % 4
    name = F.concat("p_name", F.when(k == 0, " Security.evtx").when(k == 1, " Amcache.hve").when(k == 2, " none").otherwise(""))
    return U.named(spark.read.parquet(f"{sf_dir}/part.parquet").select(name.alias("name"))).groupBy(U.triage(F.col("name")).alias("importance")).agg(F.count("*").alias("n"))


def _entry(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(entries(spark, sf_dir))
        ORACLES[f.__name__] = SQL + sql
        return f

    return add


@_entry(" SELECT id, ip, attack_type AS found, CASE WHEN attack_type IS NOT NULL THEN confidence END AS sure FROM e")
def attacks_on_entries(e):
    """Every entry with the fields of its attack."""
    found = e.filter("attack_type is not null").select("id", F.col("attack_type").alias("found"), F.col("confidence").alias("sure"))
    return C.with_attacks(e.select("id", "ip"), found)


_SETS = """, a AS (SELECT ip AS chain, id FROM e WHERE attack_type IS NOT NULL), b AS (SELECT "user" AS chain, id FROM e WHERE is_anomaly) """


@_entry(_SETS + "SELECT chain, count(*) AS events FROM b GROUP BY 1 HAVING count(*) FILTER (WHERE id IN (SELECT id FROM a)) = 0")
def chains_without_overlap(e):
    """Chains of a user's anomalies that share no event with an ip's attacks."""
    chain = lambda of, key: of.groupBy(F.col(key).alias("chain")).agg(F.collect_list("id").alias("ids"))
    return C.not_overlapping(chain(e.filter("is_anomaly"), "user"), chain(e.filter("attack_type is not null"), "ip")).select("chain", F.size("ids").cast("long").alias("events"))


@_entry(""" SELECT "user", coalesce(string_agg(DISTINCT ip, ',' ORDER BY ip) FILTER (WHERE outcome IN ('failure', 'success')), '') AS ips FROM e GROUP BY 1""")
def ips_of_users(e):
    return C.ips_of_user(e).select("user", F.concat_ws(",", "ips").alias("ips"))


@_entry(""" SELECT id, "user" FROM e ORDER BY lower("user") DESC, id LIMIT 200""")
def sorted_by_column(e):
    return C.sorted_by(e, "user", True).select("id", "user").limit(200)


@_entry(""", k AS (SELECT ip, round(0.75 + 0.02 * least(count(*), 10), 2)::DOUBLE AS confidence FROM e WHERE attack_type IS NOT NULL GROUP BY ip), c AS (SELECT count(*) AS chains, least(coalesce(sum(confidence), 0), 1)::DOUBLE AS threat_score FROM k),
n AS (SELECT count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'error') AS errors FROM e) SELECT *, least(20 * chains + 10 * critical + 5 * errors, 100)::BIGINT AS risk FROM c, n""")
def chain_risk_summary(e):
    k = e.filter("attack_type is not null").groupBy("ip").agg(F.round(0.75 + 0.02 * F.least(F.count("*"), F.lit(10)), 2).alias("confidence"))
    return C.window_summary(k, e)


@_entry(""", f AS (SELECT id, CASE WHEN port % 4 = 0 THEN 'safe' WHEN port % 4 = 1 THEN 'attack_pattern' WHEN port % 4 = 2 THEN 'maybe' END AS label FROM e) SELECT label, count(*) AS n FROM f WHERE label IN ('safe', 'unsafe', 'attack_pattern') GROUP BY 1""")
def valid_feedback(e):
    k = F.col("port") % 4
    f = e.select("id", F.when(k == 0, "safe").when(k == 1, "attack_pattern").when(k == 2, "maybe").alias("label"))
    return C.valid_labels(f).groupBy("label").agg(F.count("*").alias("n"))


QUERIES |= {"clock_rollbacks": clock_rollbacks, "weighted_scores": weighted_scores, "trace_summary": trace_summary, "artefact_triage": artefact_triage}
