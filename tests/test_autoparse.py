"""Parsing by families, records of several lines, JSON lines and fields of unknown lines."""

import json

from pyspark.sql import functions as F

from emberlog.operators import autoparse as A

LINES = {
    "ssh": ("Linux SSHD Failed", ["Mar  3 07:08:09 db sshd[1]: Failed password for invalid user olga from 198.18.0.2 port 4 ssh2", "Mar  3 07:08:09 db sshd[1]: Accepted publickey for ines from 198.18.0.2 port 4", "odd"]),
    "sys": ("Linux Syslog", ["Mar  3 07:08:09 db cron[1]: an Error and warning", "Mar  3 07:08:10 db kernel: link up", '{"time":"2025-03-03T07:08:09Z","level":"warn","user":"bo","status":"ok","source_ip":"","sourceIp":"198.18.0.8","n":{"a":[1]}}', "[1]"]),
    "web": ("Apache", ['198.18.0.9 - - [03/Mar/2025:07:08:09 +0000] "503 12', '198.18.0.9 - - [03/Mar/2025:07:08:09 +0000] "GET / HTTP/1.1" 200 1']),
    "fw": ("iptables", ["Mar  3 07:08:09 gw kernel: IPTABLES-DROP: SRC=198.18.0.2 DST=198.18.0.9", "SRC=1.1.1.1 DST=2.2.2.2 ACCEPT"]),
    "view": ("Windows Event Viewer", ["Audit Failure 03-04-2025 07:08:09 logon", "Error 03-04-2025 07:08:09 disk"]),
    "sec": ("Windows Security CSV", ["TimeCreated,EventID,a,b,c,d", "2025-03-03 07:08:09,4625,Audit Failure,Security,PC7,logon failed,olga,3,198.18.0.9", "a,b,c"]),
    "app": ("Windows Application CSV", ["2025-03-03 07:08:09,1000,Warning,Application,PC7,Hang,stopped", "2025-03-03 07:08:09,4,Error,Security,PC7,text,kim,2,198.18.0.4"]),
    "slow": ("MySQL Slow Query", ["# Time: 2025-03-03T07:08:09Z", "# User@Host: olga[olga] @ db1 [198.18.0.5]", "# Query_time: 2.5  Lock_time: 0 Rows_sent: 1  Rows_examined: 99", "select 1", "from t;", "", "# Time: 2025-03-03T07:08:10Z", "nothing"]),
    "ora": ("Oracle Alert", ["before", "Mon Mar 03 07:08:09 2025", "ORA-00600: internal", "more", "Mon Mar 03 07:08:10 2025", "a warning"]),
    "aud": ("Oracle Audit", ["TIMESTAMP: 2025-03-03T07:08:09 ACTION: 'DROP ' DATABASE USER: 'sys'", "x"]),
    "odd": ("Custom / Raw", ["free text " + "y" * 2000, "  "]),
}
#: The text behind the block's first line, its comments too.
SQL = "\n".join(LINES["slow"][1][1:5])[:-1]
NOTHING = dict.fromkeys(("source_ip", "hostname", "destination_ip", "user", "action", "outcome"))
WANT = {
    ("ssh", 0): {"source_ip": "198.18.0.2", "hostname": "db", "user": "olga", "action": "login", "outcome": "failure", "severity": "warning"},
    ("ssh", 1): {"source_ip": "198.18.0.2", "hostname": "db", "user": "ines", "action": "login", "outcome": "success", "severity": "info"},
    ("sys", 0): {"hostname": "db", "severity": "error", "message": "an Error and warning"},
    ("sys", 1): {"hostname": "db", "severity": "info", "message": "link up"},
    ("sys", 2): {"source_ip": "198.18.0.8", "user": "bo", "outcome": "ok", "severity": "warn"},
    ("web", 0): {"source_ip": "198.18.0.9", "severity": "error"},
    ("fw", 0): {"source_ip": "198.18.0.2", "destination_ip": "198.18.0.9", "action": "firewall_block", "outcome": "blocked", "severity": "warning"},
    ("fw", 1): {"source_ip": "1.1.1.1", "destination_ip": "2.2.2.2", "action": "firewall_allow", "outcome": "allowed", "severity": "info"},
    ("view", 0): {"severity": "warning", "message": "logon"},
    ("view", 1): {"severity": "error", "message": "disk"},
    ("sec", 1): {"user": "olga", "source_ip": "198.18.0.9", "severity": "error", "message": "logon failed"},
    ("app", 0): {"severity": "warning", "message": "stopped"},
    ("app", 1): {"user": "kim", "source_ip": "198.18.0.4", "severity": "error", "message": "text"},
    ("slow", 0): {"hostname": "db1", "source_ip": "198.18.0.5", "user": "olga", "severity": "warning", "message": f"Slow query: {SQL}"},
    ("ora", 1): {"severity": "error", "message": "ORA-00600: internal\nmore"},
    ("ora", 4): {"severity": "warning", "message": "a warning"},
    ("aud", 0): {"user": "sys", "action": "DROP", "severity": "info", "message": "Oracle audit: DROP by sys"},
}
FIELDS = {
    ("sec", 1): {"event_id": "4625", "level": "audit failure", "log_name": "Security", "machine_name": "PC7", "logon_type": "3"},
    ("app", 0): {"event_id": "1000", "level": "warning", "log_name": "Application", "machine_name": "PC7", "provider_name": "Hang"},
    ("slow", 0): {"user": "olga", "host": "db1", "ip": "198.18.0.5", "query_time": "2.5", "rows_examined": "99", "sql": SQL},
    ("ora", 1): {"error_code": "00600", "error_message": "internal", "full_message": "ORA-00600: internal\nmore"},
    ("aud", 0): {"action": "DROP", "user": "sys"},
    ("sys", 2): json.loads(LINES["sys"][1][2]),
    ("odd", 0): {},
}
FAILED = {("ssh", 2): 1, ("sys", 3): 1, ("web", 1): 1, ("sec", 0): 1, ("sec", 2): 1, ("slow", 6): 2, ("aud", 1): 1, ("odd", 0): 1}


def _frames(spark):
    lines = spark.createDataFrame([(s, i, x) for s, (_, rows) in LINES.items() for i, x in enumerate(rows)], "source string, line_no long, line string")
    return lines, spark.createDataFrame([(s, t) for s, (t, _) in LINES.items()], "source string, log_type string")


def test_every_family(spark):
    lines, types = _frames(spark)
    out = A.auto_parse(lines, types, F.lit("2025-12-01").cast("timestamp"))
    got = {(r.source, r.line_no): r for r in out.withColumn("fields", F.to_json("fields")).collect()}
    assert {k for k, r in got.items() if r.parsed} == set(WANT)
    assert {k: r.lines for k, r in got.items() if not r.parsed} == FAILED
    for k, want in WANT.items():
        row = got[k].asDict()
        assert {c: row[c] for c in (*NOTHING, *want)} == NOTHING | want, k
        assert k[0] == "fw" and k[1] == 1 or str(row["event_ts"])[:11] in ("2025-03-03 ", "2025-03-04 ", "2025-04-03 "), k
    for k, want in FIELDS.items():
        assert json.loads(got[k].fields) == want
    assert len(got["odd", 0].message) == 1000 and got["odd", 0].log_type == "Custom / Raw"
    schema = {r.source: r.schema for r in A.field_schemas(out).collect()}
    assert "sourceIp: STRING" in schema["sys"] and "n: OBJECT<a: ARRAY<BIGINT>>" in schema["sys"]
    stats = {r.source: (r.total_lines, r.failed_lines, r.success_rate) for r in A.parse_stats(out, lines).collect()}
    assert stats["ssh"] == (3, 1, 67) and stats["slow"] == (8, 2, 75) and stats["odd"] == (2, 1, 50) and stats["fw"] == (2, 0, 100)


def test_fields_of_unknown_lines(spark):
    rows = [("a", 'src_ip="198.18.0.2" dst_port: 44 user="olga" WARN at 2025-03-03 07:08:09'), ("b", "198.18.0.7 port=22 fatal critical"), ("c", "03/Mar/2025:07:08 username: \"bo b\" error"), ("d", "nothing")]
    f = A.dynamic_fields(F.col("line"))
    got = {r.k: (r.f, r.s) for r in spark.createDataFrame(rows, "k string, line string").select("k", f.alias("f"), A.dynamic_severity(f).alias("s")).collect()}
    assert got["a"] == ({"timestamp": "2025-03-03 07:08:09", "ip": "198.18.0.2", "port": "44", "user": "olga", "severity": "WARN"}, "unknown")
    assert got["b"] == ({"ip": "198.18.0.7", "port": "22", "severity": "fatal"}, "unknown")
    assert got["c"] == ({"timestamp": "03/Mar/2025:07:08", "user": "bo b", "severity": "error"}, "error") and got["d"] == ({}, "unknown")
