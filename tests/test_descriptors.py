"""Nested descriptors against a recursive reading; journals as text, training rows, reports, requests."""

import random

from pyspark.sql import functions as F

from emberlog.operators import descriptors as D
from emberlog.operators import filters as L
from emberlog.operators import forensic, rules
from emberlog.operators.engine import Engine
from emberlog.sources import lines as S


def _nested(rng, path, out):
    name = rng.choice("ABCD") + str(rng.randrange(9))
    if len(path) < 4 and rng.random() < 0.6:
        return f"({name}=" + "".join(_nested(rng, [*path, name.lower()], out) for _ in range(rng.randrange(1, 4))) + ")"
    value = str(rng.randrange(99)) + rng.choice(["", ".x", " y"])
    out.setdefault(".".join([*path, name.lower()]), value)
    return f"({name}={value})"


def test_descriptors_equal_a_recursive_reading(spark):
    rng, rows = random.Random(4), []
    for i in range(60):
        want = {}
        text = " * ".join(_nested(rng, [], want) for _ in range(rng.randrange(1, 4)))
        rows.append((i, f"x * {text} * done", want))
    odd = [(100, "a)b(C=1))(D=2", {"c": "1"}), (101, "", {}), (102, "no brackets=1", {}), (103, "(A=)(B=(C=1)", {"b.c": "1"}), (104, None, None)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows + odd], "i int, t string")
    got = {r.i: r.d for r in df.select("i", D.descriptor(F.col("t")).alias("d")).collect()}
    assert got == {i: w for i, _, w in rows + odd}


def test_listener(spark):
    line = "01-JAN-2026 00:00:06 * (CONNECT_DATA=(SERVICE_NAME=crmdb)(CID=(PROGRAM=app)(HOST=h1)(USER=bo))) * (ADDRESS=(PROTOCOL=tcp)(HOST=198.18.0.1)(PORT=12169)) * establish * crmdb * 0"
    got = [r[0] for r in spark.createDataFrame([(line,), ("x",)], "t string").select(D.listener(F.col("t"))).collect()]
    assert got == [{"timestamp": "01-JAN-2026 00:00:06", "protocol": "tcp", "host": "198.18.0.1", "port": "12169", "service_name": "crmdb", "cid_program": "app", "cid_host": "h1", "cid_user": "bo", "action": "establish", "service": "crmdb", "result": "0"}, None]


def test_journals_as_text_and_training_rows(spark, tmp_path):
    rows = ["==== 2024-01-01 00:00:00", "No USN 2024-01-01 00:00:00", "  ", "made a.txt 2024-01-01  10:00:00 FILE_CREATE", "no time"]
    lines = spark.createDataFrame([("j", i, x) for i, x in enumerate(rows)], "source string, line_no long, line string")
    assert [(r.source, r.timestamp, r.line) for r in S.journal_text(lines).collect()] == [("j", "2024-01-01  10:00:00", rows[3])]
    (tmp_path / "t.csv").write_text("dur, Spkts,attack_cat\n1.5,2,Fuzzers \nx,Infinity,\n,3, normal\n2,NaN,odd\n")
    got = S.training_rows(spark, str(tmp_path / "t.csv"), ("dur", "spkts", "none"), names={"fuzzers": "fuzzing"})
    assert got.columns == ["dur", "spkts", "attack_type"]
    assert [tuple(r) for r in got.collect()] == [(1.5, 2.0, "fuzzing"), (0.0, 0.0, "normal"), (0.0, 3.0, "normal"), (2.0, 0.0, "other")]


def test_rules_and_reports(spark, tmp_path):
    day = rules.DAY
    files = spark.createDataFrame([(1, "A.exe", 90 * day, 5, 90 * day, 5 + 2 * day), (2, "b.exe", 95 * day, 5, 95 * day + 2_000_000, None), (3, "c.exe", 70 * day, 0, 70 * day, 0), (4, "d.exe", 100 * day, 0, 100 * day, 0)], "record long, name string, created_us long, modified_us long, fn_created_us long, fn_modified_us long")
    found = forensic.standard_vs_name(files)
    assert {(r.record, r.severity, r.points) for r in found.collect()} == {(1, "HIGH", 30), (2, "MEDIUM", 15)}
    prefetch = spark.createDataFrame([("A.EXE-1234.pf",)], "name string")
    more = rules.prefetch_missing(files, prefetch, 100 * day + 5)
    assert {(r.record, r.severity, r.points) for r in more.collect()} == {(2, "LOW", 10)}
    every = found.unionByName(more)
    S.write_report(every, str(tmp_path / "r.txt"), "txt", "Times")
    text = "".join(p.read_text() for p in sorted((tmp_path / "r.txt").glob("part-*")))
    assert text.splitlines() == ["Times", "=====", "[HIGH] record 1: standard_vs_name (30 points)", "[MEDIUM] record 2: standard_vs_name (15 points)", "[LOW] record 2: prefetch_missing (10 points)"]
    S.write_report(every, str(tmp_path / "r.json"), "json")
    assert spark.read.json(str(tmp_path / "r.json")).count() == 3


def test_requests_over_parsed_lines(spark):
    assert L.criteria("latest apache attacks", 7_200_000_000) == [L.Filter("attack_type", "notEquals", "normal"), L.Filter("log_type", "contains", "apache"), L.Filter("us", "greaterThan", 3_600_000_000)]
    sys = "Mar  3 07:08:{:02d} db3 sshd[610]: Failed password for {} from 198.18.0.2 port 4000 ssh2"
    rows = [("s", i, sys.format(i, u)) for i, u in enumerate(("olga", "bo", "ines"))] + [("t", 0, "id=1 UNION SELECT x from 198.18.0.3"), ("t", 1, "quiet")]
    e = Engine.parse(spark.createDataFrame(rows, "source string, line_no long, line string"), F.lit("2025-12-01").cast("timestamp"))
    assert {(r.attack_type, round(r.confidence, 2)) for r in e.ask("predictions please").collect()} == {("bruteforce", 0.85), ("sql_injection", 0.95)}
    (c,) = e.correlate().collect()
    assert (c.ip, c.attacks, c.kinds) == ("198.18.0.2", 3, ["bruteforce"])
    (a,) = e.analyze(sys.format(9, "kim")).collect()
    assert (a.log_type, a.user, a.attack_type, a.ip) == ("Linux SSHD Failed", "kim", "bruteforce", "198.18.0.2")
    rows, counts = L.counted(e.data, [L.Filter("ip", "equals", "198.18.0.2")], 2)
    assert rows.count() == 2 and tuple(counts.first()) == (5, 3)
