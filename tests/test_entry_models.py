"""Entry features, anomalies by a share, forests and their measures against plain Python."""

import math
import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from emberlog.operators import models as M

ENTRIES = "id long, event_ts timestamp, log_type string, severity string, action string, outcome string, fields map<string,string>, message string, port long"
STOP = ["the", "of"]


def _entries():
    rng = random.Random(5)
    words = "the of login failed user port scan é22 x denied access".split()
    rows = []
    for i in range(60):
        text = None if i == 3 else " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))
        fields = {"status": rng.choice(["200", "4.5", "-1", "x", ""]), "bytes": "1.2.3"} if i % 3 else {}
        rows.append((i, datetime(2024, 1, 1 + i % 9, i % 24) if i % 7 else None, rng.choice(["apache", "SSH", None]), "info", rng.choice(["get", "got", "a", "b", None]), "success", fields, text, 22 if i % 2 else None))
    return rows


def _words(text):
    import re

    return re.findall(r"\w\w+", (text or "").lower())


def test_entry_features(spark):
    rows = _entries()
    df = spark.createDataFrame(rows, ENTRIES)
    of = M.vocabulary(df, most=5, stop=STOP)
    total = Counter(w for r in rows for w in _words(r[7]) if w not in STOP)
    terms = sorted(sorted(total, key=lambda w: (-total[w], w))[:5])
    idf = {t: math.log((1 + len(rows)) / (1 + sum(t in _words(r[7]) for r in rows))) + 1 for t in terms}
    assert of.terms == terms and all(math.isclose(a, idf[t]) for a, t in zip(of.idf, terms))
    got = {r.id: r for r in M.entry_features(df, of).collect()}
    kinds = {c: sorted({(r[2 + i] or "unknown").lower() for r in rows}) for i, c in enumerate(M.CATEGORIES)}
    for r in rows:
        g, text = got[r[0]], r[7] or ""
        assert (g.hour, g.day_of_week) == ((r[1].hour, r[1].weekday()) if r[1] else (0, 0))
        assert [g[c] for c in M.CATEGORIES] == [kinds[c].index((r[2 + i] or "unknown").lower()) for i, c in enumerate(M.CATEGORIES)]
        assert (g.status, g.bytes, g.port, g.src_port) == ({"200": 200.0, "4.5": 4.5}.get(r[6].get("status"), 0.0), 0.0, float(r[8] or 0), 0.0)
        share = [n / len(text) for n in Counter(text).values()]
        assert g.msg_len == len(text) and math.isclose(g.msg_entropy, -sum(p * math.log2(p) for p in share), abs_tol=1e-9)
        counts = Counter(w for w in _words(text) if w in terms)
        length = math.sqrt(sum((n * idf[w]) ** 2 for w, n in counts.items()))
        assert {i: round(v, 9) for i, v in g.terms.items()} == {terms.index(w): round(n * idf[w] / length, 9) for w, n in counts.items()}
    assert M.vocabulary(df.limit(0), stop=STOP).terms == [] and len(M.stop_words(df)) > 100


def test_ordinals(spark):
    values = ["b", "a", "aa", "aab", "ab", "é", "", "zz", None, "aab"]
    got = {r.value: r.ordinal for r in M.ordinals(spark.createDataFrame([(v,) for v in values], "v string"), "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted({v for v in values if v is not None}, key=lambda v: v.encode()))}


def test_anomalies_are_the_given_share(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(950)] + [(950 + i, rng.uniform(8, 20), rng.uniform(-20, -8)) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    out = M.anomalies(df, "id", ["a", "b"], 0.05).collect()
    hits = {r.id for r in out if r.anomaly}
    assert 45 <= len(hits) <= 50 and sum(i >= 950 for i in hits) >= 45
    low = min(r.anomaly_score for r in out if r.anomaly)
    assert all(r.anomaly == (r.anomaly_score >= low) for r in out) and all((r.confidence > 0.5) == r.anomaly or math.isclose(r.confidence, 0.5) for r in out)
    assert not any(r.anomaly for r in M.anomalies(df.limit(9), "id", ["a", "b"], 0.5).collect())
    assert M.anomalies(df.limit(0), "id", ["a", "b"]).collect() == []


def test_combined(spark):
    e = spark.createDataFrame([(i,) for i in range(5)], "id long")
    labels = spark.createDataFrame([(0, "xss", 0.9), (1, "xss", 0.2), (2, "safe", 0.9), (3, "scan", 0.3)], "id long, attack_type string, confidence double")
    found = spark.createDataFrame([(0, True, 0.6), (1, True, 0.7), (4, False, 0.4)], "id long, anomaly boolean, confidence double")
    assert {tuple(r) for r in M.combined(e, labels, found).collect()} == {(0, "xss", 0.9, True, 0.6), (1, "anomaly", 0.7, True, 0.7), (3, "scan", 0.3, False, None)}


def test_measures(spark):
    rng = random.Random(9)
    rows = [(rng.choice("abcd"), rng.choice("abce")) for _ in range(200)]
    table = M.confusion(spark.createDataFrame(rows, "label string, prediction string"))
    of = {}
    for c in "abcde":
        hits, said, have = sum(a == b == c for a, b in rows), sum(b == c for _, b in rows), sum(a == c for a, _ in rows)
        p, r = hits / said if said else 0, hits / have if have else 0
        of[c] = (p, r, 2 * p * r / (p + r) if p + r else 0, have)
    got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in M.class_report(table).collect()}
    assert set(got) == set(of) and all(math.isclose(x, y) for c in of for x, y in zip(got[c], of[c]))
    m = M.measures(table).first()
    assert m.rows == 200 and math.isclose(m.accuracy, sum(a == b for a, b in rows) / 200) and math.isclose(m.weighted_f1, sum(f * n for _, _, f, n in of.values()) / 200)
    assert M.measures(table.limit(0)).first().accuracy is None


def test_forest(spark):
    rng = random.Random(3)
    rows = [(i, k, (0.0 if k == "a" else 4.0 if k == "b" else 8.0) + rng.gauss(0, 0.7), rng.gauss(0, 1)) for i in range(600) for k in [rng.choice("aaaabbc")]]
    df = spark.createDataFrame(rows, "id long, kind string, x double, y double")
    split = M.stratified(df, "kind", "id").groupBy("kind").agg(F.avg(F.col("held_out").cast("int")).alias("s"), F.count("*").alias("n")).collect()
    assert all(abs(r.s - 0.2) <= 1.5 / r.n for r in split)
    got = M.train_forest(df, ["x", "y"], "kind", "id", folds=2, trees=10, depth=5)
    assert got.test_accuracy > 0.95 and got.weighted_f1 > 0.95 and len(got.fold_accuracy) == 2 and min(got.fold_accuracy) > 0.95
    again = {r.kind: r.predicted for r in got.model.transform(df).filter("id < 50").collect()}
    assert set(again) == {"a", "b", "c"}


ATTACKS = "message string, raw string, ip string, severity string, outcome string, user string, action string"


def test_attack_features(spark):
    from emberlog.operators import features as T

    rows = [
        ("x", "GET /a?id=1' OR '1'='1 union  select a -- ", "203.0.113.5", "error", "404", "", "view"),
        ("<script>alert(1)</script> onload=x document.cookie", None, "172.20.0.1", "info", "success", "bo", "Login"),
        ("; cat /etc/passwd | ls $(id) `x` ../../ /proc/ /var/", "", "10.0.0.1", "debug", "failure", "root", None),
        (None, None, None, None, None, None, None),
        ("Password token secret key auth port 22 198.18.0.1:443 ?file=http://x a='b'", None, "192.168.0.1", "critical", "500x", "kim", "a"),
    ]
    df = spark.createDataFrame(rows, ATTACKS)
    got = [r.asDict() for r in df.select(*T.attack_features(*(F.col(c.split()[0]) for c in ATTACKS.split(", ")))).collect()]
    assert list(got[0]) == list(T.ATTACK_FEATURES) and len(got[0]) == 25
    some = [
        {"external": 1.0, "sql": 1.0, "http": 1.0, "failure": 1.0, "severe": 1.0, "anonymous": 1.0, "single_quote": 1.0, "quoted_value": 1.0, "double_dash": 1.0, "login": 0.0, "script": 0.0},
        {"external": 0.0, "script": 1.0, "angle_brackets": 1.0, "login": 1.0, "failure": 0.0, "anonymous": 0.0, "severe": 0.0, "http": 0.0},
        {"external": 0.0, "command": 1.0, "traversal": 1.0, "system_files": 1.0, "semicolon": 1.0, "pipe": 1.0, "backtick": 1.0, "failure": 1.0, "anonymous": 1.0},
        dict.fromkeys(T.ATTACK_FEATURES, 0.0) | {"external": 1.0, "anonymous": 1.0},
        {"sensitive": 1.0, "login": 1.0, "port_in_text": 1.0, "ip_in_text": 1.0, "connection": 1.0, "inclusion": 1 / 3, "severe": 1.0, "failure": 0.0, "quoted_value": 1.0},
    ]
    for row, want in zip(got, some):
        assert {k: row[k] for k in want} == pytest.approx(want)
    assert got[0]["length"] == pytest.approx(len(rows[0][1]) / 500)


def test_anomaly_features(spark):
    from emberlog.operators import features as T

    rows = [("a", "b", "m" * 2500, "error", datetime(2024, 1, 3, 6), {"x": "1"}), ("a", None, None, "odd", None, None)]
    df = spark.createDataFrame(rows, "ip string, user string, message string, severity string, ts timestamp, fields map<string,string>")
    c = [F.col(x) for x in ("ip", "user", "message", "severity", "ts")]
    a, b = df.select(*T.anomaly_features(*c)).collect()
    assert a.ip == b.ip and 0 <= a.ip < 1 and b.user == 0.0 and (a.length, a.severity, a.hour) == (1.0, 0.75, 0.25) and a.weekday == pytest.approx(2 / 7)
    assert (b.length, b.severity, b.hour, b.weekday) == (0.0, 0.25, 0.5, 0.5)
    a, b = df.select(*T.anomaly_features(*c, F.col("fields"))).collect()
    assert (a.length, a.severity, a.fields, b.fields) == (2.5, 3.0, 0.1, 0.0)
