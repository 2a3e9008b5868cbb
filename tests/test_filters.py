"""Filters, requests and labels at their edges."""

import pytest
from pyspark.sql import functions as F

from emberlog.operators import filters as L
from emberlog.operators import labels as B
from emberlog.operators.engine import Engine
from emberlog.plans.entries import entries

SF = "/root/testdata/sf0.001"


def test_filter_operations(spark):
    df = spark.createDataFrame([("Ab", "5"), ("abc", "x"), (None, "7")], "a string, n string")
    n = lambda *f: L.apply_filters(df, [L.Filter(*x) for x in f]).count()
    assert n(("a", "equals", "AB")) == 1 and n(("a", "startsWith", "ab")) == 2 and n(("a", "endsWith", "C")) == 1
    assert n(("n", "greaterThan", 4)) == 2 and n(("n", "lessThan", 6)) == 1 and n(("n", "greaterThan", 4), ("a", "contains", "b")) == 1
    with pytest.raises(ValueError):
        L.Filter("a", "like", "x").condition()


def test_requests(spark):
    assert L.criteria("failed critical brute force from 10.1.2.3 by user bob") == [
        L.Filter("ip", "equals", "10.1.2.3"), L.Filter("attack_type", "equals", "bruteforce"), L.Filter("severity", "equals", "critical"), L.Filter("user", "equals", "bob"), L.Filter("outcome", "equals", "failure"),
    ]
    e = Engine(entries(spark, SF))
    assert e.ask("show top ips").columns[0] == "ip"
    assert e.ask("any alerts?").columns == ["rule", "ip", "evidence"]
    assert e.ask("failed sign-ins").filter("outcome <> 'failure'").count() == 0
    assert e.entries(severity="error", limit=5).count() == 5


def test_labels(spark):
    rows = [("Failed password for root", "bruteforce"), ("id=1 UNION  SELECT x", "sql_injection"), ("<script>alert(1)</script>", "xss_attack"), ("[SPAM] offer", "spam_activity"), ("hello", "safe")]
    kind, conf = B.attack_label(F.col("t"))
    for r in spark.createDataFrame(rows, "t string, want string").select("*", kind.alias("k"), conf.alias("c")).collect():
        assert r.k == r.want and (r.c > 0) == (r.want != "safe")
    kv = spark.createDataFrame([('A=1 b="two words" a=3',)], "t string").select(B.key_values(F.col("t")).alias("m")).first().m
    assert kv == {"a": "1", "b": "two words"}
