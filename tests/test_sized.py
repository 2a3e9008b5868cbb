"""Scores of records: one pass over the records, partitions in step with the rows, odd keys."""

import pytest
from pyspark.sql import functions as F

from emberlog.operators import artefacts, detect, forensic, sized
from emberlog.plans import forensic_queries, log_queries, rule_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["tamper_scores", "weighted_scores", "multi_source_presence", "artefact_votes"])
def test_partitions_grow_with_the_rows(spark, monkeypatch, name):
    monkeypatch.setattr(sized, "ROWS", 100)
    monkeypatch.setattr(sized, "SMALL", 10)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    plan = (forensic_queries.QUERIES | rule_queries.QUERIES)[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    n = -(-rows // 100)
    assert f", {n}), REPARTITION_BY_NUM" in plan and "hashpartitioning(record" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert not [p for p in plan.split("hashpartitioning(record")[1:] if not p.split(")")[0].endswith(f" {n}")]


def test_the_records_are_read_once(spark):
    files = spark.createDataFrame([(i, i * 10**12, i * 10**12 - 3_600_000_000, i * 10**12 + i * 2_000_000) for i in range(10)], "record long, created_us long, modified_us long, fn_created_us long")
    four = forensic.standard_vs_name(files).unionByName(forensic.odd_times(files, 5 * 10**12)).unionByName(forensic.order_anomaly(files)).unionByName(forensic.round_delta(files))
    one = forensic.time_indicators(files, 5 * 10**12)
    assert sorted(one.collect()) == sorted(four.collect()) and one.count() == 39
    few = files.limit(9)
    assert not one.filter("rule = 'round_delta'").isEmpty() and forensic.time_indicators(few, 5 * 10**12).filter("rule = 'round_delta'").isEmpty()


def test_sources_of_odd_keys(spark):
    base = spark.createDataFrame([(1, 5), (1, 0), (1, 0), (2, 0), (3, None), (None, 9)], "record long, gap long")
    other = spark.createDataFrame([(1,), (1,), (None,), (7,)], "record long")
    got = artefacts.votes(base, {"gap": (F.col("gap") > 0, 4), "other": (other, 2)}).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 6, "strong")] * 3 + [(2, 0, "none"), (3, 0, "none"), (None, 0, "none")], key=str)
    found = forensic.presence(base, {"gap": F.col("gap") > 0, "other": other}, "record", 2)
    assert found.collect() == [(1, 2)]
    same = forensic.presence(base, {"gap": base.filter("gap > 0"), "other": other}, "record", 2)
    assert same.collect() == found.collect()


def test_rows_of_a_key_come_back_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(artefacts, "AT_ONCE", 4)
    base = spark.range(10).select(F.lit(1).alias("record"))
    assert artefacts.votes(base, {"all": (F.lit(True), 1)}).count() == 10


def test_lines_of_a_source_are_not_brought_together(spark):
    lines = log_queries.lines(spark, SF)
    types = lines.select("source").distinct().withColumn("log_type", F.col("source"))
    plan = detect.parse(lines, types)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "RoundRobinPartitioning" in plan


def test_one_search_gives_the_groups(spark):
    spec = next(p for p in detect.PARSERS if p.label == "Dovecot")
    line = "Jan  2 03:04:05 mx dovecot: imap-login: Login: user=<ines>, rip=10.0.0.1, done"
    rows = [(line,), (line.replace("done", "a\x1fb"),), (line + "\nmore\n",), (line.replace("10.0.0.1", "10.0.0.1, lip=10.0.0.2") + "$1\\2",), ("none",), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "line string").select(detect.fields_of(F.col("line"), spec)).collect()]
    assert [g and (g["user"], g["remote_ip"], g.get("local_ip"), g["details"]) for g in got] == [
        ("ines", "10.0.0.1", None, ", done"), ("ines", "10.0.0.1", None, ", a\x1fb"), ("ines", "10.0.0.1", None, ", done"), ("ines", "10.0.0.1", "10.0.0.2", ", done$1\\2"), None, None,
    ]
