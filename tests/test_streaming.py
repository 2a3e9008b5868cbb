"""Streams give what the batch operators give on the same rows."""

from pyspark.sql import functions as F

from emberlog.plans.entries import entries
from emberlog.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def _stream(spark, tmp_path, columns):
    e = entries(spark, SF).select(*columns)
    e.repartition(1).write.parquet(str(tmp_path / "in"))
    return e, spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))


def _run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_minute_counts_equal_batch(spark, tmp_path):
    e, s = _stream(spark, tmp_path, ["event_ts", "outcome"])
    got = {(r.minute, r.n) for r in _run(J.minute_counts(s), "minutes", "complete", tmp_path).collect()}
    want = {(r.m, r.n) for r in e.groupBy(F.date_trunc("minute", "event_ts").alias("m")).agg(F.count("*").alias("n")).collect()}
    assert got == want
