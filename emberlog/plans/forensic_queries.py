"""Forensic rules on orders and lineitem as file records: order date is creation, ship date is modification."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import artefacts as T
from emberlog.operators import forensic as R
from emberlog.operators import sized

QUERIES: dict = {}
ORACLES: dict = {}
AS_OF = 757_382_400_000_000

_SQL = """WITH f AS (SELECT l_orderkey * 8 + l_linenumber AS record, epoch_us(o_orderdate) AS created_us, epoch_us(l_shipdate) AS modified_us,
    epoch_us(o_orderdate) + CAST(l_quantity AS BIGINT) % 4 * 43200000000 AS fn_created_us, l_suppkey AS dir FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
j AS (SELECT l_orderkey * 8 + l_linenumber AS record, epoch_us(l_shipdate) - l_partkey % 90 * 86400000000 AS us, CASE WHEN l_linenumber % 2 = 1 THEN 256 ELSE 2 END AS reason, l_orderkey * 8 + l_linenumber AS reference, l_partkey AS lsn, l_suppkey AS file FROM lineitem)
"""


def _files(spark, sf_dir):
    li, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    li, o = sized.sides(li, o, "l_orderkey")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("record"), us("o_orderdate").alias("created_us"), us("l_shipdate").alias("modified_us"),
        (us("o_orderdate") + F.col("l_quantity").cast("long") % 4 * 43_200_000_000).alias("fn_created_us"), F.col("l_suppkey").alias("dir"),
    )


def _journal(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rec = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return li.select(
        rec.alias("record"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) - F.col("l_partkey") % 90 * 86_400_000_000).alias("us"), F.when(F.col("l_linenumber") % 2 == 1, 256).otherwise(2).alias("reason"),
        rec.alias("reference"), F.col("l_partkey").alias("lsn"), F.col("l_suppkey").alias("file"),
    )


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(_files(spark, sf_dir), _journal(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = _SQL + sql
        return f

    return add


_RULES = f""", r AS (
SELECT record, 'standard_vs_name' AS rule, CASE WHEN abs(created_us - fn_created_us) > 86400000000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE WHEN abs(created_us - fn_created_us) > 86400000000 THEN 30 ELSE 15 END::BIGINT AS points FROM f WHERE abs(created_us - fn_created_us) > 1000000
UNION ALL SELECT record, 'odd_times', CASE WHEN created_us > {AS_OF} THEN 'CRITICAL' WHEN created_us = 0 THEN 'HIGH' ELSE 'MEDIUM' END, CASE WHEN created_us > {AS_OF} THEN 100 WHEN created_us = 0 THEN 75 ELSE 50 END FROM f WHERE created_us > {AS_OF} OR created_us < 631152000000000
UNION ALL SELECT record, 'order_anomaly', 'MEDIUM', 25 FROM f WHERE modified_us < created_us
UNION ALL SELECT record, 'round_delta', 'MEDIUM', 50 FROM f WHERE abs(modified_us - created_us) // 1000000 IN (3600, 7200, 43200, 86400, 604800, 2592000, 31536000) AND (modified_us - created_us) % 1000000 = 0) """


@_query(_RULES + "SELECT rule, severity, count(*) AS n, sum(points)::BIGINT AS points, min(record) AS first_record FROM r GROUP BY 1, 2")
def tamper_indicators(f, j):
    return R.time_indicators(f, AS_OF).groupBy("rule", "severity").agg(F.count("*").alias("n"), F.sum("points").alias("points"), F.min("record").alias("first_record"))


@_query(_RULES + """ SELECT record, sum(points)::BIGINT AS score, count(*) AS indicators, max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END)::BIGINT AS worst,
CASE WHEN sum(points) >= 75 THEN 'CRITICAL' WHEN sum(points) >= 50 THEN 'HIGH' WHEN sum(points) >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM r GROUP BY record""")
def tamper_scores(f, j):
    return R.scores(R.time_indicators(f, AS_OF).repartition(sized.parts(j), "record"))


@_query(""", m AS (SELECT record, min(us) AS made_us FROM j WHERE reason & 256 <> 0 GROUP BY 1), x AS (SELECT f.record, made_us, created_us - made_us AS gap FROM f LEFT JOIN m ON f.record = m.record),
y AS (SELECT record, 'journal_creation' AS rule, CASE WHEN made_us IS NULL THEN 'HIGH' WHEN gap < 0 THEN 'CRITICAL' WHEN gap > 86400000000 THEN 'HIGH' WHEN gap > 60000000 THEN 'MEDIUM' END AS severity, CASE WHEN made_us IS NULL OR gap < 0 OR gap > 86400000000 THEN 30 ELSE 15 END::BIGINT AS points FROM x)
SELECT * FROM y WHERE severity IS NOT NULL""")
def journal_creation(f, j):
    return R.journal_creation(f, j)


@_query(""", o AS (SELECT reference & 281474976710655 AS record, min(us) AS op_us FROM j GROUP BY 1)
SELECT f.record, 'log_operations' AS rule, CASE WHEN op_us - created_us > 86400000000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE WHEN op_us - created_us > 86400000000 THEN 20 ELSE 10 END::BIGINT AS points
FROM f JOIN o ON f.record = o.record WHERE op_us - created_us > 86400000000 OR abs(op_us - created_us) > 604800000000""")
def log_operations(f, j):
    return R.log_operations(f, j)


@_query(""", b AS (SELECT min(us) + 1000 * 86400000000 AS lo, max(us) - 300 * 86400000000 AS hi FROM j)
SELECT record, 'event_bounds' AS rule, CASE WHEN created_us > hi THEN 'HIGH' ELSE 'LOW' END AS severity, CASE WHEN created_us > hi THEN 75 ELSE 25 END::BIGINT AS points FROM f, b WHERE created_us > hi + 86400000000 OR created_us < lo - 157680000000000""")
def event_bounds(f, j):
    """Against the times of the journal, moved inward so that files lie outside."""
    events = j.agg((F.min("us") + 1000 * R.DAY).alias("a"), (F.max("us") - 300 * R.DAY).alias("b")).select(F.explode(F.array("a", "b")).alias("us"))
    return R.event_bounds(f, events)


@_query(""", d AS (SELECT CASE WHEN abs(g - 3600000000) <= 60000000 THEN 3600 WHEN abs(g - 7200000000) <= 60000000 THEN 7200 WHEN abs(g - 43200000000) <= 60000000 THEN 43200 WHEN abs(g - 86400000000) <= 60000000 THEN 86400
  WHEN abs(g - 604800000000) <= 60000000 THEN 604800 WHEN abs(g - 2592000000000) <= 60000000 THEN 2592000 WHEN abs(g - 31536000000000) <= 60000000 THEN 31536000 END AS delta_s FROM (SELECT abs(modified_us - created_us) AS g FROM f) x)
SELECT delta_s, count(*) AS n, 'CRITICAL' AS severity FROM d WHERE delta_s IS NOT NULL GROUP BY 1 HAVING count(*) >= 3""")
def delta_clusters(f, j):
    return R.delta_clusters(f)


@_query(" SELECT created_us // 1000000 AS second, count(*) AS n, count(DISTINCT dir) AS dirs FROM f GROUP BY 1 HAVING count(*) >= 5")
def same_second(f, j):
    return R.same_second(f)


@_query(""", p AS (SELECT created_us % 1000000 AS part, count(*) AS n FROM f GROUP BY 1)
SELECT sum(n)::BIGINT AS n, round(sum(CASE WHEN part = 0 THEN n ELSE 0 END) / sum(n), 6) AS zero_share, round(max(n) / sum(n), 6) AS mode_share, sum(CASE WHEN part = 0 THEN n ELSE 0 END) / sum(n) > 0.9 AS suspicious FROM p""")
def time_precision(f, j):
    return R.precision(f)


@_query(""", x AS (SELECT *, lag(us) OVER (PARTITION BY file ORDER BY lsn, record) AS prev FROM j) SELECT record, us, reason, reference, lsn, file, prev FROM x WHERE us < prev""")
def sequence_order(f, j):
    """Journal rows whose time runs backwards in the order of the log."""
    return R.sequence_order(j, "file", "lsn", "us", "record")


@_query(""", x AS (SELECT record, file, lsn, max(lsn) OVER (PARTITION BY file) AS top FROM j) SELECT record, file, lsn, top FROM x WHERE top > lsn + 100""")
def sequence_jump(f, j):
    return R.sequence_jump(j.select("record", "file", "lsn"), "file", "lsn", 100)


@_query(""", s AS (SELECT record FROM f WHERE modified_us - created_us > 5184000000000), t AS (SELECT record FROM j WHERE reason & 256 <> 0), u AS (SELECT record FROM f WHERE fn_created_us <> created_us),
n AS (SELECT f.record, (f.record IN (SELECT record FROM s))::BIGINT + (f.record IN (SELECT record FROM t))::BIGINT + (f.record IN (SELECT record FROM u))::BIGINT AS sources FROM (SELECT DISTINCT record FROM f) f) SELECT record, sources FROM n WHERE sources >= 2""")
def multi_source_presence(f, j):
    sources = {"late": F.expr("modified_us - created_us > 5184000000000"), "made": j.filter(F.col("reason").bitwiseAND(256) != 0), "named": F.expr("fn_created_us <> created_us")}
    return R.presence(f, sources, "record", 2, sized.parts(j))


@_query(""", g AS (SELECT record, (modified_us - created_us) / 1000000.0 AS gap FROM f), m AS (SELECT avg(gap) AS a, stddev_pop(gap) AS s FROM g) SELECT record, round((gap - a) / s, 2) AS z FROM g, m WHERE abs((gap - a) / s) > 1.7""")
def gap_outliers(f, j):
    g = f.select("record", ((F.col("modified_us") - F.col("created_us")) / 1e6).alias("gap"))
    return R.z_outliers(g, "gap", 1.7).select("record", F.round("z", 2).alias("z"))


@_query(""", b AS (SELECT us // 86400000000 AS day, min(us) + 43200000000 AS boot_us FROM j GROUP BY 1) SELECT record, created_us, boot_us FROM f JOIN b ON created_us // 86400000000 = b.day WHERE created_us < boot_us""")
def before_boot(f, j):
    """Boots at noon of each day that the journal has."""
    return T.before_boot(f, j.groupBy("us").count().select((F.col("us") + 43_200_000_000).alias("us")))


@_query(""", x AS (SELECT record, file, lsn, lsn - lag(lsn) OVER (PARTITION BY file ORDER BY lsn) AS gap FROM (SELECT min(record) AS record, file, lsn FROM j GROUP BY file, lsn) y) SELECT record, file, lsn, gap FROM x WHERE gap > 20 ORDER BY gap DESC, file, lsn LIMIT 10""")
def sequence_gaps(f, j):
    return T.sequence_gaps(j.groupBy("file", "lsn").agg(F.min("record").alias("record")).select("record", "file", "lsn"), "file", "lsn", 20)


@_query(" SELECT count(*) AS rows, min(us) AS first_us, max(us) AS last_us, count(*) > 100 AND max(us) - min(us) < 7 * 86400000000 AS suspicious FROM j")
def journal_health(f, j):
    return T.journal_health(j)


@_query(""", v AS (SELECT DISTINCT record, 3 AS w FROM f WHERE modified_us - created_us > 5184000000000 UNION ALL SELECT DISTINCT record, 2 FROM j WHERE reason & 256 <> 0 UNION ALL SELECT DISTINCT record, 1 FROM f WHERE fn_created_us <> created_us),
g AS (SELECT record, sum(w)::BIGINT AS w FROM v GROUP BY 1), s AS (SELECT f.record, coalesce(w, 0) AS votes FROM f LEFT JOIN g ON f.record = g.record)
SELECT record, votes, CASE WHEN votes >= 6 THEN 'strong' WHEN votes >= 4 THEN 'moderate' WHEN votes >= 2 THEN 'weak' ELSE 'none' END AS verdict FROM s""")
def artefact_votes(f, j):
    sources = {"late": (F.expr("modified_us - created_us > 5184000000000"), 3), "made": (j.filter(F.col("reason").bitwiseAND(256) != 0), 2), "named": (F.expr("fn_created_us <> created_us"), 1)}
    return T.votes(f, sources, parts=sized.parts(j))


@_query(""", y AS (SELECT dir, year(make_timestamp(created_us)) AS yr, count(*) AS n FROM f GROUP BY 1, 2), g AS (SELECT dir, sum(n)::BIGINT AS files, max(n) AS top, arg_max(yr, n * 10000 + yr)::INTEGER AS year FROM y GROUP BY 1)
SELECT dir, files, year, round(top / files, 6) AS share FROM g WHERE files >= 50 AND top > 0.2 * files""")
def year_clusters(f, j):
    return T.year_clusters(f, 50, 0.2)


@_query(""", s AS (SELECT DISTINCT us // 31536000000000 * 31536000000000 AS us FROM j)
SELECT f.record, (SELECT min(s.us) FROM s WHERE s.us > f.created_us) // 31536000000000 AS next_snapshot FROM f""")
def later_snapshot(f, j):
    """Snapshots once in 365 days of the journal's times."""
    year = F.expr("us div 31536000000000")
    return T.later_snapshot(f, j.select(year.alias("snapshot")).distinct().withColumn("us", F.col("snapshot") * 31_536_000_000_000))
