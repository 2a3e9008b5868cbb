"""Record boundaries, substring and longest-prefix joins over lines, names and addresses made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import geo
from emberlog.operators import substrings as S
from emberlog.plans.entries import SQL, entries
from emberlog.sources import boundaries as R

QUERIES: dict = {}
ORACLES: dict = {}
DAY = 86_400_000_000


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines by an event's port: two kinds of openings, three of continuations, blank and undecided ones.
_FORMS = ("2024-01-01 00:00:00 up ", "WARN: ", "\tat frame ", "Caused by: ", "    deep ", "", "text ")


@_query(
    SQL
    + """, l AS (SELECT 's' || CAST(substr("user", 2) AS BIGINT) % 9 AS source, id AS line_no, CASE port % 7 WHEN 0 THEN '2024-01-01 00:00:00 up ' || id WHEN 1 THEN 'WARN: ' || id WHEN 2 THEN chr(9) || 'at frame ' || id
  WHEN 3 THEN 'Caused by: ' || id WHEN 4 THEN '    deep ' || id WHEN 5 THEN '' ELSE 'text ' || id END AS line FROM e WHERE id IS NOT NULL),
p AS (SELECT *, lag(line) OVER (PARTITION BY source ORDER BY line_no) AS prev FROM l),
o AS (SELECT *, sum(CASE WHEN line <> '' AND (line LIKE '2024%' OR line LIKE 'WARN%' OR coalesce(prev, '') = '') THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY line_no) AS record FROM p)
SELECT source, record::BIGINT AS record, min(line_no) AS line_no, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS digest FROM o WHERE line <> '' GROUP BY source, record"""
)
def record_boundaries(spark, sf_dir):
    """Records of several lines in files that many blocks are cut from."""
    e = entries(spark, sf_dir).filter("id is not null")
    form = F.element_at(F.array(*map(F.lit, _FORMS)), (F.col("port") % len(_FORMS) + 1).cast("int"))
    source = F.concat(F.lit("s"), (F.substring("user", 2, 20).cast("long") % 9).cast("string"))
    lines = e.select(source.alias("source"), F.col("id").alias("line_no"), F.when(form == "", "").otherwise(F.concat(form, F.col("id").cast("string"))).alias("line"))
    found = R.records(lines, R.ENTRIES, 4096)
    return found.select("source", "record", "line_no", F.size(F.split("line", "\n")).cast("long").alias("lines"), F.md5("line").alias("digest"))


@_query("""WITH names AS (SELECT DISTINCT name FROM (SELECT s_suppkey::VARCHAR AS name FROM supplier UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part UNION ALL SELECT '.' || r_name FROM region UNION ALL SELECT 'example.com/fr' FROM region) x WHERE name <> ''),
texts AS (SELECT DISTINCT text FROM (SELECT url AS text FROM pages UNION ALL SELECT c_name FROM customer UNION ALL SELECT p_name || '.' || p_type FROM part) x WHERE text <> '')
SELECT name, count(*) AS texts, min(text) AS first_text, max(text) AS last_text FROM names JOIN texts ON contains(text, name) GROUP BY name""")
def substring_join(spark, sf_dir):
    """Which texts hold which names."""
    t = lambda name: _table(spark, sf_dir, name)
    names = [t("supplier").select(F.col("s_suppkey").cast("string").alias("name")), t("part").select(F.explode(F.split("p_name", " ")).alias("name")), t("region").select(F.explode(F.array(F.concat(F.lit("."), "r_name"), F.lit("example.com/fr"))).alias("name"))]
    texts = [t("pages").select(F.col("url").alias("text")), t("customer").select("c_name"), t("part").select(F.concat_ws(".", "p_name", "p_type"))]
    pairs = S.contained(names[0].union(names[1]).union(names[2]), texts[0].union(texts[1]).union(texts[2]))
    return pairs.groupBy("name").agg(F.count("*").alias("texts"), F.min("text").alias("first_text"), F.max("text").alias("last_text"))


@_query(f"""WITH f AS (SELECT p_partkey AS record, lower(split_part(p_name, ' ', 1 + p_partkey % 2) || CASE WHEN p_partkey % 3 = 0 THEN '.' || p_partkey % 40 WHEN p_partkey % 3 = 1 THEN 'zz' ELSE '' END) AS name,
    epoch_us(DATE '1999-01-01') + p_partkey * {DAY} AS created_us, epoch_us(DATE '1999-01-01') - p_partkey % 700 * {DAY} + 1000 AS modified_us FROM part),
j AS (SELECT lower(p_name || '.' || l_suppkey % 40) AS name, epoch_us(l_shipdate) AS us, CASE WHEN l_linenumber % 4 < 2 THEN 'FILE_CREATE' WHEN l_linenumber % 4 = 2 THEN 'DATA_EXTEND' ELSE 'CLOSE' END AS reason FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey % 5 = 0 OR l_linenumber % 4 < 2),
d AS (SELECT name, min(us) AS first_us, max(us) AS last_us, count(*) AS n, bool_or(reason = 'FILE_CREATE') AS made, bool_or(reason = 'DATA_EXTEND') AS written FROM j GROUP BY 1),
m AS (SELECT record, f.created_us, f.modified_us, sum(n)::BIGINT AS n, min(first_us) AS first_us, max(last_us) AS last_us, bool_or(made) AS made, bool_or(written) AS written FROM f LEFT JOIN d ON contains(d.name, f.name) WHERE modified_us < created_us GROUP BY 1, 2, 3)
SELECT record, coalesce(n, 0) AS "rows", first_us, last_us, (created_us - modified_us) // {DAY} AS days,
  CASE WHEN n IS NULL THEN 'unknown' WHEN made AND NOT written THEN 'copied' WHEN written AND first_us > modified_us AND first_us < created_us THEN 'forged' WHEN (created_us - modified_us) // {DAY} > 365 THEN 'odd' ELSE 'quiet' END AS verdict FROM m""")
def journal_evidence(spark, sf_dir):
    """What journal rows of names that hold a file's tell of files that were changed before they were made."""
    part, li = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "lineitem")
    key, start = F.col("p_partkey"), F.unix_micros(F.lit("1999-01-01").cast("timestamp"))
    tail = F.when(key % 3 == 0, F.concat(F.lit("."), (key % 40).cast("string"))).when(key % 3 == 1, "zz").otherwise("")
    name = F.concat(F.split_part("p_name", F.lit(" "), (1 + key % 2).cast("int")), tail)
    files = part.select(key.alias("record"), name.alias("name"), (start + key * DAY).alias("created_us"), (start - key % 700 * DAY + 1000).alias("modified_us"))
    kind = F.col("l_linenumber") % 4
    rows = li.filter((F.col("l_suppkey") % 5 == 0) | (kind < 2)).join(part, F.col("l_partkey") == key)
    reason = F.when(kind < 2, "FILE_CREATE").when(kind == 2, "DATA_EXTEND").otherwise("CLOSE")
    journal = rows.select(F.concat("p_name", F.lit("."), (F.col("l_suppkey") % 40).cast("string")).alias("name"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"), F.array(reason).alias("reasons"))
    return S.journal_evidence(files, journal)


_NETWORKS = """, net AS (SELECT 11::BIGINT * 16777216 + n_nationkey * 65536 AS base, 16 AS len, n_name AS country FROM nation
  UNION ALL SELECT 11::BIGINT * 16777216 + n_nationkey * 65536 + n_nationkey % 7 * 256, 24, 'part of ' || n_name FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT 11::BIGINT * 16777216 + n_nationkey * 65536 + n_nationkey % 7 * 256 + 16, 28, 'rack of ' || n_name FROM nation WHERE n_nationkey % 3 = 0),
a AS (SELECT id, u % 30 AS b, u % 7 AS c, port % 64 AS d, u % 11 = 0 AS own, 11::BIGINT * 16777216 + u % 30 * 65536 + u % 7 * 256 + port % 64 AS n FROM (SELECT id, port, CAST(substr("user", 2) AS BIGINT) AS u FROM e) x)
"""


@_query(
    SQL
    + _NETWORKS
    + """ SELECT id, CASE WHEN own THEN '192.168.1.' || d ELSE '11.' || b || '.' || c || '.' || d END AS ip,
  CASE WHEN own THEN 'LOCAL' ELSE coalesce((SELECT arg_max(country, len) FROM net WHERE n // CAST(2 ** (32 - len) AS BIGINT) = base // CAST(2 ** (32 - len) AS BIGINT)), '??') END AS country FROM a"""
)
def geo_enrich(spark, sf_dir):
    """The country of each entry's address by the longest of nested networks."""
    e, nation = entries(spark, sf_dir), _table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    forms = ((F.lit(True), text("11.", k, ".0.0/16"), ""), (k % 2 == 0, text("11.", k, ".", k % 7, ".0/24"), "part of "), (k % 3 == 0, text("11.", k, ".", k % 7, ".16/28"), "rack of "))
    networks = nation.select(F.explode(F.filter(F.array(*(F.struct(c.alias("fits"), n.alias("network"), F.concat(F.lit(p), "n_name").alias("country")) for c, n, p in forms)), lambda x: x["fits"])).alias("x")).select("x.network", "x.country")
    u, d = F.substring("user", 2, 20).cast("long"), F.col("port") % 64
    rows = e.select("id", F.when(u % 11 == 0, text("192.168.1.", d)).otherwise(text("11.", u % 30, ".", u % 7, ".", d)).alias("ip"))
    return geo.countries(rows, networks)
