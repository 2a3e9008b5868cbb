"""Labels, scalar functions and parsers on the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import labels as B

QUERIES: dict = {}
ORACLES: dict = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark, sf_dir, t):
    return spark.read.parquet(f"{sf_dir}/{t}.parquet")


def _any(col, *patterns):
    return "(" + " OR ".join(f"regexp_matches({col}, '(?i){p}')" for p in patterns) + ")"


_WEB = (("script", 0.4, ("<script", r"onerror=", r"javascript:")), ("tracking", 0.2, (r"utm_source=", r"track\(", r"ref=")), ("login", 0.3, (r"login", r"password")))


def _score(col, weight, patterns):
    n = " + ".join(f"regexp_matches({col}, '(?i){p}')::INTEGER" for p in patterns)
    return f"CASE WHEN {n} > 0 THEN least({weight} + 0.1 * ({n}), 0.95) ELSE 0 END"


@_query(f"""WITH s AS (SELECT page_id, round({_score("url || ' ' || html", 0.4, [p.replace("(", "[(]").replace(chr(92), "") for p in _WEB[0][2]])}, 4) AS a, round({_score("url || ' ' || html", 0.2, ["utm_source=", "track[(]", "ref="])}, 4) AS b, round({_score("url || ' ' || html", 0.3, ["login", "password"])}, 4) AS c FROM pages)
SELECT page_id, CASE WHEN a >= b AND a >= c THEN 'script' WHEN b >= c THEN 'tracking' ELSE 'login' END AS type, greatest(a, b, c)::DOUBLE AS score FROM s WHERE greatest(a, b, c) >= 0.3""")
def web_attack_category(spark, sf_dir):
    """The best-scoring pattern category of each page."""
    best = B.best_category(F.concat_ws(" ", "url", "html"), _WEB)
    return _read(spark, sf_dir, "pages").select("page_id", best.alias("b")).filter("b is not null").select("page_id", "b.type", F.col("b.score").cast("double").alias("score"))


@_query("""WITH s AS (SELECT doc_id, (regexp_matches(text, '(?i)idiot')::INTEGER + regexp_matches(text, '(?i)moron')::INTEGER + regexp_matches(text, '(?i)clown')::INTEGER) AS a, (regexp_matches(text, '(?i)password')::INTEGER + regexp_matches(text, '(?i)token')::INTEGER) AS b, regexp_matches(text, '(?i)licen[sc]e')::INTEGER AS c FROM documents)
SELECT doc_id, CASE WHEN a > 0 THEN 'insult' WHEN b > 0 THEN 'secret' ELSE 'license' END AS kind, round(least(0.5 + 0.15 * CASE WHEN a > 0 THEN a WHEN b > 0 THEN b ELSE c END, 0.95), 4)::DOUBLE AS confidence FROM s WHERE a > 0 OR b > 0 OR c > 0""")
def ordered_classes(spark, sf_dir):
    """The first matching class of each document's text."""
    kind, conf = B.ordered_class(F.col("text"), (("insult", ("idiot", "moron", "clown")), ("secret", ("password", "token")), ("license", ("licen[sc]e",))))
    return _read(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), F.round(conf, 4).cast("double").alias("confidence")).filter("kind is not null")


@_query("""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'critical') OR contains(lower(text), 'fatal') OR contains(lower(text), 'emergency') THEN 'critical' WHEN contains(lower(text), 'error') OR contains(lower(text), 'err') OR contains(lower(text), 'fail') THEN 'error'
WHEN contains(lower(text), 'warn') THEN 'warning' WHEN contains(lower(text), 'debug') THEN 'debug' ELSE 'info' END AS severity FROM conversations""")
def severity_ladder(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", B.severity(F.col("text")).alias("severity"))


@_query("""WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS ch, length(text) AS n FROM benchmark), g AS (SELECT item_id, ch, any_value(n) AS n, count(*) AS k FROM c GROUP BY 1, 2)
SELECT item_id, round(-sum(k / n * log2(k / n)), 6) AS entropy FROM g GROUP BY 1""")
def text_entropy(spark, sf_dir):
    return _read(spark, sf_dir, "benchmark").select("item_id", F.round(B.entropy(F.col("text")), 6).alias("entropy"))


@_query("""SELECT page_id, CASE WHEN regexp_matches(url, '(?i)(<script>|javascript:|onerror=|onload=)') THEN 'xss_attack' ELSE 'safe' END AS attack_type FROM pages""")
def keyword_attack_label(spark, sf_dir):
    """Keyword rules on urls: these have none of the words of the other types."""
    kind, _ = B.attack_label(F.col("url"))
    return _read(spark, sf_dir, "pages").select("page_id", kind.alias("attack_type"))


@_query("""SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm_source FROM pages""")
def url_key_values(spark, sf_dir):
    """Key=value pairs of the query part, first value of a key."""
    kv = B.key_values(F.regexp_replace(F.regexp_extract("url", r"\?([^#]*)", 1), "&", " "))
    return _read(spark, sf_dir, "pages").select("page_id", kv.alias("kv")).select("page_id", F.col("kv")["page"].alias("page"), F.col("kv")["ref"].alias("ref"), F.col("kv")["utm_source"].alias("utm_source"))


@_query("""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations) SELECT conv_id, count(*) AS lines, count(*) FILTER (WHERE trim(line) <> '') AS filled, max(length(line))::INTEGER AS longest FROM l GROUP BY 1""")
def line_scan(spark, sf_dir):
    """Text split into lines, as a log source is."""
    lines = _read(spark, sf_dir, "conversations").select("conv_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("conv_id").agg(F.count("*").alias("lines"), F.count_if(F.trim("line") != "").alias("filled"), F.max(F.length("line")).alias("longest"))
