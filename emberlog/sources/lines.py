"""Line sources: text files as (source, line_no, line), JSON arrays, event CSV and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CSV_FIELDS = ("TimeCreated", "EventID", "LevelDisplayName", "LogName", "MachineName", "Message", "AccountName", "LogonType", "IpAddress")


def read_lines(spark: SparkSession, path: str | list[str], blank: bool = False) -> DataFrame:
    """Files in splits: (source, line_no, line) of non-empty lines, of all with `blank`; line_no counts all lines of a file
    from 0.

    A line's number within its split is added to the lines of the splits before it, so that no file has to fit into a task.
    """
    at = [F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_block")]
    lines = spark.read.text(path).select(*at, F.col("value").alias("line"), F.monotonically_increasing_id().alias("_m"))
    counts = lines.groupBy("source", "_block").agg(F.count("*").alias("n"))  # one row a split
    before = F.sum("n").over(Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    numbered = lines.withColumn("_r", F.row_number().over(Window.partitionBy("source", "_block").orderBy("_m")) - 1)
    out = numbered.join(counts.select("source", "_block", before.alias("_before")), ["source", "_block"])
    out = out if blank else out.filter(F.trim("line") != "")
    return out.select("source", (F.col("_before") + F.col("_r")).alias("line_no"), F.rtrim("line", F.lit("\r")).alias("line"))


def read_unordered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Large files in splits: (source, line) without an order."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("line"))


def tagged(sources: dict[str, DataFrame]) -> DataFrame:
    """The union of several sources, each row tagged with its source's name."""
    every = None
    for name, df in sources.items():
        df = df.withColumn("log_source", F.lit(name))
        every = df if every is None else every.unionByName(df, allowMissingColumns=True)
    return every


def json_objects(lines: DataFrame) -> DataFrame:
    """Lines that hold `[{..}]` or `[[{..}]]` become one line for each object; other lines stay."""
    t = F.trim("line")
    flat = F.regexp_replace(F.regexp_replace(t, r"^\[\s*\[", "["), r"\]\s*\]$", "]")
    items = F.from_json(flat, "array<variant>")
    out = F.when(t.startswith("[{") | t.startswith("[[{"), F.transform(items, lambda v: F.to_json(v))).otherwise(F.array("line"))
    keep = [c for c in lines.columns if c != "line"]
    return lines.select(*keep, F.posexplode(F.coalesce(out, F.array("line"))).alias("item_no", "line"))


def event_csv(lines: DataFrame) -> DataFrame:
    """Security event rows split at plain commas; header rows and short rows go. Quotes are kept, not read."""
    p = F.split("line", ",")
    rows = lines.filter(~F.col("line").startswith("TimeCreated,")).filter(F.size(p) >= len(CSV_FIELDS))
    return rows.select(*[c for c in lines.columns if c != "line"], *(F.trim(p[i]).alias(n) for i, n in enumerate(CSV_FIELDS)))


def timeline_rows(lines: DataFrame) -> DataFrame:
    """Tab-separated file-system timeline rows (type, name, modified, accessed, changed, born), once each."""
    p = F.split("line", "\t")
    clean = lambda i: F.trim(F.regexp_replace(F.get(p, F.lit(i)), r"\s*\([^)]*\)\s*$", ""))
    names = ("type", "name", "modified", "accessed", "changed", "created")
    return lines.filter(F.size(p) >= len(names)).select(*(clean(i).alias(n) for i, n in enumerate(names))).dropDuplicates(["name", "created", "modified"])


def journal_text(lines: DataFrame) -> DataFrame:
    """Change journals as text (source, timestamp, line): lines that hold a date and clock, but rules and empty notices."""
    time = F.regexp_extract("line", r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})", 1)
    kept = lines.filter((F.trim("line") != "") & ~F.startswith("line", F.lit("=")) & ~F.contains("line", F.lit("No USN")))
    return kept.withColumn("timestamp", time).filter("timestamp <> ''").select("source", "timestamp", "line")


def training_rows(spark: SparkSession, path: str, columns: tuple[str, ...], label: str = "attack_cat", names: dict[str, str] | None = None) -> DataFrame:
    """Flow records of a csv file with a header as numbers with an `attack_type`: what is missing, no number or infinite is 0.

    Types are mapped by `names`, whose key may be in any case; none, empty and `Normal` are normal, others `other`. Columns
    that the file lacks are left out.
    """
    raw = spark.read.option("header", True).csv(path)
    there = {c.strip().lower(): c for c in raw.columns}
    number = lambda c: F.coalesce(F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c), F.lit(0.0))
    kind = F.lower(F.trim(raw[there[label.lower()]])) if label.lower() in there else F.lit("normal")
    whens = F.when(F.coalesce(kind, F.lit("")).isin("", "normal"), "normal")
    for k, v in (names or {}).items():
        whens = whens.when(kind == k.strip().lower(), v)
    own = [number(F.trim(raw[there[c.lower()]]).try_cast("double")).alias(c) for c in columns if c.lower() in there]
    return raw.select(*own, whens.otherwise("other").alias("attack_type"))


def write_report(found: DataFrame, path: str, kind: str, title: str = "Report") -> None:
    """Findings (record, rule, severity, points) as txt, json or csv, the most severe first, in parts that keep that order."""
    worst = F.array_position(F.array(*map(F.lit, ("CRITICAL", "HIGH", "MEDIUM", "LOW"))), F.col("severity"))
    rows = found.orderBy(F.when(worst == 0, 9).otherwise(worst), F.desc("points"), "record", "rule")
    if kind == "txt":
        line = F.format_string("[%s] record %s: %s (%s points)", "severity", F.col("record").cast("string"), "rule", F.col("points").cast("string"))
        head = found.sparkSession.createDataFrame([(title,), ("=" * len(title),)], "value string").coalesce(1)
        head.unionByName(rows.select(line.alias("value"))).write.mode("overwrite").text(path)
    else:
        export(rows, path, kind)


def export(entries: DataFrame, path: str, kind: str = "csv") -> None:
    """Write entries as csv (with a header, quotes doubled), json or text."""
    if kind == "csv":
        entries.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif kind == "json":
        entries.write.mode("overwrite").json(path)
    else:
        entries.select(F.concat_ws("\t", *entries.columns).alias("value")).write.mode("overwrite").text(path)


def append_feedback(feedback: DataFrame, path: str) -> None:
    """Add feedback rows to their table."""
    feedback.write.mode("append").parquet(path)
