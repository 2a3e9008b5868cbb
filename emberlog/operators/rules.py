"""Further timestamp rules, and the scores and summaries over all of them.

Records have record, name, dir, created_us, modified_us and fn_created_us; every rule returns rows (record, rule,
severity, points). Bounds of volumes and event logs are one row each and are joined as such.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.forensic import DAY, SECOND, _rows

MINUTE = 60 * SECOND
#: The first second that file times can hold: 1601-01-01.
ZERO_US = -11_644_473_600_000_000


def _year(us: Column) -> Column:
    return F.year(F.timestamp_micros(us))


def outside_years(files: DataFrame, as_of_us: int) -> DataFrame:
    """Created more than a year after this one CRITICAL 20; in 1601, the unset time, MEDIUM 10."""
    y = _year(F.col("created_us"))
    future = y > _year(F.lit(as_of_us)) + 1
    return _rows(files, future | (y == 1601), "outside_years", F.when(future, "CRITICAL").otherwise("MEDIUM"), F.when(future, 20).otherwise(10))


def after_event_logs(files: DataFrame, security: DataFrame, system: DataFrame) -> DataFrame:
    """Created over a day after the last security event HIGH 15; else after the last system event, or over 30 days before
    the first security event, MEDIUM 7."""
    b = security.agg(F.min("us").alias("first_sec"), F.max("us").alias("last_sec")).crossJoin(system.agg(F.max("us").alias("last_sys")))
    c = F.col("created_us")
    late, other = c > F.col("last_sec") + DAY, (c > F.col("last_sys") + DAY) | (c < F.col("first_sec") - 30 * DAY)
    return _rows(files.crossJoin(F.broadcast(b)), late | other, "after_event_logs", F.when(late, "HIGH").otherwise("MEDIUM"), F.when(late, 15).otherwise(7))


def event_order(files: DataFrame, events: DataFrame) -> DataFrame:
    """Created over 300 s after the first event that names the record: HIGH 15."""
    first = events.groupBy("record").agg(F.min("us").alias("seen_us"))
    return _rows(files.join(first, "record"), F.col("created_us") > F.col("seen_us") + 300 * SECOND, "event_order", F.lit("HIGH"), F.lit(15))


def logs_cleared(files: DataFrame, clearings: DataFrame) -> DataFrame:
    """100 points for every record if there is any trace of a cleared log."""
    any_ = clearings.limit(1).select(F.lit(1).alias("cleared"))  # one row at most
    return _rows(files.crossJoin(F.broadcast(any_)), F.col("cleared") == 1, "logs_cleared", F.lit("CRITICAL"), F.lit(100))


def not_in_journal(files: DataFrame, journal: DataFrame, before_year: int = 2015) -> DataFrame:
    """Created before a year and without a row in a journal that has rows: MEDIUM 25."""
    have = F.broadcast(journal.limit(1).select(F.lit(1).alias("_have")))
    gone = files.join(journal.select("record").distinct(), "record", "left_anti").crossJoin(have)
    return _rows(gone, _year(F.col("created_us")) < before_year, "not_in_journal", F.lit("MEDIUM"), F.lit(25))


def before_volume(files: DataFrame, volumes: DataFrame, days: int = 30) -> DataFrame:
    """Created over `days` days before the volume (created_us, one row): HIGH 50; names of the system's own files don't count."""
    own = F.lower("name").rlike(r"\$|shadowindex|system volume")
    b = files.crossJoin(F.broadcast(volumes.agg(F.min("created_us").alias("volume_us"))))
    return _rows(b, (F.col("volume_us") - F.col("created_us") >= (days + 1) * DAY) & ~own, "before_volume", F.lit("HIGH"), F.lit(50))


def before_install(files: DataFrame, installs: DataFrame) -> DataFrame:
    """Either creation time before the volume or system was made: CRITICAL, LOW for system paths; 40 and 5 points."""
    b = files.crossJoin(F.broadcast(installs.agg(F.min("us").alias("install_us"))))
    system = F.lower("name").rlike(r"^(windows|program files|\$)")
    early = (F.col("created_us") < F.col("install_us")) | (F.col("fn_created_us") < F.col("install_us"))
    return _rows(b, early, "before_install", F.when(system, "LOW").otherwise("CRITICAL"), F.when(system, 5).otherwise(40))


def crowded_minutes(files: DataFrame, least: int = 10, dirs: int = 5, first: int = 5) -> DataFrame:
    """The first records of each minute with over `least` creations in over `dirs` directories: HIGH 75."""
    m = files.withColumn("minute", F.expr(f"created_us div {MINUTE}"))
    hot = m.groupBy("minute").agg(F.count("*").alias("n"), F.count_distinct("dir").alias("d")).filter((F.col("n") > least) & (F.col("d") > dirs))
    ranked = m.join(hot.select("minute"), "minute").withColumn("r", F.row_number().over(Window.partitionBy("minute").orderBy("record")))
    return _rows(ranked, F.col("r") <= first, "crowded_minutes", F.lit("HIGH"), F.lit(75))


def before_write(files: DataFrame, journal: DataFrame) -> DataFrame:
    """Modified before the journal's first write of data: CRITICAL 40."""
    wrote = journal.filter(F.col("reason").bitwiseAND(0x11) != 0).groupBy("record").agg(F.min("us").alias("write_us"))
    return _rows(files.join(wrote, "record"), F.col("modified_us") < F.col("write_us"), "before_write", F.lit("CRITICAL"), F.lit(40))


def clock_rollbacks(events: DataFrame, key: str = "source", order: str = "number", changes: tuple[int, ...] = (4616, 1)) -> DataFrame:
    """Events whose time is before that of the one numbered before them, and whether a clock change is logged at either."""
    w = Window.partitionBy(key).orderBy(order, "us", "event_id")
    e = events.withColumn("before_us", F.lag("us").over(w)).withColumn("before_id", F.lag("event_id").over(w))
    told = F.col("event_id").isin(*changes) | F.coalesce(F.col("before_id").isin(*changes), F.lit(False))
    return e.filter("us < before_us").select(key, order, (F.col("before_us") - F.col("us")).alias("back_us"), told.alias("announced"))


def prefetch_missing(files: DataFrame, prefetch: DataFrame, as_of_us: int, days: int = 30) -> DataFrame:
    """Programs made 1 to `days` - 1 whole days ago that no prefetch file names: LOW 10."""
    from emberlog.operators.artefacts import without_prefetch

    age = F.expr(f"({as_of_us} - created_us) div {DAY}")
    recent = files.filter(age.between(1, days - 1))
    gone = without_prefetch(recent, prefetch).select("record")
    return _rows(recent.join(gone, "record", "left_semi"), F.lit(True), "prefetch_missing", F.lit("LOW"), F.lit(10))


# Words of file names and the importance of the artefact
TRIAGE = (
    ("critical", ("timestomp", "security", "usnjrnl", "mft", "logfile", "sam", "system.evtx")),
    ("important", ("prefetch", "amcache", "ntuser", "registry", "shadow", "powershell")),
)
# Traces in text that tell of hiding
TRACES = (
    ("shadow_copy", r"(?i)vssadmin\s+delete|shadowcopy\s+delete|wbadmin\s+delete"), ("hidden_stream", r"(?i)[^\s:\\]+\.\w+:[^\s:\\/]+(:\$DATA)?$"), ("log_clearing", r"(?i)wevtutil\s+cl|clear-eventlog|\b(1102|104)\b.*clear"),
    ("registry", r"(?i)reg\s+delete|DisablePrefetch|NtfsDisableLastAccessUpdate"), ("deletion", r"(?i)sdelete|cipher\s+/w|shred\s|eraser"), ("timeline", r"(?i)timestomp|SetFileTime|touch\s+-[dt]"), ("mft", r"(?i)\$MFT.*(anomal|mismatch|zero)"),
)


def triage(name: Column) -> Column:
    """Importance of an artefact by its file's name."""
    low = F.lower(name)
    holds = lambda words: reduce(lambda a, b: a | b, (low.contains(w) for w in words))
    return reduce(lambda c, t: c.when(holds(t[1]), t[0]), TRIAGE[1:], F.when(holds(TRIAGE[0][1]), TRIAGE[0][0])).otherwise("standard")


def traces(lines: DataFrame, text: str) -> DataFrame:
    """Lines with the kinds of traces that they hold."""
    kinds = F.array_compact(F.array(*(F.when(F.col(text).rlike(p), k) for k, p in TRACES)))
    return lines.withColumn("kind", F.explode(kinds))


def trace_summary(found: DataFrame) -> DataFrame:
    """Traces of each kind, all of them, and the risk: LOW without any, MEDIUM under five, else HIGH."""
    counts = [F.count_if(F.col("kind") == k).alias(k) for k, _ in TRACES]
    out = found.agg(*counts, F.count("*").alias("total"))
    return out.withColumn("risk", F.when(F.col("total") == 0, "LOW").when(F.col("total") < 5, "MEDIUM").otherwise("HIGH"))


# Points of a severity
SEVERITY_POINTS = (("CRITICAL", 100), ("HIGH", 75), ("MEDIUM", 50), ("LOW", 25), ("INFO", 0))


def weighted_scores(indicators: DataFrame) -> DataFrame:
    """Per record of (record, severity, confidence, weight): 100 * sum(points * confidence * weight) / sum(100 * weight), and its band."""
    points = reduce(lambda c, p: c.when(F.col("severity") == p[0], p[1]), SEVERITY_POINTS[1:], F.when(F.col("severity") == SEVERITY_POINTS[0][0], SEVERITY_POINTS[0][1]))
    g = indicators.groupBy("record").agg(
        F.least(F.lit(100.0), 100 * F.sum(points * F.col("confidence") * F.col("weight")) / F.sum(100 * F.col("weight"))).alias("score"),
        F.count_if(F.col("severity") == "CRITICAL").alias("c"), F.count_if(F.col("severity") == "HIGH").alias("h"),
    )
    s = F.col("score")
    band = F.when((F.col("c") > 0) | (s > 75), "CRITICAL").when((F.col("h") > 0) | (s > 50), "HIGH").when(s > 25, "MEDIUM").otherwise("INFO")
    return g.select("record", "score", band.alias("band"), band.isin("CRITICAL", "HIGH").alias("tampered"))


def ranked(scores: DataFrame, most: int = 500) -> DataFrame:
    """The `most` records with the highest scores."""
    return scores.orderBy(F.desc("score"), "record").limit(most)


# Names that parsers leave behind
NO_NAMES = ("", ".", "..", "unknown", "none", "null", "n/a", "-")


def named(files: DataFrame, name: str = "name") -> DataFrame:
    """Without rows whose name is left over from parsing."""
    return files.filter(F.col(name).isNotNull() & ~F.lower(F.trim(name)).isin(*NO_NAMES))
