"""Timestamp-tampering rules over file records, journals and event bounds.

Records have name, created_us and modified_us (the standard times) and fn_created_us (the file-name time). Every rule
returns rows (record, rule, severity, points); scores add up per record.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
DAY = 86_400 * SECOND
# Seconds that forged times are often shifted by
ROUND_SECONDS = (3600, 7200, 43200, 86400, 604800, 2592000, 31536000)


def ntfs_time(ticks: Column) -> Column:
    """Microseconds since 1970 of 100-ns ticks since 1601; 0 is unset."""
    return F.when(ticks != 0, F.call_function("div", ticks, F.lit(10)) - F.lit(11_644_473_600_000_000))


# what a rule on single records finds: a condition, the rule's name, severity and points
Found = tuple[Column, str, Column, Column]


def _rows(df: DataFrame, cond: Column, rule: str, severity: Column, points: Column) -> DataFrame:
    return df.filter(cond).select("record", F.lit(rule).alias("rule"), severity.alias("severity"), points.cast("long").alias("points"))


def one_pass(df: DataFrame, *found: Found) -> DataFrame:
    """What several rules on single records find, in one pass over the records."""
    hits = [F.when(cond, F.struct(F.lit(rule).alias("rule"), severity.alias("severity"), points.cast("long").alias("points"))) for cond, rule, severity, points in found]
    return df.select("record", F.inline(F.array(*hits))).filter("rule is not null")


def _standard_vs_name(files: DataFrame) -> Found:
    gap = F.abs(F.col("created_us") - F.col("fn_created_us"))
    if "fn_modified_us" in files.columns:
        gap = F.greatest(gap, F.abs(F.col("modified_us") - F.col("fn_modified_us")))  # nulls are passed over
    return gap > SECOND, "standard_vs_name", F.when(gap > DAY, "HIGH").otherwise("MEDIUM"), F.when(gap > DAY, 30).otherwise(15)


def standard_vs_name(files: DataFrame) -> DataFrame:
    """Standard and file-name times of creation, or of the last change where both are known (fn_modified_us), differ by over a
    second: HIGH and 30 points over a day, else 15.
    """
    return _rows(files, *_standard_vs_name(files))


def journal_creation(files: DataFrame, journal: DataFrame) -> DataFrame:
    """Against the first journal creation of the file: earlier CRITICAL, over a day later HIGH, over a minute MEDIUM; none at all HIGH."""
    first = journal.filter(F.col("reason").bitwiseAND(0x100) != 0).groupBy("record").agg(F.min("us").alias("made_us"))
    j = files.join(first, "record", "left")
    gap = F.col("created_us") - F.col("made_us")
    sev = F.when(F.col("made_us").isNull(), "HIGH").when(gap < 0, "CRITICAL").when(gap > DAY, "HIGH").when(gap > 60 * SECOND, "MEDIUM")
    return _rows(j, sev.isNotNull(), "journal_creation", sev, F.when(F.col("made_us").isNull() | (gap < 0) | (gap > DAY), 30).otherwise(15))


def log_operations(files: DataFrame, log: DataFrame) -> DataFrame:
    """Against the earliest logged operation of the 48-bit reference: over a day before HIGH 20, else over 7 days apart MEDIUM 10."""
    ops = log.groupBy(F.col("reference").bitwiseAND(0xFFFFFFFFFFFF).alias("record")).agg(F.min("us").alias("op_us"), F.count("*").alias("ops"))
    j = files.join(ops, "record")
    gap = F.col("op_us") - F.col("created_us")
    return _rows(j, (gap > DAY) | (F.abs(gap) > 7 * DAY), "log_operations", F.when(gap > DAY, "HIGH").otherwise("MEDIUM"), F.when(gap > DAY, 20).otherwise(10))


def _odd_times(as_of_us: int) -> Found:
    c = F.col("created_us")
    zero = c.isNull() | (c == 0)
    sev = F.when(c > as_of_us, "CRITICAL").when(zero, "HIGH").when(c < 631_152_000_000_000, "MEDIUM")
    return sev.isNotNull(), "odd_times", sev, F.when(c > as_of_us, 100).when(zero, 75).otherwise(50)


def odd_times(files: DataFrame, as_of_us: int) -> DataFrame:
    """Future 100, unset (null, as `ntfs_time` gives it, or 0) 75 and ancient (before 1990) 50 points."""
    return _rows(files, *_odd_times(as_of_us))


def _order_anomaly() -> Found:
    return F.col("modified_us") < F.col("created_us"), "order_anomaly", F.lit("MEDIUM"), F.lit(25)


def order_anomaly(files: DataFrame) -> DataFrame:
    return _rows(files, *_order_anomaly())


def event_bounds(files: DataFrame, events: DataFrame) -> DataFrame:
    """Over a day after the last event 75 points; over 5 years before the first 25. The bounds are one row."""
    b = files.crossJoin(F.broadcast(events.agg(F.min("us").alias("lo"), F.max("us").alias("hi"))))
    c = F.col("created_us")
    return _rows(b, (c > F.col("hi") + DAY) | (c < F.col("lo") - 5 * 365 * DAY), "event_bounds", F.when(c > F.col("hi"), "HIGH").otherwise("LOW"), F.when(c > F.col("hi"), 75).otherwise(25))


def _round_delta(tolerance: int, least: int) -> Found:
    """By `_n`, the records in all up to `least`."""
    gap = F.abs(F.col("modified_us") - F.col("created_us"))
    near = reduce(lambda a, b: a | b, (F.abs(gap - s * SECOND) <= tolerance * SECOND for s in ROUND_SECONDS))
    return near & (F.col("_n") >= least), "round_delta", F.lit("MEDIUM"), F.lit(50)


def _counted(files: DataFrame, least: int) -> DataFrame:
    return files.crossJoin(F.broadcast(files.limit(least).agg(F.count("*").alias("_n"))))


def round_delta(files: DataFrame, tolerance: int = 0, least: int = 10) -> DataFrame:
    """Creation and modification apart by a round time, to `tolerance` seconds; needs `least` records in all."""
    return _rows(_counted(files, least), *_round_delta(tolerance, least))


def time_indicators(files: DataFrame, as_of_us: int, tolerance: int = 0, least: int = 10) -> DataFrame:
    """`standard_vs_name`, `odd_times`, `order_anomaly` and `round_delta` in one pass over the records."""
    return one_pass(_counted(files, least), _standard_vs_name(files), _odd_times(as_of_us), _order_anomaly(), _round_delta(tolerance, least))


def delta_clusters(files: DataFrame, least: int = 3) -> DataFrame:
    """Round deltas that `least` or more records share."""
    gap = F.abs(F.col("modified_us") - F.col("created_us"))
    alike = reduce(lambda c, s: c.when(F.abs(gap - s * SECOND) <= 60 * SECOND, s), ROUND_SECONDS[1:], F.when(F.abs(gap - ROUND_SECONDS[0] * SECOND) <= 60 * SECOND, ROUND_SECONDS[0]))
    return files.select(alike.alias("delta_s")).filter("delta_s is not null").groupBy("delta_s").agg(F.count("*").alias("n")).filter(F.col("n") >= least).withColumn("severity", F.lit("CRITICAL"))


def same_second(files: DataFrame, least: int = 5) -> DataFrame:
    """Seconds in which `least` or more records were created, with their directories."""
    return files.groupBy(F.expr(f"created_us div {SECOND}").alias("second")).agg(F.count("*").alias("n"), F.count_distinct("dir").alias("dirs")).filter(F.col("n") >= least)


def precision(files: DataFrame) -> DataFrame:
    """Share of records without a sub-second part, and of the most frequent part."""
    part = files.groupBy((F.col("created_us") % SECOND).alias("part")).agg(F.count("*").alias("n"))
    s = part.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("part") == 0, F.col("n")).otherwise(0)).alias("zero"), F.max("n").alias("most"))
    return s.select("n", F.round(F.col("zero") / F.col("n"), 6).alias("zero_share"), F.round(F.col("most") / F.col("n"), 6).alias("mode_share"), (F.col("zero") / F.col("n") > 0.9).alias("suspicious"))


def z_outliers(df: DataFrame, value: str, limit: float = 3.0) -> DataFrame:
    """Rows over `limit` population deviations from the mean: the one row of moments is joined, nothing is compared pairwise."""
    m = F.broadcast(df.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s")))
    z = (F.col(value) - F.col("_m")) / F.col("_s")
    return df.crossJoin(m).filter("_s > 0").withColumn("z", z).filter(F.abs("z") > limit).drop("_m", "_s")


def sequence_order(log: DataFrame, key: str, order: str, time: str, *ties: str) -> DataFrame:
    """Operations whose time is before that of the preceding one of the same file; equal places come in order of `ties`."""
    prev = F.lag(time).over(Window.partitionBy(key).orderBy(order, *ties))
    return log.withColumn("prev", prev).filter(F.col(time) < F.col("prev"))


def sequence_jump(log: DataFrame, key: str, seq: str, most: int = 10) -> DataFrame:
    """Records whose largest sequence number of the key is over `most` above their own."""
    return log.withColumn("top", F.max(seq).over(Window.partitionBy(key))).filter(F.col("top") > F.col(seq) + most)


def scores(indicators: DataFrame) -> DataFrame:
    """Points per record and their band: 75 CRITICAL, 50 HIGH, 25 MEDIUM."""
    rank = F.element_at(F.create_map(*(F.lit(x) for p in (("LOW", 1), ("MEDIUM", 2), ("HIGH", 3), ("CRITICAL", 4)) for x in p)), F.col("severity"))
    s = indicators.groupBy("record").agg(F.sum("points").alias("score"), F.count("*").alias("indicators"), F.max(rank).cast("long").alias("worst"))
    return s.withColumn("band", F.when(F.col("score") >= 75, "CRITICAL").when(F.col("score") >= 50, "HIGH").when(F.col("score") >= 25, "MEDIUM").otherwise("LOW"))


def held(base: DataFrame, sources: dict[str, DataFrame | Column], key: str, parts: int | None = None) -> DataFrame:
    """Per key of `base`: `_n`, its rows there, and for each source `in_<name>`, whether it holds the key; a null is held by none.

    A source is a table, or a condition on the rows of `base`, so that these are made once. All rows meet in one shuffle
    by the key, into `parts` partitions if given.
    """
    have = F.col(key).isNotNull()
    own = [(F.coalesce(c & have, F.lit(False)) if isinstance(c, Column) else F.lit(False)).alias(f"in_{s}") for s, c in sources.items()]
    rows = base.select(key, F.lit(1).alias("_n"), *own)
    for name, df in sources.items():
        if not isinstance(df, Column):
            rows = rows.unionByName(df.filter(have).select(key, F.lit(0).alias("_n"), *(F.lit(s == name).alias(f"in_{s}") for s in sources)))
    dealt = rows.repartition(parts, key) if parts else rows
    return dealt.groupBy(key).agg(F.sum("_n").alias("_n"), *(F.bool_or(f"in_{s}").alias(f"in_{s}") for s in sources)).filter("_n > 0")


def presence(base: DataFrame, sources: dict[str, DataFrame | Column], key: str, least: int = 3, parts: int | None = None) -> DataFrame:
    """Keys that `least` or more of the sources hold; sources as in `held`."""
    n = reduce(lambda a, b: a + b, (F.col(f"in_{s}").cast("long") for s in sources))
    return held(base, sources, key, parts).select(key, n.alias("sources")).filter(F.col("sources") >= least)
