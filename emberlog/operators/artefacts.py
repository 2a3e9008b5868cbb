"""Joins of file records with other artefacts: boots, prefetch files, snapshots, journals and votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.forensic import held

DAY = 86_400_000_000


def before_boot(files: DataFrame, boots: DataFrame) -> DataFrame:
    """Files created on a day of a boot, but before its first boot: an equi-join on the day."""
    day = lambda c: F.expr(f"{c} div {DAY}")
    first = boots.groupBy(day("us").alias("day")).agg(F.min("us").alias("boot_us"))
    return files.withColumn("day", day("created_us")).join(first, "day").filter("created_us < boot_us").select("record", "created_us", "boot_us")


def by_name(files: DataFrame, journal: DataFrame) -> DataFrame:
    """Files with the journal rows of the same base name, whatever its case: an equi-join in place of a substring search."""
    base = lambda c: F.lower(F.regexp_extract(c, r"([^/\\]+)$", 1))
    j = journal.groupBy(base("path").alias("base")).agg(F.count("*").alias("rows"), F.min("us").alias("first_us"))
    return files.withColumn("base", base("name")).join(j, "base").select("record", "base", "rows", "first_us")


def without_prefetch(files: DataFrame, prefetch: DataFrame) -> DataFrame:
    """Programs that no prefetch file names: NAME.EXE is looked for as NAME."""
    key = F.upper(F.split_part("name", F.lit("."), F.lit(1)))
    have = prefetch.select(F.upper(F.split_part("name", F.lit("."), F.lit(1))).alias("key")).distinct()
    return files.filter(F.lower("name").endswith(".exe")).withColumn("key", key).join(have, "key", "left_anti").select("record", "name")


def later_snapshot(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Files with the first snapshot after their creation that lacks them: the two are merged by time in one window.

    Snapshots (us, snapshot) are few and are repeated for each directory, so that each directory is a window of its own.
    """
    dirs = files.select("dir").distinct().crossJoin(F.broadcast(snapshots.select("us", "snapshot")))
    both = files.select("dir", F.col("created_us").alias("us"), "record", F.lit(None).cast("long").alias("snapshot")).unionByName(dirs.select("dir", "us", F.lit(None).cast("long").alias("record"), F.col("snapshot").cast("long")))
    nxt = F.first(F.col("snapshot"), True).over(Window.partitionBy("dir").orderBy("us").rangeBetween(1, Window.unboundedFollowing))
    return both.withColumn("next_snapshot", nxt).filter("record is not null").select("record", "next_snapshot")


def sequence_gaps(log: DataFrame, key: str, seq: str, least: int, k: int = 10) -> DataFrame:
    """The k widest gaps of over `least` between neighbouring sequence numbers of a key."""
    gap = F.col(seq) - F.lag(seq).over(Window.partitionBy(key).orderBy(seq))
    return log.withColumn("gap", gap).filter(F.col("gap") > least).orderBy(F.desc("gap"), key, seq).limit(k)


def journal_health(journal: DataFrame, days: int = 7, rows: int = 100) -> DataFrame:
    """Whether a journal of over `rows` rows spans under `days` days, which hints at clearing."""
    s = journal.agg(F.count("*").alias("rows"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    return s.withColumn("suspicious", (F.col("rows") > rows) & (F.col("last_us") - F.col("first_us") < days * DAY))


#: Rows of a key that are given back at once.
AT_ONCE = 1 << 16


def votes(base: DataFrame, sources: dict[str, tuple[DataFrame | Column, int]], key: str = "record", parts: int | None = None) -> DataFrame:
    """Weights of the sources that hold each key added up, for every row of `base`: 6 strong, 4 moderate, 2 weak; sources as in `held`."""
    cast = reduce(lambda a, b: a + b, (F.when(F.col(f"in_{s}"), w).otherwise(0) for s, (_, w) in sources.items()))
    g = held(base, {s: of for s, (of, _) in sources.items()}, key, parts).select(key, cast.cast("long").alias("votes"), "_n")
    blocks = g.select(key, "votes", "_n", F.explode(F.expr(f"sequence(0, (_n - 1) div {AT_ONCE})")).alias("_b"))
    out = blocks.select(key, "votes", F.explode(F.expr(f"sequence(1, least({AT_ONCE}, _n - _b * {AT_ONCE}))"))).select(key, "votes")
    v = F.col("votes")
    return out.withColumn("verdict", F.when(v >= 6, "strong").when(v >= 4, "moderate").when(v >= 2, "weak").otherwise("none"))


def year_clusters(files: DataFrame, least: int = 50, share: float = 0.9) -> DataFrame:
    """Directories of `least` or more files with over `share` of them from one year."""
    y = files.groupBy("dir", F.year(F.timestamp_micros("created_us")).alias("year")).agg(F.count("*").alias("n"))
    g = y.groupBy("dir").agg(F.sum("n").alias("files"), F.max(F.struct("n", "year")).alias("m"))
    return g.filter((F.col("files") >= least) & (F.col("m.n") > share * F.col("files"))).select("dir", "files", F.col("m.year").alias("year"), F.round(F.col("m.n") / F.col("files"), 6).alias("share"))
