"""The named requests over one set of entries, and the routing of plain-language requests to them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators import correlation, detections, filters, stats

# Words of a request and the data that they ask for, the first match wins
INTENTS = (("chain", "attack_chains"), ("correlat", "correlate"), ("predict", "predictions"), ("timeline|over time", "timeline"), ("alert", "alerts"), ("top.*(ip|source)", "top_sources"), ("top.*user", "top_users"), ("stat|summary|overview", "stats"), ("anomal|attack", "attacks"))


class Engine:
    """Lazy views of entries (id, us, ip, user, port, action, outcome, severity, log_type, attack_type, ...)."""

    def __init__(self, entries: DataFrame):
        self.data = entries

    def stats(self) -> DataFrame:
        return stats.counts(self.data)

    def timeline(self, minutes: int = 1) -> DataFrame:
        return stats.minute_timeline(self.data, minutes)

    def attack_chains(self) -> DataFrame:
        return correlation.chains_of(self.data, "ip")

    def attacks(self, kind: str = "any") -> DataFrame:
        return filters.attack_filter(self.data, kind)

    def alerts(self) -> DataFrame:
        """(rule, ip, evidence) of the grouped rules."""
        p = detections.ip_profile(self.data)
        rules = {"port_scan": detections.port_scan(p).select("ip", F.col("ports").alias("evidence")), "brute_force": detections.brute_force(p).select("ip", F.col("failed").alias("evidence")), "credential_stuffing": detections.credential_stuffing(p).select("ip", F.col("users").alias("evidence"))}
        every = None
        for name, df in rules.items():
            df = df.select(F.lit(name).alias("rule"), "ip", "evidence")
            every = df if every is None else every.unionByName(df)
        return every

    def entries(self, severity: str | None = None, log_type: str | None = None, attack_type: str | None = None, limit: int | None = 100) -> DataFrame:
        """Entries that pass the given criteria; a limit of None gives all."""
        given = [filters.Filter(c, op, v) for c, op, v in (("severity", "equals", severity), ("log_type", "contains", log_type), ("attack_type", "equals", attack_type)) if v]
        out = filters.apply_filters(self.data, given)
        return filters.newest(out, limit) if limit else out

    def top_sources(self, k: int = 10) -> DataFrame:
        return stats.top(self.data, "ip", k)

    def top_users(self, k: int = 10) -> DataFrame:
        return stats.top(self.data, "user", k)

    @staticmethod
    def parse(lines: DataFrame, near=None) -> Engine:
        """An engine over lines (source, line_no, line): detected, parsed, normalised and labelled."""
        from emberlog.operators import detect, labels

        e = detect.normalise(detect.parse(lines, detect.detect(lines)), near=near)
        kind, confidence = labels.attack_label(F.col("message"))
        e = e.withColumns({"us": F.unix_micros("event_ts"), "attack_type": F.nullif(kind, F.lit("safe")), "confidence": confidence})
        return Engine(e)

    def predictions(self, floor: float = 0.3) -> DataFrame:
        """(id, attack_type, confidence) of entries whose attack is at least as sure as `floor`."""
        return self.data.filter(F.col("attack_type").isNotNull() & (F.col("confidence") >= floor)).select("id", "attack_type", "confidence")

    def correlate(self, column: str = "ip", least: int = 2) -> DataFrame:
        """Values of a column that `least` or more attacks share: their number, kinds, first and last time, surest first."""
        g = self.data.filter("attack_type is not null").groupBy(column).agg(F.count("*").alias("attacks"), F.array_sort(F.collect_set("attack_type")).alias("kinds"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max("confidence").alias("confidence"))
        return g.filter(F.col("attacks") >= least).orderBy(F.desc("attacks"), column)

    def analyze(self, text: str) -> DataFrame:
        """One row for one line: its type, fields, normalised entry and attack."""
        spark = self.data.sparkSession
        return Engine.parse(spark.createDataFrame([("line", 0, text)], "source string, line_no long, line string")).data

    def ask(self, request: str) -> DataFrame:
        """The named data that a request asks for, else the entries that its words select."""
        name = next((n for words, n in INTENTS if re.search(words, request.lower())), None)
        return getattr(self, name)() if name else filters.apply_filters(self.data, filters.criteria(request))
