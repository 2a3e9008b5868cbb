"""Structured filters, searches and paging over entries."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATIONS = ("equals", "notEquals", "contains", "startsWith", "endsWith", "greaterThan", "lessThan")


@dataclass(frozen=True)
class Filter:
    """One criterion: a dotted column path, an operation and a value."""

    column: str
    operation: str
    value: object

    def condition(self) -> Column:
        """Case-insensitive for strings, numeric for comparisons; a missing or non-numeric value doesn't pass."""
        if self.operation not in OPERATIONS:
            raise ValueError(f"unknown operation {self.operation!r}; known: {', '.join(OPERATIONS)}")
        c, v = F.col(self.column), str(self.value).lower()
        text = F.lower(c.cast("string"))
        if self.operation in ("greaterThan", "lessThan"):
            n = c.cast("string").try_cast("double")
            return n > float(v) if self.operation == "greaterThan" else n < float(v)
        return {"equals": text == v, "notEquals": text != v, "contains": text.contains(v), "startsWith": text.startswith(v), "endsWith": text.endswith(v)}[self.operation]


def apply_filters(df: DataFrame, filters: list[Filter]) -> DataFrame:
    """Rows that pass all filters."""
    return df.filter(reduce(lambda a, b: a & b, (f.condition() for f in filters), F.lit(True)))


def attack_filter(df: DataFrame, kind: str = "any") -> DataFrame:
    c = F.col("attack_type")
    return df.filter(c.isNotNull() & (c != "normal") if kind == "any" else c == kind)


def search(df: DataFrame, words: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows with the words in any of the columns, whatever the case."""
    return df.filter(reduce(lambda a, b: a | b, (F.lower(F.col(c).cast("string")).contains(words.lower()) for c in columns)))


def newest(df: DataFrame, most: int = 100) -> DataFrame:
    return df.orderBy(F.desc("us"), F.desc("id")).limit(most)


def page(df: DataFrame, number: int, size: int = 500) -> DataFrame:
    """Rows of one page in order of time; pages count from 0."""
    return df.orderBy("us", "id").offset(number * size).limit(size)


_ATTACK_WORDS = (("brute", "bruteforce"), ("sql_inj", "sql_injection"), ("sql inj", "sql_injection"), ("scan", "port_scan"), ("xss", "xss_attack"))
# Severities and log types that a request may name, the first that it holds
SEVERITIES = ("critical", "error", "warning", "info", "debug")
LOG_TYPES = ("apache", "nginx", "ssh", "mysql", "postgresql", "windows", "firewall", "dns")
HOUR = 3_600_000_000


def criteria(prompt: str, now_us: int | None = None) -> list[Filter]:
    """Filters for a plain request: the first ip, an attack word, the first severity and log type that it holds, `recent`
    (the hour before `now_us`, or the present), `user X` and `failed`. An attack without a kind asks for any.
    """
    low, out = prompt.lower(), []
    if m := re.search(r"\b(?:\d{1,3}\.){3}\d{1,3}\b", low):
        out.append(Filter("ip", "equals", m[0]))
    if hit := next((t for w, t in _ATTACK_WORDS if w in low), None):
        out.append(Filter("attack_type", "equals", hit))
    elif any(w in low for w in ("attack", "ml", "detected")):
        out.append(Filter("attack_type", "notEquals", "normal"))
    if hit := next((s for s in SEVERITIES if s in low), None):
        out.append(Filter("severity", "equals", hit))
    if hit := next((t for t in LOG_TYPES if t in low), None):
        out.append(Filter("log_type", "contains", hit))
    if "recent" in low or "latest" in low:
        out.append(Filter("us", "greaterThan", (time.time_ns() // 1000 if now_us is None else now_us) - HOUR))
    if m := re.search(r"\buser\s+(\w+)", low) or re.search(r"\busername\s+(\w+)", low):
        out.append(Filter("user", "equals", m[1]))
    if "failed" in low or "failure" in low:
        out.append(Filter("outcome", "equals", "failure"))
    return out


def counted(df: DataFrame, filters: list[Filter], most: int = 100) -> tuple[DataFrame, DataFrame]:
    """The newest `most` rows that pass, and one row of counts: rows in all and rows that pass."""
    passed = reduce(lambda a, b: a & b, (f.condition() for f in filters), F.lit(True))
    counts = df.agg(F.count("*").alias("total"), F.count_if(F.coalesce(passed, F.lit(False))).alias("filtered"))
    return newest(df.filter(passed), most), counts
