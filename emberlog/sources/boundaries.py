"""Records of several lines: which line opens one, and which record each line belongs to.

A rule reads a file as an automaton of two states. Every line either sets the state, whatever it was, or keeps it; so the
state before a line is what the last line that set one has left, and no loop over the file is needed. Files are cut into
blocks of lines. Each block says, for either state that it may begin in, how many records it opens and which state it
ends in; these few rows are combined in order, and every line then gets its record from its own block alone. Neither a
window nor a task spans a file.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a block.
BLOCK = 1 << 18


class Rule(NamedTuple):
    #: The state, 0 or 1, that a line leaves; null if it keeps the one before it.
    sets: Callable[[Column], Column]
    #: Whether a line opens a record, by the line and the state before it.
    opens: Callable[[Column, Column], Column]
    #: Whether a line belongs to a record at all.
    holds: Callable[[Column, Column], Column]
    #: The state before the first line.
    start: int = 0
    #: Whether lines are stripped of blanks before they are joined.
    strip: bool = False


def _any(*patterns: str) -> Callable[[Column], Column]:
    return lambda line: line.rlike("|".join(f"(?:{p})" for p in patterns))


# How a line begins that opens an entry
_OPENS = _any(
    r"^\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}",
    r"^\d{10,13}(?:\.\d+)?\s",
    r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}",
    r"^(?i:DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL|TRACE)\s*[\[:\-]",
    r"^\[\d{4}[-/]\d{2}[-/]\d{2}",
    r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\s+\S+\s+\S+\s+\[",
    r'^\{\s*"(?:timestamp|time|ts|date)"\s*:',
    r"^(?i:\d{4}[-\d\s:]+,(?:\d+,)?(?:Information|Warning|Error|Success|Failure|Audit|Info))",
    r"^TimeCreated,EventID,",
)
_STAMPED = _any(r"^[A-Za-z]{3}\s+[A-Za-z]{3}\s+\d+\s+\d{2}:\d{2}:\d{2}\s+\d{4}$")


def _blank(line: Column) -> Column:
    return ~line.rlike(r"\S")


def _text(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


_timed = lambda line: _text(line).startswith("# Time:")
_other = lambda line: _text(line).rlike("^#(?! Time:| User@Host:| Query_time:)")

#: Entries of unknown format: a blank line ends one, a line that looks like a beginning opens one, and so does the first
#: line after a blank one; all others continue. (To look ahead, whether an undecided line ends its entry since the next
#: one opens its own, changes nothing.)
ENTRIES = Rule(
    sets=lambda line: F.when(_blank(line), 0).otherwise(1),
    opens=lambda line, before: ~_blank(line) & (_OPENS(line) | (before == 0)),
    holds=lambda line, before: ~_blank(line),
)
#: Slow queries: a block opens with its time; a comment of another kind ends it, and what follows is left out.
SLOW_QUERIES = Rule(
    sets=lambda line: F.when(_timed(line), 1).when(_other(line), 0),
    opens=lambda line, before: _timed(line),
    holds=lambda line, before: ~_blank(line) & (_timed(line) | (before == 1) & ~_other(line)),
    start=1,
    strip=True,
)
#: Alerts: a line that is a time alone opens a block; lines before the first are left out.
ALERTS = Rule(
    sets=lambda line: F.when(_STAMPED(_text(line)), 1),
    opens=lambda line, before: _STAMPED(_text(line)),
    holds=lambda line, before: ~_blank(line) & (_STAMPED(_text(line)) | (before == 1)),
    strip=True,
)
#: Audit trails: every line is a record.
SINGLE = Rule(sets=lambda line: F.lit(0), opens=lambda line, before: ~_blank(line), holds=lambda line, before: ~_blank(line), strip=True)
RULES = {"entries": ENTRIES, "mysql_slow": SLOW_QUERIES, "mysql_slow_query": SLOW_QUERIES, "oracle_alert": ALERTS, "oracle_audit": SINGLE}


def opened_by(start: str) -> Rule:
    """A record opens at each line that matches `start`; what precedes the first is record 0."""
    return Rule(sets=lambda line: F.lit(None).cast("int"), opens=lambda line, before: line.rlike(start), holds=lambda line, before: F.lit(True))


def record_lines(lines: DataFrame, rule: Rule, block: int = BLOCK) -> DataFrame:
    """The lines (source, line_no, line, ...) that belong to records, with the number of their record in the source.

    Numbers go up by one with each record that a line opens; lines before the first have 0. `line_no` orders a source's
    lines, blank ones included where the rule asks for them; it need not be without gaps.
    """
    own = Window.partitionBy("source", "_block").orderBy("line_no")
    up_to, earlier = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    line = F.col("line")
    cut = lines.withColumn("_block", F.floor(F.col("line_no") / block)).withColumn("_sets", rule.sets(line).cast("int"))
    cut = cut.withColumn("_known", F.last("_sets", ignorenulls=True).over(earlier))
    opens = lambda state: F.sum(rule.opens(line, F.coalesce("_known", F.lit(state))).cast("long"))
    blocks = cut.groupBy("source", "_block").agg(opens(0).alias("_o0"), opens(1).alias("_o1"), F.max_by("_sets", F.when(F.col("_sets").isNotNull(), F.col("line_no"))).alias("_end"))
    order = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_in", F.coalesce(F.last("_end", ignorenulls=True).over(order), F.lit(rule.start)))
    blocks = blocks.withColumn("_opened", F.when(F.col("_in") == 0, F.col("_o0")).otherwise(F.col("_o1")))
    blocks = blocks.withColumn("_offset", F.coalesce(F.sum("_opened").over(order), F.lit(0)))
    both = cut.join(blocks.select("source", "_block", "_in", "_offset"), ["source", "_block"])
    before = F.coalesce("_known", "_in")
    both = both.withColumn("record", F.col("_offset") + F.sum(rule.opens(line, before).cast("long")).over(up_to))
    return both.filter(rule.holds(line, before)).select(*lines.columns, "record")


def records(lines: DataFrame, rule: Rule | str, block: int = BLOCK) -> DataFrame:
    """(source, record, line_no of the first line, line) with a record's lines joined; `rule` may be a pattern that opens one.

    A record without an end is one value: for files that never open a second one, use `record_lines`.
    """
    rule = opened_by(rule) if isinstance(rule, str) else rule
    line = _text(F.col("line")) if rule.strip else F.col("line")
    parts = record_lines(lines, rule, block).groupBy("source", "record").agg(F.array_sort(F.collect_list(F.struct("line_no", line.alias("line")))).alias("l"))
    return parts.select("source", "record", F.col("l")[0]["line_no"].alias("line_no"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("line"))
