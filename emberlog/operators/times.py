"""Times of log lines: the forms in which lines and fields write a time, and the year of those that leave it out.

A form is a pattern and what it makes of its groups: a time in one of two canonical writings. The forms are tried in
order, so a line costs as many pattern searches as its form stands behind the first, and one replacement.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000
_CLOCK = r"(\d{2}:\d{2}:\d{2})"
#: Behind a point, or three digits behind a comma that no further column follows.
_FRACTION = r"(?:[.,](?:(?<=\.)|(?=\d{3}\b(?!,)))(\d{1,9})\d*)?"
_MONTH = r"((?i:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec))[a-z]*"
#: A zone: an offset in hours and minutes, or a name.
_ZONE = r"(?:\s?([+-]\d{2}):?(\d{2})\b|\s?(Z|UTC|GMT|[CEMPAW][SDE]?S?T|CEST|EEST|WEST|BST|MSK|JST)\b)?"


class Form(NamedTuple):
    name: str
    pattern: str
    #: Year, month (a number or a name), day, clock, fraction, offset and named zone by the pattern's groups.
    canonical: str


# Forms of times, in order
FORMS = (
    Form("iso", rf"(\d{{4}})-(\d{{2}})-(\d{{2}})[T\s]\s*{_CLOCK}{_FRACTION}{_ZONE}", "$1-$2-$3 $4.$5|$6:$7|$8"),
    Form("access", rf"(\d{{1,2}})[/-]{_MONTH}[/-](\d{{4}})[:\s]{_CLOCK}{_FRACTION}{_ZONE}", "$3-$2-$1 $4.$5|$6:$7|$8"),
    Form("slashes", rf"(\d{{4}})/(\d{{2}})/(\d{{2}})\s+{_CLOCK}{_FRACTION}", "$1-$2-$3 $4.$5|:|"),
    Form("c", rf"{_MONTH}\s+(\d{{1,2}})\s+{_CLOCK}{_FRACTION}(?:\s+[A-Z]{{3,4}})?\s+(\d{{4}})\b", "$5-$1-$2 $3.$4|:|"),
    Form("spoken", rf"(\d{{1,2}})\s+{_MONTH}\s+(\d{{4}})\s+{_CLOCK}{_FRACTION}", "$3-$2-$1 $4.$5|:|"),
    Form("day first", rf"\b(\d{{2}})[/-](\d{{2}})[/-](\d{{4}})\s+{_CLOCK}{_FRACTION}", "$3-$2-$1 $4.$5|:|"),
    Form("split", rf"(?:date=)?(\d{{4}})-(\d{{2}})-(\d{{2}})\s+time={_CLOCK}{_FRACTION}", "$1-$2-$3 $4.$5|:|"),
    Form("short day", r"\b(\d{2})\\?/(\d{2})\\?/(\d{2}),?\s+(\d{2}:\d{2})\b", "20$3-$2-$1 $4:00.|:|"),
)
#: Without a year.
BARE = rf"\b{_MONTH}\s+(\d{{1,2}})\s+{_CLOCK}{_FRACTION}"
#: Seconds or milliseconds since 1970, at a line's start, in brackets or on their own.
EPOCH = r"(?:^|[\s(:\[=])(1\d{9})(?:(\d{3})\b|\.(\d{1,6})\d*)?(?![\d.])"


def _canonical(text: Column, pattern: str, form: str) -> Column:
    return F.regexp_replace(text, rf"(?s)^.*?{pattern}.*$", form)


def _read(canonical: Column) -> Column:
    """A canonical time: `date clock.fraction|offset|zone`."""
    parts = F.split(canonical, r"\|")
    time, offset, zone = F.regexp_replace(parts[0], r"\.$", ""), parts[1], parts[2]
    whole = F.concat(time, F.when(offset != ":", F.concat(F.lit(" "), offset)).when(zone.isin("Z", "UTC", "GMT"), " +00:00").when(zone != "", F.concat(F.lit(" "), zone)).otherwise(""))
    named = F.regexp_replace(time, r"^\d{4}-[A-Za-z]", "") != time
    forms = [f"yyyy-{month}-d HH:mm:ss[.SSSSSSSSS]{end}" for month in ("M", "MMM") for end in ("[ xxx]", "[ z]")]
    read = lambda t, i: F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in forms[i : i + 2]), F.try_to_timestamp(time, F.lit(forms[i])))
    return F.when(named, read(whole, 2)).otherwise(read(whole, 0))


def dated(text: Column) -> Column:
    """The first form with a year that a text holds, as a timestamp; null if it holds none."""
    first = reduce(lambda c, f: c.when(text.rlike(f.pattern), _canonical(text, f.pattern, f.canonical)), FORMS[1:], F.when(text.rlike(FORMS[0].pattern), _canonical(text, FORMS[0].pattern, FORMS[0].canonical)))
    return F.transform(F.array(first), _read)[0]


def bare(text: Column, near: Column) -> Column:
    """A time without a year as the last such time that is not over a day after `near`."""
    written = F.when(text.rlike(BARE), _canonical(text, BARE, "$1-$2 $3.$4"))
    years = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.year(near + F.expr("interval 1 day")) - i)

    def of(w: Column) -> Column:
        at = lambda y: F.try_to_timestamp(F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.regexp_replace(w, r"\.$", "")), F.lit("yyyy-MMM-d HH:mm:ss[.SSSSSSSSS]"))
        fits = lambda y: F.get(F.filter(F.array(at(y)), lambda t: t <= near + F.expr("interval 1 day")), F.lit(0))
        # years after the one that fits are not tried, nor any for lines without such a time
        return F.when(w.isNotNull(), F.aggregate(years, F.lit(None).cast("timestamp"), lambda found, y: F.coalesce(found, fits(y))))

    return F.transform(F.array(written), of)[0]


def epoch(text: Column) -> Column:
    """A number of seconds or milliseconds since 1970."""
    written = F.when(text.rlike(EPOCH), _canonical(text, EPOCH, "$1|$2|$3"))
    parts = F.split(written, r"\|")
    micros = F.rpad(F.concat(parts[1], parts[2]), 6, "0").try_cast("long")
    return F.timestamp_micros(parts[0].try_cast("long") * 1_000_000 + F.coalesce(micros, F.lit(0)))


def event_time(line: Column, fields: Column, near: Column) -> Column:
    """The time of a parsed line: of its field `timestamp`, of its date and time fields, or of the line.

    Times without a zone are those of the session's; a time without a year falls before `near`.
    """
    own = fields["timestamp"]
    at = F.instr(line, own)
    own = F.when(at > 0, F.substring(line, at, F.length(line))).otherwise(own)  # what follows it may be its zone
    joined = F.concat_ws(" ", fields["date"], fields["time"])
    named = F.concat_ws(" ", fields["month"], fields["day"], fields["time"], fields["year"])
    texts = F.filter(F.array(own, F.when(fields["date"].isNotNull() & fields["time"].isNotNull(), joined), F.when(fields["month"].isNotNull() & fields["year"].isNotNull(), named), line), lambda t: t.isNotNull())
    # texts after the one that holds a time are not searched
    return F.aggregate(texts, F.lit(None).cast("timestamp"), lambda found, t: F.coalesce(found, dated(t), bare(t, near), epoch(t)))
