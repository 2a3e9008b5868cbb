"""Nested descriptors `(NAME=(NAME=value)(NAME=(NAME=value)))` as one map of dotted names, by a fold over brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STATE = "struct<path: array<string>, token: string, found: array<struct<k: string, v: string>>>"


def _step(s: Column, t: Column) -> Column:
    """One bracket or text between brackets: an opening names its level by the text ahead, a closing gives that text's pair."""
    path, token, found = s["path"], s["token"], s["found"]
    named = F.lower(F.regexp_extract(token, r"(\w+)=\s*$", 1))
    own = F.when((named != "") & (F.size(path) > 0), F.concat(F.slice(path, 1, F.size(path) - 1), F.array(named))).otherwise(path)
    key, value = F.lower(F.regexp_extract(token, r"^\s*(\w+)=", 1)), F.regexp_extract(token, r"^\s*\w+=(.*)$", 1)
    above = F.when(F.size(path) > 0, F.slice(path, 1, F.size(path) - 1)).otherwise(path)
    name = F.array_join(F.filter(F.concat(above, F.array(key)), lambda p: p != ""), ".")
    more = F.when((key != "") & (F.trim(value) != ""), F.concat(found, F.array(F.struct(name.alias("k"), F.trim(value).alias("v"))))).otherwise(found)
    return (
        F.when(t == "(", F.struct(F.concat(own, F.array(F.lit(""))).alias("path"), F.lit("").alias("token"), found.alias("found")))
        .when(t == ")", F.struct(above.alias("path"), F.lit("").alias("token"), more.alias("found")))
        .otherwise(F.struct(path.alias("path"), t.alias("token"), found.alias("found")))
        .cast(_STATE)
    )


def descriptor(text: Column) -> Column:
    """Dotted lower-case names and values of all descriptors of a text; of a name given twice the first value counts.

    A closing bracket too many is passed over; what is never closed gives the pairs that were. Null for null.
    """
    start = F.struct(F.array().cast("array<string>").alias("path"), F.lit("").alias("token"), F.array().cast("array<struct<k: string, v: string>>").alias("found")).cast(_STATE)
    pairs = F.aggregate(F.regexp_extract_all(text, F.lit(r"([()]|[^()]+)"), 1), start, _step)["found"]

    def first(own: Column) -> Column:
        return F.map_from_entries(F.transform(F.array_distinct(F.transform(own, lambda p: p["k"])), lambda k: F.get(F.filter(own, lambda p: p["k"] == k), F.lit(0))))

    return F.get(F.transform(F.array(pairs), first), F.lit(0))


def listener(line: Column) -> Column:
    """A listener's line as a map: time, the connect data's service, program, host and user, the address and the result."""
    part = lambda p, i=1: F.regexp_extract(line, p, i)
    done, time = r"\*\s+(establish|accept|reject|update)\s+\*\s+(\S+)", part(r"^(\d{2}-\w{3}-\d{4}\s+\d{2}:\d{2}:\d{2})\s+\*")

    def named(d: Column) -> Column:
        values = {
            "timestamp": time, "protocol": d["address.protocol"], "host": d["address.host"], "port": d["address.port"], "service_name": d["connect_data.service_name"],
            "cid_program": F.coalesce(d["connect_data.cid.program"], d["connect_data.cid_program"]), "cid_host": F.coalesce(d["connect_data.cid.host"], d["connect_data.cid_host"]),
            "cid_user": F.coalesce(d["connect_data.cid.user"], d["connect_data.cid_user"]), "action": part(done), "service": part(done, 2), "result": part(r"\*\s+(\d+)\s*$"),
        }
        return F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in values.items())), lambda p: p["v"] != ""))

    # the descriptors are read once, however many of their names are looked up
    return F.when(time != "", F.get(F.transform(F.array(descriptor(line)), named), F.lit(0)))
