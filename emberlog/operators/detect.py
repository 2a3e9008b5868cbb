"""Detection of each source's log type by a two-phase vote, and parsing of lines into one map of fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.registry import DETECTORS, DISPATCH, LOG_CODES, PARSERS, Detector, Parser
from emberlog.operators import sized
from emberlog.operators.times import event_time

RAW = "Custom / Raw"
SAMPLE, FIRST = 100, 10


def matches(line: Column, d: Detector) -> Column:
    """Whether a line is one of the detector's."""
    if d.keys == ("",):
        return F.coalesce(F.json_array_length(line) > 0, F.lit(False))
    if d.keys:
        have = F.json_object_keys(line)
        return F.coalesce(reduce(lambda a, b: a & b, (F.array_contains(have, k) for k in d.keys)), F.lit(False))
    return line.rlike("^(?:" + d.pattern + ")")


def labels_of(line: Column, detectors: tuple[Detector, ...] = DETECTORS) -> Column:
    """Ordinals of the detectors that match a line."""
    return F.array_compact(F.array(*(F.when(matches(line, d), i) for i, d in enumerate(detectors))))


def any_json(detectors: tuple[Detector, ...] = DETECTORS) -> tuple[Detector, ...]:
    """The detectors by which every JSON object counts, twice, as a MongoDB server's, ahead of all that look at its keys."""
    mongo = next(d for d in detectors if d.label == "MongoDB Server")
    rest = [d for d in detectors if d is not mongo]
    first = next((i for i, d in enumerate(rest) if d.keys), len(rest))
    return (*rest[:first], Detector(mongo.label, r"\{.*\}\s*$", mongo.weight), *rest[first:])


def log_code(label: Column) -> Column:
    """The code of a detected label, `raw` if it has none."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in LOG_CODES.items() for x in p)), label), F.lit("raw"))


def detect(lines: DataFrame, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """(source, log_type, score) of lines (source, line_no, line): all labels of the first ten lines score 3 each; of the
    next ninety, the first label among those candidates scores 3; the best wins, ties by priority."""
    w = Window.partitionBy("source").orderBy("line_no")
    head = lines.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= SAMPLE).withColumn("m", labels_of(F.trim("line"), detectors))
    weight = F.array(*(F.lit(d.weight) for d in detectors))
    one = head.filter(F.col("r") <= FIRST).select("source", F.explode("m").alias("i")).groupBy("source", "i").agg((3 * F.count("*")).alias("s"))
    one = one.withColumn("s", F.col("s") * F.element_at(weight, F.col("i") + 1))
    every = F.sequence(F.lit(0), F.lit(len(detectors) - 1))
    among = one.groupBy("source").agg(F.collect_set("i").alias("c"))
    rest = head.filter(F.col("r") > FIRST).join(among, "source", "left").select("source", F.array_min(F.array_intersect("m", F.coalesce("c", every))).alias("i"))
    two = rest.groupBy("source", F.coalesce("i", F.lit(len(detectors))).alias("i")).agg(F.sum(F.when(F.col("i").isNull(), 1).otherwise(3)).alias("s"))
    best = one.unionByName(two).groupBy("source", "i").agg(F.sum("s").alias("s")).groupBy("source").agg(F.max(F.struct("s", (-F.col("i")).alias("o"))).alias("b"))
    names = F.array(*(F.lit(d.label) for d in detectors), F.lit(RAW))
    found = best.filter(F.col("b.s") >= 3).select("source", F.element_at(names, 1 - F.col("b.o")).alias("log_type"), F.col("b.s").alias("score"))
    return lines.select("source").distinct().join(found, "source", "left").select("source", F.coalesce("log_type", F.lit(RAW)).alias("log_type"), F.coalesce("score", F.lit(0)).cast("long").alias("score"))


def fields_of(line: Column, parser: Parser) -> Column:
    """The parser's fields of a line as a map, null if it doesn't match; unmatched groups are left out."""
    if parser.paths:
        values = [F.get_json_object(line, p) for p in parser.paths]
        fits = F.json_object_keys(line).isNotNull() if not parser.paths[0].startswith("$[0]") else F.get_json_object(line, "$[0][0]").isNotNull()
    elif parser.columns:
        cut = F.split(line, ",")
        values = [F.trim(F.get(cut, F.lit(i))) for i in range(len(parser.fields))]
        fits = line.rlike("^(?:" + parser.pattern + ")") & (F.size(cut) >= parser.columns)
    else:
        return F.when(line.rlike("^(?:" + parser.pattern + ")"), _groups(line, parser))
    pairs = F.array(*(F.struct(F.lit(n).alias("k"), v.alias("v")) for n, v in zip(parser.fields, values)))
    return F.when(fits, F.map_from_entries(F.filter(pairs, lambda p: p["v"] != "")))


#: Stands between the groups of a pattern; lines that hold it are searched once for each group.
CUT = "\x1f"


def _groups(line: Column, parser: Parser) -> Column:
    """The groups of a line that a parser's pattern fits, as a map, by one search for all of them."""

    def fields(values: list[Column]) -> Column:
        pairs = F.array(*(F.struct(F.lit(n).alias("k"), v.alias("v")) for n, v in zip(parser.fields, values)))
        return F.map_from_entries(F.filter(pairs, lambda p: p["v"] != ""))

    start, at = "^(?:" + parser.pattern + ")", range(len(parser.fields))
    each = fields([F.regexp_extract(line, start, i + 1) for i in at])
    cut = F.split(F.regexp_replace(line, start + r"[\s\S]*", CUT.join(f"${i + 1}" for i in at)), CUT, -1)
    once = F.transform(F.array(cut), lambda c: fields([F.get(c, F.lit(i)) for i in at]))[0]
    return F.when(F.contains(line, F.lit(CUT)), each).otherwise(once)


# Forms of pairs, of addresses and of other fields that lines hold, in order; the first value of a key wins
PAIRS = (r"(\w+)=([^,\s]+)", r"(\w+):\s*([^,\s]+)", r'"(\w+)":\s*"([^"]+)"', r'"(\w+)":\s*(\d+)')
OTHER_FIELDS = (
    ("src_ip", r"(?i)SRC[=_]((?:\d{1,3}\.){3}\d{1,3})"), ("dst_ip", r"(?i)DST[=_]((?:\d{1,3}\.){3}\d{1,3})"), ("src_ip", r"(?i)from\s+((?:\d{1,3}\.){3}\d{1,3})"),
    ("dst_ip", r"(?i)to\s+((?:\d{1,3}\.){3}\d{1,3})"), ("ip", r"((?:\d{1,3}\.){3}\d{1,3})"),
    ("user", r"(?i)user[=:\s]+(\w+)"), ("user", r"(?i)account[=:\s]+(\w+)"), ("user", r"(?i)for\s+(\S+)\s+from"),
    ("status", r"\s(\d{3})\s"), ("status", r"status[=:](\d+)"), ("method", r"(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)"), ("service", r"((?!\d+\b)\w+)(?:\[\d+\])?:"),
)


def generic_fields(line: Column) -> Column:
    """Pairs in four forms, addresses, user, status, method and service of lines that no parser reads.

    The form `name: value` is read as it stands, so a clock gives keys of digits; they are dropped.
    """
    found = [F.arrays_zip(F.transform(F.regexp_extract_all(line, F.lit(p), 1), lambda k: F.lower(k)).alias("k"), F.regexp_extract_all(line, F.lit(p), 2).alias("v")) for p in PAIRS]
    found = [F.transform(x, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"))) for x in found]
    other = F.array(*(F.struct(F.lit(n).alias("k"), F.regexp_extract(line, p, 1).alias("v")) for n, p in OTHER_FIELDS))
    found = [F.filter(x, lambda p: ~p["k"].rlike(r"^\d+(?:t\d+)?$")) for x in found]
    every = F.concat(*found, F.filter(other, lambda p: p["v"] != ""))
    first = F.transform(F.array_distinct(F.transform(every, lambda p: p["k"])), lambda k: F.struct(k.alias("k"), F.get(F.filter(every, lambda p: p["k"] == k), F.lit(0))["v"].alias("v")))
    return F.map_from_entries(first)


def parsers_for(label: Column, parsers: tuple[Parser, ...] = PARSERS) -> dict[tuple[str, ...], Column]:
    """Chains of parsers and the condition on the label that selects each: equal to a name of the table, or else holding one."""
    by_name = {p.label for p in parsers}
    table = [(n, tuple(x for x in c if x in by_name)) for n, c in DISPATCH.items()]
    table = [(n, c) for n, c in table if c]
    exact = reduce(lambda c, x: c.when(label == x[0], x[0]), table[1:], F.when(label == table[0][0], table[0][0]))
    part = reduce(lambda c, x: c.when(F.lower(label).contains(x[0].lower()), x[0]), table[1:], F.when(F.lower(label).contains(table[0][0].lower()), table[0][0]))
    name = F.coalesce(exact, part)
    chains: dict[tuple[str, ...], list[str]] = {}
    for n, c in table:
        chains.setdefault(c, []).append(n)
    return {c: name.isin(*names) for c, names in chains.items()}


def parse(lines: DataFrame, types: DataFrame, parsers: tuple[Parser, ...] = PARSERS) -> DataFrame:
    """Lines with log_type, log_code and fields: the parsers of the source's type first, then generic fields."""
    spec, line, chains = {p.label: p for p in parsers}, F.col("line"), parsers_for(F.col("log_type"), parsers)
    which = F.coalesce(*(F.when(cond, i) for i, cond in enumerate(chains.values())))
    kinds = types.select("source", "log_type", which.alias("_chain"), log_code(F.col("log_type")).alias("_code"))  # one row a source
    # a shuffle would bring all lines of a source into one task
    few = not lines.isStreaming and lines.select("source").distinct().limit(sized.SMALL + 1).count() <= sized.SMALL
    typed = lines.join(F.broadcast(kinds) if few else kinds, "source")
    whens = [(F.col("_chain") == i, F.coalesce(*(fields_of(line, spec[x]) for x in chain))) for i, chain in enumerate(chains)]
    chosen = reduce(lambda c, x: c.when(*x), whens[1:], F.when(*whens[0]))
    out = typed.withColumn("_f", chosen).withColumn("parsed", F.col("_f").isNotNull()).withColumn("fields", F.coalesce("_f", generic_fields(line))).drop("_f", "_chain")
    return out.withColumnRenamed("_code", "log_code")


def normalise(parsed: DataFrame, year: int | None = None, near: Column | None = None) -> DataFrame:
    """Parsed lines as normalised entries: time, severity, source address, port, host and service, user, action, outcome, tags.

    Times without a year get the last one that does not put them over a day after `near`, a column of the lines such as
    their file's time; without it, `near` is a day before the end of `year`, or the present.
    """
    from emberlog.operators import labels as B

    if near is None:
        near = F.current_timestamp() if year is None else F.lit(f"{year}-12-30 23:59:59").cast("timestamp")
    f, line = F.col("fields"), F.col("line")
    status = F.coalesce(f["status"], f["status_code"]).try_cast("int")
    return parsed.select(
        F.sha2(F.concat_ws("\x1f", "source", "line_no", "line"), 256).alias("id"), "source", "line_no", "log_type", event_time(line, f, near).alias("event_ts"), B.severity(line).alias("severity"),
        B.source_ip(line, f).alias("ip"), B.port(line, f).alias("port"), F.coalesce(f["host"], f["hostname"]).alias("host"), f["service"].alias("service"), B.user(line, f).alias("user"),
        B.action(line, f).alias("action"), F.coalesce(f["outcome"], B.outcome(line, status)).alias("outcome"), B.tags(line, F.col("log_type")).alias("tags"), line.alias("message"), "fields",
    )
