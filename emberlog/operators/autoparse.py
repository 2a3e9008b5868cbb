"""Parsing by line families: JSON lines first, then the family of the source's type, then the line as it is.

Entries of all kinds share one schema; what else a line holds is one variant column, an object of the line's JSON or of
the family's own fields, whose schema over mixed lines is found by aggregation. Types that write records of several lines
are joined to records first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators import detect as T
from emberlog.operators.times import event_time
from emberlog.sources import boundaries as R

_SYS = r"^(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+"
_FOUR = r"(\d{1,3}(?:\.\d{1,3}){3})"
# Families by the types that they read, given by label or code
FAMILIES = {
    "ssh": ("ssh_auth", "Linux SSHD Failed", "Linux SSHD Accepted"),
    "syslog": ("pam", "syslog", "Linux Syslog", "systemd", "kernel", "firewalld"),
    "access": ("apache", "nginx", "flask"),
    "firewall": ("iptables", "ufw", "windows_firewall"),
    "viewer": ("windows_event_viewer", "windows_application_txt", "Windows Event Viewer"),
    "security_csv": ("Windows Security CSV",),
    "application_csv": ("Windows Application CSV",),
}
# Types of several lines, by label or code
BLOCKS = {"mysql_slow": "mysql_slow", "MySQL Slow Query": "mysql_slow", "oracle_alert": "oracle_alert", "Oracle Alert": "oracle_alert", "oracle_audit": "oracle_audit", "Oracle Audit": "oracle_audit"}
# Patterns of fields of unknown lines, the first that fits
DYNAMIC = (
    ("timestamp", (r"(\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2})", r"(\d{2}/\w{3}/\d{4}:\d{2}:\d{2})", r"(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})")),
    ("ip", (r'src[_-]ip[=:]\s*"?(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})', r'dst[_-]ip[=:]\s*"?(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})', r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b")),
    ("port", (r'src[_-]port[=:]\s*"?(\d{1,5})', r'dst[_-]port[=:]\s*"?(\d{1,5})', r"port[=:]\s*(\d{1,5})\b")),
    ("user", (r'user[=:]\s*"?(\w[^"]*)"', r'username[=:]\s*"?(\w[^"]*)"')),
    ("severity", (r"\b(debug|info|notice|warn|warning|error|err|fail|fatal|critical|alert)\b",)),
)
SEVERITIES = ("debug", "info", "warning", "error", "critical")
_ENTRY = ("source_ip", "hostname", "destination_ip", "user", "action", "outcome", "severity", "message")


def _part(line: Column, pattern: str, i: int = 1) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, i), F.lit(""))


def _entry(fits: Column, fields: dict[str, Column] | None = None, **values: Column) -> Column:
    """An entry where a line fits, else null; `timestamp` is the text of its time."""
    nothing = F.lit(None).cast("string")
    parts = [values.get(n, nothing).cast("string").alias(n) for n in ("timestamp", *_ENTRY)]
    own = F.map_from_entries(F.array(*(F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in fields.items()))) if fields else F.create_map().cast("map<string,string>")
    return F.when(fits, F.struct(*parts, own.alias("fields")))


def _worded(text: Column, *words: str) -> Column:
    """The first of `words` that a text holds, else info."""
    return reduce(lambda c, w: c.when(F.contains(F.lower(text), F.lit(w)), w), words[1:], F.when(F.contains(F.lower(text), F.lit(words[0])), words[0])).otherwise("info")


def syslog(line: Column) -> Column:
    p, k = _SYS + r"[\w\-/]+\[\d+\]:\s*(.*)", _SYS + r"kernel:\s*(.*)"
    process = _entry(line.rlike(p), timestamp=_part(line, p), hostname=_part(line, p, 2), message=F.regexp_extract(line, p, 3), severity=_worded(F.regexp_extract(line, p, 3), "error", "warning", "critical"))
    return F.coalesce(process, _entry(line.rlike(k), timestamp=_part(line, k), hostname=_part(line, k, 2), message=F.regexp_extract(line, k, 3), severity=F.lit("info")))


def ssh(line: Column) -> Column:
    forms = ((r"Failed\s+password\s+for\s+(?:invalid\s+user\s+)?", "failure"), (r"Accepted\s+password\s+for\s+", "success"), (r"Accepted\s+publickey\s+for\s+", "success"))
    found = []
    for words, outcome in forms:
        p = rf"{_SYS}sshd\[\d+\]:\s+{words}(\S+)\s+from\s+{_FOUR}\s+port\s+(\d+)"
        severity = F.lit("warning" if outcome == "failure" else "info")
        found.append(_entry(line.rlike(p), timestamp=_part(line, p), hostname=_part(line, p, 2), user=_part(line, p, 3), source_ip=_part(line, p, 4), action=F.lit("login"), outcome=F.lit(outcome), severity=severity, message=line))
    return F.coalesce(*found)


def access(line: Column) -> Column:
    """Lines that write status and size right behind the time."""
    p = r'^(\S+)\s+-\s+-\s+\[(.*?)\]\s+"(\d+)\s+(\d+)'
    status = F.regexp_extract(line, p, 3).try_cast("long")
    return _entry(line.rlike(p), timestamp=_part(line, p, 2), source_ip=_part(line, p), severity=F.when(status >= 500, "error").when(status >= 400, "warning").otherwise("info"), message=line)


def firewall(line: Column) -> Column:
    p = rf"SRC={_FOUR}\s+DST={_FOUR}"
    stopped = line.rlike("DROP|BLOCK")
    pick = lambda a, b: F.when(stopped, a).otherwise(b)
    return _entry(line.rlike(p), source_ip=_part(line, p), destination_ip=_part(line, p, 2), action=pick("firewall_block", "firewall_allow"), outcome=pick("blocked", "allowed"), severity=pick("warning", "info"), message=line)


def viewer(line: Column) -> Column:
    p = r"^(Audit (?:Success|Failure|Error|Warning)|Success|Failure|Error|Warning)\s+(\d{2})-(\d{2})-(\d{4})\s+(\d{2}:\d{2}:\d{2})\s+(.*)"
    status = F.regexp_extract(line, p, 1)
    time = F.concat_ws("", F.regexp_extract(line, p, 4), F.lit("-"), F.regexp_extract(line, p, 2), F.lit("-"), F.regexp_extract(line, p, 3), F.lit("T"), F.regexp_extract(line, p, 5), F.lit("Z"))
    severity = F.when(status.isin("Error", "Failure"), "error").when(status.isin("Warning", "Audit Failure"), "warning").otherwise("info")
    return _entry(line.rlike(p), timestamp=time, message=F.regexp_extract(line, p, 6), severity=severity)


def comma_rows(line: Column, security: bool) -> Column:
    """Rows of event exports split at plain commas; rows of the security log are told by their fourth column too."""
    cut = F.split(line, ",")
    at = lambda i: F.trim(F.get(cut, F.lit(i)))
    level = F.lower(at(2))
    severity = F.when(level.isin("error", "failure", "audit failure"), "error").when(level == "warning", "warning").otherwise("info")
    fits = ~line.rlike("^(?:TimeCreated|EventID|Level),") & (F.size(cut) >= 6)
    of = {"event_id": at(1), "level": level, "log_name": at(3), "machine_name": at(4)}
    own = fits if security else fits & (F.get(cut, F.lit(3)) == "Security")
    rows = _entry(own, of | {"logon_type": F.coalesce(at(7), F.lit(""))}, timestamp=at(0), message=at(5), user=at(6), source_ip=at(8), severity=severity)
    return rows if security else F.coalesce(rows, _entry(fits, of | {"provider_name": at(5)}, timestamp=at(0), message=F.coalesce(at(6), line), severity=severity))


def slow_query(block: Column) -> Column:
    who = r"# User@Host: (\w+)\[(\w+)\] @ (\S+) \[(.*?)\]"
    cost = r"(?m)# Query_time: ([\d.]+).*Rows_examined: (\d+)"
    sql = F.trim(F.regexp_extract(block, r"(?s)\n(.*?);$", 1))
    of = {"user": _part(block, who), "host": _part(block, who, 3), "ip": _part(block, who, 4), "query_time": _part(block, cost), "rows_examined": _part(block, cost, 2), "sql": sql}
    return _entry(block.rlike(r"# Time: \S+") & block.rlike(r"(?s)\n(.*?);$"), of, timestamp=_part(block, r"# Time: (\S+)"), hostname=of["host"], source_ip=of["ip"], user=of["user"], severity=F.lit("warning"), message=F.concat(F.lit("Slow query: "), F.left(sql, F.lit(200))))


def alert_block(block: Column) -> Column:
    time = r"^([A-Za-z]{3}\s+[A-Za-z]{3}\s+\d+\s+\d{2}:\d{2}:\d{2}\s+\d{4})"
    text = F.trim(F.regexp_extract(block, r"(?s)^[^\n]*\n(.*)$", 1))
    high = F.upper(text)
    severity = F.when(F.contains(text, F.lit("ORA-")) | F.contains(high, F.lit("ERROR")), "error").when(F.contains(high, F.lit("WARNING")), "warning").otherwise("info")
    of = {"error_code": _part(text, r"ORA-(\d+):\s*(.+)"), "error_message": F.trim(_part(text, r"ORA-(\d+):\s*(.+)", 2)), "full_message": text}
    return _entry(block.rlike(time) & F.contains(block, F.lit("\n")), of, timestamp=_part(block, time), severity=severity, message=F.left(text, F.lit(500)))


def audit_block(block: Column) -> Column:
    action, user = F.trim(_part(block, r"ACTION:\s*'([^']+)'")), F.trim(_part(block, r"DATABASE USER:\s*'([^']+)'"))
    text = F.coalesce(F.concat(F.lit("Oracle audit: "), action, F.lit(" by "), user), F.lit("Oracle audit entry"))
    return _entry(block.rlike(r"TIMESTAMP:\s*\S+") & action.isNotNull(), {"action": action, "user": user}, timestamp=_part(block, r"TIMESTAMP:\s*(\S+)"), user=user, action=action, severity=F.lit("info"), message=text)


def json_entry(line: Column) -> Column:
    """An object on a line; of several names of a value the first that is neither missing nor empty counts."""
    v = F.try_parse_json(line)
    get = lambda *names: F.coalesce(*(F.nullif(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")) for n in names))
    return _entry(
        F.json_object_keys(line).isNotNull(), timestamp=get("timestamp", "time", "date"), source_ip=get("source_ip", "sourceIp"), user=get("user", "username"), action=get("action"), outcome=get("outcome", "status"),
        severity=F.coalesce(get("severity", "level"), F.lit("info")), message=line,
    )


def dynamic_fields(line: Column) -> Column:
    """Fields of a line of unknown format as a map, and no key for what it lacks."""
    found = [F.struct(F.lit(n).alias("k"), F.coalesce(*(_part(line, f"(?i){p}") for p in patterns)).alias("v")) for n, patterns in DYNAMIC]
    return F.map_from_entries(F.filter(F.array(*found), lambda p: p["v"].isNotNull()))


def dynamic_severity(fields: Column) -> Column:
    low = F.lower(fields["severity"])
    return F.when(low.isin(*SEVERITIES), low).otherwise("unknown")


PARSERS = {
    "ssh": ssh, "syslog": syslog, "access": access, "firewall": firewall, "viewer": viewer, "security_csv": lambda line: comma_rows(line, True), "application_csv": lambda line: comma_rows(line, False),
    "mysql_slow": slow_query, "oracle_alert": alert_block, "oracle_audit": audit_block,
}


def _kind(label: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The name in `table` whose members hold a type's label or code."""
    code = T.log_code(label)
    of = F.create_map(*(F.lit(x) for name, members in table.items() for m in members for x in (m, name)))
    return F.coalesce(of[label], of[code])


def blocks_of(lines: DataFrame, types: DataFrame) -> DataFrame:
    """Typed lines, with those of types of several lines joined to records: (source, log_type, line_no, line, lines)."""
    kinds = {n: tuple(m for m, k in BLOCKS.items() if k == n) for n in dict.fromkeys(BLOCKS.values())}
    typed = lines.join(types.select("source", "log_type"), "source").withColumn("block", _kind(F.col("log_type"), kinds))
    out = typed.filter("block is null").select("source", "log_type", "line_no", F.regexp_replace("line", r"^\s+|\s+$", "").alias("line"), F.lit(1).alias("lines"), "block").filter("line <> ''")
    names = types.select("source", "log_type")
    for name in kinds:
        found = R.records(typed.filter(F.col("block") == name).select("source", "line_no", "line"), R.RULES[name]).join(names, "source")
        out = out.unionByName(found.select("source", "log_type", "line_no", "line", F.size(F.split("line", "\n")).alias("lines"), F.lit(name).alias("block")))
    return out


def auto_parse(lines: DataFrame, types: DataFrame, near: Column | None = None) -> DataFrame:
    """Entries of lines (source, line_no, line) of sources of known type (source, log_type).

    An entry has its source, type, place, time, addresses, user, action, outcome, severity, message of 1,000 characters at
    most, the variant `fields`, `parsed`, and the number of lines that it is made of. A line that nothing reads is its own
    message. Times are those of the line where its text has none; a line without any has none.
    """
    near = F.current_timestamp() if near is None else near
    typed = blocks_of(lines, types).withColumn("family", F.coalesce("block", _kind(F.col("log_type"), FAMILIES)))
    line = F.col("line")
    family = reduce(lambda c, x: c.when(F.col("family") == x[0], x[1](line)), list(PARSERS.items())[1:], F.when(F.col("family") == next(iter(PARSERS)), PARSERS[next(iter(PARSERS))](line)))
    read = typed.withColumn("_json", F.when(F.col("block").isNull(), json_entry(line))).withColumn("_e", F.coalesce("_json", family))
    own = F.create_map(F.lit("timestamp"), F.col("_e.timestamp"))
    fields = F.when(F.col("_json").isNotNull(), F.try_parse_json(line)).otherwise(F.to_variant_object(F.coalesce("_e.fields", F.create_map().cast("map<string,string>"))))
    message = F.left(F.coalesce("_e.message", line), F.lit(1000))
    return read.select(
        "source", "log_type", "line_no", event_time(line, own, near).alias("event_ts"), *(F.col(f"_e.{c}").alias(c) for c in _ENTRY[:-2]), F.coalesce("_e.severity", F.lit("info")).alias("severity"),
        message.alias("message"), fields.alias("fields"), F.col("_e").isNotNull().alias("parsed"), "lines", line.alias("raw"),
    )


def field_schemas(entries: DataFrame) -> DataFrame:
    """The schema of each source's mixed fields, merged over its lines."""
    return entries.groupBy("source").agg(F.schema_of_variant_agg("fields").alias("schema"))


def parse_stats(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Per source: its type, lines in all (blank ones too), failed ones, and the rounded share of the others in percent."""
    all_ = lines.groupBy("source").agg(F.count("*").alias("total_lines"))
    bad = entries.groupBy("source", "log_type").agg(F.sum(F.when(F.col("parsed"), 0).otherwise(F.col("lines"))).alias("failed_lines"))
    out = all_.join(bad, "source", "left").withColumn("failed_lines", F.coalesce("failed_lines", F.lit(0)).cast("long"))
    rate = F.bround((F.col("total_lines") - F.col("failed_lines")) / F.col("total_lines") * 100).cast("long")
    return out.select("source", F.coalesce("log_type", F.lit("unknown")).alias("log_type"), "total_lines", (F.col("total_lines") - F.col("failed_lines")).alias("parsed_lines"), "failed_lines", rate.alias("success_rate"))
