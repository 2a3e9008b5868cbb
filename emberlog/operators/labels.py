"""Attack labels of messages by keyword rules, categories and MITRE tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.attacks import CATEGORY_ATTACKS, CHAIN_TACTICS, LOG_CATEGORIES, MITRE_IDS, ORDERED_CLASSES

# Attack type, weight, patterns (case-insensitive)
ATTACK_RULES = (
    ("bruteforce", 0.85, ("Failed password", "authentication failure", "authentication failed", "Invalid user", "too many failed attempts", "SASL.*failed")),
    ("sql_injection", 0.95, ("' OR '1'='1", r"UNION\s+SELECT", r"DROP\s+TABLE", r"INSERT\s+INTO", r"UPDATE\s+.*\s+SET", r"SELECT\s+.*\s+FROM\s+information_schema", r"SELECT\s+.*\s+FROM\s+mysql\.", r"SLEEP\(", r"BENCHMARK\(", r"WAITFOR\s+DELAY", r"OR\s+1=1", r"GROUP\s+BY\s+.*\s+HAVING")),
    ("xss_attack", 0.90, ("<script>", "javascript:", "onerror=", "onload=")),
    ("threat_intel", 0.80, ("listed by domain", "blacklist", "blocklist", "denied by policy")),
    ("spam_activity", 0.60, (r"\[SPAM\]", "blocked as spam", "spam score exceeded")),
)

# Attack type, tactic, technique
MITRE = (
    ("bruteforce", "Credential Access", "T1110"),
    ("sql_injection", "Initial Access", "T1190"),
    ("xss_attack", "Execution", "T1059"),
    ("port_scan", "Discovery", "T1046"),
    ("privilege_escalation", "Privilege Escalation", "T1068"),
)

RECOMMENDED = (
    ("bruteforce", "Lock out or slow down repeated sign-ins"),
    ("sql_injection", "Use bound parameters and filter requests"),
    ("port_scan", "Limit exposed ports and watch the source"),
)


def matches(text: Column, patterns) -> Column:
    """Whether any pattern is found, in one regular expression."""
    return text.rlike("(?i)(?:" + "|".join(patterns) + ")")


def attack_label(text: Column, rules=ATTACK_RULES) -> tuple[Column, Column]:
    """(type, confidence): the matching rule of the largest weight, the first of equals; `safe` and 0 if none matches."""
    order = sorted(rules, key=lambda r: -r[1])
    chain = lambda i, rest: reduce(lambda c, r: c.when(matches(text, r[2]), F.lit(r[i])), order[1:], F.when(matches(text, order[0][2]), F.lit(order[0][i]))).otherwise(F.lit(rest))
    return chain(0, "safe"), chain(1, 0.0)


def category_score(text: Column, weight: float, patterns) -> Column:
    """min(weight + 0.1 for each pattern found, 0.95), or 0 without any."""
    n = reduce(lambda a, b: a + b, (text.rlike("(?i)" + p).cast("int") for p in patterns))
    return F.when(n > 0, F.least(F.lit(weight) + 0.1 * n, F.lit(0.95))).otherwise(0.0)


def best_category(text: Column, configs) -> Column:
    """The struct (score, type) of the best config (type, weight, patterns), null below 0.3; the first of equals wins."""
    scored = [F.struct(F.round(category_score(text, w, ps), 4).alias("score"), F.lit(-i).alias("order"), F.lit(t).alias("type")) for i, (t, w, ps) in enumerate(configs)]
    best = F.array_max(F.array(*scored))
    return F.when(best["score"] >= 0.3, best)


def log_category(log_type: Column) -> Column:
    """The category of a detected log type by the first pattern that its name holds, else generic."""
    low = F.lower(log_type)
    return reduce(lambda c, x: c.when(low.rlike(x[1]), x[0]), LOG_CATEGORIES[1:], F.when(low.rlike(LOG_CATEGORIES[0][1]), LOG_CATEGORIES[0][0])).otherwise("generic")


def category_attack(text: Column, category: Column) -> Column:
    """The struct (score, type) of the best attack among those of the row's category, null if none is found."""
    of: dict[str, list] = {}
    for name, kind, weight, patterns in CATEGORY_ATTACKS:
        of.setdefault(name, []).append((kind, weight, patterns))
    whens = [(category == name, best_category(text, configs)) for name, configs in of.items()]
    return reduce(lambda c, x: c.when(*x), whens[1:], F.when(*whens[0]))


def ordered_class(text: Column, configs=ORDERED_CLASSES) -> tuple[Column, Column]:
    """The first type with a match and min(0.5 + 0.15 matches, 0.95)."""
    n = [reduce(lambda a, b: a + b, (text.rlike("(?i)" + p).cast("int") for p in ps)) for _, ps in configs]
    kind = reduce(lambda c, x: c.when(x[1] > 0, x[0][0]), list(zip(configs, n))[1:], F.when(n[0] > 0, configs[0][0]))
    conf = reduce(lambda c, x: c.when(x > 0, F.least(0.5 + 0.15 * x, F.lit(0.95))), n[1:], F.when(n[0] > 0, F.least(0.5 + 0.15 * n[0], F.lit(0.95))))
    return kind, conf


def _table(spark, rows, schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(rows), schema))  # a constant of a few rows


def with_mitre(labelled: DataFrame) -> DataFrame:
    """Left join of the MITRE table on attack_type."""
    return labelled.join(_table(labelled.sparkSession, MITRE, "attack_type string, tactic string, technique string"), "attack_type", "left")


def with_mitre_ids(labelled: DataFrame) -> DataFrame:
    """Left join of the tactic and technique ids of attack_type, as arrays."""
    ids = _table(labelled.sparkSession, MITRE_IDS, "attack_type string, tactics string, techniques string")
    return labelled.join(ids.select("attack_type", F.split("tactics", ",").alias("tactics"), F.split("techniques", ",").alias("techniques")), "attack_type", "left")


def tactics_of(kind: Column, table, default: str, unknown: str) -> tuple[Column, Column]:
    """(tactics, technique) of an attack type by a table of both; of others `default` and `unknown`."""
    pair = F.create_map(*(F.lit(x) for t, names, _ in table for x in (t, "|".join(names))))
    one = F.create_map(*(F.lit(x) for t, _, technique in table for x in (t, technique)))
    return F.split(F.coalesce(pair[kind], F.lit(default)), r"\|"), F.coalesce(one[kind], F.lit(unknown))


def chain_tactics(kinds: Column) -> Column:
    """The tactics of a chain's attack types, each once and in order; `Unknown` if none is known."""
    of = F.create_map(*(x for t, names in CHAIN_TACTICS for x in (F.lit(t), F.array(*map(F.lit, names)))))
    found = F.array_sort(F.array_distinct(F.flatten(F.filter(F.transform(kinds, lambda k: of[k]), lambda a: a.isNotNull()))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Unknown")))


def recommendations(labelled: DataFrame, most: int = 10) -> DataFrame:
    """Distinct advice for the attack types seen, the most frequent first."""
    seen = labelled.groupBy("attack_type").agg(F.count("*").alias("n"))
    return seen.join(_table(labelled.sparkSession, RECOMMENDED, "attack_type string, advice string"), "attack_type").orderBy(F.desc("n"), "attack_type").limit(most)


def severity(text: Column) -> Column:
    """Substring ladder: critical, error, warning, debug, info. Words count wherever they stand, so `preferred` holds `err`."""
    low = F.lower(text)
    has = lambda *words: reduce(lambda a, b: a | b, (low.contains(w) for w in words))
    return F.when(has("critical", "fatal", "emergency"), "critical").when(has("error", "err", "fail"), "error").when(has("warn"), "warning").when(has("debug"), "debug").otherwise("info")


def tags(text: Column, log_type: Column) -> Column:
    """The log type and keyword tags that apply."""
    low = F.lower(text)
    pick = [F.when(low.rlike(p), t) for t, p in (("auth", "login|auth|password"), ("failure", "fail|denied"), ("network", "connect|port"), ("error", "error"))]
    return F.array_compact(F.array(log_type, *pick))


def outcome(text: Column, status: Column) -> Column:
    """By an integer status (2xx success, 400 and more failure), else by keywords, of which those of success come first."""
    low = F.lower(text)
    by_word = F.when(low.rlike("accepted|success|allowed|completed"), "success").when(low.rlike("failed|denied|reject|error|deny|drop"), "failure").otherwise("unknown")
    return F.when(status.between(200, 299), "success").when(status >= 400, "failure").otherwise(by_word)


def action(text: Column, fields: Column) -> Column:
    """The parsed action, else a request's method, else by keywords."""
    low, method = F.lower(text), F.lower(F.nullif(F.regexp_extract(fields["request"], r"^\s*(\S+)", 1), F.lit("")))
    by_word = F.when(low.rlike("accepted|success|allow"), "allow").when(low.rlike("failed|denied|reject|drop"), "deny").when(low.rlike("connect|login"), "connect").when(low.rlike("logout"), "disconnect").otherwise("unknown")
    return F.coalesce(fields["action"], method, by_word)


def _first_of(text: Column, *patterns: str) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(text, f"(?i){p}", 1), F.lit("")) for p in patterns))


_FOUR = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"


def source_ip(text: Column, fields: Column) -> Column:
    """The parsed address, a server's before a source's, else one that a keyword names, else the first of the line."""
    parsed = [fields[k] for k in ("server_ip", "src_ip", "source_ip", "ip")]
    return F.coalesce(*parsed, _first_of(text, rf"from\s+{_FOUR}", f"SRC={_FOUR}", f"srcip={_FOUR}", f"src_ip={_FOUR}", _FOUR))


def port(text: Column, fields: Column) -> Column:
    """The port that a keyword names, else the parsed one."""
    return F.coalesce(_first_of(text, r"port\s+(\d+)", r"DPT=(\d+)", r"dstport=(\d+)"), fields["port"], fields["src_port"]).try_cast("int")


def user(text: Column, fields: Column) -> Column:
    """The parsed user, else one that a keyword names, else the parsed user name."""
    return F.coalesce(fields["user"], _first_of(text, r"for\s+(\S+)\s+from", r"user[=:\s]+(\w+)", r"User:\s*(\S+)", r"server_principal_name=([^=,\s]+)"), fields["username"])


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    chars = F.split(text, "")
    n = F.length(text)
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n > 0, -F.aggregate(share, F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(0.0)


def key_values(text: Column) -> Column:
    """Map of key=value and key="value" pairs; the first value of a lower-case key wins."""
    keys = F.transform(F.regexp_extract_all(text, F.lit(r'(\w+)=("[^"]*"|[^\s,;]+)'), 1), lambda k: F.lower(k))
    values = F.transform(F.regexp_extract_all(text, F.lit(r'(\w+)=("[^"]*"|[^\s,;]+)'), 2), lambda v: F.replace(v, F.lit('"'), F.lit("")))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1)
    return F.map_from_entries(first)
