"""Titles, categories, gates and shape of entries and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories and the codes of their log types
CATEGORY_CODES = {
    "auth": ("ssh_auth", "pam", "vsftpd", "proftpd"),
    "web": ("apache", "nginx", "iis", "django", "flask", "rails", "express", "fastapi", "gunicorn", "uvicorn"),
    "database": (
        "mysql_error", "mysql_query", "mysql_slow", "postgres_error", "postgres_auth", "postgres_statement", "oracle_alert", "oracle_listener", "oracle_audit",
        "sqlserver_error", "sqlserver_audit", "sqlserver_transaction", "mongodb_server", "mongodb_audit",
    ),
    "firewall": ("iptables", "ufw", "nftables", "firewalld", "windows_firewall", "palo_alto", "fortigate", "cisco_asa", "checkpoint", "aws_vpc_flow", "azure_nsg", "gcp_vpc"),
    "system": ("syslog", "systemd", "kernel", "audit", "package", "cron", "daemon", "windows_security", "windows_system", "windows_application"),
    "mail": ("postfix", "sendmail", "exim", "dovecot", "exchange"),
    "network": ("dns", "dhcp", "proxy"),
}
CATEGORIES = {code: name for name, codes in CATEGORY_CODES.items() for code in codes}


def category(log_type: Column) -> Column:
    """The category of a log type, `other` if unknown."""
    table = F.create_map(*(F.lit(x) for p in CATEGORIES.items() for x in p))
    return F.coalesce(F.element_at(table, log_type), F.lit("other"))


def title(ip: Column, action: Column, user: Column, outcome: Column, severity: Column) -> Column:
    """`ip action`, else `user outcome`, else the severity."""
    return F.when(ip.isNotNull() & action.isNotNull(), F.concat_ws(" ", ip, action)).when(user.isNotNull() & outcome.isNotNull(), F.concat_ws(" ", user, outcome)).otherwise(F.concat(severity, F.lit(" event")))


def likely_false(groups: DataFrame, least: int = 10, rate: float = 0.3) -> DataFrame:
    """Flags groups (n, failed, ...) that are too small, or whose failure rate is too low, for an alert."""
    small, calm = F.col("n") < least, F.col("failed") / F.col("n") < rate
    return groups.withColumn("false_positive", small | calm).withColumn("reason", F.when(small, "few events").when(calm, "low failure rate"))


def columns_of(entries: DataFrame, fields: str = "fields", first: int | None = 10) -> DataFrame:
    """Distinct non-empty field names of the first rows (or of all), sorted."""
    rows = entries.orderBy("id").limit(first) if first else entries
    return rows.select(F.explode(F.map_filter(fields, lambda k, v: v.isNotNull() & (v != ""))).alias("name", "value")).select("name").distinct().orderBy("name")


def structure(lines: DataFrame) -> DataFrame:
    """Per source: lines, how many hold each separator, key=value pairs or a time, and the likely separator."""
    seps = (("comma", ","), ("tab", "\t"), ("pipe", "|"), ("semicolon", ";"))
    aggs = [F.count_if(F.col("line").contains(s)).alias(n) for n, s in seps]
    s = lines.groupBy("source").agg(F.count("*").alias("lines"), *aggs, F.count_if(F.col("line").rlike(r"\w+=\S")).alias("pairs"), F.count_if(F.col("line").rlike(r"\d{2}:\d{2}:\d{2}")).alias("times"))
    best = F.array_max(F.array(*(F.struct(F.col(n).alias("c"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, (n, _) in enumerate(seps))))
    return s.withColumn("separator", F.when(best["c"] * 2 > F.col("lines"), best["n"]).otherwise("space"))
