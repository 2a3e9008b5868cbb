"""Correlation of entries into attack chains, kill chains, timelines and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000


def ip_chains(e: DataFrame) -> DataFrame:
    """Ips with two attacks, two anomalies or one of each; confidence grows with the number of events."""
    hot = e.filter("attack_type is not null or is_anomaly")
    g = hot.groupBy("ip").agg(F.count("attack_type").alias("attacks"), F.count_if("is_anomaly").alias("anomalies"), F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.concat_ws(",", F.array_sort(F.collect_set("attack_type"))).alias("types"))
    keep = (F.col("attacks") >= 2) | (F.col("anomalies") >= 2) | ((F.col("attacks") >= 1) & (F.col("anomalies") >= 1))
    return g.filter(keep).withColumn("confidence", F.round(0.75 + 0.02 * F.least("n", F.lit(10)), 2))


def user_targeting(e: DataFrame, ips: int = 3, failures: int = 5) -> DataFrame:
    g = e.filter("outcome = 'failure'").groupBy("user").agg(F.count_distinct("ip").alias("ips"), F.count("*").alias("failures"))
    return g.filter((F.col("ips") >= ips) & (F.col("failures") >= failures)).withColumn("confidence", F.lit(0.85))


def account_compromise(e: DataFrame, failures: int = 10) -> DataFrame:
    """Users with a success from an ip that failed before or after, or more than `failures` failures and a success."""
    per = e.groupBy("user", "ip").agg(F.count_if(F.col("outcome") == "failure").alias("f"), F.count_if(F.col("outcome") == "success").alias("s"))
    g = per.groupBy("user").agg(F.sum("f").alias("failures"), F.sum("s").alias("successes"), F.count_if((F.col("f") > 0) & (F.col("s") > 0)).alias("shared_ips"))
    return g.filter((F.col("shared_ips") > 0) | ((F.col("failures") > failures) & (F.col("successes") > 0)))


def interval_chains(left: DataFrame, right: DataFrame, width: int = 60 * SECOND) -> DataFrame:
    """Each left entry (id, us) with the first right entry 0 < dt < width later.

    Both sides are merged by time within buckets of `width`: the next right entry stands in the same bucket, found by one
    window over it, or is the first of the bucket after. The cost is that of a sort, however many entries a bucket has.
    """
    bucket = F.expr(f"us div {width}").alias("b")
    r = right.groupBy("us").agg(F.min("id").alias("right_id")).select("us", bucket, "right_id")
    both = left.select(F.col("id").alias("left_id"), "us", bucket, F.lit(None).cast("struct<us: bigint, id: bigint>").alias("r")).unionByName(
        r.select(F.lit(None).cast("long").alias("left_id"), "us", "b", F.struct(F.col("us").alias("us"), F.col("right_id").cast("long").alias("id")).alias("r"))
    )
    after = F.first("r", True).over(Window.partitionBy("b").orderBy("us").rangeBetween(1, Window.unboundedFollowing))
    heads = r.groupBy((F.col("b") - 1).alias("b")).agg(F.min(F.struct("us", F.col("right_id").cast("long").alias("id"))).alias("head"))
    near = both.withColumn("m", after).filter("left_id is not null").join(heads, "b", "left").withColumn("m", F.coalesce("m", "head"))
    return near.filter(F.col("m.us") - F.col("us") < width).select("left_id", F.col("m.id").alias("right_id"), (F.col("m.us") - F.col("us")).alias("gap_us"))


def chains_of(e: DataFrame, key: str, least: int = 3, most: int = 10) -> DataFrame:
    """Per key with `least` or more attacks: mean confidence, times, first type, and the first `most` event ids."""
    hot = e.filter("attack_type is not null")
    g = hot.groupBy(key).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.min(F.struct("us", "id", "attack_type")).alias("f"))
    # the nested list is cut before it is gathered
    from pyspark.sql import Window

    ranked = hot.select(key, "id", F.row_number().over(Window.partitionBy(key).orderBy("us", "id")).alias("r")).filter(F.col("r") <= most)
    ids = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("l")).select(key, F.concat_ws(",", F.transform("l", lambda x: x["id"].cast("string"))).alias("event_ids"))
    return g.filter(F.col("n") >= least).join(ids, key).select(key, "n", F.round("mean", 4).alias("mean_confidence"), "first_us", "last_us", F.col("f.attack_type").alias("chain_type"), "event_ids")


def bridge(e: DataFrame, chains: DataFrame, key: str) -> DataFrame:
    """(key, id): which attack entries make up which chain."""
    return e.filter("attack_type is not null").select("id", key).join(chains.select(key), key, "left_semi")


def kill_chains(e: DataFrame) -> DataFrame:
    """Every user with five failures and a success, ips with two injections or a scan, and ips with five failures."""
    count = lambda col, value, name: F.count_if(F.col(col) == value).alias(name)
    times = [F.min("us").alias("first_us"), F.max("us").alias("last_us")]
    users = e.groupBy(F.col("user").alias("key")).agg(count("outcome", "failure", "f"), count("outcome", "success", "s"), *times)
    ips = e.groupBy(F.col("ip").alias("key")).agg(count("outcome", "failure", "f"), count("attack_type", "sql_injection", "q"), count("attack_type", "port_scan", "p"), *times)

    def rule(of: DataFrame, cond: str, name: str, evidence: str) -> DataFrame:
        return of.filter(cond).select("key", F.lit(name).alias("rule"), F.col(evidence).alias("evidence"), "first_us", "last_us")

    rules = [rule(ips, "q >= 2", "data_breach", "q"), rule(ips, "p >= 1", "reconnaissance", "p"), rule(ips, "f >= 5", "brute_force", "f")]
    return reduce(DataFrame.unionByName, rules, rule(users, "f >= 5 and s >= 1", "account_takeover", "f"))


# Rule, stage, confidence
STAGES = (("account_takeover", "initial_access", 0.9), ("privilege_escalation", "privilege_escalation", 0.75), ("ransomware", "complete", 0.9), ("webshell", "persistence", 0.8), ("bruteforce", "reconnaissance", 0.85))
# What messages hold
RANSOM = r"vssadmin.*delete|shadowcopy.*delete|encrypt|[.]locked|bcditedit"
WEBSHELL = r"(?i)[.](php|asp|aspx|jsp)[?]cmd=|c99|r57|b374k|wso|eval\s*[(]"
ADMINS = ("admin", "root", "administrator", "system")


def source_kill_chains(e: DataFrame, category: Column, least: int = 5, admins: tuple[str, ...] = ADMINS) -> DataFrame:
    """Chains across sources: rule, stage, key (user or ip, null for all), evidence, first_us, last_us, confidence.

    A user's takeover needs `least` failures and a success in sign-in logs, from their first failure to their first
    success; brute force `least` failures of an ip; the others are one chain each: successes of privileged users, two
    traces of ransomware in system logs, one of a web shell in web logs.
    """
    e = e.withColumn("_src", category)
    auth, system, web = (e.filter(F.col("_src") == s) for s in ("auth", "system", "web"))
    bad, good = F.col("outcome") == "failure", F.col("outcome") == "success"
    users = auth.groupBy(F.col("user").alias("key")).agg(F.count_if(bad).alias("evidence"), F.count_if(good).alias("s"), F.min(F.when(bad, F.col("us"))).alias("first_us"), F.min(F.when(good, F.col("us"))).alias("last_us"))

    def traces(of: DataFrame, key: Column, n: int) -> DataFrame:
        return of.groupBy(key.alias("key")).agg(F.count("*").alias("evidence"), F.min("us").alias("first_us"), F.max("us").alias("last_us")).filter(F.col("evidence") >= n)

    everyone = F.lit(None).cast("string")
    named = reduce(lambda a, b: a | b, (F.lower("user").contains(x) for x in admins))
    found = (
        users.filter((F.col("evidence") >= least) & (F.col("s") > 0)).drop("s"), traces(auth.filter(good & named), everyone, 1), traces(system.filter(F.lower("message").rlike(RANSOM)), everyone, 2),
        traces(web.filter(F.col("message").rlike(WEBSHELL)), everyone, 1), traces(auth.filter(bad), F.col("ip"), least),
    )
    return reduce(DataFrame.unionByName, (f.select(F.lit(r).alias("rule"), F.lit(s).alias("stage"), "key", "evidence", "first_us", "last_us", F.lit(c).alias("confidence")) for f, (r, s, c) in zip(found, STAGES)))


def summary(chains: DataFrame, timeline: DataFrame) -> DataFrame:
    """Chains, those over 0.85, timeline events and risk min(15 chains + 2 events, 100)."""
    c = chains.agg(F.count("*").alias("chains"), F.count_if(F.col("confidence") > 0.85).alias("high"))
    t = timeline.agg(F.count("*").alias("timeline"))
    return c.crossJoin(t).withColumn("risk", F.least(15 * F.col("chains") + 2 * F.col("timeline"), F.lit(100)))  # one row each


def threat_scores(e: DataFrame, k: int = 10) -> DataFrame:
    """Ips by count times distinct attack types."""
    g = e.filter("attack_type is not null").groupBy("ip").agg(F.count("*").alias("n"), F.count_distinct("attack_type").alias("types"))
    return g.withColumn("threat_score", F.col("n") * F.col("types")).orderBy(F.desc("threat_score"), "ip").limit(k)


# Labels that feedback may give
VERDICTS = ("safe", "unsafe", "attack_pattern")


def valid_labels(feedback: DataFrame, label: str = "label") -> DataFrame:
    return feedback.filter(F.col(label).isin(*VERDICTS))


def with_attacks(e: DataFrame, attacks: DataFrame) -> DataFrame:
    """Entries with the fields of the attack of the same id, if there is one."""
    return e.join(attacks, "id", "left")


def chain_events(chains: DataFrame) -> DataFrame:
    """(chain, id): chains (chain, ids) flattened to one row an event."""
    return chains.select("chain", F.explode("ids").alias("id"))


def not_overlapping(chains: DataFrame, existing: DataFrame) -> DataFrame:
    """Chains (chain, ids) that share no event with the existing ones."""
    taken = chain_events(chains).join(chain_events(existing).select("id").distinct(), "id").select("chain").distinct()
    return chains.join(taken, "chain", "left_anti")


def ips_of_user(e: DataFrame) -> DataFrame:
    """Per user, the ips of failures and successes together."""
    ips = lambda o: F.collect_set(F.when(F.col("outcome") == o, F.col("ip")))
    return e.groupBy("user").agg(F.array_sort(F.array_union(ips("failure"), ips("success"))).alias("ips"))


def sorted_by(e: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Entries in order of any column as text, whatever its case, then of id."""
    key = F.lower(F.col(column).cast("string"))
    return e.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "id")


def window_summary(chains: DataFrame, e: DataFrame) -> DataFrame:
    """Chains, their threat score (sum of confidences, 1 at most), and the risk from chains and severities, 100 at most."""
    c = chains.agg(F.count("*").alias("chains"), F.least(F.coalesce(F.sum("confidence"), F.lit(0.0)), F.lit(1.0)).alias("threat_score"))
    n = e.agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "error").alias("errors"))
    return c.crossJoin(n).withColumn("risk", F.least(20 * F.col("chains") + 10 * F.col("critical") + 5 * F.col("errors"), F.lit(100)))  # one row each
