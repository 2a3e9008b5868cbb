"""Features, anomaly scores and classifiers of entries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Families of patterns that are counted in a text, three at most
FAMILIES = {
    "sql": r"union\s+select|select\s+.*\s+from|drop\s+table|;\s*--|--\s*$|'\s*or\s+'?1'?\s*=\s*'?1|\"\s*or\s+\"?1\"?\s*=\s*\"?1|or\s+'1'\s*=\s*'1|or\s+1\s*=\s*1|and\s+1\s*=\s*1|\bor\b.*=.*\bor\b|\band\b.*=.*\band\b",
    "script": r"<script|javascript:|on\w+\s*=|<iframe|<object|<embed|alert\(|document\.cookie|document\.location",
    "command": r"[;|`]\s*(cat|ls|wget|curl|nc|bash|sh|whoami|id|uname|pwd|echo|chmod)\s|chmod\s+\d+|wget\s+http|curl\s+http|\$\(|\$\{|`.*`",
    "traversal": r"\.\.(/|\\)|%2e%2e|\.\.\\|%252e%252e|etc/passwd|win\.ini|boot\.ini|\.htaccess|\.htpasswd",
    "inclusion": r"\?(page|file|path|include|document)\s*=.*http|\?.*=.*\.\.|include\s*\(|require\s*\(|require_once\s*\(|virtual\s*\(",
}
SYSTEM_FILES = r"/etc/|/proc/|/var/|/usr/|\\windows\\|\\system32\\"
SENSITIVE = ("password", "credential", "token", "secret", "key", "auth")
# What a text has or lacks
FLAGS = {
    "url_encoding": r"%[0-9a-fA-F]{2}", "ip_in_text": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "port_in_text": r"port\s+\d+|:\d{2,5}", "angle_brackets": r"<[^>]+>", "single_quote": "'", "quoted_value": r"=\s*['\"]",
    "double_dash": "--", "semicolon": ";", "pipe": r"\|", "backtick": "`", "connection": "connection|port",
}
ANONYMOUS = ("", "anonymous", "www-data", "nobody", "root")
LEVELS = {"debug": 0, "info": 1, "warning": 2, "error": 3, "critical": 4}
#: The 25 features in order.
ATTACK_FEATURES = (
    "external", "length", *FAMILIES, "http", "failure", "severe", "anonymous", "url_encoding", "ip_in_text", "port_in_text", "system_files", "sensitive", "login", "angle_brackets", "single_quote", "quoted_value",
    "double_dash", "semicolon", "pipe", "backtick", "connection",
)


def _third(n: Column) -> Column:
    return F.least(n / 3, F.lit(1.0))


def attack_features(message: Column, raw: Column, ip: Column, severity: Column, outcome: Column, user: Column, action: Column) -> list[Column]:
    """The 25 features of an entry for attack classification, 0 to 1 each: of the raw line, or of the message without one."""
    text = F.lower(F.coalesce(F.nullif(raw, F.lit("")), message, F.lit("")))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    values = {"external": flag(~F.coalesce(ip, F.lit("")).rlike(r"^(?:192\.168\.|10\.|172\.(?:1[6-9]|2\d|3[01]))")), "length": F.least(F.length(text) / 500, F.lit(1.0))}
    values |= {n: _third(F.regexp_count(text, F.lit(f"(?i){p}"))) for n, p in FAMILIES.items()}
    values |= {
        "http": flag(text.rlike(r"\b(?:get|post|put|delete|patch)\s+/")), "failure": flag(F.coalesce(outcome, F.lit("")).rlike(r"^(?:failure|[45]\d{2})$")), "severe": flag(severity.isin("warning", "error", "critical")),
        "anonymous": flag(F.coalesce(user, F.lit("")).isin(*ANONYMOUS)), "system_files": _third(F.regexp_count(text, F.lit(SYSTEM_FILES))), "sensitive": _third(reduce(lambda a, b: a + b, (text.contains(w).cast("int") for w in SENSITIVE))),
        "login": flag(F.coalesce(F.lower(action), F.lit("")).contains("login") | text.rlike("auth|password")), **{n: flag(text.rlike(p)) for n, p in FLAGS.items()},
    }
    return [values[n].alias(n) for n in ATTACK_FEATURES]


def anomaly_features(ip: Column, user: Column, message: Column, severity: Column, ts: Column, fields: Column | None = None) -> list[Column]:
    """Hashes of address and user in thousandths, length, severity, hour and weekday (one half without a time). With `fields`
    their number is a seventh feature, and length and severity are not scaled to 1.
    """
    share = lambda c: F.when(F.coalesce(c, F.lit("")) == "", 0.0).otherwise(F.pmod(F.xxhash64(c), F.lit(1000)) / 1000)
    level = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in LEVELS.items() for x in p)), severity), F.lit(1)).cast("double")
    length = F.length(F.coalesce(message, F.lit(""))) / 1000
    out = [share(ip).alias("ip"), share(user).alias("user")]
    out += [F.least(length, F.lit(1.0)).alias("length"), (level / 4).alias("severity")] if fields is None else [length.alias("length"), level.alias("severity"), (F.coalesce(F.size(fields), F.lit(0)) / 10).alias("fields")]
    return [*out, F.coalesce(F.hour(ts) / 24, F.lit(0.5)).alias("hour"), F.coalesce(F.weekday(ts) / 7, F.lit(0.5)).alias("weekday")]


def linear_score(features: DataFrame, weights: dict[str, float], ranges: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """Weighted mean of features clipped to their ranges, its sigmoid around the threshold, and whether it passes."""
    total = sum(abs(w) for w in weights.values())
    parts = [F.lit(w) * F.least(F.greatest(F.col(n) / ranges[n], F.lit(0.0)), F.lit(1.0)) for n, w in weights.items()]
    raw = reduce(lambda a, b: a + b, parts) / total
    return features.withColumn("raw", raw).withColumn("score", 1 / (1 + F.exp(-10 * (F.col("raw") - threshold)))).withColumn("hit", F.col("raw") >= threshold)


def isolation_trees(sample: np.ndarray, trees: int, size: int, seed: int) -> list:
    """Random split trees over rows of a bounded sample: nested (feature, split, left, right) or leaf sizes."""
    rng = np.random.default_rng(seed)

    def grow(rows: np.ndarray, depth: int):
        low, high = rows.min(0), rows.max(0)
        open_ = np.flatnonzero(high > low)
        if depth == 0 or len(rows) <= 1 or not len(open_):
            return len(rows)
        f = int(rng.choice(open_))
        at = float(rng.uniform(low[f], high[f]))
        left = rows[:, f] < at
        return f, at, grow(rows[left], depth - 1), grow(rows[~left], depth - 1)

    depth = int(np.ceil(np.log2(max(2, size))))
    return [grow(sample[rng.choice(len(sample), min(size, len(sample)), replace=False)], depth) for _ in range(trees)]


def _mean_path(n: float) -> float:
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def isolation_scores(x: np.ndarray, trees: list, size: int) -> np.ndarray:
    """2 ** (-mean path / expected path): near 1 for rows that few splits set apart."""

    def paths(tree, rows, depth, out):
        if isinstance(tree, int):
            out[rows] += depth + _mean_path(tree)
            return
        f, at, left, right = tree
        below = x[rows, f] < at
        paths(left, rows[below], depth + 1, out)
        paths(right, rows[~below], depth + 1, out)

    total = np.zeros(len(x))
    for t in trees:
        paths(t, np.arange(len(x)), 0, total)
    return 2.0 ** (-total / len(trees) / max(_mean_path(size), 1e-9))


def isolation_forest(df: DataFrame, key: str, columns: list[str], trees: int = 100, size: int = 256, most: int = 10_000, seed: int = 5) -> DataFrame:
    """(key, anomaly_score) of every row; trees are grown on at most `most` rows chosen by a hash."""
    chosen = df.orderBy(F.xxhash64(key), key).limit(most).select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns)).collect()
    sample = np.array([tuple(r) for r in chosen]).reshape(-1, len(columns))
    grown = isolation_trees(sample, trees, min(size, len(sample)), seed) if len(sample) else [0]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "anomaly_score": isolation_scores(b[columns].to_numpy(), grown, min(size, max(2, len(sample))))})

    kind = dict(df.dtypes)[key]
    rows = df.select(key, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))
    return rows.mapInPandas(score, f"{key} {kind}, anomaly_score double")


def text_classifier(labelled: DataFrame, text: str = "message", label: str = "attack_type", terms: int = 1 << 14):
    """Fit TF-IDF and multinomial logistic regression with balanced class weights; returns the pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer

    counts = labelled.groupBy(label).agg(F.count("*").alias("_n"))
    total = labelled.count()
    weighed = labelled.join(counts, label).withColumn("weight", F.lit(float(total)) / F.col("_n"))
    stages = [
        StringIndexer(inputCol=label, outputCol="label", handleInvalid="keep"), RegexTokenizer(inputCol=text, outputCol="words", pattern=r"\W+"),
        HashingTF(inputCol="words", outputCol="tf", numFeatures=terms), IDF(inputCol="tf", outputCol="features"), LogisticRegression(weightCol="weight", maxIter=30, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(weighed)


def with_feedback(labelled: DataFrame, feedback: DataFrame) -> DataFrame:
    """Labels corrected by feedback (id, verdict, corrected): a false positive becomes normal, a false negative its corrected type."""
    last = feedback.groupBy("id").agg(F.max(F.struct("at", "verdict", "corrected")).alias("f"))
    kind = F.when(F.col("f.verdict") == "false_positive", "normal").when(F.col("f.verdict") == "false_negative", F.col("f.corrected")).otherwise(F.col("attack_type"))
    return labelled.join(last, "id", "left").withColumn("attack_type", kind).drop("f")
