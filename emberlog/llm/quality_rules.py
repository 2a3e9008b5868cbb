"""Quality rules: decision lists learned by sequential covering and applied as ordered conditional expressions.

Per-document statistics are native column expressions. Rules are grown on a bounded hash-chosen sample of labelled
statistics: a conjunction of thresholds takes on conditions while they raise FOIL's gain, and is pruned on rows that it
has not seen; the rows that it covers leave, and the next is grown. The list becomes one chain of `when` expressions.

Nulls and odd rows: a null or empty text has no words, symbols or lines, so it fails the base rules; a null doc_id is
judged as any other row and never labelled; repeated rows each get a verdict; a doc_id labelled both ways is low
quality; null labels are not learned from. Without labels only the base rules decide. Whole texts are read. Other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm import shared as S

MOST_LABELLED = 6000
BLANK = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` columns of `docs` (doc_id, text), and for each row the counts in STATS."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("doc_id", *keep, t.alias("_t"))
    d = d.select("doc_id", *keep, "_t", F.filter(F.split("_t", "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: F.translate(x, BLANK, "") != "").alias("_l"))
    words = F.size("_w").cast("long")
    d = d.select(
        "doc_id", *keep, words.alias("n_words"), _length(F.translate("_t", BLANK, "")).alias("word_chars"), _count(F.col("_t"), SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), _count(F.col("_t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"), _count(F.col("_t"), "!?;=\"{}").alias("n_marks"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    # a 5-word window by the hash of its words' hashes
    window = "case when size(_h) > 5 then transform(sequence(0, size(_h) - 5), i -> xxhash64(_h[i], _h[i + 1], _h[i + 2], _h[i + 3], _h[i + 4])) else cast(array() as array<bigint>) end"
    d = d.withColumn("_v", F.expr(window)).drop("_h")
    # places of windows found twice or more, in order; each covers five words less what the next one covers
    ranked = "case when size(array_distinct(_v)) < size(_v) then array_sort(transform(_v, (x, i) -> struct(x as h, i as i))) else cast(array() as array<struct<h: bigint, i: int>>) end"
    d = d.withColumn("_r", F.expr(ranked)).drop("_v")
    again = "array_sort(transform(filter(_r, (x, i) -> x.h = get(_r, i - 1).h or x.h = get(_r, i + 1).h), x -> x.i))"
    d = d.withColumn("_p", F.expr(again)).drop("_r")
    covered = "aggregate(_p, named_struct('n', 0L, 'p', -5), (a, i) -> named_struct('n', a.n + least(5, i - a.p), 'p', i), a -> a.n)"
    return d.withColumn("n_repeat_words", F.expr(covered)).drop("_p").select("doc_id", *keep, *STATS)


def _length(c: Column) -> Column:
    return F.length(c).cast("long")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def measures() -> dict[str, Column]:
    """What rules may put thresholds on: doubles, never null."""
    n, c = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    share = {"symbols_per_word": F.col("n_symbols") / n, "repeat_share": F.col("n_repeat_words") / n, "chars_per_word": F.col("word_chars") / n, "upper_share": F.col("n_upper") / c, "marks_per_word": F.col("n_marks") / n}
    return {k: F.col(k).cast("double") for k in ("n_words", "n_dup_lines")} | share


def _gain(p0, n0, p1, n1):
    with np.errstate(divide="ignore", invalid="ignore"):
        g = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p0 / (p0 + n0)))
    return np.where(p1 > 0, g, -np.inf)


def _covers(x: np.ndarray, rule: list[tuple[int, str, float]]) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for j, op, t in rule:
        ok &= x[:, j] >= t if op == ">=" else x[:, j] < t
    return ok


def grow(x: np.ndarray, low: np.ndarray, conditions: int = 4) -> list[tuple[int, str, float]]:
    """A conjunction of thresholds that covers `low` rows, each condition the one with the largest FOIL gain."""
    rule: list = []
    for _ in range(conditions):
        at = _covers(x, rule)
        p0, n0 = (low & at).sum(), (~low & at).sum()
        if not p0 or not n0:
            break
        best = (1e-9, None)
        for j in range(x.shape[1]):
            for t in np.unique(np.quantile(x[at, j], np.linspace(0, 1, 65), method="higher")):
                above = at & (x[:, j] >= t)
                for op, m in ((">=", above), ("<", at & ~above)):
                    g = float(_gain(p0, n0, (low & m).sum(), (~low & m).sum()))
                    if g > best[0]:
                        best = (g, (j, op, float(t)))
        if best[1] is None:
            break
        rule.append(best[1])
    return rule


def prune(x: np.ndarray, low: np.ndarray, rule: list) -> list:
    """The rule without those last conditions whose loss raises (p - n) / (p + n) on unseen rows, or leaves it."""

    def worth(r):
        at = _covers(x, r)
        p, n = (low & at).sum(), (~low & at).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))


def learn(x: np.ndarray, low: np.ndarray, most_rules: int = 12, precision: float = 0.9, seed: int = 3) -> list[list[tuple[int, str, float]]]:
    """Rules for low quality, in order, by sequential covering; a rule stays if it is right on `precision` of unseen rows."""
    rules: list = []
    part = np.random.default_rng(seed).random(len(x)) < 2 / 3
    left = np.ones(len(x), bool)
    while len(rules) < most_rules and (low & left & part).sum() >= 3:
        rule = grow(x[left & part], low[left & part])
        if not rule:
            break
        rule = prune(x[left & ~part], low[left & ~part], rule)
        at = _covers(x, rule) & left
        p, n = (low & at & ~part).sum(), (~low & at & ~part).sum()
        if not p or p / (p + n) < precision:
            break
        rules.append(rule)
        left &= ~at
    return rules


def expression(rules: list, names: list[str], columns: dict[str, Column]) -> Column:
    """The decision list as a chain of conditions: true where the document is kept."""

    def both(rule):
        return reduce(lambda a, b: a & b, (columns[names[j]] >= t if op == ">=" else columns[names[j]] < t for j, op, t in rule))

    chain = None
    for rule in rules:
        chain = F.when(both(rule), False) if chain is None else chain.when(both(rule), False)
    return chain.otherwise(True) if chain is not None else F.lit(True)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> list:
    """Rules from at most `most` labelled documents (labels: doc_id, quality)."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id")
    cols = measures()
    rows = statistics(sample, "quality").select("doc_id", "quality", *(c.alias(k) for k, c in cols.items() if k not in STATS), *(k for k in cols if k in STATS)).orderBy("doc_id", *cols).limit(2 * most).collect()
    x = np.array([[float(r[k]) for k in cols] for r in rows]).reshape(-1, len(cols))
    return learn(x, np.array([r["quality"] == 0 for r in rows], bool))


def judge(docs: DataFrame, rules: list) -> DataFrame:
    """Per row: doc_id, the statistics, base_failed and kept."""
    cols = measures()
    s = statistics(docs).withColumn("base_failed", base_failed())
    return s.withColumn("kept", ~F.col("base_failed") & expression(rules, list(cols), cols))


def op9_quality_rules(spark, sf_dir) -> DataFrame:
    docs = S.read(spark, sf_dir, "documents")
    out = judge(docs, fit(docs, S.read(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES: dict = {}
