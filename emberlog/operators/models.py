"""Features of entries, anomalies by a share, tabular classifiers and their measures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.features import isolation_forest
from emberlog.operators.labels import entropy

# The categories and numbers of an entry
CATEGORIES = ("log_type", "severity", "action", "outcome")
NUMBERS = ("status", "bytes", "port", "src_port", "dst_port", "duration_ms")
TERMS = 100


def ordinals(values: DataFrame, column: str) -> DataFrame:
    """(value, ordinal) of the distinct values of a column in order, from 0.

    Values are numbered within their first two characters, and the numbers of all earlier beginnings are added: no window
    holds all values.
    """
    start = Window.partitionBy("_start").orderBy("value")
    own = values.select(F.col(column).alias("value")).filter("value is not null").distinct().withColumn("_start", F.left("value", F.lit(2))).withColumn("_r", F.row_number().over(start) - 1)
    counts = own.groupBy("_start").agg(F.count("*").alias("n"))  # a row for each beginning
    before = counts.select("_start", (F.sum("n").over(Window.orderBy("_start")) - F.col("n")).alias("_before"))
    return own.join(before, "_start").select("value", (F.col("_before") + F.col("_r")).cast("int").alias("ordinal"))


def tokens(text: Column) -> Column:
    """Lower-case words of two or more letters or digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"((?U)\w\w+)"), 1)


@dataclass
class Vocabulary:
    """The terms that are most frequent, in order of their texts, with the logarithms of their rarity."""

    terms: list[str]
    idf: list[float]


def vocabulary(entries: DataFrame, text: str = "message", most: int = TERMS, stop: list[str] | None = None) -> Vocabulary:
    """The `most` terms of most occurrences (ties in order of their texts) with ln((1 + n) / (1 + df)) + 1.

    Terms are counted where they are and merged by term; `most` rows come to the driver.
    """
    stop = stop_words(entries) if stop is None else stop
    words = entries.select(F.array_except(F.array_distinct(tokens(F.col(text))), F.array(*map(F.lit, stop)).cast("array<string>")).alias("own"), tokens(F.col(text)).alias("words"))
    pairs = words.select(F.explode(F.transform("own", lambda t: F.struct(t.alias("term"), F.size(F.filter(F.col("words"), lambda w: w == t)).alias("n")))).alias("p")).select("p.*")
    top = pairs.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("df")).orderBy(F.desc("n"), "term").limit(most)
    total = entries.count()
    rows = top.select("term", (F.log((F.lit(1.0) + total) / (1.0 + F.col("df"))) + 1).alias("idf")).collect()
    rows.sort(key=lambda r: r["term"])
    return Vocabulary([r["term"] for r in rows], [r["idf"] for r in rows])


def stop_words(df: DataFrame) -> list[str]:
    """Spark's English stop words."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def term_weights(text: Column, of: Vocabulary) -> Column:
    """Sparse TF-IDF of a text as a map from a term's place in the vocabulary to its weight; a text's weights have length 1."""
    if not of.terms:
        return F.create_map().cast("map<int,double>")
    every, idf = F.array(*map(F.lit, of.terms)), F.array(*map(F.lit, of.idf))

    def weigh(words: Column) -> Column:
        place = lambda t: F.array_position(every, t).cast("int")
        found = F.transform(F.array_intersect(words, every), lambda t: F.struct((place(t) - 1).alias("i"), (F.size(F.filter(words, lambda w: w == t)) * F.element_at(idf, place(t))).alias("w")))
        return F.get(F.transform(F.array(found), _unit), F.lit(0))

    return F.get(F.transform(F.array(tokens(text)), weigh), F.lit(0))


def _unit(found: Column) -> Column:
    length = F.sqrt(F.aggregate(found, F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    return F.map_from_entries(F.transform(found, lambda x: F.struct(x["i"], (x["w"] / length).alias("w"))))


def entry_features(entries: DataFrame, of: Vocabulary | None = None) -> DataFrame:
    """Entries (id, event_ts, log_type, severity, action, outcome, fields, message) as numbers: hour and weekday (Monday is 0;
    0 without a time), ordinals of the four categories among those there, six numbers (0 if missing or no plain number),
    the message's length and entropy, and `terms` by the vocabulary.
    """
    text = F.coalesce("message", F.lit(""))
    number = lambda v: F.when(v.rlike(r"^(?=.*\d)\d*\.?\d*$"), v.cast("double")).otherwise(0.0)
    own = {c: F.coalesce(F.nullif(F.col("fields")[c], F.lit("")), F.col(c).cast("string") if c in entries.columns else F.lit(None)) for c in NUMBERS}
    out = entries.select(
        "id", F.coalesce(F.hour("event_ts"), F.lit(0)).alias("hour"), F.coalesce(F.weekday("event_ts"), F.lit(0)).alias("day_of_week"), *(F.lower(F.coalesce(F.col(c).cast("string"), F.lit("unknown"))).alias(c) for c in CATEGORIES),
        *(F.coalesce(number(v), F.lit(0.0)).alias(c) for c, v in own.items()), F.length(text).alias("msg_len"), entropy(text).alias("msg_entropy"), *([term_weights(F.col("message"), of).alias("terms")] if of else []),
    )
    for c in CATEGORIES:
        out = out.join(ordinals(out, c).toDF("_value", "_ordinal"), F.col(c) == F.col("_value"), "left").withColumn(c, F.col("_ordinal")).drop("_value", "_ordinal")
    return out


def anomalies(df: DataFrame, key: str, columns: list[str], contamination: float = 0.05, least: int = 10, error: float = 1e-4, **forest) -> DataFrame:
    """(key, anomaly_score, anomaly, confidence): the share `contamination` of rows with the highest scores are anomalies.

    The threshold is a quantile from mergeable sketches whose rank is off by `error` of the rows at most. Confidence is
    (1 - d) / 2 for a score that lies d under the threshold. Of fewer than `least` rows none is one.
    """
    scored = isolation_forest(df, key, columns, **forest)
    bounds = scored.agg(F.percentile_approx("anomaly_score", 1 - contamination, int(1 / error)).alias("_top"), F.count("*").alias("_n"))
    out = scored.crossJoin(F.broadcast(bounds))  # one row
    hit = (F.col("_n") >= least) & (F.col("anomaly_score") > F.col("_top"))
    return out.select(key, "anomaly_score", F.coalesce(hit, F.lit(False)).alias("anomaly"), ((1 - (F.col("_top") - F.col("anomaly_score"))) / 2).alias("confidence"))


def combined(entries: DataFrame, labels: DataFrame, found: DataFrame, floor: float = 0.3) -> DataFrame:
    """(id, attack_type, confidence, anomaly, anomaly_score): a classifier's type (id, attack_type, confidence) unless it is
    safe or under `floor`, and anomalies (id, anomaly, confidence); an anomaly without a type is of the type `anomaly`.
    """
    kept = labels.filter(~F.col("attack_type").isin("safe", "normal") & (F.col("confidence") >= floor)).select("id", "attack_type", "confidence")
    odd = found.filter("anomaly").select("id", F.col("confidence").alias("anomaly_score"), F.lit(True).alias("anomaly"))
    both = entries.select("id").join(kept, "id", "left").join(odd, "id", "left").filter("attack_type is not null or anomaly")
    return both.select("id", F.coalesce("attack_type", F.lit("anomaly")).alias("attack_type"), F.coalesce("confidence", "anomaly_score").alias("confidence"), F.coalesce("anomaly", F.lit(False)).alias("anomaly"), "anomaly_score")


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n)."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def class_report(table: DataFrame) -> DataFrame:
    """Per label of a confusion table: precision, recall, f1 (0 where undefined) and support."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    of = table.groupBy("label").agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    said = table.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("said"))
    both = of.join(said, "label", "full").fillna(0, ["support", "hits", "said"])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return both.select("label", share("hits", "said").alias("precision"), share("hits", "support").alias("recall"), F.when(F.col("said") + F.col("support") > 0, 2 * F.col("hits") / (F.col("said") + F.col("support"))).otherwise(0.0).alias("f1"), "support")


def measures(table: DataFrame) -> DataFrame:
    """One row: rows, accuracy and F1 weighted by support; null measures without rows."""
    r = class_report(table).agg(F.sum("support").alias("rows"), F.sum(F.col("recall") * F.col("support")).alias("hits"), F.sum(F.col("f1") * F.col("support")).alias("f1"))
    return r.select(F.coalesce("rows", F.lit(0)).alias("rows"), F.try_divide("hits", "rows").alias("accuracy"), F.try_divide("f1", "rows").alias("weighted_f1"))


def stratified(df: DataFrame, label: str, key: str, share: float = 0.2, error: float = 1e-4) -> DataFrame:
    """`df` with `held_out`: of each label the `share` of rows whose key hashes lowest, by a quantile of its hashes."""
    h = F.xxhash64(F.lit(17), F.col(key))
    cuts = df.groupBy(F.col(label).alias("_label")).agg(F.percentile_approx(h, share, int(1 / error)).alias("_cut"))
    return df.join(cuts, F.col(label).eqNullSafe(F.col("_label")), "left").withColumn("held_out", h <= F.col("_cut")).drop("_label", "_cut")


@dataclass
class Trained:
    model: object
    test_accuracy: float
    weighted_f1: float
    fold_accuracy: list[float]


def _forest(columns: list[str], label: str, trees: int, depth: int, seed: int):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexerModel, VectorAssembler

    def stages(labels: list[str]):
        index = StringIndexerModel.from_labels(labels, inputCol=label, outputCol="_label", handleInvalid="keep")
        return [
            VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="keep"), StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True), index,
            RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed), IndexToString(inputCol="prediction", outputCol="predicted", labels=labels),
        ]

    return lambda labels: Pipeline(stages=stages(labels))


def train_forest(df: DataFrame, columns: list[str], label: str, key: str, folds: int = 5, share: float = 0.2, trees: int = 100, depth: int = 15, seed: int = 42) -> Trained:
    """A random forest over scaled columns: fitted on all but a stratified share of the rows, measured on that share and by
    cross-validation over `folds` parts of the others, which a hash of the key deals.
    """
    split = stratified(df.fillna(0.0, columns), label, key, share).persist()
    try:
        labels = sorted(str(r[0]) for r in split.select(label).filter(F.col(label).isNotNull()).distinct().collect())  # the classes
        forest = _forest(columns, label, trees, depth, seed)
        seen, held = split.filter("not held_out"), split.filter("held_out")
        scores = lambda model, rows: measures(confusion(model.transform(rows), label, "predicted")).first()
        part, accuracy = F.pmod(F.xxhash64(F.lit(23), F.col(key)), F.lit(max(folds, 1))), []
        for i in range(folds):
            accuracy.append(scores(forest(labels).fit(seen.filter(part != i)), seen.filter(part == i))["accuracy"])
        model = forest(labels).fit(seen)
        got = scores(model, held)
        return Trained(model, got["accuracy"], got["weighted_f1"], accuracy)
    finally:
        split.unpersist()
