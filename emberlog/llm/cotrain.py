"""Quality classifier by co-training a text view and a page-metadata view.

The text view is a logistic regression on shares of hashed byte 1- to 3-grams of the whole text; the metadata view is
one on source, language and size. Both start from labelled documents, LABELLED at most, chosen by a hash; in each round
both views score every unlabelled document on the executors, and each labels those that it is surest of, PER_ROUND of
each class at most, for the other to learn from. Only these come to the driver. Held-back labelled documents then
calibrate and weigh the views, and the combination scores every document.

Nulls and odd rows: a null or empty text has no text features and is scored by its metadata; null metadata are a value
of their own; a null doc_id is scored as any other and counts as unlabelled; repeated rows each get a score and are
learned from once; a doc_id labelled both ways is low quality; null labels are not learned from. Without labels of both kinds every score is 1 and all are
kept. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import shared as S
from emberlog.llm.language_id import ftrl

LABELLED = 3000
#: Chosen rows that are fetched at a time.
BATCH = 500
ROUNDS = 4
BITS = 13
META_BITS = 10
SURE = 0.95
PER_ROUND = 200
THRESHOLD = 0.5


def _grams(data: np.ndarray):
    """For n = 1, 2, 3: the bucket of the n-gram at each byte."""
    h = np.zeros(len(data), np.uint32)
    for n in (1, 2, 3):
        if len(data) < n:
            return
        h = h[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(n)
        g = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
        g ^= g >> np.uint32(13)
        yield n, (g * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, text and the hashed metadata features of each row."""
    have = set(docs.columns)
    size = F.col("n_chars").cast("double") if "n_chars" in have else F.length("text").cast("double")
    parts = [(c, F.col(c).cast("string") if c in have else F.lit(None).cast("string")) for c in ("source", "lang")]
    parts.append(("size", F.floor(F.log2(F.greatest(size, F.lit(1.0)))).cast("string")))
    meta = F.array(*(F.pmod(F.xxhash64(F.lit(n), F.coalesce(v, F.lit("?"))), F.lit(1 << META_BITS)).cast("int") for n, v in parts))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), meta.alias("meta"))


def _features(batches):
    for batch in batches:
        data, off = S.utf8(batch.column("text"))
        idx, val = [], []
        for a, b in zip(off[:-1], off[1:]):
            every = [g for _, g in _grams(data[a:b])]
            at, n = np.unique(np.concatenate(every), return_counts=True) if every else (np.zeros(0, np.int64), np.zeros(0))
            idx.append(at.astype(np.int32))
            val.append((100 * n / max(1, n.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("meta"), batch.column("label"), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], ["doc_id", "meta", "label", "idx", "val"])


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _line(rows, labels, size):
    """Weights of the log odds of label 1."""
    w = ftrl(rows, labels, 2, alpha=0.5, l1=1e-3, l2=1e-3, size=size)
    return w[:, 1] - w[:, 0]


def _logits(rows, w):
    return np.array([v @ w[i] for i, v in rows])


def stack(z: np.ndarray, y: np.ndarray, steps: int = 2000, l2: float = 1e-2) -> np.ndarray:
    """Calibrating weights of the views' log odds and an intercept, by penalised logistic regression on held-back rows."""
    scale = np.maximum(np.abs(z).std(0), 1e-6)
    x = np.c_[z / scale, np.ones(len(z))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        g = x.T @ (sigmoid(x @ w) - y) / len(y) + l2 * np.r_[w[:-1], 0] / len(y)
        w -= g
    return np.r_[w[:-1] / scale, w[-1]]


def co_train(views: list[list], labels: np.ndarray, sizes: list[int], rounds: int = ROUNDS, surest=None) -> list[np.ndarray]:
    """Weights of each view. `labels`: 0 or 1, or -1 for unlabelled rows that are at hand.

    `surest(weights)`, if given, returns further unlabelled rows: what each view is surest of, as (view, features of the
    rows in each view, their class).
    """
    known = [labels.copy() for _ in views]
    taught: list = [([], []) for _ in views]
    weights: list = [None] * len(views)
    for r in range(rounds + 1):
        for v, rows in enumerate(views):
            at = np.flatnonzero(known[v] >= 0)
            weights[v] = _line([rows[i] for i in at] + taught[v][0], np.concatenate((known[v][at], np.array(taught[v][1], known[v].dtype))), sizes[v])
        if r == rounds:
            break
        told = []
        for v, rows in enumerate(views):
            p = sigmoid(_logits(rows, weights[v]))
            for y, conf in ((1, p), (0, 1 - p)):
                other = 1 - v
                free = np.flatnonzero((known[other] < 0) & (conf >= SURE))
                told.append((other, free[np.argsort(-conf[free], kind="stable")][:PER_ROUND], y))
        for other, at, y in told:
            known[other][at] = y
        for v, features, y in surest(weights) if surest else ():
            taught[1 - v][0].append(features[1 - v])
            taught[1 - v][1].append(y)
    return weights


def _rows(got: pa.Table) -> list[tuple]:
    """The features of each row in the text view and in the metadata view."""
    one = np.ones(3)
    text = [(np.asarray(i.values, np.int64), np.asarray(v.values, np.float64)) for i, v in zip(got["idx"], got["val"])]
    meta = [(np.unique(np.asarray(m.values, np.int64)), one[: len(set(m.as_py()))]) for m in got["meta"]]
    return list(zip(text, meta))


FEATURES = "doc_id long, meta array<int>, label int, idx array<int>, val array<float>"


class Unlabelled:
    """The unlabelled rows of `docs`, in each round scored where they are."""

    def __init__(self, docs: DataFrame, known: DataFrame):
        m = metadata(docs)
        #: A row's name: repeated rows are one.
        self.rows = m.withColumn("key", F.xxhash64("doc_id", "text", "meta"))
        self.known = S.small(S.checkpoint(known.select("doc_id")), 1_000_000)
        self.told: list[set] = [set(), set()]  # by teaching view

    def best(self, weights: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """(view, class, key) of the rows that each view is surest of and has not told yet, by a distributed top-k."""
        model = {"text": (100 * weights[0]).astype(np.float32), "meta": weights[1]}
        z = self.rows.select("doc_id", "key", "text", "meta").mapInArrow(_logged(model), "doc_id long, key long, z0 double, z1 double")
        sure = float(np.log(SURE / (1 - SURE)))
        z = S.checkpoint(z.filter(f"abs(z0) >= {sure} or abs(z1) >= {sure}").join(self.known, "doc_id", "left_anti").select("key", "z0", "z1").distinct())
        tops = []
        for v in (0, 1):
            told = z.sparkSession.createDataFrame([(k,) for k in sorted(self.told[v])], "key long")
            free = z.join(F.broadcast(told), "key", "left_anti")
            for y in (1, 0):
                side = F.col(f"z{v}") if y else -F.col(f"z{v}")
                top = free.filter(side >= sure).orderBy(side.desc(), "key").limit(PER_ROUND)
                tops.append(top.select(F.lit(v).alias("v"), F.lit(y).alias("y"), "key"))
        out = [(r.v, r.y, r.key) for x in tops for r in x.collect()]
        for v, _, key in out:
            self.told[v].add(key)
        return out

    def __call__(self, weights: list[np.ndarray]) -> list[tuple]:
        chosen = self.best(weights)
        keys, features = sorted({k for _, _, k in chosen}), {}
        spark = self.rows.sparkSession
        for i in range(0, len(keys), BATCH):
            part = F.broadcast(spark.createDataFrame([(k,) for k in keys[i : i + BATCH]], "key long"))
            # the row's key takes the place of its doc_id
            rows = self.rows.join(part, "key").dropDuplicates(["key"]).select(F.col("key").alias("doc_id"), "text", "meta", F.lit(-1).alias("label"))
            got = rows.mapInArrow(_features, FEATURES).toArrow()
            features |= dict(zip(got["doc_id"].to_pylist(), _rows(got)))
        return [(v, features[k], y) for v, y, k in chosen]


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> dict | None:
    """A model from `docs` (doc_id, text, source, lang, n_chars) and `labels` (doc_id, quality)."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(labelled)
    rows = metadata(docs).join(F.broadcast(picked), "doc_id")
    # of rows that share a doc_id the one whose text has the largest hash is learned from
    one = rows.groupBy("doc_id").agg(F.max_by(F.struct("text", "meta", "label"), F.struct(F.xxhash64("text"), "meta")).alias("r")).select("doc_id", "r.*")
    got = one.mapInArrow(_features, FEATURES).toArrow()
    order = np.lexsort([[len(x) for x in got["idx"]], got["doc_id"].to_numpy()])
    y = np.minimum(got["label"].to_numpy(), 1)[order]
    if not ((y == 0).sum() >= 5 and (y == 1).sum() >= 5):
        return None
    rows = _rows(got)
    text, meta = [rows[i][0] for i in order], [rows[i][1] for i in order]
    at = np.arange(len(y))
    held = at % 4 == 3
    learn = at[~held]
    sizes = [1 << BITS, 1 << META_BITS]
    w = co_train([[text[i] for i in learn], [meta[i] for i in learn]], y[learn], sizes, surest=Unlabelled(docs, known))
    z = np.c_[_logits([text[i] for i in at[held]], w[0]), _logits([meta[i] for i in at[held]], w[1])]
    return {"text": (100 * w[0]).astype(np.float32), "meta": w[1], "mix": stack(z, y[held]), "one": [stack(z[:, [v]], y[held]) for v in (0, 1)]}


def _views(batch, model) -> np.ndarray:
    """The log odds of each row in both views."""
    data, off = S.utf8(batch.column("text"))
    z = np.zeros((batch.num_rows, 2))
    for i, m in enumerate(batch.column("meta").to_pylist()):
        z[i, 1] = model["meta"][sorted(set(m))].sum()
    for lo, hi in S.chunks(off):
        d, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        full = np.flatnonzero(np.diff(o))
        if not len(full):
            continue
        total, sums = np.zeros(len(full)), np.zeros(len(full))
        for n, g in _grams(d):
            ok = np.ones(len(d), np.float32)
            for j in range(1, n):  # n-grams that reach into the next row
                ends = o[1:][full] - j
                ok[ends[ends >= 0]] = 0
            part = model["text"][np.concatenate((g, np.zeros(n - 1, g.dtype)))] * ok
            sums += np.add.reduceat(part, o[:-1][full], dtype=np.float64)
            total += np.add.reduceat(ok, o[:-1][full], dtype=np.float64)
        z[lo + full, 0] = sums / np.maximum(total, 1)
    return z


def _logged(model):
    def score(batches):
        for batch in batches:
            z = _views(batch, model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(z[:, 0].copy()), pa.array(z[:, 1].copy())], ["doc_id", "key", "z0", "z1"])

    return score


def _scored(model):
    def score(batches):
        for batch in batches:
            z = _views(batch, model)
            p = [sigmoid(z[:, v] * model["one"][v][0] + model["one"][v][1]) for v in (0, 1)]
            both = sigmoid(z @ model["mix"][:2] + model["mix"][2])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in (*p, both))], ["doc_id", "p_text", "p_meta", "score"])

    return score


def classify(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, p_text, p_meta (calibrated views), score (combined, 1 is good) and kept."""
    m = metadata(docs)
    if model is None:
        out = m.select("doc_id", *(F.lit(1.0).alias(c) for c in ("p_text", "p_meta", "score")))
    else:
        out = m.mapInArrow(_scored(model), "doc_id long, p_text double, p_meta double, score double")
    return out.withColumn("kept", F.col("score") >= threshold)


def op10_quality_classifier(spark, sf_dir) -> DataFrame:
    docs = S.read(spark, sf_dir, "documents")
    return classify(docs, fit(docs, S.read(spark, sf_dir, "labels")))


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLES: dict = {}
