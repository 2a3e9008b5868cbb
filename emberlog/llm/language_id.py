"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased, everything but letters becomes a blank, and its character 1- to 3-grams are hashed into BUCKETS
features; a feature's weight is its share of the text's n-grams times its inverse document frequency. Document
frequencies are counted over all training documents. The regression is fitted by follow-the-regularised-leader (FTRL
proximal) with elastic-net penalties on at most SAMPLE training documents a language, chosen by a hash of their texts,
and a temperature is then fitted on the part of that sample that the regression has not seen. Every language with a
training document is learned; the model grows with their number.

Nulls and odd rows: a null text, or one without a letter, is `und` with score 0. A null lang is not learned from. A null
doc_id counts as a training document if it has a lang, and is returned as any other row. Repeated rows count repeatedly
in the document frequencies and once in the fit, as do equal texts of a language. Without any training document every
text is `und`. Texts are read whole. Other columns are ignored, or passed on if asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm import shared as S

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Training documents a language at most that the regression is fitted on.
SAMPLE = 800
EPOCHS = 3
UNKNOWN = "und"
_ASCII = re.compile(r"[A-Za-z]")
_BLANK = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    """Whether a text holds a character of a letter category."""
    return bool(_ASCII.search(text)) or any(c.isalpha() for c in set(text))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised texts laid end to end, each with a blank on both sides, and their offsets."""
    norm = [" " + _BLANK.sub(" ", t.lower()) + " " for t in texts]
    off = np.concatenate(([0], np.cumsum([len(t) for t in norm])))
    return np.frombuffer("".join(norm).encode("utf-32-le", "replace"), np.uint32), off


def _hashed(codes: np.ndarray, off: np.ndarray):
    """For each order: the bucket of the n-gram at each position, and where the n-gram would leave its text."""
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in ORDERS:
            g = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            g = (g ^ (g >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            yield n, g >> shift


def _batches(column: pa.Array, most: int = S.CHUNK_BYTES // 2):
    """The texts of ranges of rows, of bounded size."""
    _, off = S.utf8(column)
    for lo, hi in S.chunks(off, most):
        yield [t or "" for t in column.slice(lo, hi - lo).to_pylist()]


def _frequencies(batches):
    df, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for texts in _batches(batch.column("text")):
            codes, off = _codes(texts)
            grams = list(_hashed(codes, off))
            for a, b in zip(off[:-1], off[1:]):
                seen = np.zeros(BUCKETS, bool)
                for k, g in grams:
                    seen[g[a : max(a, b - k + 1)]] = True
                df += seen
                n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["bucket", "df"])


def _features(idf):
    def take(batches):
        for batch in batches:
            idx, val = [], []
            for texts in _batches(batch.column("text")):
                codes, off = _codes(texts)
                grams = list(_hashed(codes, off))
                for a, b in zip(off[:-1], off[1:]):
                    at, tf = np.unique(np.concatenate([g[a : max(a, b - k + 1)] for k, g in grams]), return_counts=True)
                    idx.append(at.astype(np.int32))
                    val.append((tf / max(1, tf.sum()) * idf[at]).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], ["lang", "idx", "val"])

    return take


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list, labels: np.ndarray, k: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, epochs: int = EPOCHS, seed: int = 7, size: int = BUCKETS) -> np.ndarray:
    """Weights (size, k) of multinomial logistic regression by FTRL-proximal with l1 and l2 penalties."""
    z, n = np.zeros((size, k)), np.zeros((size, k))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = softmax(x @ w)
            p[labels[i]] -= 1
            g = np.outer(x, p)
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on held-back rows."""
    if not len(labels):
        return 1.0
    tries = np.geomspace(0.02, 20, 61)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in tries]
    return float(tries[int(np.argmin(loss))])


def fit(train: DataFrame, sample: int = SAMPLE) -> dict | None:
    """A model from the rows of `train` (doc_id, text, lang) with text and lang."""
    train = train.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    found = {r["bucket"]: r["df"] for r in train.select("text").mapInArrow(_frequencies, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()}
    docs = found.pop(-1, 0)
    if not docs:
        return None
    df = np.zeros(BUCKETS)
    df[list(found)] = list(found.values())
    idf = np.log((1 + docs) / (1 + df)) + 1
    sizes = train.groupBy("lang").agg(F.count("*").alias("n"))
    langs = sorted(r["lang"] for r in sizes.select("lang").collect())
    # about as many rows as are needed pass a bound on their hash, so that no task ranks a whole language
    h = F.xxhash64(F.lit(17), "text")
    keyed = train.select("lang", h.alias("h")).join(F.broadcast(sizes), "lang")
    few = keyed.filter(F.expr("h / 18446744073709551616D + 0.5") * F.col("n") < sample + 8 * sample**0.5 + 64).select("lang", "h").distinct()
    cut = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= sample).select("lang", "h")
    chosen = train.withColumn("h", h).join(F.broadcast(cut), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])
    got = chosen.select("lang", "text").mapInArrow(_features(idf), "lang string, idx array<int>, val array<float>").toArrow()
    labels = np.searchsorted(langs, np.array(got["lang"].to_pylist()))
    rows = [(i.values.to_numpy(), v.values.to_numpy()) for i, v in zip(got["idx"], got["val"])]
    order = np.lexsort([[float(v.sum()) for _, v in rows], [len(i) for i, _ in rows], labels])  # not by arrival
    rows, labels = [rows[i] for i in order], labels[order]
    held = np.arange(len(rows)) % 5 == 4
    weights = ftrl([r for r, x in zip(rows, held) if not x], labels[~held], len(langs))
    logits = np.array([v @ weights[i] for (i, v), x in zip(rows, held) if x]).reshape(-1, len(langs))
    return {"langs": langs, "weights": (weights * idf[:, None]).astype(np.float32), "temperature": temperature(logits, labels[held])}


def _scored(model):
    """For a column of texts: the predicted languages and their scores."""
    # the buckets that carry weight, with their rows of weights side by side
    table = np.ascontiguousarray(model["weights"].T) if model else None

    def score(column: pa.Array) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for texts in _batches(column):
            letters = np.array([has_letter(t) for t in texts], bool)
            if model is None:
                langs += [UNKNOWN] * len(texts)
                scores += [0.0] * len(texts)
                continue
            codes, off = _codes(texts)
            k = len(model["langs"])
            logits, total = np.zeros((len(texts), k)), np.zeros(len(texts))
            for n, g in _hashed(codes, off):
                ok = np.ones(len(codes), bool)
                for j in range(1, n):  # n-grams that reach into the next text don't count
                    ok[off[1:] - j] = False
                g = np.concatenate((g, np.zeros(n - 1, g.dtype)))
                total += np.diff(off) - n + 1
                for c in range(k):
                    logits[:, c] += np.add.reduceat(table[c][g] * ok, off[:-1])
            p = softmax(logits / np.maximum(total, 1)[:, None] / model["temperature"])
            best = p.argmax(1)
            langs += [model["langs"][b] if x else UNKNOWN for b, x in zip(best, letters)]
            scores += np.where(letters, p[np.arange(len(texts)), best], 0.0).tolist()
        return langs, scores

    return score


def _predicted(model):
    def predict(batches):
        score = _scored(model)
        for batch in batches:
            langs, scores = score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return predict


def _sure(model):
    """The score of each text's language; null for `und`. Only texts come to Python and only scores go back."""

    def sure(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = _scored(model)
        for column in columns:
            langs, scores = score(column)
            yield pa.array([None if x == UNKNOWN else s for x, s in zip(langs, scores)], pa.float64())

    return F.arrow_udf(sure, "double")


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of `docs` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_predicted(model), "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: dict | None, least: float) -> DataFrame:
    """The rows of `docs`, with all their columns, whose language has a score of `least`; without a model, all with a letter."""
    if model is None:
        return docs.filter(F.col("text").cast("string").rlike(r"\p{L}"))
    return docs.filter(_sure(model)(F.col("text").cast("string")) >= least)


def held_out():
    """The rows that the query's contract keeps from training; a null doc_id is not among them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op5_language_id(spark, sf_dir) -> DataFrame:
    docs = S.read(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
ORACLES: dict = {}
