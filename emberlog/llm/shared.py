"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _folder(spark: SparkSession) -> str:
    """The session's shared folder; a folder of this machine only where all of Spark is on it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Checkpoints between two collections of the driver's garbage.
COLLECT_EVERY = 6
_made = {"checkpoints": 0}


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the session's shared folder.

    Spark drops dead checkpoints, shuffles and broadcasts when the driver collects its garbage, which a driver with a
    large heap hardly does; so it is asked to now and then.
    """
    _folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    _made["checkpoints"] += 1
    if _made["checkpoints"] % COLLECT_EVERY == 0:
        df.sparkSession.sparkContext._jvm.System.gc()
    return out


def table(df: DataFrame) -> DataFrame:
    """Cut the lineage with a written table in the session's shared folder, which takes less room than a checkpoint."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only if `df` (cheap to count) is measured to have at most `rows` rows; else Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


_POWERS: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i in 0..n-1."""
    have = _POWERS.get("n", 0)
    if have < n:
        size = max(n, 2 * have, 1 << 16)
        for key, b in (("up", BASE), ("down", inverse(BASE))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
        _POWERS["n"] = size
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads a polynomial hash over all 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column without copying; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]] if len(o) else d, o - o[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges [lo, hi) of about `most` bytes each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` (A-Z lower-cased) of rows laid end to end, and each row's word offsets."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    upper = (data >= 65) & (data <= 90)
    low = data + (upper.view(np.uint8) << 5)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a row's first byte
    solid = ~gap
    start = np.flatnonzero(solid & (first[:n] | np.concatenate(([True], gap[:-1]))))
    end = np.flatnonzero(solid & (first[1:] | np.concatenate((gap[1:], [True])))) + 1
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start]), np.searchsorted(start, offsets)


def shingles(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width`-word shingles and each row's offsets; a row of fewer words is one shingle, without words none."""
    counts = np.diff(offsets)
    total = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_off = np.concatenate(([0], np.cumsum(total)))
    out = np.zeros(int(out_off[-1]), np.uint64)
    if not len(out):
        return out, out_off
    mult = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    if len(words) >= width:
        n = len(words) - width + 1
        every = np.zeros(n, np.uint64)
        for j in range(width):
            every += words[j : j + n] * mult[j]
        owner = np.repeat(np.arange(len(counts)), total)
        at = np.arange(len(out)) - out_off[owner] + offsets[owner]
        full = counts[owner] >= width
        out[full] = every[at[full]]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        w = words[offsets[i] : offsets[i + 1]]
        out[out_off[i]] = (w * mult[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))
    return mix(out), out_off


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least id reachable over undirected `edges` (a, b), by alternating large and small stars."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e, seen = checkpoint(e), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = checkpoint(star.filter("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
