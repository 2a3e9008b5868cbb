"""Embedding whitening with a covariance found by polarisation.

A vector's components c become whole numbers x = floor(256 * c). The fit list is each distinct x vector once. One pass
counts and sums it; a second one aggregates, for every dimension i and every pair of dimensions i < j, the squares of
the centred values of x_i and of x_i + x_j. Half the difference of the variances of a pair sum and of its two parts is
their covariance. All sums are of whole numbers and exact: tasks centre by the whole part of the mean, and the rest of
the mean, a whole number of n-ths, is taken off the squares afterwards, in whole numbers too. What the driver holds is
the covariance matrix, whose size depends on the number of dimensions alone; it is assembled there for `eigh`.

Nulls and odd rows: rows whose vector is null or holds a null or non-finite component are left out, as are those with a
component of 2**53 or more after scaling, which has no exact whole number. A shorter vector counts as filled up with
zeros, an empty one as all zeros. Repeated rows and ids are transformed each; a null id stays null. A component without
variance has no whitened value (null), nor an `identity_error`; without any variance `explained` is null too. `deviation`
is a decimal; one of 38 digits or more is null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import shared as S

SCALE = 256
COMPONENTS = 4
#: Rows of a block of a task's sums.
BLOCK = 4096
#: Eigenvalues below this share of the largest count as no variance.
FLAT = 1e-12


def scaled(df: DataFrame, vector: str = "embedding", keep: str = "vec_id") -> DataFrame:
    """(vec_id, x) of the rows whose vector is sound, as long as the table's longest vector."""
    c = F.col(vector)
    sound = F.forall(c, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < (1 << 53) / SCALE), F.lit(False)))
    rows = df.filter(c.isNotNull() & sound).select(F.col(keep).alias("vec_id"), F.transform(c, lambda v: F.floor(v.cast("double") * SCALE).cast("long")).alias("x"))
    shape = rows.agg(F.max(F.size("x")), F.min(F.size("x"))).first()
    if shape[0] is None or shape[0] == shape[1]:
        return rows
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(shape[0]) - F.size("x"))))


def _matrix(batch, name="x") -> np.ndarray:
    column = batch.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _blocks(batches):
    for batch in batches:
        x = _matrix(batch)
        for lo in range(0, len(x), BLOCK):
            yield x[lo : lo + BLOCK]


def _safe(block: np.ndarray, terms: int) -> np.ndarray:
    """The block in 64 bits if squares of pair sums can be summed `terms` times in them, else in unbounded numbers."""
    top = int(np.abs(block).max(initial=0))
    return block if 4 * top * top * max(terms, 1) < 1 << 62 else block.astype(object)


def _rows(i: list, j: list, values: list) -> pa.RecordBatch:
    kind = pa.decimal128(38, 0)
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(v) for v in values], kind)], ["i", "j", "v"])


def _sums(batches):
    n, total = 0, []
    for x in _blocks(batches):
        total = total or [0] * x.shape[1]
        total = [t + int(v) for t, v in zip(total, _safe(x, len(x)).sum(0))]
        n += len(x)
    if n:
        yield _rows([-1, *range(len(total))], [-1] * (len(total) + 1), [n, *total])


def _squares(centre: list[int]):
    def run(batches):
        own, pairs = None, None
        for x in _blocks(batches):
            z = _safe(x - np.array(centre, np.int64), len(x))
            if own is None:
                own, pairs = [0] * z.shape[1], [[0] * (z.shape[1] - i - 1) for i in range(z.shape[1])]
            for i in range(z.shape[1]):
                own[i] += int((z[:, i] * z[:, i]).sum())
                both = z[:, i + 1 :] + z[:, i : i + 1]
                pairs[i] = [p + int(v) for p, v in zip(pairs[i], (both * both).sum(0))]
        if own is not None:
            d = len(own)
            i, j = [*range(d), *(a for a in range(d) for _ in range(a + 1, d))], [*range(d), *(b for a in range(d) for b in range(a + 1, d))]
            yield _rows(i, j, [*own, *(v for p in pairs for v in p)])

    return run


_SUMMED = "i int, j int, v decimal(38,0)"


def _totals(df: DataFrame) -> dict:
    return {(r.i, r.j): int(r.v) for r in df.groupBy("i", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()}


class Whitening:
    """What a fit list gives: `n`, the sums `sums`, `covariance`, `eigenvalues` (falling), `axes` (a column each)."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray):
        self.n, self.sums, self.covariance = n, sums, covariance
        e, u = np.linalg.eigh(covariance) if n else (np.zeros(0), np.zeros((0, 0)))
        self.eigenvalues, self.axes = e[::-1].copy(), u[:, ::-1].copy()
        self.trace = float(np.trace(covariance)) if n else 0.0

    def explained(self, k: int) -> float | None:
        return float(self.eigenvalues[k]) / self.trace if self.trace > 0 else None

    def flat(self, k: int) -> bool:
        return not self.eigenvalues[k] > FLAT * self.eigenvalues[0]


def fit(distinct: DataFrame) -> Whitening:
    """The whitening of the rows of `distinct` (x), which are read twice: hand over a written table."""
    sums = _totals(distinct.select("x").mapInArrow(_sums, _SUMMED))
    if not sums:
        return Whitening(0, [], np.zeros((0, 0)))
    n = sums.pop((-1, -1))
    s = [sums[i, -1] for i in range(len(sums))]
    centre = [v // n for v in s]
    rest = [v - n * c for v, c in zip(s, centre)]  # n times the mean of x - centre
    q = _totals(distinct.select("x").mapInArrow(_squares(centre), _SUMMED))
    # sums of (n * x - S)**2 from those of (x - centre)**2
    exact = {(i, j): n * n * v - n * (rest[i] if i == j else rest[i] + rest[j]) ** 2 for (i, j), v in q.items()}
    v = np.zeros((len(s), len(s)))
    for (i, j), both in exact.items():
        v[i, j] = v[j, i] = both / n**3 if i == j else (both - exact[i, i] - exact[j, j]) / (2 * n**3)
    return Whitening(n, s, v)


def _transform(model: Whitening, k: int, deviations: bool = True):
    n, sums = model.n, model.sums
    centre = [v // n for v in sums]
    part = np.array([(v - n * c) / n for v, c in zip(sums, centre)])
    axes = model.axes[:, :k] / np.array([1.0 if model.flat(i) else np.sqrt(model.eigenvalues[i]) for i in range(k)])
    blank = [i for i in range(k) if model.flat(i)]

    def run(batches):
        for batch in batches:
            x = _matrix(batch)
            for lo in range(0, len(x), BLOCK):
                # the whole part comes off in whole numbers, so large means cost no digits
                z = x[lo : lo + BLOCK] - np.array(centre, np.int64)
                white = (z - part) @ axes
                values = [[None if i in blank else float(v) for i, v in enumerate(row)] for row in white]
                columns = [batch.column("vec_id").slice(lo, len(z)), pa.array(values, pa.list_(pa.float64()))]
                if deviations:
                    rest = [v - n * c for v, c in zip(sums, centre)]
                    top = n * (int(np.abs(z).max(initial=0)) + 1)
                    y = z * n - np.array(rest, np.int64) if top * top * max(z.shape[1], 1) < 1 << 62 else z.astype(object) * n - np.array(rest, object)
                    square = (y * y).sum(1)
                    columns.append(pa.array([Decimal(int(v)) if v < 10**38 else None for v in square], pa.decimal128(38, 0)))
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "white", "deviation"][: len(columns)])

    return run


def identity_error(distinct: DataFrame, model: Whitening, k: int) -> float | None:
    """The largest entry, without sign, of the whitened fit list's covariance minus the identity, as measured on its rows."""
    if not k or any(model.flat(i) for i in range(k)):
        return None
    rows = distinct.select("x", F.lit(None).cast("long").alias("vec_id")).mapInArrow(_transform(model, k, False), "vec_id long, white array<double>")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.agg(*(F.covar_pop(F.col("white")[i], F.col("white")[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(df: DataFrame, components: int = COMPONENTS, vector: str = "embedding", keep: str = "vec_id") -> DataFrame:
    """Per sound row of `df` and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows = scaled(df, vector, keep)
    distinct = S.table(rows.select("x").distinct())
    model = fit(distinct)
    k = min(components, len(model.sums))
    error = identity_error(distinct, model, k)
    if k:
        white = rows.mapInArrow(_transform(model, k), f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, white array<double>, deviation decimal(38,0)")
    else:
        white = rows.limit(0).select("vec_id", F.array().cast("array<double>").alias("white"), F.lit(None).cast("decimal(38,0)").alias("deviation"))
    shares = F.array(*(F.lit(model.explained(i)).cast("double") for i in range(k)))
    white = white.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return white.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        (F.element_at(shares, F.col("at") + 1) if k else F.lit(None).cast("double")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def op13_embedding_whitening(spark, sf_dir) -> DataFrame:
    return whiten(S.read(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as long)"))


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
ORACLES: dict = {}
