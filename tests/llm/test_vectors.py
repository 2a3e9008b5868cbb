"""Embedding whitening, nearest neighbours: brute force, exact sums and odd rows."""

import math
from fractions import Fraction

import numpy as np

import pytest
from pyspark.sql import functions as F

from emberlog.llm import nearest, whitening

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<double>, white string"


def _covariance(x):
    """The covariance of whole-number rows, exact before the last division."""
    n, x = len(x), np.array(x, object)
    y = x * n - x.sum(0)
    return [[Fraction(c, n**3) for c in r] for r in y.T @ y]


def _whitened(rows, k):
    """{(vec_id, component): (deviation, whitened)}, eigenvalue shares; by plain loops and numpy."""
    x = {i: tuple(math.floor(256 * c) for c in v) for i, v in rows}
    fit = sorted(set(x.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    e, u = np.linalg.eigh(np.array([[float(c) for c in r] for r in _covariance(fit)]))
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, v in x.items():
        z = np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums)])
        for c in range(k):
            out[i, c + 1] = sum((n * a - s) ** 2 for a, s in zip(v, sums)), float(z @ u[:, c]) / math.sqrt(e[c])
    return n, out, e / e.sum()


def _same(got, rows, k):
    n, want, shares = _whitened(rows, k)
    assert {(r.vec_id, r.component) for r in got} == set(want) and len(got) == len(want)
    sign = {}
    for r in got:
        deviation, white = want[r.vec_id, r.component]
        assert (r.n, int(r.deviation)) == (n, deviation)
        assert math.isclose(r.explained, shares[r.component - 1], rel_tol=1e-9) and r.identity_error < 1e-6
        if abs(white) > 1e-6:
            sign.setdefault(r.component, math.copysign(1, white * r.whitened))
            assert math.isclose(sign[r.component] * r.whitened, white, rel_tol=1e-6, abs_tol=1e-8)


def test_whitening_equals_exact_covariance(spark):
    rng = np.random.default_rng(5)
    base = (rng.normal(size=(60, 6)) * [9, 5, 3, 2, 1, 0.5] + [1e6, -3e5, 0, 7, -7, 1e9]).tolist()
    rows = [(i, v) for i, v in enumerate(base + base[:25])]  # repeated vectors count once in the fit
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS)
    _same(whitening.whiten(df).collect(), rows, 4)
    # components so large that squares leave 64 bits
    big = [(i, [c * 2.0**40 for c in v[:3]]) for i, v in enumerate((rng.normal(size=(9, 3)) * [3, 2, 1]).tolist())]
    _same(whitening.whiten(spark.createDataFrame([(i, v, "x") for i, v in big], VECTORS)).collect(), big, 3)


def test_whitening_query_on_the_table(spark):
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    out = whitening.op13_embedding_whitening(spark, SF)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    _same(out.collect(), rows, 4)


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1e300, 1.0])]
    good = [(6, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [2.0]), (8, []), (9, [0.5, -1.0])]
    got = whitening.whiten(spark.createDataFrame([(i, v, "x") for i, v in bad + good], VECTORS)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (6, 1), (6, 1), (6, 2), (6, 2), (8, 1), (8, 2), (9, 1), (9, 2)]
    assert {r.n for r in got} == {4} and all(r.identity_error < 1e-9 for r in got)
    same = whitening.whiten(spark.createDataFrame([(1, [3.0, 3.0], "x"), (2, [3.0, 3.0], "x")], VECTORS)).collect()
    assert [(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, None, None, None)] * 4
    for rows in ([], [(1, None, "x")], [(1, [], "x")]):
        assert whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect() == []
    # one direction without variance among others
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i], "x") for i in range(5)], VECTORS)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line)


def _brute(rows, every, k):
    """{query row: [(rank, vec_id, score)]} over (vec_id, vector) rows, by all cosines."""
    v = np.array([r[1] for r in rows], float)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    out = {}
    for i, (q, _) in enumerate(rows):
        if q is not None and q % every == 0:
            score = unit @ unit[i]
            best = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-round(score[j], 12), rows[j][0] is None, rows[j][0] or 0))[:k]
            out[i] = [(r + 1, rows[j][0], score[j]) for r, j in enumerate(best)]
    return out


def _recall(got, want):
    """The share of the true neighbours found; scores and order are checked on the way."""
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    hits = 0
    for q, best in want.items():
        found = sorted(by.get(q, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, len(best) + 1))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & {x[1] for x in best})
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("sf,block", [("sf0.01", 4096), ("sf0.1", 256)])
def test_nearest_recall_on_the_table(spark, sf, block):
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    want = {rows[i][0]: best for i, best in _brute(rows, 50, 5).items()}
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    got = nearest.nearest(df, F.col("vec_id") % 50 == 0, block=block).collect()
    true = {(i, v): s for i, best in _brute(rows, 50, len(rows)).items() for _, v, s in best}
    assert all(math.isclose(r.score, true[r.query_id, r.vec_id], abs_tol=1e-12) for r in got if r.query_id == rows[r.query_id][0])
    assert {r.query_id for r in got} == set(want) and _recall(got, want) >= 0.95


def test_nearest_copies_and_clusters(spark):
    rng = np.random.default_rng(11)
    middle, other = rng.normal(size=16), rng.normal(size=16)
    rows = [(i, (middle + 0.01 * rng.normal(size=16) * (i % 3 > 0)).tolist()) for i in range(300)]  # a third are copies
    rows += [(300 + i, (other + 0.3 * rng.normal(size=16)).tolist()) for i in range(200)] + [(500 + i, rng.normal(size=16).tolist()) for i in range(400)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS)
    got = nearest.nearest(df, F.col("vec_id") % 50 == 0, block=64).collect()
    want = {rows[i][0]: best for i, best in _brute(rows, 50, 5).items()}
    assert _recall(got, want) >= 0.95
    # of equal copies the smallest ids come first
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 150] == [0, 3, 6, 9, 12]


def test_nearest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(50, None), (100, [1.0, None]), (150, [nan, 1.0]), (200, [inf]), (250, [0.0, 0.0]), (300, [])]
    good = [(0, [2.0**700, 2.0**700, 0.0]), (0, [1.0, 0.9, 0.0]), (7, [3.0]), (None, [2.0, 2.0, 0.0]), (9, [-(2.0**-700), -(2.0**-700)]), (7, [3.0])]
    got = nearest.nearest(spark.createDataFrame([(i, v, "x") for i, v in bad + good], VECTORS), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == sorted([(0, i) for i in range(1, 6)] * 2)
    firsts = sorted((r.vec_id is not None, r.vec_id or 0, round(r.score, 6)) for r in got if r["rank"] == 1)
    assert firsts == [(False, 0, 1.0), (True, 0, 0.998618)]
    assert [round(r.score, 6) for r in got if r.vec_id == 9] == [-1.0, -0.998618]
    for rows in ([], [(0, None, "x")]):
        assert nearest.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0).collect() == []
    assert nearest.nearest(spark.createDataFrame([(0, [1.0], "x")], VECTORS), F.lit(True)).collect() == []
