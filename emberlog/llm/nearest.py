"""Approximate nearest neighbours by cosine, with query-aware collision-counting hashing.

Vectors of length 1 are projected on PROJECTIONS random directions; each projection is an array of all vectors' values,
sorted. A vector collides with a query on a projection if it lies in the window of half-width WIDTH * R around the
query's own value. Vectors at a distance of R or less collide on a known share of the projections, so those that reach
the threshold which such a vector misses with a probability of MISS alone are verified with their exact cosine. Windows
start narrow and grow by virtual rehashing, R times GROWTH a round, each round counting only what came into the windows,
until the k best found are all within R.

Spark deals the index into blocks of about BLOCK vectors by a hash of the row; a block's arrays are one row of the index
table. A query first searches the block that holds it, which bounds the distance of its k best; every other block is then
searched once, with windows of that radius. Only the k best of a query in a block leave a task. Queries are a stated set;
they meet the blocks by a shuffle, CHUNK of them at a time, so that no task's memory grows with the table.

Every row is indexed, nothing is fitted. Recall is measured against brute force in the tests (0.9 is asked for).

Nulls and odd rows: a vector that is null, zero, empty or holds a null or non-finite component takes no part, as query or
candidate. A shorter vector counts as filled up with zeros. Rows that share an id are rows of their own, each a candidate
of the others and, where its id is asked for, each a query with its own ranks; a row without an id is a candidate, last
among ties. Equal vectors tie; ties go to the smaller id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm import shared as S

PROJECTIONS = 96
#: Half a window's width as a multiple of R: a vector at distance R collides on erf(WIDTH / sqrt 2) of the projections.
WIDTH = 1.0
#: The probability that a vector at a distance of R stays under the threshold.
MISS = 0.03
GROWTH = 1.2
FIRST_R = 0.01
#: At most 2**16: places in a block are stored in 16 bits.
BLOCK = 4096
CHUNK = 2048
BROADCAST_ROWS = 100_000
NEIGHBOURS = 5
EVERY = 50
#: What single precision may be off by.
ROUNDING = 1e-5
SEED = 20240817
_INDEX = "block int, rows binary, ids binary, vectors binary, values binary, orders binary"
_FOUND = "row long, query_id long, vec_id long, score double"
_NO_ID = np.iinfo(np.int64).max


def threshold(projections: int = PROJECTIONS, width: float = WIDTH, miss: float = MISS) -> int:
    """The most collisions that a vector at distance R falls short of with a probability of at most `miss`."""
    p, under = math.erf(width / math.sqrt(2)), 0.0
    for m in range(projections + 1):
        under += math.comb(projections, m) * p**m * (1 - p) ** (projections - m)
        if under > miss:
            return max(m, 1)
    return projections


def directions(dims: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(PROJECTIONS, dims))


def _vectors(column, dims: int) -> np.ndarray:
    """Rows of `dims` doubles, shorter ones filled up with zeros, scaled by a power of two so that no square overflows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims) < lengths[:, None]] = flat
    _, exponent = np.frexp(np.abs(out).max(1, initial=0))
    return np.ldexp(out, -exponent[:, None])


def _units(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1))[:, None]


def _ids(column) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy().astype(np.int64)


def _build(dims: int):
    def run(rows: pa.Table) -> pa.Table:
        v = _vectors(rows.column("v"), dims)
        values = (_units(v) @ directions(dims).T).T
        order = np.argsort(values, axis=1, kind="stable")
        cells = [rows.column("row").to_numpy(), _ids(rows.column("vec_id")), v, np.take_along_axis(values, order, 1).astype(np.float32), order.astype(np.uint16)]
        return pa.table({"block": pa.array([rows.column("block")[0].as_py()], pa.int32()), **{c: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for c, x in zip(("rows", "ids", "vectors", "values", "orders"), cells)}})

    return run


def sound(column: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


def numbered(df: DataFrame, vector: str = "embedding", keep: str = "vec_id", block: int = BLOCK) -> tuple[DataFrame, int, int]:
    """The table's sound rows (row, vec_id, v, block), the number of blocks and of dimensions."""
    rows = df.filter(sound(F.col(vector))).select(F.monotonically_increasing_id().alias("row"), F.col(keep).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    rows = S.table(rows)
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, math.ceil(n / block))
    return rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")), blocks, dims or 0


def index(rows: DataFrame, dims: int) -> DataFrame:
    """The index table: a row of sorted arrays for each block of `rows` (row, vec_id, v, block)."""
    return S.table(rows.groupBy("block").applyInArrow(_build(dims), _INDEX))


class _Block:
    """The arrays of one block, and its search."""

    def __init__(self, row: dict, dims: int):
        self.rows, self.ids = np.frombuffer(row["rows"], np.int64), np.frombuffer(row["ids"], np.int64)
        self.n = len(self.rows)
        self.vectors = np.frombuffer(row["vectors"]).reshape(self.n, dims)
        self.units = _units(self.vectors).astype(np.float32)
        # arrays one after the other, far enough apart that one search finds a window's ends in all of them
        values = np.frombuffer(row["values"], np.float32).astype(np.float64).reshape(PROJECTIONS, self.n)
        self.gap = 2 * (float(np.abs(values).max(initial=0)) + 1)
        self.values = (values + self.gap * np.arange(PROJECTIONS)[:, None]).ravel()
        self.orders = np.frombuffer(row["orders"], np.uint16).astype(np.intp)

    def window(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """The ends of the query's windows in the flat arrays."""
        low, high = (np.clip(x, -self.gap / 2, self.gap / 2) + self.gap * np.arange(PROJECTIONS) for x in (at - half, at + half))
        return np.searchsorted(self.values, low, "left"), np.searchsorted(self.values, high, "right")

    def search(self, unit: np.ndarray, at: np.ndarray, own: int, k: int, least: int, bound: float | None) -> np.ndarray:
        """Places in the block of the vectors that may be among the k best."""
        counts = np.zeros(self.n, np.intp)
        seen = np.zeros(self.n, bool)
        seen[self.rows == own] = True
        k = min(k, self.n - int(seen.sum()))
        found, scores = np.zeros(0, np.intp), np.zeros(0, np.float32)
        radius = FIRST_R if bound is None else bound
        low = high = None
        unit = unit.astype(np.float32)
        while k:
            a, b = self.window(at, WIDTH * radius + ROUNDING)
            whole = int((b - a).sum()) == self.n * PROJECTIONS
            if bound is not None or whole or int((b - a).sum()) >= least * k:  # fewer can't give k vectors
                low, high = (a, a) if low is None else (low, high)
                new = [self.orders[x:y] for x, y in zip(a.tolist(), low.tolist())] + [self.orders[x:y] for x, y in zip(high.tolist(), b.tolist())]
                counts += np.bincount(np.concatenate(new), minlength=self.n)
                low, high = a, b
                fresh = np.flatnonzero((counts >= least) & ~seen)
                seen[fresh] = True
                found, scores = np.concatenate((found, fresh)), np.concatenate((scores, self.units[fresh] @ unit))
                if bound is not None or whole:
                    break
                if len(found) >= k and _distance(np.partition(scores, -k)[-k]) <= radius:
                    break
            radius *= GROWTH
        if len(found) > k > 0:
            found = found[scores >= np.partition(scores, -k)[-k] - ROUNDING]
        return found


def _distance(cosine: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * float(cosine)))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of a vector with each row, the same for equal rows wherever they stand."""
    return (y * x).sum(1) / (math.sqrt((x * x).sum()) * np.sqrt((y * y).sum(1)))


def _search(dims: int, k: int):
    least = threshold()

    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        out = {"row": [], "query_id": [], "vec_id": [], "score": []}
        if queries.num_rows and blocks.num_rows:
            block = _Block({c: blocks.column(c)[0].as_buffer() for c in ("rows", "ids", "vectors", "values", "orders")}, dims)
            v = _vectors(queries.column("v"), dims)
            units = _units(v)
            at = units @ directions(dims).T
            own, ids, bounds = queries.column("row").to_pylist(), queries.column("vec_id").to_pylist(), queries.column("bound").to_pylist()
            for i in range(len(own)):
                near = block.search(units[i], at[i], own[i], k, least, bounds[i])
                score = cosines(v[i], block.vectors[near])
                best = np.lexsort((block.ids[near], -score))[:k]
                out["row"] += [own[i]] * len(best)
                out["query_id"] += [ids[i]] * len(best)
                out["vec_id"] += [None if x == _NO_ID else x for x in block.ids[near][best].tolist()]
                out["score"] += score[best].tolist()
        return pa.table({c: pa.array(x, pa.float64() if c == "score" else pa.int64()) for c, x in out.items()})

    return run


def _found(queries: DataFrame, table: DataFrame, dims: int, k: int) -> DataFrame:
    """Each query's best in the block that it is sent to; (row, vec_id, v, bound, block) by chunks of a block's queries."""
    counts = S.small(queries.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), BROADCAST_ROWS)
    table = table.join(counts, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    queries = queries.join(counts, "block").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int")).drop("chunks")
    return queries.groupBy("block", "chunk").cogroup(table.groupBy("block", "chunk")).applyInArrow(_search(dims, k), _FOUND)


def nearest(df: DataFrame, asked: Column, k: int = NEIGHBOURS, vector: str = "embedding", keep: str = "vec_id", block: int = BLOCK) -> DataFrame:
    """Per sound row of `df` for which `asked` holds, its k nearest: query_id, rank (from 1), vec_id, score."""
    rows, blocks, dims = numbered(df, vector, keep, block)
    table = index(rows, dims)
    queries = rows.filter(asked)
    first = _found(queries.withColumn("bound", F.lit(None).cast("double")), table, dims, k)
    if blocks > 1:
        first = S.table(first)
        # the k-th best so far is as far as any better one can be; fewer give no bound
        last = first.groupBy("row").agg(F.min("score").alias("s"), F.count("*").alias("c")).select("row", F.when(F.col("c") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("s"))) + ROUNDING).alias("bound"))
        queries = queries.join(last, "row", "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).filter("other <> block")
        rest = _found(queries.drop("block").withColumnRenamed("other", "block"), table, dims, k)
        first = first.unionByName(rest)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op11_nearest(spark, sf_dir) -> DataFrame:
    return nearest(S.read(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


QUERIES = {"op11_nearest": op11_nearest}
ORACLES: dict = {}
