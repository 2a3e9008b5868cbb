"""Benchmark decontamination by q-gram lemma filtering in diagonal bands and banded alignment.

Texts are normalised (lower case; anything but letters and digits becomes one blank). Every benchmark item is cut into
windows of WINDOW characters at every STEP (an item of up to WINDOW is one window), so that an excerpt of WINDOW + STEP
characters holds one wholly, and a document is contaminated by an item if some stretch of it is within the edit budget,
RATE of the window's length, of one of its windows. An item of fewer than Q characters has no q-gram and contaminates
the documents that are equal to it. A window with m characters and budget e shares at least m - Q + 1 - Q * e of its q-grams with such a stretch, on
diagonals that span at most e: shared q-grams are counted in overlapping bands of diagonals, bands that reach the bound
are candidates, and a banded alignment with free ends decides.

The windows are held in memory in blocks of at most BLOCK; a larger benchmark takes one more step over the documents
for each block. Documents are never moved. Where many windows share a text's q-grams, the text is searched in
overlapping halves until the postings at hand are few, so memory is bounded.

Nulls and odd rows: a null or empty text is clean; a null or empty item matches nothing; the item with a null item_id is
reported as null, after the others; a null doc_id is judged as any other row; repeated rows each get their verdict;
repeated item_ids are one item. An empty benchmark leaves all clean. Whole texts are read. Other columns are ignored, or
passed on if asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import shared as S

Q = 12
WINDOW = 100
RATE = 0.06
STEP = 25
BLOCK = 50_000
#: Blocks that one stage judges, each in a Python worker of its own; then the verdicts so far are written as a table.
CHAIN = 4
#: Postings at hand at a time, beyond which a text is halved.
MOST = 2_000_000
_OTHER = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), off


def budget(m: int, rate: float) -> int:
    """Edits allowed in a window of m characters: so few that one shared q-gram at least is sure."""
    return max(0, min(int(rate * m), (m - Q) // Q))


def _windows(window, step):
    def cut(batches):
        for batch in batches:
            ids, out = [], []
            for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                t = normalised(t)
                last = max(0, len(t) - window)
                for a in sorted({*range(0, last, step), last}) if t else ():
                    ids.append(i)
                    out.append(t[a : a + window])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["item_id", "window"])

    return cut


def _grams(c: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q-gram at each position."""
    if len(c) < Q:
        return np.zeros(0, np.uint64)
    up, down = S.powers(len(c))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((c.astype(np.uint64) + np.uint64(1)) * up)))
    return S.mix((sums[Q:] - sums[:-Q]) * down[: len(c) - Q + 1])


class Index:
    """Postings of the windows' q-grams."""

    def __init__(self, windows: list[tuple[int | None, str]], rate: float):
        #: items whose whole text is too short for a q-gram, by text
        self.short: dict[str, set] = {}
        for i, w in windows:
            if len(w) < Q:
                self.short.setdefault(w, set()).add(i)
        windows = [x for x in windows if len(x[1]) >= Q]
        self.items = [i for i, _ in windows]
        self.codes, self.off = codes([w for _, w in windows])
        self.size = np.diff(self.off)
        self.edits = np.array([budget(m, rate) for m in self.size.tolist()], np.int64)
        self.least = self.size - Q + 1 - Q * self.edits
        self.reach = int((self.size + self.edits).max()) if windows else 0
        at = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b - Q + 1) for a, b in zip(self.off[:-1], self.off[1:]))])
        h = _grams(self.codes)[at]
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        owner = np.searchsorted(self.off, at, "right") - 1
        self.owner, self.place = owner[order], (at - self.off[owner])[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.hash >> np.uint64(42)] = True

    def matches(self, c: np.ndarray, off: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
        """(row, window) pairs of texts laid end to end in `c` that hold a stretch within the window's budget."""
        if not self.items:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = _grams(c)
        at = np.flatnonzero(self.bits[h >> np.uint64(42)]) if len(h) else np.zeros(0, np.int64)
        lo = np.searchsorted(self.hash, h[at], "left")
        n = np.searchsorted(self.hash, h[at], "right") - lo
        row = np.searchsorted(off, at, "right") - 1
        ok = (n > 0) & (at + Q <= off[row + 1])
        at, lo, n, row = at[ok], lo[ok], n[ok], row[ok]
        if n.sum() > most and (halves := self._halves(c, off)):
            found = [(r + first, w) for cut, o, first in halves for r, w in [self.matches(cut, o, most)]]
            pairs = np.unique(np.concatenate([np.stack(x, 1) for x in found]), axis=0)
            return pairs[:, 0], pairs[:, 1]
        post = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else lo, n) + np.arange(n.sum())
        at, row = np.repeat(at, n), np.repeat(row, n)
        win, place = self.owner[post], self.place[post]
        step = self.edits[win] + 1
        band = (at - off[row] - place + self.size[win]) // step  # diagonals shifted to be positive
        span = 1 << 30
        key = np.concatenate([((row * len(self.items) + win) * span + band - j) for j in (0, 1)])
        both = np.unique(np.stack((key, np.tile(place, 2)), 1), axis=0) if len(key) else np.zeros((0, 2), np.int64)
        key, count = np.unique(both[:, 0], return_counts=True)
        # a band of -1 must not run into the key before it
        win, row, band = ((key + 1) // span) % len(self.items), (key + 1) // span // len(self.items), (key + 1) % span - 1
        ok = count >= self.least[win]
        row, win, band = row[ok], win[ok], band[ok]
        ok = self.aligned(c, off, row, win, band)
        return row[ok], win[ok]

    def _halves(self, c: np.ndarray, off: np.ndarray):
        """The rows in two halves; a single row in two parts that overlap by the longest stretch; none if it is short."""
        k = len(off) - 1
        if k > 1:
            m = k // 2
            return [(c[: off[m]], off[: m + 1], 0), (c[off[m] :], off[m:] - off[m], m)]
        if len(c) < 4 * self.reach:
            return None
        m = len(c) // 2
        return [(x, np.array([0, len(x)]), 0) for x in (c[: m + self.reach], c[m - self.reach :])]

    def aligned(self, c, off, row, win, band) -> np.ndarray:
        """Whether each candidate's banded alignment, free at both ends of the text, is within the budget."""
        good = np.zeros(len(row), bool)
        for e in np.unique(self.edits[win]):
            for m in np.unique(self.size[win][self.edits[win] == e]):
                at = np.flatnonzero((self.edits[win] == e) & (self.size[win] == m))
                low = band[at] * (e + 1) - m - e
                diag = low[:, None] + np.arange(2 * (e + 1) + 2 * e)
                cost, ramp = np.zeros(diag.shape, np.int32), np.arange(diag.shape[1], dtype=np.int32)
                start, end = off[row[at]][:, None], off[row[at] + 1][:, None]
                for i in range(int(m)):
                    pos = start + diag + i
                    same = (pos >= start) & (pos < end)
                    same &= c[np.clip(pos, 0, len(c) - 1)] == self.codes[self.off[win[at]] + i][:, None]
                    new = cost + ~same
                    new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
                    cost = np.minimum.accumulate(new - ramp, 1) + ramp
                good[at] = cost.min(1) <= e
        return good


def _judged(windows, rate, most):
    """The block's items in each text. Only texts come to Python and only ids go back; all columns else stay in Spark."""

    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(windows.value, rate)
        for col in columns:
            _, sizes = S.utf8(col)
            hits: list = [set() for _ in range(len(col))]
            for lo, hi in S.chunks(sizes, S.CHUNK_BYTES // 2):
                texts = [normalised(t) for t in col.slice(lo, hi - lo).to_pylist()]
                for r, t in enumerate(texts):
                    if index.short and len(t) < Q:
                        hits[lo + r] |= index.short.get(t, set())
                for r, w in zip(*index.matches(*codes(texts), most)):
                    hits[lo + r].add(index.items[w])
            yield pa.array([list(x) for x in hits], pa.list_(pa.int64()))

    return F.arrow_udf(judge, "array<bigint>")


def judged(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, window: int = WINDOW, step: int = STEP, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """`docs` (text, items array<bigint>, ...) with the item_ids of `benchmark` (item_id, text) found in `items`, null last."""
    cut = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(_windows(window, step), "item_id long, window string").distinct()
    cut = S.checkpoint(cut)
    blocks = -(-cut.count() // block)
    for b in range(blocks):  # each block's size is bounded, whatever the benchmark's
        part = cut.filter(F.pmod(F.xxhash64("item_id", "window"), F.lit(blocks)) == b) if blocks > 1 else cut
        rows = docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in part.collect()])
        if rows.value:
            found = _judged(rows, rate, most)(F.col("text").cast("string"))
            docs = docs.withColumn("items", F.array_sort(F.array_distinct(F.concat("items", found))))
        if b % CHAIN == CHAIN - 1 and b < blocks - 1:
            docs = S.table(docs)
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, contaminated, and the item_ids of `benchmark` (item_id, text) found."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.expr("cast(array() as array<bigint>)").alias("items"))
    return judged(rows, benchmark, **options).select("doc_id", (F.size("items") > 0).alias("contaminated"), F.col("items").alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` (text, ...), with all their columns, in which no item of `benchmark` is found."""
    names = docs.columns
    inner = [n if n == "text" else f"c{i}" for i, n in enumerate(names)]  # `items` may be a column of theirs
    rows = docs.toDF(*inner).withColumn("items", F.expr("cast(array() as array<bigint>)"))
    return judged(rows, benchmark, **options).filter(F.size("items") == 0).select(*inner).toDF(*names)


def op8_decontamination(spark, sf_dir) -> DataFrame:
    return contamination(S.read(spark, sf_dir, "documents"), S.read(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontamination": op8_decontamination}
ORACLES: dict = {}
