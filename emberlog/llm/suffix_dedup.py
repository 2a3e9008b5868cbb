"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

Every string of `match` bytes (a window) has one anchor: its k-gram with the least hash, the leftmost if several have
it. Equal windows have equal anchors at equal places, so windows only have to be compared under the same anchor. All
windows of one anchor occurrence make up its context. Occurrences go to the part of their anchor's hash, once; those
with equal contexts are settled there by counting (and, before they move, within each task), all but the first go, and
anchors with one context are dropped.

Contexts that differ under one anchor are compared byte by byte: within each part batches in document order get a
suffix array (the suffixes at their anchors, in order of anchor hash and following bytes), are merge-scanned against
the arrays of earlier batches for matches of `match` bytes around the anchor, and arrays of equal size merge, so that a
part keeps logarithmically many. An anchor with more than `pairs` different contexts is split by longer strings: the
windows of its contexts get anchors anew, with a longer k-gram, and take the same way again; k ends at `match`, where a
context is one window and nothing is left to compare.

Anchors count by 64-bit hashes, and equal contexts by those together with a 64-bit hash of all their bytes.

Nulls and odd rows: a null or empty text has no bytes; a null doc_id comes after all others; rows that repeat a doc_id
come in order of a digest of their texts, and equal rows stand for one document, so that both get the same verdict. A
text shorter than `match` keeps all bytes. Whole texts are read as UTF-8. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import shared as S

MATCH = 100
GRAM = 20
PAIRS = 64
BATCH = 4096
PART_ROWS = 50_000
#: Anchors that a task settles at a time before they move.
SETTLE = 300_000
#: Lists (about 16 bytes an item) are broadcast up to so many items.
BROADCAST_ITEMS = 3_000_000
_PLACE = 24  # bits for a place within a chunk, below the hash in the sliding minimum
_OPEN = "h long, c long, doc_id long, d long, place long"

def _chunk_anchors(data: np.ndarray, off: np.ndarray, match: int, gram: int):
    """Anchor runs of rows laid end to end: row, first and last window start, anchor place, anchor hash, context hash."""
    n, span = len(data), match - gram + 1
    grams = n - gram + 1
    if grams < span:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    up, down = S.powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = S.mix((sums[gram:] - sums[:-gram]) * down[:grams])
    keyed = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(grams, dtype=np.uint64)
    # sliding minimum from prefix and suffix minima of blocks
    blocks = -(-grams // span)
    pad = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    pad[:grams] = keyed
    pad = pad.reshape(blocks, span)
    ahead = np.minimum.accumulate(pad, 1).ravel()
    behind = np.minimum.accumulate(pad[:, ::-1], 1)[:, ::-1].ravel()
    windows = n - match + 1
    least = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows]) & np.uint64((1 << _PLACE) - 1)
    at = least.astype(np.int64)
    size = np.diff(off)
    valid = np.zeros(n + 1, np.int32)  # windows that lie within one row
    long = size >= match
    np.add.at(valid, off[:-1][long], 1)
    np.add.at(valid, off[1:][long] - match + 1, -1)
    ok = np.cumsum(valid[:windows]) > 0
    p = np.flatnonzero(ok)
    if not len(p):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    a = at[p]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1))))
    first, last, a = p[new], p[np.concatenate((new[1:], [len(p)])) - 1], a[new]
    context = S.mix((sums[last + match] - sums[first]) * down[first] + (a - first).astype(np.uint64) * S.BASE + (last - first).astype(np.uint64))
    return np.searchsorted(off, first, "right") - 1, first, last, a, h[a], context


def pack_place(start, anchor, last):
    """(start of the first window, anchor - start, last window's start - start) in one number ordered by start."""
    return (start << 16) | (anchor << 8) | last


def _parts(data: np.ndarray, off: np.ndarray, match: int, most: int = 1 << 23):
    """The rows as they are, or one long row in overlapping parts that have each window once: bytes, offsets, shift."""
    if len(data) <= most:
        yield data, off, 0
        return
    for a in range(0, len(data), most):
        d = data[a : a + most + match - 1]
        yield d, np.array([0, len(d)]), a


def _own_rows(match):
    """Whole texts as rows laid end to end: bytes, offsets, and each row's (doc_id, d, shift of places)."""

    def rows(batch):
        ids, d = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "d"))
        data, off = S.utf8(batch.column("text"))
        for lo, hi in S.chunks(off):
            for part, o, shift in _parts(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], match):
                yield part, o, ids[lo:hi], d[lo:hi], np.full(hi - lo, shift)

    return rows


def _wanted(batch, match):
    """The contexts that `wanted` lists for each text: bytes of all, offsets, row, place."""
    text, off = S.utf8(batch.column("text"))
    wanted = batch.column("wanted")
    rows = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
    place = wanted.flatten().field("place").to_numpy(zero_copy_only=False)
    start = off[rows] + (place >> 16)
    size = (place & 255) + match
    return text, start, size, rows, place


def _context_rows(match):
    """Contexts of crowded anchors as rows."""

    def rows(batch):
        ids, d = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "d"))
        text, start, size, row, place = _wanted(batch, match)
        for a in range(0, len(row), 5000):
            b = slice(a, a + 5000)
            data = np.concatenate([text[x : x + n] for x, n in zip(start[b], size[b])])
            yield data, np.concatenate(([0], np.cumsum(size[b]))), ids[row[b]], d[row[b]], place[b] >> 16

    return rows


def _merged(doc: np.ndarray, d: np.ndarray, s: np.ndarray, e: np.ndarray):
    """Spans of the same document that touch as one."""
    order = np.lexsort((s, d, doc))
    doc, d, s, e = doc[order], d[order], s[order], e[order]
    other = np.concatenate(([True], (doc[1:] != doc[:-1]) | (d[1:] != d[:-1])))
    top = np.maximum.accumulate(e + np.cumsum(other) * np.int64(1 << 40)) & np.int64((1 << 40) - 1)
    new = np.flatnonzero(other | np.concatenate(([True], s[1:] > top[:-1])))
    return doc[new], d[new], s[new], top[np.concatenate((new[1:], [len(s)])) - 1]


def _occurrences(rows, match, gram, settle):
    """Open anchor occurrences, and spans that an equal context in the same task settles: those have place -1 - end and c = start."""

    def flush(held):
        h, c, doc, d, place = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((place, d, doc))
        order = order[np.argsort((S.mix(h) + c)[order], kind="stable")]
        h, c, doc, d, place = h[order], c[order], doc[order], d[order], place[order]
        first = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
        again = ~first
        gone = place[again] >> 16
        x, y, s, e = _merged(doc[again], d[again], gone, gone + (place[again] & 255) + match) if again.any() else (doc[:0], d[:0], place[:0], place[:0])
        cols = ((h[first], S.mix(x.view(np.uint64))), (c[first], s.view(np.uint64)), (doc[first], x), (d[first], y), (place[first], -1 - e))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in cols], ["h", "c", "doc_id", "d", "place"])

    def scan(batches):
        held, n = [], 0
        for batch in batches:
            for data, off, ids, d, shift in rows(batch):
                row, first, last, a, h, c = _chunk_anchors(data, off, match, gram)
                if len(row):
                    held.append((h, c, ids[row], d[row], pack_place(first - off[row] + shift[row], a - first, last - first)))
                    n += len(row)
                if n >= settle:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return scan


def _counted(match):
    """A part's occurrences in order of h, c and document: spans (place = start, e = end) that an earlier one has, and, for
    each anchor with several contexts, the first occurrence of each (e = -1 - number of contexts before it)."""

    def scan(batches):
        last = None  # h, c, contexts of h so far, and the occurrence of the first while it is alone
        for batch in batches:
            h, c, doc, d, place = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("h", "c", "doc_id", "d", "place"))
            settled = place < 0
            out = [(h[settled] * 0, doc[settled], d[settled], c[settled], -1 - place[settled])]
            h, c, doc, d, place = (x[~settled] for x in (h, c, doc, d, place))
            if len(h):
                h0, c0, n0, one = last or (~h[0], 0, 0, None)
                newh = np.concatenate(([h[0] != h0], h[1:] != h[:-1]))
                newc = newh | np.concatenate(([c[0] != c0], c[1:] != c[:-1]))
                again = ~newc
                s = place[again] >> 16
                out.append((h[again] * 0, doc[again], d[again], s, s + (place[again] & 255) + match))
                group = np.cumsum(newh)  # 0 goes on from the batch before
                seen = np.cumsum(newc)
                start = np.flatnonzero(newh)
                base = np.concatenate(([-n0], seen[start] - 1))  # contexts before each group
                rank = seen - base[group] - 1  # of each row's context in its anchor
                count = np.concatenate((seen[start] - 1, [seen[-1]])) - base
                if one is not None and count[0] > 1:
                    out.append(tuple(np.array([x]) for x in (*one[:4], -1)))
                    one = None
                at = newc & (count[group] > 1)
                out.append((h[at], doc[at], d[at], place[at], -1 - rank[at]))
                if count[-1] == 1 and len(start):
                    i = start[-1]
                    one = (h[i], doc[i], d[i], place[i])
                elif len(start):
                    one = None
                # a group that ends with the batch and has more than one context is out already
                last = (h[-1], c[-1], int(count[-1]), one)
            cols = [np.concatenate(x) for x in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["h", "doc_id", "d", "place", "e"])

    return scan


def _contexts(match):
    """The bytes of each wanted context."""

    def cut(batches):
        for batch in batches:
            ids, d = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "d"))
            text, start, size, row, place = _wanted(batch, match)
            h = batch.column("wanted").flatten().field("h").to_numpy(zero_copy_only=False)
            for a in range(0, len(row), 20_000):
                b = slice(a, a + 20_000)
                out = [text[x : x + n].tobytes() for x, n in zip(start[b], size[b])]
                yield pa.RecordBatch.from_arrays([pa.array(h[b]), pa.array(ids[row[b]]), pa.array(d[row[b]]), pa.array(place[b]), pa.array(out, pa.binary())], ["h", "doc_id", "d", "place", "bytes"])

    return cut


class Level:
    """A suffix array: suffixes at anchors in order of anchor hash and following bytes, with the bytes on both sides."""

    def __init__(self, key, right, left, low, high, who):
        self.key, self.right, self.left, self.low, self.high, self.who = key, right, left, low, high, who

    @staticmethod
    def of(h: np.ndarray, raw: list[bytes], anchor: np.ndarray, last: np.ndarray, who: np.ndarray, match: int, gram: int) -> Level:
        """From contexts; `anchor` and `last` are offsets from their first byte."""
        n, reach = len(raw), match - gram
        size = np.array([len(x) for x in raw], np.int64)
        data = np.frombuffer(b"".join(raw) + b"\0", np.uint8)
        base = np.concatenate(([0], np.cumsum(size)[:-1])) if n else np.zeros(0, np.int64)

        def grid(step, width):
            pos = anchor[:, None] + step * np.arange(width)[None, :] - (step < 0)
            inside = (pos >= 0) & (pos < size[:, None])
            return np.where(inside, data[np.where(inside, base[:, None] + pos, 0)].astype(np.int16), np.int16(-1))

        right, left = grid(1, match), grid(-1, reach)
        key = _key(h, right)
        order = np.argsort(key, kind="stable")
        return Level(key[order], right[order], left[order], (anchor - last)[order], anchor[order], who[order])

    def merge(self, other: Level) -> Level:
        """Two suffix arrays as one, in order: the other's suffixes go where they stand among this one's."""
        slot = np.searchsorted(self.key, other.key, "right") + np.arange(len(other.key))
        mine = np.ones(len(self.key) + len(other.key), bool)
        mine[slot] = False

        def both(x, y):
            out = np.empty((len(mine), *x.shape[1:]), x.dtype)
            out[mine], out[slot] = x, y
            return out

        return Level(*(both(getattr(self, k), getattr(other, k)) for k in ("key", "right", "left", "low", "high", "who")))


def _key(h: np.ndarray, right: np.ndarray, fill: int = 0, length: np.ndarray | None = None) -> np.ndarray:
    """Anchor hash and following bytes as strings that sort; beyond `length` bytes, or a row's end, `fill` stands."""
    n, width = right.shape
    out = np.full((n, 8 + width + 1), 1, np.uint8)  # a last byte that keeps trailing zeros
    out[:, :8] = np.ascontiguousarray(h.astype(">i8")).view(np.uint8).reshape(n, 8)
    inside = right >= 0
    if length is not None:
        inside &= np.arange(width)[None, :] < length[:, None]
    out[:, 8:-1] = np.where(inside, right, fill)
    if length is not None:
        out[:, -1] = fill or 0
    return out.view(f"S{out.shape[1]}").ravel()


def matches(new: Level, old: Level, match: int, most: int = 200_000):
    """Merge-scan: (rank in `new`, least and greatest number of bytes left of the anchor) of windows that `old` has earlier.

    A window with all the bytes left of the anchor that its context has needs the fewest bytes to the right; suffixes of
    `old` that share so many stand together.
    """
    if not len(new.key) or not len(old.key):
        return
    h = np.ascontiguousarray(new.key).view(np.uint8).reshape(len(new.key), -1)[:, :8].copy().view(">i8").ravel()
    need = match - new.high
    lo = np.searchsorted(old.key, _key(h, new.right, 0, need), "left")
    hi = np.searchsorted(old.key, _key(h, new.right, 255, need), "right")
    n = np.maximum(hi - lo, 0)
    ends = np.cumsum(n)
    start = 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        m = n[start:stop]
        j = np.repeat(np.arange(start, stop), m)
        i = np.repeat(lo[start:stop] - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())
        ok = old.who[i] < new.who[j]
        i, j = i[ok], j[ok]
        same = (new.right[j] == old.right[i]) & (new.right[j] >= 0)
        r = np.where(same.all(1), same.shape[1], same.argmin(1)) if len(j) else np.zeros(0, np.int64)
        same = (new.left[j] == old.left[i]) & (new.left[j] >= 0)
        left = (np.where(same.all(1), same.shape[1], same.argmin(1)) if same.shape[1] else np.zeros(len(j), np.int64)) if len(j) else r
        low, high = np.maximum(match - r, new.low[j]), np.minimum(left, new.high[j])
        ok = low <= high
        if ok.any():
            yield j[ok], low[ok], high[ok]
        start = stop


def _family(match, gram, batch_rows):
    """Each part's contexts arrive in document order; spans that an earlier context has go out."""

    def scan(batches):
        levels: list[Level] = []
        seen = 0
        for batch in batches:
            for a in range(0, batch.num_rows, batch_rows):
                b = batch.slice(a, batch_rows)
                h, ids, d, place = (b.column(k).to_numpy(zero_copy_only=False) for k in ("h", "doc_id", "d", "place"))
                start, anchor, last = place >> 16, (place >> 8) & 255, place & 255
                who = np.arange(seen, seen + len(place))
                new = Level.of(h, b.column("bytes").to_pylist(), anchor, last, who, match, gram)
                out = [x for level in [new, *levels] for x in matches(new, level, match)]
                if out:
                    j, low, high = (np.concatenate(x) for x in zip(*out))
                    at = new.who[j] - seen
                    s = start[at] + anchor[at]
                    x, y, s, e = _merged(ids[at], d[at], s - high, s - low + match)
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x, y, s, e)], ["doc_id", "d", "s", "e"])
                seen += len(place)
                while levels and len(levels[-1].key) <= len(new.key):
                    new = levels.pop().merge(new)
                levels.append(new)

    return scan


def _runs(batches):
    """Maximal runs of each document's spans."""
    for batch in batches:
        spans, off = batch.column("spans").flatten(), batch.column("spans").offsets.to_numpy()
        off = off - off[0]
        s, e = spans.field("s").to_numpy(zero_copy_only=False), spans.field("e").to_numpy(zero_copy_only=False)
        starts, ends = [], []
        for a, b in zip(off[:-1], off[1:]):
            order = np.argsort(s[a:b], kind="stable")
            x, y = s[a:b][order], np.maximum.accumulate(e[a:b][order])
            new = np.concatenate(([True], x[1:] > y[:-1]))
            starts.append(x[new])
            ends.append(y[np.concatenate((np.flatnonzero(new)[1:], [len(x)])) - 1])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("d"), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], ["doc_id", "d", "starts", "ends"])


def _cut(with_text):
    def cut(batches):
        for batch in batches:
            data, off = S.utf8(batch.column("text"))
            starts, ends = batch.column("starts").to_pylist(), batch.column("ends").to_pylist()
            out = {k: [] for k in ("n_removed", "n_spans", "kept_sha256", "kept")}
            for i in range(batch.num_rows):
                raw = data[off[i] : off[i + 1]]
                keep, removed = np.ones(len(raw), bool), 0
                runs = [(a, min(b, len(raw))) for a, b in zip(starts[i] or (), ends[i] or ()) if a < len(raw)]
                for a, b in runs:
                    keep[a:b] = False
                    removed += b - a
                left = (raw[keep] if runs else raw).tobytes()
                for k, v in (("n_removed", removed), ("n_spans", len(runs)), ("kept_sha256", hashlib.sha256(left).hexdigest()), ("kept", left if with_text else None)):
                    out[k].append(v)
            cols = [batch.column("doc_id"), pa.array(np.diff(off)), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(out["kept"], pa.binary())] if with_text else []), names + (["kept"] if with_text else []))

    return cut


def _texts(docs: DataFrame) -> DataFrame:
    """own_id (as given), doc_id (null as the greatest number), d and text; d tells rows of one doc_id apart and is 0 where none repeats."""
    several = docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").limit(1).count() > 0
    text = F.col("text").cast("string")
    d = F.xxhash64(text) if several else F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(0)
    return docs.select(F.col("doc_id").cast("long").alias("own_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), d.cast("long").alias("d"), text.alias("text"))


def _with(texts: DataFrame, lists: DataFrame, how: str, items: int) -> DataFrame:
    """Documents joined with per-document lists, which are broadcast if they have few items."""
    return texts.join(F.broadcast(lists) if items <= BROADCAST_ITEMS else lists, ["doc_id", "d"], how)


def repeated(docs: DataFrame, match: int = MATCH, gram: int = GRAM, pairs: int = PAIRS, batch: int = BATCH, settle: int = SETTLE) -> tuple[DataFrame, DataFrame, int]:
    """The texts; (doc_id, d, starts, ends): each document's maximal runs of bytes in strings of `match` bytes that start
    earlier too; and the number of runs."""
    all_texts = _texts(docs)
    texts = all_texts.filter(F.octet_length("text") >= match).select("doc_id", "d", "text")
    # equal rows are one document; with ids of their own there are none
    texts = texts.dropDuplicates(["doc_id", "d"]) if texts.filter("d <> 0").limit(1).count() else texts
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans: list[DataFrame] = []
    rows, source = _own_rows(match), texts
    while True:
        found = source.mapInArrow(_occurrences(rows, match, gram, settle), _OPEN).repartition(F.col("h")).sortWithinPartitions("h", "c", "doc_id", "d", "place")
        counted = S.table(found.mapInArrow(_counted(match), "h long, doc_id long, d long, place long, e long"))
        spans.append(counted.filter("e >= 0").select("doc_id", "d", F.col("place").alias("s"), "e"))
        reps = counted.filter("e < 0")
        crowded = S.checkpoint(reps.filter(F.col("e") == -1 - pairs).select("h").distinct())
        crowd = S.small(crowded, BROADCAST_ITEMS)
        sizes = [0, 0]
        lists = []
        for i, how in enumerate(("left_anti", "left_semi")):
            some = reps.join(crowd, "h", how)
            lists.append(some.groupBy("doc_id", "d").agg(F.collect_list(F.struct("h", "place")).alias("wanted")))
            sizes[i] = some.count()
        if sizes[0]:
            cut = _with(texts, lists[0], "inner", sizes[0]).mapInArrow(_contexts(match), "h long, doc_id long, d long, place long, bytes binary")
            cut = cut.repartition(max(-(-sizes[0] // PART_ROWS), parts), "h").sortWithinPartitions("doc_id", "d", "place")
            spans.append(cut.mapInArrow(_family(match, gram, batch), "doc_id long, d long, s long, e long"))
        if not sizes[1]:
            break
        # the windows of crowded anchors get longer ones
        gram = match - (match - gram) // 4
        rows, source = _context_rows(match), _with(texts, lists[1], "inner", sizes[1])
    every = spans[0]
    for s in spans[1:]:
        every = every.unionByName(s)
    lists = every.groupBy("doc_id", "d").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    runs = S.checkpoint(lists.mapInArrow(_runs, "doc_id long, d long, starts array<long>, ends array<long>"))
    return all_texts, runs, runs.agg(F.sum(F.size("starts"))).first()[0] or 0


def dedup_substrings(docs: DataFrame, match: int = MATCH, gram: int = GRAM, pairs: int = PAIRS, batch: int = BATCH, settle: int = SETTLE, with_text: bool = False) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept bytes]."""
    texts, runs, n = repeated(docs, match, gram, pairs, batch, settle)
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return _with(texts, runs, "left", n).select(F.col("own_id").alias("doc_id"), "text", "starts", "ends").mapInArrow(_cut(with_text), fields)


def op7_suffix_dedup(spark, sf_dir) -> DataFrame:
    return dedup_substrings(S.read(spark, sf_dir, "documents"))


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLES: dict = {}
