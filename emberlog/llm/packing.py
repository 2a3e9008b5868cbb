"""Best-fit decreasing packing of tokenised documents into sequences of bounded length.

Documents are tokenised where they lie; only a document longer than a sequence is cut, and its first piece takes the
remainder so that all later pieces fill a sequence each. Best fit takes the pieces longest first, each into the open
sequence with the least room that still holds it, found by a segment tree over remaining capacities. Pieces of equal
length are interchangeable, so the one packing of the whole corpus follows from how many there are of each length: the
driver holds that histogram, of `capacity` rows at most, and the patterns of sequences that come out, each with its
number of sequences. The pieces then take the places of their length in order of rank; ranks are counted in hash-dealt
blocks of about BLOCK pieces, so that a length which most pieces share is spread too.

The ids are those of the byte-level BPE vocabulary file; the reader of the same vocabulary as ranks is four times as
fast and gives the same ids, the end-of-text token that a text spells out included (tests compare them).

Nulls and odd rows: a null or empty text is the end id alone; a null doc_id is packed as any other; each repeated row is
packed by itself; equal lengths go by doc_id and piece. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm import shared as S

CAPACITY = 1024
END_ID = 2
BLOCK = 100_000
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}


def tokenizer(path: str | None = None):
    """The byte-level BPE of the rank file at `path` (by default the installed public vocabulary)."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def _pieces(path, capacity, end_id, with_ids):
    def cut(batches):
        enc = tokenizer(path)
        for batch in batches:
            rows = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(enc.encode_to_numpy(text.as_py() or "", allowed_special="all").astype("<u4"), np.uint32(end_id)).astype("<u4")
                edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    part = ids[a:b]
                    for k, v in (("doc_id", doc_id), ("piece", i), ("start", a), ("length", b - a), ("ids_crc32", zlib.crc32(part.tobytes())), ("ids", part if with_ids else None)):
                        rows[k].append(v)
            cols = [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["piece"], pa.int32())] + [pa.array(rows[k], pa.int64()) for k in ("start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(rows["ids"], pa.list_(pa.int64()))] if with_ids else []), [k for k in rows if with_ids or k != "ids"])

    return cut


class Rooms:
    """A segment tree over remaining capacities: which rooms open sequences have."""

    def __init__(self, capacity: int):
        self.size = 1 << int(capacity).bit_length()
        self.tree = bytearray(2 * self.size)

    def put(self, room: int, there: bool) -> None:
        node = self.size + room
        self.tree[node] = there
        while node > 1:
            node >>= 1
            self.tree[node] = self.tree[2 * node] | self.tree[2 * node + 1]

    def tightest(self, need: int) -> int:
        """The least room of `need` or more, or 0: climb until a right sibling holds one, then go down."""
        node = self.size + need
        if self.tree[node]:
            return need
        while node > 1 and (node & 1 or not self.tree[node + 1]):
            node >>= 1
        if node <= 1:
            return 0
        node += 1
        while node < self.size:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        return node - self.size


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (number of sequences, [(length, offset), ...]) of best-fit decreasing over pieces counted by length.

    Sequences with the same room are filled one after the other, each with as many pieces of the length as go in, as
    they would be piece by piece; sequences that get the same are moved as one.
    """
    rooms, groups = Rooms(capacity), {}  # room: groups (number, pattern)

    def put(room: int, number: int, pattern: list) -> None:
        if number:
            groups.setdefault(room, []).append((number, pattern))
            rooms.put(room, True)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = rooms.tightest(length)
            if room:
                number, pattern = groups[room].pop()
                if not groups[room]:
                    rooms.put(room, False)
            else:
                room, number, pattern = capacity, -(-left // (capacity // length)), []
            each = room // length
            full = min(number, left // each)
            rest = min(left - full * each, each) if full < number else 0
            for n, k in ((full, each), (1 if rest else 0, rest)):
                put(room - k * length, n, pattern + [(length, capacity - room + i * length) for i in range(k)])
            put(room, number - full - (1 if rest else 0), pattern)
            left -= full * each + rest
    return [g for gs in groups.values() for g in gs]


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank, the first sequence and the offset of each run of places, in order of rank."""
    runs: dict[int, list] = {}
    base, ranks = 0, {}
    for number, pattern in patterns:
        for length, offset in pattern:
            first = ranks.get(length, 0)
            runs.setdefault(length, []).append((first, base, offset))
            ranks[length] = first + number
        base += number
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in runs.items()}


def _placed(table, fields):
    def place(pieces: pa.Table, starts: pa.Table) -> pa.Table:
        """The pieces of one block, ranked within their length from where the blocks before it end."""
        if not pieces.num_rows:
            return pa.table({n: pa.array([], t) for n, t in fields.items()})
        pieces = pieces.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        length = pieces["length"].to_numpy()
        value, first = np.unique(length, return_index=True)
        begin = dict(zip(starts["length"].to_pylist(), starts["before"].to_pylist()))
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for v, a, b in zip(value.tolist(), first, np.append(first[1:], len(length))):
            rank = begin[v] + np.arange(b - a)
            firsts, base, offset = table.value[v]
            at = np.searchsorted(firsts, rank, "right") - 1
            seq[a:b], off[a:b] = base[at] + rank - firsts[at], offset[at]
        out = pieces.drop_columns(["b"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))
        return out.select(list(fields)).cast(pa.schema(list(fields.items())))

    return place


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, block: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """Pieces of `docs` (doc_id, text) and their places: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    pieces = S.checkpoint(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(path, capacity, end_id, with_ids), schema))
    blocks = max(1, -(-pieces.count() // block))
    dealt = pieces.withColumn("b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    counts = S.checkpoint(dealt.groupBy("length", "b").agg(F.count("*").alias("n")))  # `capacity` rows a block at most
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = docs.sparkSession.sparkContext.broadcast(places(best_fit_decreasing(histogram, capacity)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    starts = counts.select("length", "b", before.alias("before"))
    fields = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int64())} if with_ids else {}) | {"sequence_id": pa.int64(), "offset": pa.int64()}
    return dealt.groupBy("b").cogroup(starts.groupBy("b")).applyInArrow(_placed(table, fields), f"{schema}, sequence_id long, offset long")


def op6_best_fit_packing(spark, sf_dir) -> DataFrame:
    return pack(S.read(spark, sf_dir, "documents"))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
ORACLES: dict = {}
