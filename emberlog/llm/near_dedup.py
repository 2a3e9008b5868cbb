"""MinHash near-dedup by a signature-coordinate inverted join.

Every document has one posting for each (coordinate, value) pair of its MinHash signature. Two documents whose
signatures agree in at least T of K coordinates share one of the K - T + 1 rarest postings of either (the prefix), so
only those lists are merged; postings that one document alone holds are skipped, and a document left with fewer than T
others is linked with nothing. The collisions of a pair that meets in a list are counted over all K coordinates, and
pairs with T or more are retained. As a further filter, documents that lack shingles which others have too drop out, and
a longer sketch has to agree in enough coordinates; what is left is confirmed on the full shingle sets.

Lists are never expanded into all their pairs. First each member meets the first member of its list, which joins dense
groups into components. Then only pairs of different components are compared, and only members outside a list's
largest component probe the list.

Nulls and odd rows: a null or wordless text has an empty set and is linked with nothing; a null doc_id is returned as
its own row with a null component and kept; of rows that repeat a doc_id with other texts, the one whose set digest is
largest is compared, and all get its component (`first_of_each` tells such rows apart). An empty table gives no rows.
Very long texts are read whole. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm import shared as S

COORDINATES = 32
#: Coordinates of the sketch that survivors get, four bits each.
SKETCH = 512
#: The probability that a pair at the threshold is missed by the signature; and as much by the sketch.
MISS = 1e-5
WIDTH = 5
SIMILAR = 85
BROADCAST_ROWS = 500_000
#: Lists with more members are compared in blocks of about so many.
LONG_LIST = 512

_rng = np.random.default_rng(20240611)
_A = _rng.integers(1, 1 << 63, COORDINATES + SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, COORDINATES + SKETCH, dtype=np.uint64)


def agreements(similar: int, coordinates: int, chance: float = 0.0) -> int:
    """The least agreements of `coordinates` that a pair with Jaccard `similar` percent has but for a probability nearest to MISS.

    `chance` is the probability that coordinates of different minima agree.
    """
    p = min(similar / 100 + (1 - similar / 100) * chance, 1.0)
    under, best = 0.0, (math.inf, 0)
    for m in range(1, coordinates + 1):
        under += math.comb(coordinates, m - 1) * p ** (m - 1) * (1 - p) ** (coordinates - m + 1)
        best = min(best, (abs(math.log(max(under, 1e-300) / MISS)), m))
    return best[1]


def sketch_agreements(similar: int) -> int:
    return agreements(similar, SKETCH, 1 / 16)


def _signed(batches):
    for batch in batches:
        ids = batch.column("doc_id")
        data, off = S.utf8(batch.column("text"))
        for lo, hi in S.chunks(off, S.CHUNK_BYTES // 4):
            words, woff = S.word_hashes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            sh, soff = S.shingles(words, woff, WIDTH)
            sets = [np.unique(sh[a:b]) for a, b in zip(soff[:-1], soff[1:])]
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            sig = np.zeros((hi - lo, COORDINATES), np.uint32)
            key = np.zeros((hi - lo, 2), np.uint64)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                at = np.concatenate(([0], np.cumsum(n[full])[:-1]))
                key[full, 0] = np.add.reduceat(S.mix(flat), at)
                key[full, 1] = np.add.reduceat(S.mix(flat + S.BASE), at)
                for k in range(COORDINATES):
                    sig[full, k] = np.minimum.reduceat((flat * _A[k] + _B[k]) >> np.uint64(32), at)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, hi - lo),
                    pa.array(n),
                    pa.array(key[:, 0].view(np.int64)),
                    pa.array(key[:, 1].view(np.int64)),
                    pa.array([r.tobytes() for r in sig], pa.binary()),
                ],
                ["doc_id", "n_shingles", "key1", "key2", "signature"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles (set size), two order-free set digests and the packed signature."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_signed, "doc_id long, n_shingles long, key1 long, key2 long, signature binary")


def _tokens(batches):
    """One row for each coordinate: the posting's key mixes coordinate and value."""
    coord = S.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64))
    for batch in batches:
        n = batch.num_rows
        sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(n, COORDINATES)
        key = S.mix(sig.astype(np.uint64) + coord).view(np.int64)
        rep = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), COORDINATES)
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(key.ravel())], ["rep", "key"])


def _sets(batches):
    for batch in batches:
        ids = batch.column("doc_id")
        data, off = S.utf8(batch.column("text"))
        for lo, hi in S.chunks(off, S.CHUNK_BYTES // 4):
            words, woff = S.word_hashes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            sh, soff = S.shingles(words, woff, WIDTH)
            out = [np.unique(sh[a:b]) for a, b in zip(soff[:-1], soff[1:])]
            key = np.array([S.mix(x).sum(dtype=np.uint64) for x in out], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(key), pa.array([x.view(np.int64) for x in out], pa.list_(pa.int64()))], ["id", "key1", "items"])


def _items(batches):
    """Each document's distinct shingles, one a row."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        data, off = S.utf8(batch.column("text"))
        for lo, hi in S.chunks(off, S.CHUNK_BYTES // 4):
            words, woff = S.word_hashes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            sh, soff = S.shingles(words, woff, WIDTH)
            sets = [np.unique(sh[a:b]) for a, b in zip(soff[:-1], soff[1:])]
            n = np.array([len(x) for x in sets], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo:hi], n)), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets).view(np.int64))], ["doc_id", "n", "item"])


def confirm(pairs: DataFrame, docs: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= similar * union."""
    ids = S.checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(S.small(ids, BROADCAST_ROWS), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets, "id long, key1 long, items array<bigint>").groupBy("id").agg(F.max_by("items", "key1").alias("items"))
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    # one pair at a time, in Spark: a batch of pairs has both sets of each, which no number of rows bounds
    both = F.size(F.array_intersect("x", "y"))
    near = (100 + similar) * both >= similar * (F.size("x") + F.size("y"))  # the union is both sizes less what both hold
    return pairs.join(left, "a").join(right, "b").filter(near).select("a", "b")


def _sketched(batches):
    """The signature, and a longer one of four bits a coordinate, packed into longs: equal coordinates have equal nibbles."""
    shift = np.arange(0, 64, 4, dtype=np.uint64)
    for batch in batches:
        data, off = S.utf8(batch.column("text"))
        for lo, hi in S.chunks(off, S.CHUNK_BYTES // 4):
            words, woff = S.word_hashes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            sh, soff = S.shingles(words, woff, WIDTH)
            out, key, full = np.zeros((hi - lo, SKETCH), np.uint64), np.zeros(hi - lo, np.uint64), np.flatnonzero(np.diff(soff))
            sig = np.zeros((hi - lo, COORDINATES), np.uint32)
            size = np.zeros(hi - lo, np.int64)
            for i in full:
                items = np.unique(sh[soff[i] : soff[i + 1]])
                size[i], key[i] = len(items), S.mix(items).sum(dtype=np.uint64)
            for k in range(SKETCH if len(full) else 0):
                low = np.minimum.reduceat((sh * _A[COORDINATES + k] + _B[COORDINATES + k]) >> np.uint64(32), soff[full])
                out[full, k] = S.mix(low) & np.uint64(15)
            for k in range(COORDINATES if len(full) else 0):
                sig[full, k] = np.minimum.reduceat((sh * _A[k] + _B[k]) >> np.uint64(32), soff[full])
            longs = (out.reshape(hi - lo, -1, 16) << shift).sum(2, dtype=np.uint64).view(np.int64)
            cols = [size, key.view(np.int64), *longs.T, *sig.view(np.int64).T]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *(pa.array(np.ascontiguousarray(c)) for c in cols)], ["rep", "n", "key1", *_COLUMNS])


_SKETCH = [f"s{i}" for i in range(SKETCH // 16)]
#: The signature, two coordinates a long.
_SIGNATURE = [f"c{i}" for i in range(COORDINATES // 2)]
_COLUMNS = _SKETCH + _SIGNATURE


def enough(x: str, y: str, least: int) -> str:
    """SQL for whether two packed sketches agree in `least` coordinates: nibbles that differ are folded into one bit each."""
    v = [f"({x}{c} ^ {y}{c})" for c in _SKETCH]
    differ = " + ".join(f"bit_count(({d} | shiftrightunsigned({d}, 1) | shiftrightunsigned({d}, 2) | shiftrightunsigned({d}, 3)) & {0x1111111111111111})" for d in v)
    return f"{differ} <= {SKETCH - least}"


def collide(x: str, y: str, least: int) -> str:
    """SQL for whether two signatures collide in `least` coordinates."""
    v = [f"({x}{c} ^ {y}{c})" for c in _SIGNATURE]
    return " + ".join(f"if({d} & 4294967295 = 0, 1, 0) + if(shiftrightunsigned({d}, 32) = 0, 1, 0)" for d in v) + f" >= {least}"


def _compared(similar, matches):
    least = sketch_agreements(similar)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        """Pairs of one block of a long list's probes with one block of its members."""
        out_a, out_b = [], []
        if left.num_rows and right.num_rows:
            grid = lambda t, names: np.stack([t.column(c).to_numpy() for c in names], 1)
            col = lambda t, c: t.column(c).to_numpy()
            x, y, ones = grid(left, _SKETCH).view(np.uint64), grid(right, _SKETCH).view(np.uint64), np.uint64(0x1111111111111111)
            p, q = grid(left, _SIGNATURE).view(np.uint32), grid(right, _SIGNATURE).view(np.uint32)
            a, b, ca, cb, na, nb = col(left, "rep"), col(right, "rep"), col(left, "comp"), col(right, "comp"), col(left, "n"), col(right, "n")
            main, place = col(right, "main"), col(left, "place")
            ka, kb = left.column("keys").to_pylist(), [set(k) for k in right.column("keys").to_pylist()]
            for i in range(len(a)):
                j = np.flatnonzero((ca[i] != cb) & ((cb == main) | (a[i] < b)) & (100 * np.minimum(na[i], nb) >= similar * np.maximum(na[i], nb)))
                j = j[(p[i] == q[j]).sum(1) >= matches]
                d = x[i] ^ y[j]
                d |= d >> np.uint64(2)
                d |= d >> np.uint64(1)
                for j in j[np.bitwise_count(d & ones).sum(1) <= SKETCH - least]:
                    if not any(k in kb[j] for k in ka[i][: place[i]]):  # else an earlier list has the pair
                        out_a.append(min(a[i], b[j]))
                        out_b.append(max(a[i], b[j]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return compare


def _long_lists(lists: DataFrame, similar: int, matches: int) -> DataFrame:
    """Pairs of long lists: probes and members are dealt into blocks, and every probe block meets every member block.

    Members are copied once for each block of probes that the list has, probes once for each block of members.
    """
    rows, cols = (F.ceil(F.col(c) / LONG_LIST).cast("int") for c in ("probes", "members"))
    deal = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    names = ["key", "rep", "comp", "n", "place", "keys", "main", *_COLUMNS]
    left = lists.filter("comp <> main").select(*names, deal(rows).alias("p"), every(cols).alias("q"))
    right = lists.select(*names, deal(cols), every(rows)).toDF(*names, "q", "p")
    return left.groupBy("key", "p", "q").cogroup(right.groupBy("key", "p", "q")).applyInArrow(_compared(similar, matches), "a long, b long")


def links(docs: DataFrame, reps: DataFrame, matches: int, similar: int) -> DataFrame:
    """(node, component) over representatives `reps` (rep, signature) that have links."""
    posts = reps.select("rep", "signature").mapInArrow(_tokens, "rep long, key long")
    posts = posts.withColumn("df", F.count("*").over(Window.partitionBy("key"))).filter("df > 1")
    # of K rarest-first postings the first K - T + 1 are the prefix; those that nobody shares come first
    counts = posts.groupBy("rep").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("df", "key"))).alias("p"))
    keys = F.expr(f"transform(slice(p, 1, cast(n as int) - {matches} + 1), t -> t.key)")
    prefix = S.checkpoint(counts.filter(F.col("n") >= matches).select("rep", keys.alias("keys")))
    # a link shares `similar` percent of either's shingles: who has fewer that another one has too drops out
    found = S.small(prefix.select(F.col("rep").alias("doc_id")), BROADCAST_ROWS)
    items = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(found, "doc_id", "left_semi").mapInArrow(_items, "doc_id long, n long, item long")
    every = Window.partitionBy("item")
    common = items.withColumn("first", F.min("doc_id").over(every)).withColumn("last", F.max("doc_id").over(every)).filter("first < last")
    ids = S.checkpoint(common.groupBy("doc_id", "n").agg(F.count("*").alias("c")).filter(f"100 * c >= {similar} * n").select("doc_id").distinct())
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(S.small(ids, BROADCAST_ROWS), "doc_id", "left_semi")
    sketch = texts.mapInArrow(_sketched, "rep long not null, n long not null, key1 long, " + ", ".join(f"{c} long not null" for c in _COLUMNS))
    sketch = sketch.join(reps.select("rep", "key1"), ["rep", "key1"], "left_semi").drop("key1").dropDuplicates(["rep"])
    # sketches and prefixes stand once for each document; the lists hold ids alone
    sketch = S.checkpoint(sketch.join(prefix, "rep"))
    lists = sketch.select("rep", F.posexplode("keys").alias("place", "key"))

    def side(of: DataFrame, name: str, *keep: str) -> DataFrame:
        return of.select(*keep, F.col("rep").alias(name[0]), *(F.col(c).alias(c + name[0]) for c in ("n", "keys", "place", "comp") if c in of.columns), *(F.col(c).alias(name[1] + c) for c in _COLUMNS))

    near = f"100 * least(na, nb) >= {similar} * greatest(na, nb) and {collide('x', 'y', matches)} and {enough('x', 'y', sketch_agreements(similar))}"
    # round 1: each member of a list against its first member; a pair that shares several lists is compared once
    heads = lists.groupBy("key").agg(F.min("rep").alias("a"))
    stars = lists.join(heads, "key").filter("rep > a").select("a", F.col("rep").alias("b")).distinct()
    plain = sketch.drop("keys")
    stars = S.checkpoint(stars.join(side(plain, "ax"), "a").join(side(plain, "by"), "b").filter(near).select("a", "b"))
    # as tables: the union of plans whose constraints a checkpoint carries on fails in Spark 4.1
    first = S.table(confirm(stars, docs, similar))
    comp = S.components(first)
    # round 2: pairs of different components; who is outside a list's largest component probes the list
    lists = lists.join(comp, lists["rep"] == comp["node"], "left").select(*lists.columns, F.coalesce("component", "rep").alias("comp"))
    sizes = lists.groupBy("key", "comp").agg(F.count("*").alias("m"))
    main = sizes.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("m").alias("members")).filter("comps > 1")
    main = S.checkpoint(main.select("key", F.col("top.comp").alias("main"), "members", (F.col("members") - F.col("top.m")).alias("probes")))
    lists = S.checkpoint(lists.join(main, "key").join(sketch, "rep"))
    # a pair that shares several lists is made in the first of them alone
    near += " and not arrays_overlap(slice(keysa, 1, placea), keysb)"
    short = lists.filter(f"members <= {LONG_LIST}")
    probe, there = side(short.filter("comp <> main"), "ax", "key"), side(short, "by", "key", "main")
    cross = probe.join(there, "key").filter(f"compa <> compb and (compb = main or a < b) and {near}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = cross.unionByName(_long_lists(lists.filter(f"members > {LONG_LIST}"), similar, matches)).distinct()
    second = S.table(confirm(S.checkpoint(cross.join(stars, ["a", "b"], "left_anti")), docs, similar))
    return S.components(first.unionByName(second))


def near_dedup(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles, component_id (smallest linked doc_id), kept.

    Documents are linked if the Jaccard similarity of their shingle sets is `similar` percent at least.
    """
    signed = S.checkpoint(signatures(docs))
    one = F.max(F.struct("key1", "key2", "n_shingles", "signature")).alias("one")
    named = S.checkpoint(signed.filter("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(one).select("doc_id", "one.*"))
    # equal sets are one class: only its representative goes on
    classes = named.groupBy("key1", "key2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    by_set = named.select("doc_id", "key1", "key2", "n_shingles").join(classes, ["key1", "key2", "n_shingles"]).select("doc_id", "rep")
    reps = named.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "signature", "key1")
    comp = links(docs, reps, agreements(similar, COORDINATES), similar)
    merged = by_set.join(comp, by_set["rep"] == comp["node"], "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles").join(merged, "doc_id", "left")
    cid = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", cid.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def first_of_each(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...), with all their columns, that are the first of their group of linked texts.

    Rows without a doc_id, or that share one, are told apart: they come in order of doc_id (null last) and of a digest of
    their texts.
    """
    odd = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count() > 0
    if not odd:
        gone = near_dedup(docs, similar).filter(~F.col("kept")).select("doc_id")
        return docs.join(S.small(S.checkpoint(gone), BROADCAST_ROWS), "doc_id", "left_anti").select(*docs.columns)
    names = docs.columns
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    doc_id, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    # the rows of one task come after those of the one before it, so numbers follow the order; written, they stay
    rows = S.table(rows.orderBy(F.asc_nulls_last(doc_id), F.xxhash64(text)).withColumn("row", F.monotonically_increasing_id()))
    found = near_dedup(rows.select(F.col("row").alias("doc_id"), text.alias("text")), similar)
    gone = S.checkpoint(found.filter(~F.col("kept")).select(F.col("doc_id").alias("row")))
    return rows.join(S.small(gone, BROADCAST_ROWS), "row", "left_anti").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def op2_near_dedup(spark, sf_dir) -> DataFrame:
    return near_dedup(S.read(spark, sf_dir, "documents"))


QUERIES = {"op2_near_dedup": op2_near_dedup}
ORACLES: dict = {}
