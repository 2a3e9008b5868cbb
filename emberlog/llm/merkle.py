"""Merkle manifest of a dataset, and proofs by a recursive query that climbs it.

Every row is a leaf, the SHA-256 of its fields. The leaves of one language form a tree in order of doc_id: two
consecutive nodes become their parent, a last one without a partner is hashed alone; the roots of these trees, in order
of language, form the top tree in the same way. Built levels are stored as rows, one for each node, that name their
parent. A node at the foot of a block of STEP levels also names the node at the block's top and holds its siblings on the
way there, so that the recursive query climbs a block with one join: from every leaf it ascends to the root, appends the
siblings and folds the claimed leaf hash with them. With a step of 1 every join climbs one level.

A block is one group of at most 2**STEP nodes, so no task gets a tree; places in a tree come from a global sort by
range, whose partitions are counted and added up. Only the number of nodes of the largest tree comes to the driver.

Nulls and odd rows: a null field counts as `-`; rows without a language are a tree of their own, which comes first; in a
tree rows without a doc_id come first, and rows that share one come in order of their leaf hash. Equal rows are equal
leaves; each has its own place and proof. Fields are read as text, so missing extra columns or very long texts make no
difference; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm import shared as S

#: Levels of a block: a group has two to this power nodes at most.
STEP = 9
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
BROADCAST_ROWS = 100_000
#: The tree of the trees' roots; the other trees are numbered from 0 in order of language.
TOP = -1


def digest(fields: dict[str, Column]) -> Column:
    """The leaf hash: each field as `-` if null, else its UTF-8 byte count, `:` and its text."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields.values()]
    return F.sha2(F.concat(*said), 256)


def leaves(docs: DataFrame, claimed: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, lang, hash, claim) of every row; `claimed` replaces fields in the hash that is to be proven, which is `claim`
    where it differs.
    """
    own = {c: F.col(c) for c in FIELDS}
    claim = F.nullif(digest(own | claimed), F.col("hash")) if claimed else F.lit(None).cast("string")
    return docs.withColumn("hash", digest(own)).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "hash", claim.alias("claim"))


def numbered(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """The rows of `df`, a written table, with their place from 0 in a global order.

    The rows of one partition of a sort come after those of the one before it, so a row's place is its number in its
    partition plus the rows of all partitions before; those counts are one row for each partition.
    """
    rows = S.table(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(name), 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("c"), F.min(name).alias("base"))
    before = counts.select("part", F.expr("sum(c) over (order by part rows between unbounded preceding and current row) - c - base").alias("shift"))
    return rows.withColumn("part", part).join(F.broadcast(before), "part").withColumn(name, F.col(name) + F.col("shift")).drop("part", "shift")


def _levels(nodes: DataFrame, step: int, level: int) -> DataFrame:
    """The nodes of all blocks over `nodes` (tree, pos, n, hash, doc_id, claim), from foot to top.

    `n` is the number of nodes of the tree at the foot's level: a tree of 2**step or fewer ends in its only block, `up`
    levels on. Nodes at a foot hold their siblings up to the block's top; a top is told by `top`.
    """
    up = f"least({step}, if(n = 1, 0, length(bin(n - 1))))"
    foot = F.array_sort(F.collect_list(F.struct("pos", "hash", "doc_id", "claim")))
    blocks = nodes.groupBy("tree", F.shiftright("pos", step).alias("block"), "n").agg(foot.alias("foot")).withColumn("up", F.expr(up))
    last = "levels[size(levels) - 1]"
    above = f"transform(sequence(0, (size({last}) - 1) div 2), i -> sha2(concat({last}[2 * i], coalesce(get({last}, 2 * i + 1), '')), 256))"
    grown = f"aggregate(sequence(1, up), array(foot.hash), (levels, k) -> concat(levels, array({above})))"
    blocks = blocks.withColumn("levels", F.expr(f"if(up = 0, array(foot.hash), {grown})"))
    place = f"cast(f.pos - shiftleft(block, {step}) as int)"
    way = f"if(up = 0, array(), transform(sequence(0, up - 1), k -> unhex(get(levels[k], shiftright({place}, k) ^ 1))))"
    feet = f"transform(foot, f -> struct({level} as level, f.pos as pos, f.hash as hash, {way} as siblings, f.doc_id as doc_id, f.claim as claim, false as top))"
    node = f"struct({level} + k as level, shiftleft(block, {step} - k) + i as pos, h as hash, cast(null as array<binary>) as siblings, cast(null as long) as doc_id, cast(null as string) as claim, k = up as top)"
    inner = f"flatten(transform(sequence(least(1, up), up), k -> transform(levels[k], (h, i) -> {node})))"
    rows = blocks.select("tree", "block", "n", "up", F.explode(F.expr(f"concat({feet}, {inner})")).alias("x")).select("tree", "block", "n", "up", "x.*")
    return S.table(rows)


def _forest(nodes: DataFrame, step: int, end: bool) -> tuple[DataFrame, DataFrame]:
    """Node rows of all trees with leaves `nodes`, linked to their parents, and (tree, level, hash) of the trees' roots.

    With `end`, a tree's root is named by its place at the foot of the top tree.
    """
    parts, roots, level = [], [], 0
    while True:
        rows = _levels(nodes, step, level)
        done = f"n <= {1 << step}"
        link = []
        for name, here, there in (("parent", f"level + 1 = {level} + up or up = 0", ("tree", "level + 1", "shiftright(pos, 1)")), ("top", "true", ("tree", f"{level} + up", "block"))):
            over = f"{end and 'true' or 'false'} and {done} and ({here})"
            link += [f"if({over}, {a}L, {b}) as {name}_{c}" if c == "tree" else f"if({over}, {a}, {b}) as {name}_{c}" for c, a, b in zip(("tree", "level", "pos"), (TOP, "0", "tree"), there)]
        parts.append(rows.filter("not top").selectExpr("tree", "level", "pos", "hash", *link, "siblings", "doc_id", "claim"))
        tops = rows.filter("top")
        roots.append(tops.filter(done).select("tree", "level", "hash"))
        most = nodes.agg(F.max("n")).first()[0]
        if most is None or most <= 1 << step:
            break
        nodes = tops.filter(f"not {done}").selectExpr("tree", "pos", f"cast(ceil(n / {1 << step}) as long) as n", "hash", "doc_id", "claim")
        level += step
    return reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, roots)


@dataclass
class Manifest:
    """`nodes`: a row for each node below the root; `trees`: (tree, lang, subroot); the root's hash and level, or None."""

    nodes: DataFrame
    trees: DataFrame
    root: str | None
    height: int | None


def manifest(rows: DataFrame, step: int = STEP) -> Manifest:
    """The manifest of leaves (doc_id, lang, hash, claim)."""
    placed = numbered(S.table(rows), F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.asc("hash"))
    trees = numbered(placed.groupBy("lang").agg(F.min("place").alias("first"), F.count("*").alias("n")), F.asc("first"), name="tree")
    trees = S.table(trees)
    of = S.small(trees.withColumnRenamed("lang", "of"), BROADCAST_ROWS)
    leaves = placed.join(of, F.col("lang").eqNullSafe(F.col("of"))).select("tree", (F.col("place") - F.col("first")).alias("pos"), "n", "hash", "doc_id", "claim")
    nodes, roots = _forest(leaves, step, True)
    count = F.lit(trees.count()).cast("long")
    top = roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), count.alias("n"), "hash", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("claim"))
    above, last = _forest(top, step, False)
    root = last.first()  # the top tree has one root, or none
    height = root["level"] if root else None
    nodes = nodes.unionByName(above.filter(F.col("level") < height)) if root else nodes
    return Manifest(nodes, trees.join(roots, "tree").select("tree", "lang", F.col("hash").alias("subroot")), root and root["hash"], height)


#: Each sibling with its side, folded into the claim; a node without a partner is hashed alone.
_FOLD = """aggregate(transform({n}.siblings, (s, i) -> struct(lower(hex(s)) as s, shiftright({n}.pos, i) & 1 = 1 as before)), {h},
  (h, x) -> sha2(case when x.s is null then h when x.before then concat(x.s, h) else concat(h, x.s) end, 256))"""
#: Siblings as bytes, one after the other.
_APPEND = "aggregate({n}.siblings, {p}, (p, s) -> concat(p, coalesce(s, X'')))"
_CLIMB = f"""
with recursive climb as (
  select doc_id, hash as leaf, tree as own, top_tree as tree, top_level as level, top_pos as pos,
    {_APPEND.format(n="l", p="X''")} as siblings, {_FOLD.format(n="l", h="coalesce(claim, hash)")} as folded
  from {{leaves}} l
  union all
  select c.doc_id, c.leaf, c.own, n.top_tree, n.top_level, n.top_pos,
    {_APPEND.format(n="n", p="c.siblings")}, {_FOLD.format(n="n", h="c.folded")}
  from climb c join {{higher}} n on c.tree = n.tree and c.level = n.level and c.pos = n.pos
)
select doc_id, leaf, own as tree, siblings, folded from climb where tree = {{top}} and level = {{height}}
"""


def climb(found: Manifest) -> DataFrame:
    """(doc_id, leaf, tree, siblings, folded) of every leaf: the siblings' digests up to the root as bytes, and the hash
    that its claim folds to. The result is written at once, so that the limit of rows of recursive queries is lifted for
    this query alone.
    """
    spark = found.nodes.sparkSession
    feet, low = found.nodes.filter("siblings is not null"), f"level = 0 and tree <> {TOP}"
    # all steps' rows are read in as many partitions as the first step has: one for each shuffle partition, not for its few MB
    own = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        return S.table(spark.sql(_CLIMB, leaves=feet.filter(low), higher=feet.filter(f"not ({low})"), top=TOP, height=found.height))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(found: Manifest) -> DataFrame:
    """Per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    if found.root is None:
        return found.nodes.sparkSession.createDataFrame([], PROOF)
    rows = climb(found).join(S.small(found.trees.select("tree", "subroot"), BROADCAST_ROWS), "tree")
    root, proof = F.lit(found.root), F.sha2(F.lower(F.hex("siblings")), 256)
    return rows.select("doc_id", "leaf", "subroot", root.alias("root"), proof.alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))


def op12_merkle_manifest(spark, sf_dir, step: int = STEP) -> DataFrame:
    docs = S.read(spark, sf_dir, "documents").select(*FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    chars = F.col("n_chars").cast("decimal(38,0)")
    return proofs(manifest(leaves(docs, {"n_chars": F.when(hit, chars + 1).otherwise(chars)}), step))


ORACLE = """
with recursive leaf as (
  select doc_id, lang, row_number() over (partition by lang order by doc_id nulls first) - 1 as pos,
    list_reduce(list_prepend(4294967295::ubigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda ch: [ascii(ch)::ubigint + 4294967296, 0, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, b: case when b > 0 then xor(c, b - 4294967296) when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as c,
    [doc_id::varchar, source, lang, n_chars::varchar, text] as said,
    [doc_id::varchar, source, lang, (n_chars + 1)::varchar, text] as more
  from documents
), hashed as (
  select doc_id, lang, pos,
    sha256(array_to_string(list_transform(said, lambda x: coalesce(strlen(x)::varchar || ':' || x, '-')), '')) as leaf,
    sha256(array_to_string(list_transform(case when xor(c, 4294967295::ubigint) % 7 = 0 then more else said end, lambda x: coalesce(strlen(x)::varchar || ':' || x, '-')), '')) as claim
  from leaf
), tree as (
  select lang, pos, 0 as level, leaf as h, count(*) over (partition by lang) as n from hashed
  union all
  select lang, pos // 2, level + 1, sha256(string_agg(h, '' order by pos)), any_value((n + 1) // 2) from tree where n > 1 group by lang, pos // 2, level
), subroots as (
  select lang, level, h as subroot, row_number() over (order by encode(lang) nulls first) - 1 as pos, count(*) over () as n from tree where n = 1
), top as (
  select pos, 0 as level, subroot as h, n from subroots
  union all
  select pos // 2, level + 1, sha256(string_agg(h, '' order by pos)), any_value((n + 1) // 2) from top where n > 1 group by pos // 2, level
), every as (
  select a.doc_id, a.lang, a.pos, a.leaf, a.claim, s.subroot, w.way || v.way as way
  from hashed a join subroots s on a.lang is not distinct from s.lang
  join lateral (select coalesce(list([coalesce(t.h, ''), ((a.pos >> r.k) & 1)::varchar] order by r.k), []) as way from range(64) r(k)
    left join tree t on t.lang is not distinct from a.lang and t.level = r.k and t.pos = xor(a.pos >> r.k, 1) where r.k < s.level) w on true
  join lateral (select coalesce(list([coalesce(t.h, ''), ((s.pos >> r.k) & 1)::varchar] order by r.k), []) as way from range(64) r(k)
    left join top t on t.level = r.k and t.pos = xor(s.pos >> r.k, 1) where r.k < (select max(level) from top)) v on true
), folded as (
  select *, list_reduce(list_prepend([claim, ''], way), lambda h, x: [sha256(case when x[2] = '1' then x[1] || h[1] else h[1] || x[1] end), ''])[1] as folded_root,
    sha256(array_to_string(list_transform(way, lambda x: x[1]), '')) as proof_sha256
  from every
)
select doc_id, leaf, subroot, (select h from top where n = 1) as root, proof_sha256, folded_root, folded_root = (select h from top where n = 1) as verified
from folded
"""

QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLES = {"op12_merkle_manifest": ORACLE}
