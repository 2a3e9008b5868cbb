"""Line dedup by a segment-partition edit join, in DataFrame operations alone.

Every line that holds a word, that is a letter or digit, is compared over the whole corpus, and so is one of WORDLESS
characters or more without any; other lines (blank ones, braces, rules) stay. Of equal lines the first (smallest doc_id,
then line number) stays. The distinct lines are then joined. The edits that make two lines near grow with the shorter
one: one for each PER_EDIT characters, THRESHOLD at most, so lines of fewer than PER_EDIT characters have to be equal.

The join has two levels of segments. A line of n characters and t edits is cut into t + 1 segments, so that a line
within t edits holds at least one of them unchanged: lines post their segments under (length, number, text), and probe
the lengths that they could match with the few substrings that the multi-match-aware rule leaves. Segments that no
second line has are dropped by counting. Around a shared segment, what is left of both lines is again within t edits,
so it is cut into t + 1 segments too, and only lines that share one of these as well meet: a segment that many lines
have in common (a template) is split by what they differ in. Counts of letters and digits, which t edits can't change much, thin the
pairs inside the join, and a banded bit-parallel edit distance decides. A line goes if an earlier one is near.

Equal lines count by a digest of two independent 64-bit hashes. Texts move only if the lists of lines are too large to
broadcast, which is measured.

Nulls and odd rows: a null or empty text and a null doc_id stay as they are; rows that repeat a doc_id and text get the
same verdict, and one that repeats a doc_id with another text is judged by its own lines; ties go by doc_id and line
number. A text keeps its other lines and its line breaks between them; one that loses every line becomes empty. An
empty table gives no rows. Other columns pass through, whatever their names, but for n_lines, n_exact and n_near, which
the counts replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm import shared as S

THRESHOLD = 2
#: Characters for each edit.
PER_EDIT = 10
#: Lines of so many characters are compared even if they hold no letter or digit.
WORDLESS = 24
#: Lists of lines (about 40 bytes a line) and keys (about 30) are broadcast up to so many.
BROADCAST_LINES = 1_000_000
BROADCAST_KEYS = 500_000
LETTERS = "etnoairsdl"
DIGITS = "0123456789"
RARER = "hcumpfgwybvkjxqz"
_SCALE = 10**10  # line numbers are below it
_LISTS = "array<struct<line_no: int, h1: bigint, h2: bigint>>"


def _position(doc_id: str, line_no: str) -> Column:
    """(doc_id, line_no) as one ordered number, which a hash aggregation can hold."""
    return (F.col(doc_id).cast("decimal(20,0)") * F.lit(_SCALE).cast("decimal(11,0)") + F.col(line_no).cast("decimal(10,0)")).cast("decimal(38,0)")


def _unpacked(df: DataFrame, p: str, *keep: str) -> DataFrame:
    d = df.withColumn("doc_id", F.floor(F.col(p) / F.lit(_SCALE).cast("decimal(38,0)")).cast("long"))
    no = (F.col(p) - F.col("doc_id").cast("decimal(20,0)") * F.lit(_SCALE).cast("decimal(11,0)")).cast("int")
    return d.select("doc_id", no.alias("line_no"), *keep)


def _digests(line: str) -> tuple[Column, Column]:
    return F.expr(f"xxhash64({line})").alias("h1"), F.expr(f"xxhash64(7L, {line})").alias("h2")


def _worded(line: str) -> str:
    """SQL for whether a line is compared at all."""
    return f"({line} <> '' and (length({line}) >= {WORDLESS} or {line} rlike '[\\\\p{{L}}\\\\p{{N}}]'))"


def _edits(n: str, threshold: int) -> str:
    """SQL for the edits that a line of `n` characters may differ by from one that is as long or longer."""
    return f"least({threshold}, ({n}) div {PER_EDIT})"


def _start(n: str, c: str, i: str) -> str:
    """SQL for the 1-based start of segment `i` of `n` characters under slot `c`; the longer segments come last."""
    return f"({i} * (({n}) div ({c}.t + 1)) + greatest(0, {i} - ({c}.t + 1 - ({n}) % ({c}.t + 1))) + 1)"


def _size(n: str, c: str, i: str) -> str:
    return f"(({n}) div ({c}.t + 1) + if({i} >= {c}.t + 1 - ({n}) % ({c}.t + 1), 1, 0))"


def _slots(threshold: int) -> list[tuple[int, int, int, int]]:
    """(t, l, i, d): with t edits, a line finds segment i of lines that are l characters shorter at a shift of d.

    The segments that the line posts itself, l = d = 0, come first.
    """
    out = []
    for t in range(1, threshold + 1):
        for less in range(t + 1):
            for i in range(t + 1):
                low, high = max(-i, less - (t - i)), min(i, less + (t - i))
                out += [(t, less, i, d) for d in range(low, high + 1)]
    return sorted(out, key=lambda s: (s[1], s[3] != 0, s[2], s[3], s[0]))


def _array(slots: list[tuple[int, int, int, int]]) -> str:
    return f"array({', '.join(f"named_struct('t', {t}, 'l', {less}, 'i', {i}, 'd', {d})" for t, less, i, d in slots)})"


def _slots_of(n: str, threshold: int) -> str:
    """SQL for the slots of a line of `n` characters; most lines are long enough for all edits at every length."""
    every = _slots(threshold)
    full = _array([s for s in every if s[0] == threshold])
    return f"if({n} >= {threshold * (PER_EDIT + 1)}, {full}, filter({_array(every)}, c -> {_edits(f'{n} - c.l', threshold)} = c.t))"


def _counts(chars: str, threshold: int | None = None, bits: int = 6) -> Column:
    """The counts of one-byte characters in `line`, of `bits` bits each, packed; above them the line's edits, if asked for."""
    total = F.lit(0).cast("long") if threshold is None else F.shiftleft(F.expr(_edits("n", threshold)).cast("long"), bits * len(chars))
    for i, c in enumerate(chars):
        count = F.octet_length("line") - F.octet_length(F.expr(f"replace(line, '{c}', '')"))
        total = total + F.shiftleft((count % (1 << bits)).cast("long"), bits * i)
    return total


def _alike() -> str:
    """SQL for whether counts of letters (x, z) and digits (y) differ by as much as the edits of the posted line can change them."""

    def gaps(name: str, chars: str, bits: int = 6) -> str:
        most = (1 << bits) - 1
        each = [f"abs((shiftright({name}a, {bits * i}) & {most}) - (shiftright({name}b, {bits * i}) & {most}))" for i in range(len(chars))]
        return " + ".join(f"least({g}, {most + 1} - {g})" for g in each)

    most = f"2 * shiftright(xa, {6 * len(LETTERS)})"
    common = f"{gaps('x', LETTERS)} + {gaps('y', DIGITS)}"
    return f"{gaps('y', DIGITS)} <= {most} and {common} <= {most} and {common} + {gaps('z', RARER, 4)} <= {most}"


def within(x: str, y: str, threshold: int) -> Column:
    """Whether the edit distance of two text columns is at most `threshold`: banded bit-parallel, one word a column.

    Bit b of the words stands for row i + threshold - (width - 1) + b in column i. The score follows the band's lowest
    diagonal down to the last row, then that row to its end.
    """
    k, width = threshold, 2 * threshold + 3
    full = (1 << width) - 1
    bits = " + ".join(f"if(get(p, i + {k - (width - 1) + b}) = c, {1 << b}L, 0L)" for b in range(width))
    vertical = f"{((1 << (k + 1)) - 1) << (width - k - 1)}L"
    d0 = f"(((((m & a.vp) + a.vp) ^ a.vp) | m | a.vn) & {full})"
    hp, hn, d1 = f"(a.vn | (~(d | a.vp) & {full}))", "(d & a.vp)", "shiftright(d, 1)"
    down = f"(1 - (shiftright(d, {width - 1}) & 1))"
    at = f"greatest(0, {width - 2} - cast(a.i - (size(p) - {k}) as int))"
    along = f"((shiftright({hp}, {at}) & 1) - (shiftright({hn}, {at}) & 1))"
    step = f"named_struct('vp', {hn} | (~({d1} | {hp}) & {full}), 'vn', {d1} & {hp}, 'i', a.i + 1, 'd', a.d + if(a.i < size(p) - {k}, {down}, {along}))"
    step = f"transform(array({d0}), d -> {step})[0]"
    run = f"aggregate(transform(q, (c, i) -> {bits}), named_struct('vp', {vertical}, 'vn', 0L, 'i', 0, 'd', {k}L), (a, m) -> {step}, a -> a.d)"
    return F.expr(f"transform(array(named_struct('p', split({x}, ''), 'q', split({y}, ''))), s -> abs(size(s.p) - size(s.q)) <= {k} and {_bound(run)} <= {k})[0]")


def _bound(run: str) -> str:
    """The expression with the arrays p and q taken from the struct s."""
    import re

    return re.sub(r"\b([pq])\b(?=[,)])", r"s.\1", run)


def _per_doc(lines: DataFrame, *fields: str) -> DataFrame:
    """Lines gathered for each document; a document has few."""
    return lines.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("line_no", "h1", "h2", *fields))).alias("w"))


def _joined(docs: DataFrame, lists: DataFrame, how: str, lines: int | None = None) -> DataFrame:
    if lines is None:
        lines = lists.agg(F.sum(F.size("w"))).first()[0] or 0
    return docs.join(F.broadcast(lists) if lines <= BROADCAST_LINES else lists, "doc_id", how)


def _own(lines: str, lists: str) -> str:
    """SQL for the numbers of those listed lines that `lines` has; a row that repeats a doc_id may have others."""
    return f"transform(filter({lists}, e -> xxhash64(get({lines}, e.line_no)) = e.h1 and xxhash64(7L, get({lines}, e.line_no)) = e.h2), e -> e.line_no)"


def _repeats(texts: DataFrame) -> DataFrame:
    """Per document, the lines that an earlier one equals."""
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(_worded("line"))
    seen = S.checkpoint(lines.select(*_digests("line"), _position("doc_id", "line_no").alias("p")))
    first = seen.groupBy("h1", "h2").agg(F.min("p").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    again = seen.join(first, ["h1", "h2"]).filter("p <> first")
    return S.checkpoint(_per_doc(_unpacked(again, "p", "h1", "h2")))


def _firsts(texts: DataFrame, exact: DataFrame, threshold: int) -> DataFrame:
    """The first of each line that edits may make near to another: uid, doc_id, line_no, h1, h2, n, and the keys of its slots."""
    split = _joined(texts, exact, "left").select("doc_id", F.split("text", "\n").alias("lines"), F.expr(f"coalesce(w, cast(array() as {_LISTS}))").alias("w"))
    kept = f"if(size(w) = 0, sequence(0, size(lines) - 1), array_except(sequence(0, size(lines) - 1), {_own('lines', 'w')}))"
    ones = split.select("doc_id", "lines", F.explode(F.expr(kept)).alias("line_no")).select("doc_id", "line_no", F.expr("lines[line_no]").alias("line"))
    ones = ones.filter(f"octet_length(line) >= {PER_EDIT}").select("*", F.length("line").alias("n")).filter(f"n >= {PER_EDIT} and {_worded('line')}")
    key = f"xxhash64(n - c.l, c.i, substring(line, {_start('n - c.l', 'c', 'c.i')} + c.d, {_size('n - c.l', 'c', 'c.i')}))"
    keys = F.expr(f"transform({_slots_of('n', threshold)}, c -> {key})")
    return S.checkpoint(ones.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "line_no", *_digests("line"), "n", keys.alias("keys")))


def _candidates(texts: DataFrame, ones: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of lines that share a segment and one of what is left; and the lines that share a segment."""
    posted = F.col("pos") <= F.expr(_edits("n", threshold))
    slots = ones.select("uid", "doc_id", "line_no", "h1", "h2", "n", F.posexplode("keys").alias("pos", "key"))
    # keys that one line at least posts, and a second row has
    shared = slots.groupBy("key").agg(F.sum(F.when(posted, (1 << 32) + 1).otherwise(1)).alias("c")).filter(f"c >= {(1 << 32) + 2}")
    shared = S.checkpoint(shared.select("key"))
    alive = S.checkpoint(slots.join(S.small(shared, BROADCAST_KEYS), "key", "left_semi"))
    rows = _joined(texts, _per_doc(alive, "uid", "pos", "key"), "inner", alive.count()).select("doc_id", F.split("text", "\n").alias("lines"), F.explode("w").alias("w"))
    rows = rows.select("w.*", F.expr("get(lines, w.line_no)").alias("line")).filter("xxhash64(line) = h1 and xxhash64(7L, line) = h2").select("uid", "key", "pos", "line", F.length("line").alias("n"))
    rows = rows.select("*", F.expr(f"get({_slots_of('n', threshold)}, pos)").alias("c"))
    at, size = _start("n - c.l", "c", "c.i"), _size("n - c.l", "c", "c.i")
    rest = f"concat(substring(line, 1, {at} + c.d - 1), substring(line, {at} + c.d + {size}))"
    # m: what the posted line has left
    rows = rows.select("uid", "key", "pos", "n", "c", _counts(LETTERS, threshold).alias("x"), _counts(DIGITS).alias("y"), _counts(RARER, bits=4).alias("z"), F.expr(rest).alias("rest"), F.expr(f"n - c.l - {size}").alias("m"))
    second = f"xxhash64(key, s.i, substring(rest, {_start('m', 's', 's.i')} + s.d, {_size('m', 's', 's.i')}))"
    own = f"filter({_array([s for s in _slots(threshold) if s[1] == s[3] == 0])}, s -> s.t = c.t and pos <= c.t)"
    other = f"filter({_array(_slots(threshold))}, s -> s.t = c.t and s.l = c.l)"
    rows = S.checkpoint(rows.select("uid", F.expr("c.l").alias("l"), "x", "y", "z", F.expr(f"transform({own}, s -> {second})").alias("posts"), F.expr(f"transform({other}, s -> {second})").alias("probes")))
    index = rows.select(F.explode("posts").alias("key"), F.col("uid").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("z").alias("za"))
    asked = rows.select(F.explode("probes").alias("key"), "l", F.col("uid").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("z").alias("zb"))
    pairs = index.join(asked, "key").filter(f"(l = 0 and a < b or l > 0) and {_alike()}")
    return S.checkpoint(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), alive


def _near(texts: DataFrame, pairs: DataFrame, alive: DataFrame, threshold: int) -> DataFrame:
    """Per document, the lines that are near an earlier one."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    places = alive.select("uid", "doc_id", "line_no", "h1", "h2").distinct().join(wanted, "uid", "left_semi")
    rows = _joined(texts, S.checkpoint(_per_doc(places, "uid")), "inner").select("doc_id", F.split("text", "\n").alias("lines"), F.explode("w").alias("w"))
    found = rows.select("doc_id", "w.*", F.expr("get(lines, w.line_no)").alias("line")).filter("xxhash64(line) = h1 and xxhash64(7L, line) = h2").dropDuplicates(["uid"])
    found = S.checkpoint(found.select("uid", "line", F.struct("doc_id", "line_no", "h1", "h2").alias("at")))
    left = found.select(F.col("uid").alias("a"), F.col("line").alias("x"), F.col("at").alias("pa"))
    right = found.select(F.col("uid").alias("b"), F.col("line").alias("y"), F.col("at").alias("pb"))
    edits = F.expr(_edits("least(length(x), length(y))", threshold))
    close = F.lit(False)
    for t in range(1, threshold + 1):
        close = F.when(edits == t, within("x", "y", t)).otherwise(close)
    later = pairs.join(left, "a").join(right, "b").filter("pa <> pb").filter(close).select(F.greatest("pa", "pb").alias("p")).distinct()
    return S.checkpoint(_per_doc(later.select("p.*")))


def duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Per document, the lines (w: line_no, h1, h2) that repeat an earlier one exactly, and nearly."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    exact = _repeats(texts)
    pairs, alive = _candidates(texts, _firsts(texts, exact, threshold), threshold)
    return exact, _near(texts, pairs, alive, threshold)


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """`docs` (doc_id, text, ...) without repeated lines, and n_lines, n_exact and n_near (lines removed)."""
    exact, near = duplicates(docs, threshold)
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    d = docs.toDF(*inner).withColumn("doc_id", F.col(inner[names.index("doc_id")]).cast("long")).withColumn("t", F.col(inner[names.index("text")]).cast("string"))
    for lists, kind in ((exact, "exact"), (near, "near")):
        d = _joined(d, lists, "left").withColumn(kind, F.expr(f"coalesce(w, cast(array() as {_LISTS}))")).drop("w")
    # only texts with such lines are split
    kept = "array_join(transform(array_except(sequence(0, size(g.l) - 1), concat(g.e, g.n)), i -> g.l[i]), '\\n')"
    cut = f"transform(transform(array(split(t, '\\n')), l -> named_struct('l', l, 'e', {_own('l', 'exact')}, 'n', {_own('l', 'near')})), g -> named_struct('e', size(g.e), 'n', size(g.n), 'text', if(size(g.e) + size(g.n) = 0, t, {kept})))[0]"
    d = d.withColumn("cut", F.expr(f"case when t is null or size(exact) + size(near) = 0 then null else {cut} end"))
    n_lines = F.coalesce(F.length("t") - F.length(F.expr("replace(t, '\\n', '')")) + 1, F.lit(0))
    counts = [n_lines.cast("long").alias("n_lines"), *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(n) for c, n in (("cut.e", "n_exact"), ("cut.n", "n_near")))]
    cols = [F.coalesce("cut.text", c).alias(n) if n == "text" else F.col(c).alias(n) for c, n in zip(inner, names) if n not in ("n_lines", "n_exact", "n_near")]
    return d.select(*cols, *counts)


def op1_line_dedup(spark, sf_dir) -> DataFrame:
    out = dedup_lines(S.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLES: dict = {}
