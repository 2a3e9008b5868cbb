"""Line dedup, near-dedup and substring dedup against brute force, with odd rows."""

import hashlib
import random
import re

import pytest

from pyspark.sql import functions as F

from emberlog.llm import line_dedup, near_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, kept string"


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, x in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return row[-1]


def changed(rng, text, alphabet, times):
    t = list(text)
    for _ in range(times):
        p, kind = rng.randrange(len(t)), rng.random()
        if kind < 0.4:
            t[p] = rng.choice(alphabet)
        elif kind < 0.7:
            del t[p]
        else:
            t.insert(p, rng.choice(alphabet))
    return "".join(t)


def test_bit_parallel_distance(spark):
    rng, pairs = random.Random(1), []
    for _ in range(150):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(6, 40)))
        pairs.append((a, changed(rng, a, "abé", rng.randint(0, 5))))
    for k in (1, 2, 3):
        got = spark.createDataFrame(pairs, "x string, y string").select("x", "y", line_dedup.within("x", "y", k).alias("w")).collect()
        assert all(r.w == (edit(r.x, r.y) <= k) for r in got)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(24, 40))) for _ in range(30)]
    docs = [(d, "\n".join(changed(rng, rng.choice(base), "abcé ", rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 6))) + rng.choice(["", "\n", "\nshort"])) for d in range(40)]
    docs += [(100, None), (None, base[0]), (101, "")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA)).collect()}
    seen = []
    for d, t in docs:
        if d is None or t is None:
            assert got[d].text == t
            continue
        out, exact, near = [], 0, 0
        for line in t.split("\n"):
            if not any(c.isalnum() for c in line) and len(line) < 24:
                out.append(line)
            elif line in seen:
                exact += 1
            else:
                hit = any(abs(len(s) - len(line)) <= 2 and edit(line, s) <= min(2, min(len(s), len(line)) // 10) for s in seen)
                near += hit
                if not hit:
                    out.append(line)
                seen.append(line)
        assert (got[d].text, got[d].n_exact, got[d].n_near) == ("\n".join(out), exact, near)


def test_short_lines_equal_brute_force(spark):
    """Lines of all lengths: exact from one word on, near by one edit for each ten characters of the shorter line."""
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 26))) for _ in range(120)]
    odd = ["", " ", "}", "---", "-" * 30, "5", "é", "All rights reserved."]
    docs = [(d, "\n".join(rng.choice(odd) if rng.random() < 0.2 else changed(rng, rng.choice(base), "abcé ", rng.choice([0, 0, 1, 2])) for _ in range(rng.randint(1, 8)))) for d in range(60)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA)).collect()}
    seen, totals = [], [0, 0]
    for d, t in docs:
        out, exact, near = [], 0, 0
        for line in t.split("\n"):
            if not any(c.isalnum() for c in line) and len(line) < 24:
                out.append(line)
            elif line in seen:
                exact += 1
            else:
                hit = any(edit(line, s) <= min(2, min(len(s), len(line)) // 10) for s in seen)
                near += hit
                if not hit:
                    out.append(line)
                seen.append(line)
        assert (got[d].text, got[d].n_exact, got[d].n_near) == ("\n".join(out), exact, near)
        totals = [totals[0] + exact, totals[1] + near]
    assert min(totals) > 20


def test_template_lines_equal_brute_force(spark):
    """Many lines that share most of their text, so that segments are common, and lines that differ by few edits."""
    rng = random.Random(18)
    body = "the parcel of the customer was handed over to the carrier"
    lines = [f"{rng.choice(['no', 'nr'])} {rng.randint(100, 999)} {body} on day {rng.randint(10, 99)} at {rng.randint(10, 23)}" for _ in range(220)]
    docs = [(d, "\n".join(rng.sample(lines, 3) + [changed(rng, rng.choice(lines), "xyz", 2)])) for d in range(70)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA)).collect()}
    seen, near = [], 0
    for d, t in docs:
        out = []
        for line in t.split("\n"):
            if line not in seen:
                hit = any(abs(len(s) - len(line)) <= 2 and edit(line, s) <= 2 for s in seen)
                near += hit
                out += [] if hit else [line]
                seen.append(line)
        assert got[d].text == "\n".join(out)
    assert near > 20


def test_line_dedup_odd_rows(spark):
    """Repeated rows, a doc_id with two texts, one very long text, names that clash with the operator's own."""
    rng = random.Random(19)
    long = "\n".join("".join(rng.choice("abcdefghijklmnop ") for _ in range(40)) for _ in range(20_000))
    rows = [(1, "the same words here\nand more of them", 9), (1, "the same words here\nand more of them", 9), (2, "the same words here\nx", 8), (2, "other\nthe same words here", 7), (3, "\n\n", 6), (4, long, 5), (5, "  ", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id long")
    for c in ("doc", "w", "t", "c0", "n_lines", "exact", "cut"):
        df = df.withColumn(c, F.lit(c))
    out = line_dedup.dedup_lines(df)
    assert [c for c in out.columns if c not in ("n_exact", "n_near", "n_lines")] == [c for c in df.columns if c != "n_lines"]
    got = sorted(((r.doc_id, r.text, r._id, r.n_exact, r.n_near, r.w, r.t, r.c0, r.exact, r.cut) for r in out.collect()), key=repr)
    tail = ("w", "t", "c0", "exact", "cut")
    want = [(1, rows[0][1], 9, 0, 0), (1, rows[0][1], 9, 0, 0), (2, "x", 8, 1, 0), (2, "other", 7, 1, 0), (3, "\n\n", 6, 0, 0), (5, "  ", 4, 0, 0)]
    kept = [r for r in got if r[0] != 4]
    assert kept == sorted(((*w, *tail) for w in want), key=repr)
    four = next(r for r in got if r[0] == 4)
    assert four[3] == 0 and len(four[1].split("\n")) == 20_000 and four[4] == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for d in range(160):
        if docs and rng.random() < 0.6:
            w = (rng.choice(docs)[1] or "a").split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = [rng.choice(words) for _ in range(rng.randint(1, 90))]
        docs.append((d, " ".join(w)))
    docs += [(900, None), (901, " \n"), (902, docs[0][1].upper()), (None, docs[0][1]), (5, docs[5][1])]
    got = near_dedup.near_dedup(spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA)).collect()
    sets = {d: shingles(t) for d, t in docs if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)


def test_long_lists_are_compared_in_blocks(spark, monkeypatch):
    """A dense group of near copies, in lists beyond the bound, gives the components of brute force."""
    monkeypatch.setattr(near_dedup, "LONG_LIST", 4)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for d in range(40):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(999)}"
        docs.append((d, " ".join(w)))
    test = spark.createDataFrame(docs, "doc_id long, text string")
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}
    for _ in docs:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(test).collect()} == root


def test_agreements_follow_the_threshold():
    assert [(near_dedup.agreements(s, near_dedup.COORDINATES), near_dedup.sketch_agreements(s)) for s in (85, 80)] == [(18, 405), (15, 377)]


def test_pipeline_stage_links_from_80_percent(spark):
    """Pairs with a Jaccard similarity in [0.80, 0.85), and others, against brute force."""
    import corpus_pipeline

    rng, docs, between = random.Random(7), [], 0
    for d in range(0, 240, 2):
        base = [f"w{rng.randrange(9999)}" for _ in range(rng.randint(60, 160))]
        copy = list(base)
        for p in rng.sample(range(8, len(base) - 8, 9), rng.choice([1, 1, 2, 2, 3])):
            copy[p] = "x"
        docs += [(d, " ".join(base), "x", "y"), (d + 1, " ".join(copy), "x", "y")]
    want = set()
    for (a, x, *_), (b, y, *_) in zip(docs[::2], docs[1::2]):
        p, q = shingles(x), shingles(y)
        share = 100 * len(p & q) / len(p | q)
        between += 80 <= share < 85
        want |= {a} if share >= 80 else {a, b}
    assert between > 20
    got = corpus_pipeline.stage_near(spark, spark.createDataFrame(docs, SCHEMA), "").collect()
    assert {r.doc_id for r in got} == want


def removed(docs, match):
    """By (doc_id, text), in the order that the operator states."""
    seen, out = set(), {}
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - match + 1):
            if b[p : p + match] in seen:
                gone[p : p + match] = b"\1" * match
            seen.add(b[p : p + match])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[d, t] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("match, gram, pairs, batch, settle", [(12, 4, 64, 4096, 10**6), (12, 5, 2, 7, 50), (12, 5, 1, 999, 300), (20, 20, 1, 5, 100), (20, 4, 0, 5, 1)])
def test_suffix_dedup_equals_brute_force(spark, match, gram, pairs, batch, settle):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(10, 60))) for _ in range(8)]
    docs = [(3 * d - 40, "".join(rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(0, 6)))) for d in range(80)]
    docs += [(900, "a" * 70), (901, "a" * 33 + pool[0]), (5000, None), (5001, "")]
    want = removed(docs, match)
    table = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA).repartition(3)
    got = suffix_dedup.dedup_substrings(table, match, gram, pairs, batch, settle, with_text=True).collect()
    assert len(got) == len(docs)
    by = dict(docs)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id, by[r.doc_id]]
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_suffix_dedup_of_repeated_rows_and_null_ids(spark):
    """A doc_id with several texts: in order of a digest of the text; equal rows are one document; null ids come last."""
    from pyspark.sql import functions as F

    rng = random.Random(15)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(6)]
    docs = [(rng.choice([1, 2, 3, None]), "".join(rng.sample(pool, 3))) for _ in range(25)]
    docs += docs[:5] + [(None, None), (2, "")]
    table = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA).repartition(3)
    digest = {r.text: r.h for r in table.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(set(docs), key=lambda x: (x[0] is None, x[0] or 0, digest[x[1]]))
    want = removed(order, 20)
    got = [tuple(r) for r in suffix_dedup.dedup_substrings(table, 20, 6, 2).collect()]
    assert sorted(got, key=repr) == sorted([(d, *want[d, t]) for d, t in docs], key=repr)


def test_a_long_row_is_read_in_parts():
    import numpy as np

    rng = random.Random(6)
    data = np.frombuffer("".join(rng.choice("abc") for _ in range(5000)).encode(), np.uint8)
    whole = list(zip(*suffix_dedup._chunk_anchors(data, np.array([0, len(data)]), 30, 8)[1:5]))
    parts = [(a + s, b + s, c + s, h) for d, o, s in suffix_dedup._parts(data, np.array([0, len(data)]), 30, 700) for a, b, c, h in zip(*suffix_dedup._chunk_anchors(d, o, 30, 8)[1:5])]
    windows = lambda runs: {(p, c, h) for a, b, c, h in runs for p in range(a, b + 1)}
    assert windows(whole) == windows(parts)


def test_near_dedup_recall_near_the_threshold(spark):
    """Of many pairs with a similarity from 0.82 to 0.93, and a long text, none is lost; below 0.85 none is linked."""
    rng, docs, want = random.Random(21), [], {}
    for d in range(0, 1200, 2):
        n = rng.randint(80, 400)
        base = [f"w{rng.randrange(99999)}" for _ in range(n)]
        copy = list(base)
        for p in rng.sample(range(6, n - 6), max(1, n // rng.choice((55, 60, 65, 70)))):
            copy[p] = "x"
        docs += [(d, " ".join(base), "x", "y"), (d + 1, " ".join(copy), "x", "y")]
        p, q = shingles(docs[-2][1]), shingles(docs[-1][1])
        want[d + 1] = d if 100 * len(p & q) >= 85 * len(p | q) else d + 1
    docs.append((5000, " ".join(f"v{i}" for i in range(200_000)), "x", "y"))
    want[5000] = 5000
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(docs, SCHEMA).repartition(4)).collect()}
    assert {k: got[k] for k in want} == want and 100 < sum(k != v for k, v in want.items()) < 590


def test_first_of_each_with_odd_rows(spark):
    """Rows with equal or null ids are judged one by one; one of equal rows stays; clashing names pass."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, 1), (5, text + " end", 2), (5, "another text altogether", 3), (None, text, 4), (None, "only here", 5), (None, "only here", 5), (3, None, 6), (2, "", 7)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, row long, c0 string").repartition(3)
    got = near_dedup.first_of_each(df, 80)
    assert got.columns == df.columns
    kept = sorted((r.row for r in got.collect()))
    assert kept in ([1, 3, 5, 6, 7], [2, 3, 5, 6, 7])


@pytest.mark.parametrize("run", [line_dedup.dedup_lines, near_dedup.near_dedup, suffix_dedup.dedup_substrings, near_dedup.first_of_each])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sketches_stay_off_lists_that_one_component_holds(spark, monkeypatch):
    """A group of near copies of its first text is settled by its lists' first members: no list carries sketches."""
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join(words if i == 0 else [*words[: 10 * i], f"other{i}", *words[10 * i + 1 :]])) for i in range(12)], "doc_id long, text string")
    made, keep = [], near_dedup.S.checkpoint

    def noted(df):
        out = keep(df)
        made.append((set(out.columns), out.count()))
        return out

    monkeypatch.setattr(near_dedup.S, "checkpoint", noted)
    assert {r["component_id"] for r in near_dedup.near_dedup(docs).collect()} == {0}
    wide = [n for columns, n in made if {"key", "s0"} <= columns]
    assert wide and not sum(wide)


def test_lines_that_differ_in_rarer_letters_do_not_meet(spark):
    """Lines of one template with marks of rarer letters share their segments, but no pair is handed to the edit distance."""
    template = "the rest of the tale and its end are on the other side of the stone near the old road to the sea " * 2
    marks = ["hcum", "pfgw", "ybvk", "jxqz"]
    docs = spark.createDataFrame([(i, template[:90] + marks[i % 4] * (1 + i // 4) + template[90 + 4 * (i // 4) :]) for i in range(16)], "doc_id long, text string")
    pairs, alive = line_dedup._candidates(docs, line_dedup._firsts(docs, line_dedup._repeats(docs), 2), 2)
    assert alive.select("uid").distinct().count() == 16 and pairs.count() == 0
    near = docs.unionByName(spark.createDataFrame([(99, template[:90] + "hcuq" + template[90:])], docs.schema))
    assert {r["doc_id"] for r in line_dedup.dedup_lines(near).filter("n_near > 0").collect()} == {99}
