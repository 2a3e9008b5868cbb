"""Merkle manifest against plain loops, with blocks of several heights and odd rows."""

import hashlib
import os
import zlib

import duckdb
import pytest

from emberlog.llm import merkle

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string"


def _h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _leaf(r, more=0):
    n = r["n_chars"] + more if r["n_chars"] is not None else None
    said = [r["doc_id"], r["source"], r["lang"], n, r["text"]]
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in said))


def _grown(row):
    """All levels over `row`, and each node's siblings on the way up."""
    levels = [row]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_h("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    ways = []
    for i in range(len(row)):
        ways.append([(level[(i >> k) ^ 1] if (i >> k) ^ 1 < len(level) else None, (i >> k) & 1) for k, level in enumerate(levels[:-1])])
    return levels[-1][0], ways


def _expected(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in rows if r["lang"] == x), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r))) for x in langs}
    grown = {x: _grown([_leaf(r) for r in trees[x]]) for x in langs}
    root, up = _grown([grown[x][0] for x in langs])
    out = []
    for x, over in zip(langs, up):
        for r, way in zip(trees[x], grown[x][1]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            h = _leaf(r, int(hit))
            for s, right in way + over:
                h = _h(h if s is None else s + h if right else h + s)
            proof = _h("".join(s for s, _ in way + over if s))
            out.append((r["doc_id"], _leaf(r), grown[x][0], root, proof, h, h == root))
    return sorted(out, key=repr)


def _query(spark, rows, step, tmp_path):
    spark.createDataFrame([tuple(r[c.split()[0]] for c in DOCS.split(", ")) for r in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op12_merkle_manifest(spark, str(tmp_path), step).collect()), key=repr)


def _rows(counts):
    out = []
    for lang, n in counts.items():
        out += [{"doc_id": 1000 - len(out), "text": f"text {lang} {len(out)} ä", "lang": lang, "source": None, "n_chars": len(out), "tree": "x"} for _ in range(n)]
    return out


@pytest.mark.parametrize("step,counts", [(1, {"a": 5, "b": 1, None: 3}), (2, {"a": 17, "b": 16, "c": 4, "d": 1, None: 2, "é": 5}), (3, {"x": 9}), (2, {str(i): 1 for i in range(21)}), (9, {"x": 1}), (9, {"a": 40, "b": 7})])
def test_proofs_equal_plain_loops(spark, tmp_path, step, counts):
    rows = _rows(counts)
    assert _query(spark, rows, step, tmp_path) == _expected(rows)


def test_odd_rows(spark, tmp_path):
    blank = {"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None, "tree": None}
    rows = [blank, blank, blank | {"doc_id": 7}, blank | {"doc_id": 7, "text": "b", "n_chars": 2**63 - 1}, blank | {"doc_id": 7, "text": "a"}, blank | {"lang": "", "text": ""}, blank | {"lang": "en", "text": "word " * 200_000, "doc_id": 3, "n_chars": 5}]
    assert any(zlib.crc32(str(i).encode()) % 7 == 0 for i in range(40))
    rows += [blank | {"doc_id": i, "n_chars": i % 3 or None, "lang": "en"} for i in range(40)]
    got = _query(spark, rows, 2, tmp_path)
    assert got == _expected(rows) and {r[-1] for r in got} == {True, False}
    empty = os.path.join(tmp_path, "none")
    assert _query(spark, [], 2, empty) == []


def test_nodes_are_parent_linked(spark):
    rows = _rows({"a": 11, "b": 6, "c": 1})
    docs = spark.createDataFrame([tuple(r[c.split()[0]] for c in DOCS.split(", ")) for r in rows], DOCS)
    found = merkle.manifest(merkle.leaves(docs), 2)
    nodes = {(r.tree, r.level, r.pos): r for r in found.nodes.collect()}
    assert len(nodes) == found.nodes.count()
    children = {}
    for at, r in nodes.items():
        if (up := (r.parent_tree, r.parent_level, r.parent_pos)) != at:
            children.setdefault(up, []).append(r)
    for up, below in children.items():
        below.sort(key=lambda r: r.pos)
        made = found.root if up == (merkle.TOP, found.height, 0) else nodes[up].hash
        assert made == _h("".join(r.hash for r in below)) or [made] == [r.hash for r in below]
    assert sum(r.level == 0 and r.tree != merkle.TOP for r in nodes.values()) == len(rows)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.execute(merkle.ORACLE).fetchall())
    assert sorted(tuple(r) for r in merkle.op12_merkle_manifest(spark, SF).collect()) == want and len(want) > 100
