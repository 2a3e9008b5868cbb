"""Substring and longest-prefix joins against nested loops."""

import ipaddress
import random

from pyspark.sql import functions as F

from emberlog.operators import geo
from emberlog.operators import substrings as S


def _nested(names, texts):
    return {(n, t) for n in names if n for t in texts if t and n in t}


def test_contained_equals_a_nested_loop(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    names = [word(rng.randrange(1, 9)) for _ in range(80)] + ["", None, "é_%", "zzzz", "ab" * 20]
    texts = [word(rng.randrange(0, 30)) for _ in range(200)] + ["é_%x", None, "ab" * 25, "a"]
    n = spark.createDataFrame([(x,) for x in names * 2], "name string")
    t = spark.createDataFrame([(x,) for x in texts * 2], "text string")
    for gram, block in ((4, 4096), (3, 2), (1, 7)):
        out = S.contained(n, t, gram, block)
        got = [(r.name, r.text) for r in out.collect()]
        assert len(got) == len(set(got)) and set(got) == _nested(names, texts)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert S.contained(n.limit(0), t).collect() == [] and S.contained(n, t.limit(0)).collect() == []


def test_file_events(spark):
    files = spark.createDataFrame([(1, "A.txt", 1000_000_000), (2, "b.log", 0), (3, "", 0), (4, None, 0)], "record long, name string, created_us long")
    rows = [(4688, 500_000_000, r"C:\x\a.TXT"), (4663, 900_000_000, "/srv/a.txt.bak"), (9, 0, "/srv/a.txt"), (5140, 0, "/srv/b.log/dir")]
    events = spark.createDataFrame(rows, "event_id int, us long, path string")
    got = {(r.record, r.path, r.event_id, r.kind, r.late_us, r.anomaly) for r in S.file_events(files, events).collect()}
    assert got == {(1, r"c:\x\a.txt", 4688, "process", 500_000_000, True), (1, "/srv/a.txt.bak", 4663, "object", 100_000_000, False), (2, "/srv/b.log/dir", 5140, "file", 0, False)}
    # of a file's paths only those seen first
    assert {r.path for r in S.file_events(files, events, most=2).filter("record = 1").collect()} == {r"c:\x\a.txt"}
    data = spark.createDataFrame([(7, {"a": r"C:\windows\x.exe", "b": "S-1-5-21/0000", "c": "/short", "d": None})], "event_id int, data map<string,string>")
    assert [(r.event_id, r.path) for r in S.event_paths(data).collect()] == [(7, r"c:\windows\x.exe")]


def test_journal_evidence(spark):
    day = S.DAY
    files = [(1, "copy", 900 * day, 1), (2, "Forged", 900 * day, 100 * day), (3, "odd", 900 * day, 1), (4, "quiet", 9 * day, 1), (5, "none", 9 * day, 1), (6, "later", 1, 2)]
    journal = [("my copy.txt", 1, ["FILE_CREATE"]), ("forged.exe", 200 * day, ["DATA_EXTEND"]), ("odd", 950 * day, ["DATA_EXTEND"]), ("the odd one", 960 * day, []), ("quiet", 1, ["CLOSE"]), ("later", 1, ["CLOSE"])]
    got = S.journal_evidence(spark.createDataFrame(files, "record long, name string, created_us long, modified_us long"), spark.createDataFrame(journal, "name string, us long, reasons array<string>"))
    assert {(r.record, r.rows, r.verdict) for r in got.collect()} == {(1, 1, "copied"), (2, 1, "forged"), (3, 2, "odd"), (4, 1, "quiet"), (5, 0, "unknown")}


ADDRESSES = ["198.18.0.1", "10.1.2.3", "172.31.0.1", "172.32.0.1", "192.168.1.1", "127.0.0.5", "169.254.3.3", "203.0.113.77", "0.0.0.0", "255.255.255.255", "::1", "::", "fe80::1", "fd12::9", "2001:db8::1", "2001:DB8:0:1::", "2001:db8:0:0:1:2:3:4", "::ffff:198.18.0.1", "1:2:3:4:5:6:198.18.0.1", "2001:db8::"]
BAD = ["", None, "x", "1.2.3", "1.2.3.256", "1.2.3.4.5", "1::2::3", "1:2:3", ":1", "1:", "12345::", "1:2:3:4:5:6:7:8:9", "g::1", "01.2.3.4"]


def test_bits_equal_the_standard_reading(spark):
    rows = spark.createDataFrame([(a,) for a in ADDRESSES + BAD], "ip string")
    got = {r.ip: r.b for r in rows.select("ip", geo.bits(F.col("ip")).alias("b")).collect()}
    for a in ADDRESSES:
        x = ipaddress.ip_address(a)
        assert got[a] == format(int(x), f"0{x.max_prefixlen}b"), a
    assert all(got[a] is None for a in BAD)


def test_countries_equal_a_loop_over_networks(spark):
    rng = random.Random(6)
    nets = [("0.0.0.0/1", "AA"), ("198.0.0.0/8", "BB"), ("198.18.0.0/15", "CC"), ("198.18.0.1/32", "DD"), ("198.18.0.1/32", "DX"), ("203.0.113.64/26", "EE"), ("2001:db8::/32", "FF"), ("2001:db8:0:1::/64", "GG"), ("::/0", "HH"), ("203.0.113.77", "II"), ("bad/3", "ZZ"), ("1.2.3.4/40", "ZZ"), (None, "ZZ")]
    addresses = ADDRESSES + [a for a in BAD if a != "01.2.3.4"] + [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(200)] + [f"198.{rng.randrange(16, 22)}.0.{i}" for i in range(40)]
    local = [ipaddress.ip_network(n) for n in geo.PRIVATE]

    def country(a):
        try:
            x = ipaddress.ip_address(a)
        except ValueError:
            return "LOCAL" if not a else "??"
        if any(x.version == n.version and x in n for n in local):
            return "LOCAL"
        fits = []
        for n, c in nets:
            try:
                net = ipaddress.ip_network(n, strict=False)
            except ValueError:
                continue
            if net.version == x.version and x in net:
                fits.append((-net.prefixlen, c))
        return min(fits)[1] if fits else "??"

    rows = spark.createDataFrame([(i, a) for i, a in enumerate(addresses)], "id long, ip string")
    out = geo.countries(rows, spark.createDataFrame(nets, "network string, country string"))
    assert {r.id: r.country for r in out.collect()} == {i: country(a) for i, a in enumerate(addresses)}
    assert out.columns == ["id", "ip", "country"]
    assert {r.country for r in geo.countries(rows.limit(5), spark.createDataFrame([], "network string, country string")).collect()} == {"LOCAL", "??"}


def test_is_private_knows_every_range(spark):
    rows = spark.createDataFrame([(a,) for a in ADDRESSES], "ip string")
    got = {r.ip: r.p for r in rows.select("ip", geo.is_private(F.col("ip")).alias("p")).collect()}
    local = [ipaddress.ip_network(n) for n in geo.PRIVATE]
    assert got == {a: any(x.version == n.version and x in n for n in local) for a in ADDRESSES for x in [ipaddress.ip_address(a)]}
