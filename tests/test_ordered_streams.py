"""Ordered rules on streams: shuffled arrival, many batches and a replay give what loops over sorted rows give."""

import random
from datetime import datetime, timedelta

import pytest

from emberlog.operators import detections as D
from emberlog.streaming import ordered as O

SCHEMA = "ip string, user string, us long, outcome string, event_ts timestamp"
START = datetime(2024, 1, 1)


def _rows(seed=1):
    """Entries of twelve minutes, so that late ones stay within the watermark's ten, crossing whole minutes."""
    rng = random.Random(seed)
    out = []
    for ip, count in (("a", 120), ("b", 60), ("c", 9), ("d", 11)):
        times = sorted(rng.randrange(0, 540_000_000) for _ in range(count))
        if ip == "d":  # ten in less than a minute across a whole minute
            times = [50_000_000 + 1_900_000 * i for i in range(10)] + [400_000_000]
        out += [(ip, f"u{rng.randrange(2)}", t, rng.choice(["failure", "failure", "success"]) if ip != "d" else "failure") for t in times]
    return out


def _stream(spark, tmp_path, rows, batches, name, rule):
    """The rule's result when rows come shuffled in `batches` files, then one row much later to move the watermark on."""
    base = int(START.timestamp()) * 1_000_000
    rows = rows[:]
    random.Random(batches).shuffle(rows)
    path, q = str(tmp_path / f"in_{name}"), None
    full = lambda r: (r[0], r[1], base + r[2], r[3], START + timedelta(microseconds=r[2]))
    chunks = [rows[i::batches] for i in range(batches)] + [[("end", "u0", 86_400_000_000, "failure")], [("end", "u0", 86_400_000_000, "failure")]]
    for chunk in chunks:
        spark.createDataFrame([full(r) for r in chunk], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        q = rule(spark.readStream.schema(SCHEMA).parquet(path)).writeStream.format("parquet").option("path", str(tmp_path / f"out_{name}")).option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start()
        q.awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / f"out_{name}")).filter("ip <> 'end'").collect()
    return sorted(tuple(v - base if isinstance(v, int) and v > 10**12 else v for v in r) for r in got)


def _windows(rows, width):
    out = []
    for ip in {r[0] for r in rows}:
        now = None
        for _, _, us, outcome in sorted((r for r in rows if r[0] == ip), key=lambda r: r[2]):
            if now is None or us > now[1] + width:
                now = [ip, us, 0, 0]
                out.append(now)
            now[2], now[3] = now[2] + 1, now[3] + (outcome == "failure")
    return sorted(map(tuple, out))


def _bursts(rows, width, least):
    out = []
    for ip in {r[0] for r in rows}:
        times = sorted(r[2] for r in rows if r[0] == ip)
        near = [t for t in times if t < times[0] + width]
        if len(near) >= least:
            out.append((ip, near[0], near[-1], len(near)))
    return sorted(out)


@pytest.fixture(autouse=True)
def _store(spark):
    O.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("batches", [1, 3])
def test_anchored_windows_and_bursts(spark, tmp_path, batches):
    rows, width = _rows(), 30_000_000
    assert _stream(spark, tmp_path, rows, batches, "w", lambda s: O.anchored_windows(s, width)) == _windows(rows, width)
    assert _stream(spark, tmp_path, rows, batches, "b", lambda s: O.bursts(s)) == _bursts(rows, 60_000_000, 10)


def test_brute_force_equals_the_batch_rule(spark, tmp_path):
    rows = _rows(2)
    got = _stream(spark, tmp_path, rows, 2, "f", lambda s: O.brute_force(s, 4, 60_000_000))
    batch = spark.createDataFrame([(*r, START) for r in rows], SCHEMA)
    want = sorted((r.ip, r.user, r.start_us, r.failures) for r in D.sliding_brute_force(batch, 4, 60_000_000).collect())
    assert got == want and len(want) > 3
