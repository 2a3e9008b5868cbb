"""Windowed rules against plain loops, and thresholds at their edges."""

import random

from emberlog.operators import detections as D


def _entries(spark, rows):
    return spark.createDataFrame(rows, "id long, us long, ip string, user string, outcome string")


def test_greedy_windows_equal_a_loop(spark):
    random.seed(1)
    rows = [(i, random.randint(0, 300) * 1000, f"i{random.randint(0, 3)}", "u", "failure") for i in range(200)]
    got = {r.id: r.window_start for r in D.greedy_windows(_entries(spark, rows), "ip", 20_000).collect()}
    start = {}
    for i, us, ip, *_ in sorted(rows, key=lambda r: r[1]):
        if ip not in start or us > start[ip] + 20_000:
            start[ip] = us
        assert got[i] == start[ip]


def test_brute_force_edges(spark):
    def alerts(n, last):
        rows = [(i, i * 1000, "a", "u", "failure") for i in range(n - 1)] + [(99, last, "a", "u", "failure")]
        return D.sliding_brute_force(_entries(spark, rows), 5, 10_000).collect()

    assert alerts(4, 9_000) == []
    assert [(r.start_us, r.failures) for r in alerts(5, 10_000)] == [(0, 5)]
    assert alerts(5, 10_001) == []


def test_password_spray_counts_users_once(spark):
    rows = [(i, t, "a", u, "failure") for i, (t, u) in enumerate([(0, "x"), (1, "x"), (5, "y"), (10, "z"), (11, "w")])]
    got = D.password_spray(_entries(spark, rows), 3, 10).collect()
    assert [(r.start_us, r.users, r.most_users) for r in got] == [(0, 3, 4)]


def loop_windows(rows, width):
    """window start of each entry, by a plain loop."""
    start, out = {}, {}
    for i, us, ip, *_ in sorted(rows, key=lambda r: r[1]):
        if ip not in start or us > start[ip] + width:
            start[ip] = us
        out[i] = start[ip]
    return out


def test_windowed_chains_equal_a_loop(spark):
    random.seed(3)
    rows = [(i, random.randint(0, 400) * 1000, f"i{random.randint(0, 3)}", f"u{random.randint(0, 5)}", random.choice(["failure", "failure", "success"])) for i in range(400)]
    at = loop_windows(rows, 30_000)
    brute, spray = {}, {}
    for i, us, ip, user, outcome in rows:
        if outcome == "failure":
            brute.setdefault((ip, at[i], user), []).append(us)
            spray.setdefault((ip, at[i]), []).append((us, user))
    got = D.windowed_brute_chains(_entries(spark, rows), 3, 25_000, 30_000).collect()
    want = {(k, len(v)) for k, v in brute.items() if len(v) >= 3 and max(v) - min(v) <= 25_000}
    assert {((r.ip, r.window_start, r.user), r.n) for r in got} == want and want
    got = D.windowed_spray_chains(_entries(spark, rows), 4, 30_000, 30_000).collect()
    want = {(k, len({u for _, u in v})) for k, v in spray.items() if len({u for _, u in v}) >= 4}
    assert {((r.ip, r.window_start), r.users) for r in got} == want and want


def test_isolation_forest_sets_outliers_apart(spark):
    from emberlog.operators import features

    random.seed(4)
    rows = [(i, random.gauss(0, 1), random.gauss(0, 1)) for i in range(300)] + [(1000 + i, 9.0 + i, -9.0 - i) for i in range(3)]
    got = {r.id: r.anomaly_score for r in features.isolation_forest(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"]).collect()}
    assert len(got) == len(rows) and min(got[1000 + i] for i in range(3)) > sorted(v for k, v in got.items() if k < 1000)[-6]
