"""URL filter: host and path rules, and logistic regression on hashed character n-grams for URLs that no rule fits.

The longest fitting rule decides. Otherwise the URL is blocked if the regression, trained from a small labelled URL
table, gives a probability of THRESHOLD or more. Training data are a bounded table that the driver holds; scoring runs
where the rows lie, a batch at a time. N-grams are those of the words of host and path, runs of letters with a mark at
either end; digits and signs carry nothing, so the numbers of a path do not sway a host's verdict. Each n-gram counts
alike, however long the URL is, and one that the table lacks counts nothing. A URL of unknown words stays near the
intercept, under THRESHOLD, and is allowed.

The labelled table is made of common words: hosts and paths of kinds of site that corpora leave out (gambling, adult,
pills, loans, downloads of cracked software, link and ad farms) and of kinds that they keep.

Nulls and odd rows: a null url, or one without `://`, has an empty host and path, fits no rule, and is allowed; a null
page_id is judged as any other row; repeated rows each get a verdict. Labelled rows with a null are not learned from.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import shared as S

BITS = 18
ORDERS = (3, 4, 5)
#: Above what made-up names get that were not learned from.
THRESHOLD = 0.7
#: What an n-gram counts.
UNIT = 0.25
MOST_LABELLED = 10_000

#: (verdict, rule)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

UNWANTED = """casino poker roulette slots betting bet jackpot lottery sportsbook blackjack bingo gamble wager
porn xxx adult nude escort webcam fetish erotic hentai sexy milf camgirls
viagra cialis pills pharmacy steroids weightloss botox painkiller
payday loan quickcash forex binary-options cryptodoubler getrich
torrent warez keygen crack serial cracked-apk pirate nulled
spam linkfarm backlinks adserver clickbait popunder doorway phishing malware tracker replica fake-watches counterfeit""".split()
WANTED = """news library museum university school weather history garden cooking recipe theatre music science physics
chemistry biology math travel hotel railway airport city council court law parliament health hospital clinic nursing
football tennis chess running cycling film novel poetry painting photo design architecture language dictionary
encyclopedia lecture course research journal archive data map forum blog shop bakery bookstore furniture bicycle camera
software developer docs manual support download-center kernel database network energy climate farming forest ocean
children family church charity volunteer bank insurance tax jobs career""".split()


_PLAIN = ("www", "m", "blog", "the", "my", "best", "online", "info", "site", "page", "home", "world", "club", "net", "zone", "daily")
_ENDS = ("com", "net", "org", "info", "co", "io")


def labelled_urls(each: int = 8) -> list[tuple[str, int]]:
    """The small labelled table: 1 is unwanted. Each word stands `each` times in a host or path beside plain words, which
    are dealt by a checksum and so tell nothing; as many made-up names as unwanted rows are wanted."""
    rows = []
    for words, label in ((UNWANTED, 1), (WANTED, 0)):
        for w in words:
            for k in range(each):
                n = zlib.crc32(f"{w} {k}".encode())
                x, y, end = _PLAIN[n % 16], _PLAIN[n // 16 % 16], _ENDS[n // 256 % 6]
                host = (f"{w}.{end}", f"{x}-{w}.{end}", f"{w}{x}.{y}.{end}", f"{x}.{y}.{end}")[k % 4]
                rows.append((f"https://{host}/{w if k % 4 == 3 else x}/{n // 1000 % 1000}", label))
    for k in range(len(UNWANTED) * each):
        n = zlib.crc32(f"name {k}".encode())
        name = "".join("bcdfghjklmnprstvwz"[(n >> 5 * i) % 18] + "aeiou"[(n >> 3 * i) % 5] for i in range(2 + n % 4))
        rows.append((f"https://{('', 'www.', 'm.', 'blog.')[n // 7 % 4]}{name}.{_ENDS[n // 256 % 6]}/{_PLAIN[n // 77 % 16]}/{n % 999}", 0))
    return rows


def parts(url):
    """Host (A-Z lower-cased) and path of a url column, both empty without `://`."""
    after = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host, path, rules: Iterable[tuple[str, str]]):
    """(rule, verdict) columns of the longest fitting rule, null if none fits."""
    order = sorted(rules, key=lambda r: -len(r[1]))

    def fits(rule):
        h, slash, p = rule.partition("/")
        return ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)

    pick = lambda i: reduce(lambda c, r: c.when(fits(r[1]), r[i]), order[1:], F.when(fits(order[0][1]), order[0][i]))
    return (pick(1), pick(0)) if order else (F.lit(None).cast("string"), F.lit(None).cast("string"))


_WORD = re.compile(r"[^\W\d_]+")


def _words(text: str) -> str:
    return "".join(f"^{w}$" for w in _WORD.findall(text.lower()))


def buckets(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the words of hosts and paths, and the row of each; the two are told apart by a seed."""
    out, rows = [], []
    for seed, texts in ((1, list(map(_words, hosts))), (2, list(map(_words, paths)))):
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        c = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(len(texts)), np.diff(off))
        for n in ORDERS:
            if len(c) >= n:
                h = np.full(len(c) - n + 1, seed * 31 + n, np.uint64)
                for j in range(n):
                    h = h * np.uint64(1_000_003) + c[j : len(c) - n + 1 + j]
                own = row[: len(h)] == row[n - 1 :]
                out.append((S.mix(h) >> np.uint64(64 - BITS))[own].astype(np.int64))
                rows.append(row[: len(h)][own])
    return (np.concatenate(out), np.concatenate(rows)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def train(labelled: list[tuple[str, str, int]], l2: float = 1e-3, steps: int = 400, rate: float = 50.0) -> tuple[np.ndarray, float]:
    """Weights and intercept of logistic regression over (host, path, label), by full-batch gradient descent."""
    n = len(labelled)
    at, row = buckets([h for h, _, _ in labelled], [p for _, p, _ in labelled])
    seen, at = np.unique(at, return_inverse=True)
    y = np.array([v for *_, v in labelled], np.float64)
    w, b = np.zeros(len(seen)), 0.0
    for _ in range(steps if n else 0):
        z = UNIT * np.bincount(row, w[at], n) + b
        g = (1 / (1 + np.exp(-z)) - y) / n
        w -= rate * UNIT * np.bincount(at, g[row], len(seen)) + l2 * w
        b -= g.sum()
    out = np.zeros(1 << BITS, np.float32)
    out[seen] = w
    return out, b


def probabilities(hosts: list[str], paths: list[str], w: np.ndarray, b: float) -> np.ndarray:
    """The probability that each URL is unwanted; 0 without a host."""
    n = len(hosts)
    at, row = buckets(hosts, paths)
    z = UNIT * np.bincount(row, w[at], n) + b
    return np.where([bool(h) for h in hosts], 1 / (1 + np.exp(-np.clip(z, -60, 60))), 0.0)


def _scored(w, b):
    def score(batches):
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            off = np.concatenate(([0], np.cumsum([len(h) + len(p) for h, p in zip(hosts, paths)])))
            p = [probabilities(hosts[x:y], paths[x:y], w, b) for x, y in S.chunks(off)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *p]))], [*batch.schema.names, "p_block"])

    return score


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: Iterable[tuple[str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of `pages` (page_id, url): page_id, host, path, rule, verdict, p_block. `labelled`: (url, label 1 for unwanted)."""
    spark = pages.sparkSession
    labelled = labelled if labelled is not None else spark.createDataFrame(labelled_urls(), "url string, label int")
    h, p = parts(F.col("url"))
    rows = labelled.filter("url is not null and label is not null").select(h.alias("h"), p.alias("p"), F.col("label").cast("int").alias("y")).orderBy("h", "p", "y").limit(MOST_LABELLED).collect()
    w, b = train([(r.h, r.p, r.y) for r in rows])
    cut = pages.select(F.col("page_id").cast("long"), F.coalesce(h, F.lit("")).alias("host"), F.coalesce(p, F.lit("")).alias("path"))
    scored = cut.mapInArrow(_scored(w, b), "page_id long, host string, path string, p_block double")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "p_block")


def op3_url_filter(spark, sf_dir) -> DataFrame:
    return filter_urls(S.read(spark, sf_dir, "pages"))


QUERIES = {"op3_url_filter": op3_url_filter}
ORACLES: dict = {}
