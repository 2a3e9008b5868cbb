"""Records of several lines against loops over the lines, with blocks and splits that cut records."""

import random
import re

import pytest

from emberlog.sources import boundaries as R
from emberlog.sources import lines as L

POOL = {
    "entries": ["2025-03-03 07:08:09 up", "[2025-03-03] x", "Mar  3 07:08:09 db up", "error: bad", "Warning - odd", "198.18.0.1 - - [x", '{ "ts": 1}', "1740985689.1 a", "2025-03-03 07:08,7,Information", "", "  ", "\tat a.b", "Caused by: x", "free text", "    indented", "1740985689", "INFO done"],
    "mysql_slow": ["# Time: 1", "# User@Host: a", "  # Query_time: 2", "select 1", "# other", "", "set x"],
    "oracle_alert": ["Mon Mar 03 07:08:09 2025", " Mon Mar 3 07:08:09 2025 ", "text", "", "Mon Mar 03 07:08:09 2025 more"],
    "oracle_audit": ["a", "", " b "],
}


def _new(line):
    forms = [r"\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}", r"\d{10,13}(\.\d+)?\s", r"[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}", r"\[\d{4}[-/]\d{2}[-/]\d{2}", r"\d+\.\d+\.\d+\.\d+\s+\S+\s+\S+\s+\[", r'\{\s*"(timestamp|time|ts|date)"\s*:']
    if any(re.match(f, line) for f in forms):
        return True
    return bool(re.match(r"(debug|info|warn|warning|error|fatal|critical|trace)\s*[\[:\-]", line.lower()) or re.match(r"\d{4}[-\d\s:]+,(\d+,)?(information|warning|error|success|failure|audit|info)", line.lower()))


def _loop(kind, lines):
    """Records by a loop that keeps the open one; for entries it looks ahead, as a reader by hand would."""
    out, now = [], None
    for i, line in enumerate(lines):
        text = line.strip()
        if kind == "entries":
            if not text:
                now = None
            elif _new(line) or now is None:
                now = [line]
                out.append(now)
            else:
                now.append(line)
                continued = re.match(r"\s+(at|File|line|in)\s+|[\t ]{2,}|[\t ]+\"|(?i:caused by|exception|traceback)", line)
                if not continued and i + 1 < len(lines) and _new(lines[i + 1]):
                    now = None
        elif text and kind == "oracle_audit":
            out.append([text])
        elif text and kind == "oracle_alert":
            if re.fullmatch(r"[A-Za-z]{3}\s+[A-Za-z]{3}\s+\d+\s+\d{2}:\d{2}:\d{2}\s+\d{4}", text):
                now = []
                out.append(now)
            if now is not None:
                now.append(text)
        elif text:
            if text.startswith("# Time:"):
                now = [text]
                out.append(now)
            elif text.startswith("#") and not text.startswith(("# User@Host:", "# Query_time:")):
                now = False
            elif now is None:
                now = [text]
                out.append(now)
            elif now is not False:
                now.append(text)
    return ["\n".join(x) for x in out]


@pytest.mark.parametrize("kind", list(POOL))
@pytest.mark.parametrize("block", [1, 7, 1000])
def test_records_equal_a_loop(spark, kind, block):
    rng = random.Random(f"{kind}{block}")
    files = {f"f{i}": [rng.choice(POOL[kind]) for _ in range(n)] for i, n in enumerate((60, 23, 1))}
    rows = [(s, i, x) for s, lines in files.items() for i, x in enumerate(lines)]
    rng.shuffle(rows)
    lines = spark.createDataFrame(rows, "source string, line_no long, line string").repartition(3)
    got = {}
    for r in R.records(lines, R.RULES[kind], block).orderBy("source", "record").collect():
        got.setdefault(r.source, []).append(r.line)
    assert got == {s: x for s, lines in files.items() if (x := _loop(kind, lines))}


def test_records_of_a_file_in_many_splits(spark, tmp_path):
    rng = random.Random(3)
    lines = [rng.choice(POOL["entries"]) for _ in range(3000)]
    (tmp_path / "a.log").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        read = L.read_lines(spark, str(tmp_path), blank=True)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = [r.line for r in R.records(read, R.ENTRIES, 100).orderBy("record").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == _loop("entries", lines)


def test_records_opened_by_a_pattern(spark):
    rows = [(0, "intro"), (1, "# a"), (2, "one"), (3, "# b"), (9, "two")]
    lines = spark.createDataFrame([("s", *r) for r in rows], "source string, line_no long, line string")
    assert [(r.record, r.line_no, r.line) for r in R.records(lines, "^#").orderBy("record").collect()] == [(0, 0, "intro"), (1, 1, "# a\none"), (2, 3, "# b\ntwo")]
    assert R.records(lines.limit(0), R.ENTRIES).collect() == []
