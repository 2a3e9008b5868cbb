"""Event-log sources: records of binary event logs by chunks, the XML form of events, and events as JSON."""

from __future__ import annotations

import re
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.sources.binxml import Chunk
from emberlog.sources.ranges import byte_ranges

# Fixed values of the on-disk format
FILE_MAGIC, CHUNK_MAGIC = b"ElfFile\0", b"ElfChnk\0"
HEADER_BYTES, CHUNK_BYTES, FIRST_RECORD = 4096, 65536, 512
RECORD_MAGIC = 0x00002A2A
# Event ids of security channels to actions, and ids that tell of a failure
ACTIONS = {
    4624: "logon_success", 4625: "logon_failure", 4634: "logoff", 4648: "explicit_logon", 4672: "admin_logon", 4688: "process_create",
    4689: "process_exit", 4696: "token_duplicate", 4720: "user_created", 4722: "user_enabled", 4723: "password_change", 4724: "password_reset",
    4725: "user_disabled", 4726: "user_deleted", 4738: "user_changed", 4740: "account_locked", 4767: "account_unlocked", 4768: "tgt_request",
    4769: "tgs_request", 4771: "preauth_failure", 4776: "cred_validate",
}
FAILURES = (4625, 4648, 4767, 4771, 4776)
# Names of levels, and the severities of levels by number or name
LEVELS = {"0": "LogAlways", "1": "Critical", "2": "Error", "3": "Warning", "4": "Information", "5": "Verbose"}
SEVERITIES = {"1": "critical", "critical": "critical", "2": "error", "error": "error", "3": "warning", "warning": "warning"}
_RECORDS = "source string, record long, ticks long, body binary, xml string, strings array<string>"
_TEXT = re.compile(r"[\x20-\x7E]{4,}")


def records(chunk: bytes):
    """(record number, ticks, body, XML or None) of every record of a chunk; a damaged record has no XML."""
    if chunk[:8] != CHUNK_MAGIC:
        return
    names = Chunk(chunk)
    at = FIRST_RECORD
    while at + 24 <= len(chunk):
        magic, size, number, ticks = struct.unpack_from("<IIQQ", chunk, at)
        if magic != RECORD_MAGIC or size < 28 or at + size > len(chunk):
            break
        try:
            xml = names.text(at + 24, at + size - 4) or None
        except (struct.error, IndexError, ValueError, OverflowError):
            xml = None
        yield number, ticks, chunk[at + 24 : at + size - 4], xml
        at += size


def _rows(batches):
    for batch in batches:
        for path, raw in zip(batch.column("source").to_pylist(), batch.column("content")):
            found = list(records(raw.as_py() or b""))
            if found:
                n, t, b, x = zip(*found)
                whole = lambda v: pa.array(v, pa.uint64()).cast(pa.int64(), safe=False)
                strings = [_TEXT.findall(body.decode("utf-16-le", "replace")) for body in b]
                columns = [pa.array([path] * len(n)), whole(n), whole(t), pa.array(b, pa.binary()), pa.array(x, pa.string()), pa.array(strings, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["source", "record", "ticks", "body", "xml", "strings"])


def read_event_logs(spark: SparkSession, path: str) -> DataFrame:
    """(source, record, us, body, xml, strings) of event-log files, a chunk at a time; strings are runs of UTF-16 text in the
    body, for records whose tokens can't be read.
    """
    from emberlog.operators.forensic import ntfs_time

    raw = byte_ranges(spark, path, first=HEADER_BYTES, step=CHUNK_BYTES).select("source", "content").mapInArrow(_rows, _RECORDS)
    return raw.select("source", "record", ntfs_time(F.col("ticks")).alias("us"), "body", "xml", "strings")


def _plain(text: Column) -> Column:
    """Text without the five named references and numbered ones of one character."""
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("#x27", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(sign))
    return text


def _one(xml: Column, pattern: str) -> Column:
    return F.nullif(_plain(F.regexp_extract(xml, pattern, 1)), F.lit(""))


def data_fields(xml: Column) -> Column:
    """The named data of an event as a map; of a name given twice the first value counts."""
    item = r"""<Data\s+Name=["']([^"']*)["'](?:/>|>([^<]*)</Data>)"""
    names, values = (F.regexp_extract_all(xml, F.lit(item), i) for i in (1, 2))
    first = F.transform(F.array_distinct(names), lambda n: F.struct(_plain(n).alias("k"), _plain(F.get(values, F.array_position(names, n) - 1)).alias("v")))
    return F.map_from_entries(first)


def action(number: Column, channel: Column) -> Column:
    """What an event of a security channel tells of; `event` for others."""
    known = F.element_at(F.create_map(*(F.lit(v) for p in ACTIONS.items() for v in p)), number)
    return F.when(F.lower(channel).contains("security"), F.coalesce(known, F.lit("event"))).otherwise("event")


def events(rows: DataFrame) -> DataFrame:
    """Rows with a column `xml` of one event each, with the event's fields and its named data."""
    x = F.col("xml")
    number, channel = F.regexp_extract(x, r"<EventID[^>]*>(\d+)</EventID>", 1).try_cast("int"), _one(x, r"<Channel>([^<]*)</Channel>")
    level, data = _one(x, r"<Level>([^<]*)</Level>"), data_fields(x)
    ip = F.coalesce(F.nullif(data["IpAddress"], F.lit("")), _one(x, r"(?i)<IpAddress>([^<]+)</IpAddress>"), _one(x, r"<Data[^>]*>([\d.]+)</Data>"))
    severity = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for p in SEVERITIES.items() for v in p)), F.lower(level)), F.lit("info"))
    return rows.withColumns({
        "event_id": number, "event_ts": F.try_to_timestamp(F.regexp_extract(x, r"""SystemTime=['"]([^'"]*)['"]""", 1)), "computer": _one(x, r"<Computer>([^<]*)</Computer>"), "channel": channel,
        "level": level, "severity": severity, "provider": _one(x, r"""<Provider\s+Name=['"]([^'"]*)['"]"""), "message": _one(x, r"<Message>([^<]*)</Message>"),
        "user": F.nullif(data["TargetUserName"], F.lit("")), "ip": ip, "action": action(number, channel), "outcome": F.when(number.isin(*FAILURES), "failure").otherwise("success"), "data": data,
    })


def xml_events(texts: DataFrame) -> DataFrame:
    """Events of (source, text) rows that hold `<Event>..</Event>` elements."""
    return events(texts.select("source", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)(<Event[ >].*?</Event>)"), 1)).alias("item_no", "xml")))


def event_json(found: DataFrame) -> DataFrame:
    """Each event as one line of JSON: its id, time, computer, channel, name of the level, named data and XML."""
    names = F.element_at(F.create_map(*(F.lit(v) for p in LEVELS.items() for v in p)), F.col("level"))
    time = F.nullif(F.regexp_extract("xml", r"""SystemTime=['"]([^'"]*)['"]""", 1), F.lit(""))
    fields = {"EventID": F.col("event_id"), "Timestamp": time, "Computer": F.col("computer"), "Channel": F.col("channel"), "Level": F.coalesce(names, "level", F.lit("Information")), "EventData": F.col("data"), "RawXml": F.col("xml")}
    return found.select("source", F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"}).alias("line"))
