"""NTFS transaction logs, volume information and boot sectors.

A log is read in ranges: a record belongs to the range in which its mark stands, whatever its length. Each range is read
from LONGEST bytes ahead, where the scan falls in step with the records, so that marks inside a record which began in an
earlier range are passed over as they are when the file is read whole.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.sources.ranges import byte_ranges

# Fixed values of the on-disk format
RECORD_MARK, RESTART_MARKS = b"LOG ", (b"RSTR", b"LOOP")
HEADER_BYTES, RESTART_BYTES, LONGEST = 64, 128, 1_000_000
NO_FILE = 0xFFFFFFFFFFFFFFFF
# Operations by number from 0
OPERATIONS = (
    "Noop", "CompensationLogRecord", "InitializeFileRecordSegment", "DeallocateFileRecordSegment", "WriteEndOfFileRecordSegment", "WriteFileRecordSegment", "DeleteFileRecordSegment",
    "CreateAttribute", "DeleteAttribute", "UpdateResidentValue", "UpdateNonResidentValue", "UpdateMappingPairs", "DeleteDirtyClusters", "SetNewAttributeSizes", "AddIndexEntryRoot",
    "DeleteIndexEntryRoot", "AddIndexEntryAllocation", "DeleteIndexEntryAllocation", "WriteEndOfIndexAllocation", "SetIndexEntryV", "UpdateFileNameRoot", "UpdateFileNameAllocation",
    "SetBitmap", "SetBitmapV", "HotFix", "EndTopLevelAction", "Rollback", "CommitTransaction", "ForgetTransaction", "OpenNonresidentAttribute", "OpenAttributeTableDump", "CheckDirtyTable",
    "QueryDirtyTable", "InvalidatePages", "ChangeAttributeSize", "WriteLogRecord", "UpdateRecord",
)
#: Kinds of operations by number: of file information, of metadata, renames and changes of values.
KINDS = {"file_information": (0x05, 0x06, 0x14, 0x15, 0x03, 0x04), "metadata": (0x05, 0x06, 0x07, 0x08, 0x09, 0x0A), "rename": (0x06,), "value": (0x09, 0x0A)}
_LOG = "source string, offset long, lsn long, transaction long, client long, record_type int, segment_length long, previous_lsn long, undo_next_lsn long, redo_length long, undo_length long, target long, ticks long, code int"
_RESTART = "source string, offset long, mark string, page_size long, restart_size long, minor_version int, major_version int, current_lsn long, clients long, flags long, sector_size long, first_lsn long, last_lsn long, restart_lsn long, log_bytes long"
_BOOT = "source string, bytes_per_sector int, sectors_per_cluster int, reserved_sectors int, media int, hidden_sectors long, total_sectors long, mft_cluster long, mirror_cluster long, serial string, checksum long"
_VOLUME = "source string, flags long, version int, minor_version int, created_ticks long, modified_ticks long"


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def log_records(raw: bytes, first: int = 0, end: int | None = None, offset: int = 0):
    """The records of a log whose mark stands at `first` or later and before `end`; `offset` is the place of the first byte."""
    at, end = 0, len(raw) if end is None else end
    while 0 <= (at := raw.find(RECORD_MARK, at)) < end:
        if at + HEADER_BYTES > len(raw):
            return
        (size,) = struct.unpack_from("<I", raw, at + 4)
        if not HEADER_BYTES <= size <= LONGEST:
            at += len(RECORD_MARK)
            continue
        if at >= first:
            lsn, transaction, client, kind, _, segment, previous, undo_next, redo, undo, target = struct.unpack_from("<QIIHHIQQIIQ", raw, at + 8)
            ticks = struct.unpack_from("<Q", raw, at + 64)[0] if at + 72 <= len(raw) else 0
            code = struct.unpack_from("<H", raw, at + 76)[0] if segment > HEADER_BYTES and at + 80 <= len(raw) else 0
            yield offset + at, _signed(lsn), transaction, client, kind, segment, _signed(previous), _signed(undo_next), redo, undo, None if target == NO_FILE else _signed(target), _signed(ticks), code
        at += size


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    names, types = zip(*(f.split() for f in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], list(names))


def _decoded(decode, schema: str):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows = [(r["source"], *x) for x in decode(r["content"] or b"", r["start"], r["ahead"], r["size"])]
                if rows:
                    yield _columns(rows, schema)

    return run


def read_log(spark: SparkSession, path: str, step: int = 16 << 20) -> DataFrame:
    """Records of transaction logs with their operation, the file's 48-bit reference and their time in microseconds."""
    from emberlog.operators.forensic import ntfs_time

    decode = lambda raw, start, ahead, size: log_records(raw, ahead, ahead + size, start - ahead)
    rows = byte_ranges(spark, path, step=step, before=LONGEST, extra=LONGEST).mapInArrow(_decoded(decode, _LOG), _LOG)
    code = F.col("code")
    names = F.coalesce(F.get(F.array(*map(F.lit, OPERATIONS)), code), F.format_string("Unknown(0x%02X)", code))
    file = F.col("target").bitwiseAND(0xFFFFFFFFFFFF)
    return rows.withColumn("operation", F.when(F.col("segment_length") > HEADER_BYTES, names).otherwise("Unknown")).withColumn("reference", F.when(F.col("target") != 0, file)).withColumn("us", ntfs_time(F.col("ticks"))).drop("ticks")


def _restart(raw: bytes, start: int, ahead: int, size: int):
    if len(raw) >= RESTART_BYTES and raw[:4] in RESTART_MARKS:
        page, restart, minor, major = struct.unpack_from("<IIHH", raw, 8)
        current, clients = struct.unpack_from("<QI", raw, 32)
        (flags,) = struct.unpack_from("<I", raw, 52)
        (sector,) = struct.unpack_from("<I", raw, 64)
        first, last, lsn, total, _ = map(_signed, struct.unpack_from("<5Q", raw, 72))
        yield start, raw[:4].decode(), page, restart, minor, major, _signed(current), clients, flags, sector, first, last, lsn, total


def read_restart_areas(spark: SparkSession, path: str) -> DataFrame:
    """The restart areas at the start of each log, one on each of its first two pages."""
    return byte_ranges(spark, path, step=4096, most=2).mapInArrow(_decoded(_restart, _RESTART), _RESTART)


def _boot(raw: bytes, start: int, ahead: int, size: int):
    if len(raw) >= 92 and raw[3:11] == b"NTFS    ":
        sector, cluster, reserved = struct.unpack_from("<HBH", raw, 11)
        (hidden,) = struct.unpack_from("<I", raw, 28)
        total, mft, mirror = map(_signed, struct.unpack_from("<3Q", raw, 40))
        serial = "%02X%02X-%02X%02X" % (raw[83], raw[82], raw[81], raw[80])
        yield sector, cluster, reserved, raw[21], hidden, total, mft, mirror, serial, struct.unpack_from("<I", raw, 88)[0]


def read_boot_sectors(spark: SparkSession, path: str) -> DataFrame:
    """The boot sector of each image, with its size in clusters; a checksum of 0 is invalid."""
    rows = byte_ranges(spark, path, step=512, most=1).mapInArrow(_decoded(_boot, _BOOT), _BOOT)
    per = F.col("sectors_per_cluster")
    return rows.withColumn("clusters", F.when(per > 0, F.call_function("div", F.col("total_sectors"), per)).otherwise(0)).withColumn("valid", F.col("checksum") != 0)


def _volume(raw: bytes, start: int, ahead: int, size: int):
    if len(raw) >= 100:
        flags, version, minor = struct.unpack_from("<IHH", raw, 0)
        yield flags, version, minor, *map(_signed, struct.unpack_from("<2Q", raw, 8))


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """Volume information: flags, version and the times of creation and of the last change in microseconds."""
    from emberlog.operators.forensic import ntfs_time

    rows = byte_ranges(spark, path, step=4096, most=1).mapInArrow(_decoded(_volume, _VOLUME), _VOLUME)
    return rows.select("source", "flags", "version", "minor_version", ntfs_time(F.col("created_ticks")).alias("created_us"), ntfs_time(F.col("modified_ticks")).alias("modified_us"))


def of_kind(log: DataFrame, kind: str) -> DataFrame:
    """The operations of one of KINDS."""
    return log.filter(F.col("code").isin(*KINDS[kind]))


def redo_chains(log: DataFrame) -> DataFrame:
    """Transactions as chains of records, each of which names the one before it: (source, transaction, records, first_lsn,
    last_lsn, broken, committed). `broken` counts records whose predecessor is not in the log.
    """
    known = log.select("source", F.col("lsn").alias("previous_lsn"), F.lit(1).alias("_known")).distinct()
    linked = log.join(known, ["source", "previous_lsn"], "left")
    lost = (F.col("previous_lsn") != 0) & F.col("_known").isNull()
    commits = F.max(F.col("code") == OPERATIONS.index("CommitTransaction"))
    return linked.groupBy("source", "transaction").agg(F.count("*").alias("records"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.sum(lost.cast("long")).alias("broken"), commits.alias("committed"))


def log_gaps(log: DataFrame, least: int = 1_000_000, k: int = 10) -> DataFrame:
    """The first k gaps of over `least` between neighbouring sequence numbers of a log.

    Neighbours are found in blocks of the numbers, to each of which the last number before it is carried.
    """
    lsn = log.filter("lsn > 0").select("source", "lsn", F.expr(f"lsn div {least}").alias("block"))
    ends = lsn.groupBy("source", "block").agg(F.max("lsn").alias("top"))
    order = Window.partitionBy("source").orderBy("block")
    first = lsn.groupBy("source", "block").agg(F.min("lsn").alias("to_lsn"))
    # within a block no gap is that wide, so only the ends of neighbouring blocks matter
    both = first.join(ends, ["source", "block"]).withColumn("from_lsn", F.lag("top").over(order))
    gap = (F.col("to_lsn") - F.col("from_lsn")).alias("gap")
    return both.select("source", "from_lsn", "to_lsn", gap).filter(F.col("gap") > least).orderBy("source", "from_lsn").limit(k)
