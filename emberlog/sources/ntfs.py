"""Binary NTFS artefacts: master file table records and change journal records.

The file table is read as fixed-length records, so that one large file is scanned by many tasks. The change journal has
records of varying length that do not cross its pages; it is read in ranges of pages, each from its first page's start.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.sources.ranges import byte_ranges

# Fixed values of the on-disk format
RECORD_BYTES, PAGE_BYTES = 1024, 4096
STANDARD, FILE_NAME, END = 0x10, 0x30, 0xFFFFFFFF
REASONS = {0x1: "DATA_OVERWRITE", 0x2: "DATA_EXTEND", 0x4: "DATA_TRUNCATION", 0x100: "FILE_CREATE", 0x200: "FILE_DELETE", 0x1000: "RENAME_OLD_NAME", 0x2000: "RENAME_NEW_NAME", 0x8000: "BASIC_INFO_CHANGE", 0x80000000: "CLOSE"}
_MFT = "record long, sequence int, in_use boolean, is_directory boolean, si_created long, si_modified long, si_changed long, si_accessed long, fn_created long, fn_modified long, parent long, name string"
_USN = "record long, parent long, usn long, ticks long, reason long, name string"


def _fixed(raw: bytes) -> bytes:
    """The record with the last two bytes of each sector put back from its update array."""
    at, n = struct.unpack_from("<HH", raw, 4)
    out = bytearray(raw)
    for i in range(1, n):
        end = i * 512
        if end <= len(out) and at + 2 * i + 2 <= len(raw):
            out[end - 2 : end] = raw[at + 2 * i : at + 2 * i + 2]
    return bytes(out)


def mft_record(raw: bytes) -> tuple | None:
    """One file record: identity, flags, standard and first file-name times (ticks), parent and name; None if it is none."""
    if len(raw) < 48 or raw[:4] != b"FILE":
        return None
    raw = _fixed(raw)
    sequence, _, first, flags = struct.unpack_from("<HHHH", raw, 16)
    number = struct.unpack_from("<I", raw, 44)[0]
    si, fn, parent, name = (None,) * 4, (None,) * 2, None, None
    at = first
    while at + 24 <= len(raw):
        kind, size = struct.unpack_from("<II", raw, at)
        if kind == END or size < 24 or at + size > len(raw):
            break
        if raw[at + 8] == 0:  # resident
            body = at + struct.unpack_from("<H", raw, at + 20)[0]
            if kind == STANDARD and body + 32 <= len(raw):
                created, modified, changed, accessed = struct.unpack_from("<4Q", raw, body)
                si = (created, modified, changed, accessed)
            elif kind == FILE_NAME and name is None and body + 66 <= len(raw):
                parent = struct.unpack_from("<Q", raw, body)[0] & 0xFFFFFFFFFFFF
                fn = struct.unpack_from("<2Q", raw, body + 8)
                name = raw[body + 66 : body + 66 + 2 * raw[body + 64]].decode("utf-16-le", "replace")
        at += size
    return (number, sequence, bool(flags & 1), bool(flags & 2), *si, *fn, parent, name)


def _mft_rows(batches):
    for batch in batches:
        found = [r for r in map(mft_record, batch.column("raw").to_pylist()) if r]
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), *[pa.int64()] * 7, pa.string()]
        cols = list(zip(*found)) if found else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [f.split()[0] for f in _MFT.split(", ")])


def read_mft(spark: SparkSession, path: str) -> DataFrame:
    """File records of extracted file tables, times in microseconds since 1970 (null if unset)."""
    from emberlog.operators.forensic import ntfs_time

    raw = spark.createDataFrame(spark.sparkContext.binaryRecords(path, RECORD_BYTES).map(lambda r: (bytearray(r),)), "raw binary")
    rows = raw.mapInArrow(_mft_rows, _MFT)
    return rows.select(*(ntfs_time(F.col(c)).alias(c) if c.startswith(("si_", "fn_")) else F.col(c) for c in rows.columns))


def usn_records(raw: bytes, end: int | None = None):
    """Version 2 records of a change journal that start before `end`; gaps are skipped eight bytes at a time."""
    at, end = 0, len(raw) if end is None else end
    while at < end and at + 60 <= len(raw):
        size, major, minor = struct.unpack_from("<IHH", raw, at)
        length, start = struct.unpack_from("<HH", raw, at + 56)
        if size < 60 or size > 4096 or size % 8 or (major, minor) != (2, 0) or at + size > len(raw) or start < 60 or start + length > size:
            at += 8
            continue
        ref, parent, usn, ticks, reason = struct.unpack_from("<QQQQI", raw, at + 8)
        name = raw[at + start : at + start + length].decode("utf-16-le", "replace")
        yield ref & 0xFFFFFFFFFFFF, parent & 0xFFFFFFFFFFFF, usn, ticks, reason, name
        at += size


def _usn_rows(batches):
    kinds = [*[pa.int64()] * 5, pa.string()]
    for batch in batches:
        for raw, size in zip(batch.column("content"), batch.column("size").to_pylist()):
            found = list(usn_records(raw.as_py() or b"", size))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], [f.split()[0] for f in _USN.split(", ")])


def read_usn(spark: SparkSession, path: str, step: int = 1 << 20) -> DataFrame:
    """Change journal records, time in microseconds and reasons by name; `step` is a number of whole pages."""
    from emberlog.operators.forensic import ntfs_time

    rows = byte_ranges(spark, path, step=step, extra=PAGE_BYTES).select("size", "content").mapInArrow(_usn_rows, _USN)
    names = F.array_compact(F.array(*(F.when(F.col("reason").bitwiseAND(F.lit(bit)) != 0, n) for bit, n in REASONS.items())))
    return rows.withColumn("us", ntfs_time(F.col("ticks"))).withColumn("reasons", names)
