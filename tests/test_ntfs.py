"""NTFS records written by hand are read back."""

import random
import struct

from pyspark.sql import functions as F

from emberlog.operators import forensic, rules
from emberlog.sources import ntfs as N
from emberlog.sources import ntfs_logs as L

TICKS = 133_000_000_000_000_000  # 2022


def mft(number, name, created):
    si = struct.pack("<4Q", created, created + 10, created, created) + bytes(16)
    fn = struct.pack("<Q", 5) + struct.pack("<4Q", created + 20, created, created, created) + bytes(24) + bytes([len(name), 1]) + name.encode("utf-16-le")

    def attribute(kind, body):
        size = (24 + len(body) + 7) // 8 * 8
        return struct.pack("<IIBBHHHIHH", kind, size, 0, 0, 0, 0, 0, len(body), 24, 0) + body + bytes(size - 24 - len(body))

    body = attribute(0x10, si) + attribute(0x30, fn) + struct.pack("<I", 0xFFFFFFFF)
    head = b"FILE" + struct.pack("<HHQHHHHIIQHHI", 48, 3, 0, 7, 1, 56, 1, 0, 1024, 0, 0, 0, number)
    raw = bytearray((head + bytes(56 - len(head)) + body).ljust(1024, b"\0"))
    for i in (1, 2):
        raw[48 + 2 * i : 50 + 2 * i] = raw[i * 512 - 2 : i * 512]
        raw[i * 512 - 2 : i * 512] = b"\x01\x00"
    raw[48:50] = b"\x01\x00"
    return bytes(raw)


def test_mft(spark, tmp_path):
    (tmp_path / "MFT").write_bytes(mft(40, "a.txt", TICKS) + bytes(1024) + mft(41, "naïve.exe", 0))
    rows = {r.record: r for r in N.read_mft(spark, str(tmp_path / "MFT")).collect()}
    assert set(rows) == {40, 41}
    us = TICKS // 10 - 11_644_473_600_000_000
    assert (rows[40].name, rows[40].parent, rows[40].sequence, rows[40].in_use, rows[40].is_directory) == ("a.txt", 5, 7, True, False)
    assert (rows[40].si_created, rows[40].si_modified, rows[40].fn_created) == (us, us + 1, us + 2)
    assert rows[41].name == "naïve.exe" and rows[41].si_created is None


def usn(ref, reason, name):
    text = name.encode("utf-16-le")
    size = (60 + len(text) + 7) // 8 * 8
    return (struct.pack("<IHHQQQQIIIIHH", size, 2, 0, ref, 5, 1, TICKS, reason, 0, 0, 0, len(text), 60) + text).ljust(size, b"\0")


def test_usn(spark, tmp_path):
    (tmp_path / "J").write_bytes(bytes(64) + usn(40, 0x100, "a.txt") + bytes(16) + usn((3 << 48) | 41, 0x3000, "b"))
    rows = {r.record: r for r in N.read_usn(spark, str(tmp_path / "J")).collect()}
    assert rows[40].reasons == ["FILE_CREATE"] and rows[41].reasons == ["RENAME_OLD_NAME", "RENAME_NEW_NAME"] and rows[41].name == "b"


def test_usn_by_ranges_equals_one_read(spark, tmp_path):
    """Records fill pages without crossing them; ranges of one page and of all give the same."""
    rng = random.Random(8)
    raw = bytearray()
    for i in range(400):
        r = usn(i, rng.choice([0x100, 0x2, 0x3000]), "n" * rng.randrange(1, 60))
        if len(raw) % 4096 + len(r) > 4096:
            raw = raw.ljust((len(raw) // 4096 + 1) * 4096, b"\0")
        raw += r
    (tmp_path / "J").write_bytes(bytes(8192) + raw)
    key = lambda r: r.record
    whole = sorted(N.read_usn(spark, str(tmp_path / "J")).collect(), key=key)
    assert [r.record for r in whole] == list(range(400))
    assert sorted(N.read_usn(spark, str(tmp_path / "J"), 4096).collect(), key=key) == whole


def log(lsn, transaction, previous, target, ticks, code, size=96):
    head = L.RECORD_MARK + struct.pack("<IQIIHHIQQIIQ", size, lsn, transaction, 7, 1, 0, 80, previous, 0, 0, 0, target)
    return (head + struct.pack("<QIHH", ticks, 0, code, 0)).ljust(size, b"\0")


def test_log_records_in_ranges(spark, tmp_path):
    rng = random.Random(4)
    restart = bytearray(4096)
    restart[:4] = b"RSTR"
    struct.pack_into("<IIHH", restart, 8, 4096, 128, 1, 2)
    struct.pack_into("<Q", restart, 32, 900)
    struct.pack_into("<5Q", restart, 72, 100, 900, 800, 1 << 20, 5)
    raw, want, previous = bytearray(restart), [], {}
    for i in range(200):
        lsn, t = 100 + 4 * i + (5_000_000 if i >= 150 else 0), rng.randrange(5)
        body = log(lsn, t, previous.get(t, 0), (3 << 48) | (40 + i % 3), TICKS + i, rng.choice([0x05, 0x06, 0x09, 0x1B, 0x40]), rng.choice([80, 96, 4000]))
        if i == 100:  # a record that holds the image of another
            body = (body[:80] + log(1, 99, 0, 1, 1, 1)).ljust(300, b"\0")
            body = body[:4] + struct.pack("<I", 300) + body[8:]
        want.append((len(raw), lsn, t, struct.unpack_from("<H", body, 76)[0]))
        previous[t] = lsn
        raw += body
        if i % 17 == 0:
            raw = raw.ljust((len(raw) // 4096 + 1) * 4096, b"\0")
    (tmp_path / "log").write_bytes(raw)
    for step in (1 << 24, 4096, 1000):
        got = L.read_log(spark, str(tmp_path / "log"), step)
        assert sorted((r.offset, r.lsn, r.transaction, r.code) for r in got.collect()) == want
    rows = {r.lsn: r for r in got.collect()}
    assert rows[100].reference == 40 and rows[100].us == TICKS // 10 - 11_644_473_600_000_000
    assert {r.operation for r in rows.values()} == {"WriteFileRecordSegment", "DeleteFileRecordSegment", "UpdateResidentValue", "CommitTransaction", "Unknown(0x40)"}
    assert L.of_kind(got, "rename").count() == sum(c == 0x06 for *_, c in want)
    (gap,) = L.log_gaps(got).collect()
    assert (gap.from_lsn, gap.to_lsn) == (100 + 4 * 149, 100 + 4 * 150 + 5_000_000)
    chains = {r.transaction: r for r in L.redo_chains(got).collect()}
    assert sum(r.records for r in chains.values()) == 200 and all(r.broken == 0 for r in chains.values())
    cut = {r.transaction: r.broken for r in L.redo_chains(got.filter("lsn <> 100")).collect()}
    assert sum(cut.values()) == 1
    (area,) = L.read_restart_areas(spark, str(tmp_path / "log")).collect()
    assert (area.mark, area.page_size, area.current_lsn, area.first_lsn, area.last_lsn, area.log_bytes) == ("RSTR", 4096, 900, 100, 900, 1 << 20)


def test_rules_run_from_read_files(spark, tmp_path):
    day = 864_000_000_000  # ticks
    (tmp_path / "MFT").write_bytes(mft(40, "a.txt", TICKS) + mft(41, "b.txt", TICKS - 400 * day))
    (tmp_path / "log").write_bytes(bytes(4096) + log(1, 1, 0, (2 << 48) | 40, TICKS + 3 * day, 5) + log(2, 1, 1, 41, TICKS - 400 * day, 5))
    boot = bytearray(512)
    boot[3:11] = b"NTFS    "
    struct.pack_into("<HBH", boot, 11, 512, 8, 0)
    struct.pack_into("<3Q", boot, 40, 80_001, 4, 5)
    boot[80:84], boot[88] = b"\x01\x02\x03\x04", 9
    (tmp_path / "boot").write_bytes(boot + b"rest of the volume")
    (tmp_path / "volume").write_bytes(struct.pack("<IHHQQ", 1, 3, 1, TICKS - 100 * day, TICKS).ljust(128, b"\0"))
    (b,) = L.read_boot_sectors(spark, str(tmp_path / "boot")).collect()
    assert (b.bytes_per_sector, b.sectors_per_cluster, b.clusters, b.mft_cluster, b.serial, b.valid) == (512, 8, 10_000, 4, "0403-0201", True)
    assert L.read_boot_sectors(spark, str(tmp_path / "log")).collect() == []
    files = N.read_mft(spark, str(tmp_path / "MFT")).withColumnsRenamed({"si_created": "created_us", "si_modified": "modified_us"})
    assert [(r.record, r.severity) for r in forensic.log_operations(files, L.read_log(spark, str(tmp_path / "log"))).collect()] == [(40, "HIGH")]
    volumes = L.read_volumes(spark, str(tmp_path / "volume"))
    assert [r.record for r in rules.before_volume(files, volumes).collect()] == [41]
    install = volumes.select(F.col("created_us").alias("us"))
    assert {r.record for r in rules.before_install(files.withColumn("fn_created_us", F.col("fn_created")).withColumn("dir", F.lit("/x")), install).collect()} == {41}
