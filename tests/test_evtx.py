"""Event-log chunks and XML events written by hand are read back."""

import json
import struct

from emberlog.sources import binxml as X
from emberlog.sources import evtx as E

TICKS = 133_000_000_000_000_000
XML = "<Event xmlns=\"x\"><System><Provider Name=\"Audit &amp; co\"/><EventID Qualifiers=\"0\">{id}</EventID><Level>2</Level><TimeCreated SystemTime=\"2022-06-18T04:26:40.{us:06d}Z\"/><Channel>Security</Channel><Computer>pc1</Computer></System><EventData><Data Name=\"TargetUserName\">{user}</Data><Data Name=\"IpAddress\">{ip}</Data>{more}</EventData></Event>"


class Writer:
    """Tokens of a chunk, with names and one template that are written where they are first used."""

    def __init__(self):
        self.raw, self.names = bytearray(E.CHUNK_MAGIC.ljust(E.FIRST_RECORD, b"\0")), {}

    def name(self, text, before):
        """The place of a name; `before` bytes are written ahead of it."""
        if text not in self.names:
            self.names[text] = len(self.raw) + before
            return self.names[text], struct.pack("<IHH", 0, 0, len(text)) + text.encode("utf-16-le") + b"\0\0"
        return self.names[text], b""

    def open(self, text, attributes=False):
        place, own = self.name(text, 11)
        self.raw += struct.pack("<BHII", 0x41 if attributes else 1, 0xFFFF, 0, place) + own + (bytes(4) if attributes else b"")

    def attribute(self, text):
        place, own = self.name(text, 5)
        self.raw += struct.pack("<BI", 6, place) + own

    def value(self, text):
        self.raw += struct.pack("<BBH", 5, 1, len(text)) + text.encode("utf-16-le")

    def gap(self, number, kind):
        self.raw += struct.pack("<BHB", 0x0E, number, kind)

    def byte(self, *tokens):
        self.raw += bytes(tokens)

    def template(self):
        self.byte(0x0F, 1, 1, 0)
        self.open("Event", True)
        self.attribute("xmlns")
        self.value("x")
        self.byte(2)
        self.open("System")
        self.byte(2)
        self.open("Provider", True)
        self.attribute("Name")
        self.value("Audit & co")
        self.byte(3)
        self.open("EventID", True)
        self.attribute("Qualifiers")
        self.gap(0, 6)
        self.byte(2)
        self.gap(1, 6)
        self.byte(4)
        self.open("Level")
        self.byte(2)
        self.gap(2, 4)
        self.byte(4)
        self.open("TimeCreated", True)
        self.attribute("SystemTime")
        self.gap(3, 0x11)
        self.byte(3)
        self.open("Channel")
        self.byte(2)
        self.value("Security")
        self.byte(4)
        self.open("Computer")
        self.byte(2)
        self.gap(4, 1)
        self.byte(4, 4)
        self.open("EventData")
        self.byte(2)
        for name, number in (("TargetUserName", 5), ("IpAddress", 6)):
            self.open("Data", True)
            self.attribute("Name")
            self.value(name)
            self.byte(2)
            self.gap(number, 1)
            self.byte(4)
        self.gap(7, 0x21)
        self.byte(4, 4, 0)

    def record(self, number, event, user, ip, inner):
        start = len(self.raw)
        self.raw += struct.pack("<IIQQ", E.RECORD_MAGIC, 0, number, TICKS + 10 * number)
        self.byte(0x0F, 1, 1, 0)
        at = len(self.raw)
        if not hasattr(self, "place"):
            self.place = at + 10
            self.raw += struct.pack("<BBII", 0x0C, 1, 7, self.place) + bytes(24)
            self.template()
            struct.pack_into("<I", self.raw, self.place + 20, len(self.raw) - self.place - 24)
        else:
            self.raw += struct.pack("<BBII", 0x0C, 1, 7, self.place)
        values = [(6, bytes(2)), (6, struct.pack("<H", event)), (4, b"\2"), (0x11, struct.pack("<Q", TICKS + 10 * number)), (1, "pc1".encode("utf-16-le")), (1, user.encode("utf-16-le")), (1, ip.encode("utf-16-le")), (0x21 if inner else 0, b"")]
        self.raw += struct.pack("<I", len(values))
        heads = len(self.raw)
        self.raw += bytes(4 * len(values))
        for i, (kind, v) in enumerate(values):
            begin = len(self.raw)
            if kind == 0x21:  # tokens of their own within a value
                self.byte(0x0F, 1, 1, 0)
                self.open("Data", True)
                self.attribute("Name")
                self.value("Extra")
                self.byte(2)
                self.value(inner)
                self.byte(4, 0)
            self.raw += v
            struct.pack_into("<HB", self.raw, heads + 4 * i, len(self.raw) - begin, kind)
        self.byte(0)
        size = len(self.raw) + 4 - start
        struct.pack_into("<I", self.raw, start + 4, size)
        self.raw += struct.pack("<I", size)

    def chunk(self):
        return bytes(self.raw).ljust(E.CHUNK_BYTES, b"\0")


EVENTS = [(1, 4625, "bob", "198.18.0.9", ""), (2, 4624, "o<l>ga", "::1", "a & b"), (3, 4624, "", "", ""), (4, 9, "ünï", "198.18.0.7", "")]
FIELDS = ("event_id", "event_ts", "computer", "channel", "level", "severity", "provider", "user", "ip", "action", "outcome", "data")


def _xml(number, event, user, ip, inner):
    clean = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return XML.format(id=event, us=number, user=clean(user), ip=ip, more=f'<Data Name="Extra">{clean(inner)}</Data>' if inner else "")


def test_templates_equal_the_xml_form(spark, tmp_path):
    files = []
    for part in (EVENTS[:2], EVENTS[2:]):
        w = Writer()
        for e in part:
            w.record(*e)
        files.append(w.chunk())
    (tmp_path / "s.evtx").write_bytes(E.FILE_MAGIC.ljust(4096, b"\0") + files[0] + bytes(E.CHUNK_BYTES) + files[1])
    (tmp_path / "t.evtx").write_bytes(b"other")
    read = {r.record: r for r in E.events(E.read_event_logs(spark, str(tmp_path))).collect()}
    assert {n: r.xml for n, r in read.items()} == {e[0]: _xml(*e) for e in EVENTS}
    assert all(r.us == (TICKS + 10 * n) // 10 - 11_644_473_600_000_000 for n, r in read.items())
    text = "<Events>" + "".join(_xml(*e) for e in EVENTS) + "</Events>"
    want = {r.item_no + 1: r for r in E.xml_events(spark.createDataFrame([("s", text)], "source string, text string")).collect()}
    for n, r in read.items():
        assert [r[c] for c in FIELDS] == [want[n][c] for c in FIELDS]
    assert (read[1].event_id, read[1].action, read[1].outcome, read[1].user, read[1].provider, read[1].severity) == (4625, "logon_failure", "failure", "bob", "Audit & co", "error")
    assert read[2].data == {"TargetUserName": "o<l>ga", "IpAddress": "::1", "Extra": "a & b"} and read[3].user is None


def test_records_without_tokens_have_their_strings(spark, tmp_path):
    def record(n, text):
        body = text.encode("utf-16-le")
        size = 28 + len(body)
        return struct.pack("<IIQQ", E.RECORD_MAGIC, size, n, TICKS) + body + struct.pack("<I", size)

    chunk = (E.CHUNK_MAGIC.ljust(512, b"\0") + record(1, "Logon by alice") + record(2, "xx")).ljust(E.CHUNK_BYTES, b"\0")
    (tmp_path / "s.evtx").write_bytes(E.FILE_MAGIC.ljust(4096, b"\0") + chunk)
    rows = sorted(E.read_event_logs(spark, str(tmp_path)).collect(), key=lambda r: r.record)
    assert [(r.record, r.xml, r.strings) for r in rows] == [(1, None, ["Logon by alice"]), (2, None, [])]


def test_values():
    sid = bytes([1, 2]) + (5).to_bytes(6, "big") + struct.pack("<2I", 32, 544)
    cases = [(0, b"", ""), (1, "aé\0".encode("utf-16-le"), "aé"), (2, b"ab\0", "ab"), (3, b"\xff", "-1"), (8, b"\1\0\0\0", "1"), (0xD, b"\1\0\0\0", "true"), (0xE, b"\xab", "AB"), (0x14, b"\x10\0\0\0", "0x10"), (0x13, sid, "S-1-5-32-544")]
    cases += [(0x81, "a\0b\0".encode("utf-16-le"), "a b"), (0x86, b"\1\0\2\0", "1 2"), (0x12, struct.pack("<8H", 2022, 6, 6, 18, 4, 5, 6, 7), "2022-06-18T04:05:06.007Z"), (0xF, bytes(range(16)), "{03020100-0504-0706-0809-0A0B0C0D0E0F}")]
    assert [X.value_text(k, v) for k, v, _ in cases] == [t for *_, t in cases]


def test_damaged_chunks_do_not_fail():
    w = Writer()
    for e in EVENTS:
        w.record(*e)
    whole = w.chunk()
    for at in range(E.FIRST_RECORD, E.FIRST_RECORD + 1500, 7):
        broken = bytearray(whole)
        broken[at] ^= 0x5A
        list(E.records(bytes(broken)))
    # a template that holds itself
    broken = bytearray(whole)
    struct.pack_into("<BBII", broken, w.place + 28, 0x0C, 1, 7, w.place)
    assert [x for _, _, _, x in E.records(bytes(broken))][0] is None


def test_xml_events_and_json(spark):
    xml = "<Events><Event xmlns='x'><System><EventID Qualifiers='0'>4625</EventID><TimeCreated SystemTime='2026-01-10T09:00:01Z'/><Channel>Security</Channel><Computer>pc1</Computer></System><EventData><Data Name=\"TargetUserName\">bob</Data><Data Name=\"IpAddress\">10.0.0.9</Data></EventData></Event><Event><System><EventID>9</EventID></System></Event></Events>"
    found = E.xml_events(spark.createDataFrame([("s", xml)], "source string, text string"))
    a, b = found.orderBy("item_no").collect()
    assert (a.event_id, a.action, a.user, a.ip, a.computer, str(a.event_ts)) == (4625, "logon_failure", "bob", "10.0.0.9", "pc1", "2026-01-10 09:00:01")
    assert b.event_id == 9 and b.action == "event" and b.user is None
    lines = sorted((json.loads(r.line) for r in E.event_json(found).collect()), key=lambda x: x["EventID"])
    assert lines[1] | {"RawXml": ""} == {"EventID": 4625, "Timestamp": "2026-01-10T09:00:01Z", "Computer": "pc1", "Channel": "Security", "Level": "Information", "EventData": {"TargetUserName": "bob", "IpAddress": "10.0.0.9"}, "RawXml": ""}
    assert lines[0]["EventData"] == {} and lines[0]["Timestamp"] is None
