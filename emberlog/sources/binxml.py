"""Binary XML of event-log records as text.

A record is a stream of tokens; most are an instance of a template, which the chunk holds once: the template's own tokens
with numbered gaps, and for each record the values that fill them. Names and templates are given by their place in the
chunk, so a chunk of 64 KB is all that its records need.
"""

from __future__ import annotations

import struct
import uuid
from datetime import datetime, timedelta
from html import escape

# Fixed values of the format: tokens, whose bit 0x40 says that more follows
END, OPEN, CLOSE, EMPTY, CLOSED, VALUE, ATTRIBUTE, CDATA, CHARACTER, ENTITY = range(10)
TARGET, DATA, TEMPLATE, GAP, OPTIONAL, HEADER = range(10, 16)
#: Nested elements and templates at most: a damaged chunk may refer to itself.
DEPTH = 64
_NUMBERS = {3: "b", 4: "B", 5: "h", 6: "H", 7: "i", 8: "I", 9: "q", 10: "Q", 11: "f", 12: "d"}


def _time(ticks: int) -> str:
    return (datetime(1601, 1, 1) + timedelta(microseconds=ticks // 10)).isoformat(timespec="microseconds") + "Z"


def _sid(raw: bytes) -> str:
    parts = struct.unpack_from(f"<{raw[1]}I", raw, 8)
    return "-".join(["S", str(raw[0]), str(int.from_bytes(raw[2:8], "big")), *map(str, parts)])


def value_text(kind: int, raw: bytes) -> str:
    """A value of the format as text; an array as its members with blanks between."""
    if kind & 0x80:
        if kind & 0x7F == 1:
            return " ".join(raw.decode("utf-16-le", "replace").rstrip("\0").split("\0"))
        size = struct.calcsize(_NUMBERS[kind & 0x7F]) if kind & 0x7F in _NUMBERS else {0xF: 16, 0x11: 8}.get(kind & 0x7F, len(raw) or 1)
        return " ".join(value_text(kind & 0x7F, raw[i : i + size]) for i in range(0, len(raw), size))
    if kind == 0 or not raw:
        return ""
    if kind == 1:
        return raw.decode("utf-16-le", "replace").rstrip("\0")
    if kind == 2:
        return raw.decode("cp1252", "replace").rstrip("\0")
    if kind in _NUMBERS:
        return str(struct.unpack("<" + _NUMBERS[kind], raw)[0])
    if kind == 0x0D:
        return "true" if any(raw) else "false"
    if kind == 0x0F:
        return "{" + str(uuid.UUID(bytes_le=raw)).upper() + "}"
    if kind in (0x10, 0x14, 0x15):
        return hex(int.from_bytes(raw, "little"))
    if kind == 0x11:
        return _time(int.from_bytes(raw, "little"))
    if kind == 0x12:
        year, month, _, day, hour, minute, second, milli = struct.unpack("<8H", raw)
        return datetime(year, month, day, hour, minute, second, milli * 1000).isoformat(timespec="milliseconds") + "Z"
    if kind == 0x13:
        return _sid(raw)
    return raw.hex().upper()


class Chunk:
    """The text of a chunk's records. Names are read once; templates are filled anew for each record."""

    def __init__(self, raw: bytes):
        self.raw, self.names = raw, {}

    def text(self, at: int, end: int) -> str:
        """The tokens from `at` to `end` as XML."""
        out: list[str] = []
        self._tokens(at, end, None, out, 0)
        return "".join(out)

    def _name(self, at: int, here: int) -> tuple[str, int]:
        """A name by its place, and where reading goes on: behind it if it stands right here."""
        if at not in self.names:
            (size,) = struct.unpack_from("<H", self.raw, at + 6)
            self.names[at] = self.raw[at + 8 : at + 8 + 2 * size].decode("utf-16-le", "replace"), at + 10 + 2 * size
        name, behind = self.names[at]
        return name, behind if at == here else here

    def _template(self, at: int, out: list[str], depth: int) -> int:
        (place,) = struct.unpack_from("<I", self.raw, at + 6)
        (size,) = struct.unpack_from("<I", self.raw, place + 20)
        body = place + 24
        at = body + size if place == at + 10 else at + 10
        (count,) = struct.unpack_from("<I", self.raw, at)
        head, at = at + 4, at + 4 + 4 * count
        values = []
        for i in range(count):
            length, kind = struct.unpack_from("<HB", self.raw, head + 4 * i)
            values.append((kind, at, at + length))
            at += length
        self._tokens(body, body + size, values, out, depth + 1)
        return at

    def _filled(self, values, number: int, out: list[str], depth: int, mark: bool) -> None:
        kind, at, end = values[number]
        if kind == 0x21:
            self._tokens(at, end, None, out, depth + 1)
        else:
            out.append(escape(value_text(kind, self.raw[at:end]), quote=mark))

    def _tokens(self, at: int, end: int, values, out: list[str], depth: int) -> int:
        if depth > DEPTH:
            raise ValueError("too deep")
        raw, open_, attribute = self.raw, [], False

        def leave():
            nonlocal attribute
            if attribute:
                out.append('"')
                attribute = False

        while at < end:
            token, more = raw[at] & 0x0F, raw[at] & 0x40
            if raw[at] & 0xB0:
                raise ValueError("no token")
            if token == END:
                return at + 1
            if token == HEADER:
                at += 4
            elif token == OPEN:
                (place,) = struct.unpack_from("<I", raw, at + 7)
                name, at = self._name(place, at + 11)
                at += 4 if more else 0
                open_.append(name)
                out.append("<" + name)
            elif token == ATTRIBUTE:
                leave()
                (place,) = struct.unpack_from("<I", raw, at + 1)
                name, at = self._name(place, at + 5)
                out.append(f' {name}="')
                attribute = True
            elif token == CLOSE:
                leave()
                out.append(">")
                at += 1
            elif token in (EMPTY, CLOSED):
                leave()
                name = open_.pop()
                out.append("/>" if token == EMPTY else f"</{name}>")
                at += 1
            elif token == VALUE:
                (size,) = struct.unpack_from("<H", raw, at + 2)
                out.append(escape(value_text(1, raw[at + 4 : at + 4 + 2 * size]), quote=attribute))
                at += 4 + 2 * size
            elif token == CDATA:
                (size,) = struct.unpack_from("<H", raw, at + 1)
                out.append(escape(raw[at + 3 : at + 3 + 2 * size].decode("utf-16-le", "replace"), quote=False))
                at += 3 + 2 * size
            elif token == CHARACTER:
                (code,) = struct.unpack_from("<H", raw, at + 1)
                out.append(f"&#{code};")
                at += 3
            elif token == ENTITY:
                (place,) = struct.unpack_from("<I", raw, at + 1)
                name, at = self._name(place, at + 5)
                out.append(f"&{name};")
            elif token == TARGET:
                (place,) = struct.unpack_from("<I", raw, at + 1)
                _, at = self._name(place, at + 5)
            elif token == DATA:
                (size,) = struct.unpack_from("<H", raw, at + 1)
                at += 3 + 2 * size
            elif token == TEMPLATE:
                at = self._template(at, out, depth)
            else:
                (number,) = struct.unpack_from("<H", raw, at + 1)
                if not 0 <= number < len(values or ()):
                    raise ValueError("no such value")
                self._filled(values, number, out, depth, attribute)
                at += 4
        return at
