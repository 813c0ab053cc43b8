"""Byte codecs of composite keys that keep the order of their parts. 0x00 separates, 0x01 escapes."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from typing import Any

SEPARATOR, ESCAPE = 0, 1


def escape(raw: bytes) -> bytes:
    """raw without separator bytes; the order of escaped values is that of the raw ones."""
    out = bytearray()
    for b in raw:
        out += bytes((ESCAPE, b + 1)) if b in (SEPARATOR, ESCAPE) else bytes((b,))
    return bytes(out)


def unescape(coded: bytes) -> bytes:
    out, it = bytearray(), iter(coded)
    for b in it:
        if b == ESCAPE:
            b = next(it, 0) - 1
            if b not in (SEPARATOR, ESCAPE):
                raise ValueError("a broken escape")
        out.append(b)
    return bytes(out)


def join(parts: Iterable[bytes]) -> bytes:
    return bytes((SEPARATOR,)).join(escape(p) for p in parts)


def split(coded: bytes) -> list[bytes]:
    return [unescape(p) for p in coded.split(bytes((SEPARATOR,)))]


def ordered_bytes(value: Any, kind: str) -> bytes:
    """Bytes that sort as the values do: LONG, INT, DOUBLE, FLOAT, BOOLEAN, STRING or BINARY; null (None) comes first."""
    if value is None:
        return b"\0"
    if kind in ("LONG", "INT", "ULONG", "UINT"):
        width = 8 if kind.endswith("LONG") else 4
        raw = (value + (1 << (8 * width - 1))).to_bytes(width, "big")
    elif kind in ("DOUBLE", "NDOUBLE", "FLOAT"):
        single = kind == "FLOAT"
        bits = int.from_bytes(struct.pack(">f" if single else ">d", value), "big")
        top = 1 << (31 if single else 63)
        raw = ((~bits & (2 * top - 1)) if bits & top else bits | top).to_bytes(4 if single else 8, "big")
    else:
        raw = bytes((value,)) if kind == "BOOLEAN" else value.encode() if kind == "STRING" else value
    return b"\1" + raw


def from_ordered_bytes(coded: bytes, kind: str) -> Any:
    if coded == b"\0":
        return None
    raw = coded[1:]
    if kind in ("LONG", "INT", "ULONG", "UINT"):
        return int.from_bytes(raw, "big") - (1 << (8 * len(raw) - 1))
    if kind in ("DOUBLE", "NDOUBLE", "FLOAT"):
        bits, top = int.from_bytes(raw, "big"), 1 << (8 * len(raw) - 1)
        bits = bits & ~top if bits & top else ~bits & (2 * top - 1)
        return struct.unpack(">f" if kind == "FLOAT" else ">d", bits.to_bytes(len(raw), "big"))[0]
    return bool(raw[0]) if kind == "BOOLEAN" else raw.decode() if kind == "STRING" else raw
