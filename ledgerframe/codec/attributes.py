"""Attribute blobs of collectibles: sparse pairs of a field number and a value, typed by the schema's format."""

from __future__ import annotations

import struct

from .names import base58_encode
from .wire import Cursor, Malformed

FIRST = 4  # fixed value of the format: numbers below are reserved
_BITS = {f"{p}int{n}": (p, n) for p in ("", "u") for n in (8, 16, 32, 64)}


def _number(x: int, bits: int):
    return str(x) if bits == 64 else x


def _real(x: float):
    return x if x == x and abs(x) != float("inf") else None


def read_value(type_: str, c: Cursor, depth: int = 0):
    if depth > 16:
        raise Malformed("arrays nest too deep")
    if type_.endswith("[]"):
        return [read_value(type_[:-2], c, depth + 1) for _ in range(c.varuint())]
    if type_ in _BITS:
        unsigned, bits = _BITS[type_]
        u = c.varuint()
        u &= (1 << 64) - 1
        return _number(u if unsigned else u >> 1 ^ -(u & 1), bits)
    if type_.startswith("fixed"):
        bits = int(type_[5:])
        return _number(int.from_bytes(c.take(bits // 8), "little"), bits)
    if type_ in ("byte", "bool"):
        return c.u8()
    if type_ == "float":
        return _real(c.number("f"))
    if type_ == "double":
        return _real(c.number("d"))
    if type_ == "ipfs":
        return base58_encode(c.blob())
    if type_ == "bytes":
        return c.blob().hex()
    if type_ in ("string", "image"):
        return c.text()
    raise Malformed(f"no attribute type {type_!r}")


def decode(blob: bytes, format_: list[tuple[str, str]]) -> dict:
    """Attributes by name; fields that the blob leaves out are absent."""
    c, out = Cursor(blob), {}
    while c.left:
        k = c.varuint() - FIRST
        if not 0 <= k < len(format_):
            raise Malformed("field number out of range")
        name, type_ = format_[k]
        out[name] = read_value(type_, c)
    return out


def decode_or_empty(blob: bytes | None, format_: list[tuple[str, str]] | None) -> dict:
    if not blob or not format_:
        return {}
    try:
        return decode(blob, format_)
    except (Malformed, ValueError, struct.error):
        return {}
