"""Portable snapshots: sections, contract rows of both layouts, permissions and links, accounts and code hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from .names import key_to_text, micros_to_text, name_to_text, text_to_name
from .wire import Builder, Cursor, Malformed

#: Fixed values of the format: magic, version, end mark, and row sizes of the five secondary indexes.
MAGIC, VERSION, END = 0x30510550, 1, 0xFFFFFFFFFFFFFFFF
SECONDARY = (24, 32, 48, 24, 32)
_PREFIX = "eosio::chain::"


@dataclass
class Section:
    name: str
    rows: int
    at: int
    size: int


def sections(data: bytes) -> list[Section]:
    c = Cursor(data)
    if c.u32() != MAGIC:
        raise Malformed("not a portable snapshot")
    if c.u32() != VERSION:
        raise Malformed("unknown file version")
    out = []
    while c.left >= 8:
        size = c.u64()
        if size == END:
            break
        after = c.at
        if size < 9 or after + size > len(data):
            raise Malformed(f"a section at {after} of impossible size {size}")
        rows = c.u64()
        stop = data.find(b"\0", c.at, after + size)
        if stop < 0:
            raise Malformed("a section without a name")
        name = data[c.at : stop].decode()
        out.append(Section(name, rows, stop + 1, after + size - stop - 1))
        c.at = after + size
    return out


def sections_of(file, size: int) -> list[Section]:
    """The sections of a seekable file of this size, by their headers alone."""
    if size < 8:
        raise Malformed("not a portable snapshot")
    head = Cursor(file.read(8))
    if head.u32() != MAGIC:
        raise Malformed("not a portable snapshot")
    if head.u32() != VERSION:
        raise Malformed("unknown file version")
    out, at = [], 8
    while size - at >= 8:
        file.seek(at)
        raw = file.read(min(512, size - at))
        own = Cursor(raw).u64()
        if own == END:
            break
        stop = raw.find(b"\0", 16)
        if own < 9 or at + 8 + own > size:
            raise Malformed(f"a section at {at + 8} of impossible size {own}")
        if stop < 0:
            raise Malformed("a section without a name")
        out.append(Section(raw[16:stop].decode(), Cursor(raw, 8).u64(), at + stop + 1, own - (stop + 1 - 8)))
        at += 8 + own
    return out


def only(file, found: list[Section], names: tuple[str, ...]) -> bytes:
    """A snapshot of just these sections of a file."""
    out = Builder().u32(MAGIC).u32(VERSION)
    for s in found:
        if s.name.removeprefix(_PREFIX) in names:
            file.seek(s.at)
            name = s.name.encode() + b"\0"
            out.u64(8 + len(name) + s.size).u64(s.rows).raw(name).raw(file.read(s.size))
    return out.u64(END).bytes()


def find(found: list[Section], name: str) -> Section | None:
    return next((s for s in found if s.name in (name, _PREFIX + name)), None)


def chain_version(data: bytes, found: list[Section]) -> int:
    s = find(found, "chain_snapshot_header")
    if s is None:
        raise Malformed("a snapshot without a header")
    return Cursor(data, s.at, s.at + s.size).u32()


Row = tuple[str, str, str, str, str, bytes]


def contract_rows(data: bytes, wanted: Callable[[str, str, str], bool] = lambda *_: True) -> Iterator[Row]:
    """(code, scope, table, primary key, payer, value) of the wanted tables; framing errors are raised."""
    found = sections(data)
    if (s := find(found, "contract_tables")) is not None:
        yield from _inlined(Cursor(data, s.at, s.at + s.size), wanted)
        return
    ids, rows = find(found, "table_id_object"), find(found, "key_value_object")
    if ids is None or rows is None:
        return
    c = Cursor(data, ids.at, ids.at + ids.size)
    tables = []
    for _ in range(ids.rows):
        tables.append(tuple(name_to_text(c.u64()) for _ in range(3)))
        c.take(12)
    if c.left:
        raise Malformed("table ids do not fill their section")
    c, last = Cursor(data, rows.at, rows.at + rows.size), -1
    while c.left:
        t, n = c.u64(), c.varuint()
        if t <= last:
            raise Malformed("table numbers do not increase")
        last = t
        keep = t < len(tables) and wanted(*tables[t])
        for _ in range(n):
            key, payer, value = c.u64(), c.u64(), c.blob()
            if keep:
                yield (*tables[t], str(key), name_to_text(payer), value)


def _inlined(c: Cursor, wanted) -> Iterator[Row]:
    while c.left:
        code, scope, table = (name_to_text(c.u64()) for _ in range(3))
        c.u64()
        c.u32()
        keep = wanted(code, scope, table)
        for _ in range(c.varuint()):
            key, payer, value = c.u64(), c.u64(), c.blob()
            if keep:
                yield code, scope, table, str(key), name_to_text(payer), value
        for size in SECONDARY:
            c.take(c.varuint() * size)


def accounts(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Accounts with their interfaces: name, creation slot, interface."""
    s = find(sections(data), "account_object")
    if s is None:
        return
    c = Cursor(data, s.at, s.at + s.size)
    for _ in range(s.rows):
        name = name_to_text(c.u64())
        c.u32()
        yield name, c.blob()


def code_hashes(data: bytes) -> Iterator[tuple[str, str]]:
    """(account, code hash) of accounts with code; rows are 86 bytes."""
    s = find(sections(data), "account_metadata_object")
    if s is None:
        return
    if s.size != s.rows * 86:
        raise Malformed("account metadata of unknown size")
    for k in range(s.rows):
        row = data[s.at + 86 * k : s.at + 86 * (k + 1)]
        code = row[40:72]
        if any(code):
            yield name_to_text(int.from_bytes(row[:8], "little")), code.hex()


def _key(c: Cursor) -> str:
    kind = c.u8()
    if kind < 2:
        return key_to_text(("K1", "R1")[kind], c.take(33))
    start = c.at
    c.take(34)
    c.text()
    return key_to_text("WA", c.data[start : c.at])


def _authority(c: Cursor) -> dict:
    return {"threshold": c.u32(), "keys": c.many(lambda: {"key": _key(c), "weight": c.u16()}), "accounts": c.many(lambda: {"permission": {"actor": name_to_text(c.u64()), "permission": name_to_text(c.u64())}, "weight": c.u16()}), "waits": c.many(lambda: {"wait_sec": c.u32(), "weight": c.u16()})}


def permissions(data: bytes) -> Iterator[dict]:
    """Permissions of accounts; the root entry without an owner is skipped."""
    s = find(sections(data), "permission_object")
    if s is None:
        return
    c = Cursor(data, s.at, s.at + s.size)
    for _ in range(s.rows):
        parent, owner, name = (name_to_text(c.u64()) for _ in range(3))
        updated, _used = micros_to_text(c.i64()), c.i64()
        auth = _authority(c)
        if owner or name:
            yield {"account": owner, "perm_name": name, "parent": parent, "last_updated": updated, "required_auth": auth}
    if c.left:
        raise Malformed("permissions do not fill their section")


def permission_links(data: bytes) -> Iterator[dict]:
    s = find(sections(data), "permission_link_object")
    if s is None:
        return
    if s.size != s.rows * 32:
        raise Malformed("links of unknown size")
    c = Cursor(data, s.at, s.at + s.size)
    for _ in range(s.rows):
        account, code, action, perm = (name_to_text(c.u64()) for _ in range(4))
        yield {"account": account, "code": code, "action": action, "perm_name": perm}


class SnapshotWriter:
    """Sections in memory, for fixtures."""

    def __init__(self, version: int):
        self.out = Builder().u32(MAGIC).u32(VERSION)
        self.version = version
        self.section("chain_snapshot_header", 1, Builder().u32(version).bytes())

    def section(self, name: str, rows: int, payload: bytes) -> None:
        full = (name if name == "contract_tables" else _PREFIX + name).encode() + b"\0"
        self.out.u64(8 + len(full) + len(payload)).u64(rows).raw(full).raw(payload)

    def contract(self, tables: dict[tuple[str, str, str], list[tuple[int, str, bytes]]]) -> None:
        row = lambda b, r: b.u64(r[0]).u64(text_to_name(r[1])).blob(r[2])
        if self.version < 7:
            b = Builder()
            for (code, scope, table), rows in tables.items():
                for n in (code, scope, table):
                    b.u64(text_to_name(n))
                b.u64(0).u32(len(rows)).many(rows, lambda r: row(b, r))
                for _ in SECONDARY:
                    b.varuint(0)
            self.section("contract_tables", len(tables), b.bytes())
            return
        ids, kv = Builder(), Builder()
        for t, ((code, scope, table), rows) in enumerate(tables.items()):
            for n in (code, scope, table):
                ids.u64(text_to_name(n))
            ids.u64(0).u32(len(rows))
            kv.u64(t).many(rows, lambda r: row(kv, r))
        self.section("table_id_object", len(tables), ids.bytes())
        self.section("key_value_object", sum(map(len, tables.values())), kv.bytes())

    def accounts(self, abis: dict[str, bytes]) -> None:
        b = Builder()
        for name, abi in abis.items():
            b.u64(text_to_name(name)).u32(0).blob(abi)
        self.section("account_object", len(abis), b.bytes())

    def permissions(self, rows: list[dict], links: list[dict]) -> None:
        b = Builder()
        for p in rows:
            b.u64(text_to_name(p.get("parent", ""))).u64(text_to_name(p["account"])).u64(text_to_name(p["perm_name"])).i64(0).i64(0).u32(p.get("threshold", 1))
            b.many(p.get("keys", []), lambda k: b.u8(0).raw(k[0]).number("H", k[1]))
            b.many(p.get("accounts", []), lambda a: b.u64(text_to_name(a[0])).u64(text_to_name(a[1])).number("H", a[2]))
            b.varuint(0)
        self.section("permission_object", len(rows), b.bytes())
        b = Builder()
        for x in links:
            for n in ("account", "code", "action", "perm_name"):
                b.u64(text_to_name(x[n]))
        self.section("permission_link_object", len(links), b.bytes())

    def bytes(self) -> bytes:
        return self.out.bytes() + Builder().u64(END).bytes()
