"""Python data sources over state-history logs, block logs and snapshots.

Registered names: ``ship_log`` (block_num, block_id, payload), ``block_log`` (block_num, producer, slot), ``snapshot_rows``
(contract rows of a snapshot) and ``snapshot_sections``. Paths go through Arrow's file systems, so any store they know works.
A log is cut into ranges of blocks; every task seeks by the index and reads its range in order. Filters on block_num become
ranges before any byte of a payload is read (needs ``spark.sql.python.filterPushdown.enabled``).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..codec import history, snapshot
from ..shipping import ship


def open_file(path: str):
    """A seekable file of a local path or of a URI."""
    from pyarrow import fs

    if "://" in path:
        system, at = fs.FileSystem.from_uri(path)
    else:
        system, at = fs.LocalFileSystem(), path
    return system.open_input_file(at)


def read_all(path: str) -> bytes:
    """A whole file, unpacked by its ending (.gz, .zst)."""
    with open_file(path) as f:
        data = f.read()
    if path.endswith((".gz", ".tgz")):
        import gzip

        data, path = gzip.decompress(data), path.removesuffix(".gz")
    if path.endswith(".zst"):
        import zstandard

        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        path = path.removesuffix(".zst")
    return _member(data) if path.endswith((".tar", ".tgz")) else data


def _member(data: bytes) -> bytes:
    """The first file of an archive that is called a snapshot (.bin), else its first file."""
    import io
    import tarfile

    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        files = [m for m in tar.getmembers() if m.isfile()]
        return tar.extractfile(next((m for m in files if m.name.endswith(".bin")), files[0])).read()


def unpacked(path: str) -> str:
    """The path of the unpacked sibling of a ``.zst`` file; it is made once, under another name until it is whole."""
    import os
    import shutil
    import uuid

    import zstandard

    target = path.removesuffix(".zst")
    if target != path and not os.path.exists(target):
        part = f"{target}.{uuid.uuid4().hex}.part"
        with open(path, "rb") as source, open(part, "wb") as out, zstandard.ZstdDecompressor().stream_reader(source) as reader:
            shutil.copyfileobj(reader, out, 1 << 20)
        os.replace(part, target)
    return target


class BlockRange(InputPartition):
    def __init__(self, start: int, end: int, wanted: tuple[int, ...] | None = None):
        super().__init__(0)
        self.start, self.end, self.wanted = start, end, wanted


class _Bounds:
    """Filters on block_num as a range and perhaps a list of blocks."""

    def __init__(self):
        self.low, self.high, self.wanted = 0, 1 << 62, None

    def take(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("block_num",):
                yield f
            elif isinstance(f, EqualTo):
                self._only({f.value})
            elif isinstance(f, In):
                self._only(set(f.value))
            elif isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, f.value)
            elif isinstance(f, GreaterThan):
                self.low = max(self.low, f.value + 1)
            elif isinstance(f, LessThanOrEqual):
                self.high = min(self.high, f.value)
            elif isinstance(f, LessThan):
                self.high = min(self.high, f.value - 1)
            else:
                yield f

    def _only(self, blocks: set) -> None:
        self.wanted = blocks if self.wanted is None else self.wanted & blocks


class ShipLogReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.bounds = _Bounds()
        self.bounds.low = int(options.get("start", 0))
        self.bounds.high = int(options.get("end", 1 << 62))
        self.chunk = int(options.get("chunk", 20_000))
        self.unpack = options.get("payload", "true").lower() != "false"

    def pushFilters(self, filters):
        return self.bounds.take(filters)

    def span(self) -> tuple[int, int]:
        """First and last block; the first entry of a restored log has another magic, the second must be a log's."""
        with open_file(f"{self.path}.index") as index, open_file(f"{self.path}.log") as log:
            n = index.size() // 8
            if not n:
                raise ValueError("the log is empty")
            magic, _, first, _ = history.read_header(log.read(history.HEADER))
            if not history.is_ship(magic):
                second = 0
                if n > 1:
                    index.seek(8)
                    log.seek(struct.unpack("<Q", index.read(8))[0])
                    second = struct.unpack("<Q", log.read(8))[0]
                if not history.is_ship(second):
                    raise ValueError("this is no state-history log")
            return first, first + n - 1

    def partitions(self):
        first, last = self.span()
        low, high = max(first, self.bounds.low), min(last, self.bounds.high)
        if self.bounds.wanted is not None:
            blocks = sorted(b for b in self.bounds.wanted if low <= b <= high)
            return [BlockRange(part[0], part[-1], tuple(part)) for k in range(0, len(blocks), 256) if (part := blocks[k : k + 256])]
        return [BlockRange(b, min(b + self.chunk - 1, high)) for b in range(low, high + 1, self.chunk)]

    def read(self, partition):
        if partition is None:
            return
        with open_file(f"{self.path}.index") as index, open_file(f"{self.path}.log") as log:
            first = history.read_header(log.read(history.HEADER))[2]
            blocks = partition.wanted or range(partition.start, partition.end + 1)
            for b, offset in _offsets(index, first, blocks):
                log.seek(offset)
                _, id_, number, size = history.read_header(log.read(history.HEADER))
                if number != b:
                    raise ValueError(f"the index says block {b}, the log {number}")
                try:
                    payload = history.unpack_payload(log.read(size)) if self.unpack else b""
                except Exception:  # a bad entry is a row without a payload, so that it can be counted
                    payload = None
                yield b, id_, payload


def _offsets(index, first: int, blocks) -> Iterator[tuple[int, int]]:
    """(block, offset in the log): one read of the index for each run of consecutive blocks, of 4096 at most."""
    k = 0
    while k < len(blocks):
        n = 1
        while n < 4096 and k + n < len(blocks) and blocks[k + n] == blocks[k] + n:
            n += 1
        index.seek((blocks[k] - first) * 8)
        yield from zip(blocks[k : k + n], struct.unpack(f"<{n}Q", index.read(n * 8)), strict=True)
        k += n


class ShipLogStream(DataSourceStreamReader):
    """Blocks as they are appended; the offset is the next block, so a restart resumes where the last batch ended."""

    def __init__(self, options):
        self.inner = ShipLogReader(options)

    def initialOffset(self):
        return {"block": max(self.inner.span()[0], self.inner.bounds.low)}

    def latestOffset(self):
        return {"block": min(self.inner.span()[1], self.inner.bounds.high) + 1}

    def partitions(self, start, end):
        return [BlockRange(b, min(b + self.inner.chunk, end["block"]) - 1) for b in range(start["block"], end["block"], self.inner.chunk)]

    def read(self, partition):
        return self.inner.read(partition)

    def commit(self, end):
        pass


class ShipLog(DataSource):
    @classmethod
    def name(cls):
        return "ship_log"

    def schema(self):
        return "block_num long, block_id string, payload binary"

    def reader(self, schema):
        return ShipLogReader(self.options)

    def streamReader(self, schema):
        return ShipLogStream(self.options)


class BlockLogReader(DataSourceReader):
    """Headers of a block log: an index of offsets, and at each offset a slot and a producer."""

    def __init__(self, options):
        self.path, self.chunk, self.bounds = options["path"], int(options.get("chunk", 20_000)), _Bounds()

    def pushFilters(self, filters):
        return self.bounds.take(filters)

    def partitions(self):
        with open_file(f"{self.path}.index") as index, open_file(f"{self.path}.log") as log:
            _, first = struct.unpack("<II", log.read(8))
            last = first + index.size() // 8 - 1
        low, high = max(first, self.bounds.low), min(last, self.bounds.high)
        if self.bounds.wanted is not None:
            blocks = sorted(b for b in self.bounds.wanted if low <= b <= high)
            return [BlockRange(blocks[0], blocks[-1], tuple(blocks))] if blocks else []
        return [BlockRange(b, min(b + self.chunk - 1, high)) for b in range(low, high + 1, self.chunk)]

    def read(self, partition):
        from ..codec.names import name_to_text

        if partition is None:
            return
        with open_file(f"{self.path}.index") as index, open_file(f"{self.path}.log") as log:
            _, first = struct.unpack("<II", log.read(8))
            for b in partition.wanted or range(partition.start, partition.end + 1):
                index.seek((b - first) * 8)
                log.seek(struct.unpack("<Q", index.read(8))[0])
                slot, producer = struct.unpack("<IQ", log.read(12))
                yield b, name_to_text(producer), slot


class BlockLog(DataSource):
    @classmethod
    def name(cls):
        return "block_log"

    def schema(self):
        return "block_num long, producer string, slot long"

    def reader(self, schema):
        return BlockLogReader(self.options)


class SnapshotReader(DataSourceReader):
    """One file is one partition, as its rows can only be read in order; several paths are several partitions."""

    def __init__(self, options, kind):
        self.paths, self.kind = options["path"].split(","), kind
        self.targets = [tuple(t.split(":")) for t in options.get("tables", "").split(",") if t]

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def _sections(self, path: str) -> list[snapshot.Section]:
        """By seeking from header to header where the file is not packed."""
        if path.endswith((".gz", ".zst", ".tgz", ".tar")):
            return snapshot.sections(read_all(path))
        with open_file(path) as f:
            return snapshot.sections_of(f, f.size())

    def _needed(self, path: str) -> bytes:
        """A snapshot with the sections that this kind reads, and no others."""
        if path.endswith((".gz", ".zst", ".tgz", ".tar")):
            return read_all(path)
        names = {"rows": ("contract_tables", "table_id_object", "key_value_object"), "accounts": ("account_object",), "code": ("account_metadata_object",), "permissions": ("permission_object", "permission_usage_object"), "links": ("permission_link_object",)}[self.kind]
        with open_file(path) as f:
            return snapshot.only(f, snapshot.sections_of(f, f.size()), (*names, "chain_snapshot_header"))

    def _wanted(self, code: str, scope: str, table: str) -> bool:
        def one(t):
            return t[0] == table if len(t) == 1 else (t[0], t[-1]) == (code, table) and (len(t) == 2 or t[1] == scope)

        return not self.targets or any(one(t) for t in self.targets)

    def read(self, partition):
        import json

        if self.kind == "sections":
            yield from ((s.name, s.rows, s.at, s.size) for s in self._sections(partition.value))
            return
        data = self._needed(partition.value)
        if self.kind == "rows":
            yield from snapshot.contract_rows(data, self._wanted)
        elif self.kind == "accounts":
            yield from snapshot.accounts(data)
        elif self.kind == "code":
            yield from snapshot.code_hashes(data)
        elif self.kind == "permissions":
            yield from ((p["account"], p["perm_name"], p["parent"], p["last_updated"], json.dumps(p["required_auth"])) for p in snapshot.permissions(data))
        else:
            yield from ((x["account"], x["perm_name"], x["code"], x["action"]) for x in snapshot.permission_links(data))


_SNAPSHOT = {
    "rows": "code string, scope string, table string, primary_key string, payer string, value binary",
    "sections": "name string, rows long, offset long, size long",
    "accounts": "account string, abi binary",
    "code": "account string, code_hash string",
    "permissions": "account string, perm_name string, parent string, last_updated string, required_auth string",
    "links": "account string, perm_name string, code string, action string",
}


def _snapshot_source(kind_: str) -> type[DataSource]:
    class Source(DataSource):
        kind = kind_

        @classmethod
        def name(cls):
            return f"snapshot_{cls.kind}"

        def schema(self):
            return _SNAPSHOT[self.kind]

        def reader(self, schema):
            return SnapshotReader(self.options, self.kind)

    Source.__name__ = f"Snapshot{kind_.title()}"
    return Source


def register(spark: SparkSession) -> None:
    ship(spark)
    for source in (ShipLog, BlockLog, *map(_snapshot_source, _SNAPSHOT)):
        spark.dataSource.register(source)


def read_abi_index(spark: SparkSession, path: str):
    """Interface versions from NDJSON (account, block, abi_hex); malformed lines and empty interfaces are left out."""
    from pyspark.sql import functions as F

    df = spark.read.schema("account string, block long, abi_hex string").option("mode", "DROPMALFORMED").json(path)
    return df.filter("account is not null and block is not null and length(abi_hex) > 0").select("account", F.col("block").alias("valid_from"), F.unhex("abi_hex").alias("abi"))
