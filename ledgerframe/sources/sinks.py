"""Sinks: bulk identifiers, NDJSON, and versioned tables with numbered pointers."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import index_name


def bulk_ids(df: DataFrame, chain: str, kind: str, block: str, size: int, key: list[str]) -> DataFrame:
    """``df`` with _index (partition of the block) and _id (key parts joined by dashes); writing twice gives the same rows."""
    return df.withColumns({"_index": index_name(chain, kind, F.col(block), size), "_id": F.concat_ws("-", *[F.col(c).cast("string") for c in key])})


def write_ndjson(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document a line, without null fields; only whole files appear."""
    df.write.mode(mode).option("ignoreNullFields", "true").json(path)


def first_of_each(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first document of each key in file order."""
    return df.groupBy(*key).agg(F.min_by(F.struct(*[c for c in df.columns if c not in key]), order).alias("_x")).select(*key, "_x.*")


def write_sorted(df: DataFrame, path: str, key: list[str], partitions: int) -> None:
    """A table laid out by ranges of its lookup key, so that point reads touch few row groups."""
    df.repartitionByRange(partitions, *key).sortWithinPartitions(*key).write.mode("overwrite").parquet(path)


#: Orders of documents in an index: the newest first.
SORTED = {"action": [("global_sequence", False)], "delta": [("block_num", False), ("scope", True), ("primary_key", True)]}


def write_in_order(df: DataFrame, path: str, kind: str, partitions: int) -> None:
    """Documents of a kind in the order of its index: files are ranges of it and each file is in order."""
    order = [F.col(c).asc() if up else F.col(c).desc() for c, up in SORTED[kind]]
    df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def row_lines(df: DataFrame) -> DataFrame:
    """A contract row as a line: the decoded document under ``data``, or the raw bytes in hexadecimal under ``value``."""
    head = F.to_json(F.struct("code", "scope", "table", "primary_key", "payer", "block_num", F.lit(True).alias("present")))
    tail = F.when(F.col("json").isNotNull(), F.concat(F.lit('"data":'), F.col("json"))).otherwise(F.concat(F.lit('"value":"'), F.lower(F.hex("value")), F.lit('"')))
    return df.select(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(","), tail, F.lit("}")).alias("value"))


def complete_lines(path: str) -> int:
    """Takes an unfinished last line off a file that a writer left in the middle; the bytes that remain."""
    with open(path, "r+b") as f:
        size = f.seek(0, 2)
        at = size
        while at:  # from the end, a block at a time
            start = max(0, at - (1 << 16))
            f.seek(start)
            cut = f.read(at - start).rfind(b"\n")
            if cut >= 0:
                at = start + cut + 1
                break
            at = start
        if at != size:
            f.truncate(at)
        return at


class VersionedTable:
    """Immutable versions under one root, and pointers: small numbered files of which the highest counts.

    A pointer appears whole by one rename to a name that no other has, and none is ever changed or taken away first; a reader
    at any moment, also after a crash between any two steps, finds the last published version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        """Numbers of all pointers, ascending."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[8:]) for n in names if n.startswith("CURRENT-") and n[8:].isdigit())

    def _note(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/CURRENT-{number:012d}").collect()[0].value)

    def current(self) -> dict | None:
        numbers = self._numbers()
        return self._note(numbers[-1]) if numbers else None

    def history(self):
        """Notes of all publications, the newest first."""
        for n in reversed(self._numbers()):
            yield self._note(n)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.current()["path"])

    def publish(self, df: DataFrame, **notes) -> str:
        """Writes a new version, then makes it the current one by one rename."""
        path = f"{self.root}/v{time.time_ns()}"
        df.write.parquet(path)
        self.point({"path": path, **notes})
        return path

    def point(self, note: dict) -> None:
        """Makes a note the current one; if another writer takes the next number first, the one after it is tried."""
        temp = self._path(f"{self.root}/.pointer-{uuid.uuid4().hex}")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(note).encode()))
        out.close()
        number = (self._numbers() or [0])[-1] + 1
        while self._fs.exists(target := self._path(f"{self.root}/CURRENT-{number:012d}")) or not self._fs.rename(temp, target):
            number += 1


def bulk_lines(df: DataFrame) -> DataFrame:
    """The body of bulk requests, one row a document: the target line, the document, each on a line of its own. ``df`` has _index
    and _id; writing the rows as text gives files a bulk endpoint takes as they are."""
    target = F.to_json(F.struct(F.struct("_index", "_id").alias("index")))
    document = F.to_json(F.struct(*[c for c in df.columns if c not in ("_index", "_id")]))
    return df.select(F.concat(target, F.lit("\n"), document).alias("value"))


class Refreshed:
    """An aggregate kept as a versioned table and computed again once it is older than ``seconds``."""

    def __init__(self, spark: SparkSession, root: str, compute, seconds: int = 300):
        self.table, self.compute, self.seconds = VersionedTable(spark, root), compute, seconds

    def read(self, now: float | None = None) -> DataFrame:
        now = time.time() if now is None else now
        current = self.table.current()
        if current is None or now - current["at"] > self.seconds:
            self.table.publish(self.compute(), at=now)
        return self.table.read()
