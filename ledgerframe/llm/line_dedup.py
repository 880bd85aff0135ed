"""Line deduplication with exact reference counts and sharded cuckoo filters, reversible document by document.

The reference table counts, for every line key, the documents that hold it; it is the truth, and inserting or deleting
documents adds a table of changes to it (after ``MOST_CHANGES`` of them they are merged). Keys found in at least ``min_docs``
documents are also kept in cuckoo filters, one for each shard of keys, which unlike Bloom filters let a key go again when its
count falls: an insertion or deletion looks up only the keys of its own documents, puts those that reached ``min_docs`` into
the filters of their shards, takes those that fell below it out of theirs, and leaves all other filters as they are. A filter
that has no more place is built again, larger, from the keys of its shard.

Reading documents, every line asks the filters first; only the few that answer yes are joined with the reference table, whose
word is final. So a false answer of a filter costs a lookup and never a line. Filters are small (2 bytes a slot) and are
broadcast in groups of at most ``GROUP_BYTES``, one group at a time: the answers of a group are written before the next is read.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased; the table holds its MD5.

Defined results: a null or empty text is one empty line; keys shorter than ``min_length`` code points are never counted;
a key counts once for each row that holds it, repeated rows each; deleting documents of which a line was never inserted that
often raises ``ValueError`` and changes nothing; an empty table gives an empty result; input columns named like a
result column are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import add_by_arrow, map_arrow, put, ship, text_or_empty
from .storage import discard, materialize

MIN_DOCS, MIN_LENGTH, SHARD_KEYS = 10, 1, 1 << 16
GROUP_BYTES, MOST_CHANGES = 64 << 20, 8
_SLOTS, _KICKS = 4, 500
_BLANKS = " \t\n\u000b\f\r"
_FOLD = {c: c + 32 for c in range(65, 91)}


class CuckooFilter:
    """Partial-key cuckoo hashing with 16-bit fingerprints in buckets of four; keys are (bucket hash, print) pairs."""

    def __init__(self, capacity: int):
        self.mask = (1 << max(1, int(np.ceil(np.log2(max(1, capacity) / (0.8 * _SLOTS)))))) - 1
        self.table = np.zeros((self.mask + 1, _SLOTS), np.uint16)

    @staticmethod
    def _split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = (keys >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        return (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), prints

    def _other(self, bucket, prints):
        return (bucket ^ (prints.astype(np.int64) * 0x5BD1E995 & 0x7FFFFFFF)) & self.mask

    def _own(self) -> None:
        if not self.table.flags.writeable:
            self.table = self.table.copy()

    def contains(self, keys: np.ndarray) -> np.ndarray:
        at, prints = self._split(keys)
        at &= self.mask
        return (self.table[at] == prints[:, None]).any(1) | (self.table[self._other(at, prints)] == prints[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> None:
        """Adds keys; an error if one finds no place after many kicks."""
        self._own()
        at, prints = self._split(keys)
        state = 0x2545F491
        for k in range(len(keys)):
            p = prints[k : k + 1]
            b = int(at[k]) & self.mask
            for turn in range(_KICKS):
                for c in (b, int(self._other(np.int64(b), p)[0])):
                    free = np.flatnonzero(self.table[c] == 0)
                    if len(free):
                        self.table[c, free[0]] = p[0]
                        break
                else:
                    state = (state * 1103515245 + 12345) & 0x7FFFFFFF
                    slot = (state >> 16) % _SLOTS
                    b = int(self._other(np.int64(b), p)[0])
                    old = self.table[b, slot : slot + 1].copy()
                    self.table[b, slot] = p[0]
                    p = old
                    b = int(self._other(np.int64(b), p)[0])
                    continue
                break
            else:
                raise OverflowError("no place in the filter")

    def delete(self, keys: np.ndarray) -> None:
        """Takes out one entry of each key; the keys must have been inserted (another key with the same print and buckets is
        as good)."""
        self._own()
        at, prints = self._split(keys)
        for b, p in zip((at & self.mask).tolist(), prints.tolist(), strict=True):
            for c in (b, int(self._other(np.array([b]), np.array([p], np.uint16))[0])):
                own = np.flatnonzero(self.table[c] == p)
                if len(own):
                    self.table[c, own[0]] = 0
                    break

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        room = len(keys)
        while True:
            made = cls(room)
            try:
                made.insert(keys)
                return made
            except OverflowError:
                room = 2 * (made.mask + 1) * _SLOTS

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        made = cls.__new__(cls)
        made.table = np.frombuffer(raw, np.uint16).reshape(-1, _SLOTS)  # shared with ``raw``; copied before it is changed
        made.mask = len(made.table) - 1
        return made


def line_key(line: str) -> str:
    return line.strip(_BLANKS).translate(_FOLD)


def _digest(key: str) -> bytes:
    return hashlib.md5(key.encode()).digest()


def line_counts(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """The exact reference table (key, n_docs) of these documents; partial counts are made before the shuffle."""
    key = lambda line: F.translate(F.btrim(line, F.lit(_BLANKS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = F.array_distinct(F.transform(F.split(text_or_empty(), "\n"), key))
    lines = docs.select(F.explode(keys).alias("line")).filter(F.char_length("line") >= min_length)
    return lines.groupBy(F.unhex(F.md5(F.col("line").cast("binary"))).alias("key")).agg(F.count("*").alias("n_docs"))


class LineIndex:
    """Reference counts, and cuckoo filters of the keys in at least ``min_docs`` documents, by shard of the key.

    An index is never changed in place: :meth:`insert` and :meth:`delete` return the next one, which shares all tables and
    filters with this one but for what the documents touch."""

    def __init__(self, counts: list[DataFrame], frequent: DataFrame, filters: DataFrame, shards: int, min_docs: int, min_length: int):
        #: A base table and signed changes to it, (key, n_docs) each.
        self.parts, self.frequent, self.filters, self.shards, self.min_docs, self.min_length = counts, frequent, filters, shards, min_docs, min_length

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH, shard_keys: int = SHARD_KEYS) -> LineIndex:
        counts = materialize(line_counts(docs, min_length), "line_counts")
        frequent = materialize(counts.filter(F.col("n_docs") >= min_docs).select("key"), "frequent")
        shards = max(1, -(-frequent.count() // shard_keys))
        return cls([counts], frequent, materialize(_built(frequent, shards), "filters"), shards, min_docs, min_length)

    @property
    def counts(self) -> DataFrame:
        """The reference table (key, n_docs) as of now."""
        if len(self.parts) == 1:
            return self.parts[0]
        every = self.parts[0]
        for p in self.parts[1:]:
            every = every.unionByName(p)
        return every.groupBy("key").agg(F.sum("n_docs").alias("n_docs")).filter("n_docs > 0")

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        change = materialize(line_counts(docs, self.min_length).select("key", (sign * F.col("n_docs")).alias("n_docs")), "line_changes")
        # only the keys of these documents are looked up
        before = None
        for p in self.parts:
            own = p.join(change.select("key"), "key", "left_semi")
            before = own if before is None else before.unionByName(own)
        before = before.groupBy("key").agg(F.sum("n_docs").alias("before"))
        moved = change.join(before, "key", "left").select("key", F.coalesce("before", F.lit(0)).alias("before"), F.expr("coalesce(before, 0) + n_docs").alias("after"))
        least = F.lit(self.min_docs)
        moved = materialize(moved.filter((F.col("after") < 0) | ((F.col("before") >= least) != (F.col("after") >= least))).select("key", "after", _shard(F.col("key"), self.shards).alias("shard")), "moved")
        if not moved.filter("after < 0").isEmpty():
            raise ValueError("documents to delete hold lines that were never inserted that often")
        moved = moved.select("shard", "key", (F.col("after") >= least).alias("up"))
        frequent = self.frequent.join(moved.filter("not up").select("key"), "key", "left_anti").unionByName(moved.filter("up").select("key"))
        frequent = materialize(frequent, "frequent")
        ship(docs.sparkSession.sparkContext)
        touched = moved.select("shard").distinct()
        old = self.filters.join(touched, "shard", "left_semi")
        new = materialize(moved.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(_updated, "shard int, filter binary"), "new_filters")
        full = new.filter("filter is null").select("shard")
        filters = self.filters.join(touched, "shard", "left_anti").unionByName(new.filter("filter is not null"))
        if not full.isEmpty():
            keys = frequent.withColumn("shard", _shard(F.col("key"), self.shards)).join(full, "shard", "left_semi").select("key")
            filters = filters.unionByName(_built(keys, self.shards))
        parts = [*self.parts, change]
        out = LineIndex(parts, frequent, materialize(filters, "filters"), self.shards, self.min_docs, self.min_length)
        discard(new)
        if len(parts) > MOST_CHANGES:
            out.parts = [materialize(out.counts, "line_counts")]
        return out

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index after these documents came."""
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index after these documents, inserted before, went."""
        return self._changed(docs, -1)

    def groups(self, group_bytes: int = GROUP_BYTES) -> list[list[int]]:
        """Shards in groups whose filters fit one broadcast."""
        out: list[list[int]] = []
        room = 0
        for r in self.filters.select("shard", F.octet_length("filter").alias("b")).orderBy("shard").toLocalIterator():
            if not out or r.b > room:
                out.append([])
                room = group_bytes
            out[-1].append(r.shard)
            room -= r.b
        return out

    def drop_lines(self, docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
        """``docs`` with text without the lines whose key is frequent, n_lines (before) and n_dropped."""
        sc = docs.sparkSession.sparkContext
        shards, short = self.shards, self.min_length
        tagged = put(docs, _text_key=F.unhex(F.md5(text_or_empty().cast("binary"))))
        groups, asked = self.groups(group_bytes), None
        for group in groups:
            filters = sc.broadcast({r.shard: bytes(r.filter) for r in self.filters.filter(F.col("shard").isin(group)).collect()})
            found = _candidates(tagged.select("_text_key", "text"), filters, shards, short)
            if len(groups) > 1:
                found = materialize(found, "candidates")
                filters.unpersist()
            asked = found if asked is None else asked.unionByName(found)
        if asked is None:
            return _without(put(tagged, _lines=F.array().cast("array<int>")))
        true = asked.join(self.frequent.select("key"), "key", "left_semi")
        # texts that are equal lose the same lines. The table is written, so that the join below has two plain exchanges and the
        # copies of a frequent text can be split over tasks
        lines = materialize(true.groupBy("_text_key").agg(F.array_sort(F.collect_set("line")).alias("_lines")).withColumnRenamed("_text_key", "_text_key2"), "lines")
        return _without(tagged.join(lines, F.col("_text_key") == F.col("_text_key2"), "left").drop("_text_key2"))


def _built(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, filter) of these keys."""

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        made = CuckooFilter.of(np.sort(_first8(table.column("key"))))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([made.to_bytes()], pa.binary())})

    ship(keys.sparkSession.sparkContext)
    return keys.select(_shard(F.col("key"), shards).alias("shard"), "key").groupBy("shard").applyInArrow(build, "shard int, filter binary")


def _updated(moved: pa.Table, old: pa.Table) -> pa.Table:
    """The filter of a shard after keys came (up) and went; null if it has no place for them."""
    up = moved.column("up").to_numpy(zero_copy_only=False).astype(bool)
    keys = _first8(moved.column("key"))
    filter_ = CuckooFilter.from_bytes(old.column("filter")[0].as_py()) if old.num_rows else CuckooFilter(int(up.sum()))
    raw: bytes | None = None
    try:
        filter_.delete(keys[~up])
        filter_.insert(np.sort(keys[up]))
        raw = filter_.to_bytes()
    except OverflowError:
        pass
    return pa.table({"shard": moved.column("shard").slice(0, 1).cast(pa.int32()), "filter": pa.array([raw], pa.binary())})


def _first8(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = b"".join(x[:8] for x in column.to_pylist())
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def _shard(key, shards: int):
    """Shard of a digest, from bytes that the filters do not use."""
    return (F.conv(F.hex(F.substring(key, 13, 4)), 16, 10).cast("long") % shards).cast("int")


def _candidates(texts: DataFrame, filters, shards: int, short: int) -> DataFrame:
    """(_text_key, line, key) of lines to which a filter says yes; equal texts within a batch ask once."""
    schema = "_text_key binary, line int, key binary"

    def run(batches):
        sets = {s: CuckooFilter.from_bytes(f) for s, f in filters.value.items()}
        for batch in batches:
            who, line, key = [], [], []
            asked: set[bytes] = set()
            for t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t in asked:
                    continue
                asked.add(t)
                known: dict[str, bytes] = {}
                for i, raw in enumerate((text or "").split("\n")):
                    k = line_key(raw)
                    if len(k) >= short:
                        who.append(t)
                        line.append(i)
                        key.append(known.get(k) or known.setdefault(k, _digest(k)))
            if not key:
                continue
            whole = np.frombuffer(b"".join(key), np.dtype([("a", ">u8"), ("b", ">u4"), ("c", ">u4")]))
            first, shard = whole["a"].astype(np.uint64), whole["c"].astype(np.int64) % shards
            yes = np.zeros(len(key), bool)
            for s, f in sets.items():
                own = np.flatnonzero(shard == s)
                if len(own):
                    yes[own] = f.contains(first[own])
            at = np.flatnonzero(yes).tolist()
            if at:
                yield pa.RecordBatch.from_arrays([pa.array([who[i] for i in at], pa.binary()), pa.array([line[i] for i in at], pa.int32()), pa.array([key[i] for i in at], pa.binary())], names=["_text_key", "line", "key"])

    return map_arrow(texts, run, schema)


def _without(docs: DataFrame) -> DataFrame:
    names = docs.schema.names
    text_at, lines_at = names.index("text"), names.index("_lines")
    fields = [T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        texts, before, gone = [], [], []
        for text, drop in zip(batch.column(text_at).to_pylist(), batch.column(lines_at).to_pylist(), strict=True):
            own = (text or "").split("\n")
            before.append(len(own))
            gone.append(len(drop or ()))
            if drop:
                out = set(drop)
                text = "\n".join(x for i, x in enumerate(own) if i not in out)
            texts.append(text)
        return [pa.array(texts, pa.string()), pa.array(before, pa.int64()), pa.array(gone, pa.int64())]

    return add_by_arrow(docs, fields, compute, drop=("_lines", "_text_key"))


def op7_cuckoo_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = LineIndex.build(docs).drop_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(text_or_empty().cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH l AS (
  SELECT k, doc_id, i, line, translate(trim(line, E' \\t\\n\\x0B\\x0C\\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT k, doc_id, unnest(x) AS line, unnest(generate_series(1, len(x))) AS i
        FROM (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
f AS (SELECT key FROM l WHERE length(key) >= {MIN_LENGTH} GROUP BY key HAVING count(DISTINCT k) >= {MIN_DOCS})
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM l LEFT JOIN f USING (key) GROUP BY k
"""
