"""Removal of benchmark passages: windows of training words against a broadcast hash set of benchmark n-grams.

Words are lower-cased (A-Z) runs of ASCII letters and digits and of all non-ASCII characters. The windows of the
benchmark items go to every worker as arrays: sorted 64-bit hashes, the item of each, and its place in the items' words; the
windows of a document are hashed batch by batch with numpy, looked up, and every hit is compared word by word before it counts.

The benchmark is broadcast only in groups of at most ``GROUP_BYTES`` of text (a window takes 28 bytes beside the text, so a
group holds at most about 14 times its text, when all words are of one letter, and 5 times for ordinary words); a larger one is
worked off in several rounds, each reading the marks of the former, so no broadcast grows with the data.

Defined results: null texts and texts without words have no words and no hits; an item with fewer words than a window
is one window; an item without words never occurs; repeated items all count, by their ids; an empty benchmark or
table gives no hits; input columns named like a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import add_by_arrow, shielded
from .storage import discard, materialize
from .tokens import ALNUM, buffers, lowered, windows, words

WINDOW = 10
GROUP_BYTES = 16 << 20
_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
]


class NgramSet:
    """Windows of benchmark items: for every window length the sorted hashes, and the item and the bytes of each."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        self.size, self.names = size, [i for i, _ in items]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        column = pa.array([t for _, t in items], pa.string())
        data, _ = buffers(column)
        said, found, before = [], {}, 0
        for w in words(column, ALNUM):
            if not len(w.hash):
                continue
            length = w.end - w.start
            place = np.cumsum(length + 1) - (length + 1)
            text = np.append(data, np.uint8(32))[np.repeat(w.start - place, length + 1) + np.arange(int((length + 1).sum()))]
            text[place + length] = 32
            said.append(_LOWER[text])
            per = np.bincount(w.doc - w.first, minlength=w.last - w.first)
            for n in np.unique(np.minimum(per[per > 0], size)).tolist():
                h = windows(w.hash, n)
                i = np.flatnonzero((w.doc[: len(h)] == w.doc[n - 1 :]) & (np.minimum(per, size)[w.doc[: len(h)] - w.first] == n))
                found.setdefault(n, []).append((h[i], w.doc[i].astype(np.int32), place[i] + before, place[i + n - 1] + length[i + n - 1] + before))
            before += len(text)
        self.text = np.concatenate([*said, np.zeros(0, np.uint8)])
        for n, parts in found.items():
            h, item, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.by_length[n] = h[order], item[order], start[order], end[order]
        self._bits: dict[int, np.ndarray] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_bits": None}

    def bits(self, n: int) -> np.ndarray:
        """A bitmap of hash prefixes, made once in a process."""
        self._bits = {} if self._bits is None else self._bits
        if n not in self._bits:
            self._bits[n] = _bitmap(self.by_length[n][0])
        return self._bits[n]

    def items(self, n: int, h: np.uint64, own: bytes) -> set[int]:
        """Items with this window."""
        table, item, start, end = self.by_length[n]
        lo, hi = np.searchsorted(table, h), np.searchsorted(table, h, "right")
        return {int(item[k]) for k in range(lo, hi) if self.text[start[k] : end[k]].tobytes() == own}


_LOWER = np.frombuffer(lowered(bytes(range(256))), np.uint8)


def _joined(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(lowered(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


def _member(h: np.ndarray, table: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Positions whose hash is in the sorted table; a bitmap of hash prefixes turns nearly all others away first."""
    maybe = np.flatnonzero(bits[h >> np.uint64(44)])
    at = np.searchsorted(table, h[maybe])
    at[at == len(table)] = 0
    return maybe[table[at] == h[maybe]]


def _bitmap(table: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[table >> np.uint64(44)] = True
    return bits


def _scan(column: pa.Array, grams: NgramSet):
    """For each text: words, and the (start, end) bytes of merged hits and item numbers."""
    data, offsets = buffers(column)
    n_words, n_hit = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    items: list[set[int]] = [set() for _ in range(len(column))]
    spans: list[list[list[int]]] = [[] for _ in range(len(column))]
    for w in words(column, ALNUM):
        n_words[w.first : w.last] = np.bincount(w.doc - w.first, minlength=w.last - w.first)
        marks = np.zeros(len(w.hash) + 1, np.int64)
        for n, (table, *_) in grams.by_length.items():
            h = windows(w.hash, n)
            for i in _member(h, table, grams.bits(n)).tolist():
                d = int(w.doc[i])
                if d != w.doc[i + n - 1]:
                    continue
                own = _joined(data[w.start[i] : w.end[i + n - 1]].tobytes(), w.start[i : i + n] - w.start[i], w.end[i : i + n] - w.start[i])
                who = grams.items(n, h[i], own)
                if who:
                    marks[i] += 1
                    marks[i + n] -= 1
                    items[d] |= who
        hit = np.cumsum(marks[:-1]) > 0
        if hit.any():
            at = np.flatnonzero(hit)
            n_hit[w.first : w.last] += np.bincount(w.doc[at] - w.first, minlength=w.last - w.first)
            for i in at.tolist():
                d = int(w.doc[i])
                a, b = int(w.start[i] - offsets[d]), int(w.end[i] - offsets[d])
                own = spans[d]
                if own and i and hit[i - 1] and w.doc[i - 1] == d:
                    own[-1][1] = b
                else:
                    own.append([a, b])
    return n_words, n_hit, items, spans


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside hits), item_ids (sorted as strings) and spans (bytes of the UTF-8 text
    covered by hits, merged)."""
    if window < 1:
        raise ValueError("a window has at least one word")
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"), F.octet_length(F.coalesce("text", F.lit(""))).alias("b"))
    total = items.agg(F.coalesce(F.sum(F.col("b") + 64), F.lit(0))).first()[0]
    rounds = max(1, -(-total // group_bytes) * 2 if total > group_bytes else 1)
    at = docs.schema.names.index("text")
    sc = docs.sparkSession.sparkContext
    out = docs
    for r in range(rounds):
        part = items if rounds == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(rounds)) == r)
        grams = sc.broadcast(NgramSet([(x.i if x.i is not None else "", x.t) for x in part.select("i", "t").collect()], window))
        last, out = out, _round(out, at, grams, r)
        if r + 1 < rounds:
            out = materialize(out, "marks")
            grams.unpersist()
            if r:
                discard(last)
    return out


def _round(out: DataFrame, at: int, grams, number: int) -> DataFrame:
    names = out.schema.names
    before = [names.index(f.name) for f in _FIELDS] if number else []
    at = names.index("text")

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        g = grams.value
        n_words, n_hit, items, spans = _scan(batch.column(at), g)
        ids = [sorted({g.names[k] for k in x}) for x in items]
        if before:
            ids = [sorted({*x, *y}) for x, y in zip(ids, batch.column(before[2]).to_pylist(), strict=True)]
            spans, n_hit = _merged(batch.column(at), spans, batch.column(before[3]).to_pylist())
        return [pa.array(n_words), pa.array(n_hit), pa.array(ids, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int64())))]

    return add_by_arrow(out, _FIELDS, compute)


def _merged(column: pa.Array, new: list, old: list) -> tuple[list, np.ndarray]:
    """Unions of hit spans of two rounds, and the number of words inside them."""
    data, offsets = buffers(column)
    out, n = [], np.zeros(len(new), np.int64)
    for w in words(column, ALNUM):
        for d in range(w.first, w.last):
            lo, hi = np.searchsorted(w.doc, [d, d + 1])
            starts, ends = w.start[lo:hi] - offsets[d], w.end[lo:hi] - offsets[d]
            hit = np.zeros(len(starts), bool)
            for a, b in [*new[d], *old[d]]:
                hit |= (starts >= a) & (ends <= b)
            n[d] = hit.sum()
            merged: list[list[int]] = []
            for i in np.flatnonzero(hit).tolist():
                if merged and i and hit[i - 1]:
                    merged[-1][1] = int(ends[i])
                else:
                    merged.append([int(starts[i]), int(ends[i])])
            out.append(merged)
    return out, n


def remove_contamination(docs: DataFrame, benchmark: DataFrame, whole_documents: bool = True, **options) -> DataFrame:
    """``docs`` without documents that hold a benchmark window, or with just the hit passages cut out of ``text``."""
    if whole_documents:
        return shielded(docs, lambda own: find_contamination(own, benchmark, **options).filter("n_hit = 0"))
    return shielded(docs, lambda own: _cut(find_contamination(own, benchmark, **options)))


def _cut(found: DataFrame) -> DataFrame:
    at, spans = found.schema.names.index("text"), found.schema.names.index("spans")

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for text, cuts in zip(batch.column(at).to_pylist(), batch.column(spans).to_pylist(), strict=True):
            if cuts:
                raw, kept, last = text.encode(), [], 0
                for a, b in cuts:
                    kept.append(raw[last:a])
                    last = b
                text = b"".join([*kept, raw[last:]]).decode()
            out.append(text)
        return [pa.array(out, pa.string())]

    return add_by_arrow(found, [T.StructField("text", T.StringType())], compute)


def op3_ngram_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS i, {_SQL_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT i, least({WINDOW}, len(w)) AS n, array_to_string(w[j : j + least({WINDOW}, len(w)) - 1], ' ') AS x
      FROM b, LATERAL (SELECT unnest(generate_series(1, len(w) - least({WINDOW}, len(w)) + 1)) AS j) WHERE len(w) > 0),
n AS (SELECT DISTINCT n FROM g),
o AS (SELECT k, j, n.n, array_to_string(w[j : j + n.n - 1], ' ') AS x
      FROM d, n, LATERAL (SELECT unnest(generate_series(1, len(w) - n.n + 1)) AS j) WHERE len(w) >= n.n),
h AS (SELECT o.k, o.j, o.n, g.i FROM o JOIN g ON o.n = g.n AND o.x = g.x),
c AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(generate_series(j, j + n - 1)) AS p FROM h) GROUP BY k),
m AS (SELECT k, count(DISTINCT i) AS n_items, string_agg(DISTINCT i, ',' ORDER BY i) AS ids FROM h GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN m USING (k)
"""
