"""Toxicity by compression distance: one zstandard dictionary of toxic text, one of ordinary text.

Both are trained by zstandard's own trainer on the labelled documents of their class. Most of a toxic document is ordinary text,
and a dictionary of it would hold little else; so the toxic documents are cut, before training, to the runs of characters whose
5-grams set toxic documents apart (a log-likelihood ratio over documents, corrected for the number of grams looked at).
A third dictionary, trained on ordinary text too, is the body that both share, so that text known to either side costs the same;
ordinary training windows that the toxic dictionary still shortens are added to that body, for a few rounds.

A document is read in windows of ``WINDOW`` words. Every window is compressed with either dictionary, and the difference of
the two lengths is what toxic text would explain. The best differences of a document and its number of windows decide,
through weights and a threshold calibrated on labelled documents that trained no dictionary.

The sample for fitting has at most ``SAMPLE`` documents of each label of at most ``SAMPLE_BYTES``; scoring reads every
whole text.

Defined results: null and empty texts get the score of a text without any saving; several labels of an id count as
toxic if one is; without labels of both kinds, among the training and among the calibrating documents, or if nothing sets
them apart, every score is the share of toxic labels (0 without labels) and the filter drops nothing; too little text for the
trainer is taken as the dictionary as it is; an empty table gives an empty result; input columns named like a result column
are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import add_by_arrow, remainder, shielded
from .tokens import ALNUM, buffers, words

SAMPLE, SAMPLE_BYTES = 2000, 1 << 17
#: Words of a window, and bytes of a part of a very long one.
WINDOW, PART = 8, 512
#: Bytes of the class dictionaries, of the shared body, and of what a round adds to it.
CLASS_BYTES, BODY_BYTES, ROUND_BYTES, ROUNDS = 4 << 10, 64 << 10, 32 << 10, 12
THRESHOLD = 0.3
_GRAM = 5
#: Around every text: a lead both dictionaries end with, so that very short texts give exact lengths, and a tail; a window
#: is compressed with the ``_AFTER`` bytes that follow it, as a match never begins in the last bytes.
_LEAD, _TAIL = (hashlib.sha256(x).hexdigest()[:n] for x, n in ((b"lead", 40), (b"tail", 10)))
_AFTER = 1 + len(_TAIL)
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class _Sizer:
    """Compressed lengths of segments of a buffer with one dictionary."""

    def __init__(self, content: bytes):
        parameters = zstandard.ZstdCompressionParameters(compression_level=1, strategy=zstandard.STRATEGY_FAST, window_log=19, hash_log=20, min_match=5, target_length=0, write_content_size=False, write_checksum=False, write_dict_id=False)
        trained = zstandard.ZstdCompressionDict(content + _LEAD.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        trained.precompute_compress(compression_params=parameters)
        self.compress = zstandard.ZstdCompressor(dict_data=trained, compression_params=parameters).multi_compress_to_buffer

    def __call__(self, buffer: bytes, segments: bytes) -> np.ndarray:
        return np.array([len(x) for x in self.compress(zstandard.BufferWithSegments(buffer, segments), threads=1)], np.int64)


def normalised(column: pa.Array) -> pa.Array:
    """Lower-cased words with one blank between, and the lead and the tail around each text."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(column.cast(pa.string()), "")), _GAP, " ")
    return pc.binary_join_element_wise(_LEAD, plain, _TAIL, " ")


def window_edges(column: pa.Array):
    """(bytes, text, start, end) of the windows of normalised texts, in groups of whole texts."""
    data, offsets = buffers(column)
    for w in words(column, ALNUM):
        own = np.ones(len(w.hash), bool)  # the lead and the tail are no words of the text
        own[np.searchsorted(w.doc, np.arange(w.first, w.last))] = False
        own[np.searchsorted(w.doc, np.arange(w.first, w.last), "right") - 1] = False
        doc, start, end = w.doc[own], w.start[own], w.end[own]
        if not len(doc):
            continue
        place = np.arange(len(doc)) - np.searchsorted(doc, doc)
        first = np.flatnonzero(place % WINDOW == 0)
        last = np.append(first[1:], len(doc)) - 1
        d, a, b = doc[first], start[first], end[last]
        a = np.where(place[first] == 0, offsets[d], a - 1)  # the first window has the lead
        b = np.minimum(b + _AFTER, offsets[d + 1])
        for k in np.flatnonzero(b - a > PART).tolist():  # rare: parts of very long words
            cuts = np.arange(a[k], b[k] - 16, PART - 16)
            d, a, b = np.append(d, np.full(len(cuts) - 1, d[k])), np.append(a, cuts[1:]), np.append(b, np.minimum(cuts[1:] + PART, b[k]))
            b[k] = a[k] + PART
        base = int(offsets[w.first])
        yield data[base : int(offsets[w.last])], d, a - base, b - base


class Distance:
    """Bytes that the toxic dictionary saves over the ordinary one, window by window."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.contents = (ordinary, toxic)
        self._sizers = None

    def __getstate__(self):
        return self.contents

    def __setstate__(self, contents):
        self.__init__(*contents)

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self._sizers is None:
            self._sizers = tuple(_Sizer(c) for c in self.contents)
        buffer, segments = data.tobytes(), np.stack([start, end - start], axis=1).astype(np.uint64).tobytes()
        return self._sizers[0](buffer, segments) - self._sizers[1](buffer, segments)


def _grams(word: bytes) -> list[bytes]:
    x = b" " + word + b" "
    return [x[i : i + _GRAM] for i in range(len(x) - _GRAM + 1)]


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary of about ``size`` bytes by zstandard's trainer; where there is too little text for it, the text itself."""
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b" ".join(dict.fromkeys(samples))[-CLASS_BYTES:]


def telling(toxic: list[set[bytes]], ordinary: list[set[bytes]]) -> dict[bytes, bool]:
    """5-grams whose documents are toxic more often than the labels' shares explain, and whether that is beyond doubt, so
    that they are never taken for ordinary where a label is wrong."""
    n, m = len(toxic), len(ordinary)
    bad, good = Counter(g for d in toxic for g in d), Counter(g for d in ordinary for g in d)
    share = n / (n + m)
    looked = math.log(1 + sum(c >= 3 for c in bad.values()))
    out = {}
    for g, c in bad.items():
        o = good[g]
        if c >= 3 and c / (c + o) >= (1 + share) / 2:
            proof = c * math.log(c / ((c + o) * share)) + (o * math.log(o / ((c + o) * (1 - share))) if o else 0.0)
            if proof > looked + 3:
                out[g] = proof > 2 * (looked + 3)
    return out


def _runs(word: bytes, found: dict[bytes, bool]) -> list[bytes]:
    """The parts of a word that telling grams cover."""
    x, at = b" " + word + b" ", []
    for i in range(len(x) - _GRAM + 1):
        if x[i : i + _GRAM] in found:
            if at and i <= at[-1][1]:
                at[-1][1] = i + _GRAM
            else:
                at.append([i, i + _GRAM])
    return [x[a:b] for a, b in at]


def train_distance(toxic: list[str], ordinary: list[str]) -> Distance | None:
    """Dictionaries from toxic and from ordinary texts; null if nothing sets them apart."""
    gap = re.compile(_GAP)
    split = lambda t: [w for w in gap.sub(" ", t.lower()).encode().split(b" ") if w]
    said = {k: [split(t) for t in texts] for k, texts in ((1, toxic), (0, ordinary))}
    found = telling(*([{g for w in set(d) for g in _grams(w)} for d in said[k]] for k in (1, 0)))
    samples = [b" ".join(r for w in dict.fromkeys(d) for r in _runs(w, found)) for d in said[1]]
    samples = [s for s in samples if s]
    if not samples:
        return None
    plain = [b" ".join(d) for d in said[0]]
    own, other = trained(samples, CLASS_BYTES, 32), trained(plain, CLASS_BYTES, 32)
    shared = trained(plain, BODY_BYTES, 64)
    size = max(len(own), len(other))
    own, other = own.rjust(size), other.rjust(size)  # both at the same distance from the text
    windows = list(window_edges(normalised(pa.array(ordinary, pa.string()))))
    for _ in range(ROUNDS):
        distance = Distance(other + shared, own + shared)
        hard: Counter = Counter()
        for data, _, start, end in windows:
            saved = distance(data, start, end)
            for i in np.flatnonzero(saved >= 2).tolist():
                x = data[start[i] : end[i]].tobytes()
                if not any(found.get(x[j : j + _GRAM]) for j in range(len(x) - _GRAM + 1)):
                    hard[x] = int(saved[i])
        if not hard:
            break
        shared = b" ".join(sorted(hard, key=lambda x: (-hard[x], x)))[:ROUND_BYTES] + b" " + shared
    return Distance(other + shared, own + shared)


class Model:
    """Distance, and the logistic weights on the best savings and the number of windows."""

    def __init__(self, distance: Distance | None, weights: np.ndarray):
        self.distance, self.weights = distance, weights

    def features(self, column: pa.Array) -> np.ndarray:
        """Of each text: the best saving, the next, the two after together, and the logarithm of the number of windows."""
        out = np.zeros((len(column), 4))
        for data, doc, start, end in window_edges(normalised(column)):
            saved = self.distance(data, start, end)
            np.add.at(out[:, 3], doc, 1)
            at = np.flatnonzero(saved > 0)
            at = at[np.lexsort((-saved[at], doc[at]))]
            rank = np.arange(len(at)) - np.searchsorted(doc[at], doc[at])
            at, rank = at[rank < 4], rank[rank < 4]
            np.add.at(out, (doc[at], np.minimum(rank, 2)), saved[at])
        out[:, 3] = np.log1p(out[:, 3])
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.distance is None:
            return np.full(len(column), float(self.weights[0]))
        z = self.weights[0] + self.features(column) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrate(features: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge; saved bytes never count against toxicity."""
    x = np.concatenate([np.ones((len(features), 1)), features], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, 0.05, 0.05, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (toxic - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    w[1:4] = np.maximum(w[1:4], 0)
    return w


def model_of(rows: list[tuple[int, int, str]]) -> Model:
    """A model from (toxic, remainder, text): remainders 0 and 1 train the dictionaries, 3 calibrates."""
    rows = sorted(rows)
    share = sum(r[0] for r in rows) / len(rows) if rows else 0.0
    bad, good = ([r[2] for r in rows if r[0] == k and r[1] != 3] for k in (1, 0))
    held = [r for r in rows if r[1] == 3]
    distance = train_distance(bad, good) if bad and good and len({r[0] for r in held}) == 2 else None
    if distance is None:
        return Model(None, np.array([share]))
    model = Model(distance, np.zeros(5))
    model.weights = calibrate(model.features(pa.array([r[2] for r in held], pa.string())), np.array([float(r[0]) for r in held]))
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled documents whose crc32 remainder by 4 is not 2."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    part = remainder("doc_id", 4)
    ids = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("b")).filter(F.col("doc_id").isNotNull() & (part != 2) & (F.col("b") <= SAMPLE_BYTES)).select("doc_id").join(marks, "doc_id")
    counts = {r.toxic: r["count"] for r in ids.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    if not counts.get(0) or not counts.get(1):
        return Model(None, np.array([counts.get(1, 0) / total if total else 0.0]))
    # the share of ids that gives at most `sample` documents of each label, by a fixed hash of the id
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30))
    keep = F.lit(False)
    for label, n in counts.items():
        keep = keep | ((F.col("toxic") == label) & (draw < int((1 << 30) * min(1.0, 0.9 * sample / n))))
    # about 1.8 x sample ids, repeated ones once; the limit, in an order of their own, is the proof that they may be broadcast
    drawn = ids.filter(keep).distinct().orderBy(draw, "doc_id").limit(4 * sample)
    few = docs.select("doc_id", "text").filter((part != 2) & (F.octet_length("text") <= SAMPLE_BYTES)).join(F.broadcast(drawn), "doc_id").select("toxic", part.cast("int").alias("part"), "text").distinct()
    got = few.toArrow()
    return model_of(list(zip(*(got.column(i).to_pylist() for i in range(3)), strict=True)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1, higher is more likely toxic) and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.schema.names.index("text")

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        p = shared.value.scores(batch.column(at))
        return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

    return add_by_arrow(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], compute)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents predicted toxic; all of them where the labels gave no model to tell them apart."""
    if model.distance is None:
        return docs
    return shielded(docs, lambda own: score(own, model, threshold).filter("predicted = 0"))


def op10_compression_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
