"""Language identification, word first, with back-off to character n-grams.

Counts of words and of character n-grams by language come from labelled documents. A text is scored word by word: a
word known in any language gives each language its log relative frequency (a fixed penalty where it is unknown); an
unknown word is cut into n-grams of the longest length, and if none of them is known, of the next shorter one, down to
single characters; the scores of its known n-grams are averaged. A language's score is the mean over all words.

Words are runs of letters and marks, lower-cased. The sample for fitting has at most ``SAMPLE`` documents of each language of
at most ``SAMPLE_BYTES``. The tables keep ``WORDS`` words, and ``GRAMS`` n-grams of each length, found at least ``LEAST`` times
(together over all languages); every language has an equal share of them for its own commonest, so a model has a bounded size
and no language takes another's room. Prediction reads every whole text; scores of words are kept by a 64-bit hash of the word.

Defined results: a text without letters, a null text and any text under a model without languages is ``und`` with
score 0; ties go to the first language in code point order; the score is the probability that the word scores give the
predicted language (a softmax over at most ``EVIDENCE`` words of evidence); input columns named like a result column are
replaced.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import add_by_arrow, map_arrow, remainder
from .tokens import _table, buffers, words

SAMPLE, SAMPLE_BYTES = 2000, 1 << 20
WORDS, GRAMS, LONGEST, LEAST = 100_000, 100_000, 4, 2
EVIDENCE, _CACHE = 12, 1 << 20
#: ASCII letters and all non-ASCII code points; what is no letter or mark among these was made a blank before.
_LETTERS = _table(lambda b: b < 0x80 and not chr(b).isalpha())


def normalised(column: pa.Array) -> pa.Array:
    """Lower case, and a blank for every non-ASCII code point that is no letter or mark."""
    lower = pc.utf8_lower(pc.fill_null(column.cast(pa.string()), ""))
    return pc.replace_substring_regex(lower, r"[^\pL\pM\x00-\x7f]+", " ")


def grams(word: str, n: int) -> list[str]:
    x = f" {word} "
    return [x[i : i + n] for i in range(len(x) - n + 1)]


class Model:
    """Relative log frequencies of words and n-grams by language."""

    def __init__(self, languages: list[str], known: dict[str, np.ndarray], pieces: dict[int, dict[str, np.ndarray]]):
        self.languages, self.known, self.pieces = languages, known, pieces
        self._keys = None

    def __getstate__(self):
        return self.languages, self.known, self.pieces

    def __setstate__(self, state):
        self.__init__(*state)

    @classmethod
    def of_counts(cls, by_word: dict[str, Counter]) -> Model:
        """From counts of words for each language."""
        languages = sorted(by_word)
        if not languages:
            return cls([], {}, {})

        def logs(tables: list[Counter], most: int) -> dict[str, np.ndarray]:
            whole = Counter()
            for t in tables:
                whole.update(t)
            kept: dict[str, None] = {}
            for t in tables:  # every language's commonest
                kept |= dict.fromkeys(heapq.nsmallest(-(-most // len(tables)), (w for w in t if whole[w] >= LEAST), key=lambda w: (-t[w], w)))
            sums = np.array([max(1, sum(t.values())) for t in tables], float)
            unseen = np.log10(sums) + 1  # as if found a tenth of a time
            out = {}
            for w in kept:
                c = np.array([t[w] for t in tables], float)
                out[w] = np.where(c > 0, np.log10(np.maximum(c, 1) / sums), -unseen).astype(np.float32)
            return out

        known = logs([by_word[k] for k in languages], WORDS)
        pieces = {}
        for n in range(LONGEST, 0, -1):
            tables = []
            for k in languages:
                t: Counter = Counter()
                for w, c in by_word[k].items():
                    for g in grams(w, n):
                        t[g] += c
                t.pop(" ", None)
                tables.append(t)
            pieces[n] = logs(tables, GRAMS)
        return cls(languages, known, pieces)

    def word(self, w: str) -> np.ndarray | None:
        """Scores of a word by language; None if not even a character is known."""
        own = self.known.get(w)
        if own is not None:
            return own
        for n in range(LONGEST, 0, -1):
            found = [self.pieces[n][g] for g in grams(w, n) if g in self.pieces[n]]
            if found:
                return np.mean(found, axis=0)
        return None

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        k, n = len(self.languages), len(column)
        if not k:
            return ["und"] * n, np.zeros(n)
        if self._keys is None:  # a direct-mapped cache of word scores, bounded and per process
            self._keys, self._rows = np.zeros(_CACHE, np.uint64), np.zeros((_CACHE, k), np.float32)
        clean = normalised(column)
        data, _ = buffers(clean)
        total, count, letters = np.zeros((n, k)), np.zeros(n), np.zeros(n, bool)
        letters[:] = pc.match_substring_regex(clean, r"\pL").to_numpy(zero_copy_only=False)
        for w in words(clean, _LETTERS):
            if not len(w.hash):
                continue
            unique, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
            rows = self._lookup(unique, at, w, data)
            has = ~np.isnan(rows[:, 0])
            mine = w.doc - w.first
            for j in range(k):
                total[w.first : w.last, j] = np.bincount(mine, weights=np.where(has, rows[:, j], 0)[back], minlength=w.last - w.first)
            count[w.first : w.last] = np.bincount(mine, weights=has[back], minlength=w.last - w.first)
        mean = total / np.maximum(count, 1)[:, None]
        best = mean.argmax(1)
        z = (mean - mean.max(1, keepdims=True)) * np.log(10) * np.minimum(count, EVIDENCE)[:, None]
        p = 1 / np.exp(z).sum(1)
        return [self.languages[b] if x else "und" for b, x in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters, p, 0.0)

    def _lookup(self, unique: np.ndarray, at: np.ndarray, w, data: np.ndarray) -> np.ndarray:
        slot = (unique >> np.uint64(11)).astype(np.int64) & (_CACHE - 1)
        rows = self._rows[slot]
        new = np.flatnonzero(self._keys[slot] != unique)
        for i, a, b in zip(new.tolist(), w.start[at[new]].tolist(), w.end[at[new]].tolist(), strict=True):
            own = self.word(data[a:b].tobytes().decode())
            rows[i] = np.nan if own is None else own
        self._keys[slot[new]], self._rows[slot[new]] = unique[new], rows[new]
        return rows


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from documents with a language whose crc32 remainder by 4 is not 2."""
    train = docs.filter(F.col("lang").isNotNull() & (remainder("doc_id", 4) != 2) & (F.octet_length(F.coalesce("text", F.lit(""))) <= SAMPLE_BYTES))
    counts = {r.lang: r["count"] for r in train.groupBy("lang").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30))
    keep = F.lit(False)
    for lang, n in counts.items():
        keep = keep | ((F.col("lang") == lang) & (draw < int((1 << 30) * min(1.0, 0.9 * sample / n))))
    few = train.filter(keep).select("lang", "text")

    def count_words(batches):
        for b in batches:
            by: dict[str, Counter] = {}
            clean = normalised(b.column(1))
            data, _ = buffers(clean)
            langs = b.column(0).to_pylist()
            for w in words(clean, _LETTERS):
                for d in range(w.first, w.last):
                    lo, hi = np.searchsorted(w.doc, [d, d + 1])
                    by.setdefault(langs[d], Counter()).update(data[x:y].tobytes() for x, y in zip(w.start[lo:hi].tolist(), w.end[lo:hi].tolist(), strict=True))
            rows = [(k, w.decode(), n) for k, c in by.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    table = map_arrow(few, count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # about 2 x WORDS rows come to the driver, however many languages there are: an equal share of each, the commonest first
    share = max(1, 2 * WORDS // max(1, len(counts)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    table = table.withColumn("_rank", rank).filter(F.col("_rank") <= share)
    by_word: dict[str, Counter] = {}
    for lang, word, n in zip(*table.select("lang", "word", "n").toArrow().to_pydict().values(), strict=True):
        by_word.setdefault(lang, Counter())[word] = n
    return Model.of_counts(by_word)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.schema.names.index("text")

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        said, p = shared.value.predict(batch.column(at))
        return [pa.array(said, pa.string()), pa.array(p)]

    return add_by_arrow(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], compute)


def op4_backoff_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
