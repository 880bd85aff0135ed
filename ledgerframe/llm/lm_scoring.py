"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation, in numpy.

Tokens are A-Z lower-cased words between white space, and one end for each text. Exact counts of all training tokens are
made block by block: a block is about ``BLOCK_BYTES`` of documents by hash, written as one row of a table; it sends each of its
distinct tokens once, and gets their corpus counts back for scoring; no table of all words has to fit anywhere.

The vocabulary grows with the corpus: its ``WORDS + GROW x sqrt(tokens)`` commonest words are classes of their own, and all
other words are dealt by hash over about a quarter as many classes, so every word tells as a context and as a target. A word of a
hash class has the probability of its class times its share (count + 1) of that class, with one share for unseen words.

The network scores a class after the two tokens before: the context's representation is ``C1 r(w1) + C2 r(w2)``, the score of
w is its product with ``q(w)`` plus a bias. Classes are put in about sqrt(classes) groups by rank, and groups are scored in
the same way. A token's probability is that of its group times that of its class among the group's classes; both are
normalised exactly, so token log-probabilities are. Training reads all training documents; every block runs noise-contrastive
steps for classes and groups with noise from the unigram distribution, and the parameters are averaged by tokens after each
round. Blocks and the order in them follow from the documents alone, so scores do not depend on partitions or cores.

Defined results: null and empty texts are one end; without training tokens every count is 0; repeated rows train and are
scored each (rows equal in id and text that are together larger than a block are dealt to blocks by their place in the input); an empty table gives an empty result; input columns named like a result column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .frames import map_arrow, put, remainder, ship, text_or_empty
from .storage import materialize, read_once
from .tokens import BLANK, words

WORDS, WIDTH, ROUNDS, BATCH, NOISE, RATE = 1024, 24, 2, 4096, 64, 0.3
GROW, CHUNK = 4, 1 << 18
#: Rows whose scores of all groups stay in a core's cache.
CACHED = 512
#: Most keys that begin with the same bits, for words to be looked up by these bits.
DEEP = 8
#: Bytes of a block; blocks, and their least bytes, where there is less text than so many of them would hold.
BLOCK_BYTES, FEW_BLOCKS, LEAST_BYTES = 16 << 20, 32, 4 << 20
FAN, FAN_BYTES = 64, 128 << 20
#: How blocks are written: every block is a row group of its own, where the writer would else gather 100 rows before it looks at
#: their size, and a codec that works through a stream, where the usual one holds whole pages in memory outside the heap, twice.
LAYOUT = {"compression": "zstd", "parquet.block.size": "1", "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
#: The end token's key; no word hashes are compared with it on purpose.
END = np.uint64(0xE4D0F7E8)


def token_keys(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row of each token, key of each token), ends included, for groups of whole texts."""
    for w in words(column, BLANK):
        n = w.last - w.first
        per = np.bincount(w.doc - w.first, minlength=n) + 1
        doc = np.repeat(np.arange(w.first, w.last), per)
        key = np.full(len(doc), END, np.uint64)
        key[np.arange(len(w.hash)) + (w.doc - w.first)] = w.hash
        yield w.first, doc, key


class Network:
    """Parameters of the log-bilinear model over ``keys`` (sorted), hash classes (n to n + hashed - 1) and end; the context after
    end is a text's start."""

    def __init__(self, keys: np.ndarray, noise: np.ndarray, seed: int = 7):
        v, rng = len(noise), np.random.default_rng(seed)
        self.keys, self.noise, self.hashed, self.starts = keys, noise, v - len(keys) - 1, None
        per = max(1, math.isqrt(v))
        #: Classes by rank; group g has those from g * per on.
        self.ranked = np.argsort(-noise, kind="stable")
        self.group = np.empty(v, np.int64)
        self.group[self.ranked] = np.arange(v) // per
        self.at = np.empty(v, np.int64)
        self.at[self.ranked] = np.arange(v) % per
        self.per = per
        self.group_noise = np.bincount(self.group, noise)
        self.r = rng.normal(0, 0.1, (v + 1, WIDTH)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (v, WIDTH)).astype(np.float32)
        self.c = np.stack([np.eye(WIDTH, dtype=np.float32)] * 2)
        self.b = np.log(noise).astype(np.float32)
        self.gq = rng.normal(0, 0.1, (len(self.group_noise), WIDTH)).astype(np.float32)
        self.gb = np.log(self.group_noise).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.r, self.q, self.c, self.b, self.gq, self.gb]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    def set_flat(self, x: np.ndarray) -> None:
        at = 0
        for p in self.parameters():
            p[...] = x[at : at + p.size].reshape(p.shape)
            at += p.size

    def classes(self, doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of each token, and of the two before it."""
        n, end = len(self.keys), len(self.noise) - 1
        own = n + (key & np.uint64(self.hashed - 1)).astype(np.int64)
        if n:
            at, deep = self._first(key)
            for _ in range(deep):
                found = np.flatnonzero(self.keys.take(at, mode="clip") == key)
                own[found] = np.minimum(at[found], n - 1)
                at += 1
        own[key == END] = end
        start = np.ones(len(doc), bool)
        start[1:] = doc[1:] != doc[:-1]
        one = np.concatenate([[end + 1], own[:-1]]).astype(np.int64)
        one[start] = end + 1
        two = np.concatenate([[end + 1], one[:-1]]).astype(np.int64)
        two[start] = end + 1
        return own, one, two

    def _first(self, key: np.ndarray) -> tuple[np.ndarray, int]:
        """Where each key would be first among ``keys``, and how many places from there on it may be at."""
        if self.starts is None:  # made where it is used, and not sent along
            self.bits = np.uint64(64 - min(24, len(self.keys).bit_length() + 2))
            self.starts = np.searchsorted(self.keys, np.arange(1 << 64 - int(self.bits), dtype=np.uint64) << self.bits)
            self.deep = int(np.diff(self.starts, append=len(self.keys)).max())
        return (np.searchsorted(self.keys, key), 1) if self.deep > DEEP else (self.starts.take(key >> self.bits), self.deep)

    def train(self, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], seed: int) -> int:
        """Noise-contrastive steps with Adagrad; returns the number of tokens."""
        rng, n = np.random.default_rng(seed), 0
        # biases are last columns, so a class and its bias are gathered, summed and moved together
        r, c, q, gq = self.r, self.c.reshape(2 * WIDTH, WIDTH), np.column_stack([self.q, self.b]), np.column_stack([self.gq, self.gb])
        r2, c2, q2, gq2 = (np.full(p.shape, 1e-2, np.float32) for p in (r, c, q, gq))
        levels = [(x, np.log(p * NOISE).astype(np.float32), np.cumsum(p)) for x, p in ((q, self.noise), (gq, self.group_noise))]
        place, step = np.empty(len(r), np.int64), np.float32(RATE * 0.1)
        for classes, one, two in batches:
            for lo in range(0, len(classes), BATCH):
                w, a, b = classes[lo : lo + BATCH], one[lo : lo + BATCH], two[lo : lo + BATCH]
                m = len(w)
                size, share = np.float32(math.sqrt(m)), np.float32(1 / m)
                x = np.concatenate([r.take(a, axis=0), r.take(b, axis=0)], axis=1)
                h1 = np.ones((m, WIDTH + 1), np.float32)
                np.matmul(x, c, out=h1[:, :WIDTH])
                wide = h1.T.astype(float)  # sums are made by columns, in 64 bits
                picked = [np.minimum(np.searchsorted(pick, rng.random(NOISE) * pick[-1]), len(pick) - 1) for _, _, pick in levels]
                noise = np.concatenate([p.take(k, axis=0) for (p, _, _), k in zip(levels, picked, strict=True)])
                noise[:, WIDTH] -= np.concatenate([log_noise[k] for (_, log_noise, _), k in zip(levels, picked, strict=True)])
                gh, down = np.empty((m, WIDTH), np.float32), np.zeros(noise.shape, np.float32)
                minus, back = np.ascontiguousarray(-noise.T), noise[:, :WIDTH] * -share
                for at in range(0, m, CACHED):
                    some = h1[at : at + CACHED]
                    bad = _rate(some @ minus)
                    np.matmul(bad, back, out=gh[at : at + CACHED])
                    down += bad.T @ some
                down *= -share
                moved = []
                for (p, log_noise, _), t, k, own in zip(levels, (w, self.group.take(w)), picked, (down[:NOISE], down[NOISE:]), strict=True):
                    pw = p.take(t, axis=0)
                    good = _rate(log_noise.take(t) - np.einsum("ij,ij->i", h1, pw))
                    good = (1 - good) * share
                    pw *= good[:, None]
                    gh += pw[:, :WIDTH]
                    at, (i, j) = _places(place, len(p), t, k)
                    g = _sums(i, wide, len(at), good.astype(float))
                    np.add.at(g, j, own)
                    moved.append((at, g))
                # the second word before is most often the first one of the token before, so both moves are those of one row
                by = gh @ c.T
                same = b[1:] == a[:-1]
                alone = np.concatenate([[0], np.flatnonzero(~same) + 1])
                rest = by[alone, WIDTH:]
                by[:-1, :WIDTH] += by[1:, WIDTH:] * same[:, None]
                at, (i, j) = _places(place, len(r), a, b[alone])
                g = _sums(i, by[:, :WIDTH].T.astype(float), len(at))
                np.add.at(g, j, rest)
                moved.append((at, g))
                g = x.T @ gh
                g *= size
                c2 += g * g
                c += step * g / np.sqrt(c2)
                for p, s, (at, g) in zip((q, gq, r), (q2, gq2, r2), moved, strict=True):
                    g *= size
                    own_s = s.take(at, axis=0)
                    own_s += g * g
                    s[at] = own_s
                    g *= step
                    g /= np.sqrt(own_s, out=own_s)
                    g += p.take(at, axis=0)
                    p[at] = g
                n += m
        self.q[...], self.b[...], self.gq[...], self.gb[...] = q[:, :WIDTH], q[:, WIDTH], gq[:, :WIDTH], gq[:, WIDTH]
        return n

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the groups by first and by second context token, and the log normaliser of every pair of them; its size
        is the square of the vocabulary's, so scoring does not use it."""
        one = self.r.astype(float) @ self.c[0] @ self.gq.T.astype(float) + self.gb
        two = self.r.astype(float) @ self.c[1] @ self.gq.T.astype(float)
        top1, top2 = one.max(1, keepdims=True), two.max(1, keepdims=True)
        z = np.log(np.exp(one - top1) @ np.exp(two - top2).T) + top1 + top2.T
        return one.astype(np.float32), two.astype(np.float32), z.astype(np.float32)

    def log_p(self, own: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each class after its two tokens, exactly normalised."""
        out = np.empty(len(own))
        first, second = self.r @ self.c[0], self.r @ self.c[1]
        gq, q = (np.ascontiguousarray(np.column_stack(x).T) for x in ((self.gq, self.gb), (self.q[self.ranked], self.b[self.ranked])))
        for lo in range(0, len(own), CHUNK):
            w, a, b = (x[lo : lo + CHUNK] for x in (own, one, two))
            order = np.argsort(self.group.take(w).astype(np.int32), kind="stable")
            w, a, b = w.take(order), a.take(order), b.take(order)
            group, place = self.group.take(w), self.at.take(w)
            h = np.ones((len(w), WIDTH + 1), np.float32)
            for at in range(0, len(w), BATCH):
                some = slice(at, at + BATCH)
                np.add(first.take(a[some], axis=0), second.take(b[some], axis=0), out=h[some, :WIDTH])
            p = _log_share(h, gq, group)
            edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                g = group[i]
                p[i:j] += _log_share(h[i:j], np.ascontiguousarray(q[:, g * self.per : (g + 1) * self.per]), place[i:j])
            out[lo + order] = p
        return out


def _log_share(h: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax of each row of ``h @ q`` at one column."""
    out, ones = np.empty(len(h)), np.ones(q.shape[1], np.float32)
    with np.errstate(over="ignore"):
        for lo in range(0, len(h), CACHED):
            some, own = h[lo : lo + CACHED], at[lo : lo + CACHED]
            scores = some @ q
            mine = scores[np.arange(len(own)), own].astype(float)
            total = (np.exp(scores, out=scores) @ ones).astype(float)
            if not 1e-30 < total.min() <= total.max() < 1e37:  # past the range of 32-bit numbers unless less the greatest
                scores = some.astype(float) @ q
                top = scores.max(1)
                mine, total = scores[np.arange(len(own)), own] - top, np.exp(scores - top[:, None]).sum(1)
            out[lo : lo + CACHED] = mine - np.log(total)
    return out


def _rate(x: np.ndarray) -> np.ndarray:
    """The logistic function of -x, in place; 0 where the exponential is past the range of 32-bit numbers."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _places(place: np.ndarray, n: int, *rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct rows of ``n``, in order, and where each row is among them; ``place`` is room for that."""
    found = np.zeros(n, bool)
    for x in rows:
        found[x] = True
    at = np.flatnonzero(found)
    place[at] = np.arange(len(at))
    return at, [place.take(x) for x in rows]


def _sums(at: np.ndarray, columns: np.ndarray, n: int, times: np.ndarray | None = None) -> np.ndarray:
    """The sums of ``columns`` (a row for each column of the result), each number ``times`` its row's, by place: ``n`` rows."""
    out = np.empty((len(columns), n), np.float32)
    for k, x in enumerate(columns):
        out[k] = np.bincount(at, x if times is None else x * times, n)
    return np.ascontiguousarray(out.T)


def block_table(docs: DataFrame, train: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, rows): ``docs`` with _train in blocks of about ``block_bytes`` of text by a hash of id and text, in its order."""
    docs = put(docs, _train=F.coalesce(train, F.lit(False)), _h=F.xxhash64("doc_id", "text"))
    size = F.octet_length(text_or_empty()).cast("long")
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    blocks = max(1, min(FEW_BLOCKS, total // LEAST_BYTES), -(-total // block_bytes))
    at = F.pmod("_h", F.lit(blocks))
    if blocks > 1:
        # at most total / block_bytes keys
        hot = docs.groupBy("_h").agg(F.sum(size + 1).alias("b")).filter(F.col("b") > block_bytes).select(F.col("_h").alias("_hot"))
        docs = docs.join(F.broadcast(hot), F.col("_h") == F.col("_hot"), "left")
        at = F.when(F.col("_hot").isNull(), at).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(blocks)))
        docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "_hot"], at.cast("int").alias("_block"))
    else:
        docs = put(docs, _block=at.cast("int"))
    fields = [f for f in docs.schema.fields if f.name not in ("_h", "_block")]
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("rows", T.ArrayType(T.StructType(fields)))])
    arrow = to_arrow_schema(T.StructType(fields))

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h = table.column("_h").combine_chunks().to_numpy()
        table = table.select([f.name for f in arrow]).take(np.argsort(h, kind="stable")).combine_chunks()
        columns = [table.column(f.name).chunk(0).cast(f.type) if len(h) else pa.array([], f.type) for f in arrow]
        rows = pa.ListArray.from_arrays(pa.array([0, len(h)], pa.int32()), pa.StructArray.from_arrays(columns, fields=list(arrow)))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "rows": rows})

    ship(docs.sparkSession.sparkContext)
    with read_once(docs.sparkSession):
        return materialize(docs.groupBy("_block").applyInArrow(pack, schema), "blocks", **LAYOUT)


def _each_block(batch: pa.RecordBatch) -> Iterator[tuple[int, list[pa.Array]]]:
    """(block, flat columns) of each row of a batch: its first column is the block, the others are lists."""
    for k in range(batch.num_rows):
        yield batch.column(0)[k].as_py(), [c.slice(k, 1).flatten() for c in batch.columns[1:]]


def block_tokens(table: DataFrame) -> DataFrame:
    """(block, token, n) of the distinct tokens of each block, n being their number in training texts."""

    def run(batches):
        for batch in batches:
            for block, (text, learn) in _each_block(batch):
                learn = learn.to_numpy(zero_copy_only=False).astype(bool)
                keys, numbers = [np.zeros(0, np.uint64)], [np.zeros(0)]
                for _, doc, key in token_keys(text):
                    u, back = np.unique(key, return_inverse=True)
                    keys.append(u)
                    numbers.append(np.bincount(back, learn[doc], len(u)))
                every, back = np.unique(np.concatenate(keys), return_inverse=True)
                n = np.bincount(back, np.concatenate(numbers), len(every)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(every), block, np.int32)), pa.array(every.view(np.int64)), pa.array(n)], names=["block", "token", "n"])

    return map_arrow(table.select("block", F.col("rows.text"), F.col("rows._train")), run, "block int, token long, n long")


class Counts:
    """Exact counts of training tokens, as a table by block of the tokens found there, with the corpus sums."""

    def __init__(self, docs: DataFrame, train: Column, words_: int | None = None, block_bytes: int = BLOCK_BYTES):
        self.columns = list(docs.columns)
        self.blocks = block_table(docs, train, block_bytes)
        self.per_block = materialize(block_tokens(self.blocks), "block_tokens")
        self.counts = materialize(self.per_block.filter("n > 0").groupBy("token").agg(F.sum("n").alias("c")), "token_counts")
        n, v = self.counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        self.tokens, self.distinct = int(n), int(v)
        end = int(END.view(np.int64))
        words_ = WORDS + GROW * math.isqrt(self.tokens) if words_ is None else words_
        top = self.counts.filter(F.col("token") != end).orderBy(F.col("c").desc(), "token").limit(words_).collect()
        pairs = sorted((int(np.int64(r.token).view(np.uint64)), r.c) for r in top)
        self.keys = np.array([k for k, _ in pairs], np.uint64)
        known = np.array([c for _, c in pairs], float)
        ends = (self.counts.filter(F.col("token") == end).first() or [0, 0])[1]
        rest = self.distinct - len(pairs) - (1 if ends else 0)
        self.hashed = 1 << (max(1, min(words_ // 4, rest // 8)).bit_length() - 1)
        #: Training tokens and distinct words of each hash class: those of all words less those of the keys.
        self.other_tokens, self.other_distinct = np.zeros(self.hashed, np.int64), np.zeros(self.hashed, np.int64)
        by = self.counts.filter(F.col("token") != end).groupBy(F.col("token").bitwiseAND(F.lit(self.hashed - 1)).alias("h"))
        for h, c, m in by.agg(F.sum("c"), F.count("*")).collect():
            self.other_tokens[h], self.other_distinct[h] = c, m
        at = (self.keys & np.uint64(self.hashed - 1)).astype(np.int64)
        np.subtract.at(self.other_tokens, at, known.astype(np.int64))
        np.subtract.at(self.other_distinct, at, 1)
        mass = np.concatenate([known, np.maximum(1, self.other_tokens), [max(1.0, ends)]])
        self.noise = mass / mass.sum()


def train(counts: Counts, rounds: int = ROUNDS) -> Network:
    """A network trained on all training documents; blocks learn apart and are averaged by tokens."""
    net = Network(counts.keys, counts.noise)
    sc = counts.blocks.sparkSession.sparkContext
    texts = counts.blocks.select("block", F.col("rows.text"), F.col("rows._train"))
    size, blocks = len(net.flat()), counts.blocks.count()
    for turn in range(rounds):
        shared = sc.broadcast((net.keys, net.noise, net.flat()))

        def learn(batches, shared=shared, turn=turn):
            keys, noise, flat = shared.value
            own = Network(keys, noise)

            def parts(text):
                for _, doc, key in token_keys(text):
                    yield own.classes(doc, key)

            for batch in batches:
                for block, (text, train_) in _each_block(batch):
                    own.set_flat(flat)
                    n = own.train(parts(text.filter(train_)), seed=turn + rounds * block)
                    if n:
                        yield _row(block, n, own.flat() - flat)

        def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            total, n = np.zeros(size), 0
            table = table.sort_by("part")  # sums in an order of their own
            for x, k in zip(table.column("delta"), table.column("n").to_pylist(), strict=True):
                total += np.frombuffer(x.as_buffer(), np.float16).astype(float) * k
                n += k
            return pa.Table.from_batches([_row(key[0].as_py(), n, total / n)])

        schema = "part int, n long, delta binary"
        fan = max(2, min(FAN, FAN_BYTES // (2 * size)))
        with read_once(counts.blocks.sparkSession):  # a round's changes are larger than its texts where there are many words
            sums, wide = map_arrow(texts, learn, schema), max(2, blocks)
            while wide > 1:  # a tree of means: no task adds more than fan parameter sets
                sums = sums.withColumn("part", F.expr(f"part div {fan}").cast("int")).groupBy("part").applyInArrow(add, schema)
                wide = -(-wide // fan)
            sums = sums.collect()
        if sums:
            net.set_flat((net.flat() + np.frombuffer(sums[0].delta, np.float16)).astype(np.float32))
        shared.unpersist()
    return net


def _row(part: int, n: int, delta: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([delta.astype(np.float16).tobytes()], pa.binary())], names=["part", "n", "delta"])


_FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]


def score(counts: Counts, net: Network) -> DataFrame:
    """The documents of ``counts`` with n_tokens, n_known, train_tokens, base_score (add-one unigram) and score, both log10."""
    sc = counts.blocks.sparkSession.sparkContext
    names = {f.name for f in _FIELDS}
    inside = counts.blocks.schema["rows"].dataType.elementType
    kept = [inside[c] for c in counts.columns if c not in names]
    schema = T.StructType([*kept, *_FIELDS])
    columns = [f.name for f in kept]
    shared = sc.broadcast(net)
    total, distinct, rest = counts.tokens, counts.distinct, counts.other_tokens + counts.other_distinct + 1
    arrow = to_arrow_schema(schema)

    def of_block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        model = shared.value
        other = len(model.keys)
        token = right.column("token").combine_chunks().to_numpy().view(np.uint64) if right.num_rows else np.zeros(0, np.uint64)
        c = right.column("c").combine_chunks().to_numpy() if right.num_rows else np.zeros(0, np.int64)
        order = np.argsort(token)
        token, c = token[order], c[order]
        out = []
        for rows in left.column("rows").chunks:
            part = pa.RecordBatch.from_struct_array(rows.flatten())
            n = part.num_rows
            got = np.zeros((4, n))
            for _, doc, key in token_keys(part.column("text")):
                unique, back = np.unique(key, return_inverse=True)
                at = np.searchsorted(token, unique)
                at[at == len(token)] = 0
                own_c = np.where(token[at] == unique, c[at], 0) if len(token) else np.zeros(len(unique), np.int64)
                own, a, b = model.classes(doc, key)
                log_p = model.log_p(own, a, b) / math.log(10)
                hashed = np.flatnonzero((own >= other) & (own < other + model.hashed))
                log_p[hashed] += np.log10((own_c[back[hashed]] + 1) / rest[own[hashed] - other])
                base = np.log10((own_c + 1) / (total + distinct + 1))[back]
                for i, x in enumerate((None, (own_c > 0)[back], base, log_p)):
                    got[i] += np.bincount(doc, x, n)
            made = [pa.array(got[0].astype(np.int64)), pa.array(got[1].astype(np.int64)), pa.array(np.full(n, total, np.int64)), pa.array(got[2]), pa.array(got[3])]
            out.append(pa.RecordBatch.from_arrays([*[part.column(x).cast(arrow.field(x).type) for x in columns], *made], schema=arrow))
        return pa.Table.from_batches(out)

    ship(sc)
    known = counts.per_block.select("block", "token").join(counts.counts, "token").select("block", "token", "c")
    return counts.blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(of_block, schema)


def op8_log_bilinear_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = remainder("doc_id", 7) == 2
    counts = Counts(docs, ~held_out)
    scored = score(counts, train(counts))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
