"""Self-join on the Jaccard similarity of five-word shingle sets by chosen paths.

Texts with the same shingle set are one class; only classes are joined. A class is carried as a sketch of ``SKETCH`` sampled
shingles (the least hash in each of as many bins; an empty bin takes that of another one, found by a fixed search), in which
two classes agree at a place with the probability of their similarity. In each of several runs the classes go down a tree: a
node samples one or two places, 1 / similarity on average, and for each of them has a child for every shingle found there, so a
pair at the threshold stays together in one child on average and deep trees still find it. A bucket of at most ``BUCKET``
classes is compared by brute force; a larger one is split again, up to ``DEPTH`` times. What is large even then (classes that
are alike everywhere) is cut into blocks, and every pair of blocks is a task of its own. Runs are repeated until a pair at the
threshold is missed with a probability of at most ``1 - recall``, if its buckets were split to the end.

A task first compares sketches; only classes whose sketch agrees with another one's in nearly the share of places that the
threshold asks for are sent with their text and compared exactly, on whole sets of 64-bit shingle hashes. (Classes are told
apart by two 64-bit sums over these.)

Pairs are never listed. A task counts links and returns for each class a number of links and one link to the task's root
of its component. A pair that meets in several buckets counts in the one with the least number: classes carry the numbers of
their other buckets, and whatever shares a lesser one is skipped. Classes are then merged to connected components.

Defined results: words are A-Z lower-cased runs of ASCII letters and digits and of non-ASCII characters; a text of one to
four words has one shingle of all its words; null texts and texts without words have no shingles, are in no group and
have no links; repeated rows are copies; an empty table gives an empty result; input columns named like a result column
are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .frames import add_by_arrow, map_arrow, put, shielded, text_or_empty
from .storage import discard, materialize
from .tokens import ALNUM, mix, windows, words

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.99
BUCKET, DEPTH, BLOCK, BLOCK_SHINGLES = 64, 5, 1024, 4_000_000
#: Places of a sketch; how far below the threshold their agreement may be, five standard deviations of an estimate; the
#: size of a set below which estimates are not relied on.
SKETCH, SLACK, FEW = 64, 0.25, 16


def survival(similarity: float, depth: int) -> float:
    """Probability that a pair of this similarity is in a common node of a tree at this depth."""
    two, s = _second_child(similarity), 1.0
    for _ in range(depth):
        s = (1 - two) * similarity * s + two * (1 - (1 - similarity * s) ** 2)
    return s


def _second_child(similarity: float) -> float:
    return min(1.0, 1 / similarity - 1)


def runs_for(similarity: float, recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold that must stay together all the way down was found with this probability."""
    return 1 if similarity == 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity, depth))))


def shingle_sets(column: pa.Array, size: int = SHINGLE):
    """(row, sorted distinct shingle hashes) for every text with a word."""
    for w in words(column, ALNUM):
        if not len(w.hash):
            continue
        edges = np.searchsorted(w.doc, np.arange(w.first, w.last + 1))
        all_windows = windows(w.hash, size)
        for d in range(w.first, w.last):
            lo, hi = int(edges[d - w.first]), int(edges[d - w.first + 1])
            if hi - lo >= size:
                yield d, np.unique(all_windows[lo : hi - size + 1])
            elif hi > lo:
                yield d, windows(w.hash[lo:hi], hi - lo)


_FP = T.StructField("_set", T.BinaryType())
_SIZE = T.StructField("_size", T.LongType())
_SKETCH = T.StructField("_sketch", T.ArrayType(T.IntegerType()))
_ODD = mix(np.arange(1, 4, dtype=np.uint64)) | np.uint64(1)
_BIN = np.uint64(64 - int(math.log2(SKETCH)))
#: The bins that an empty bin looks at, in turn; the same for all sets.
_SEARCH = np.stack([np.random.default_rng(5 + k).permutation(SKETCH) for k in range(SKETCH)])


def _set_key(s: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return s.sum(dtype=np.uint64).tobytes() + mix(s + np.uint64(len(s))).sum(dtype=np.uint64).tobytes()


def sketch(s: np.ndarray) -> np.ndarray:
    """Of each bin of a random order the least shingle, as 32 bits; empty bins repeat others."""
    x = np.sort((s ^ (s >> np.uint64(29))) * _ODD[0])
    bins = (x >> _BIN).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    full = np.zeros(SKETCH, bool)
    full[bins[first]] = True
    out = np.zeros(SKETCH, np.int32)
    out[bins[first]] = (x[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    if len(first) < SKETCH:
        empty = np.flatnonzero(~full)
        out[empty] = out[_SEARCH[empty, full[_SEARCH[empty]].argmax(1)]]
    return out


def with_sets(docs: DataFrame, sketched: bool = False, size: int = SHINGLE) -> DataFrame:
    """``docs`` with _set (128 bits of the shingle set; null without words), _size, and with ``sketched`` also _sketch."""
    at = docs.schema.names.index("text")

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        n = batch.num_rows
        keys: list[bytes | None] = [None] * n
        sizes = np.zeros(n, np.int64)
        sketches: list = [None] * n
        for d, s in shingle_sets(batch.column(at), size):
            keys[d], sizes[d] = _set_key(s), len(s)
            if sketched:
                sketches[d] = sketch(s)
        out = [pa.array(keys, pa.binary()), pa.array(sizes)]
        return [*out, pa.array(sketches, pa.list_(pa.int32()))] if sketched else out

    return add_by_arrow(docs, [_FP, _SIZE, _SKETCH] if sketched else [_FP, _SIZE], compute)


def _children(similarity: float) -> Column:
    """The child nodes of ``path`` for a class with ``_sketch``: one for each place that the node samples."""
    place = lambda k: F.pmod(F.xxhash64("path", F.lit(k)), F.lit(SKETCH)).cast("int")
    second = F.pmod(place(1) + 1 + F.pmod(F.xxhash64("path", F.lit(2)), F.lit(SKETCH - 1)).cast("int"), F.lit(SKETCH))
    child = lambda p: F.xxhash64("path", p, F.get("_sketch", p))
    two = F.pmod(F.xxhash64("path", F.lit(3)), F.lit(1 << 20)) < int(_second_child(similarity) * (1 << 20))
    return F.explode(F.when(two, F.array(child(place(1)), child(second))).otherwise(F.array(child(place(1)))))


def _leaves(classes: DataFrame, runs: int, similarity: float, depth: int, bucket: int) -> DataFrame:
    """(_set, leaf, n, shingles) of classes that share a leaf with another class; leaves of all runs have numbers of their own."""
    rows = classes.select("_set", "_size", "_sketch", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    rows = rows.withColumn("path", F.xxhash64(F.lit("run"), "run"))
    done = None
    for level in range(depth):
        rows = rows.select("_set", "_size", _children(similarity).alias("path"))
        # written first, so that the join has two plain exchanges and the rows of a large bucket can be split over tasks
        counts = materialize(rows.groupBy("path").agg(F.count("*").alias("n"), F.sum("_size").alias("shingles")).filter("n > 1"), "counts")
        met = materialize(rows.join(counts, "path"), "buckets")
        discard(counts)
        last = level + 1 == depth
        large = met.filter(F.col("n") > bucket)
        ended = (met if last else met.filter(F.col("n") <= bucket)).select("_set", F.col("path").alias("leaf"), "n", "shingles")
        done = ended if done is None else done.unionByName(ended)
        if last or large.isEmpty():
            break
        rows = large.select("_set", "_size", "path").join(classes.select("_set", "_sketch").hint("merge"), "_set")
    return done


def _tasks(leaves: DataFrame, block: int, block_shingles: int) -> DataFrame:
    """(_set, leaf, i, j, own, earlier): who meets in which task, without buckets that hold nothing new. ``earlier`` lists the
    leaves of the class with lesser numbers."""
    leaves = materialize(leaves, "leaves")
    own = leaves.groupBy("_set").agg(F.collect_list("leaf").alias("all"))  # at most runs x 2 ^ depth, 1.25 ^ depth on average
    met = leaves.join(own, "_set").withColumn("earlier", F.array_sort(F.filter("all", lambda x: x < F.col("leaf")))).drop("all")
    met = materialize(met, "met")
    discard(leaves)
    # a bucket whose classes are all in one lesser bucket holds nothing new
    inside = met.select("leaf", "n", F.explode("earlier").alias("e")).groupBy("leaf", "n", "e").count().filter("count = n").select("leaf").distinct()
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("shingles") / block_shingles)).cast("int")
    buckets = met.groupBy("leaf").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    new = materialize(buckets.join(inside, "leaf", "left_anti").select("leaf", blocks.alias("blocks")), "new_buckets")
    met = met.drop("n", "shingles").join(new, "leaf")
    mine = F.pmod(F.xxhash64("_set"), F.col("blocks")).cast("int")
    met = met.select("_set", "leaf", "blocks", mine.alias("own"), "earlier")
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select("_set", "leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "earlier")


def _met(earlier: list[np.ndarray]) -> np.ndarray:
    """(class, bucket) marks of the earlier buckets that several classes of a task were in."""
    n = len(earlier)
    every = np.concatenate([*earlier, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(n), [len(e) for e in earlier])
    _, back, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times[back] > 1
    out = np.zeros((n, int((times > 1).sum())), np.float32)
    out[owner[shared], (np.cumsum(times > 1) - 1)[back[shared]]] = 1
    return out


def promising(sketches: np.ndarray, size: np.ndarray, side: np.ndarray, earlier: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether each class of a task may have a new link to another: sketches agree nearly enough, sizes allow it, and they were in
    no earlier bucket together."""
    n = len(size)
    least = (similarity - SLACK) * SKETCH
    if n == 2:
        small, big = sorted(size.tolist())
        if small < similarity * big - 1e-9 or small >= FEW and (sketches[0] == sketches[1]).sum() < least:
            return np.zeros(2, bool)
        return np.full(2, not len(np.intersect1d(earlier[0], earlier[1])))
    marks, out, two = _met(earlier), np.zeros(n, bool), len(np.unique(side)) > 1
    for lo in range(0, n, 256):
        hi = min(n, lo + 256)
        agree = np.zeros((hi - lo, n), np.int16)
        for p in range(SKETCH):
            agree += sketches[lo:hi, p, None] == sketches[None, :, p]
        maybe = (agree >= least) | (np.minimum(size[lo:hi, None], size[None, :]) < FEW)
        maybe &= np.minimum(size[lo:hi, None], size[None, :]) >= similarity * np.maximum(size[lo:hi, None], size[None, :]) - 1e-9
        maybe[np.arange(hi - lo), np.arange(lo, hi)] = False
        if two:
            maybe &= side[lo:hi, None] != side[None, :]
        if marks.shape[1]:
            maybe &= marks[lo:hi] @ marks.T == 0
        out[lo:hi] = maybe.any(1)
    return out


def link_counts(sets: list[np.ndarray], side: np.ndarray, weight: np.ndarray, earlier: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of a task's sets: for each set its number of linked sets, of their rows, and the root of its component.

    ``side`` 0 meets 1, or all meet all where there is one side. Pairs that share a number in ``earlier`` met before."""
    n = len(sets)
    links, rows, root = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    def join(x: np.ndarray, y: np.ndarray) -> None:
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)

    size = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        small, big = sorted(size.tolist())
        if small >= similarity * big and not len(np.intersect1d(earlier[0], earlier[1])):
            common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            if common >= similarity * (small + big - common) - 1e-9:
                links[:], rows[:] = 1, weight[::-1]
                root[1] = 0
        return links, rows, root
    # shingles of one set only cannot be common
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    _, back, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times[back] > 1
    column = (np.cumsum(times > 1) - 1)[back[shared]]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = int(column[-1]) + 1 if len(column) else 0
    # the largest group that met before need not meet itself again
    marks = _met(earlier)
    met = marks[:, marks.sum(0).argmax()] > 0 if marks.shape[1] else np.zeros(n, bool)
    two = len(np.unique(side)) > 1
    fresh, old = np.flatnonzero(~met), np.flatnonzero(met)
    whole = np.concatenate([fresh, old])
    for lo in range(0, len(fresh), 1024):
        left = fresh[lo : lo + 1024]
        right = whole[lo:]  # pairs with earlier rows of this order were taken in earlier strips
        common = np.zeros((len(left), len(right)), np.float32)
        place = np.full(n, -1)
        place[right] = np.arange(len(right))
        for at in range(0, width, 4096):
            a, b = np.searchsorted(column, [at, at + 4096])
            o, c = owner[a:b], column[a:b] - at
            keep = place[o] >= 0
            m = np.zeros((len(right), min(4096, width - at)), np.float32)
            m[place[o[keep]], c[keep]] = 1
            common += m[: len(left)] @ m.T
        linked = common >= similarity * (size[left][:, None] + size[right][None, :] - common) - 1e-6
        linked &= np.arange(len(right))[None, :] > np.arange(len(left))[:, None]
        if two:
            linked &= side[left][:, None] != side[right][None, :]
        if marks.shape[1]:
            linked &= marks[left] @ marks[right].T == 0
        np.add.at(links, left, linked.sum(1))
        np.add.at(links, right, linked.sum(0))
        np.add.at(rows, left, linked @ weight[right])
        np.add.at(rows, right, weight[left] @ linked)
        # one link for each linked row and for each linked column is enough for the components, if rows chain along columns
        some = linked.any(1)
        join(left[some], right[linked[some].argmax(1)])
        some = linked.any(0)
        join(right[some], left[linked[:, some].argmax(0)])
        _chain(linked, left, right, join)
    return links, rows, np.array([find(x) for x in range(n)])


def _chain(linked: np.ndarray, left: np.ndarray, right: np.ndarray, join) -> None:
    """Joins every pair of this strip that the first links of rows and columns leave apart: labels spread along links."""
    label = np.arange(len(left))
    while True:
        column = np.where(linked, label[:, None], len(left)).min(0, initial=len(left))
        now = np.minimum(label, np.where(linked, column[None, :], len(left)).min(1, initial=len(left)))
        if (now == label).all():
            break
        label = now
    own = np.flatnonzero(label != np.arange(len(left)))
    join(left[own], left[label[own]])
    column = np.where(linked, label[:, None], len(left)).min(0, initial=len(left))
    own = np.flatnonzero(column < len(left))
    join(right[own], left[column[own]])


_TASK = ("leaf", "i", "j")


def _by_task(rows, of_task):
    """Results of ``of_task`` for the rows (task first) of each task with several; rows come sorted by task."""
    held: list = []
    for row in rows:
        if held and row[0] != held[0][0]:
            if len(held) > 1:
                yield from of_task(held)
            held = []
        held.append(row)
    if len(held) > 1:
        yield from of_task(held)


def _batches(rows, schema: pa.Schema, most: int = 4096):
    out: list = []
    for row in rows:
        out.append(row)
        if len(out) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _promising(tasks: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``tasks`` (with _size and _sketch, sorted by task) that may have a new link in their task."""
    schema = pa.schema([("_set", pa.binary()), ("leaf", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("own", pa.int32()), ("earlier", pa.list_(pa.int64()))])

    def of_task(held):
        sketches = np.stack([h[4] for h in held])
        good = promising(sketches, np.array([h[3] for h in held], np.int64), np.array([h[2] for h in held]), [h[5] for h in held], similarity)
        for k in np.flatnonzero(good).tolist():
            task, key, own, _, _, earlier = held[k]
            yield (key, *task, own, earlier)

    def run(batches):
        def rows():
            for b in batches:
                c = {x: b.column(b.schema.names.index(x)) for x in ("_set", "leaf", "i", "j", "own", "earlier", "_size", "_sketch")}
                sketches = c["_sketch"].flatten().to_numpy(zero_copy_only=False).reshape(-1, SKETCH)
                offsets, every = c["earlier"].offsets.to_numpy(), c["earlier"].values.to_numpy(zero_copy_only=False)
                for k, (key, leaf, i, j, own, size) in enumerate(zip(*(c[x].to_pylist() for x in ("_set", "leaf", "i", "j", "own", "_size")), strict=True)):
                    yield (leaf, i, j), key, own, size, sketches[k], every[offsets[k] : offsets[k + 1]]

        yield from _batches(_by_task(rows(), of_task), schema)

    return map_arrow(tasks, run, "_set binary, leaf long, i int, j int, own int, earlier array<long>")


def _compare(tasks: DataFrame, similarity: float, size: int) -> DataFrame:
    """(_set, links, rows, root) of every class that has a new link in a task; ``tasks`` come sorted by task."""
    schema = pa.schema([("_set", pa.binary()), ("links", pa.int64()), ("rows", pa.int64()), ("root", pa.binary())])

    def of_task(held):
        own = sorted(held, key=lambda h: h[1])
        links, rows, root = link_counts([x[3] for x in own], np.array([x[2] for x in own]), np.array([x[4] for x in own]), [x[5] for x in own], similarity)
        for k in np.flatnonzero(links).tolist():
            yield own[k][1], int(links[k]), int(rows[k]), own[int(root[k])][1]

    def run(batches):
        def rows():
            for b in batches:
                names = b.schema.names
                get = {c: b.column(names.index(c)).to_pylist() for c in ("_set", "leaf", "i", "j", "own", "n_docs")}
                earlier = b.column(names.index("earlier"))
                offsets, every = earlier.offsets.to_numpy(), earlier.values.to_numpy(zero_copy_only=False)
                for d, s in shingle_sets(b.column(names.index("text")), size):
                    yield (get["leaf"][d], get["i"][d], get["j"][d]), get["_set"][d], get["own"][d], s, get["n_docs"][d], every[offsets[d] : offsets[d + 1]]

        yield from _batches(_by_task(rows(), of_task), schema)

    return map_arrow(tasks, run, "_set binary, links long, rows long, root binary")


def join_classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, size: int = SHINGLE, bucket: int = BUCKET, depth: int = DEPTH, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row for each shingle set of ``docs`` (doc_id, text): _set, least doc_id of its rows (first_id), n_docs, links (to
    other sets), linked_docs (rows of those sets), and of its component: root and class_id (its least doc_id)."""
    if not 0 < similarity <= 1:
        raise ValueError("the similarity lies in (0, 1]")
    runs = runs_for(similarity, recall, depth)
    sets = with_sets(docs.select("doc_id", "text"), True, size).filter("_size > 0")
    classes = sets.groupBy("_set").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_docs"), F.first("_size").alias("_size"), F.first("_sketch").alias("_sketch"), F.first("text").alias("text"))
    classes = materialize(classes, "classes")
    tasks = _tasks(_leaves(classes.select("_set", "_size", "_sketch"), runs, similarity, depth, bucket), block, block_shingles)
    ready = tasks.join(classes.select("_set", "_size", "_sketch").hint("merge"), "_set").repartition(*_TASK).sortWithinPartitions(*_TASK)
    good = materialize(_promising(ready, similarity), "promising")
    ready = good.join(classes.select("_set", "n_docs", "text").hint("merge"), "_set").repartition(*_TASK).sortWithinPartitions(*_TASK)
    found = materialize(_compare(ready, similarity, size), "links")
    discard(good)
    totals = found.groupBy("_set").agg(F.sum("links").alias("links"), F.sum("rows").alias("linked_docs"))
    parts = components(found.select(F.col("_set").alias("u"), F.col("root").alias("v")))
    out = classes.select("_set", "first_id", "n_docs").join(totals, "_set", "left").join(parts.withColumnRenamed("node", "_set"), "_set", "left")
    out = materialize(out.select("_set", "first_id", "n_docs", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("linked_docs", F.lit(0)).alias("linked_docs"), F.coalesce("root", "_set").alias("root")), "joined")
    least = out.groupBy("root").agg(F.min("first_id").alias("class_id"))
    joined = materialize(out.join(least, "root"), "joined_classes")
    for t in (classes, found, out):
        discard(t)
    return joined


def find_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with class_id (least doc_id of all texts connected by links), n_copies (rows with the same shingles), n_links
    (other rows at the similarity or more, copies among them) and n_linked_sets (different shingle sets among those)."""
    return _with_classes(docs, **options).drop("_root", "_set_key")


def _with_classes(docs: DataFrame, **options) -> DataFrame:
    """The same with _root, the component's key; null for texts without words."""
    size = options.get("size", SHINGLE)
    joined = join_classes(docs, **options).select(F.col("_set").alias("_set2"), F.col("class_id").alias("_class"), F.col("root").alias("_root2"), "n_docs", "links", "linked_docs", "first_id")
    own = with_sets(docs, False, size)
    # texts without words match nothing; a key of their own keeps them apart
    key = F.coalesce("_set", F.concat(F.lit("-").cast("binary"), F.unhex(F.hex(F.xxhash64("doc_id", F.rand(1))))))
    out = put(own, _key=key).join(joined, F.col("_key") == F.col("_set2"), "left")
    found = F.col("_set2").isNotNull()
    out = put(out, class_id=F.when(found, F.col("_class")).otherwise(F.col("doc_id")), n_copies=F.coalesce("n_docs", F.lit(1)).cast("long"), n_links=F.when(found, F.col("linked_docs") + F.col("n_docs") - 1).otherwise(0).cast("long"), n_linked_sets=F.coalesce("links", F.lit(0)).cast("long"), _root=F.col("_root2"))
    return out.drop("_set", "_size", "_set2", "_class", "n_docs", "links", "linked_docs", "first_id", "_root2").withColumnRenamed("_key", "_set_key")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of every group: the one with the least doc_id (a null id after all others) and, where rows of a group share
    it, the one whose text has the least hash. Texts without words are in no group and all stay."""
    def first_of_each(own: DataFrame) -> DataFrame:
        found = _with_classes(own, **options).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
        names = [c for c in found.columns if c not in ("_set_key", "_root")]
        # all rows of texts without words have keys of their own
        group = found.select(F.coalesce("_root", "_set_key").alias("_group"), F.struct(*names).alias("_row"), F.xxhash64(text_or_empty()).alias("_text"))
        return group.groupBy("_group").agg(F.min_by("_row", "_text").alias("_row")).select("_row.*")

    return shielded(docs, first_of_each)


def op5_chosen_path_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_near_duplicates(docs).drop("text")
