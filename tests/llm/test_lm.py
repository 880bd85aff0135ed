"""Scores of the log-bilinear model recomputed word by word from its parameters, and reruns over other partitions."""

import glob
import math
import os
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from ledgerframe.llm import lm_scoring as lm


def corpus(n=300):
    rng = random.Random(2)
    return [(i, None if i == 7 else " ".join(f"W{min(rng.randrange(90), rng.randrange(90))}" for _ in range(rng.randint(0, 40)))) for i in range(n)]


def key_of(word):
    return next(lm.token_keys(pa.array([word])))[2][0]


def brute_score(text, counts, net, c, n, v):
    """log10 probability by sums over all groups and all classes of the group, one token at a time."""
    words = (text or "").lower().split()
    known, end = len(net.keys), len(net.noise) - 1
    place = {int(k): i for i, k in enumerate(net.keys)}

    def of(word):
        k = key_of(word)
        return place.get(int(k), known + int(k & np.uint64(net.hashed - 1)))

    mass = Counter()  # of the words of each hash class: (count + 1) of each, and one share for all unseen ones
    for w, m in c.items():
        if w != "END" and of(w) >= known:
            mass[of(w)] += m + 1
    two, one, total = end + 1, end + 1, 0.0
    for w in [*words, "END"]:
        t = end if w == "END" else of(w)
        h = net.r[one].astype(float) @ net.c[0] + net.r[two].astype(float) @ net.c[1]
        by_group = np.exp(net.gq.astype(float) @ h + net.gb)
        mates = [x for x in range(end + 1) if net.group[x] == net.group[t]]
        by_class = {x: math.exp(net.q[x].astype(float) @ h + net.b[x]) for x in mates}
        total += math.log10(by_group[net.group[t]] / by_group.sum()) + math.log10(by_class[t] / sum(by_class.values()))
        if known <= t < end:
            total += math.log10((c.get(w, 0) + 1) / (mass[t] + 1))
        two, one = one, t
    return total


def test_scores_are_those_of_the_model(spark):
    rows = corpus()
    train = [(i, t) for i, t in rows if i % 5]
    counts = lm.Counts(spark.createDataFrame(rows, "doc_id long, text string"), lm.F.col("doc_id") % 5 != 0, words_=20, block_bytes=3000)
    net = lm.train(counts, rounds=1)
    c = Counter(w for _, t in train for w in [*(t or "").lower().split(), "END"])
    n, v = sum(c.values()), len(c)
    assert net.hashed > 1 and len(net.keys) == 20 < v
    out = {r.doc_id: r for r in lm.score(counts, net).collect()}
    assert len(out) == len(rows)
    for i, t in rows[:40]:
        words = [*(t or "").lower().split(), "END"]
        assert out[i].base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words))
        assert out[i].score == pytest.approx(brute_score(t, counts, net, c, n, v), rel=1e-4)


def test_scores_do_not_depend_on_partitions(spark):
    d = spark.createDataFrame(corpus(), "doc_id long, text string")
    got = []
    for parts in (1, 7):
        counts = lm.Counts(d.repartition(parts), lm.F.col("doc_id") % 5 != 0, words_=20, block_bytes=2000)
        got.append({r.doc_id: r.score for r in lm.score(counts, lm.train(counts, rounds=2)).collect()})
    assert got[0] == pytest.approx(got[1], rel=1e-6)


def test_equal_rows_are_dealt_to_several_blocks(spark):
    rows = [(1, "the same row again " * 5)] * 200 + corpus(50)
    counts = lm.Counts(spark.createDataFrame(rows, "doc_id long, text string"), lm.F.lit(True), words_=10, block_bytes=2000)
    sizes = [r.n for r in counts.blocks.select(lm.F.size("rows").alias("n")).collect()]
    assert max(sizes) < 60 and sum(sizes) == 250
    out = lm.score(counts, lm.train(counts, rounds=1))
    assert out.columns == ["doc_id", "text", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and out.count() == 250


def test_blocks_are_written_one_at_a_time(spark):
    """No task holds several blocks in a page or a row group; the writer looks at sizes only every 100 rows by itself."""
    d = spark.createDataFrame([(i, f"text {i} " * 30) for i in range(20_000)], "doc_id long, text string").coalesce(1)
    blocks = lm.block_table(d, lm.F.lit(True), block_bytes=2 << 20)
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{blocks._scratch_path.removeprefix('file:')}/*.parquet")]
    assert sum(m.num_rows for m in files) > len(files)
    for m in files:
        for g in range(m.num_row_groups):
            assert m.row_group(g).num_rows == 1 and m.row_group(g).column(0).compression == "ZSTD"


def test_a_round_leaves_no_shuffle_files(spark):
    """Changes of the parameters are as many as blocks times words; those of one round go before the next."""

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in files.mkString("\n").split("\n") if "/shuffle_" in f and f.endswith(".data")}

    counts = lm.Counts(spark.createDataFrame(corpus(), "doc_id long, text string"), lm.F.lit(True), words_=20, block_bytes=3000)
    before = shuffled()
    lm.train(counts, rounds=2)
    left = [os.path.getsize(f) for f in shuffled() - before if os.path.exists(f)]
    assert sum(left) < 1000  # counting the blocks leaves a few bytes
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def plain_steps(net, batches, seed):
    """Noise-contrastive steps as they read: each table of parameters sorted by row and summed by itself."""

    def rate(x):
        return 1 / (1 + np.exp(np.minimum(-x, 80)))

    def by_row(rows, values):
        order = np.argsort(rows.astype(np.int32))
        r = rows[order]
        last = np.flatnonzero(np.concatenate([r[1:] != r[:-1], [True]]))
        sums = np.cumsum(values[order], axis=0, dtype=np.float64)[last]
        sums[1:] -= sums[:-1].copy()
        return r[last], sums.astype(np.float32)

    rng = np.random.default_rng(seed)
    r2, q2, c2, b2, gq2, gb2 = (np.full(p.shape, 1e-2, np.float32) for p in net.parameters())
    levels = [(q, b, qs, bs, np.log(p * lm.NOISE).astype(np.float32), np.cumsum(p)) for q, b, qs, bs, p in ((net.q, net.b, q2, b2, net.noise), (net.gq, net.gb, gq2, gb2, net.group_noise))]
    for own, one, two in batches:
        for lo in range(0, len(own), lm.BATCH):
            w, a, b = (x[lo : lo + lm.BATCH] for x in (own, one, two))
            h, size, steps = net.r[a] @ net.c[0] + net.r[b] @ net.c[1], np.float32(math.sqrt(len(w))), []
            gh = np.zeros_like(h)
            for t, (q, bias, qs, bs, log_noise, pick) in zip((w, net.group[w]), levels, strict=True):
                k = np.minimum(np.searchsorted(pick, rng.random(lm.NOISE) * pick[-1]), len(pick) - 1)
                good = (1 - rate((h * q[t]).sum(1) + (bias[t] - log_noise[t]))) / np.float32(len(w))
                bad = rate(h @ q[k].T + (bias[k] - log_noise[k])) / np.float32(len(w))
                gh += good[:, None] * q[t] - bad @ q[k]
                rows = np.concatenate([t, k])
                steps.append((q, qs, rows, np.concatenate([good[:, None] * h, -(bad.T @ h)])))
                steps.append((bias, bs, rows, np.concatenate([good, -bad.sum(0)])))
            steps.append((net.r, r2, np.concatenate([a, b]), np.concatenate([gh @ net.c[0].T, gh @ net.c[1].T])))
            g = np.stack([net.r[a].T @ gh, net.r[b].T @ gh]) * size
            c2 += g * g
            net.c += lm.RATE * 0.1 * g / np.sqrt(c2)
            for p, s, rows, values in steps:
                at, g = by_row(rows, values)
                g *= size
                s[at] += g * g
                p[at] += lm.RATE * 0.1 * g / np.sqrt(s[at])


def test_steps_are_the_plain_ones_in_less_time():
    rng = np.random.default_rng(3)
    noise = 1 / np.arange(1, 20_002) ** 0.9
    noise /= noise.sum()
    keys = np.sort(rng.integers(1, 1 << 63, 16_000).astype(np.uint64) * np.uint64(2))
    at = np.minimum(np.searchsorted(np.cumsum(noise), rng.random(60_000)), len(noise) - 1)
    doc = np.sort(rng.integers(0, 400, len(at)))
    key = np.where(at < len(keys), keys[np.minimum(at, len(keys) - 1)], np.uint64(1) + at.astype(np.uint64) * np.uint64(2))
    took, made = {True: [], False: []}, {}
    for _ in range(3):
        for plain in (True, False):
            net = lm.Network(keys, noise)
            batch = net.classes(doc, key)
            began = time.perf_counter()
            plain_steps(net, [batch], 5) if plain else net.train(iter([batch]), 5)
            took[plain].append(time.perf_counter() - began)
            made[plain] = net.flat()
    assert np.abs(made[True] - made[False]).max() < 1e-4 and np.abs(made[True] - lm.Network(keys, noise).flat()).max() > 0.1
    assert min(took[False]) < 0.8 * min(took[True])


def test_words_are_found_where_keys_crowd():
    rng = np.random.default_rng(4)
    for keys in (np.arange(1, 50, dtype=np.uint64), rng.integers(1, 1 << 63, 5000).astype(np.uint64) * np.uint64(2), np.array([3], np.uint64), np.zeros(0, np.uint64)):
        keys = np.unique(keys)
        net = lm.Network(keys, np.full(len(keys) + 5, 1 / (len(keys) + 5)))
        ask = np.concatenate([keys, keys + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)])
        place = {int(k): i for i, k in enumerate(keys)}
        assert net.classes(np.zeros(len(ask), int), ask)[0].tolist() == [place.get(int(k), len(keys) + int(k) % 4) for k in ask]


def test_large_scores_are_normalised():
    """Scores past the range of 32-bit exponentials."""
    net = lm.Network(np.arange(1, 30, dtype=np.uint64), np.full(40, 1 / 40))
    for far in (0, 300, -300):
        net.gb[...], net.b[...] = far, far
        net.b[::3] += 120
        p = np.exp(net.log_p(np.arange(40), np.full(40, 3), np.full(40, 40)))
        assert p.sum() == pytest.approx(1, abs=1e-5) and np.isfinite(net.log_p(np.arange(40), np.full(40, 3), np.full(40, 40))).all()
