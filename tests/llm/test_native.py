"""Sharding, exact dedup, mixing and line dedup against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerframe.llm import exact_dedup, line_dedup, mixing, sharding


def docs(spark, texts, sources=None):
    rows = [(i, t, (sources or ["s"])[i % len(sources or ["s"])]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def random_texts(seed, n, words=30, alphabet="abcdefgh"):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, words))) for _ in range(n)]


def trie(keys, limit, depth=0):
    if sum(b for _, b in keys) <= limit or len(keys) == 1 or depth == sharding.KEY_BITS:
        return {k: depth for k, _ in keys}
    at = sharding.KEY_BITS - depth - 1
    out = {}
    for bit in (0, 1):
        side = [(k, b) for k, b in keys if k >> at & 1 == bit]
        if side:
            out |= trie(side, limit, depth + 1)
    return out


@pytest.mark.parametrize("step", [2, 10])
def test_shards_are_the_trie(spark, step):
    texts = [*random_texts(1, 150), "y" * 5000]
    keys = [(int(hashlib.md5(f"{i}:{t}".encode()).hexdigest()[:15], 16), len(t)) for i, t in enumerate(texts)]
    want = trie(keys, 300)
    got = sharding.shard(docs(spark, texts), 300, step=step).collect()
    size = Counter()
    for r in got:
        k = keys[r.doc_id][0]
        assert r.local_depth == want[k]
        assert r.shard_id == (format(k >> sharding.KEY_BITS - r.local_depth, f"0{r.local_depth}b") if r.local_depth else "*")
        size[r.shard_id] += len(r.text)
    assert all(size[r.shard_id] == r.shard_bytes and (r.shard_bytes <= 300 or r.shard_docs == 1) for r in got)


def test_equal_rows_overflow_to_pages(spark):
    d = spark.createDataFrame([(7, "x" * 50)] * 25 + [(100 + i, "y" * 20) for i in range(10)], "doc_id long, text string").repartition(4)
    got = sharding.shard(d, 120, step=20).collect()
    pages = Counter((r.shard_id, r.overflow_page) for r in got if r.doc_id == 7)
    assert sum(pages.values()) == 25 and max(pages.values()) <= 2 and len(pages) == 13


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(7))])
@pytest.mark.parametrize("hot", [1 / 256, 2.0])
def test_equal_texts(spark, hashed, hot):
    base = random_texts(2, 40, words=400)
    rng = random.Random(3)
    texts = [rng.choice(base) if rng.random() < 0.5 else base[0] for _ in range(1300)] + [t + "!" for t in base] + ["".join(reversed(base[5]))]
    got = exact_dedup.mark_duplicates(docs(spark, texts), hashed, hot_share=hot).collect()
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t].append(i)
    for r in got:
        own = groups[r.text]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))
        assert r.text_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert len(got) == len(texts)


SCRIPTS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "han": "".join(map(chr, range(0x4E00, 0x4F00))),
    "code": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_chunks_join_to_the_text_and_resist_insertions(spark, script):
    rng = random.Random(4)
    gap = "" if script in ("han", "code") else " "
    text = gap.join("".join(rng.choice(SCRIPTS[script]) for _ in range(rng.randint(2, 9))) for _ in range(8000))
    d = spark.createDataFrame([(text,), ("zz" + text,)], "text string").select(exact_dedup.chunks(F.col("text")).alias("c"))
    a, b = (r.c for r in d.collect())
    assert "".join(a).encode("latin-1").decode() == text and len(a) > 40
    assert len(set(a) & set(b)) >= 0.9 * len(a)
    assert max(map(len, a)) < exact_dedup.LONGEST


def brute_mix(rows, weights=mixing.WEIGHTS, share=1.5, most=2):
    size = {i: len(t.split()) for i, t, _ in rows}
    by = defaultdict(list)
    for i, _, s in rows:
        by[s].append(i)
    w = {s: weights[k % len(weights)] for k, s in enumerate(sorted(by))}
    total = {s: sum(size[i] for i in own) for s, own in by.items()}
    target, open_, left = {}, set(by), share * sum(total.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * total[s]}
        if not full:
            target |= {s: level * w[s] for s in open_}
            break
        for s in full:
            target[s] = float(most * total[s])
            left -= target[s]
        open_ -= full
    return size, total, target


@pytest.mark.parametrize(("slices", "ordered"), [(4, 3), (4096, 20_000)])
def test_mix(spark, slices, ordered):
    texts = random_texts(5, 300)
    rows = [(i, t, f"s{i % 5}" if i % 3 else "hot") for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(d, slices=slices, ordered=ordered).collect()
    size, total, target = brute_mix(rows)
    taken = Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= 30
    again = {r.doc_id: r.taken for r in mixing.mix(d.repartition(5)).collect()}
    if slices == 4096:
        assert again == {r.doc_id: r.taken for r in got}
    assert mixing.repeat(d).count() == sum(r.copies for r in got)


def test_importance_shifts_the_sample(spark):
    rows = [(i, "w " * 10, "s", 5.0 if i % 2 else 1.0) for i in range(400)] + [(1000 + i, "w " * 10, "t", 1.0) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    got = mixing.mix(d, weights=(1, 3), share=0.5, importance="q").filter("source = 's'").collect()
    odd, even = (sum(r.taken for r in got if r.doc_id % 2 == k) for k in (1, 0))
    assert odd > 3 * even and abs(odd + even - got[0].target) <= 10


def test_documents_of_a_source_have_unequal_chances(spark):
    """Copies expected are in proportion to the binary digits of the size, so the mix prefers longer documents."""
    rows = [(i, "w " * (3 if i % 2 else 60), "a" if i < 4000 else "b") for i in range(8000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.5).filter("source = 'b'").collect()
    short, long_ = ([r for r in got if r.size == n] for n in (3, 60))
    rate = lambda x: sum(r.copies for r in x) / len(x)
    assert rate(short) / rate(long_) == pytest.approx(2 / 6, abs=0.08)
    assert abs(sum(r.taken for r in got) - got[0].target) <= 60


def test_expected_copies_make_the_target(spark):
    """Those that reach the most copies leave their share to the others."""
    rows = [(i, "w " * 10, "s", 100.0 if i < 50 else 1.0 if i < 390 else None) for i in range(400)] + [(1000 + i, "w " * 10, "t", 0.0) for i in range(10)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, q double"), weights=(1, 1), share=0.7, importance="q").collect()
    s = [r for r in got if r.source == "s"]
    assert all(r.copies == 2 for r in s if r.q == 100) and all(r.copies == 0 for r in got if not r.q)
    assert abs(sum(r.taken for r in s) - s[0].target) <= 10


def brute_lines(texts, min_docs):
    key = line_dedup.line_key
    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    return ["\n".join(x for x in (t or "").split("\n") if not (key(x) and n[key(x)] >= min_docs)) for t in texts]


def test_lines(spark):
    rng = random.Random(6)
    pool = ["Common line", " common LINE\t", "x", "", "rare", "É É", "é é", "two  words"] + [f"line {i}" for i in range(80)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    d = docs(spark, texts)
    got = {r.doc_id: r for r in line_dedup.LineIndex.build(d, min_docs=10, shard_keys=8).drop_lines(d, group_bytes=64).collect()}
    want = brute_lines(texts, 10)
    assert [got[i].text for i in range(200)] == want
    assert all(got[i].n_lines == texts[i].count("\n") + 1 and got[i].n_dropped == texts[i].count("\n") + 1 - (want[i].count("\n") + 1 if got[i].n_dropped < got[i].n_lines else 0) for i in range(200))


def test_lines_come_and_go(spark):
    texts = [f"shared\nown {i}" for i in range(12)]
    d = docs(spark, texts)
    first, more = d.filter("doc_id < 8"), d.filter("doc_id >= 8")
    index = line_dedup.LineIndex.build(first)
    assert index.drop_lines(d).agg(F.sum("n_dropped")).first()[0] == 0
    full = index.insert(more)
    assert full.drop_lines(d).agg(F.sum("n_dropped")).first()[0] == 12
    back = full.delete(more)
    assert back.drop_lines(d).agg(F.sum("n_dropped")).first()[0] == 0
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, index.counts.collect()))


def test_updates_touch_only_their_shards(spark):
    line = lambda k: f"line number {k}"
    docs = spark.createDataFrame([(i, "\n".join(line(k) for k in range(400) if (k + i) % 2)) for i in range(6)], "doc_id long, text string")
    index = line_dedup.LineIndex.build(docs, min_docs=3, shard_keys=50)
    assert index.shards == 8
    before = {r.shard: bytes(r.filter) for r in index.filters.collect()}
    more = spark.createDataFrame([(10 + i, "a new line") for i in range(3)], "doc_id long, text string")
    after = index.insert(more)
    held = {r.shard: bytes(r.filter) for r in after.filters.collect()}
    changed = [s for s in before if before[s] != held[s]]
    assert len(changed) == 1 and set(before) == set(held) and after.shards == 8 and len(after.parts) == 2
    assert after.drop_lines(more).filter("n_dropped = 1").count() == 3
    back = after.delete(more)
    assert {r.shard: bytes(r.filter) for r in back.filters.collect()} == before
    assert back.drop_lines(more).filter("n_dropped = 1").count() == 0
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, index.counts.collect()))
    with pytest.raises(ValueError, match="never inserted"):
        back.delete(more)


def test_a_full_filter_is_built_again(spark):
    one = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    index = line_dedup.LineIndex.build(one, min_docs=2)
    text = "\n".join(f"row {k}" for k in range(500))
    many = spark.createDataFrame([(3, text), (4, text)], "doc_id long, text string")
    grown = index.insert(many)
    assert grown.drop_lines(many).filter("n_dropped = 500").count() == 2 and grown.drop_lines(one).filter("n_dropped = 1").count() == 2
    assert {r.n_dropped for r in grown.drop_lines(many, group_bytes=1).collect()} == {500}


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    f = line_dedup.CuckooFilter.from_bytes(line_dedup.CuckooFilter.of(keys).to_bytes())
    assert f.contains(keys).all()
    other = rng.integers(0, 2**64, 100_000, dtype=np.uint64)
    assert f.contains(other).mean() < 1e-3
    f.delete(keys[:10_000])
    assert f.contains(keys[10_000:]).all() and f.contains(keys[:10_000]).mean() < 1e-2
