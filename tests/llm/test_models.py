"""Decontamination and the similarity join against brute force; models by held-out accuracy and exact properties."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerframe.llm import components, decontamination, language_id, lm_scoring, ngram_join, pii, tokens, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def words_of(t):
    return WORD.findall((t or "").translate(FOLD))


def test_words_over_segments(monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT", 64)
    texts = ["", "Aé bc--D " * 40, "x" * 300, None, "ß 日本 Zz", "q " * 100]
    column = pa.array(["skip", *texts])[1:]
    data, _ = tokens.buffers(column)
    got = {}
    for w in tokens.words(column, tokens.ALNUM):
        for d, a, b in zip(w.doc.tolist(), w.start.tolist(), w.end.tolist(), strict=True):
            got.setdefault(d, []).append(tokens.lowered(data[a:b].tobytes()).decode())
    assert [got.get(i, []) for i in range(len(texts))] == [words_of(t) for t in texts]


def brute_hits(text, items, size):
    w = words_of(text)
    hit, who = set(), set()
    for name, item in items:
        x = words_of(item)
        n = min(size, len(x))
        for j in range(len(x) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == x[j : j + n]:
                    hit |= set(range(i, i + n))
                    who.add(str(name))
    return len(w), len(hit), sorted(who)


@pytest.mark.parametrize("group_bytes", [1 << 20, 600])
def test_contamination(spark, group_bytes):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice("abc") + rng.choice(["", "!", "É"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60)), "keep") for i in range(120)]
    items = [(i, text(rng.randint(0, 9))) for i in range(12)]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_hit string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_contamination(d, b, window=4, group_bytes=group_bytes).collect()
    for r in got:
        assert (r.n_words, r.n_hit, r.item_ids) == brute_hits(r.text, items, 4)
    plain = d.drop("n_hit")
    cut = decontamination.remove_contamination(plain, b, whole_documents=False, window=4).collect()
    assert len(cut) == len(docs) and sum(len(words_of(r.text)) for r in cut) == sum(r.n_words - r.n_hit for r in got)
    assert decontamination.remove_contamination(plain, b, window=4).count() == sum(r.n_hit == 0 for r in got)


def brute_join(texts, similarity, size=5):
    sets = {}
    for i, t in texts:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    links, root = Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and common >= similarity * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


@pytest.mark.parametrize("options", [{}, {"bucket": 2, "depth": 2, "block": 6}, {"bucket": 1, "depth": 1, "block": 1000, "block_shingles": 500}])
def test_join(spark, options):
    rng = random.Random(2)
    fresh = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    texts, k = [], 0
    for _ in range(25):
        base = fresh(rng.randint(3, 80))
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 99)}"
            texts.append((k, " ".join(w)))
            k += 1
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.find_near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), recall=0.9999, **options).collect()}
    assert got == brute_join(texts, 0.8)


def test_link_counts_in_strips():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = []
    for _ in range(1500):
        s = base.copy()
        s[rng.integers(0, 60, 3)] = rng.integers(0, 2**63, 3).astype(np.uint64)
        sets.append(np.unique(s))
    n, weight = len(sets), rng.integers(1, 4, 1500)
    earlier = [np.flatnonzero(x) + 1 for x in rng.random((n, 6)) < 0.2]
    links, rows, root = ngram_join.link_counts(sets, np.zeros(n, int), weight, earlier, 0.8)
    for i in rng.integers(0, n, 8).tolist():
        linked = []
        for j in range(n):
            common = len(np.intersect1d(sets[i], sets[j]))
            met = len(np.intersect1d(earlier[i], earlier[j])) > 0
            if j != i and not met and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                linked.append(j)
        assert links[i] == len(linked) and rows[i] == weight[linked].sum() and all(root[j] == root[i] for j in linked)


def test_sketches_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(8)
    for n, share in ((5, 0.8), (20, 0.8), (400, 0.8), (400, 0.5)):
        agree = []
        for _ in range(300):
            common = max(1, round(n * 2 * share / (1 + share)))
            a, b, c = (rng.integers(0, 2**63, k).astype(np.uint64) for k in (common, n - common, n - common))
            agree.append((ngram_join.sketch(np.append(a, b)) == ngram_join.sketch(np.append(a, c))).mean())
        assert np.mean(agree) == pytest.approx(common / (2 * n - common), abs=0.04)


def test_recall_at_the_threshold(spark):
    """Pairs hardly above the threshold among many documents that share passages, with the recall that the query asks for."""
    rng = random.Random(12)
    passage = [[f"p{k}x{i}" for i in range(30)] for k in range(4)]
    texts, pairs = [], []
    for k in range(500):
        w = [f"u{rng.randint(0, 10**9)}" for _ in range(16)] + passage[k % 4]
        rng.shuffle(w) if k % 5 == 0 else None
        other = list(w)
        other[0], other[8] = f"n{k}", f"m{k}"  # 6 of 42 shingles differ: a similarity of 0.75; one change: above 0.8
        other[8] = w[8] if k % 2 else other[8]
        pairs.append((2 * k, 2 * k + 1))
        texts += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    want = brute_join(texts, 0.8)
    got = {r.doc_id: r.n_links for r in ngram_join.find_near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), bucket=3).collect()}
    total = sum(n for _, n in want.values())
    assert total >= 500 and sum(got.values()) >= 0.98 * total and all(got[i] <= want[i][1] for i in got)


def test_a_group_keeps_one_row(spark):
    base = " ".join(f"w{k}" for k in range(60))
    d = spark.createDataFrame([(5, base), (5, base + " more"), (9, base), (None, "a b c"), (None, "A B c"), (7, None), (8, "")], "doc_id long, text string")
    kept = ngram_join.keep_one(d).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [5, 7, 8] and len(kept) == 4


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_language_backs_off(spark):
    rng = random.Random(5)
    stems = {"aa": ["ka", "lo", "mi"], "bb": ["tsch", "pf", "ung"], "cc": ["eau", "oir", "que"]}
    make = lambda k: " ".join("".join(rng.choice(stems[k]) for _ in range(rng.randint(1, 4))) for _ in range(12))
    rows = [(i, make(k), k) for i, k in ((i, rng.choice("abc") * 2) for i in range(400))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_id.identify(d, language_id.fit(d)).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held) and all(0 <= r.score <= 1 for r in out)
    m = language_id.fit(d)
    assert "kalomikalomi" not in m.known and m.languages[int(np.argmax(m.word("kalomikalomi")))] == "aa"
    assert m.word("7") is None


def test_languages_by_brute_force():
    """Whole predictions from word scores that are looked up one by one in plain dictionaries."""
    rng = random.Random(11)
    syllables = {"aa": ["ka", "lo", "mi", "é"], "bb": ["ten", "sor", "lo", "ß"], "cc": ["да", "нет", "ми"]}
    word = lambda k: "".join(rng.choice(syllables[k]) for _ in range(rng.randint(1, 4)))
    by = {k: Counter(word(k) for _ in range(300)) for k in syllables}
    model = language_id.Model.of_counts(by)
    texts = [" ".join(word(rng.choice(k)) for _ in range(rng.randint(1, 30))) + rng.choice(["", " zzz!", " 12", ", Ka-LO"]) for k in rng.choices([["aa"], ["bb"], ["cc"], ["aa", "bb"]], k=200)] + ["", "12 34", "...", None]

    def logs(tables, w):
        whole = sum(t[w] for t in tables)
        if whole < language_id.LEAST:
            return None
        sums = [sum(t.values()) for t in tables]
        return [math.log10(t[w] / n) if t[w] else -math.log10(n) - 1 for t, n in zip(tables, sums, strict=True)]

    names = sorted(by)
    words_ = [by[k] for k in names]
    cut = {n: [Counter() for _ in names] for n in range(1, language_id.LONGEST + 1)}
    for n, tables in cut.items():
        for t, own in zip(tables, words_, strict=True):
            for w, c in own.items():
                for g in language_id.grams(w, n):
                    t[g] += c
            t.pop(" ", None)

    def score(w):
        own = logs(words_, w)
        for n in range(language_id.LONGEST, 0, -1):
            if own is not None:
                return own
            found = [x for x in (logs(cut[n], g) for g in language_id.grams(w, n) if g != " ") if x]
            own = [sum(c) / len(found) for c in zip(*found, strict=True)] if found else None
        return own

    got, p = model.predict(pa.array(texts))
    for t, lang, q in zip(texts, got, p.tolist(), strict=True):
        scores = [x for x in map(score, re.findall(r"[^\W\d_]+", (t or "").lower())) if x]
        if not scores:
            assert lang == "und" and q == 0 or t
            continue
        mean = [sum(c) / len(scores) for c in zip(*scores, strict=True)]
        best = max(range(len(names)), key=lambda k: (mean[k], -k))
        e = [math.exp((m - mean[best]) * math.log(10) * min(len(scores), language_id.EVIDENCE)) for m in mean]
        assert lang == names[best] and q == pytest.approx(1 / sum(e), rel=1e-3)


def test_a_small_language_keeps_its_words(monkeypatch):
    monkeypatch.setattr(language_id, "WORDS", 40)
    by = {"big": Counter({f"big{k}": 1000 - k for k in range(200)}), "small": Counter({f"klein{k}": 2 for k in range(20)})}
    known = language_id.Model.of_counts(by).known
    assert sum(w.startswith("klein") for w in known) == 20 == sum(w.startswith("big") for w in known)


def test_language_model(spark):
    rng = random.Random(6)
    follow = {"a": "bc", "b": "a", "c": "d", "d": "ab"}

    def make():
        w = ["a"]
        while len(w) < 60:
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(w) + (" rare%d" % rng.randint(0, 50))

    rows = [(i, make()) for i in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    held_out = lm_scoring.remainder("doc_id", 7) == 2
    counts = lm_scoring.Counts(d, ~held_out, words_=8, block_bytes=4000)
    net = lm_scoring.train(counts, rounds=3)
    one, two, z = net.tables()
    p = np.exp(one[:, None, :].astype(float) + two[None, :, :] - z[:, :, None]).sum(2)
    assert np.allclose(p, 1, atol=1e-4)
    out = lm_scoring.score(counts, net).collect()
    c = Counter()
    own = {i: [*t.split(), "END"] for i, t in rows}
    for i, w in own.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(w)
    n, v = sum(c.values()), len(c)
    for r in out:
        w = own[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 12 <= len(re.sub(r"\D", "", s)) <= 19 and pii.luhn(re.sub(r"\D", "", s))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15),
]


def test_base_spans_are_the_patterns():
    rng = random.Random(7)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8.9", "4111 1111-1111 1111", "4111111111111112", "+1 (743) 555-3824", "+", "..", " ", "-", "é", "7", "a@b.c@d.e", "\n", "(", "00000000001.1.1.1"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        want = [(m.start(), m.end(), k) for k, p, ok in BASE for m in p.finditer(t) if ok(m[0])]
        assert pii.base_spans(t) == sorted(want, key=lambda s: (s[0], pii.KINDS.index(s[2]))), t
    assert pii.base_spans("a" * 200_000 + "@" + "1." * 50_000) is not None


def test_field_finds_disguised_spans():
    rng = random.Random(8)
    lines = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(12)) for _ in range(200)]
    field = pii.train_field(lines)
    found = added = 0
    for k in range(200):
        kind = pii.KINDS[k % 4]
        hidden = pii.disguised(rng, kind, pii._made_up(rng, kind))
        text = f"{lines[k][:30]} {hidden} {lines[k][30:]}"
        spans = field.spans(text)
        found += (31, 31 + len(hidden), kind) in spans
        assert set(pii.base_spans(text)) <= set(spans)
    for line in lines:
        added += len(field.spans(f"{line} version 2.0 of 2024-11-02 item 1234567 id f33e61083db5"))
    assert found >= 150 and added <= 4


def test_redaction(spark):
    d = spark.createDataFrame([(1, "mail a@b.cd or +1 (743) 555-3824 now"), (2, None), (3, "clean")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(d, pii.train_field(["some words here"])).collect()}
    assert got == {1: "mail <email> or <phone> now", 2: None, 3: "clean"}


def test_toxicity(spark):
    rng = random.Random(9)
    syllables = ["ka", "lo", "mi", "ten", "sor", "ga", "ril"]
    plain = lambda n: ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    rows, labels = [], []
    for i in range(1200):
        w, bad = plain(80), i % 6 == 0
        for _ in range(3 if bad else 0):
            w[rng.randrange(80)] = rng.choice(["vilething", "nastyword", "hatefulxx", "zworg" + rng.choice(syllables)])
        rows.append((i, " ".join(w).capitalize() + "."))
        labels.append((i, 1, int(bad)))
    d, l = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.score(d, toxicity.fit(d, l)).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    bad = [r for r in held if r.doc_id % 6 == 0]
    good = [r for r in held if r.doc_id % 6]
    assert sum(r.predicted for r in bad) >= 0.9 * len(bad) and sum(r.predicted for r in good) <= 0.03 * len(good)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert [r.score for r in toxicity.score(d, toxicity.fit(d, l.filter("toxic = 0"))).take(2)] == [0, 0]


def test_language_model_tells_rare_words_apart(spark):
    """The vocabulary grows with the corpus, and words past it are not one class."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(4000)}" for _ in range(50)) for _ in range(2000)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    small, large = (lm_scoring.Counts(d.filter(f"doc_id < {n}"), lm_scoring.F.lit(True)) for n in (20, 2000))
    assert lm_scoring.WORDS >= 1000 > len(small.keys) and len(large.keys) > 2 * lm_scoring.WORDS
    assert large.hashed > 1
    net = lm_scoring.Network(large.keys, large.noise)
    net.set_flat(net.flat() + np.random.default_rng(1).normal(0, 0.3, len(net.flat())).astype(np.float32))
    v = len(large.noise)
    for one, two in ((0, 1), (v - 2, v), (v, v)):  # words, a hash class, the start
        p = np.exp(net.log_p(np.arange(v), np.full(v, one), np.full(v, two)))
        assert p.sum() == pytest.approx(1, abs=1e-5)
    assert np.isfinite(lm_scoring.train(large, rounds=1).flat()).all()
    rare = np.setdiff1d(np.arange(1, 2000, dtype=np.uint64), large.keys)
    own, _, _ = net.classes(np.zeros(len(rare), int), rare)
    assert len(set(own)) > 1
    a, b = np.flatnonzero(own == own[0])[0], np.flatnonzero(own != own[0])[0]
    after = [net.log_p(np.array([0]), np.array([own[k]]), np.array([v]))[0] for k in (a, b)]
    assert after[0] != after[1]
