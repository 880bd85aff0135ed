"""The semi-Markov field against enumeration of all segmentations, and texts that are hard to read."""

import random
import time

import numpy as np
import pytest

from ledgerframe.llm import pii


@pytest.fixture(scope="module")
def field():
    return pii.train_field(["call 555 now", "see the page 12 of it", "a b c d", "mail anna@example.com today", "host 10.0.0.1 is up"])


def _segmentations(lattice, at=0):
    """All ways to cut the atoms from ``at`` on into candidates and single atoms."""
    if at == lattice.n:
        yield ()
        return
    yield from _segmentations(lattice, at + 1)
    for k, (i, j) in enumerate(lattice.spans):
        if i == at:
            for rest in _segmentations(lattice, j):
                yield (k, *rest)


@pytest.mark.parametrize("text", ["a 1234 5678 b", "x (555) 123-4567", "1.2.3.4", "bo@ex.org 12345", "no digits here"])
def test_marginals_and_best_cut_agree_with_enumeration(field, text):
    lattice = pii.Lattice(text, 0, len(text))
    rng = np.random.default_rng(len(text))
    w = field.w + rng.normal(0, 0.5, field.w.shape)
    score = lattice.x @ w.T if lattice.spans else np.zeros((0, 4))
    total, by, best = 0.0, np.zeros(score.shape), (-1.0, ())
    for cut in _segmentations(lattice):
        # every span of a cut has one of the kinds: sums over kinds factor
        weight = float(np.exp(sum(np.logaddexp.reduce(score[k]) for k in cut)))
        total += weight
        for k in cut:
            by[k] += weight * np.exp(score[k] - np.logaddexp.reduce(score[k]))
        top = sum(score[k].max() for k in cut)
        if top > best[0] or best[0] < 0 and not cut:
            best = (max(top, 0.0), cut) if top > 0 or not cut else best
    p, z = lattice.marginals(w)
    assert np.allclose(p, by / total) and np.isclose(z, np.log(total))
    assert sum(score[k].max() for k, _ in lattice.best(w)) == pytest.approx(best[0])


def test_only_ascii_digits_are_digits(field):
    for text in ("area 123456789012 m²", "123456789012²", "٣٣٣٣ ٤٤٤٤ ٥٥٥٥ ٦٦٦٦", "call +49 ²²² 123456789"):
        assert all(0 <= a < b <= len(text) for a, b, _ in field.spans(text))
    assert pii.base_spans("+4912345678²") == [(0, 11, "phone")]


def test_very_long_runs_of_digits(field):
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(0, 5006, "ip")]
    assert field.spans("9" * 100_000 + ".1.1.1") == []
    assert field.spans("7" * 10_000_000) == []  # one atom


def test_time_grows_in_proportion_on_a_line_of_digits(field):
    def seconds(n):
        line = " ".join(str(1000 + k % 9000) for k in range(n))
        began = time.process_time()
        field.spans(line)
        return time.process_time() - began

    seconds(2000)
    assert seconds(40_000) < 25 * seconds(4000) + 1


def test_pieces_find_what_the_whole_finds(field):
    rng = random.Random(3)
    parts = []
    for k in range(300):
        kind = pii.KINDS[k % 4]
        parts += ["und so weiter", pii.disguised(rng, kind, pii._made_up(rng, kind))]
    text = " ".join(parts)
    whole, small = field.spans(text, piece=len(text)), field.spans(text, piece=300)
    assert len(set(whole) ^ set(small)) <= 0.02 * len(whole) and len(whole) > 100


def test_known_shapes_give_the_features_of_the_text():
    rng = random.Random(4)
    for _ in range(300):
        text = "a " + "".join(rng.choice("0123456789 .-()@a") for _ in range(24)) + " b"
        lattice = pii.Lattice(text, 0, len(text), {})
        for (i, j), x in zip(lattice.spans, lattice.x, strict=True):
            a, b = lattice.at[i], lattice.at[j]
            assert (x == pii.features(text[a:b], text[a - 1 : a], text[b : b + 1])).all()


def test_disguises_of_every_kind_can_be_candidates():
    rng = random.Random(5)
    for k in range(400):
        kind = pii.KINDS[k % 4]
        hidden = pii.disguised(rng, kind, pii._made_up(rng, kind))
        lattice = pii.Lattice(f"see {hidden} there", 0, len(hidden) + 10)
        assert (4, 4 + len(hidden)) in {(lattice.at[i], lattice.at[j]) for i, j in lattice.spans}, hidden


def test_fit_does_not_depend_on_partitions_or_copies(spark):
    rows = [(k, f"text {k} with 12{k} numbers and a{k}@example.org\nline {k * 7919}") for k in range(60)]
    once = pii.fit(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    many = pii.fit(spark.createDataFrame(rows + rows[:5] * 20, "doc_id long, text string").repartition(7))
    assert np.array_equal(once.w, many.w)
