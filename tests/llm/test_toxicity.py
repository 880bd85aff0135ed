"""Compression distances against one-by-one compression of windows cut by a regular expression."""

import random
import re

import numpy as np
import pyarrow as pa
import zstandard

from ledgerframe.llm import toxicity as tx

GAP = re.compile(tx._GAP)


def brute_windows(text):
    """The bytes of each window of a text, as the definition has them."""
    words = [w for w in GAP.sub(" ", (text or "").lower()).split(" ") if w]
    whole = f"{tx._LEAD} {' '.join(words)} {tx._TAIL}" if words else ""
    out, at = [], len(tx._LEAD) + 1
    for k in range(0, len(words), tx.WINDOW):
        size = len(" ".join(words[k : k + tx.WINDOW]))
        out.append(whole[0 if k == 0 else at - 1 : at + size + tx._AFTER].encode())
        at += size + 1
    return out


def sizes(content, windows):
    parameters = zstandard.ZstdCompressionParameters(compression_level=1, strategy=zstandard.STRATEGY_FAST, window_log=19, hash_log=20, min_match=5, target_length=0, write_content_size=False, write_checksum=False, write_dict_id=False)
    trained = zstandard.ZstdCompressionDict(content + tx._LEAD.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(compression_params=parameters)
    return [len(zstandard.ZstdCompressor(dict_data=trained, compression_params=parameters).compress(w)) for w in windows]


def corpus(n=500, seed=4):
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ten", "sor", "ga", "ril"]
    texts, toxic = [], []
    for i in range(n):
        w = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.choice((5, 60)))]
        toxic.append(int(i % 4 == 0))
        for _ in range(3 * toxic[-1]):
            w[rng.randrange(len(w))] = rng.choice(["vilething", "nastyword", "hatefulxx"])
        texts.append(rng.choice([" ", ", "]).join(w).capitalize())
    return texts, toxic


def test_scores_are_the_compressed_lengths():
    texts, toxic = corpus()
    model = tx.model_of([(y, (0, 1, 3)[i // 4 % 3], t) for i, (t, y) in enumerate(zip(texts, toxic, strict=True))])
    ordinary, own = model.distance.contents
    odd = [None, "", "--", "Ä ñandú 日本 vilething", "a", *texts[:20]]
    got = model.features(pa.array(["skip", *odd])[1:])
    for x, t in zip(got, odd, strict=True):
        w = brute_windows(t)
        saved = sorted((max(0, a - b) for a, b in zip(sizes(ordinary, w), sizes(own, w), strict=True)), reverse=True) + [0] * 4
        assert x.tolist() == [saved[0], saved[1], saved[2] + saved[3], np.log1p(len(w))]
    z = model.weights[0] + got @ model.weights[1:]
    assert np.allclose(model.scores(pa.array(odd)), 1 / (1 + np.exp(-z)))


def test_dictionaries_hold_text_of_their_class():
    texts, toxic = corpus()
    ordinary, own = tx.train_distance([t for t, y in zip(texts, toxic, strict=True) if y], [t for t, y in zip(texts, toxic, strict=True) if not y]).contents
    assert all(w in own and w not in ordinary for w in (b"vilething", b"nastyword", b"hatefulxx"))
    assert len(own) == len(ordinary) and own[-2000:] == ordinary[-2000:]


def test_very_long_words_are_read_in_parts():
    column = tx.normalised(pa.array(["x" * 5000 + " a b c", "short one"]))
    (data, doc, start, end), = tx.window_edges(column)
    assert (end - start).max() <= tx.PART and len(doc) > 8
    read = np.zeros(len(data), bool)
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        read[a:b] = True
    assert read.all()


def test_nothing_to_tell_apart():
    same = [(k % 2, k % 4, "same words in every document of it") for k in range(80)]
    assert tx.model_of(same).distance is None and tx.model_of([]).weights[0] == 0
    assert tx.model_of([(1, 0, "a"), (0, 0, "b")]).distance is None  # nothing to calibrate on
