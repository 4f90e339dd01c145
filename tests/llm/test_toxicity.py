import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from tessera.llm import toxicity
from tessera.llm import toxicity as T


def fixture(n=900):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [word() for _ in range(30)]
        if toxic:
            for _ in range(3):
                words[rnd.randrange(30)] = rnd.choice(["zork", "blag", "quux"]) + rnd.choice(["", "!!", "###"])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, quality long, toxic long")
    got = toxicity.score(d, toxicity.train(d, y)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)


def test_weights_are_sparse_and_ftrl_matches_scalar_loop():
    rnd = np.random.default_rng(0)
    rows = [(np.unique(np.r_[rnd.integers(10, 5000, 20), [7] if y else [8]]), int(y)) for y in rnd.random(400) < 0.3]
    index, value, bias = toxicity.ftrl(rows, epochs=3)
    assert 7 in index and value[list(index).index(7)] > 0 and len(index) < 200
    # the same recurrences, one coordinate at a time
    z, n, zb, nb = {}, {}, 0.0, 0.0
    counts = np.bincount(np.concatenate([x for x, _ in rows]), minlength=5001)
    T = toxicity
    w = lambda z, n: 0.0 if abs(z) <= T.L1 else -(z - np.sign(z) * T.L1) / ((T.BETA + n**0.5) / T.ALPHA + T.L2)
    for _ in range(3):
        for x, y in rows:
            x = [i for i in x if counts[i] >= T.MIN_DOCS]
            wb = -zb / ((T.BETA + nb**0.5) / T.ALPHA + T.L2)
            s = sum(w(z.get(i, 0), n.get(i, 0)) for i in x) + wb
            g = (1 / (1 + np.exp(-s)) - y) * (T.POSITIVE_WEIGHT if y else 1)
            for i in x:
                a, b = z.get(i, 0.0), n.get(i, 0.0)
                z[i] = a + g - ((b + g * g) ** 0.5 - b**0.5) / T.ALPHA * w(a, b)
                n[i] = b + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / T.ALPHA * wb
            nb += g * g
    want = {i: w(z[i], n[i]) for i in z if w(z[i], n[i])}
    assert set(want) == set(index.tolist())
    assert np.allclose([want[i] for i in index.tolist()], value)


def test_edges(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a b"), (3, "x " * 50_000)], "doc_id long, text string").selectExpr("*", "1 as score")
    y = spark.createDataFrame([(1, 1, 0), (1, 1, None), (None, 1, 1)], "doc_id long, quality long, toxic long")
    got = toxicity.score(d, toxicity.train(d, y)).collect()
    assert len(got) == 5 and all(0 <= r.score < 0.7 and r.predicted == 0 for r in got)
    assert toxicity.score(d.limit(0), toxicity.train(d.limit(0), y.limit(0))).count() == 0


def test_coordinates_equal_features_hashed_one_by_one(monkeypatch):
    monkeypatch.setattr(T, "VOCABULARY", 5)  # the table starts anew again and again
    top = 1 << 64
    h = lambda w, seed=0: xxhash.xxh3_64_intdigest(w, seed=seed)
    place = lambda x: (x * int(T._MIX) % top) >> (64 - T.BITS)

    def brute(text):
        words = re.findall(r"\w+", (text or "").lower())
        out = [h(w) for w in words] + [h(w[:n], n) for n in T.STARTS for w in words]
        for gap, by in ((1, T._PAIR), (2, T._SKIP)):
            for a, b in zip(words, words[gap:]):
                x = (h(a) * int(by) + h(b)) % top
                out.append(x ^ (x >> 31))
        return sorted(map(place, out))

    vocabulary = T._Vocabulary()
    for text in (None, "", "one", "Two words", "a b c a b c d e f g h", "Größe çà и ещё 123 x_y", "lots " * 50, "trash, trash! and Idiotic-things"):
        assert sorted(T.coordinates(text, vocabulary).tolist()) == brute(text)


def test_scores_equal_the_sum_of_weights(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "gamma " * 4)], "doc_id long, text string")
    vocabulary = T._Vocabulary()
    index = np.unique(T.coordinates("alpha beta gamma", vocabulary))
    value = np.linspace(-1, 2, len(index))
    weights = dict(zip(index.tolist(), value.tolist()))
    got = {r.doc_id: r.score for r in T.score(docs, (index, value, -0.5)).collect()}
    for i, text in ((1, "alpha beta"), (2, None), (3, "gamma " * 4)):
        total = sum(weights.get(c, 0.0) for c in set(T.coordinates(text, vocabulary).tolist())) - 0.5
        assert got[i] == pytest.approx(1 / (1 + math.exp(-total)))
