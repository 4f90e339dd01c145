import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import neighbours
from tessera.llm import neighbours as N

LABELS = "doc_id long, quality long, toxic long"


def fixture(n=600):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(5, 60))]
        if i % 4 == 0:
            junk = rnd.choice([lambda w: w + rnd.choice(["###", "%%%"]), lambda w: w.upper() + "!!", lambda w: w + " |", lambda w: f"{w} {w}"])
            words = [junk(w) for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 4 != 0), 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = fixture()
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    got = neighbours.score(d, neighbours.train(d, y)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == N.is_held_out(str(r.doc_id)) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 != 0) for r in held) >= 0.98 * len(held) > 90


def test_counts_equal_terms_counted_one_by_one(monkeypatch):
    monkeypatch.setattr(N, "WORDS", 4)  # the table starts anew again and again
    top = 1 << 64
    h = lambda w, seed=0: xxhash.xxh3_64_intdigest(w, seed=seed)

    def plain(text):
        words, out = (text or "").split(), np.zeros(N.TERMS)
        kinds = [h(N.shape(w)) for w in words]
        terms = [h(w.lower(), 1) for w in words] + kinds + [(a * int(N._FIRST) + b * int(N._SECOND)) % top for a, b in zip(kinds, kinds[1:])]
        again = sum(a == b for a, b in zip(words, words[1:]))
        if words:
            terms += [h(f"repeated {8 * again // len(words)}/8", 2)] * len(words) + [h("repeated", 2)] * again
        for t in terms:
            out[t * int(N._MIX) % top >> 51] += 1
        return out

    known = N._Words()
    for text in (None, "", "one", "a a b B b", "Größe, çà 12345 ### !!!", "x " * 999, " ".join(f"w{i % 50}" for i in range(300))):
        assert (N.counts(text, known) == plain(text)).all()
    assert [N.shape(w) for w in ("Ünder12", "SHOUT!!!!", "_a_", "|", "9999x")] == ["Xxx99", "XX!!", "_x_", "|", "99x"]


def test_blocks_vote_like_a_plain_search():
    rnd = np.random.default_rng(5)
    rows = rnd.poisson(0.3, (120, N.TERMS)).astype(np.float32) * (rnd.random(N.TERMS) < 0.02)
    good = rnd.random(120) < 0.7
    model = N.fit(rows, good)
    assert model.vectors.shape == (120, N.RANK) and np.allclose(np.linalg.norm(model.vectors, axis=1), 1, atol=1e-4)
    queries = np.vstack([rows[:40] + rnd.poisson(0.01, (40, N.TERMS)), np.zeros((1, N.TERMS))])
    got = N.votes(queries, model)
    for q, s in zip(queries, got):
        w = np.log1p(q) * model.weights
        z = (w / (np.linalg.norm(w) or 1)) @ model.loadings
        z = z / np.linalg.norm(z) if np.linalg.norm(z) > 1e-6 else 0 * z
        near = sorted(((float(np.clip(z @ v, 0, 1)), g) for v, g in zip(model.vectors, model.good)), key=lambda x: -x[0])[: N.VOTERS]
        up, down = sum(c**N.POWER * g for c, g in near) + N.PRIOR * model.share, sum(c**N.POWER for c, _ in near) + N.PRIOR
        assert s == pytest.approx(up / down, abs=1e-4)
    assert got[-1] == pytest.approx(model.share, abs=1e-6)


def test_latent_space_is_the_best_of_its_rank():
    rnd = np.random.default_rng(6)
    rows = (rnd.random((90, 3)) @ rnd.random((3, N.TERMS)) * 5).astype(np.float32)
    model = N.fit(rows, np.ones(90))
    a = N.unit(np.log1p(rows) * model.weights)
    s = np.linalg.svd(a, compute_uv=False)
    assert np.linalg.norm(a - a @ model.loadings @ model.loadings.T) <= 1.02 * np.linalg.norm(s[N.RANK :]) + 1e-3


def test_edges(spark):
    long = "word after word " * 60_000
    d = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a b"), (3, long), (3, "short")], "doc_id long, text string").withColumns({"score": F.lit(1), "quality": F.lit("x")})
    y = spark.createDataFrame([(1, 1, 0), (1, None, None), (None, 1, 1), (3, 1, 0), (3, 0, 0)], LABELS)
    model = neighbours.train(d, y)
    got = neighbours.score(d, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in got if r.doc_id in (1, 2)] == [pytest.approx(model.share, abs=1e-6)] * 3
    none = neighbours.train(d.limit(0), y.limit(0))
    assert neighbours.score(d.limit(0), none).count() == 0
    assert [r.score for r in neighbours.score(d, none).collect()] == [0.5] * 6
    assert len(neighbours.train(*(spark.createDataFrame(x, s) for x, s in zip(fixture(200), ("doc_id long, text string", LABELS))), max_train=50).good) == 50


def test_no_label_no_language_is_read(spark):
    docs, labels = fixture(100)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = neighbours.train(d, spark.createDataFrame(labels, LABELS))
    plan = neighbours.score(d.withColumns({"lang": F.lit("x"), "source": F.lit("y")}), model)
    assert {r.doc_id: r.score for r in plan.collect()} == {r.doc_id: r.score for r in neighbours.score(d, model).collect()}
    assert not re.search("lang|source", str(plan.columns))
