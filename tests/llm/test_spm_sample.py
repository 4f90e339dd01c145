import itertools
import math
import os
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import spm_sample as S

pytestmark = pytest.mark.skipif(not os.path.exists(S.DEFAULT_MODEL), reason="no tokenizer model")
_pieces: dict[str, S.Pieces] = {}


@pytest.fixture(scope="module")
def sampler():
    return S.Sampler(k=2)


def enumerate_all(sampler, text):
    """Every segmentation of a short text with its probability, by plain recursion."""
    p = sampler.pieces

    def split(chunk):
        if not chunk:
            return [((), 0.0)]
        out = []
        for j in range(1, len(chunk) + 1):
            sub = chunk[:j]
            if sub in p.ids:
                head = ((p.ids[sub],), p.logw[p.ids[sub]])
            elif j == 1:
                raw = sub.encode()
                head = (tuple(p.byte_ids[b] for b in raw), p.byte_logw * len(raw))
            else:
                continue
            out += [(head[0] + t, head[1] + w) for t, w in split(chunk[j:])]
        return out

    parts = []
    for chunk in S.chunks_of(text):
        one = split(chunk)
        z = math.log(sum(math.exp(w) for _, w in one))
        parts.append([(ids, w - z) for ids, w in one])
    return {sum((ids for ids, _ in combo), ()): sum(w for _, w in combo) for combo in itertools.product(*parts)}


def test_probabilities_and_order(sampler):
    for text in ["the cat", "a  b", "é\n😀", "to", " x "]:
        every = enumerate_all(sampler, text)
        assert math.isclose(sum(map(math.exp, every.values())), 1, rel_tol=1e-9)
        for key in range(40):
            [(samples, bound)] = sampler.sample([key], [text])
            assert len({tuple(s.ids) for s in samples}) == len(samples) == min(2, len(every))
            for s in samples:
                assert math.isclose(every[tuple(s.ids.tolist())], s.log_prob, abs_tol=1e-9) and sampler.decode(s.ids) == text
            assert sorted((s.perturbed for s in samples), reverse=True) == [s.perturbed for s in samples] and bound <= samples[-1].perturbed
            assert (bound == -math.inf) == (len(every) <= 2)


@pytest.mark.parametrize("steps", [64, 1, 2])
def test_sampling_without_replacement_is_exact(monkeypatch, steps):
    monkeypatch.setattr(S, "STEPS", steps)
    sampler = S.Sampler(k=2)
    text, n = "the of it", 6000
    every = {k: math.exp(v) for k, v in enumerate_all(sampler, text).items()}
    # P(in the top two) of sampling without replacement: p_a + sum over b of p_b p_a / (1 - p_b)
    want = {a: pa + sum(pb * pa / (1 - pb) for b, pb in every.items() if b != a) for a, pa in every.items()}
    first, both, estimate = Counter(), Counter(), 0.0
    keys = list(range(n))
    for a in range(0, n, 500):
        for samples, bound in sampler.sample(keys[a : a + 500], [text] * 500):
            first[tuple(samples[0].ids.tolist())] += 1
            both.update(tuple(s.ids.tolist()) for s in samples)
            estimate += sum(math.exp(s.log_prob) / S.inclusion(s.log_prob, bound) for s in samples)
    for ids, p in every.items():
        for got, q in ((first[ids] / n, p), (both[ids] / n, want[ids])):
            assert abs(got - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-3, (ids, got, q)
    assert abs(estimate / n - 1) < 0.05  # inclusion scores weigh the samples without bias


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_round_trip(text):
    sampler = _pieces.setdefault("s", S.Sampler(k=3))
    [(samples, _)] = sampler.sample([text], [text])
    assert 1 <= len(samples) <= 3
    assert all(sampler.decode(s.ids) == text for s in samples)


def test_batches_do_not_change_samples(sampler):
    texts = ["the quick brown fox", None, "", "jumps over " * 30, "x" * 3000, "▁literal▁", "é" * 5]
    keys = list(range(len(texts)))
    one = [sampler.sample([k], [t])[0] for k, t in zip(keys, texts)]
    many = S.Sampler(k=2).sample(keys, texts)
    assert [[s.ids.tolist() for s in x[0]] for x in one] == [[s.ids.tolist() for s in x[0]] for x in many]
    assert [len(x[0]) for x in many[1:3]] == [1, 1]


def test_frame(spark):
    rows = [(1, "hello there world"), (1, "hello there world"), (None, None), (3, "a " * 20_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids")
    full = S.segmentations(d).collect()
    texts = dict(rows)
    assert len(full) == 7 and all(r.decoded == (texts[r.doc_id] or "") for r in full)
    twice = [tuple(r.ids) for r in full if r.doc_id == 1]
    assert len(set(twice)) == 2 and Counter(twice).most_common(1)[0][1] == 2
    assert all(r.round_trip and r.n_pieces == len(r.ids) and 0 < r.inclusion <= 1 for r in full)
    assert S.segmentations(d.limit(0)).count() == 0


def test_full_memory_does_not_change_samples(sampler, monkeypatch):
    texts = [f"some words {i % 7} and  others {'y' * (i % 5)}" for i in range(60)]
    want = [x for i, t in enumerate(texts) for x in sampler.sample([i], [t])]
    monkeypatch.setattr(S, "CACHE_NODES", 40)
    small = S.Sampler(k=2)
    got = [x for i, t in enumerate(texts) for x in small.sample([i], [t])]
    assert [[s.ids.tolist() for s in x[0]] for x in want] == [[s.ids.tolist() for s in x[0]] for x in got]
    assert small.lattices.n_nodes < 200


def test_chunks_are_found_in_joined_texts():
    texts = ["a  b c ", " ", "", "  x", "y"]
    whole = [" " + t for t in texts if t]
    codes = np.frombuffer("".join(whole).encode("utf-32-le"), np.uint32)
    starts = S.chunk_starts(codes, np.cumsum([0, *map(len, whole)])[:-1])
    joined = "".join(whole)
    assert [joined[a:b] for a, b in zip(starts, [*starts[1:], len(joined)])] == [c for t in texts if t for c in S.chunks_of(t)]
