"""Candidates of small buckets grow with their members, not with the square, and lose no link."""

import numpy as np

from tessera.llm import ngram_join as N


def bucket_edges(join, texts):
    shingles = N.Shingler(join.width)
    sets = [shingles(t) for t in texts]
    size = np.array([len(s) for s in sets])
    roughs = [N.rough(N.sketch(N._mix(s + N._C))) for s in sets]
    where = np.cumsum([0, *map(len, roughs)])[:-1]
    flat = np.frombuffer(b"".join(roughs), np.uint8)
    doc = np.arange(len(sets)) + 10
    found = N._pairs(join, np.array([0]), np.array([len(sets)]), doc, size, flat, where, np.arange(len(sets)))
    return [(a - 10, b - 10, c) for e in found for a, b, c in zip(*(x.tolist() for x in e))], sets


def test_a_bucket_gives_fewer_edges_than_members_and_ties_every_link():
    rnd = np.random.default_rng(3)
    join = N.Join(5, 80, 100)
    texts = []
    for n in (40, 200, 900, 2500):  # sketches of several lengths
        base = [f"w{i}" for i in rnd.integers(0, 5000, n)]
        for _ in range(12):
            copy = list(base)
            copy[int(rnd.integers(n))] = "other"
            texts.append(" ".join(copy))
    texts += [" ".join(f"v{i}" for i in rnd.integers(0, 5000, 60)) for _ in range(10)]
    edges, sets = bucket_edges(join, texts)
    assert 0 < len(edges) < len(texts)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if join.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    assert len(links) > len(texts)
    assert all(root(a) == root(b) for a, b in links)
    # a closed edge stands for itself: its bucket's other pairs are no links
    assert not any(closed for *_, closed in edges)


def test_pairs_without_a_cycle_are_closed():
    join = N.Join(5, 80, 100)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base), " ".join([*base, "more"]), " ".join(f"v{i}" for i in range(300))]
    assert bucket_edges(join, texts)[0] == [(0, 1, True)]
