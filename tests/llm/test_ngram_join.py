import random
import re
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import components as C
from tessera.llm import ngram_join as N


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(docs, width, num, den):
    sets = {i: shingle_set(t, width) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, n=160):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(3))
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE TWO"), (7, "é Éa b"), (8, "É éa b"), (9, "x\x0by\x0cz")]
    while len(docs) < n:
        base = [word() for _ in range(rnd.choice([4, 8, 12, 30, 60, 120]))]
        for _ in range(rnd.randint(1, 14)):
            w = list(base)
            for _ in range(rnd.randint(0, 1 + len(base) // 20)):
                at = rnd.randrange(len(w))
                rnd.choice([lambda: w.__setitem__(at, word()), lambda: w.insert(at, word()), lambda: w.pop(at) if len(w) > 2 else None])()
            docs.append((len(docs), " ".join(w)))
    return docs


@pytest.mark.parametrize(("width", "num", "den", "wide"), [(3, 90, 100, False), (5, 80, 100, False), (3, 90, 100, True), (5, 80, 100, True)])
def test_equals_brute_force(spark, monkeypatch, width, num, den, wide):
    if wide:
        monkeypatch.setattr(N, "plans", lambda join, histogram: dict.fromkeys(range(200), True))
        monkeypatch.setattr(N, "BLOCK_SHINGLES", 400)  # many blocks
        monkeypatch.setattr(N, "SMALL_BUCKET", 2)  # and hubs in nearly every bucket
        monkeypatch.setattr(N, "LOCAL_BUCKET", 1)
    docs = corpus(width + wide)
    got = N.classify(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), width, num, den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, width, num, den) and len(got) == len(docs)


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_frequent_shingles_and_small_blocks_change_nothing(spark, monkeypatch, width, num):
    """Every repeated shingle counts as frequent, buckets go by hubs, and blocks hold a few sets."""
    for name, value in {"FREQUENT_DOCS": 2, "REPEATED": 1, "SMALL_BUCKET": 2, "LOCAL_BUCKET": 1, "BLOCK_SETS": 3, "BLOCK_SKETCHES": 4, "BLOCK_SHINGLES": 500}.items():
        monkeypatch.setattr(N, name, value)
    docs = corpus(20 + width)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert len(N.frequent(frame, width)) > 50
    got = N.classify(frame, width, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, width, num, 100) and len(got) == len(docs)


def test_signatures_of_linked_sets_meet_whatever_is_frequent():
    rnd = random.Random(4)
    for num in (80, 90):
        join = N.Join(3, num, 100)
        for _ in range(400):
            n = rnd.choice([3, 8, 20, 60, 200])
            x = {rnd.getrandbits(64) for _ in range(n)}
            y = set(x)
            while True:  # as different as a link allows
                z = set(y)
                z.discard(rnd.choice(sorted(z)))
                if rnd.random() < 0.5:
                    z.add(rnd.getrandbits(64))
                if not z or not join.linked(len(x & z), len(x), len(z)):
                    break
                y = z
            common = np.array(sorted(k for k in x | y if rnd.random() < rnd.choice([0.2, 0.9, 1.0])), np.uint64)
            a, b = (np.array(sorted(s), np.uint64) for s in (x, y))
            assert set(N.signatures(join, a, {}, common).tolist()) & set(N.signatures(join, b, {}, common).tolist())


def test_sketches_never_rule_out_a_link():
    rnd = random.Random(9)
    join = N.Join(3, 80, 100)
    sets = []
    for _ in range(12):
        base = [rnd.getrandbits(64) for _ in range(rnd.choice([10, 100, 2000]))]
        for _ in range(5):
            sets.append(np.array(sorted({x for x in base if rnd.random() < 0.95} | {rnd.getrandbits(64) for _ in range(rnd.randrange(3))}), np.uint64))
    n, label = np.array([len(s) for s in sets]), np.arange(len(sets))
    sketches = [N.sketch(N._mix(s + N._C)).tobytes() for s in sets]
    every = np.arange(len(sets))
    got = set(zip(*(c.tolist() for c in N.possible_pairs(join, n, label, sketches, every, every, True))))
    linked = {(i, j) for i in every.tolist() for j in every.tolist() if i < j and join.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    assert linked and linked <= got and len(got) < len(sets) * (len(sets) - 1) / 4
    forest = N.forest(*map(list, zip(*sorted(got))))
    assert len(forest) < len(sets) and set(forest) <= got


def test_blocks_are_bounded_by_sets():
    sets = [np.arange(i, i + 10, dtype=np.uint64) for i in range(2 * N.BLOCK_SETS)]
    tracemalloc.start()
    ok = N.block_matrix(N.Join(3, 80, 100), list(range(len(sets))), sets, np.arange(len(sets)) < N.BLOCK_SETS, np.arange(len(sets)) >= N.BLOCK_SETS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ok.sum() == 1 and peak < 100e6


@pytest.mark.parametrize("many", [False, True])
def test_all_links_and_their_numbers(spark, monkeypatch, many):
    if many:
        monkeypatch.setattr(N, "BLOCK_SHINGLES", 400)
        monkeypatch.setattr(N, "SMALL_BUCKET", 2)
        monkeypatch.setattr(N, "LOCAL_BUCKET", 1)
    docs = corpus(11 + many)
    sets = {i: shingle_set(t, 3) for i, t in docs}
    linked = lambda x, y: bool(x & y) and 10 * len(x & y) >= 8 * len(x | y)
    rep = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = N.classify(frame, 3, 8, 10, count=True).collect()
    assert {r.doc_id: r.n_links for r in got} == {i: sum(linked(sets[i], sets[j]) for j in sets if j != i) for i in sets} and len(got) == len(docs)
    pairs = [(r.a, r.b) for r in N.links(frame, 3, 8, 10).collect()]
    reps = set(rep.values())
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in reps for b in reps if a < b and linked(sets[a], sets[b])}


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([(9, 10), (8, 10)]))
def test_sketches_rule_out_no_link(seed, threshold):
    rnd = np.random.default_rng(seed)
    join = N.Join(3, *threshold)
    x = np.unique(rnd.integers(0, 2**63, rnd.choice([30, 400, 5000])).astype(np.uint64))
    y = np.unique(np.concatenate([x[rnd.random(len(x)) > rnd.random() / 4], rnd.integers(0, 2**63, rnd.integers(0, 40)).astype(np.uint64)]))
    if len(y) and join.linked(len(np.intersect1d(x, y)), len(x), len(y)):
        n = np.array([[len(x)], [len(y)]])
        assert N.may_link(join, n[0], n[1], [N.sketch(N._mix(x + N._C)).tobytes()], [N.sketch(N._mix(y + N._C)).tobytes()]).all()


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([(9, 10), (8, 10), (1, 2)]), st.booleans())
def test_no_linked_pair_escapes_the_index(seed, threshold, wide):
    rnd = np.random.default_rng(seed)
    join = N.Join(3, *threshold)
    x = np.unique(rnd.integers(0, 2**63, rnd.integers(1, 60)).astype(np.uint64))
    kept = x[rnd.random(len(x)) > rnd.choice([0.0, 0.03, 0.1, 0.3])]
    y = np.unique(np.concatenate([kept, rnd.integers(0, 2**63, rnd.integers(0, 6)).astype(np.uint64)]))
    both = len(np.intersect1d(x, y))
    if len(y) and both and join.linked(both, len(x), len(y)):
        plan = dict.fromkeys(range(200), wide)
        assert np.intersect1d(N.signatures(join, x, plan), N.signatures(join, y, plan)).size


def test_pigeonhole_with_empty_segments(monkeypatch):
    # every segment with a difference: linked only through an empty segment's successor
    join = N.Join(3, 8, 10)
    found = tried = 0
    for seed in range(4000):
        rnd = np.random.default_rng(seed)
        x = rnd.integers(0, 2**63, 9).astype(np.uint64)
        y = np.concatenate([x[:8], rnd.integers(0, 2**63, 1).astype(np.uint64)])
        if join.linked(8, 9, 9):
            tried += 1
            found += bool(np.intersect1d(N.signatures(join, np.unique(x), {}), N.signatures(join, np.unique(y), {})).size)
    assert found == tried > 0


def test_components_on_random_graphs(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_groups_and_edges(spark):
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join(base)) for i in range(300)]
    for i in range(300, 600):
        w = list(base)
        w[rnd.randrange(80)] = f"x{i}"
        docs.append((i, " ".join(w)))
    got = N.classify(spark.createDataFrame([*docs, *docs[:5]], "doc_id long, text string").selectExpr("*", "1 as n", "2 as id"), 3, 90, 100).collect()
    assert len(got) == 605 and {r.component_id for r in got} == {0}
    rows = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (6, "A B C D"), (None, None)], "doc_id long, text string")
    out = {(r.doc_id, r.n_shingles, r.component_id) for r in N.classify(rows).collect()}
    assert out == {(None, 2, None), (None, 0, None), (5, 2, 5), (6, 2, 5)}
    assert N.classify(rows.limit(0)).count() == 0
    kept = N.keep_one(rows.selectExpr("*", "'en' as lang"), 3, 90, 100)
    assert kept.columns == ["doc_id", "text", "lang"] and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["5", "None", "None"]
