import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import loser_tree as L
from tessera.llm import substring_dedup as S


def brute(docs):
    """The contract, string by string."""
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                s = b[p : p + 50]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if i is not None:
            for p in range(len(b) - 49):
                if first[b[p : p + 50]] < i:
                    gone[p : p + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=150):
    rnd = random.Random(seed)
    text = lambda k: "".join(rnd.choice("ab é") for _ in range(k))
    passages = [text(rnd.randint(40, 160)) for _ in range(12)]
    docs = [(n + 1, None), (n + 2, ""), (n + 3, "x" * 49), (n + 4, "x" * 50), (n + 5, "x" * 3000), (n + 6, "x" * 51)]
    for i in range(n):
        parts = [text(rnd.randint(0, 120))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            parts += [p[a : a + rnd.choice([30, 60, 200])], text(rnd.randint(0, 40))]
        docs.append((i, "".join(parts)))
    docs += [(n + 10 + i, docs[20 + i % 7][1]) for i in range(20)]
    return docs


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "FLUSH", 300)
    monkeypatch.setattr(S, "SORT_FLUSH", 200)
    for seed in (1, 2):
        docs = corpus(seed) + [(None, "ab" * 60), (None, "ab" * 60), (3, corpus(seed)[9][1])]
        docs = [d for d in docs if d[0] != 3] + [(3, "q" * 70), (3, "q" * 70)]
        got = S.dedup(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as at").repartition(7)).collect()
        assert sorted(map(tuple, got), key=str) == brute(docs)


def test_texts_that_share_a_doc_id(spark, monkeypatch):
    monkeypatch.setattr(S, "FLUSH", 300)
    monkeypatch.setattr(S, "SORT_FLUSH", 200)
    rnd = random.Random(8)
    texts = [t for _, t in corpus(5, 120)]
    docs = [(rnd.randrange(30), t) for t in texts] + [(40, texts[3] + "z" * 80), (40, "z" * 80 + "a unique text " * 9), (41, "z" * 80), (41, texts[3])]
    got = S.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs)


def test_doc_ids_that_are_no_numbers(spark):
    line = "one and the same long line that stands in all of these rows, word for word"
    got = S.dedup(spark.createDataFrame([("1", line), ("x", line), ("2", line), (None, line)], "doc_id string, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 0), ("2", len(line)), ("None", 0), ("None", 0)]


def test_hot_passage_and_empty_table(spark):
    line = "This very line stands in every single document of the corpus, word for word."
    docs = [(i, f"{i} unique start {i * 7919} {line} and {i * 104729} its own end") for i in range(400)]
    got = S.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs)
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=12).map(lambda b: bytes(x % 3 for x in b)), max_size=12), max_size=9))
def test_loser_tree_merges_like_sorted(runs):
    runs = [sorted(r) for r in runs]
    lcp = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    commons = [[lcp(r[i - 1], r[i]) if i else 0 for i in range(len(r))] for r in runs]
    order, prefix = L.merge(runs, commons)
    at, out = [0] * len(runs), []
    for r in order:
        out.append(runs[r][at[r]])
        at[r] += 1
    assert out == sorted(x for r in runs for x in r)
    assert prefix[1:] == [lcp(a, b) for a, b in zip(out, out[1:])]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=9), min_size=1, max_size=30))
def test_front_coding_round_trip(rows):
    rows = sorted(rows)
    m = np.zeros((len(rows), 9), np.uint8)
    for i, r in enumerate(rows):
        m[i, : len(r)] = np.frombuffer(r, np.uint8)
    lengths = np.array([len(r) for r in rows])
    common, rest = L.front_code(m, lengths)
    assert L.decode(common, lengths, rest) == rows


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=50, max_size=400))
def test_every_string_holds_an_anchor(text):
    at, _ = S.anchors(text)
    for p in range(len(text) - 49):
        assert ((at >= p) & (at <= p + 34)).any()
