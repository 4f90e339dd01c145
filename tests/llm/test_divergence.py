import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, min_docs):
    docs = [([t.translate(LOWER) for t in TERM.findall(text or "")], lang or "", source or "") for _, text, lang, source in rows]
    out = set()
    for lang in {x[1] for x in docs}:
        df = Counter(t for words, at, _ in docs if at == lang for t in set(words))
        kept = sorted(t for t in df if df[t] >= min_docs)
        v = len(kept)
        count = defaultdict(Counter)
        for words, at, source in docs:
            if at == lang:
                count[source].update(w for w in words if df[w] >= min_docs)
        total = sum(count.values(), Counter())
        p = lambda c, t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * v)
        for s in count:
            pairs = [(sum(abs(p(count[s], t) - p(count[o], t)) for t in kept), o) for o in count if o != s]
            terms = [(p(count[s], t) - p(total, t), t) for t in kept if count[s][t] and p(count[s], t) > p(total, t)]
            for part, items, top in (("pair", pairs, len(pairs)), ("term", terms, 50)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:top]
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)}
    return out


def random_docs(n=400, sources=9):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcAB") for _ in range(rnd.randint(1, 3))) for _ in range(60)] + ["Ünder", "ünder", "naïve", "x😀", "日本"]
    docs = []
    for i in range(n):
        text = rnd.choice([" ", "-", ", 5"]).join(rnd.choice(words[: rnd.choice([5, 65])]) for _ in range(rnd.randint(0, 30)))
        docs.append((i, text, rnd.choice(["en", "de", None, ""]), rnd.choice([None, *(f"s{k}" for k in range(sources))]) if rnd.random() < 0.6 else "s0"))
    return docs + [(7, None, "en", "empty"), (7, "", "en", "empty"), (8, "some words here", "xx", "a"), (9, "other", "xx", "b"), (10, "alone", "yy", "only")] + docs[:20]


@pytest.mark.parametrize("chunk,block,span,held", [(4096, 32, 16, 1 << 21), (7, 2, 1, 50), (3, 3, 2, 1)])
def test_equals_brute_force(spark, chunk, block, span, held):
    rows = random_docs()
    out = divergence.audit(spark.createDataFrame(rows, SCHEMA).withColumns({"term": F.lit(1), "chunk": F.lit("x"), "part": F.lit(0)}), 6, chunk, block, span, held)
    got = [tuple(r) for r in out.collect()]
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 6)


def test_shares_are_exact(spark):
    cases = [(0, 0, 1), (0, 10**13, 10**7), (10**13 - 1, 10**13, 3), (123_456_789_012, 987_654_321_098, 55_555), (6, 7, 1)]
    rows = spark.createDataFrame(cases, "n long, total long, size long").select("n", "total", "size", divergence.share(F.col("n"), F.col("total"), F.col("size")).alias("p"))
    for r in rows.collect():
        assert r.p == 1 + 1_000_000_000 * (r.n + 5) // (r.total + 5 * r["size"])


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert divergence.audit(empty).count() == 0
    long = "Word " * 300_000 + "rare"
    rows = [(i, long if i == 0 else "word other", "en", f"s{i % 2}") for i in range(40)]
    assert {tuple(r) for r in divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows, 30)
