import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least=10, top=2000):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        c = counts.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals["und" if lang is None else lang] += len(words)
            for k in (1, 2, 3):
                c.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, c in counts.items():
        candidates = {p: f for p, f in c.items() if len(p) > 1 and f >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * f >= 50 * a and p in (q[:2], q[1:]) for q, f in candidates.items()):
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return out


def random_rows(n=500):
    rnd = random.Random(11)
    words = ["New", "york", "CITY", "of", "the", "Ünï", "ünï", "a", "b", "c", "x\x00y", "#1", "日本"]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rnd.randint(0, 25)):
            text += rnd.choice([*words, "new york city", "of the", "a a a a"]) + rnd.choice([" "] * 8 + ["\t", ", ", ".", "\n", "\r\n", "\x0b", "!? ", "  "])
        rows.append((i, text, rnd.choice(["en", "en", "de", None, "und", ""])))
    return rows + [(1, None, "en"), (1, "", "xx"), (2, " .,!\n", "yy")] + rows[:30]


@pytest.mark.parametrize("least,top,places", [(10, 2000, 1 << 20), (10, 7, 40), (3, 50, 1)])
def test_equals_brute_force(spark, least, top, places):
    rows = random_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"block": F.lit(1), "name": F.lit("x"), "n": F.lit(0)})
    out = collocations.mine(docs, least, top, places)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for _, t in out.dtypes[3:]} == {"bigint"}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, least, top)


def test_scores_are_exact(spark):
    cases = [(10**13, 10**13, 10**13), (123_456_789_012, 923_456_789_012, 523_456_789_013), (10, 11, 12), (10, 10**13, 10**13)]
    rows = spark.createDataFrame(cases, "a long, l long, r long")
    for r in rows.withColumn("score", collocations.ratio(F.col("a"), F.col("l"), F.col("r"))).collect():
        assert r.score == 1_000_000 * r.a * r.a // (r.l * r.r)


def test_edges(spark):
    assert collocations.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "One two three four " * 60_000, "en"), (2, None, None)]
    assert {tuple(r) for r in collocations.mine(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)
