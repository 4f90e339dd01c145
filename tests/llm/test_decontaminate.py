import os
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessera.llm import decontaminate as D

BENCHMARK = "/root/testdata/sf0.01/benchmark.parquet"

ITEM = "Alice bought 12 apples at the market and gave Bob 5 of them before walking 3 km home with the rest of 12 apples."


def judged(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 as item_ids")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: r for r in D.judge(d, b, **kw).collect()}


def test_exact_reparameterised_and_inconsistent(spark):
    swap = lambda t, **kw: " ".join(kw.get("w" + w.strip(".,"), w) for w in t.split())
    docs = [
        (1, "some words before. " + ITEM + " and after"),
        (2, "intro: " + swap(ITEM, w12="40", wBob="Dan", w5="7", w3="9", wkm="miles")),
        (3, ITEM.upper()),
        (4, "Alice bought apples and walked home."),
        (5, None),
        (6, ""),
        (7, " ".join(ITEM.split()[:12])),
    ]
    got = judged(spark, docs, [(9, ITEM), (10, "too short"), (None, ITEM), (11, None)])
    assert [got[i].contaminated for i in range(1, 8)] == [True, True, True, False, False, False, False]
    assert got[1].item_ids == [9] and got[1].exact_copy and got[1].run_words >= 20
    assert got[2].item_ids == [9] and not got[2].exact_copy


def test_slot_consistency():
    item = "we have 3 red balls and 3 blue balls and we add up 3 more of those balls now"
    same = item.replace("3", "8")
    mixed = item.replace("3 red", "8 red").replace("3 blue", "9 blue").replace("3 more", "8 more")
    index, words = D.Index([(1, item)]), D.Words()
    assert index.match(same, words)[1] == (19, False)
    assert index.match(item, words)[1] == (19, True)
    assert 1 not in index.match(mixed, words)


def test_verbatim_copies_need_no_literals():
    items = [
        "What is 12 times 7 plus 30 minus 5?",
        "Convert 5 miles 300 yards and 2 feet to 7 km 20 m and 3 cm.",
        "Which Famous Roman Emperor Built The Great Wall Across Northern Britain After Hadrian Died?",
        "Add 2 and 2.",
        "Name the capital of France",
        "Name the old capital of northern France today",
    ]
    index, words = D.Index(list(enumerate(items))), D.Words()
    for i, t in enumerate(items):
        n = len(t.split())
        for text in (t, t.upper(), t.lower(), f"Some heading {t} and more", f"A sentence. {t}"):
            assert index.match(text, words).get(i) == (n, True), (t, text)
    assert index.match("A heading What is 40 times 9 plus 31 minus 6?", words) == {0: (9, False)}
    assert index.match("Convert 6 miles 301 yards and 3 feet to 8 km 21 m and 4 cm. Add 2 and 3.", words) == {}


def test_a_heading_does_not_hide_a_template():
    index, words = D.Index([(1, "Give him exactly 3 of those")]), D.Words()
    assert index.match("Some heading Give him exactly 4 of those things", words) == {1: (6, False)}
    assert index.match("Some heading Tell him exactly 4 of those things", words) == {}


def test_matches_brute_force_and_blocks(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abc") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(rnd.randint(8, 30)))) for i in range(30)]
    docs = []
    for i in range(200):
        body = [word() for _ in range(rnd.randint(0, 60))]
        if i % 3 == 0:
            src = items[rnd.randrange(30)][1].split()
            a = rnd.randrange(len(src))
            body[len(body) // 2 : len(body) // 2] = src[a : a + rnd.randint(5, 30)]
        docs.append((i, " ".join(body)))

    def brute(text):
        w, out = text.split(), []
        for k, t in items:
            s = t.split()
            need = min(13, len(s))
            grams = {tuple(s[i : i + need]) for i in range(len(s) - need + 1)}
            if any(tuple(w[i : i + need]) in grams for i in range(len(w) - need + 1)):
                out.append(k)
        return out

    got = judged(spark, docs, items)
    assert {i: got[i].item_ids for i in got} == {i: brute(t) for i, t in docs}
    assert {i: r.item_ids for i, r in judged(spark, docs, items, block_chars=200).items()} == {i: r.item_ids for i, r in got.items()}


def test_drop_keeps_columns_and_empty_tables(spark):
    d = spark.createDataFrame([(1, ITEM, "en"), (2, "clean", None)], "doc_id long, text string, lang string")
    b = spark.createDataFrame([(9, ITEM)], "item_id long, text string")
    out = D.drop_contaminated(d, b)
    assert out.columns == d.columns and [r.doc_id for r in out.collect()] == [2]
    assert D.drop_contaminated(d, b.limit(0)).count() == 2 and D.drop_contaminated(d.limit(0), b).count() == 0


def test_slots_are_one_to_one():
    item = "At noon Alice has 3 red balls and Bob has 5 red ones"
    index, words = D.Index([(1, item)]), D.Words()
    assert index.match("At noon Dana has 4 red balls and Tom has 9 red ones", words)
    assert not index.match("At noon Tom has 4 red balls and Tom has 9 red ones", words)
    assert not index.match("At noon Dana has 7 red balls and Tom has 7 red ones", words)


def test_titles_and_number_words_of_four_languages():
    items = [
        "Anna kauft sieben rote Äpfel und gibt ihrem Bruder drei davon, wie viele bleiben ihr dann noch",
        "marie achète sept pommes rouges et donne trois pommes à son frère, combien en reste-t-il alors",
        "ana compra siete manzanas rojas y da tres manzanas a su hermano, cuántas le quedan después",
        "she buys seven red apples and gives three of them to her brother, how many are left then",
    ]
    other = {"sieben": "neun", "drei": "acht", "sept": "neuf", "trois": "huit", "siete": "nueve", "tres": "dos", "seven": "9", "three": "4"}
    index, words = D.Index(list(enumerate(items))), D.Words()
    for i, t in enumerate(items):
        swapped = " ".join(other.get(w, w) for w in t.split())
        for text in (t, t.title(), t.upper(), swapped, swapped.title(), swapped.upper()):
            assert list(index.match(f"before it. {text} behind it", words)) == [i], text


@pytest.mark.skipif(not os.path.exists(BENCHMARK), reason="no test data")
def test_recased_and_renumbered_copies_of_all_items():
    items = [(r["item_id"], r["text"]) for r in pq.read_table(BENCHMARK).to_pylist()]
    rnd = random.Random(6)
    with_numbers = []
    for k, t in items:
        w = t.split()
        for i in sorted(rnd.sample(range(len(w)), 3), reverse=True):
            w.insert(i, str(rnd.randrange(100)))
        with_numbers.append((k, " ".join(w)))
    index, words = D.Index(with_numbers), D.Words()
    renumber = lambda t: re.sub(r"\b\d+\b", lambda m: str(int(m[0]) + 1000), t)
    for change in (str.title, str.upper, str.lower, renumber, lambda t: renumber(t).title()):
        assert all(k in index.match("words before " + change(t), words) for k, t in with_numbers)
    assert not index.match(None, words) and not index.match("", words)


def test_very_long_text():
    index, words = D.Index([(9, ITEM)]), D.Words()
    long = " ".join(f"w{i % 5000}" for i in range(400_000))
    assert not index.match(long, words) and list(index.match(f"{long} {ITEM} {long}", words)) == [9]


def test_window_hashes_are_one_polynomial():
    h = np.arange(3, 60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for width in range(1, 9):
        x = np.zeros(len(h) - width + 1, np.uint64)
        for i in range(width):
            x = x * D._A + h[i : i + len(x)]
        x = (x ^ (x >> np.uint64(32))) * D._MIX
        assert (D.window_hashes(h, width) == (x ^ (x >> np.uint64(29)))).all()
