import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, quality_rules, sharding

WS = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_stats(text):
    text = text or ""
    words = [w for w in WS.split(text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_statistics_match_brute_force(spark):
    rnd = random.Random(3)
    texts = [None, "", " \t\n", "a", "x\x0by\x0cz\r\n", "é ü 😀 é", "# $ %<>|&*", " lead and trail ", "a b c d e f g h " * 5, "same\nsame\n\nsame \n"]
    texts += [" ".join(rnd.choice("ab") for _ in range(rnd.randint(1, 60))) + "\n" * rnd.randint(0, 2) + "tail" for _ in range(40)]
    got = quality_rules.text_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        want = brute_stats(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(texts[r.doc_id])


def quality_fixture(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    docs, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        docs.append((i, " ".join(word() + ("###" if bad else "") for _ in range(40)), "en", "s", 1))
        labels.append((i, 0 if bad else 1, 0))
    return docs, labels


def test_rules_separate_junk_and_keep_clean(spark):
    docs, labels = quality_fixture(spark)
    out = quality_rules.apply_rules(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality long, toxic long"))
    got = {r.doc_id: r.kept for r in out.collect()}
    assert all(got[i] == (i % 4 != 0) for i in got) and len(got) == 300
    kept = quality_rules.keep_good(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality long, toxic long"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept.count() == 225


def test_rules_edge_tables(spark):
    labels = spark.createDataFrame([(1, None, None), (1, 1, 0), (None, 0, 0)], "doc_id long, quality long, toxic long")
    docs = spark.createDataFrame([(None, "x " * 50, None), (1, None, "k"), (1, "word " * 25, "k")], "doc_id long, text string, kept string")
    out = quality_rules.apply_rules(docs, labels).collect()
    assert len(out) == 3 and all(r.base_failed for r in out)
    assert quality_rules.apply_rules(docs.limit(0), labels.limit(0)).count() == 0


def test_sharding_table_is_balanced_and_stable():
    names = [f"s{i}" for i in range(10)]
    table = sharding.fill_table(names, 65_537)
    shares = [table.count(i) for i in range(10)]
    assert max(shares) - min(shares) <= 1
    fewer = sharding.fill_table(names[:-1], 65_537)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 9)
    assert moved < 0.06 * 65_537
    heavy = sharding.fill_table(names, 65_537, {"s0": 3})
    assert heavy.count(0) == pytest.approx(3 * heavy.count(1), rel=0.01)


def test_sharding_places_by_brute_force(spark):
    import hashlib

    rows = [(i,) for i in range(200)] + [(None,), (7,)]
    out = sharding.place(spark.createDataFrame(rows, "doc_id long").withColumn("SLOT", F.lit("x")), "doc_id").collect()
    table = sharding.fill_table(sharding.SHARDS)
    assert len(out) == 202
    for r in out:
        key = "\0" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) % sharding.TABLE_SIZE
        assert (r.slot, r.shard) == (slot, sharding.SHARDS[table[slot]])
    with pytest.raises(ValueError):
        sharding.fill_table(["a", "a"], 13)
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 12)


def test_sharding_names_with_dots_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "`a.b` long, `c d` string")
    assert sharding.place(df, "a.b").columns == ["a.b", "c d", "slot", "shard"] and sharding.place(df, "a.b").count() == 2
    assert sharding.place(df.limit(0), "c d").count() == 0


def test_very_long_texts(spark):
    long = "word after word " * 60_000
    docs = spark.createDataFrame([(1, long), (2, "line\n" * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.text_statistics(docs).collect()}
    assert got[1].n_words == 180_000 == got[1].n_repeat_words and got[2].n_dup_lines == 99_999
    turns = [(1, 0, "user", long), (1, 1, "assistant", "a"), (2, 0, "user", long)]
    out = chat_format.collapse(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.conv_id, r.n_turns, len(r.text) > 2 * 480_000) for r in out] == [(1, 2, True)]


def brute_chats(rows):
    convs = {}
    for c, t, r, x in set(rows):
        convs.setdefault(c, []).append((t, r, x))
    key = lambda v: tuple((x is not None, x if x is not None else 0) for x in v)
    seqs = {c: tuple((r, x) for t, r, x in sorted(v, key=key)) for c, v in convs.items()}
    out = {}
    for c, s in seqs.items():
        if any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values()):
            continue
        out.setdefault(s, []).append(c)
    return {(min((c for c in v if c is not None), default=None), len(s), len(v)) for s, v in out.items()}


def test_chat_collapse_matches_brute_force(spark):
    rnd = random.Random(8)
    rows = []
    for c in range(80):
        for t in range(rnd.randint(1, 5)):
            rows.append((c, t, rnd.choice(["user", None, "assistant"]), rnd.choice(["hi", "", None, "x"]) if t else "hello"))
    rows += rows[:10] + [(None, 0, "user", "lone"), (None, 1, None, None)]
    out = chat_format.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1)))
    got = out.collect()
    assert {(r.conv_id, r.n_turns, r.n_copies) for r in got} == brute_chats(rows)
    assert all(r.text.count(chat_format.START) == r.n_turns for r in got)
    assert chat_format.collapse(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
