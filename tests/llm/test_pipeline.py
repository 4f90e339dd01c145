import os
import re

import pytest

from tessera.llm import pii, quality_rules, spm_sample
from tests.llm.test_native_ops import brute_stats
from tests.llm.test_ngram_join import brute as brute_components
from tests.llm.test_pii import PATTERNS

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF) or not os.path.exists(spm_sample.DEFAULT_MODEL), reason="no test data")


def brute_quality(docs, rules):
    out = []
    for d in docs:
        words, chars, symbols, dup, repeat = brute_stats(d["text"])
        text = d["text"]
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        split = re.findall(r"[^\x20\x09-\x0D]+", text)
        values = {
            "f_symbols": symbols * 1000 // max(chars, 1),
            "f_upper": sum(c.isupper() for c in text) * 1000 // max(chars, 1),
            "f_marks": len(re.findall("[!?]", text)) * 1000 // max(words, 1),
            "f_digits": len(re.findall("[0-9]", text)) * 1000 // max(chars, 1),
            "f_word_len": chars * 20 // max(words, 1),
            "f_dup_lines": dup * 1000 // max(len(lines), 1),
            "f_repeats": repeat * 1000 // max(words, 1),
            "f_distinct": len(set(split)) * 1000 // max(words, 1),
        }
        values = {k: min(1000, v) for k, v in values.items()}
        rejected = any(all(values[x.feature] <= x.value if x.op == "<=" else values[x.feature] > x.value for x in r.literals) for r in rules if all(x.feature in values for x in r.literals))
        if words >= 20 and 100 * repeat <= 30 * words and not rejected:
            out.append(d)
    return out


def brute_contaminated(text, items):
    norm = lambda t: [w for w in (re.sub(r"^\W+|[\W_]+$", "", w).lower() for w in t.split()) if w]
    words = norm(text)
    for t in items:
        s = norm(t)
        need = min(13, len(s))
        grams = {tuple(s[i : i + need]) for i in range(len(s) - need + 1)}
        if any(tuple(words[i : i + need]) in grams for i in range(len(words) - need + 1)):
            return True
    return False


def brute_redact(text):
    spans = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            n = len(re.sub("[^0-9]", "", m[0]))
            if [True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True, 12 <= n <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0])), 9 <= n <= 15][kind]:
                spans.append((m.start(), kind, m.end()))
    out, at = "", 0
    for a, kind, b in sorted(spans):
        if a >= at:
            out += text[at:a] + f"<{pii.KINDS[kind].upper()}>"
        at = max(at, b)
    return out + text[at:]


def test_stages_match_brute_force(spark):
    import corpus_pipeline as P

    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    docs = [r.asDict() for r in read("documents").collect()]
    features = quality_rules.with_features(quality_rules.text_statistics(read("documents")))
    rules = quality_rules.learn(features, read("labels")).rules
    want = brute_quality(docs, rules)
    now = read("documents")
    for i, (name, stage) in enumerate(P.STAGES):
        now = stage(spark, now, SF)
        rows = [r.asDict() for r in now.collect()]
        if i == 1:
            groups = brute_components([(d["doc_id"], d["text"]) for d in want], 5, 80, 100)
            want = [d for d in want if groups[d["doc_id"]][1] == d["doc_id"]]
        elif i == 2:
            items = [r.text for r in read("benchmark").collect()]
            want = [d for d in want if not brute_contaminated(d["text"], items)]
        elif i == 3:
            want = [d | {"text": (t := brute_redact(d["text"])), "n_chars": len(t)} for d in want]
        if i < 4:
            assert tuple(now.columns) == P.COLUMNS
            key = lambda d: d["doc_id"]
            assert sorted(rows, key=key) == sorted(want, key=key), name
    texts = {d["doc_id"]: d["text"] for d in want}
    assert {r["doc_id"] for r in rows} == set(texts) and all(r["decoded"] == texts[r["doc_id"]] for r in rows)
    assert len({(r["doc_id"], tuple(r["ids"])) for r in rows}) == len(rows) == 2 * len(texts)


def test_run_is_the_registered_query(spark):
    import __spark_entry__ as E

    assert E.queries()["pipeline"](spark, SF).count() > 0


def tables(spark, folder, docs, labels=(), items=()):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, rule long, item_ids string, contaminated boolean"
    spark.createDataFrame([(*d, "k", 1, "x", None) for d in docs], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality long, toxic long").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def prose(n, k=60):
    return " ".join(f"{w}{n}" for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa".split() for _ in [0]) + " " + " ".join(f"word{n * 1000 + i}" for i in range(k))


def test_edge_cases(spark, tmp_path):
    import corpus_pipeline as P

    long = " ".join(f"long{i}" for i in range(60_000))
    item = "the answer to this benchmark question is the number that comes after the last one here"
    docs = [
        (1, prose(1), "en", "s", 10),
        (1, prose(1), "en", "s", 10),  # a repeated row
        (2, prose(1) + " tail", None, None, None),  # a near copy
        (3, None, None, None, None),
        (4, "", "en", "s", 0),
        (None, prose(5) + " mail a@b.example now", None, "s", None),
        (6, long, "en", "s", 1),
        (7, prose(7) + " " + item, "en", "s", 1),
        (8, "few words", "en", "s", 1),
    ]
    sf = tables(spark, tmp_path / "a", docs, [(1, None, None), (None, 0, 1), (99, 0, 0)], [(1, item), (None, None), (2, None)])
    out = P.run(spark, sf).collect()
    texts = {(r.doc_id, r.decoded) for r in out}
    assert texts == {(1, prose(1)), (None, prose(5) + " mail <EMAIL> now"), (6, long)}
    assert sum(r.doc_id == 1 for r in out) == 4 and all(r.round_trip for r in out)


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    assert P.run(spark, tables(spark, tmp_path / "none", [])).count() == 0
    only = P.run(spark, tables(spark, tmp_path / "one", [(1, prose(1), "en", "s", 1)])).collect()
    assert {r.doc_id for r in only} == {1}
