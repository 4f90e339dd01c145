"""Quality rules: decision lists learned by sequential covering, applied as Spark CASE expressions.

Everything is DataFrame operations. Text statistics are array expressions over
one row; learning reads only histograms of at most ``len(FEATURES) * 1001 * 4``
counts per step, so what reaches the driver does not grow with the corpus.

Defined results: a null text counts as empty (no words, so ``base_failed``);
repeated or conflicting labels of a document count once, as the lowest quality;
null labels are ignored; with no usable labels the list is empty and only the
base rules reject; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.storage import discard, materialize

WS = r"[\x20\x09-\x0D]+"
NOT_WS = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Features of the learned rules, each an integer from 0 to 1000.
FEATURES = {
    "f_symbols": "least(1000, n_symbols * 1000 div greatest(word_chars, 1))",
    "f_upper": "least(1000, n_upper * 1000 div greatest(word_chars, 1))",
    "f_marks": "least(1000, n_marks * 1000 div greatest(n_words, 1))",
    "f_digits": "least(1000, n_digits * 1000 div greatest(word_chars, 1))",
    "f_word_len": "least(1000, word_chars * 20 div greatest(n_words, 1))",
    "f_dup_lines": "least(1000, n_dup_lines * 1000 div greatest(n_lines, 1))",
    "f_repeats": "least(1000, n_repeat_words * 1000 div greatest(n_words, 1))",
    "f_distinct": "least(1000, n_distinct * 1000 div greatest(n_words, 1))",
    "f_words": "least(1000, cast(floor(log2(n_words + 1) * 40) as bigint))",
}


def _repeat_words(words: Column) -> Column:
    """Words in windows of eight that occur twice or more, the first included.

    Hashes decide whether any window can repeat; only then are the windows
    themselves sorted, so the count is exact.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    windows = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("i"))))

    def flagged(ordered: Column) -> Column:
        same = lambda w, k, d: F.coalesce(F.get(ordered, k + d).getField("w") == w.getField("w"), F.lit(False))
        repeated = F.filter(ordered, lambda w, k: same(w, k, -1) | same(w, k, 1))
        at = F.array_sort(F.transform(repeated, lambda w: w.getField("i")))
        step = lambda acc, i: F.struct((acc.getField("n") + WINDOW - F.greatest(acc.getField("last") + WINDOW - i, F.lit(0))).alias("n"), i.alias("last"))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(at, start, step, lambda acc: acc.getField("n"))

    # transform over a one-element array binds the sorted windows to a name
    counted = F.transform(F.array(windows), flagged)[0]
    long_enough = n >= WINDOW
    return F.when(long_enough & (F.size(F.array_distinct(hashes)) < n - (WINDOW - 1)), counted).otherwise(0).cast("long")


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the counts that the rules use."""
    has_word = lambda line: line.rlike(NOT_WS)
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.select("doc_id", "text", F.filter(F.split("text", WS), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n"), has_word).alias("lines"))
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    return df.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"[!?]").alias("n_marks"),
        count(r"[0-9]").alias("n_digits"),
    )


def with_features(stats: DataFrame) -> DataFrame:
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return stats.select("*", *(F.expr(e).cast("int").alias(k) for k, e in FEATURES.items()), base.alias("base_failed"))


@dataclass(frozen=True)
class Literal:
    feature: str
    op: str
    value: int

    def sql(self) -> str:
        return f"{self.feature} {self.op} {self.value}"


@dataclass(frozen=True)
class Rule:
    literals: tuple[Literal, ...]
    hits: int
    misses: int

    def sql(self) -> str:
        return " AND ".join(x.sql() for x in self.literals)


@dataclass
class DecisionList:
    """Ordered rejecting rules; a row that meets none is kept."""

    rules: list[Rule] = field(default_factory=list)

    def verdict(self) -> Column:
        """The first rule that holds, as text, or ``keep``."""
        if not self.rules:
            return F.lit("keep")
        return F.expr("CASE " + " ".join(f"WHEN {r.sql()} THEN '{r.sql()}'" for r in self.rules) + " ELSE 'keep' END")


def _histograms(rows: DataFrame, where: str) -> dict[str, dict[int, list[int]]]:
    """Counts of (feature, value) split by fold and label: [grow bad, grow good, prune bad, prune good]."""
    pairs = ", ".join(f"'{f}', {f}" for f in FEATURES)
    exploded = rows.filter(where).selectExpr("bad", "prune", f"stack({len(FEATURES)}, {pairs}) as (feature, value)")
    counted = exploded.groupBy("feature", "value").agg(*(F.count_if(F.expr(c)).alias(k) for k, c in (("gb", "bad and not prune"), ("gg", "not bad and not prune"), ("pb", "bad and prune"), ("pg", "not bad and prune"))))
    out: dict[str, dict[int, list[int]]] = {f: {} for f in FEATURES}
    for r in counted.collect():  # bounded: features times 1001 values
        out[r.feature][r.value] = [r.gb, r.gg, r.pb, r.pg]
    return out


def _best_literal(hist: dict[str, dict[int, list[int]]]) -> tuple[float, Literal, list[int]] | None:
    """The threshold test with the highest FOIL gain on the growing fold."""
    best = None
    for f, values in hist.items():
        keys = sorted(values)
        total = [sum(values[v][i] for v in keys) for i in range(4)]
        p0, n0 = total[0], total[1]
        if not p0 or not n0:
            continue
        base, below = math.log2(p0 / (p0 + n0)), [0, 0, 0, 0]
        for a, b in zip(keys, keys[1:]):
            below = [x + y for x, y in zip(below, values[a])]
            cut = (a + b) // 2
            for op, side in (("<=", below), (">", [t - x for t, x in zip(total, below)])):
                if side[0]:
                    gain = side[0] * (math.log2(side[0] / (side[0] + side[1])) - base)
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, Literal(f, op, cut), side)
    return best if best and best[0] > 1e-6 else None


def learn(features: DataFrame, labels: DataFrame, max_rules: int = 8, max_literals: int = 4, min_precision: float = 0.85, min_hits: int = 3) -> DecisionList:
    """Sequential covering over all labelled rows that pass the base rules.

    A rule grows by FOIL gain on two thirds of the rows, is cut back to the
    prefix with the best worth (p - n) / (p + n) on the rest, and is accepted if
    its precision over both folds reaches ``min_precision``; rows it covers leave.
    """
    written: list[str] = []
    y = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    folds = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 2
    rows = materialize(features.filter("not base_failed").join(y, "doc_id").select(*FEATURES, (F.col("quality") == 0).alias("bad"), folds.alias("prune")), "rule-rows", scratch=written)
    learned = DecisionList()
    uncovered = "true"
    for _ in range(max_rules):
        literals: list[Literal] = []
        seen: list[list[int]] = []
        where = uncovered
        while len(literals) < max_literals:
            found = _best_literal(_histograms(rows, where))
            if not found:
                break
            literals.append(found[1])
            seen.append(found[2])
            where = f"{where} AND {found[1].sql()}"
            if not found[2][1]:
                break
        if not literals:
            break
        worth = [(pb - pg) / (pb + pg) if pb + pg else -1.0 for _, _, pb, pg in seen]
        keep = max(range(len(seen)), key=lambda i: (worth[i], -i))
        gb, gg, pb, pg = seen[keep]
        hits, misses = gb + pb, gg + pg
        if hits < min_hits or hits < min_precision * (hits + misses):
            break
        learned.rules.append(Rule(tuple(literals[: keep + 1]), hits, misses))
        uncovered = f"{uncovered} AND NOT ({learned.rules[-1].sql()})"
    discard(features.sparkSession, written)
    return learned


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, base verdict and learned verdict of every document."""
    features = materialize(with_features(text_statistics(docs)), "rule-features")
    learned = learn(features, labels)
    return features.select("*", learned.verdict().alias("rule")).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == "keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns.

    Rows and features are written once: the verdict then tests stored columns, where a
    filter on computed ones would be pushed down and repeat the text statistics per test.
    """
    whole = docs.select(F.struct(*docs.columns).alias("doc_id"), "text")
    judged = materialize(with_features(text_statistics(whole)), "judged").withColumnRenamed("doc_id", "row")
    learned = learn(judged.withColumn("doc_id", F.col("row.doc_id")), labels)
    kept = judged.filter(~F.col("base_failed") & (learned.verdict() == "keep"))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
