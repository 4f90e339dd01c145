"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and stripped of marks at their ends; numbers, quantities,
units and names become typed placeholders, so that a question with other
figures or people has the same template. Windows of ``WINDOW`` words of
all benchmark items are hashed three ways: as templates, with names as plain words
(so that capitals elsewhere, as in a title, hide nothing), and as plain lower-cased words;
documents are scanned against all three tables in place. From a window that matches, the
diagonal (document position minus item position) is followed both ways while
one of the three agrees. It is taken further only if its slots agree: within
one item, equal source values must stand for equal values in the document, and different
ones of a type for different ones. A document
is contaminated by an item if such a diagonal covers ``MIN_RUN`` words in a row, or
all words of a shorter item.

The benchmark is read in blocks of at most ``BLOCK_CHARS`` characters, each one
broadcast of bounded size; every block is matched against all rows, so a
benchmark of any size is used whole.

Defined results: null or empty texts match nothing; windows with fewer than
``MIN_LITERAL`` words that are not placeholders are no templates and match by their
plain words only; null item ids and texts are skipped; repeated rows are judged each; columns of
``docs`` that are called like added ones give way to them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 8
MIN_RUN = 13
MIN_LITERAL = 5
BLOCK_CHARS = 8_000_000
VOCABULARY = 200_000

# Written numbers (but articles) and units that become placeholders, in English, German, French and Spanish.
NUMBER_WORDS = frozenset(
    """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half
    null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend millionen milliarde milliarden dutzend halb
    zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent cents mille millions milliard milliards douzaine demi
    cero uno dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil millón millones docena medio""".split()
)
UNITS = frozenset(
    """mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros percent degree degrees celsius fahrenheit meter meters metre metres kilometer kilometers watt watts volt volts mph kmh
    sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate jahr jahre jahren gramm kilogramm pfund tonne tonnen prozent grad
    seconde secondes heure heures jour jours semaine semaines mois année années gramme grammes kilogramme kilogrammes kilomètre kilomètres mètre mètres litres degré degrés
    segundo segundos minuto minutos hora horas día días semana semanas meses año años gramo gramos kilogramo kilogramos kilómetro kilómetros metro metros litro litros grado grados""".split()
)
LITERAL, NUMBER, UNIT, QUANTITY = 0, 1, 2, 3
NAME = 4
_PLACEHOLDER = np.array([xxhash.xxh3_64_intdigest(f"\0{k}") for k in range(5)], np.uint64)

_NUMBER = re.compile(r"[+-]?[$€£¥]?[0-9][0-9,]*(?:\.[0-9]+)?%?")
_QUANTITY = re.compile(r"[0-9][0-9,]*(?:\.[0-9]+)?[a-z]{1,3}")
_ENDS = re.compile(r"^\W+|[\W_]+$")
_A, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


_TYPED = dict.fromkeys(UNITS, UNIT) | dict.fromkeys(NUMBER_WORDS, NUMBER)


def _classify(raw: str) -> tuple[str, int, bool, bool]:
    """Bare word, type, whether it looks like a name, whether it ends a sentence."""
    bare = raw if raw.isalpha() else raw[:-1] if raw[-1:] in (",", ".") and raw[:-1].isalpha() else ""
    if bare:  # most words
        low = bare.lower()
        kind = _TYPED.get(low, LITERAL)
        return low, kind, kind == LITERAL and len(bare) > 1 and bare[0].isupper() and bare[1:].islower(), raw[-1] == "."
    ends = raw.rstrip("\"')]}»”’*#$%&").endswith((".", "!", "?", ":"))
    bare = raw.strip("\"'()[]{},;:.!?*#$%&|<>»«“”‘’")
    if _NUMBER.fullmatch(bare):
        return bare, NUMBER, False, ends
    bare = _ENDS.sub("", bare)
    low = bare.lower()
    if low in _TYPED:
        return low, _TYPED[low], False, ends
    if _QUANTITY.fullmatch(low):
        return low, QUANTITY, False, ends
    return low, LITERAL, len(bare) > 1 and bare[0].isupper() and bare[1:].islower(), ends


#: The three forms of a sequence of words: templates; names as words; all as words.
TEMPLATE, NAMED, PLAIN = range(3)


class Words(dict):
    """Raw word -> row of the columns below, filled on first use."""

    def __init__(self) -> None:
        super().__init__()
        self.pending: list[tuple[int, int, bool, bool]] = []
        self.hashes, self.kinds = np.empty(1024, np.uint64), np.empty(1024, np.int8)
        self.named, self.ends = np.empty(1024, bool), np.empty(1024, bool)

    def __missing__(self, raw: str) -> int:
        bare, kind, named, ends = _classify(raw)
        self.pending.append((xxhash.xxh3_64_intdigest(bare) if bare else 0, kind, named, ends))
        self[raw] = n = len(self)
        return n

    def forms(self, raw: list[str]) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        """Hashes in the three forms, types, and positions in ``raw`` (words without letters or digits fall out)."""
        if len(self) > VOCABULARY:
            self.clear()
            self.__init__()
        rows = np.fromiter(map(self.__getitem__, raw), np.int64, len(raw))
        if self.pending:
            a, b = len(self) - len(self.pending), len(self)
            if b > len(self.hashes):  # by doubling, so that new words do not copy the table each time
                self.hashes, self.kinds, self.named, self.ends = (np.resize(x, 2 * b) for x in (self.hashes, self.kinds, self.named, self.ends))
            h, k, n, e = zip(*self.pending)
            self.hashes[a:b] = np.array(h, np.uint64)
            self.kinds[a:b], self.named[a:b], self.ends[a:b] = k, n, e
            self.pending = []
        starts = np.ones(len(raw), bool)
        if len(raw) > 1:
            starts[1:] = self.ends[rows[:-1]]
        own, plain = self.kinds[rows], self.hashes[rows]
        at = np.flatnonzero((own != LITERAL) | (plain != 0))
        kinds = np.where(self.named[rows] & ~starts, NAME, own).astype(np.int8)[at]
        own, plain = own[at], plain[at]
        named = np.where(own == LITERAL, plain, _PLACEHOLDER[own])
        return (np.where(kinds == NAME, _PLACEHOLDER[NAME], named), named, plain), kinds, at


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_A), n, 1 << 64))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    if len(h) < width:
        return np.empty(0, np.uint64)
    # by doubling, for the bits of the width from the highest on
    x, done = h, 1
    for bit in bin(width)[3:]:
        x = x[:-done] * _power(done) + x[done:]
        done *= 2
        if bit == "1":
            x = x[:-1] * _A + h[done:]
            done += 1
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class Windows:
    """Windows of one width: their hashes in order, with the item and the place in it of each."""

    def __init__(self, parts: list[tuple[np.ndarray, int, np.ndarray]]) -> None:
        x = np.concatenate([p[0] for p in parts])
        order = np.argsort(x, kind="stable")
        self.hashes = x[order]
        self.items = np.repeat(np.array([p[1] for p in parts], np.int32), [len(p[0]) for p in parts])[order]
        self.places = np.concatenate([p[2] for p in parts]).astype(np.int32)[order]
        self.filter = np.zeros(1 << 18, bool)
        self.filter[(x >> np.uint64(46)).astype(np.int64)] = True

    def hits(self, x: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(position, item, place in the item) for the window hashes of a document."""
        maybe = np.nonzero(self.filter[(x >> np.uint64(46)).astype(np.int64)])[0]
        if len(maybe):
            a, b = (np.searchsorted(self.hashes, x[maybe], side) for side in ("left", "right"))
            for k in np.nonzero(b > a)[0].tolist():
                p = int(maybe[k])
                for n, i in zip(self.items[a[k] : b[k]].tolist(), self.places[a[k] : b[k]].tolist()):
                    yield p, n, i


class Index:
    """Windows of one block of the benchmark in the three forms."""

    def __init__(self, items: Iterable[tuple[int, str]]) -> None:
        self.items: list[tuple[int, list[str], np.ndarray, tuple[np.ndarray, ...]]] = []
        words = Words()
        parts: dict[tuple[int, int], list[tuple[np.ndarray, int, np.ndarray]]] = defaultdict(list)
        for item_id, text in items:
            raw = text.split()
            forms, kinds, at = words.forms(raw)
            width = min(WINDOW, len(at))
            if not width:
                continue
            n = len(self.items)
            looks = [_classify(raw[i]) for i in at]
            self.items.append((item_id, [x[0] for x in looks], kinds, forms))
            plain = window_hashes(forms[PLAIN], width)
            parts[PLAIN, width].append((plain, n, np.arange(len(plain))))
            # the other forms where they differ from the next one
            below = plain
            for form, slots in ((NAMED, (kinds != LITERAL) & (kinds != NAME)), (TEMPLATE, kinds != LITERAL)):
                x = window_hashes(forms[form], width)
                literal = width - np.convolve(slots, np.ones(width, int), "valid")
                usable = np.flatnonzero((literal >= MIN_LITERAL) & (x != below))
                parts[form, width].append((x[usable], n, usable))
                below = x
            if looks[0][2] and kinds[0] == LITERAL and literal[0] >= MIN_LITERAL:
                # after a heading the first word would look like a name
                first = np.append(_PLACEHOLDER[NAME], forms[TEMPLATE][1:width])
                parts[TEMPLATE, width].append((window_hashes(first, width), n, np.zeros(1, int)))
        self.windows = {key: Windows(p) for key, p in parts.items() if any(len(x[0]) for x in p)}

    def match(self, text: str | None, words: Words) -> dict[int, tuple[int, bool]]:
        """Item -> (longest run of words, whether all its slots are the item's own)."""
        raw = (text or "").split()
        out: dict[int, tuple[int, bool]] = {}
        if not raw:
            return out
        forms, _, at = words.forms(raw)
        diagonals: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for (form, width), windows in self.windows.items():
            for p, n, i in windows.hits(window_hashes(forms[form], width)):
                diagonals[n, p - i].append((i, i + width))
        for (n, shift), starts in diagonals.items():
            item_id, values, item_kinds, item_forms = self.items[n]
            need = min(MIN_RUN, len(values))
            lo, hi = max(0, -shift), min(len(values), len(at) - shift)
            agree = lambda j: any(x[j] == y[j + shift] for x, y in zip(item_forms, forms))  # noqa: B023, E731
            for a, b in _runs(sorted(starts), agree, lo, hi):
                if b - a < need:
                    continue
                a, b, same = _consistent(values, item_kinds, a, b, [_classify(raw[at[j + shift]])[0] for j in range(a, b)], need)
                if b - a >= need and (item_id not in out or (b - a, same) > out[item_id]):
                    out[item_id] = (b - a, same)
        return out


def _runs(starts: list[tuple[int, int]], agree: Callable[[int], bool], lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Ranges of item words in [lo, hi) that agree without a gap around the windows ``starts`` (ascending)."""
    a = b = lo
    for i, j in starts:
        if i >= b:
            if b > a:
                yield a, b
            a, stop = i + (not agree(i)), b  # another name may stand in the first word's place
            while a > stop and agree(a - 1):
                a -= 1
        elif j <= b:
            continue
        b = j
        while b < hi and agree(b):
            b += 1
    if b > a:
        yield a, b


def _consistent(values: list[str], kinds: np.ndarray, a: int, b: int, found: list[str], need: int) -> tuple[int, int, bool]:
    """The longest part of [a, b) in which slot values and what stands for them agree both ways; whether they are the item's own."""
    best, start = (a, a, True), a
    # (type, value of one side) -> value of the other, and where that was last seen
    seen: tuple[dict[tuple[int, str], tuple[str, int]], ...] = ({}, {})
    for i in range(a, b + 1):
        clash = -1
        if i < b and kinds[i] != LITERAL:
            kind, pair = int(kinds[i]), (values[i], found[i - a])
            for side, known in enumerate(seen):
                other, last = known.get((kind, pair[side]), (pair[1 - side], -1))
                if other != pair[1 - side] and last >= start:
                    clash = max(clash, last)
                known[kind, pair[side]] = pair[1 - side], i
        if i == b or clash >= 0:
            if i - start > best[1] - best[0]:
                best = (start, i, all(values[j] == found[j - a] for j in range(start, i)))
            if clash >= 0:
                start = clash + 1
    return best if best[1] - best[0] >= need else (a, a, True)


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items, in blocks of bounded size."""
    block: list[tuple[int, str]] = []
    size = 0
    rows = benchmark.filter("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text")
    for r in rows.toLocalIterator():  # one partition at a time
        if size >= block_chars:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block:
        yield block


ADDED = ("contaminated", "item_ids", "run_words", "exact_copy")


def judge(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with contaminated, item_ids (ascending), run_words (the longest run) and exact_copy (its slots are the item's own)."""
    spark = docs.sparkSession
    own = [c for c in docs.columns if c.lower() not in ADDED]
    rows = docs.select(*own, F.lit(False).alias(ADDED[0]), F.expr("cast(array() as array<long>)").alias(ADDED[1]), F.lit(0).cast("long").alias(ADDED[2]), F.lit(False).alias(ADDED[3]))
    at_text = own.index("text")
    for items in blocks(benchmark, block_chars):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, words = Index(shared.value), Words()
            for b in batches:
                yes, ids, runs, exact = (b.column(len(own) + i).to_pylist() for i in range(4))
                for i, text in enumerate(b.column(at_text).to_pylist()):
                    if found := index.match(text, words):
                        longest = max(max(found.values()), (runs[i], exact[i]))
                        yes[i], ids[i], (runs[i], exact[i]) = True, sorted({*ids[i], *found}), longest
                more = [pa.array(yes, pa.bool_()), pa.array(ids, pa.list_(pa.int64())), pa.array(runs, pa.int64()), pa.array(exact, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], *more], names=[*own, *ADDED])

        rows = rows.mapInArrow(run, rows.schema)
    return rows


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their columns."""
    return judge(docs, benchmark).filter("not contaminated").select(*docs.columns)
