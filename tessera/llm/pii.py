"""Personal data: plain patterns, and disguised ones found on a normalised text and mapped back.

Base spans (code points of the source) are leftmost, non-overlapping matches per
kind; emails are found from each ``@`` outwards, so the cost is linear in the text
even for very long runs. Then a chain of transducers rewrites the text, each
keeping for every output character the source range it came from: look-alike,
full-width and other-script characters to ASCII and invisible ones dropped;
spelled digits to digits; dot words between figures to dots; letters that stand for digits; ``at`` and ``dot`` in words or
brackets. Identifiers found in the result map back to source offsets and are
added where they cover a rewritten or dropped character and overlap no base span of their kind, unless they hold it whole and more.

Defined results: a null text counts as empty; repeated rows are judged each;
other columns are not read. The hash of no spans is that of the empty string.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, index of the kind, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _part_ok(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Undisguised identifiers, by start and then kind."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_part_ok, m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


class Mapped:
    """A rewritten text; character i came from source[start[i]:end[i]], changed[i] tells whether it was rewritten."""

    __slots__ = ("text", "start", "end", "changed")

    def __init__(self, text: str, start: list[int], end: list[int], changed: list[bool]) -> None:
        self.text, self.start, self.end, self.changed = text, start, end, changed

    @classmethod
    def of(cls, text: str) -> Mapped:
        n = len(text)
        return cls(text, list(range(n)), list(range(1, n + 1)), [False] * n)

    def edit(self, edits: Iterable[tuple[int, int, str]]) -> Mapped:
        """Replace the given ranges (ascending, disjoint); the new characters map to the whole range."""
        parts: list[str] = []
        start: list[int] = []
        end: list[int] = []
        changed: list[bool] = []
        at = 0
        for a, b, new in edits:
            parts += (self.text[at:a], new)
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            changed += self.changed[at:a] + [True] * len(new)
            at = b
        if not parts:
            return self
        parts.append(self.text[at:])
        return Mapped("".join(parts), start + self.start[at:], end + self.end[at:], changed + self.changed[at:])


# Cyrillic and Greek letters that look like ASCII letters.
LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТУХІЈЅаеорсухіјѕԁԛԝһҮΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ",
        "ABEKMHOPCTYXIJSaeopcyxijsdqwhYABEZHIKMNOPTYXovp",
        strict=True,
    )
)
# Characters that are not seen; other dashes and dots.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\ufeff"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2212"
DOTS = "\u3002\u2024\u00b7"


def _plain(c: str) -> str | None:
    """What one character stands for, or None where it stands for itself."""
    if c < "\x80":
        return None
    if c in INVISIBLE:
        return ""
    if c in DASHES:
        return "-"
    if c in DOTS:
        return "."
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(d)
    flat = unicodedata.normalize("NFKC", c)
    return flat if flat != c and len(flat) == 1 and flat < "\x80" else None


_FOREIGN = re.compile(r"[^\x00-\x7fÀ-ɏ]")


def plain_characters(m: Mapped) -> Mapped:
    return m.edit((x.start(), x.end(), new) for x in _FOREIGN.finditer(m.text) if (new := _plain(x[0])) is not None)


# Digits as words in English, German, French and Spanish.
DIGIT_WORDS = {
    w: str(d)
    for d, words in enumerate(
        (
            "zero null zéro cero oh",
            "one eins uno",
            "two zwei zwo deux dos",
            "three drei trois tres",
            "four vier quatre cuatro",
            "five fünf cinq cinco",
            "six sechs seis",
            "seven sieben sept siete",
            "eight acht huit ocho",
            "nine neun neuf nueve",
        )
    )
    for w in words.split()
}
_DW = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_DOT_WORD = r"(?:dot|point|punkt|punto)"
_PLUS_WORD = r"(?:plus|más)"
#: A run of at least three spelled digits, which may hold figures, "double", dots and a plus before it.
_SPELLED = re.compile(rf"(?<!\w)(?:{_PLUS_WORD}[\s,-]+(?:[0-9]+[\s,-]+)?)?(?:(?:double|triple)\s+)?(?:{_DW})(?:(?:[\s,-]+(?:{_DOT_WORD}[\s,-]+)?|\s*\.\s*)(?:(?:double|triple)\s+)?(?:{_DW}|[0-9]+))+(?!\w)", re.I)
#: The start of every such run.
_SPELLED_PAIR = re.compile(rf"(?<!\w)(?:{_DW})(?:[\s,-]+(?:{_DOT_WORD}[\s,-]+)?|\s*\.\s*)(?:(?:double|triple)\s+)?(?:{_DW}|[0-9])", re.I)
_SPELLED_TOKEN = re.compile(rf"{_PLUS_WORD}(?!\w)|{_DOT_WORD}(?!\w)|double(?!\w)|triple(?!\w)|{_DW}|[0-9]+|\.", re.I)


def spelled_digits(m: Mapped) -> Mapped:
    if not _SPELLED_PAIR.search(m.text):
        return m
    edits = []
    for x in _SPELLED.finditer(m.text):
        tokens = [t for t in _SPELLED_TOKEN.finditer(m.text, x.start(), x.end())]
        if sum(t[0].lower() in DIGIT_WORDS for t in tokens) < 3:
            continue
        # every token takes the separators before it, so that digits become neighbours
        times, at = 1, x.start()
        for t in tokens:
            w = t[0].lower()
            if w in ("double", "triple"):
                times = 2 if w == "double" else 3
                continue
            new = DIGIT_WORDS.get(w) or (w if w.isdigit() else "." if w == "." or re.fullmatch(_DOT_WORD, w) else "+")
            edits.append((t.start() if at == x.start() else at, t.end(), new * times))
            times, at = 1, t.end()
    return m.edit(edits)


_FIGURE_DOT = re.compile(rf"(?<=[0-9])\s{{1,3}}{_DOT_WORD}\s{{1,3}}(?=[0-9])", re.I)


def figure_dots(m: Mapped) -> Mapped:
    return m.edit((x.start(), x.end(), ".") for x in _FIGURE_DOT.finditer(m.text))


# Letters that stand for digits.
DIGIT_LETTERS = dict(zip("OoIlSBZ", "0011582", strict=True))
_DL = "".join(DIGIT_LETTERS)
_DIGIT_LETTER = re.compile(r"(?<=[0-9])[OoIl]{1,3}(?=[\s.-]?[0-9])")
#: A place that every word of digits and such letters has.
_LETTER_EDGE = re.compile(rf"[0-9][{_DL}]|[{_DL}][0-9]")
_MIXED_GROUP = re.compile(rf"(?<![^\W_])[0-9{_DL}]++(?![^\W_])")
_DIGIT_BEFORE, _DIGIT_AFTER = re.compile(r"[0-9][\s.()-]{0,2}\Z"), re.compile(r"[\s.()-]{0,2}[0-9]")


def _as_digits(text: str) -> str:
    return "".join(DIGIT_LETTERS.get(c, c) for c in text)


def digit_letters(m: Mapped) -> Mapped:
    m = m.edit((x.start(), x.end(), _as_digits(x[0])) for x in _DIGIT_LETTER.finditer(m.text))
    if not _LETTER_EDGE.search(m.text):
        return m
    edits = []
    for x in _MIXED_GROUP.finditer(m.text):
        digits = sum(map(str.isdigit, x[0]))
        # mostly digits, and part of a longer number
        if len(x[0]) > digits >= len(x[0]) - digits and (
            digits >= 7 or _DIGIT_BEFORE.search(m.text, max(0, x.start() - 3), x.start()) or _DIGIT_AFTER.match(m.text, x.end())
        ):
            edits += [(x.start() + i, x.start() + i + 1, DIGIT_LETTERS[c]) for i, c in enumerate(x[0]) if c in DIGIT_LETTERS]
    return m.edit(edits)


_BRACKET_AT = re.compile(r"\s{0,3}[\[({<]\s{0,3}(?:at|@|ät|arroba|arobase)\s{0,3}[\])}>]\s{0,3}", re.I)
_BRACKET_DOT = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:{_DOT_WORD}|\.)\s{{0,3}}[\])}}>]\s{{0,3}}", re.I)
_AT = r"(?:\s{0,3}@\s{0,3}|\s{1,3}(?:at|arroba|arobase|ät)\s{1,3})"
_DOT = rf"(?:\.|\s{{1,3}}{_DOT_WORD}\s{{1,3}})"
#: A whole address in words: at least one of its dots, or its at, must be there too.
_WORD_ADDRESS = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+){{0,4}}(?P<at>{_AT})[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I)
_AT_WORD = re.compile(_AT, re.I)
_DOT_WORDS = re.compile(rf"\s{{1,3}}{_DOT_WORD}\s{{1,3}}", re.I)
_LABELS = re.compile(_DOT, re.I)
_HINT = re.compile(rf"[\[({{<]\s{{0,3}}(?:at|@|ät|arroba|arobase|{_DOT_WORD}|\.)\s{{0,3}}[\])}}>]|\s{_DOT_WORD}\s|\s@|@\s|\s(?:at|arroba|arobase|ät)\s+[A-Za-z0-9-]+\.[A-Za-z0-9-]", re.I)


# Endings that no sentence has; words before and after an "at" of prose.
SURE_ENDINGS = (".com", ".org", ".net", ".edu", ".de", ".fr", ".es", ".io")
BEFORE_AT = frozenset(
    "look looks looked looking arrive arrives arrived meet meets met stay stays stayed live lives lived work works worked be is are was were been start starts started end ends ended stop stops stopped aim aimed laugh laughed good bad not and or but up back down out here there it he she we they you me him her them us".split()
)
AFTER_AT = frozenset(
    "this that these those the a an it its him her them us me you my your his our their all any each every some once least last first most best worst noon night midnight dawn dusk home work school lunch dinner breakfast times time hand present which what whom one two three four five six seven eight nine ten".split()
)


def _prose(local: str, domain: str) -> bool:
    """Whether a spoken at with a written dot is more likely a sentence that lacks the space after its full stop."""
    if domain.lower().endswith(SURE_ENDINGS):
        return False
    labels = domain.split(".")
    if not labels[-1].isalpha() or len(labels[-1]) < 2 or (labels[-1][0].isupper() and not labels[-1].isupper()):
        return True
    return local.lower() in BEFORE_AT or labels[0].lower() in AFTER_AT


def at_and_dot(m: Mapped) -> Mapped:
    if not _HINT.search(m.text):
        return m
    m = m.edit((x.start(), x.end(), "@") for x in _BRACKET_AT.finditer(m.text))
    m = m.edit((x.start(), x.end(), ".") for x in _BRACKET_DOT.finditer(m.text))
    edits, at = [], 0
    while x := _WORD_ADDRESS.search(m.text, at):
        a, b = x.span("at")
        at = b  # what follows the at of no address may begin one
        labels = [w for part in (m.text[x.start() : a], m.text[b : x.end()]) for w in _LABELS.split(part)]
        if any(w.lower() in ("at", "dot") for w in labels) or _AT_WORD.match(m.text, x.end()):
            continue
        spoken = not m.text[a:b].strip() == "@"
        dots = [*_DOT_WORDS.finditer(m.text, x.start(), a), *_DOT_WORDS.finditer(m.text, b, x.end())]
        if spoken and not dots and _prose(m.text[x.start() : a], m.text[b : x.end()]):
            continue  # "look at this.thing" is prose
        edits += sorted([(d.start(), d.end(), ".") for d in dots] + ([(a, b, "@")] if m.text[a:b] != "@" else []))
        at = x.end()
    return m.edit(edits)


TRANSDUCERS: tuple[Callable[[Mapped], Mapped], ...] = (plain_characters, spelled_digits, figure_dots, digit_letters, at_and_dot)


def normalise(text: str) -> Mapped | None:
    """The normalised text with its source offsets; None where nothing was rewritten."""
    # the cheap tests first, so clean texts build no offset lists
    if not (_FOREIGN.search(text) or _SPELLED_PAIR.search(text) or (_DIGIT.search(text) and (_DIGIT_LETTER.search(text) or _LETTER_EDGE.search(text))) or _HINT.search(text)):
        return None
    m = first = Mapped.of(text)
    for step in TRANSDUCERS:
        m = step(m)
    return None if m is first else m


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Disguised identifiers, in source offsets."""
    m = normalise(text)
    if m is None:
        return []
    # of one kind, base spans and found ones are in order and apart, so only those around a new span are looked at
    known = {k: ([s for s, kind, _ in base if kind == k], [e for _, kind, e in base if kind == k]) for k in range(4)}
    mine: dict[int, list[tuple[int, int]]] = {k: [] for k in range(4)}
    found = []
    for s, kind, e in base_spans(m.text):
        a, b = m.start[s], m.end[e - 1]
        if any(m.changed[s:e]) or b - a != e - s:  # rewritten, or something inside dropped
            starts, ends = known[kind]
            first, last = bisect_right(ends, a), bisect_left(starts, b)
            met = list(zip(starts[first:last], ends[first:last]))
            for x, y in reversed(mine[kind]):
                if y <= a:
                    break
                met.append((x, y))
            if all(a <= x and y <= b and b - a > y - x for x, y in met):
                found.append((a, kind, b))
                mine[kind].append((a, b))
    return found


def describe(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def redact(text: str) -> str:
    """Every span, base or added, replaced by its kind; overlapping spans count as the first."""
    base = base_spans(text)
    spans = sorted(base + added_spans(text, base))
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += (text[at:s], f"<{KINDS[k].upper()}>")
        at = max(at, e)
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: base counts and hash, and all spans."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: tuple[list[int], ...] = ([], [], [], [])
            hashes, spans, added = [], [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                more = added_spans(text, base)
                for k, c in enumerate(counts):
                    c.append(sum(x[1] == k for x in base))
                hashes.append(hashlib.sha256(describe(base).encode()).hexdigest())
                spans.append(describe(base + more))
                added.append(len(more))
            arrays = [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with identifiers replaced in ``text`` and ``n_chars`` counted anew; null texts stay null."""
    at = {c: i for i, c in enumerate(docs.columns)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if t is None else redact(t) for t in b.column(at["text"]).to_pylist()]
            columns = list(b.columns)
            columns[at["text"]] = pa.array(texts, pa.string())
            if "n_chars" in at:
                columns[at["n_chars"]] = pa.array([None if t is None else len(t) for t in texts], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names=list(at))

    return docs.mapInArrow(run, docs.schema)
