"""Personal data behind disguises, with spans in the source text.

Base detectors find plain identifiers in the text as it stands.  Then transducers
rewrite disguises into the characters they stand for: look-alike letters and
digits, invisible characters, spelled digits ("four one five"), "plus", and
bracketed or spelled "at" and "dot".  Each rewrite is an edit (source start,
source end, replacement), so every position of the rewritten text maps back to
the source.  The same detectors run over the rewritten text; a find that a
rewrite made possible is mapped back to source positions and added unless it
overlaps a base span of its kind.

Rewriting is only tried near a trigger, so that texts without disguises cost one
search, and every pattern reads a text a bounded number of times, however long its
runs of letters, digits or blanks are.  Defined results: a null text is empty and has
no spans; positions are code points, end exclusive; rows are independent of each
other, so repeated rows and null identifiers give results like any other.  Other
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueweave.functions.storage import spread

KINDS = ("email", "ip", "card", "phone")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits are taken whole: a match that starts inside a run could not do better than one at its start.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def run_start(text: str, end: int, least: int) -> int:
    """Where the run of local characters that ends at ``end`` begins, not before ``least``."""
    while end > least and LOCAL.match(text, end - 1):
        end -= 1
    return end


def find_emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local@domain: the run of local characters before each @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = run_start(text, at, done)
        if start < at and (m := DOMAIN.match(text, at)):
            yield Span("email", start, m.end())
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def find_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping spans of each kind, in the order of kind and start."""
    out = list(find_emails(text)) if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            out.append(Span("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(Span("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(Span("phone", *m.span()))
    return out


# ---------------------------------------------------------------- transducers
# Characters that look like ASCII ones, by script.
CYRILLIC = dict(zip("АВЕЗКМНОРСТУХаеіјорсухѕһԁԛԝь", "ABE3KMHOPCTYXaeijopcyxshdqwb", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορυνικχϲ", "ABEZHIKMNOPTYXaopuvikxc", strict=True))
OTHERS = dict(zip("օսոհɑɡıℓ", "ounhagil", strict=True))
SIGNS = dict.fromkeys("․·•∙⋅", ".") | dict.fromkeys("‐‑‒–—−", "-") | {"＠": "@", "﹫": "@", "⁺": "+", "＋": "+"}
LOOKALIKES = CYRILLIC | GREEK | OTHERS | SIGNS
# Characters that are not seen.
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤﻿"
# Digit words of the corpus languages.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
REPEATS = {"double": 2, "triple": 3}
AT_WORDS, DOT_WORDS = ("at", "arobase", "arroba"), ("dot", "point", "punkt", "punto")

_digit = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_unit = rf"(?:(?:{'|'.join(REPEATS)})[\s-]+)?(?:{_digit}|[0-9]++)"
_gap = r"[ \t,-]{1,3}"
# White space is taken whole and only from where it begins, so that long runs of it are read once.
_dotted = rf"(?<![ \t])(?:[ \t]*+[\[({{<][ \t]*+(?:{'|'.join(DOT_WORDS)}|\.)[ \t]*+[\])}}>][ \t]*+|[ \t]++(?:{'|'.join(DOT_WORDS)})[ \t]++)"
_atted = rf"(?<![ \t])(?:[ \t]*+[\[({{<][ \t]*+(?:{'|'.join(AT_WORDS)}|@)[ \t]*+[\])}}>][ \t]*+|[ \t]++(?:{'|'.join(AT_WORDS)})[ \t]++)"
# Digit words and groups of digits in a row, two at least and one of them (or a plus or dot) spelled.
SPELLED = re.compile(rf"(?<!\w)(?:(?:plus|\+)[\s-]*)?{_unit}(?:(?:{_gap}|{_dotted}){_unit})+(?!\w)", re.IGNORECASE)
WORDS = re.compile(rf"(?P<repeat>{'|'.join(REPEATS)})[\s-]+|(?P<digit>{_digit})|(?P<figures>[0-9]+)|(?P<plus>plus)[\s-]*|(?P<dot>{_dotted})|(?P<gap>{_gap})", re.IGNORECASE)
DISGUISED_AT = re.compile(_atted, re.IGNORECASE)
DISGUISED_DOT = re.compile(rf"(?<=[\w]){_dotted}(?=\w)", re.IGNORECASE)
# What joins the parts of an address, and the labels after it.
ANY_AT = re.compile(rf"{_atted}|@", re.IGNORECASE)
LABELS = re.compile(rf"[A-Za-z0-9-]+(?:(?:{_dotted}|\.)[A-Za-z0-9-]+)+", re.IGNORECASE)
# The last label of a host: letters, two at least, so neither a number nor an initial.
TOP = re.compile(r"(?<![A-Za-z0-9-])(?=[A-Za-z0-9-]*[A-Za-z][A-Za-z0-9-]*[A-Za-z])[A-Za-z0-9-]+\Z")
DOTTED_IP = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:{_dotted}|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
_token = re.compile(r"\w+")
_spoken = frozenset([*DIGIT_WORDS, *REPEATS, *DOT_WORDS, "plus"])
_figures = re.compile(r"(?:plus)?[0-9]+")


def may_be_spelled(low: str) -> bool:
    """Whether a spelled unit stands beside another unit."""
    tokens = _token.findall(low)
    spoken = bytes(map(_spoken.__contains__, tokens))
    at = spoken.find(1)
    while at >= 0:
        if any(t in _spoken or _figures.fullmatch(t) for t in tokens[max(at - 1, 0) : at] + tokens[at + 1 : at + 2]):
            return True
        at = spoken.find(1, at + 1)
    return False


@lru_cache(maxsize=4096)
def stands_for(c: str) -> str:
    """The ASCII that a character is used for: a look-alike, a digit of another
    script, a form that Unicode calls compatible, or nothing if it is not seen."""
    if c < "\x80":
        return c
    if c in INVISIBLE:
        return ""
    new = LOOKALIKES.get(c) or (str(unicodedata.digit(c)) if c.isdecimal() else unicodedata.normalize("NFKC", c))
    return new if new.isascii() and not new.isspace() else c


class Edits:
    """A rewritten text and where its positions come from."""

    def __init__(self, text: str):
        self.text, self.starts, self.sources, self.ends = text, [0], [0], [len(text)]
        self.changed: list[tuple[int, int]] = []

    @classmethod
    def of(cls, text: str, edits: list[tuple[int, int, str]]) -> Edits:
        out, at, done = cls(text), 0, 0
        parts, out.starts, out.sources, out.ends = [], [], [], []

        def put(piece: str, start: int, end: int, length: int) -> None:
            nonlocal done
            if piece:
                out.starts.append(done)
                out.sources.append(start)
                out.ends.append(end)
                parts.append(piece)
                done += length

        for start, end, new in edits:
            put(text[at:start], at, start, start - at)
            if new:
                out.changed.append((done, done + len(new)))
            else:
                out.changed.append((done, done))
            put(new, start, end, len(new))
            at = end
        put(text[at:], at, len(text), len(text) - at)
        out.text = "".join(parts)
        out.kept = {(s, e) for s, e, _ in edits}
        return out

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a span of the rewritten text."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1

        def copied(k: int) -> bool:
            return (self.sources[k], self.ends[k]) not in self.kept

        left = self.sources[i] + (start - self.starts[i]) if copied(i) else self.sources[i]
        right = self.sources[j] + (end - self.starts[j]) if copied(j) else self.ends[j]
        return left, right

    def touched(self, start: int, end: int) -> bool:
        """Whether a rewrite lies in a span of the rewritten text."""
        i = bisect_left(self.changed, (start, start))
        if i and self.changed[i - 1][1] > start:
            return True
        return any(a < b or start < a for a, b in self.changed[i : i + 2] if a < end)


class Taken:
    """Disjoint spans, kept in order."""

    def __init__(self, spans: list[Span]):
        self.spans = [(s.start, s.end) for s in spans]

    def add(self, start: int, end: int) -> bool:
        """Take a span; False if it overlaps one that is taken."""
        i = bisect_left(self.spans, (start, end))
        if i < len(self.spans) and self.spans[i][0] < end or i and self.spans[i - 1][1] > start:
            return False
        self.spans.insert(i, (start, end))
        return True


def disguised_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Spans of addresses whose at or dots may be spelled or bracketed: from every at,
    local characters to the left and labels to the right."""
    done = 0
    for at in ANY_AT.finditer(text):
        if at.start() < done:
            continue
        start = run_start(text, at.start(), done)
        if start < at.start() and (m := LABELS.match(text, at.end())) and TOP.search(text, m.start(), m.end()):
            yield start, m.end()
            done = m.end()


def plain_characters(text: str) -> list[tuple[int, int, str]]:
    """Edits that replace look-alikes and drop invisible characters."""
    odd = [c for c in set(text) if stands_for(c) != c]
    if not odd:
        return []
    return [(m.start(), m.end(), stands_for(m[0])) for m in re.finditer("[" + re.escape("".join(odd)) + "]", text)]


def spelled_out(text: str) -> list[tuple[int, int, str]]:
    """Edits that turn spelled digits, and spelled or bracketed at and dot, into characters."""
    edits: dict[int, tuple[int, int, str]] = {}

    def put(start: int, end: int, new: str) -> None:
        edits.setdefault(start, (start, end, new))

    low = text.lower()
    if may_be_spelled(low):
        for run in SPELLED.finditer(text):
            if not any(c.isalpha() for c in run[0]):
                continue
            repeat = 1
            for m in WORDS.finditer(text, *run.span()):
                if m["repeat"]:
                    repeat = REPEATS[m["repeat"].lower()]
                    put(m.start(), m.end(), "")
                elif m["digit"]:
                    put(m.start(), m.end(), DIGIT_WORDS[m["digit"].lower()] * repeat)
                    repeat = 1
                elif m["figures"]:
                    if repeat > 1 and len(m[0]) == 1:
                        put(m.start(), m.end(), m[0] * repeat)
                    repeat = 1
                else:
                    put(m.start(), m.end(), "+" if m["plus"] else "." if m["dot"] else "")
    found = list(disguised_addresses(text)) if any(w in low for w in AT_WORDS) or "@" in low else []
    if any(w in low for w in DOT_WORDS) or any(c in low for c in "[({<"):
        found += [m.span() for m in DOTTED_IP.finditer(text)]
    for start, end in found:
        for part, new in ((DISGUISED_DOT, "."), (DISGUISED_AT, "@")):
            for m in part.finditer(text, start, end):
                put(m.start(), m.end(), new)
    out, at = [], 0
    for start, end, new in sorted(edits.values()):
        if start >= at:
            out.append((start, end, new))
            at = end
    return out


def find_disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows, in source positions."""
    first = plain_characters(text) if not text.isascii() else []
    one = Edits.of(text, first) if first else Edits(text)
    second = spelled_out(one.text)
    if not first and not second:
        return []
    two = Edits.of(one.text, second) if second else None
    taken = {k: Taken([s for s in base if s.kind == k]) for k in KINDS}
    out = []
    for edits in filter(None, (two, one if first else None)):
        for span in find_spans(edits.text):
            if edits is two:
                fresh = two.touched(span.start, span.end)
                start, end = two.source(span.start, span.end)
                if first:
                    fresh = fresh or one.touched(start, end)
                    start, end = one.source(start, end)
            else:
                fresh = one.touched(span.start, span.end)
                start, end = one.source(span.start, span.end)
            if fresh and taken[span.kind].add(start, end):
                out.append(Span(span.kind, start, end))
    return out


def all_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), ordered by kind and start."""
    base = find_spans(text or "")
    added = find_disguised(text, base) if text else []
    return base, sorted([*base, *added], key=lambda s: (KINDS.index(s.kind), s.start)) if added else base


SPAN_SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int,disguised:boolean>>"


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every document; spans in the order of kind and start.  No shuffle."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disguised", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1):
                base, spans = all_spans(text.as_py())
                plain = set(base)
                found.append([{**s._asdict(), "disguised": s not in plain} for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, SPAN_SCHEMA)


def digest_spans(found: DataFrame) -> DataFrame:
    """Counts of all spans by kind (and of base spans alone), the digest of base spans, and all spans as text."""

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: ~s["disguised"])

    def count(kind: str, spans) -> F.Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(k, F.col("spans")).alias(f"n_{k}") for k in KINDS],
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
        *[count(k, base).alias(f"n_base_{k}") for k in KINDS],
    )
