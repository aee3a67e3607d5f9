"""Personal data: identifiers in plain and in disguised form, as spans of the source text.

Plain forms are found in the text as it is (the base spans). Disguised ones go through
transducers, each a rewriting that keeps for every character the place it came from:
look-alike letters and digits, invisible characters, "at" and "dot" in brackets or in
words, and spelled digits. The same detectors run on the rewritten text, and their spans
are mapped back to code points of the source. A span found that way is added beside the
base spans unless it lies inside one or begins within one: where a look-alike letter ends a plain
match early or begins it late, the longer span is the identifier.

Defined results: a null or empty text has no spans; ends are exclusive; spans are in order
of start, then kind as in ``KINDS``; matches that fail a check (an address part over 255, a
wrong check digit or number of digits) are dropped without another try. All detectors are
linear in the text, also on very long runs of digits or letters.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewharf.llm.common import lean

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# All characters that an address, a card or a phone number can hold, from its first on.
_ISLAND = re.compile(r"[0-9+][0-9 .()+-]{6,}")
# A match always begins where a run of digits does: one that fails there fails further on.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    doubled = (sum(divmod(2 * d, 10)) for d in digits[-2::-2])
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            yield start, found.end()
            done = found.end()
        at = text.find("@", at + 1)


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain identifiers of a text, in order."""
    spans = [(start, 0, end) for start, end in _emails(text)]
    for island in _ISLAND.finditer(text):
        start, piece = island.start(), island[0]
        for m in _IP.finditer(piece):
            if all(len(p := part.lstrip("0")) < 3 or len(p) == 3 and p <= "255"
                   for part in m.groups()):
                spans.append((start + m.start(), 1, start + m.end()))
        for m in _CARD.finditer(piece):
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((start + m.start(), 2, start + m.end()))
        for m in _PHONE.finditer(piece):
            if 10 <= len(_digits(m[0])) <= 15:
                spans.append((start + m.start(), 3, start + m.end()))
    return sorted(spans)


# Letters of other alphabets that look like Latin ones.
_GLYPHS = dict(zip("АВЕЅІЈКМНОРСТХаесіјорѕухԁɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονι",
                   "ABESIJKMHOPCTXaecijopsyxdgABEZHIKMNOPTYXaovi"))
_GLYPHS |= {"һ": "h", "Ү": "Y", "ո": "n", "օ": "o", "ս": "u", "ց": "g", "ı": "i", "ɑ": "a"}
_GLYPHS |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full-width forms


def _compatible() -> dict[str, str]:
    """Letters and digits that Unicode itself calls forms of an ASCII one, and all decimal digits."""
    found = {}
    for code in range(0x80, 0x20000):
        char = chr(code)
        digit = unicodedata.decimal(char, None)
        plain = unicodedata.normalize("NFKC", char) if digit is None else str(digit)
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            found[char] = plain
    return found


_GLYPHS |= _compatible()
_GLYPHS |= dict.fromkeys("­​‌‍⁠﻿", "")  # invisible
_GLYPHS |= {"․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "\u00a0": " ", "\u202f": " "}
_GLYPH_SET = frozenset(_GLYPHS)
_GLYPH_TABLE = str.maketrans(_GLYPHS)

# Digits in English, German, French and Spanish, without articles.
_NUMBERS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5",
    "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7",
    "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9",
}
_NUMBER = "(?:" + "|".join(sorted(_NUMBERS, key=len, reverse=True)) + ")"
_DOTS = "(?:dot|punkt|punto|point)"
_TIMES = {"": 1, "double": 2, "triple": 3}
_SPELLED = re.compile(
    rf"(?<!\w)(?:plus[ -]+)?(?:(?:(?:double|triple)[ -]+)?{_NUMBER}|[0-9]++)"
    rf"(?:(?: +{_DOTS} +|[ .(),-]+)(?:(?:(?:double|triple)[ -]+)?{_NUMBER}|[0-9]++))*(?!\w)", re.I)
#: The least digits that a detector wants of a number with few words in it.
LEAST_DIGITS = 10
_MARKS = str.maketrans(dict.fromkeys("-.()+,;:!?", " "))
_TOKEN = re.compile(
    rf"(?P<plus>plus[ -]+)|(?:(?P<times>double|triple)[ -]+)?(?P<number>{_NUMBER})(?!\w)"
    rf"|[0-9]+| +{_DOTS} +|(?P<between>[ .(),-]+)", re.I)
# Letters that stand for digits among digits.
_FOR_DIGITS = {"l": "1", "I": "1", "O": "0", "o": "0"}
_DIGIT = re.compile("[0-9]")
_MIXED = re.compile(r"[0-9][lIOo](?![A-Za-z])|(?<![A-Za-z])[lIOo][0-9]")
_MIXED_RUN = re.compile(r"(?<![\w+])\+?[0-9lIOo][0-9lIOo .()-]{8,}[0-9lIOo](?!\w)")
_AMONG_DIGITS = re.compile(r"(?<=[0-9])[lIOo]+(?![A-Za-z])|(?<![A-Za-z])[lIOo]+(?=[0-9])")
# At and dot in brackets, with spaces around.
_AT = r"(?:at|arroba|ät|@)"
_DOT = r"(?:dot|punkt|punto|point|\.)"
_BRACKETED = re.compile(
    rf" {{0,3}}(?:\[ {{0,3}}{_AT} {{0,3}}\]|\( {{0,3}}{_AT} {{0,3}}\)|\{{ {{0,3}}{_AT} {{0,3}}\}}"
    rf"|< {{0,3}}{_AT} {{0,3}}>) {{0,3}}"
    rf"|( {{0,3}}(?:\[ {{0,3}}{_DOT} {{0,3}}\]|\( {{0,3}}{_DOT} {{0,3}}\)|\{{ {{0,3}}{_DOT} {{0,3}}\}}"
    rf"|< {{0,3}}{_DOT} {{0,3}}>) {{0,3}})", re.I)
# In words only as a whole: name at host dot domain, or numbers with dots between.
_ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "uk")
_ENDED = tuple(f".{ending}" for ending in _ENDINGS)
_DOTTED = rf"(?:[A-Za-z0-9-]+\.){{1,6}}(?:{'|'.join(_ENDINGS)})(?![A-Za-z0-9-])"
_WORDY = re.compile(
    rf"(?<=[A-Za-z0-9_%+-]) {{1,3}}(?:at|arroba) {{1,3}}"
    rf"(?=[A-Za-z0-9-]+ {{1,3}}{_DOT} {{1,3}}[A-Za-z]|{_DOTTED})"
    rf"|((?<=[A-Za-z0-9_-]) {{1,3}}(?:dot|punkt|punto|point) {{1,3}}(?=[A-Za-z0-9]))", re.I)
_WORDY_ADDRESS = re.compile(
    r"[A-Za-z0-9_%+-] {1,3}(?:at|arroba) {1,3}[A-Za-z0-9-]+ {1,3}(?:dot|punkt|punto|point) "
    r"|@[A-Za-z0-9-]+ {1,3}(?:dot|punkt|punto|point) "
    r"|[0-9] {1,3}(?:dot|punkt|punto|point) {1,3}[0-9]"
    rf"|[A-Za-z0-9_%+-] {{1,3}}(?:at|arroba) {{1,3}}{_DOTTED}", re.I)
_DOT_WORDS = frozenset(("dot", "punkt", "punto", "point"))
_ANY_BRACKETED = re.compile(rf"[\[({{<] {{0,3}}(?:{_AT}|{_DOT}) {{0,3}}[\])}}>]", re.I)


@dataclass
class Rewritten:
    """A text and, for each character, the span of the source it stands for."""

    text: str
    starts: list[int]
    ends: list[int]

    @staticmethod
    def of(text: str) -> Rewritten:
        return Rewritten(text, list(range(len(text))), list(range(1, len(text) + 1)))

    def replace(self, pattern: re.Pattern, by) -> Rewritten:
        """Replace each match that ``by`` gives a text for."""
        return self.edited(
            (*m.span(), new) for m in pattern.finditer(self.text) if (new := by(m)) is not None)

    def edited(self, edits: Iterable[tuple[int, int, str]]) -> Rewritten:
        """Replace stretches, in order, by a few characters, each standing for the whole stretch."""
        parts, starts, ends, done = [], [], [], 0
        for a, b, new in edits:
            parts += (self.text[done:a], new)
            starts += self.starts[done:a]
            ends += self.ends[done:a]
            if b > a:
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            done = b
        if not done:
            return self
        parts.append(self.text[done:])
        return Rewritten("".join(parts), starts + self.starts[done:], ends + self.ends[done:])


def _spelled(run: Rewritten) -> Rewritten:
    """Spelled digits as digits; what separates two of them goes, commas become spaces."""
    edits = []
    for m in _SPELLED.finditer(run.text):
        tokens = list(_TOKEN.finditer(run.text, *m.span()))
        numbers = sum(bool(t["number"]) for t in tokens)
        if numbers + sum(bool(t["plus"]) for t in tokens) < 3 and not (
                numbers and len(_digits(m[0])) + numbers >= LEAST_DIGITS):
            continue
        for before, t, after in zip([None, *tokens], tokens, [*tokens[1:], None]):
            if t["plus"]:
                edits.append((*t.span(), "+"))
            elif t["number"]:
                times = _TIMES[(t["times"] or "").lower()]
                edits.append((*t.span(), _NUMBERS[t["number"].lower()] * times))
            elif between := t["between"]:
                spelled = before and before["number"] and after and after["number"]
                if spelled and not set(between) & set(".()"):
                    edits.append((*t.span(), ""))
                elif "," in between:
                    edits.append((*t.span(), " "))
    return run.edited(edits)


def _mixed(run: Rewritten) -> Rewritten:
    """Letters among the digits of a long number as digits."""
    return run.edited(
        (m.start() + x.start(), m.start() + x.end(), "".join(map(_FOR_DIGITS.get, x[0])))
        for m in _MIXED_RUN.finditer(run.text) if len(_digits(m[0])) >= LEAST_DIGITS - 4
        for x in _AMONG_DIGITS.finditer(m[0]))


def _may_be_spelled(words: list[str]) -> bool:
    """Whether there are three numbers in words, two of them at most one word apart.

    Or a run of words that are numbers or digits, some of each, with enough digits in all.
    """
    at = [i for i, word in enumerate(words) if word in _NUMBERS]
    if len(at) > 2 and any(b - a <= 2 for a, b in zip(at, at[1:])):
        return True
    spelled = digits = 0
    for word in words:
        if word in _NUMBERS:
            spelled, digits = spelled + 1, digits + 1
        elif word.isdecimal():
            digits += len(word)
        elif word not in ("plus", "double", "triple"):
            spelled = digits = 0
        if spelled and digits >= LEAST_DIGITS:
            return True
    return False


def rewritten(text: str) -> Rewritten | None:
    """The text after all transducers; None if none of them has anything to change."""
    glyphs = not text.isascii() and not _GLYPH_SET.isdisjoint(text)
    words = (text.translate(_GLYPH_TABLE) if glyphs else text).lower().translate(_MARKS).split()
    numbers = not _NUMBERS.keys().isdisjoint(words) and _may_be_spelled(words)
    dots = not _DOT_WORDS.isdisjoint(words) or (
        " at " in text or " arroba " in text) and any(ending in text for ending in _ENDED)
    mixed = glyphs or _DIGIT.search(text) and _MIXED.search(text)
    if not (glyphs or numbers or dots or mixed or _ANY_BRACKETED.search(text)):
        return None
    out = Rewritten.of(text)
    if glyphs:
        out = out.edited((i, i + 1, _GLYPHS[c]) for i, c in enumerate(text) if c in _GLYPH_SET)
    if numbers:
        out = _spelled(out)
    if mixed:
        out = _mixed(out)
    out = out.replace(_BRACKETED, lambda m: "." if m[1] else "@")
    if _WORDY_ADDRESS.search(out.text):
        out = out.replace(_WORDY, lambda m: "." if m[1] else "@")
    return None if out.text == text else out


def all_spans(text: str | None) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) of a text: the base spans and those of disguised identifiers."""
    if not text:
        return []
    base = plain_spans(text)
    found = [(start, kind, end, True) for start, kind, end in base]
    if (changed := rewritten(text)) is not None:
        plain = [(start, end) for start, _, end in base]
        begins = [start for start, _ in plain]
        # How far the base spans that begin up to each one reach, and where the next begins.
        reach = list(accumulate((end for _, end in plain), max))
        for start, kind, end in plain_spans(changed.text):
            a, b = changed.starts[start], changed.ends[end - 1]
            i = bisect_right(begins, a)
            if i and reach[i - 1] >= b:
                continue  # inside a base span: the text already says as much
            if i and reach[i - 1] > a and begins[i - 1] != a:
                continue  # it begins within a base span and goes on: two identifiers run into one
            found.append((a, kind, b, False))
    return sorted(set(found))


def detect(documents: DataFrame, *, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """All columns of ``documents`` with the spans of personal data; that column is replaced."""
    before = documents.drop(spans_col)
    names = before.columns
    at = names.index(text_col)
    schema = T.StructType([*before.schema.fields,
                           T.StructField(spans_col, T._parse_datatype_string(SPANS))])
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()),
                                    ("end", pa.int32()), ("base", pa.bool_())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"kind": KINDS[kind], "start": start, "end": end, "base": base}
                 for start, kind, end, base in all_spans(text.as_py())]
                for text in batch.column(at)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(spans, kind_type)], names=[*names, spans_col])

    return before.mapInArrow(lean(found), schema)
