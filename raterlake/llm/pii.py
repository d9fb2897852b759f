"""Personal data by offset-preserving deobfuscation.

The base patterns (email, ip, card, phone) are matched on the text as it is. Texts with a
sign of disguise then pass three transducers, each of which rewrites the text and keeps
for every character it writes the span of source characters it stands for:

1. homoglyphs: look-alike letters of other scripts, full-width forms, digits of other
   scripts and dots of other scripts become ASCII, invisible characters vanish;
2. spelled digits: runs of at least two digit words become digits, and `plus` before a
   digit becomes `+`;
3. disguised `at` and `dot`, bracketed, or as plain words where both stand in one address;
   names of @ that mean nothing else (`arroba`) need no disguised dot.

Words are those of English, German, Spanish and French, apart by four blanks at most of any
kind. Not seen: words of other languages, digits in words above nine, and `at` before an
ordinary dot (`look at example.com` is prose).

The same patterns are matched on the result, and each span is mapped back to the source.
Base spans always stay; a mapped span is added unless it overlaps a span of its own kind.
All scans are linear: emails grow from their @, and digit runs are matched from their
first digit on.

Defined results: a null text counts as empty; texts without data give no span and the
digest of the empty string; rows are judged one by one, so repeated rows are alike; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Look-alikes of Latin letters in Cyrillic and Greek, and other dots.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "·": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", " ": " ",
}
#: Characters that are not seen.
INVISIBLE = "­​‌‍⁠﻿"
#: Digit words in English, German, Spanish and French.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
#: Names of @ that mean nothing else between two words, and names of the dot.
#: `at` is a word of prose, and so is `point` after it.
AT_NAMES = "arroba|arobase|arobas|klammeraffe|ät"
DOT_NAMES = "dot|punkt|punto"
#: Words of prose after `at` that open no domain.
ARTICLES = frozenset("a an the this that these those my our your his her their its der die das dem den ein eine einem le la les un une el los las una all any some no what which".split())

_B = r"[\x20\x09-\x0D]"
_GAP = _B + "{1,4}"
_NO_GAP = _B + "{0,4}"
_DIGIT = f"(?:{'|'.join(DIGITS)})"
_SPELLED = re.compile(rf"\b{_DIGIT}(?:(?:{_GAP}|{_B}?-{_B}?){_DIGIT})+\b", re.IGNORECASE)
_ONE_DIGIT = re.compile(rf"\b{_DIGIT}\b", re.IGNORECASE)
_PLUS = re.compile(rf"\b(?:plus|más|mas){_GAP}(?=\+?[0-9])", re.IGNORECASE)
_DOTTED = re.compile(rf"\b(?:{_DIGIT}|[0-9]+)(?:(?:\x20?\.\x20?|{_NO_GAP}\b(?:{DOT_NAMES}|point)\b{_NO_GAP})(?:{_DIGIT}|[0-9]+)(?:{_GAP}{_DIGIT})*)+\b", re.IGNORECASE)
_DOT_WORD = re.compile(rf"{_NO_GAP}\b(?:{DOT_NAMES}|point)\b{_NO_GAP}", re.IGNORECASE)
_BRACKETED = re.compile(rf"{_NO_GAP}[\[({{<]{_B}?(?:(at|@|{AT_NAMES})|{DOT_NAMES}|point|\.){_B}?[\])}}>]{_NO_GAP}", re.IGNORECASE)
_LABEL = r"[A-Za-z0-9-]{1,63}"
_LOCAL_PART = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}"
_PLAIN = re.compile(rf"{_LOCAL_PART}({_GAP}at{_GAP}|{_NO_GAP}@{_NO_GAP}){_LABEL}((?:(?:{_GAP}(?:{DOT_NAMES}){_GAP}|\.|\x20\.\x20){_LABEL})+)", re.IGNORECASE)
_NAMED = re.compile(rf"{_LOCAL_PART}({_GAP}(?:{AT_NAMES}){_GAP}){_LABEL}((?:(?:{_GAP}(?:{DOT_NAMES}|point){_GAP}|\.|\x20\.\x20){_LABEL})+)", re.IGNORECASE)
_PLAIN_DOT = re.compile(rf"{_GAP}(?:{DOT_NAMES}|point){_GAP}|\x20\.\x20", re.IGNORECASE)
#: Signs of disguise, each with what a text must hold, in small letters, to be searched for it.
_ODD = re.compile(r"[^\x00-ɏ‐-⁄₠-₿]|[\xa0\xad·‐-–․]")
_SIGNS = [
    ([*DOT_NAMES.split("|"), "point", *AT_NAMES.split("|")], re.compile(rf"{_B}(?:{DOT_NAMES}|point|{AT_NAMES}){_B}")),
    (["@"], re.compile(rf"{_B}@|@{_B}")),
    (["[", "(", "{", "<"], re.compile(rf"[\[({{<]{_B}?(?:at|@|{AT_NAMES}|{DOT_NAMES}|point|\.){_B}?[\])}}>]")),
    (["plus", "más", "mas"], re.compile(rf"\b(?:plus|más|mas){_GAP}(?:\+?[0-9]|{_DIGIT})")),
]


def _digit_run() -> re.Pattern[str]:
    """Two digit words side by side, as branches by first letter, which fail sooner."""
    rests: dict[str, list[str]] = {}
    for word in DIGITS:
        rests.setdefault(word[0], []).append(word[1:])
    word = "(?:" + "|".join(f"{c}(?:{'|'.join(r)})" for c, r in rests.items()) + ")"
    return re.compile(rf"\b{word}(?:{_GAP}|{_B}?-{_B}?){word}\b")


_DIGIT_RUN = _digit_run()


def disguised(text: str) -> bool:
    """Whether the transducers could change anything; cheap, since few texts have a sign."""
    if not text.isascii() and _ODD.search(text):
        return True
    low = text.lower()
    return any(any(x in low for x in needs) and sign.search(low) for needs, sign in _SIGNS) or _DIGIT_RUN.search(low) is not None


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, leftmost first and not overlapping within the kind."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found["email"].append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


class Traced:
    """A text and, for each of its characters, the source span it stands for."""

    def __init__(self, text: str, start: list[int] | None = None, end: list[int] | None = None):
        self.text = text
        self.start = list(range(len(text))) if start is None else start
        self.end = list(range(1, len(text) + 1)) if end is None else end

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Traced:
        """Replaces spans (sorted, apart); a new character stands for its whole span, the
        characters of a longer replacement for equal shares in order."""
        if not edits:
            return self
        text, start, end, at = [], [], [], 0
        for lo, hi, new in edits:
            text.append(self.text[at:lo])
            start += self.start[at:lo]
            end += self.end[at:lo]
            text.append(new)
            if new:
                start += [self.start[lo]] * len(new)
                end += [self.end[hi - 1]] * len(new)
            at = hi
        text.append(self.text[at:])
        return Traced("".join(text), start + self.start[at:], end + self.end[at:])

    def source(self, lo: int, hi: int) -> tuple[int, int]:
        return self.start[lo], self.end[hi - 1]


def _plain_letter(c: str) -> str | None:
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if 0xFF01 <= ord(c) <= 0xFF5E:  # full-width forms
        return chr(ord(c) - 0xFEE0)
    if (d := unicodedata.digit(c, None)) is not None and c.isdecimal():
        return str(d)
    return None


def homoglyphs(t: Traced) -> Traced:
    new = {c: p for c in set(t.text) if c > "\x7f" and (p := _plain_letter(c)) is not None}
    if not new:
        return t
    return t.rewrite([(m.start(), m.end(), new[m[0]]) for m in re.finditer("[" + re.escape("".join(new)) + "]", t.text)])


def spelled_digits(t: Traced) -> Traced:
    """Digit words to digits, the blanks between them left out; in dotted numbers, single words too."""
    spans = [m.span() for m in _SPELLED.finditer(t.text)]
    for m in _DOTTED.finditer(t.text):
        if _ONE_DIGIT.search(m[0]) or _DOT_WORD.search(m[0]):
            spans.append(m.span())
    spans.sort()
    edits: list[tuple[int, int, str]] = []
    for lo, hi in spans:
        last = edits[-1][1] if edits else 0
        words = [m for m in _ONE_DIGIT.finditer(t.text, lo, hi) if m.start() >= last]
        for i, m in enumerate(words):
            if i and not t.text[words[i - 1].end() : m.start()].strip(" -\t\n\x0b\x0c\r"):
                edits.append((words[i - 1].end(), m.start(), ""))
            edits.append((m.start(), m.end(), DIGITS[m[0].lower()]))
        edits += [(m.start(), m.end(), ".") for m in _DOT_WORD.finditer(t.text, lo, hi)]
    edits.sort()
    apart = []
    for e in edits:
        if not apart or e[0] >= apart[-1][1]:
            apart.append(e)
    t = t.rewrite(apart)
    return t.rewrite([(m.start(), m.end(), "" if t.text[m.end()] == "+" else "+") for m in _PLUS.finditer(t.text)])


def at_and_dot(t: Traced) -> Traced:
    t = t.rewrite([(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKETED.finditer(t.text)])
    for pattern in (_NAMED, _PLAIN):
        edits = []
        for m in pattern.finditer(t.text):
            dots = list(_PLAIN_DOT.finditer(t.text, m.start(2), m.end(2)))
            if not dots and (m[1] == "@" or m[1].strip().lower() == "at"):
                continue
            if m[1].strip().lower() == "at" and t.text[m.end(1) : m.start(2)].lower() in ARTICLES:
                continue  # we met at the dot com boom
            edits.append((m.start(1), m.end(1), "@"))
            edits += [(d.start(), d.end(), ".") for d in dots]
        t = t.rewrite(edits)
    return t


def deobfuscate(text: str) -> Traced:
    return at_and_dot(spelled_digits(homoglyphs(Traced(text))))


def spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans and all spans of each kind, in code points of the source."""
    base = find(text)
    if not disguised(text):
        return base, base
    traced = deobfuscate(text)
    if traced.text == text:
        return base, base
    full = {}
    for kind, found in find(traced.text).items():
        mapped = sorted(traced.source(lo, hi) for lo, hi in found)
        out, taken = [], sorted(base[kind])
        i = 0
        for lo, hi in mapped:
            while i < len(taken) and taken[i][1] <= lo:
                i += 1
            if (i == len(taken) or taken[i][0] >= hi) and (not out or out[-1][1] <= lo):
                out.append((lo, hi))
        full[kind] = sorted(base[kind] + out)
    return base, full


def joined(found: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{lo}:{hi}" for k in KINDS for lo, hi in found[k])


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_spans and spans (kind:start:end,
    comma-joined), base_sha256 and n_added."""

    def run(batches):
        for chunk in kernels.chunks(batches):
            out = []
            for doc, text in zip(chunk.column("doc_id").to_pylist(), chunk.column("text").to_pylist()):
                base, full = spans(text or "")
                b, f = joined(base), joined(full)
                n = [len(base[k]) for k in KINDS]
                out.append((doc, *n, b, hashlib.sha256(b.encode()).hexdigest(), f, sum(map(len, full.values())) - sum(n)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 3 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_spans", "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, base_sha256 string, spans string, n_added long")
