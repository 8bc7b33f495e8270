"""Personal data in texts, plain and disguised, as spans of the source text.

Plain identifiers are found by ``scan``.  For disguised ones the text goes
through three transducers, each a list of edits (start, end, replacement)
that yields a rewritten text and a map back to source offsets:

* homoglyphs: full-width and mathematical characters, look-alike Cyrillic
  and Greek letters, other scripts' digits, character references such as
  ``&#64;``; invisible characters go;
* spelled digits: runs of digit words (English, German, French, Spanish),
  "double" and "triple", digits, and "plus", "dot" and "dash" words;
* at / dot disguises: bracketed or spelled ``at`` and ``dot`` between the
  labels of an address, followed label by label from each sign outwards,
  however long the labels are and however many.

The same ``scan`` runs on the rewritten text, and what it finds across an
edit is mapped back.  Of a number, at least one sign in four must come from
a word: prose has single digit words next to long numbers too.  A document
without a trigger costs a few searches over the text and nothing else.

Defined results: a null text counts as empty and has no spans; a null id
is a row like any other; repeated rows each give a row; very long texts are
read whole, in linear time; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]  # kind, start, end (code points, end exclusive)

HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match ends at the end of a digit run, so starting at run starts only loses nothing
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Extends left from each host: linear also on long runs without ``@``."""
    end = 0
    for m in HOST.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            yield "email", start, end


def scan(text: str) -> list[Span]:
    """The plain identifiers, leftmost and non-overlapping per kind, by start, then kind."""
    found: list[Span] = list(emails(text)) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (d.lstrip("0") or "0" for d in m[0].split("."))):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := digits(m[0])) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(digits(m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Rewritten:
    """A text after a transducer: the new text, and spans mapped back to the old one."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, self.new, self.old, self.edited = [], [], [], []
        at = length = 0
        for start, end, put in [*edits, (len(text), len(text), "")]:
            if start > at:  # an untouched stretch
                self._piece(length, at, False)
                parts.append(text[at:start])
                length += start - at
            if put or end > start:
                self._piece(length, start, True)
                parts.append(put)
                length += len(put)
            at = end
        self._piece(length, len(text), False)
        self.text = "".join(parts)

    def _piece(self, new: int, old: int, edited: bool) -> None:
        self.new.append(new)
        self.old.append(old)
        self.edited.append(edited)

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span, and whether an edit lies in it."""
        i, j = bisect_right(self.new, start) - 1, bisect_right(self.new, end - 1) - 1
        left = self.old[i] + (0 if self.edited[i] else start - self.new[i])
        right = self.old[j + 1] if self.edited[j] else self.old[j] + end - self.new[j]
        return left, right, any(self.edited[i:j + 1])

    def put_in(self, start: int, end: int) -> int:
        """How many characters of the new text in [start, end) come from edits."""
        i, j = bisect_right(self.new, start) - 1, bisect_right(self.new, end - 1) - 1
        ends = self.new[i + 1:j + 2]
        return sum(min(b, end) - max(a, start) for a, b, e in zip(self.new[i:j + 1], ends, self.edited[i:j + 1]) if e)


# Cyrillic and Greek letters that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "τ": "t",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X",
    "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-",
}

# Digit words, 0 to 9.
DIGIT_WORDS = {
    "en": ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"),
    "de": ("null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"),
    "fr": ("zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"),
    "es": ("cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"),
}
# Words for signs, in the same languages.
SIGN_WORDS = {"plus": "+", "más": "+", "dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "minus": "-",
              "hyphen": "-"}
# Words that repeat the digit after them.
TIMES_WORDS = {"double": 2, "triple": 3, "doble": 2, "doppel": 2}


@lru_cache(maxsize=1)
def glyphs() -> dict[str, str]:
    """Character -> what it stands for: look-alikes, compatibility forms of ASCII, digits of other scripts."""
    table = dict(LOOK_ALIKES)
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Cf":
            table.setdefault(c, "")
        elif kind == "Nd":
            table.setdefault(c, str(unicodedata.digit(c)))
        elif kind[0] in "LPS" and (plain := unicodedata.normalize("NFKC", c)) != c and len(plain) == 1 and "!" <= plain <= "~":
            table.setdefault(c, plain)
    return table


@lru_cache(maxsize=1)
def glyph_pattern() -> re.Pattern[str]:
    """The characters of ``glyphs`` up to U+FFFF (a class without larger ones is searched much faster)."""
    return re.compile("[" + "".join(re.escape(c) for c in glyphs() if c < "\U00010000") + "]")


BEYOND = re.compile("[\U00010000-\U0010ffff]")


REFERENCE = re.compile(r"&(?:#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|commat|period|plus|lowbar|hyphen|dash);")


def homoglyphs(text: str) -> list[tuple[int, int, str]]:
    edits = []
    if "&" in text:
        found = ((m.span(), html.unescape(m[0])) for m in REFERENCE.finditer(text))
        edits = [(*span, c if c <= "~" else "-") for span, c in found if "!" <= c <= "~" or c in "\u2010\u2011"]
    if text.isascii():
        return edits
    table = glyphs()
    found = [m.start() for m in glyph_pattern().finditer(text)]
    if BEYOND.search(text):
        found += [m.start() for m in BEYOND.finditer(text) if m[0] in table]
    return sorted(edits + [(i, i + 1, table[text[i]]) for i in found])


_DIGITS = {w: str(i) for words in DIGIT_WORDS.values() for i, w in enumerate(words)} | {"oh": "0"}
_WORDS = "|".join(sorted(map(re.escape, _DIGITS), key=len, reverse=True))
_SIGNS = "|".join(map(re.escape, SIGN_WORDS))
_TIMES = "|".join(TIMES_WORDS)
_BREAK = r"[\s,_/-]++"
_ITEM = rf"(?:(?:{_TIMES}){_BREAK}(?:{_WORDS}|[0-9])|{_WORDS}|{_SIGNS}|[0-9]++)(?!\w)"
SPELLED = re.compile(rf"(?<!\w){_ITEM}(?:{_BREAK}{_ITEM})++", re.I)
ITEM = re.compile(rf"(?P<times>{_TIMES}){_BREAK}(?P<digit>{_WORDS}|[0-9])|(?P<word>{_WORDS}|{_SIGNS})|[0-9]++", re.I)
#: A digit word next to another item, the cheapest sign of a spelled number.
HINT = re.compile(rf"\b(?:{_WORDS}|{_TIMES})[\s,_/-]++(?:{_WORDS}|{_SIGNS}|{_TIMES}|[0-9]+)\b|[0-9]\b[\s,_/-]++(?:{_WORDS}|{_SIGNS}|{_TIMES})\b|\b(?:plus|más)[\s,_/-]++(?:{_WORDS}|[0-9])")


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """An edit per word, and one per break inside a run."""
    edits = []
    for run in SPELLED.finditer(text):
        end = run.start()
        for m in ITEM.finditer(text, *run.span()):
            if m.start() > end:
                edits.append((end, m.start(), ""))
            end = m.end()
            if m["times"]:
                edits.append((*m.span(), _digit(m["digit"]) * TIMES_WORDS[m["times"].lower()]))
            elif m["word"]:
                edits.append((*m.span(), _digit(m["word"])))
    return edits


def _digit(word: str) -> str:
    w = word.lower()
    return _DIGITS.get(w) or SIGN_WORDS.get(w) or w


SPACES = " \t\xa0"
#: A disguised sign: in brackets, or as a word between spaces.
DISGUISE = re.compile(r"[\[({<][ \t\xa0]*+(?P<inner>at|@|arroba|dot|punkt|punto|point|\.)[ \t\xa0]*+[\])}>]"
                      r"|(?<=[ \t\xa0])(?P<outer>at|@|arroba|dot|punkt|punto)(?=[ \t\xa0])", re.I)
#: What every at / dot disguise holds: a bracketed sign, or a spelled dot.
SIGNS = re.compile(r"[\[({<][ \t\xa0]*+(?:at|@|arroba|dot|punkt|punto|point|\.)[ \t\xa0]*+[\])}>]"
                   r"|[ \t\xa0](?:dot|punkt|punto)[ \t\xa0]", re.I)
LABEL = re.compile(r"[A-Za-z0-9_%+-]++")
HOST_LABEL = re.compile(r"[A-Za-z0-9-]+")
LABEL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")


class Sign(NamedTuple):
    start: int
    end: int
    put: str  # "@" or "."
    plain: bool
    bracketed: bool


class Chain(NamedTuple):
    """Labels with a sign between each two."""

    labels: list[tuple[int, int]]
    signs: list[Sign]


def disguised_signs(text: str) -> list[Sign]:
    """The disguised signs with the spaces around them."""
    out: list[Sign] = []
    for m in DISGUISE.finditer(text):
        (start, end), least = m.span(), out[-1].end if out else 0
        while start > least and text[start - 1] in SPACES:
            start -= 1
        while end < len(text) and text[end] in SPACES:
            end += 1
        word = (m["inner"] or m["outer"]).lower()
        out.append(Sign(start, end, "@" if word in ("at", "@", "arroba") else ".", False, m["inner"] is not None))
    return out


def chains(text: str) -> Iterator[Chain]:
    """What reads as one address or number around disguised signs; each character is looked at a bounded number of times."""
    signs = disguised_signs(text)
    floor = i = 0
    while i < len(signs):
        labels, found = [], []
        at = signs[i].start
        while True:  # outwards to the left: labels with plain signs between them
            start = at
            while start > floor and text[start - 1] in LABEL_SIGNS:
                start -= 1
            if start == at:
                break
            labels.insert(0, (start, at))
            if start - 1 <= floor or text[start - 1] not in ".@":
                break
            found.insert(0, Sign(start - 1, start, text[start - 1], True, False))
            at = start - 1
        found = found[len(found) - max(len(labels) - 1, 0):]
        if not labels:
            i += 1
            continue
        sign = signs[i]
        i += 1
        while sign is not None and (label := LABEL.match(text, sign.end)):
            found.append(sign)
            labels.append(label.span())
            end, sign = label.end(), None
            if i < len(signs) and signs[i].start == end:
                sign, i = signs[i], i + 1
            elif text[end:end + 1] in (".", "@") and LABEL.match(text, end + 1):
                sign = Sign(end, end + 1, text[end], True, False)
        floor = labels[-1][1]
        if found:
            yield Chain(labels, found)


def at_and_dot(text: str) -> list[tuple[int, int, str]]:
    """Edits inside what reads as one address or number."""
    used: set[Sign] = set()
    for labels, signs in chains(text):
        ats = [k for k, s in enumerate(signs) if s.put == "@"]
        for n, k in enumerate(ats):
            first = ats[n - 1] + 1 if n else 0  # a label is left of the sign with its number
            last = ats[n + 1] if n + 1 < len(ats) else len(signs)
            host = [text[a:b] for a, b in labels[k + 1:last + 1]]
            while host and not HOST_LABEL.fullmatch(host[-1]):
                host.pop()
            own = signs[first:k + len(host)]
            if len(host) > 1 and believable(host, own, signs[k]):
                used.update(own)
        run: list[int] = []
        for k, (a, b) in enumerate([*labels, (0, 0)]):
            number = b - a in (1, 2, 3) and text[a:b].isdigit()
            if run and (not number or signs[k - 1].put != "."):
                if len(run) > 3:
                    used.update(signs[run[0]:run[-1]])
                run = []
            if number:
                run.append(k)
    return [(s.start, s.end, s.put) for s in sorted(used) if not s.plain]


# Words that follow a plain "at" in prose.
DETERMINERS = frozenset("a an the this that these those my your his her its our their all each every which".split())


def believable(host: list[str], signs: list[Sign], at: Sign) -> bool:
    """Prose has a plain " at " too: it counts only with a disguised dot or a bracket, and not before a determiner."""
    if not any(not s.plain and (s.put == "." or s.bracketed) for s in signs):
        return False
    prose = not at.plain and not at.bracketed and re.match(r"[A-Za-z]*", host[0])[0].lower() in DETERMINERS
    return bool(re.search(r"[A-Za-z]{2,}$", host[-1])) and not prose


def disguised(text: str) -> list[Span]:
    """Identifiers that only the rewritten text shows, as spans of ``text``."""
    steps: list[tuple[Rewritten, bool]] = []
    now = text
    for transducer, hint in ((homoglyphs, None), (spelled_digits, HINT), (at_and_dot, SIGNS)):
        if hint is not None and not hint.search(now if hint is SIGNS else now.lower()):
            continue
        if edits := transducer(now):
            steps.append((Rewritten(now, edits), transducer is spelled_digits))
            now = steps[-1][0].text
    if not steps:
        return []
    found = []
    for kind, start, end in scan(now):
        touched, number, worded = False, len(digits(now[start:end])), 0
        for step, spelled in reversed(steps):
            worded += step.put_in(start, end)
            start, end, edited = step.back(start, end)
            if spelled and edited and 4 * worded < number and kind != "email":
                break
            touched |= edited
        else:
            if touched:
                found.append((kind, start, end))
    return found


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans); a disguised span inside a plain one of its kind adds nothing."""
    base = scan(text)
    more = [s for s in disguised(text) if not any(k == s[0] and a <= s[1] and s[2] <= b for k, a, b in base)]
    return base, in_order(base + more) if more else base


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and spans (arrays of kind, start, end) for every row."""
    span = "array<struct<kind:string,start:int,end:int>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def listed(spans: list[list[Span]]) -> pa.Array:
            return pa.array([[dict(zip(("kind", "start", "end"), s)) for s in one] for one in spans], arrow)

        for batch in batches:
            both = [find(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), listed([b for b, _ in both]), listed([a for _, a in both])], ["id", "base", "spans"])

    return rows.mapInArrow(run, f"id {kind}, base {span}, spans {span}").withColumnRenamed("id", id_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns: plain spans counted per kind and hashed, all spans listed."""
    def text(c: str):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(id_col, *map(count, KINDS), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"),
                        F.size("spans").cast("bigint").alias("n_spans"))
