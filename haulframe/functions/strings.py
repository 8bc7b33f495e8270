"""STR1-STR8, FLT9: text functions as Column expressions.

Every function returns a Column built from Spark built-ins, so it stays in
whole-stage codegen; the ``*_job`` wrappers apply one to a table column.
"""

from __future__ import annotations

import json
import re
import unicodedata
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
# Typeahead accent table (lower-case letters mapped one to one).
TYPEAHEAD_ACCENT_FROM = "ãàáäâẽèéëêìíïîõòóöôùúüûñç"
TYPEAHEAD_ACCENT_TO = "aaaaaeeeeeiiiiooooouuuunc"
# The five HTML entities, in the order they are escaped.
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
# Named entities that the pages of this product use (beyond the five).
EXPORT_ENTITIES = [("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&reg;", "\u00ae"),
                   ("&hellip;", "\u2026"), ("&mdash;", "\u2014"), ("&ndash;", "\u2013"), ("&apos;", "'")]
# Characters that make a spreadsheet treat a cell as a formula.
FORMULA_START = "^[=+\\-@\t\r]"
# ---------------------------------------------------------------------------


def _nfd_table() -> tuple[str, str]:
    """Every character that decomposes into one base character and marks U+0300 to U+036F, and that base.

    Built from a rule (Unicode decomposition) over all code points: Latin,
    Greek, Cyrillic and the rest.
    """
    src, dst = [], []
    for cp in range(0x80, 0x30000):  # no decomposition beyond
        whole = unicodedata.normalize("NFD", chr(cp))
        base = "".join(m for m in whole if not 0x0300 <= ord(m) <= 0x036F)
        if len(base) == 1 and base != chr(cp):
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


NFD_FROM, NFD_TO = _nfd_table()


def fold_accents(c: Column) -> Column:
    """FLT9: NFD-fold accents (precomposed letters to base, combining marks removed); plain ASCII is passed on as it is."""
    folded = F.translate(F.regexp_replace(c, "[\\u0300-\\u036f]", ""), NFD_FROM, NFD_TO)
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(folded)


def js_text(c: Column, dtype: T.DataType) -> Column:
    """Text of a cell as a JS template literal prints it.

    Integral doubles print without a fraction (900.0 -> "900"); other types
    use the plain cast.  Only string and number cells are searchable; other
    types give null.
    """
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c), F.lit("NaN")).when(
            (c == F.floor(c)) & (F.abs(c) < 1e15), F.floor(c).cast("bigint").cast("string")
        ).otherwise(c.cast("string"))
    if isinstance(dtype, (T.StringType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DecimalType)):
        return c.cast("string")
    return F.lit(None).cast("string")


def norm_key(c: Column) -> Column:
    """STR1: lower-case, missing or empty becomes the sentinel 'none'."""
    return F.lower(F.coalesce(F.nullif(c, F.lit("")), F.lit("none")))


TAG = "<[^>]+>"
ENTITY = "&#?[0-9A-Za-z]+;"


def strip_tags(c: Column) -> Column:
    """STR2 (plain): remove every tag."""
    return F.regexp_replace(c, TAG, "")


def js_trim(c: Column) -> Column:
    """String.prototype.trim: strip leading and trailing whitespace (not only spaces)."""
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def remove_html(c: Column) -> Column:
    """STR2 (full): remove tags and entities, trim."""
    # tags first: an entity may appear once the tag inside it has gone
    return js_trim(F.regexp_replace(strip_tags(c), ENTITY, ""))


def html_escape(c: Column) -> Column:
    """STR3: escape the five entities, ampersand first."""
    out = c
    for raw, ent in HTML_ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(ent))
    return out


def html_unescape(c: Column) -> Column:
    """STR3: unescape the five entities, '&amp;' first (as the reference does)."""
    out = c
    for raw, ent in HTML_ESCAPES:
        out = F.replace(out, F.lit(ent), F.lit(raw))
    return out


def _char(code: Column) -> Column:
    """The character of a code point (0 to 10FFFF, no surrogate)."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _numeric_reference(digits: Column, base: int, longest: int) -> Column:
    """The text of a numeric reference with these digits, by the rules of the HTML standard for faulty ones."""
    bare = F.ltrim(digits, F.lit("0"))
    code = F.conv(F.concat(F.lit("0"), F.when(F.char_length(bare) <= longest, bare)), base, 10).cast("bigint")
    high = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")  # code points of the old Windows page
    beyond = F.coalesce(code, F.lit(0x110000)) >= 0x110000  # null: more digits than any code point has
    unseen = (code.between(1, 8) | (code == 0xB) | code.between(0xE, 0x1F) | (code == 0x7F)
              | code.between(0xFDD0, 0xFDEF) | (code % 0x10000 >= 0xFFFE))
    old = F.substring(F.lit(high), (code - 0x7F).cast("int"), F.lit(1))
    return (F.when(beyond | (code == 0) | code.between(0xD800, 0xDFFF), F.lit("\ufffd"))
            .when(code.between(0x80, 0x9F), F.when(old == "\ufffd", _char(code)).otherwise(old))
            .when(unseen, F.lit("")).otherwise(_char(code)))


def _names() -> Column:
    """Map from first letter to a map from name (with its semicolon, if any) to text: the HTML standard's list."""
    by_letter: dict[str, dict[str, str]] = {}
    for name, text in html5.items():
        by_letter.setdefault(name[0], {})[name] = text
    return F.from_json(F.lit(json.dumps(by_letter)), "map<string,map<string,string>>")  # folded once, when planned


def decode_references(c: Column) -> Column:
    """Every character reference of a text as the character it stands for, in one pass.

    Decimal and hexadecimal ones by code point, named ones by the standard's
    list, of which the older names also stand without their semicolon (the
    longest such name that the letters begin with); anything else stays.
    """
    names = _names()
    older = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))

    def piece(p: Column) -> Column:
        number = F.regexp_extract(p, "^&#(?:([0-9]+)|[xX]([0-9a-fA-F]+));?", 0)
        dec, hexa = F.regexp_extract(p, "^&#([0-9]+)", 1), F.regexp_extract(p, "^&#[xX]([0-9a-fA-F]+)", 1)
        name = F.regexp_extract(p, "^&([0-9A-Za-z]+;?)", 1)
        old = F.regexp_extract(p, f"^&({older})", 1)

        def text(n: Column) -> Column:
            return F.try_element_at(F.try_element_at(names, F.substring(n, 1, 1)), n)

        def rest(found: Column) -> Column:
            return F.substring(p, F.char_length(found) + 1, F.char_length(p))

        whole = F.when(name.endswith(";"), text(name))
        return (F.when(dec != "", F.concat(_numeric_reference(dec, 10, 7), rest(number)))
                .when(hexa != "", F.concat(_numeric_reference(hexa, 16, 6), rest(number)))
                .when(whole.isNotNull(), F.concat(whole, rest(F.concat(F.lit("&"), name))))
                .when(old != "", F.concat(text(old), rest(F.concat(F.lit("&"), old))))
                .otherwise(p))

    pieces = F.transform(F.split(c, "(?=&[#0-9A-Za-z])", -1), lambda p: F.when(p.startswith("&"), piece(p)).otherwise(p))
    return F.array_join(pieces, "")


def clean_cell(c: Column) -> Column:
    """STR4: export cleaning, in the reference's order.

    Drop script blocks, drop comments, drop tags, trim, newlines to spaces,
    decode character references as a browser does, and prefix a quote to cells that start like a formula.
    """
    # a script block runs to its first end tag; one without an end tag is only a tag
    for block in ("(?is)<script\\b.*?</script>", "<!--.*?-->", "<[^>]*>"):
        c = F.regexp_replace(c, block, "")
    s = c
    s = F.replace(js_trim(s), F.lit("\n"), F.lit(" "))
    return F.regexp_replace(decode_references(s), FORMULA_START, "'$0")


def remove_accent(c: Column) -> Column:
    """Typeahead accent removal: lower-case then the fixed one-to-one table."""
    return F.translate(F.lower(c), TYPEAHEAD_ACCENT_FROM, TYPEAHEAD_ACCENT_TO)


def slug(c: Column) -> Column:
    """STR5: lower-case, fold accents, keep a-z0-9, one dash for each run of anything else, none at the ends."""
    return F.btrim(F.regexp_replace(remove_accent(c), "[^a-z0-9]+", "-"), F.lit("-"))


def _spellings(letter: str) -> str:
    """Regex for a letter and every accented letter that the fixed table folds to it."""
    accented = "".join(f for f, t in zip(TYPEAHEAD_ACCENT_FROM, TYPEAHEAD_ACCENT_TO) if t == letter)
    return f"[{letter}{accented}]" if accented else re.escape(letter)


def highlight(c: Column, keys: list[str], accents: bool = False) -> Column:
    """STR6: wrap case-insensitive matches in <strong>, longest key first, not inside tags.

    With ``accents`` a key also matches accented spellings of its letters
    (the fixed accent table), and the original spelling is kept inside the tag.
    Tags are matched too and put back as they are, so nothing inside them
    is ever a match.
    """
    patterns = ["".join(map(_spellings, k.lower())) if accents else re.escape(k)
                for k in sorted(keys, key=len, reverse=True) if k.strip()]
    if not patterns:
        return c
    either = f"(?iu)(<[^<>]*>)|({'|'.join(patterns)})"
    marked = F.regexp_replace(c, either, "$1<strong>$2</strong>")
    # a tag leaves an empty mark behind it
    return F.replace(marked, F.lit("<strong></strong>"), F.lit(""))


def basename(c: Column) -> Column:
    """STR7: file name of a path."""
    return F.substring_index(c, "/", -1)


def strip_delim(c: Column, delim: str) -> Column:
    """STR7: drop every occurrence of the delimiter from a label."""
    return F.replace(c, F.lit(delim), F.lit(""))


def localized(cols: list[Column]) -> Column:
    """STR8: first non-empty translation in language order."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cols])

