"""The fixers as column functions: built-in expressions only. Null stays null."""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmend import chars, patterns
from lexmend.config import NORMAL_FORMS

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _mapped(text: Column, table: dict[str, str]) -> Column:
    """``translate`` behind a test, which is cheaper where nothing is to be replaced."""
    keys = "".join(table)
    return F.when(text.rlike(patterns.char_class(keys)), F.translate(text, keys, "".join(table.values()))).otherwise(text)


def fix_c1_controls(c: ColumnOrName) -> Column:
    """C1 control characters to the characters of windows-1252."""
    return _mapped(col(c), chars.C1)


def fix_latin_ligatures(c: ColumnOrName) -> Column:
    """Latin ligatures and digraphs to their letters."""
    text = col(c)
    fixed = text
    for char, letters in chars.LIGATURES.items():
        fixed = F.replace(fixed, F.lit(char), F.lit(letters))
    return F.when(text.rlike(patterns.char_class("".join(chars.LIGATURES))), fixed).otherwise(text)


def fix_character_width(c: ColumnOrName) -> Column:
    """Full-width and half-width characters to their usual form."""
    return _mapped(col(c), chars.WIDTHS)


def uncurl_quotes(c: ColumnOrName) -> Column:
    """Curly quotation marks to straight ones."""
    return _mapped(col(c), dict.fromkeys(chars.DOUBLE_QUOTES, '"') | dict.fromkeys(chars.SINGLE_QUOTES, "'"))


def fix_line_breaks(c: ColumnOrName) -> Column:
    """All kinds of line breaks to a line feed."""
    return F.regexp_replace(col(c), chars.LINE_BREAKS, "\n")


def remove_terminal_escapes(c: ColumnOrName) -> Column:
    """Removes terminal escape sequences such as colours."""
    text = col(c)
    return F.when(F.contains(text, F.lit("\x1b[")), F.regexp_replace(text, patterns.TERMINAL_ESCAPE, "")).otherwise(text)


def remove_control_chars(c: ColumnOrName) -> Column:
    """Removes control characters that a text should not hold."""
    return F.regexp_replace(col(c), chars.CONTROL_CLASS, "")


@cache
def unsettled(form: str) -> frozenset[int]:
    """Code points whose presence can make a text differ from its normal form."""
    out = set()
    for code in range(0x80, 0x110000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        if unicodedata.combining(char) or unicodedata.normalize(form, char) != char:
            out.add(code)
        parts = unicodedata.decomposition(char).split()
        # The second half of a pair that composes.
        if form in ("NFC", "NFKC") and len(parts) == 2 and not parts[0].startswith("<"):
            out.add(int(parts[1], 16))
    if form in ("NFC", "NFKC"):
        out.update(range(0x1161, 0x1176))
        out.update(range(0x11A8, 0x11C3))
    return frozenset(out)


@cache
def unassigned() -> tuple[str, str]:
    """A pattern, fast to fail, and a class of the characters that Python's version of Unicode doesn't know. The normaliser of the JVM may know them; both sides leave them alone."""
    codes = {c for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Cn"}
    return patterns.beyond_ascii(codes), patterns.one_of(codes, 1 << 20)


def normalize(c: ColumnOrName, form: str = "NFC") -> Column:
    """The text in a Unicode normal form; only texts with a character that matters are passed to the normaliser."""
    if form not in NORMAL_FORMS:
        raise ValueError(f"form must be one of {', '.join(NORMAL_FORMS)}, not {form!r}")
    text = col(c)
    way = "compose" if form in ("NFC", "NFKC") else "decompose"
    matters = (F.octet_length(text) != F.char_length(text)) & text.rlike(patterns.beyond_ascii(unsettled(form)))
    done = lambda x: F.try_reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(way), x, F.lit(form in ("NFKC", "NFKD")))
    some, new = unassigned()
    # Nothing composes across such a character, so what lies between them can be normalised apart.
    parts = F.regexp_extract_all(text, F.lit(f"({new}+|[^{new[1:]}+)"), F.lit(1))
    apart = F.array_join(F.transform(parts, lambda x: F.when(x.rlike(some), x).otherwise(done(x))), "")
    return F.when(matters, F.when(text.rlike(some), apart).otherwise(done(F.when(matters, text)))).otherwise(text)


@cache
def _entity_table() -> str:
    """Entities by length and first letter, as JSON: maps of Spark are searched from end to end, so each is kept small."""
    table: dict[str, dict[str, str]] = {}
    for name, value in chars.entities().items():
        table.setdefault(f"{name[1]}{len(name)}", {})[name] = value
    return json.dumps(table)


def unescape_html(c: ColumnOrName) -> Column:
    """Character references that end in a semicolon, and all-caps forms of names, to their characters."""
    text = col(c)
    table = F.from_json(F.lit(_entity_table()), "map<string,map<string,string>>")

    def number(e: Column) -> Column:
        hexadecimal = F.substring(e, 3, 1).isin("x", "X")
        digits = F.regexp_extract(e, r"^&#(?:[xX]0*([0-9a-fA-F]{1,6})|0*([0-9]{1,7}));$", 1)
        decimal = F.regexp_extract(e, r"^&#(?:[xX]0*([0-9a-fA-F]{1,6})|0*([0-9]{1,7}));$", 2)
        valid = e.rlike(r"^&#(?:[xX][0-9a-fA-F]+|[0-9]+);$")
        code = F.when(hexadecimal, F.conv(F.when(digits != "", digits), 16, 10)).otherwise(F.when(decimal != "", decimal)).cast("int")

        def char(n: Column) -> Column:
            wrong = n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
            # Built from its UTF-8 bytes: char() knows Latin-1 alone.
            six = lambda shift: F.shiftright(n, shift).bitwiseAND(F.lit(0x3F)) + 0x80
            data = (
                F.when(n < 0x80, F.hex(n))
                .when(n < 0x800, F.concat(F.hex(F.shiftright(n, 6) + 0xC0), F.hex(six(0))))
                .when(n < 0x10000, F.concat(F.hex(F.shiftright(n, 12) + 0xE0), F.hex(six(6)), F.hex(six(0))))
                .otherwise(F.concat(F.hex(F.shiftright(n, 18) + 0xF0), F.hex(six(12)), F.hex(six(6)), F.hex(six(0))))
            )
            one = F.decode(F.unhex(F.when(F.length(data) % 2 == 1, F.concat(F.lit("0"), data)).otherwise(data)), "UTF-8")
            return F.when(wrong, F.lit(chars.REPLACEMENT)).otherwise(fix_c1_controls(one))

        return F.when(valid, bind(code, lambda n: F.when(n == 0x3B, e).otherwise(char(n)))).otherwise(e)

    def named(e: Column) -> Column:
        own = F.try_element_at(table, F.concat(F.substring(e, 2, 1), F.length(e).cast("string")))
        return F.coalesce(F.try_element_at(own, e), e)

    found = F.regexp_extract_all(text, F.lit(f"({chars.ENTITY})"), F.lit(1))
    done = F.transform(found, lambda e: F.when(F.startswith(e, F.lit("&#")), number(e)).otherwise(named(e)))
    between = F.split(text, chars.ENTITY)
    joined = F.array_join(F.flatten(F.zip_with(between, done, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return F.when(text.rlike(chars.ENTITY), joined).otherwise(text)
