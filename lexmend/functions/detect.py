"""Predicates and measures of damage, as built-in expressions. Null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmend import chars, patterns
from lexmend.functions.fixers import ColumnOrName, col


def is_ascii(c: ColumnOrName) -> Column:
    """Whether every character is one byte: told from two lengths, without a pattern."""
    text = col(c)
    return F.octet_length(text) == F.char_length(text)


def is_control_char(c: ColumnOrName) -> Column:
    """Whether the text is a single control character that texts should not hold."""
    return col(c).rlike(patterns.ONE_CONTROL)


def is_bad(c: ColumnOrName) -> Column:
    """Whether the text holds a sequence that intact text hardly has."""
    text = col(c)
    return ~is_ascii(text) & text.rlike(patterns.IS_BAD)


def may_be_bad(c: ColumnOrName) -> Column:
    """True of every text with a line that is bad on its own: a filter ahead of work line by line."""
    text = col(c)
    return ~is_ascii(text) & text.rlike(patterns.MAY_BE_BAD)


def badness(c: ColumnOrName) -> Column:
    """The number of such sequences, from left to right, without overlap."""
    text = col(c)
    return F.when(is_bad(text), F.regexp_count(text, F.lit(patterns.BADNESS))).when(text.isNotNull(), F.lit(0))


def possible_encoding(c: ColumnOrName, codec: str) -> Column:
    """Whether the text can have been decoded with the single-byte codec."""
    if codec == "ascii":
        return is_ascii(c)
    text = col(c)
    held = chars.repertoire(codec)
    fits = is_ascii(text) | ~text.rlike(patterns.outside(held))
    return fits if "\x1a" in held else fits & ~F.contains(text, F.lit("\x1a"))


def possible_encodings(c: ColumnOrName) -> Column:
    """The codecs, in order of trial, that the text can have been decoded with."""
    return F.array_compact(F.array(*[F.when(possible_encoding(c, x), F.lit(x)) for x in chars.CANDIDATES]))


def utf8_runs(c: ColumnOrName) -> Column:
    """Runs of characters that look like UTF-8 read with a single-byte codec."""
    return F.regexp_extract_all(col(c), F.lit(f"({patterns.UTF8_RUN})"), F.lit(1))
