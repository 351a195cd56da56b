"""Single-byte codecs and byte-level repairs, as built-in expressions.

Bytes are kept as a string of the characters U+0000 to U+00FF, one for each byte ("byte string"),
so that they can be matched with regular expressions; :func:`as_binary` makes real bytes of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmend import chars, patterns
from lexmend.functions.detect import possible_encoding
from lexmend.functions.fixers import ColumnOrName, bind, col

LATIN = "ISO-8859-1"


def as_binary(data: ColumnOrName) -> Column:
    """Binary of a byte string; null for a string that isn't one."""
    data = col(data)
    return F.encode(F.when(~data.rlike(r"[^\x00-\xFF]"), data), LATIN)


def as_byte_string(data: ColumnOrName) -> Column:
    return F.decode(col(data), LATIN)


def encode(c: ColumnOrName, codec: str) -> Column:
    """Byte string that the text was decoded from with the codec; null where that isn't possible."""
    text, table = col(c), chars.to_bytes_table(codec)
    data = F.translate(text, "".join(map(chr, table)), "".join(map(chr, table.values()))) if table else text
    return F.when(possible_encoding(text, codec), data)


def decode(data: ColumnOrName, codec: str) -> Column:
    """Text of a byte string."""
    table = {b: c for b, c in enumerate(chars.decoded(codec)) if ord(c) != b}
    return F.translate(col(data), "".join(map(chr, table)), "".join(table.values())) if table else col(data)


def decode_binary(data: ColumnOrName, codec: str) -> Column:
    """Text of a binary column."""
    return decode(as_byte_string(data), codec)


def restore_byte_a0(data: ColumnOrName) -> Column:
    """Puts back bytes A0 that turned into blanks inside UTF-8."""
    data = col(data)
    followers = "|".join(patterns.A_GRAVE_FOLLOWERS)
    # Every word that is looked at gets a mark in place of its first byte; the mark says what the byte becomes.
    marked = F.regexp_replace(data, patterns.A_GRAVE.replace(r"\xC3 [^ ]* ?", r"\xC3 ([^ ]* ?)"), "\ue000 $1")
    done = F.replace(F.regexp_replace(marked, f"\ue000 (?!{followers})", "\u00c3\u00a0 "), F.lit("\ue000"), F.lit("\u00c3"))
    spans = f"({patterns.ALTERED_UTF8})"
    mended = bind(
        done,
        lambda d: F.array_join(
            F.flatten(F.zip_with(F.split(d, patterns.ALTERED_UTF8), F.transform(F.regexp_extract_all(d, F.lit(spans), F.lit(1)), lambda m: F.translate(m, " ", "\u00a0")), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))),
            "",
        ),
    )
    return F.when(data.rlike(f"{patterns.ALTERED_UTF8}|{patterns.A_GRAVE}"), mended).otherwise(data)


def replace_lossy_sequences(data: ColumnOrName) -> Column:
    """UTF-8 with lost continuation bytes to the UTF-8 of U+FFFD."""
    return F.regexp_replace(col(data), patterns.LOSSY_UTF8, "\u00ef\u00bf\u00bd")


def decode_utf8(data: ColumnOrName) -> Column:
    """Text of a byte string in strict UTF-8, or null."""
    return F.try_validate_utf8(as_binary(data).cast("string"))


def decode_utf8_variants(data: ColumnOrName) -> Column:
    """Text of a byte string in UTF-8 that may hold Java's null and CESU-8 pairs, or null.

    Where a surrogate stands alone the result is null here; the kernel decides such rows.
    """
    data = col(data)
    pair = r"\xED([\xA0-\xAF][\x80-\xBF])\xED([\xB0-\xBF][\x80-\xBF])"

    def four(p: Column) -> Column:
        at = lambda i: F.conv(F.hex(F.encode(F.substring(p, i, 1), LATIN)), 16, 10).cast("int")
        code = F.lit(0x10000) + F.shiftleft(at(2).bitwiseAND(F.lit(0x0F)), 16) + F.shiftleft(at(3).bitwiseAND(F.lit(0x3F)), 10) + F.shiftleft(at(5).bitwiseAND(F.lit(0x0F)), 6) + at(6).bitwiseAND(F.lit(0x3F))
        six = lambda n, shift: F.hex(F.shiftright(n, shift).bitwiseAND(F.lit(0x3F)) + 0x80)
        return bind(code, lambda n: F.decode(F.unhex(F.concat(F.hex(F.shiftright(n, 18) + 0xF0), six(n, 12), six(n, 6), six(n, 0))), LATIN))

    whole = pair.replace("([", "(?:[")
    joined = bind(
        F.regexp_replace(data, r"\xC0\x80", "\x00"),
        lambda d: F.array_join(F.flatten(F.zip_with(F.split(d, whole), F.transform(F.regexp_extract_all(d, F.lit(f"({whole})"), F.lit(1)), four), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), ""),
    )
    return decode_utf8(F.when(data.rlike(r"[\xC0\xED]"), joined).otherwise(data))


def undo_layer(c: ColumnOrName, codec: str, restore_a0: bool = True, lossy: bool = True) -> Column:
    """The text read as UTF-8 from the bytes that the codec gives it, or null where that fails."""
    data = encode(c, codec)
    if restore_a0 and codec != "macroman":
        data = restore_byte_a0(data)
    if lossy and codec.startswith("sloppy"):
        data = replace_lossy_sequences(data)
    return decode_utf8_variants(data)


def undo_first_layer(c: ColumnOrName, restore_a0: bool = True, lossy: bool = True) -> Column:
    """:func:`undo_layer` with the first candidate codec that works, or null."""
    return F.coalesce(*[undo_layer(c, x, restore_a0, lossy) for x in chars.CANDIDATES])
