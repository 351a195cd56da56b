"""The whole repair as column functions.

:func:`untouched` is a cheap test of built-in expressions that is true only of texts that no fixer
can change: of ASCII texts without control characters and the like. All other texts go to the
kernel, null-masked. Patterns over texts beyond ASCII take Java longer than the whole repair takes
the kernel, so there is no test of these ahead of it.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmend import chars, kernel, patterns
from lexmend.config import DEFAULT, TextFixerConfig
from lexmend.functions import detect
from lexmend.functions.batches import by_text
from lexmend.functions.fixers import ColumnOrName, col
from lexmend.functions.pieces import before_angle

EXPLAINED = "struct<text:string,steps:array<struct<transformation:string>>>"


@cache
def _touching(config: TextFixerConfig) -> str | None:
    """Pattern of the ASCII characters that some fixer changes wherever they stand."""
    held: set[int] = set()
    if config.fix_line_breaks:
        held.add(ord("\r"))
    if config.remove_control_chars:
        held.update(x for a, b in chars.CONTROLS for x in range(a, b + 1) if x < 0x80)
    return patterns.char_set(held) if held else None


def entity_part(c: ColumnOrName, config: TextFixerConfig, whole: bool) -> Column | None:
    """The part of a text in which entities are decoded; ``whole``: as one segment."""
    text = col(c)
    if config.unescape_html == "auto":
        return F.when(~F.contains(text, F.lit("<")), text).otherwise(F.lit("")) if whole else before_angle(text)
    return text if config.unescape_html else None


def untouched(c: ColumnOrName, config: TextFixerConfig = DEFAULT, whole: bool = False) -> Column:
    """True only if no fixer changes the text and it records no step: of ASCII texts without what is changed there."""
    text = col(c)
    ok = detect.is_ascii(text)
    if (part := entity_part(text, config, whole)) is not None:
        ok = ok & (~F.contains(text, F.lit("&")) | ~part.rlike(chars.ENTITY))
    if config.remove_terminal_escapes and not config.remove_control_chars:
        ok = ok & ~F.contains(text, F.lit("\x1b["))
    if (plain := _touching(config)) is not None:
        ok = ok & ~text.rlike(plain)
    return ok


def kernel_text(c: ColumnOrName, config: TextFixerConfig = DEFAULT) -> Column:
    """The exact repair in Python; null for null, so that rows can be masked."""

    return by_text(lambda t: kernel.fix_text_safely(t, config))(col(c))


def fix_text(c: ColumnOrName, config: TextFixerConfig = DEFAULT) -> Column:
    """The repaired text, segment by segment."""
    text = col(c)
    return F.coalesce(kernel_text(F.when(~untouched(text, config), text), config), text)


def fix_encoding(c: ColumnOrName, config: TextFixerConfig = DEFAULT) -> Column:
    """Only layers of wrong decoding taken off, segment by segment."""
    return fix_text(c, config.but(unescape_html=False, remove_terminal_escapes=False, fix_latin_ligatures=False, fix_character_width=False, uncurl_quotes=False, fix_line_breaks=False, remove_control_chars=False, normalization=None))


def decode_inconsistent_utf8(c: ColumnOrName) -> Column:
    """Repairs what looks like UTF-8 inside texts that are not all of that kind; only texts with a bad run leave the JVM."""
    text = col(c)
    some = F.exists(detect.utf8_runs(text), lambda x: detect.is_bad(x) & (F.length(x) < F.length(text)))

    return F.coalesce(by_text(kernel.decode_inconsistent_utf8)(F.when(text.rlike(patterns.UTF8_RUN) & some, text)), text)


def explained(config: TextFixerConfig):
    """The function behind :func:`fix_and_explain`; null for null."""

    def one(text: str) -> dict:
        fixed, steps = kernel.fix_and_explain_safely(text, config)
        return {"text": fixed, "steps": None if steps is None else [{"transformation": x} for x in steps]}

    return by_text(one, EXPLAINED, pa.struct([("text", pa.string()), ("steps", pa.list_(pa.struct([("transformation", pa.string())])))]))


def fix_and_explain(c: ColumnOrName, config: TextFixerConfig = DEFAULT) -> Column:
    """The text repaired as one segment and the steps taken: struct<text, steps>; steps are null if ``config.explain`` is off."""
    text = col(c)

    made = explained(config)(F.when(~untouched(text, config, whole=True), text))
    none = F.array().cast("array<struct<transformation:string>>") if config.explain else F.lit(None).cast("array<struct<transformation:string>>")
    plain = F.struct(text.alias("text"), none.alias("steps"))
    return F.when(text.isNull(), F.lit(None).cast(EXPLAINED)).when(made["text"].isNotNull(), made).otherwise(plain)
