"""Segments: lines with their line feeds, cut where they are too long."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmend import kernel
from lexmend.config import DEFAULT
from lexmend.functions.batches import by_text
from lexmend.functions.fixers import ColumnOrName, bind, col


def lines(c: ColumnOrName) -> Column:
    """The lines of a text, each with its line feed; they join to the text again."""
    return F.array_remove(F.split(col(c), r"(?<=\n)"), "")


def segments(c: ColumnOrName, max_decode_length: int = DEFAULT.max_decode_length) -> Column:
    """The segments of a text. Only texts with a line of more bytes than allowed leave the JVM."""
    text = col(c)
    long = (F.octet_length(text) > max_decode_length) & F.exists(lines(text), lambda x: F.octet_length(x) > max_decode_length)

    cut = by_text(lambda t: kernel.segments(t, max_decode_length), "array<string>", pa.list_(pa.string()))
    return F.coalesce(cut(F.when(long, text)), lines(text))


def before_angle(c: ColumnOrName) -> Column:
    """The lines ahead of the first one with a ``<``: those in which "auto" decodes entities."""
    text = col(c)
    head = F.substring_index(text, "<", 1)
    rest = F.substring_index(head, "\n", -1)
    return F.when(F.contains(text, F.lit("<")), F.substring(head, F.lit(1), F.length(head) - F.length(rest))).otherwise(text)


def sticky_angle(c: ColumnOrName) -> Column:
    """For every line whether "auto" still decodes entities in it: not from the first ``<`` on."""
    text = col(c)
    head = F.substring_index(text, "<", 1)
    ahead = F.when(F.contains(text, F.lit("<")), F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))).otherwise(F.length(text))
    # The number of the first line with one is found once for the text.
    return bind(ahead, lambda n: F.transform(lines(text), lambda x, i: i < n))
