"""Damage put into intact texts, the same on every run: what the queries repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmend.functions import codecs


def layer(text: Column, codec: str) -> Column:
    """The text's UTF-8 read with a single-byte codec."""
    return codecs.decode_binary(F.encode(text, "UTF-8"), codec)


def substitute(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def curly(text: Column) -> Column:
    """Blanks before ``t`` get quotation marks."""
    return F.replace(F.replace(text, F.lit(" t"), F.lit(" ‘t’")), F.lit(" a"), F.lit(" “a”"))

