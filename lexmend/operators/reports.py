"""Reports on damage in a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmend.functions import detect, pieces


def segment_rows(df: DataFrame, id_col: str, column: str = "text") -> DataFrame:
    """One row for each segment of a text: id, pos, segment."""
    return df.select(id_col, F.posexplode(pieces.segments(column)).alias("pos", "segment"))


def bad_lines(df: DataFrame, id_col: str, column: str = "text") -> DataFrame:
    """The lines that are bad on their own: id, pos, segment, badness."""
    # Texts without a bad line are left out before lines are made.
    found = segment_rows(df.filter(detect.may_be_bad(column)), id_col, column)
    return found.filter(detect.is_bad("segment")).withColumn("badness", detect.badness("segment"))


def badness_by(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Texts, bad texts and total badness of every key."""
    scored = df.select(key, detect.badness(column).cast("long").alias("b"))
    return scored.groupBy(key).agg(F.count(F.lit(1)).alias("texts"), F.sum(F.when(F.col("b") > 0, 1).otherwise(0)).cast("long").alias("bad_texts"), F.sum("b").alias("badness"))


def worst(df: DataFrame, id_col: str, column: str = "text", k: int = 20) -> DataFrame:
    """The ``k`` texts with the most damage; ties by id."""
    return df.select(id_col, detect.badness(column).cast("long").alias("badness")).orderBy(F.desc("badness"), id_col).limit(k)


def encodings(df: DataFrame, column: str = "text") -> DataFrame:
    """How many texts each candidate codec could have produced."""
    return df.select(F.explode(detect.possible_encodings(column)).alias("codec")).groupBy("codec").agg(F.count(F.lit(1)).alias("texts"))
