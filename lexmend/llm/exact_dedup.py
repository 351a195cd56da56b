"""Exact deduplication by a 128-bit content hash, with a byte comparison inside every hash group.

Rows are grouped by (hash, text): the hash settles nearly every comparison, and Spark's hash
aggregation compares the key bytes of what is left, so texts that merely share a hash stay apart.
Copies collapse inside each map task before the shuffle, which is why a text that makes up a
third of the corpus costs one row for each task and not one for each copy.

Defined cases: a null text equals the empty text. Null ids rank lowest. Rows that repeat both id
and text get one survivor among them. An empty table gives an empty result. Other columns, of
any name, are neither read by :func:`exact_groups` nor changed by :func:`drop_exact_copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row for each row of ``df``: id, keep_id, group_size, kept, text_sha256.

    ``keep`` names the id that stays, ``smallest`` or ``largest``.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    groups = (
        rows.withColumn("_hash", content_hash(F.col("_text")))
        .groupBy("_hash", "_text")
        .agg(best("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_hash", F.sha2(F.col("_text"), 256).alias("_sha"), "keep_id", "group_size")
    )
    # Equal ids of equal texts are told apart by number, so that one of them can stay.
    members = (
        rows.select("_id", content_hash(F.col("_text")).alias("_hash"), F.sha2(F.col("_text"), 256).alias("_sha"))
        .groupBy("_id", "_hash", "_sha")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return (
        members.join(groups, ["_hash", "_sha"])
        .select("_id", "keep_id", "group_size", "_sha", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy"))
        .select(
            F.col("_id").alias(id_col),
            "keep_id",
            "group_size",
            (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
            F.col("_sha").alias("text_sha256"),
        )
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns, in one shuffle and without a join."""
    best = {"smallest": F.min_by, "largest": F.max_by}[keep]
    names = [f"_c{i}" for i in range(len(df.columns))]
    at = dict(zip(df.columns, names, strict=True))
    text = F.coalesce(F.col(at[text_col]), F.lit(""))
    rest = [n for n in names if n != at[text_col]]
    flat = df.toDF(*names)
    # A null id ranks below every other one for either choice of ``keep``.
    blank = F.col(at[id_col]).isNull()
    rank = F.struct(blank if keep == "smallest" else ~blank, F.col(at[id_col]), F.col(at[text_col]).isNull())
    return (
        flat.select(content_hash(text).alias("_hash"), text.alias("_text"), rank.alias("_rank"), F.struct(F.col(at[text_col]).isNull().alias("_null"), *rest).alias("_row"))
        .groupBy("_hash", "_text")
        .agg(best("_row", "_rank").alias("_row"))
        .select(*[(F.when(~F.col("_row._null"), F.col("_text")) if n == at[text_col] else F.col(f"_row.{n}")).alias(c) for c, n in at.items()])
    )
