"""Packing into length buckets whose boundaries minimise padding.

A document longer than ``max_length`` is cut into pieces of that length, so that no part of a text
is lost. A dynamic program over the histogram of all piece lengths (at most ``max_length`` numbers,
whatever the corpus) chooses ``n_buckets`` boundaries so that padding every piece to its bucket's
boundary wastes the fewest tokens. Inside a bucket, pieces in a hashed order fill batches of
``token_budget`` tokens, padding included.

Places inside a bucket come from counts of hash ranges plus a place inside the range, so a bucket
with a third of all pieces is never ordered in one task, and all batches but a bucket's last are full.

Every row has a hash of its own, so rows that share an id, or have none, are spread like others:
it is taken from ``row_col``, a number that tells rows apart (see ``common.row_keyed``), or where that
isn't given from the place of the row in the frame.

Defined cases: a document without tokens, or whose length is null, makes no piece and no row. A
document of any length is cut into pieces, none is lost. Pieces with the same hash are ordered by id
(null first), number, then length. Empty tables give empty results. Columns other than those
named are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmend.llm.common import as_text, staged

#: Pieces that one range of a bucket holds on average.
RANGE_ROWS = 20_000


def choose_boundaries(histogram: dict[int, int], n_buckets: int) -> list[int]:
    """Bucket boundaries (lengths, ascending) of least total padding; the last is the longest length."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.float64)
    below = np.concatenate(([0.0], np.cumsum(counts)))
    mass = np.concatenate(([0.0], np.cumsum(counts * lengths)))
    n, k = len(lengths), min(n_buckets, len(lengths))
    # cost[j]: least padding of the first j lengths with the buckets so far.
    cost = np.concatenate(([0.0], np.full(n, np.inf)))
    back = np.zeros((k, n + 1), dtype=np.int64)
    for b in range(k):
        new = np.full(n + 1, np.inf)
        for j in range(b + 1, n + 1):
            waste = cost[:j] + lengths[j - 1] * (below[j] - below[:j]) - (mass[j] - mass[:j])
            back[b, j] = int(np.argmin(waste))
            new[j] = waste[back[b, j]]
        cost = new
    out, j = [], n
    for b in range(k - 1, -1, -1):
        out.append(int(lengths[j - 1]))
        j = int(back[b, j])
    return out[::-1]


def pieces(df: DataFrame, id_col: str, length: Column, max_length: int, row: Column) -> DataFrame:
    """id, row, piece, start, length: every document in pieces of at most ``max_length``."""
    whole = F.ceil(F.col("total") / max_length).cast("int")
    number = F.explode(F.when(F.col("total") > 0, F.sequence(F.lit(0), whole - 1)))
    return (
        df.select(F.col(id_col).alias("id"), row.cast("long").alias("row"), length.cast("long").alias("total"))
        .select("id", "row", "total", number.alias("piece"))
        .select("id", "row", "piece", (F.col("piece").cast("long") * max_length).alias("start"), F.least(F.lit(max_length).cast("long"), F.col("total") - F.col("piece").cast("long") * max_length).cast("int").alias("length"))
    )


def pack(df: DataFrame, length: Column, id_col: str = "doc_id", row_col: str | None = None, max_length: int = 2048, n_buckets: int = 16, token_budget: int = 65_536, seed: int = 11) -> DataFrame:
    """One row for each piece: id, piece, start, length, bucket (padded length), batch (number inside the bucket), slot.

    ``length`` is a document's number of tokens, such as :func:`lexmend.llm.tokens.token_counts` gives.
    """
    if token_budget < max_length:
        raise ValueError("token_budget must hold a piece of max_length")
    spread = F.xxhash64(as_text(F.col("id")), F.col("row"), F.col("piece"), F.lit(seed))
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    cut = staged(pieces(df, id_col, length, max_length, row).select("id", "piece", "start", "length", spread.alias("h")), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most max_length rows
    ends = choose_boundaries(histogram, n_buckets)
    bucket, ranges = F.lit(max_length), F.lit(1).cast("long")
    for end in reversed(ends):
        size = sum(n for x, n in histogram.items() if x <= end) - sum(n for x, n in histogram.items() if any(x <= e for e in ends if e < end))
        bucket = F.when(F.col("length") <= end, F.lit(end)).otherwise(bucket)
        ranges = F.when(F.col("length") <= end, F.lit(-(-size // RANGE_ROWS))).otherwise(ranges)
    # The hash as a fraction picks the range, so ranges are in the order of the hash.
    part = F.least(F.floor((F.col("h") / float(1 << 64) + 0.5) * ranges), ranges - 1)
    dealt = cut.select("*", bucket.cast("int").alias("bucket"), part.alias("part"))
    counts = dealt.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.select(F.col("bucket").alias("_b"), F.col("part").alias("_p"), F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    ahead = staged(ahead, "pack-ranges")
    place = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("h", F.col("id").asc_nulls_first(), "piece", "start", "length")) - 1
    held = F.floor(F.lit(token_budget) / F.col("bucket"))
    return (
        dealt.withColumn("place", place)
        .join(ahead, (F.col("bucket") == F.col("_b")) & (F.col("part") == F.col("_p")))
        .withColumn("at", F.col("place") + F.col("ahead"))
        .select(F.col("id").alias(id_col), "piece", "start", "length", "bucket", F.floor(F.col("at") / held).cast("long").alias("batch"), F.pmod("at", held).cast("int").alias("slot"))
    )
