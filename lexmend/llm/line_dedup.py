"""Line deduplication over content-defined chunks of lines.

Each line is hashed; a rolling hash over the hashes of the last ``WINDOW`` lines ends a chunk
unless it is 0 modulo ``JOINED``. Boundaries depend on the lines around them alone, with nothing
carried over from the boundary before, so a block of lines that moved, or that has lines added
before it, falls into the same chunks again; and they are close, so that a short block holds a
whole chunk. Chunks are grouped by (hash, text): that compares their bytes, and collapses copies
inside each map task. A chunk that occurs earlier in the corpus (by id, then place) is a match,
which grows by the lines before and behind it that both places share, up to ``REACH`` lines on
either side. So neighbouring chunks of one repeated block join. Matches of two lines or more that
aren't blank are removed; a single repeated line stays.

Every removed line has an equal one at an earlier place, so one copy of everything stays.

Defined cases: null texts stay null, texts without a repeated block stay as they are, an emptied
text is empty. Null ids come last in the order of the corpus. Rows that repeat id and text are
told apart by a row key: the first keeps what is new in it, the others are repeated blocks from
end to end. Texts of one id are told apart by 128 bits. A very long text is held by one task, in
full. Ties can't occur: a place is unique. Empty tables give empty results; other columns, of any
name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmend.llm.arrow import slices
from lexmend.llm.common import drop_staged, marked_rows, place, repeated_rows, staged

#: Lines that decide whether a boundary follows, one in how many is none, and the most lines of a chunk.
WINDOW, JOINED, MOST = 2, 8, 64
#: Lines by which a match can grow on either side of a chunk.
REACH = 3
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def line_hashes(lines: list[str]) -> list[int]:
    """A hash of every line, 0 for blank ones."""
    return [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) if x and not x.isspace() else 0 for x in lines]


def boundaries(hashes: list[int]) -> list[int]:
    """Ends of the chunks (exclusive); the last is the number of lines."""
    drop = pow(BASE, WINDOW, 1 << 64)
    ends, rolling, start = [], 0, 0
    for i, h in enumerate(hashes):
        rolling = (rolling * BASE + h + 1) & MASK
        if i >= WINDOW:
            rolling = (rolling - (hashes[i - WINDOW] + 1) * drop) & MASK
        mixed = (rolling ^ (rolling >> 33)) * BASE & MASK
        if (mixed >> 40) % JOINED or i + 1 - start >= MOST or i + 1 == len(hashes):
            ends.append(i + 1)
            start = i + 1
    return ends


def chunks(text: str | None) -> list[tuple[int, int, int, list[int], list[int], str]]:
    """First line, end, lines that aren't blank, hashes of the lines before (nearest first) and behind, and text of every chunk that isn't blank."""
    if not text:
        return []
    lines = text.split("\n")
    hashes = line_hashes(lines)
    signed = np.array(hashes, dtype=np.uint64).view(np.int64).tolist()
    out, start = [], 0
    for end in boundaries(hashes):
        full = sum(1 for h in hashes[start:end] if h)
        if full:
            out.append((start, end, full, signed[max(start - REACH, 0) : start][::-1], signed[end : end + REACH], "\n".join(lines[start:end])))
        start = end
    return out


def chunk_rows(rows: DataFrame) -> DataFrame:
    """One row for each chunk of ``rows`` (id, r1, r2, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, found = [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                own = chunks(text)
                at += [i] * len(own)
                found += own
            pick = pa.array(at, pa.int64())
            start, stop, full, before, behind, body = (list(x) for x in zip(*found, strict=True)) if found else ([],) * 6
            data = [x.encode("utf-8", "surrogatepass") for x in body]
            check = np.array([xxhash.xxh64_intdigest(x, 7) for x in data], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(pick) for c in range(3)],
                    *[pa.array(x, pa.int32()) for x in (start, stop, full)],
                    *[pa.array(x, pa.list_(pa.int64())) for x in (before, behind)],
                    pa.array([blake2b(x, digest_size=16).digest() for x in data], pa.binary()),
                    pa.array(check),
                    pa.array(body, pa.string()),
                ],
                names=["id", "r1", "r2", "start", "stop", "full", "before", "behind", "hash", "check", "body"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "r1", "r2", "text").mapInArrow(each, f"id {kind}, r1 long, r2 long, start int, stop int, full int, before array<long>, behind array<long>, hash binary, check long, body string")


def _shared(a: Column, b: Column, count) -> Column:
    """Sum of ``count`` over the elements of ``a`` up to the first that differs from that of ``b``."""
    out = F.lit(0)
    for i in range(REACH - 1, -1, -1):
        out = F.when(F.get(a, F.lit(i)) == F.get(b, F.lit(i)), count(F.get(a, F.lit(i))) + out).otherwise(F.lit(0))
    return out


def removed_lines(rows: DataFrame) -> DataFrame:
    """r1, r2 and ``cut``, the line ranges (start, stop) to remove, sorted, for rows (id, r1, r2, text) with any."""
    found = chunk_rows(rows)
    # The text is shuffled once, for the comparison; what follows moves hashes and places only.
    groups = (
        found.groupBy("hash", "check", "body")
        .agg(F.count(F.lit(1)).alias("n"), F.min(place("r1", "r2", "start", "before", "behind")).alias("first"))
        .filter("n > 1")
        .select(F.col("hash").alias("g"), F.col("check").alias("g_check"), "first")
    )
    groups = staged(groups, "line-groups")
    # Two hashes of a text, 192 bits together, tell its group.
    again = found.drop("body").join(groups, (F.col("hash") == F.col("g")) & (F.col("check") == F.col("g_check")))
    again = again.filter(~place("r1", "r2", "start").eqNullSafe(F.struct("first.last", "first.id", "first.r1", "first.r2", "first.start")))
    one, solid = lambda x: F.lit(1), lambda x: (x != 0).cast("int")
    grown = lambda count: (_shared(F.col("before"), F.col("first.before"), count), _shared(F.col("behind"), F.col("first.behind"), count))
    (up, down), (full_up, full_down) = grown(one), grown(solid)
    again = again.filter(F.col("full") + full_up + full_down >= 2).select("r1", "r2", (F.col("start") - up).alias("start"), (F.col("stop") + down).alias("stop"))
    cut = staged(again.groupBy("r1", "r2").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("cut")), "line-cuts")
    drop_staged(groups)
    return cut


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, text without its repeated blocks, n_lines, removed_lines, removed."""
    rows = marked_rows(df, id_col, text_col)
    joined = repeated_rows(rows, removed_lines(rows), "line-marks")
    kind = rows.schema["id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, totals, counts, places = [], [], [], []
            for text, held, copy in zip(*(batch.column(c) for c in (1, 2, 3)), strict=True):
                text, held = text.as_py(), held.as_py() or []
                cut = whole(text) if copy.as_py() else [(c["start"], c["stop"]) for c in held]
                kept, total, gone = without(text, cut)
                texts.append(kept)
                totals.append(total)
                counts.append(sum(b - a for a, b in gone))
                places.append([{"start": a, "stop": b} for a, b in gone])
            kinds = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(counts, pa.int64()), pa.array(places, kinds)], names=["id", "text", "n_lines", "removed_lines", "removed"])

    out = joined.mapInArrow(each, f"id {kind}, text string, n_lines long, removed_lines long, removed array<struct<start:int,stop:int>>")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_lines", "removed_lines", "removed")


def whole(text: str | None) -> list[tuple[int, int]]:
    """The cut of a row that repeats another one: all lines, if two of them aren't blank."""
    lines = (text or "").split("\n")
    return [(0, len(lines))] if sum(1 for x in lines if x and not x.isspace()) > 1 else []


def without(text: str | None, cut: list[tuple[int, int]]) -> tuple[str | None, int, list[tuple[int, int]]]:
    """The text without the line ranges of ``cut`` (sorted), its number of lines, and the ranges joined."""
    if text is None:
        return None, 0, []
    if not cut:
        return text, text.count("\n") + 1, []
    gone: list[tuple[int, int]] = []
    for a, b in cut:
        if gone and a <= gone[-1][1]:
            gone[-1] = (gone[-1][0], max(b, gone[-1][1]))
        else:
            gone.append((a, b))
    lines, out, at = text.split("\n"), [], 0
    for a, b in gone:
        out += lines[at:a]
        at = b
    return "\n".join(out + lines[at:]), len(lines), gone
