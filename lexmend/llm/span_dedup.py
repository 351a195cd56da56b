"""Substring deduplication over sliding runs of sentences.

At every sentence starts a run: the shortest sequence of several sentences from there on
(``LEAST_SENTENCES``) with at least ``LEAST_WORDS`` words. Likewise a run ends at every sentence.
A longer run repeats only if the runs in it do, and is covered by them, so no others need to be
hashed. What a run holds depends on nothing outside it: a passage that two documents share gives
the same runs in both, wherever it stands, and they cover it from its first whole sentence to its
last. Runs are hashed (128 bits, words lower-cased and joined by blanks) and joined on the hash
over the whole corpus; the first occurrence, by id and place, stays, and every sentence covered by
another occurrence is removed.

The least number of words keeps pairs of very short sentences, which repeat by chance, from cutting
documents that share nothing; the README has the measured share of such documents.

The shuffle carries hashes and places, no text. Occurrences of a hash are counted by partial
aggregation and never gathered, so a passage in a third of all documents is one row for each task.

Defined cases: null texts stay null; texts without a repeated run stay as they are. Null ids come
last. Rows that repeat id and text are told apart by a row key: in all but the first every run is
a repetition. Texts of one id are told apart by 128 bits. Sentences are found in time linear in
the text; a very long text is held by one task, in full. Ties can't occur: a place is unique. Empty
tables give empty results; other columns, of any name, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmend.llm.arrow import slices
from lexmend.llm.common import drop_staged, marked_rows, place, repeated_rows, staged

LEAST_SENTENCES, LEAST_WORDS = 2, 12
#: The end of a sentence with the white space behind it: end marks before white space, or a line end. A run of marks is tried at its start alone.
SENTENCE_END = re.compile(r"(?<![.!?])[.!?]++[\"')\]]*+(?=\s|\Z)\s*+|\n\s*+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Places (start, stop) that tile the text from its first sentence on; white space belongs to the sentence before it."""
    at, out = len(text) - len(text.lstrip()), []
    for m in SENTENCE_END.finditer(text, at):
        out.append((at, m.end()))
        at = m.end()
    return [*out, (at, len(text))] if at < len(text) else out


def extents(counts: list[int]) -> set[tuple[int, int]]:
    """(first sentence, end) of the shortest run from every sentence on, and of the shortest up to every sentence."""
    out, end, held = set(), 0, 0
    for i in range(len(counts)):
        while end < len(counts) and not _full(end - i, held):
            held += counts[end]
            end += 1
        if not _full(end - i, held):
            break
        out.add((i, end))
        held -= counts[i]
    start, held = 0, 0
    for j in range(1, len(counts) + 1):
        held += counts[j - 1]
        while _full(j - start - 1, held - counts[start]):
            held -= counts[start]
            start += 1
        if _full(j - start, held):
            out.add((start, j))
    return out


def _full(n: int, words: int) -> bool:
    return n >= LEAST_SENTENCES and words >= LEAST_WORDS


def runs(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, bytes]]:
    """(first sentence, end, hash) of every run of the text."""
    bodies = [text[a:b].lower().split() for a, b in spans]
    parts = [" ".join(b) for b in bodies]
    return [(a, b, blake2b(" ".join(parts[a:b]).encode("utf-8", "surrogatepass"), digest_size=16).digest()) for a, b in sorted(extents([len(b) for b in bodies]))]


def run_rows(rows: DataFrame) -> DataFrame:
    """One row for each run of ``rows`` (id, r1, r2, text): id, r1, r2, start, stop, hash."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, start, stop, digest = [], [], [], []
            for i, text in enumerate(batch.column(3)):
                text = text.as_py() or ""
                for a, b, h in runs(text, sentences(text)):
                    at.append(i)
                    start.append(a)
                    stop.append(b)
                    digest.append(h)
            pick = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pick) for c in range(3)], pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(digest, pa.binary())], names=["id", "r1", "r2", "start", "stop", "hash"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "r1", "r2", "text").mapInArrow(each, f"id {kind}, r1 long, r2 long, start int, stop int, hash binary")


def repeated_runs(rows: DataFrame) -> DataFrame:
    """r1, r2 and ``cut``, the sentence ranges (start, stop) of non-first runs, for rows (id, r1, r2, text) with any."""
    found = staged(run_rows(rows), "runs")
    firsts = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(place("r1", "r2", "start")).alias("first")).filter("n > 1").select(F.col("hash").alias("g"), "first")
    # As a table of its own, it leaves the join free to split a hash with very many runs over tasks.
    firsts = staged(firsts, "run-firsts")
    again = found.join(firsts, F.col("hash") == F.col("g")).filter(~place("r1", "r2", "start").eqNullSafe(F.col("first")))
    cut = staged(again.groupBy("r1", "r2").agg(F.collect_set(F.struct("start", "stop")).alias("cut")), "run-cuts")
    drop_staged(found)
    drop_staged(firsts)
    return cut


def without(text: str, cut: list[tuple[int, int]]) -> tuple[str, int, list[tuple[int, int]]]:
    """The text without the sentences of ``cut``, their number, and the removed character ranges."""
    spans = sentences(text)
    gone = np.zeros(len(spans) + 1, np.int64)
    for a, b in cut:
        gone[a] += 1
        gone[b] -= 1
    hit = np.cumsum(gone)[:-1] > 0
    ranges: list[list[int]] = []
    for (a, b), h in zip(spans, hit.tolist(), strict=True):
        if h and ranges and ranges[-1][1] == a:
            ranges[-1][1] = b
        elif h:
            ranges.append([a, b])
    out, at = [], 0
    for a, b in ranges:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]]), int(hit.sum()), [(a, b) for a, b in ranges]


def whole(text: str | None) -> list[tuple[int, int]]:
    """The cut of a row that repeats another one: all its runs."""
    return sorted(extents([len(text[a:b].split()) for a, b in sentences(text)])) if text else []


def drop_repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, text without repeated passages, n_sentences, removed_sentences, removed (character ranges)."""
    rows = marked_rows(df, id_col, text_col)
    joined = repeated_rows(rows, repeated_runs(rows), "span-marks")
    kind = rows.schema["id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, totals, counts, places = [], [], [], []
            for text, held, copy in zip(*(batch.column(c) for c in (1, 2, 3)), strict=True):
                text, held = text.as_py(), held.as_py() or []
                cut = whole(text) if copy.as_py() else [(c["start"], c["stop"]) for c in held]
                kept, n, gone = without(text, cut) if cut else (text, 0, [])
                texts.append(kept)
                totals.append(len(sentences(text or "")))
                counts.append(n)
                places.append([{"start": a, "stop": b} for a, b in gone])
            kinds = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(counts, pa.int64()), pa.array(places, kinds)], names=["id", "text", "n_sentences", "removed_sentences", "removed"])

    out = joined.mapInArrow(each, f"id {kind}, text string, n_sentences long, removed_sentences long, removed array<struct<start:int,stop:int>>")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_sentences", "removed_sentences", "removed")
