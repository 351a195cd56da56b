"""Token counts by a public byte-level BPE vocabulary, whose file is a parameter.

The driver reads the file and sends its bytes along, so executors need no copy at that path. Each
Python worker builds the encoder once. The default is a public byte-level BPE of 50,256 ranks (OpenAI,
MIT License); its path is the parameter ``vocabulary``, or the environment's ``LEXMEND_VOCABULARY``.

Defined cases: null and empty texts have no token; special tokens in a text are ordinary text; a
long text is counted whole, in pieces that end at white space ahead of a letter, where no token can
span. Ties can't occur; repeated rows are counted alike. Empty tables give empty results. Columns
other than id, text and those named in ``also`` are not read, whatever their names.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rank file, and the pattern that splits texts ahead of its merges.
VOCABULARY = os.environ.get("LEXMEND_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoder(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("lexmend", pat_str=pattern, mergeable_ranks=table, special_tokens={})


#: Characters of a long text that are encoded together, and where it may be cut: before a blank between a letter or mark and a letter.
PIECE = 1 << 18
CUT = re.compile(r"(?<=\S)(?= [^\W\d_])")


def count(text: str, encode) -> int:
    """Tokens of a text, however long."""
    total, at = 0, 0
    while len(text) - at > PIECE:
        cut = CUT.search(text, at + PIECE)
        if cut is None:
            break
        total += len(encode(text[at : cut.start()]))
        at = cut.start()
    return total + len(encode(text[at:]))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, also: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``df``: id, tokens, and the columns named in ``also``."""
    if not Path(vocabulary).is_file():
        raise FileNotFoundError(f"no vocabulary at {vocabulary}: pass the path of a rank file as vocabulary, or set LEXMEND_VOCABULARY")
    ranks = Path(vocabulary).read_bytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, pattern).encode_ordinary
        for batch in batches:
            counts = [count(x.as_py() or "", encode) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *batch.columns[2:]], names=["id", "tokens", *batch.schema.names[2:]])

    names = [f"_a{i}" for i in range(len(also))]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(n) for c, n in zip(also, names, strict=True)])
    more = "".join(f", {n} {rows.schema[n].dataType.simpleString()}" for n in names)
    made = rows.mapInArrow(each, f"id {rows.schema['id'].dataType.simpleString()}, tokens long{more}")
    return made.select(F.col("id").alias(id_col), "tokens", *[F.col(n).alias(c) for c, n in zip(also, names, strict=True)])
