"""Small pieces that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmend.plans.home import shared_dir

#: Everything that is not ASCII white space makes up a word.
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space of ``WORD`` without the blank itself.
BREAKS = "\t\n\x0b\x0c\r"


#: Paths that were written inside the innermost :func:`scratch`.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage so that it survives lost executors, gives the optimizer true sizes (it
    broadcasts a side only when that is under its threshold), and keeps one costly scan from
    being repeated.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexmend/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (held := _scratch.get()) is not None:
        held.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_staged_at"] = path
    return out


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(df: DataFrame) -> None:
    """Delete the files behind a frame from :func:`staged` that nothing reads any more."""
    known = df.__dict__.get("_staged_at")
    for folder in [known] if known else {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that were staged inside: for results that are written by then."""
    mark = _scratch.set([])
    try:
        yield
    finally:
        held = _scratch.get()
        _scratch.reset(mark)
        for path in held:
            delete(spark, path)


def as_text(col: Column) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(col.cast("string"), F.lit(""))


def words(col: Column) -> Column:
    """Array of the words of a text."""
    blanks = F.translate(col, BREAKS, " " * len(BREAKS))
    return F.array_remove(F.split(blanks, " "), "")


def n_words(col: Column) -> Column:
    return F.size(words(as_text(col))).cast("long")


def crc_bucket(id_col: Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(as_text(id_col).cast("binary")), F.lit(n))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_keyed(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with one more column, the last, and its name: a number that tells rows apart, the same at every reading.

    A scan of files has it from the file and the place in it; other frames are written first.
    """
    name = next(n for n in ("_row_key", *(f"_row_key_{i}" for i in range(len(df.columns)))) if n not in df.columns)
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if node.nodeName() == "LogicalRelation" and "_metadata" not in df.columns:
        try:
            return df.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(name)), name
        except AnalysisException:  # not a table that has row numbers
            pass
    return staged(df.withColumn(name, F.monotonically_increasing_id()), "keyed"), name


def text_marks() -> tuple[Column, Column]:
    """r1 and r2, 128 bits together, which only rows that repeat id and text share. Columns id and text."""
    blank = F.col("id").isNull()
    return F.xxhash64("id", blank, "text").alias("r1"), F.xxhash64(F.lit("lexmend"), "text", blank, "id").alias("r2")


def marked_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, r1, r2 (see :func:`text_marks`), text and key of every row of ``df``; no two rows share a key."""
    keyed, key = row_keyed(df)
    rows = keyed.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(key).alias("key"))
    return rows.select("id", *text_marks(), "text", "key")


def repeated_rows(rows: DataFrame, cut: DataFrame, name: str) -> DataFrame:
    """id, text, cut and copy of :func:`marked_rows`: what ``cut`` (r1, r2, cut) has for a text, and whether the row repeats another one."""
    twice = rows.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first")).filter("n > 1").select("r1", "r2", "first")
    marks = staged(cut.join(twice, ["r1", "r2"], "full").select(F.col("r1").alias("m1"), F.col("r2").alias("m2"), "cut", "first"), name)
    drop_staged(cut)
    # Merged at every size: a broadcast would hold for small corpora only, and then turn into a shuffle of the texts.
    joined = rows.join(marks.hint("merge"), (F.col("r1") == F.col("m1")) & (F.col("r2") == F.col("m2")), "left")
    return joined.select("id", "text", "cut", F.coalesce(F.col("key") != F.col("first"), F.lit(False)).alias("copy"))


def place(*more: str) -> Column:
    """Order of the corpus: by id, null last."""
    return F.struct(F.col("id").isNull().alias("last"), "id", *more)
