"""Readers and writers around the repair. All of them stay lazy and split as Spark's readers do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmend.config import DEFAULT, TextFixerConfig
from lexmend.functions.codecs import decode_binary
from lexmend.operators.repair import fix_column


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A row for each line of text files: path, text. Line breaks other than line feeds stay in the text, to be fixed."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each text file: path, text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_table(spark: SparkSession, path: str, column: str, kind: str = "parquet", **options) -> DataFrame:
    """A Parquet, ORC, JSON or CSV table; ``column`` must be a string column of it."""
    frame = spark.read.format(kind).options(**options).load(path)
    if dict(frame.dtypes).get(column) != "string":
        raise ValueError(f"{path} has no string column {column!r}")
    return frame


def read_warc(spark: SparkSession, path: str, types: tuple[str, ...] = ("response", "conversion", "resource"), version: str = "1.0") -> DataFrame:
    """A row for each record of WARC files: type, uri, date, data, body, complete.

    ``data`` are the bytes of the body as ``Content-Length`` has them, ``body`` is their text: UTF-8, or
    where they aren't that, windows-1252, of which every byte comes back. Uncompressed files are split
    ahead of record marks that follow an empty line; a record is not ``complete`` if its body holds one
    itself, and so ends before its length.
    """
    mark = f"WARC/{version}\r\n"
    records = spark.read.option("lineSep", f"\r\n\r\n{mark}").text(path)
    # The text reader keeps bytes as they are; only bytes are counted here.
    value = F.when(F.startswith("value", F.lit(mark)), F.substring("value", len(mark) + 1, 1 << 30)).otherwise(F.col("value"))
    header = F.substring_index("value", "\r\n\r\n", 1)
    field = lambda name: F.regexp_extract("header", rf"(?im)^{name}:[ \t]*(.*?)\r?$", 1)
    after = lambda data, head: F.substring(data, F.octet_length(head) + 5, F.octet_length(data))
    parsed = (
        records.select(value.alias("value"))
        .select(header.alias("header"), after(F.col("value").cast("binary"), header).alias("rest"))
        .select(field("WARC-Type").alias("type"), field("WARC-Target-URI").alias("uri"), field("WARC-Date").alias("date"), field("Content-Length").try_cast("int").alias("length"), "rest")
        .filter(F.col("type").isin(*types))
        .withColumn("length", F.coalesce("length", F.octet_length("rest")))
        .withColumn("complete", F.octet_length("rest") >= F.col("length"))
        .withColumn("rest", F.substring("rest", F.lit(1), F.col("length")))
    )
    # A response has headers of its own ahead of the body.
    inner = F.substring_index(F.col("rest").cast("string"), "\r\n\r\n", 1)
    data = F.when(F.col("type") == "response", after(F.col("rest"), inner)).otherwise(F.col("rest"))
    text = F.col("data").cast("string")
    body = F.when(F.is_valid_utf8(text), text).otherwise(decode_binary("data", "sloppy-windows-1252"))
    return parsed.withColumn("data", data).select("type", "uri", "date", "data", body.alias("body"), "complete")


def write_texts(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", column: str | None = None, config: TextFixerConfig = DEFAULT) -> None:
    """Writes a frame, with ``column`` repaired on the way if it is given."""
    (fix_column(df, column, config=config) if column else df).write.format(kind).mode(mode).save(path)
