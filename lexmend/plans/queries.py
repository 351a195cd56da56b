"""The registered queries of the repair, and SQL that gives the same rows.

The test tables are intact, so each query damages their texts first, the same way on every run,
and repairs them; the SQL states what must come out, most often the intact text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmend import chars, kernel, patterns
from lexmend.config import DEFAULT, ENCODING_ONLY
from lexmend.functions import batches, codecs, detect, fixers, pieces, repair, sql
from lexmend.operators import repair as operators
from lexmend.operators import reports
from lexmend.plans import damage
from lexmend.plans.home import shared_dir
from lexmend.streaming import start_fixed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def re2(pattern: str) -> str:
    """A pattern for RE2 as a SQL literal: its escapes of code points, and its names of properties."""
    out = pattern.replace(patterns.WORD_CHAR, r"\pL\pM\p{Nd}\p{Nl}\p{Pc}").replace(patterns.SPACE_CHAR, r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
    return "'" + re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", out).replace("'", "''") + "'"


def bytes_as(codec: str) -> str:
    """SQL: the UTF-8 of ``text`` read with a codec."""
    table = chars.decoded(codec)
    read = "list_transform(range(1, 1 + octet_length(encode(text))), lambda i: CAST('0x' || substr(hex(encode(text)), CAST(2 * i - 1 AS BIGINT), 2) AS INT))"
    odd = {b: c for b, c in enumerate(table) if ord(c) != b}
    as_latin = f"array_to_string(list_transform({read}, lambda b: chr(b)), '')"
    if not odd:
        return as_latin
    return f"translate({as_latin}, '{''.join(map(chr, odd))}', '{''.join(odd.values())}')"


# --- Segments


@query(
    """
    SELECT doc_id, CAST(i - 1 AS INT) AS pos, CASE WHEN i < len(l) THEN l[i] || chr(10) ELSE l[i] END AS segment
    FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
    WHERE i < len(l) OR l[i] <> ''
    """
)
def segment_rows(spark, sf_dir):
    return reports.segment_rows(docs(spark, sf_dir), "doc_id")


@query(
    """
    SELECT page_id, CAST(i - 1 AS INT) AS pos, NOT max(contains(l[i], '<')) OVER (PARTITION BY page_id ORDER BY i) AS decodes
    FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, string_split(substr(replace(html, '<', chr(10) || chr(60)), 2), chr(10)) AS l FROM pages))
    WHERE i < len(l) OR l[i] <> ''
    """
)
def sticky_angle(spark, sf_dir):
    text = F.substring(F.replace(F.col("html"), F.lit("<"), F.lit("\n<")), F.lit(2), F.length("html") * 2)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.alias("html"))
    return pages.select("page_id", F.posexplode(pieces.sticky_angle("html")).alias("pos", "decodes"))


# --- Detection


def _mojibake(spark, sf_dir, codec: str = "latin-1") -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", "lang", F.col("text").alias("intact"), damage.layer(F.col("text"), codec).alias("text"))


@query(
    f"""
    SELECT doc_id, pos, badness FROM (
      SELECT doc_id, CAST(i - 1 AS INT) AS pos, CAST(len(regexp_extract_all(CASE WHEN i < len(l) THEN l[i] || chr(10) ELSE l[i] END, {re2(patterns.BADNESS_OF_RULES)})) AS INT) AS badness
      FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split({bytes_as("latin-1")}, chr(10)) AS l FROM documents)))
    WHERE badness > 0
    """
)
def bad_lines(spark, sf_dir):
    return reports.bad_lines(_mojibake(spark, sf_dir), "doc_id").select("doc_id", "pos", "badness")


@query(
    f"""
    SELECT lang, count(*) AS texts, CAST(sum(CASE WHEN b > 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad_texts, CAST(sum(b) AS BIGINT) AS badness
    FROM (SELECT lang, len(regexp_extract_all({bytes_as("latin-1")}, {re2(patterns.BADNESS_OF_RULES)})) AS b FROM documents) GROUP BY lang
    """
)
def badness_by_lang(spark, sf_dir):
    return reports.badness_by(_mojibake(spark, sf_dir), "lang")


@query(
    f"""
    SELECT doc_id, CAST(len(regexp_extract_all({bytes_as("sloppy-windows-1252")}, {re2(patterns.BADNESS_OF_RULES)})) AS BIGINT) AS badness
    FROM documents ORDER BY badness DESC, doc_id LIMIT 20
    """
)
def worst_texts(spark, sf_dir):
    return reports.worst(_mojibake(spark, sf_dir, "sloppy-windows-1252"), "doc_id", k=20)


@query("SELECT doc_id, false AS bad, 0 AS badness FROM documents")
def intact_is_not_bad(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", detect.is_bad("text").alias("bad"), detect.badness("text").alias("badness"))


def _outside(codec: str) -> str:
    return re2("[^" + patterns.char_class("".join(chars.repertoire(codec)))[1:])


@query(" UNION ALL ".join(f"SELECT '{c}' AS codec, count(*) AS texts FROM documents WHERE NOT regexp_matches(text, {_outside(c)}) HAVING count(*) > 0" for c in chars.CANDIDATES))
def possible_encodings(spark, sf_dir):
    return reports.encodings(docs(spark, sf_dir))


@query("SELECT doc_id, NOT regexp_matches(text, '[^\\x00-\\x7F]') AS ascii FROM documents")
def ascii_texts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", detect.is_ascii("text").alias("ascii"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[^\\x00-\\x7F]+')) AS runs FROM documents")
def utf8_runs(spark, sf_dir):
    """Each run of characters beyond ASCII, read with windows-1252, is one run of what looks like UTF-8."""
    return _mojibake(spark, sf_dir, "sloppy-windows-1252").select("doc_id", F.size(detect.utf8_runs("text")).cast("long").alias("runs"))


# --- Single fixers


def _fixed(spark, sf_dir, damaged: Column, fix) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", damaged.alias("text")).select("doc_id", fix(F.col("text")).alias("text"))


INTACT = "SELECT doc_id, text FROM documents"
#: What is left of the quotation marks of :func:`damage.curly`.
STRAIGHT = "replace(replace(text, ' t', ' ' || chr(39) || 't' || chr(39)), ' a', ' \"a\"')"


@query("SELECT doc_id, replace(replace(replace(text, 'e', '€'), 'a', '…'), 'n', '‘' || chr(129) || 'Ÿ') AS text FROM documents")
def fix_c1_controls(spark, sf_dir):
    text = F.replace(F.replace(F.replace(F.col("text"), F.lit("e"), F.lit("\x80")), F.lit("a"), F.lit("\x85")), F.lit("n"), F.lit("\x91\x81\x9f"))
    return _fixed(spark, sf_dir, text, fixers.fix_c1_controls)


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, 'e', 'ffi'), 't', 'st'), 'o', 'ij'), 'u', 'ſt'), 'a', 'ʼn') AS text FROM documents")
def fix_latin_ligatures(spark, sf_dir):
    text = F.col("text")
    for plain, one in (("e", "ﬃ"), ("t", "ﬆ"), ("o", "ĳ"), ("u", "ﬅ"), ("a", "ŉ")):
        text = damage.substitute(text, plain, one)
    return _fixed(spark, sf_dir, text, fixers.fix_latin_ligatures)


@query(INTACT)
def fix_character_width(spark, sf_dir):
    wide = F.translate("text", "".join(map(chr, range(0x21, 0x7F))) + " ", "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "\u3000")
    return _fixed(spark, sf_dir, wide, fixers.fix_character_width)


@query(f"SELECT doc_id, {STRAIGHT} AS text FROM documents")
def uncurl_quotes(spark, sf_dir):
    return _fixed(spark, sf_dir, damage.curly(F.col("text")), fixers.uncurl_quotes)


@query("SELECT doc_id, replace(replace(text, '. ', '.' || chr(10)), ', ', ',' || chr(10)) AS text FROM documents")
def fix_line_breaks(spark, sf_dir):
    text = F.replace(F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), F.lit(". "), F.lit(".\u2028")), F.lit(", "), F.lit(",\r"))
    return _fixed(spark, sf_dir, text, fixers.fix_line_breaks)


@query(INTACT)
def remove_terminal_escapes(spark, sf_dir):
    text = F.replace(F.replace(F.col("text"), F.lit(" t"), F.lit("\x1b[1;31m t\x1b[0m")), F.lit("a"), F.lit("\x1b[ma"))
    return _fixed(spark, sf_dir, text, fixers.remove_terminal_escapes)


@query(INTACT)
def remove_control_chars(spark, sf_dir):
    text = F.replace(F.replace(F.replace(F.col("text"), F.lit("e"), F.lit("\x00e\x0b")), F.lit("a"), F.lit("\ufeffa\x7f")), F.lit("n"), F.lit("\u206an\ufffc"))
    return _fixed(spark, sf_dir, text, fixers.remove_control_chars)


DECOMPOSED = "[ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ]"


@query(f"SELECT doc_id, nfc_normalize(text) AS nfc, nfc_normalize(text) AS nfkc, length(nfc_normalize(text)) + len(regexp_extract_all(nfc_normalize(text), '{DECOMPOSED}')) AS nfd_length, nfc_normalize(text) AS from_nfkd FROM documents")
def normalize(spark, sf_dir):
    split = docs(spark, sf_dir).select("doc_id", fixers.normalize("text", "NFD").alias("d"), fixers.normalize("text", "NFKD").alias("k"))
    return split.select("doc_id", fixers.normalize("d", "NFC").alias("nfc"), fixers.normalize("d", "NFKC").alias("nfkc"), F.length("d").cast("long").alias("nfd_length"), fixers.normalize("k", "NFC").alias("from_nfkd"))


@query("SELECT page_id, replace(replace(replace(replace(html, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&') AS html FROM pages")
def unescape_html(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", fixers.unescape_html("html").alias("html"))


@query("SELECT doc_id, replace(text, '. ', 'É€A😀&notit;&semi;;' || chr(65533) || '. ') AS text FROM documents")
def unescape_references(spark, sf_dir):
    text = damage.substitute(F.col("text"), ". ", "&EACUTE;&#128;&#x41;&#x1F600;&notit;&semi;&SEMI;&#xD800;. ")
    return _fixed(spark, sf_dir, text, fixers.unescape_html)


# --- Bytes


def _bytes(spark, sf_dir) -> DataFrame:
    """The UTF-8 of the texts as byte strings."""
    return docs(spark, sf_dir).select("doc_id", codecs.as_byte_string(F.encode("text", "UTF-8")).alias("data"))


@query("SELECT doc_id, replace(replace(text, '. ', '.à la '), ', ', ',Š') AS text FROM documents")
def restore_byte_a0(spark, sf_dir):
    """Bytes A0 that turned into blanks, among the bytes of intact text."""
    data = damage.substitute(damage.substitute(F.col("data"), ". ", ".\xc3 la "), ", ", ",\xc5 ")
    return _bytes(spark, sf_dir).select("doc_id", data.alias("data")).select("doc_id", codecs.decode_utf8(codecs.restore_byte_a0("data")).alias("text"))


@query("SELECT doc_id, replace(text, '. ', chr(65533) || 'x' || chr(65533) || '. ') AS text FROM documents")
def replace_lossy_sequences(spark, sf_dir):
    data = damage.substitute(F.col("data"), ". ", "\xe2\x80\x1ax\xc3?. ")
    return _bytes(spark, sf_dir).select("doc_id", codecs.decode_utf8(codecs.replace_lossy_sequences(data)).alias("text"))


@query("SELECT doc_id, replace(text, '. ', '😀가. ') AS text, true AS broken FROM documents")
def utf8_variants(spark, sf_dir):
    data = damage.substitute(F.col("data"), ". ", "\xed\xa0\xbd\xed\xb8\x80\xea\xb0\x80. ")
    made = _bytes(spark, sf_dir).select("doc_id", data.alias("data"))
    return made.select("doc_id", codecs.decode_utf8_variants("data").alias("text"), codecs.decode_utf8_variants(F.concat("data", F.lit("\xc0"))).isNull().alias("broken"))


#: Bytes, in hexadecimal, that the public standards of the codecs leave without a character.
WITHOUT_CHARACTER = {
    "sloppy-windows-1253": "AA D2 FF",
    "sloppy-windows-1255": "D9 DA DB DC DD DE DF FB FC FF",
    "sloppy-windows-1257": "A1 A5",
    "sloppy-iso-8859-3": "A5 AE BE C3 D0 E3 F0",
    "sloppy-iso-8859-6": "A1 A2 A3 A5 A6 A7 A8 A9 AA AB AE AF B0 B1 B2 B3 B4 B5 B6 B7 B8 B9 BA BC BD BE C0 DB DC DD DE DF F3 F4 F5 F6 F7 F8 F9 FA FB FC FD FE FF",
    "sloppy-iso-8859-7": "AE D2 FF",
    "sloppy-iso-8859-8": "A1 BF C0 C1 C2 C3 C4 C5 C6 C7 C8 C9 CA CB CC CD CE CF D0 D1 D2 D3 D4 D5 D6 D7 D8 D9 DA DB DC DD DE FB FC FF",
}
ROUND_TRIPS = (*chars.CANDIDATES, *(c for c in chars.EXTRA_CODECS if c.startswith("sloppy-")))


@query(
    f"""
    SELECT doc_id, CASE WHEN regexp_matches(hex(encode(text)), '^(..)*(' || c.lost || ')') THEN 'lost' ELSE text END || c.codec AS text
    FROM documents, (VALUES {', '.join(f"('{c}', '{WITHOUT_CHARACTER.get(c, 'none').replace(' ', '|')}')" for c in ROUND_TRIPS)}) c(codec, lost)
    """
)
def codec_round_trips(spark, sf_dir):
    """UTF-8 read with a codec, encoded with it again, and read as UTF-8: every byte comes back, but those without a character.

    The documents are read once for all codecs, and the codecs are the kernel's: as expressions they
    took ten times the CPU.
    """

    def each(whole: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole:
            for at in batches.slices(batch.column(1)):
                some = batch.slice(*at)
                texts = some.column(1).cast(pa.binary()).to_pylist()
                for codec in ROUND_TRIPS:
                    # A byte without a character comes back as another one or not at all.
                    done = [None if t is None else ("lost" if (back := kernel.round_trip(t, codec)) is None else back) + codec for t in texts]
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(done, pa.string())], ["doc_id", "text"])

    made = docs(spark, sf_dir).select("doc_id", "text")
    return made.mapInArrow(each, f"doc_id {made.schema['doc_id'].dataType.simpleString()}, text string")


@query(INTACT)
def undo_first_layer(spark, sf_dir):
    made = _mojibake(spark, sf_dir, "sloppy-windows-1252")
    return made.select("doc_id", F.when(detect.is_bad("text"), codecs.undo_first_layer("text")).otherwise(F.col("text")).alias("text"))


# --- Wrong decoding


def _layers(spark, sf_dir, *names: str) -> DataFrame:
    text = F.col("text")
    for codec in names:
        text = damage.layer(text, codec)
    made = docs(spark, sf_dir).select("doc_id", text.alias("text"))
    return operators.fix_column(made, config=ENCODING_ONLY)


@query(INTACT)
def fix_encoding_latin_1(spark, sf_dir):
    return _layers(spark, sf_dir, "latin-1")


@query(INTACT)
def fix_encoding_1252(spark, sf_dir):
    return _layers(spark, sf_dir, "sloppy-windows-1252")


@query("SELECT doc_id, replace(replace(replace(text, ' t', ' ‘t’'), ' a', ' “a”') || chr(10), chr(10), ' “x”' || chr(10)) AS text FROM documents")
def fix_encoding_1251(spark, sf_dir):
    # A quotation mark at the end of every line: without one, accents read as Cyrillic letters can pass for intact.
    quoted = F.replace(F.concat(damage.curly(F.col("text")), F.lit("\n")), F.lit("\n"), F.lit(" “x”\n"))
    made = docs(spark, sf_dir).select("doc_id", damage.layer(quoted, "sloppy-windows-1251").alias("text"))
    return operators.fix_column(made, config=ENCODING_ONLY)


@query(INTACT)
def fix_encoding_two_layers(spark, sf_dir):
    return _layers(spark, sf_dir, "sloppy-windows-1252", "sloppy-windows-1252")


@query("SELECT doc_id, '☃ ' || replace(replace(text, '. ', '. é '), ', ', ', —t ') AS text FROM documents")
def decode_inconsistent_utf8(spark, sf_dir):
    # The snowman keeps any one codec from fitting the whole text.
    text = F.concat(F.lit("☃ "), F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(". Ã© ")), F.lit(", "), F.lit(", â€”t ")))
    return docs(spark, sf_dir).select("doc_id", repair.decode_inconsistent_utf8(text).alias("text"))


# --- Everything together


def _all_damage(text: Column) -> Column:
    return F.replace(F.replace(F.regexp_replace(damage.curly(text), "fi", "ﬁ"), F.lit("\n"), F.lit("\r\n")), F.lit(". "), F.lit("\x1b[0m. "))


@query(f"SELECT doc_id, {STRAIGHT} AS text FROM documents")
def fix_text(spark, sf_dir):
    return operators.fix_column(docs(spark, sf_dir).select("doc_id", _all_damage(F.col("text")).alias("text")))


@query(f"SELECT doc_id, {STRAIGHT} AS text FROM documents")
def fix_text_and_layers(spark, sf_dir):
    """Quotation marks, read with windows-1252 twice over."""
    text = damage.layer(damage.layer(damage.curly(F.col("text")), "sloppy-windows-1252"), "sloppy-windows-1252")
    # The repair names its text several times; the damage is done once.
    return docs(spark, sf_dir).select("doc_id", text.alias("text")).select("doc_id", repair.fix_text("text").alias("text"))


@query(INTACT)
def fix_text_intact(spark, sf_dir):
    return operators.fix_column(docs(spark, sf_dir).select("doc_id", "text"))


@query("SELECT conv_id, turn, text FROM conversations")
def fix_text_conversations(spark, sf_dir):
    return operators.fix_column(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text"))


PAGES = "replace(replace(replace(replace({}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')"


@query(f"SELECT page_id, {PAGES.format(PAGES.format('html'))} AS html FROM pages")
def fix_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return operators.fix_column(pages, "html", config=DEFAULT.but(unescape_html=True))


@query("SELECT page_id, html FROM pages")
def fix_pages_auto(spark, sf_dir):
    """Every page holds a ``<`` in its first line, so entities stay."""
    return operators.fix_column(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "html")


@query(
    f"""
    SELECT doc_id, {STRAIGHT} AS text,
           concat_ws(',', CASE WHEN contains(text, ' t') OR contains(text, ' a') THEN 'uncurl_quotes' END, CASE WHEN contains(text, chr(10)) THEN 'fix_line_breaks' END) AS steps
    FROM documents
    """
)
def fix_and_explain(spark, sf_dir):
    made = docs(spark, sf_dir).select("doc_id", F.replace(damage.curly(F.col("text")), F.lit("\n"), F.lit("\r\n")).alias("damaged"))
    done = operators.explain_column(made, "damaged", "e")
    return done.select("doc_id", F.col("e.text").alias("text"), F.array_join(F.transform("e.steps", lambda s: s["transformation"]), ",").alias("steps"))


@query(f"SELECT doc_id, {STRAIGHT} AS text, false AS bad, len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN 1 ELSE 0 END AS n_lines FROM documents")
def sql_functions(spark, sf_dir):
    sql.register(spark, prefix="lexmend_")
    docs(spark, sf_dir).select("doc_id", damage.curly(F.col("text")).alias("curly"), "text").createOrReplaceTempView("lexmend_documents")
    return spark.sql("SELECT doc_id, lexmend_fix_text(curly) AS text, lexmend_is_bad(text) AS bad, CAST(size(lexmend_text_lines(text)) AS BIGINT) AS n_lines FROM lexmend_documents")


@query(INTACT)
def stream_fix_text(spark, sf_dir):
    """The same repair over a stream of files, written by a streaming query and read back."""
    home = f"{shared_dir(spark)}/lexmend/stream-{uuid.uuid4().hex}"
    kinds = docs(spark, sf_dir).select("doc_id", "text").schema
    # A glob, because the table is one file at the small sizes and a folder at others.
    stream = spark.readStream.schema(kinds).parquet(f"{sf_dir}/documents.parquet*")
    start_fixed(stream.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\r\n"))), f"{home}/out", f"{home}/checkpoint").awaitTermination()
    return spark.read.schema(kinds).parquet(f"{home}/out")
