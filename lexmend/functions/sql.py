"""The functions under SQL names.

What SQL can express becomes a SQL function, which the optimizer inlines. The rest are vectorised
functions of the kernel; :func:`register` gives them a SQL function in front that passes them
only the texts that can change.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from lexmend import chars, kernel, patterns
from lexmend.config import DEFAULT, ENCODING_ONLY, TextFixerConfig
from lexmend.functions.batches import by_text
from lexmend.functions.repair import EXPLAINED, _touching, explained


def quoted(text: str) -> str:
    """A SQL string literal."""
    out = "".join(f"\\u{ord(c):04X}" if not 0x20 <= ord(c) < 0x7F else "\\" + c if c in "\\'" else c for c in text)
    return f"'{out}'"


def _translate(table: dict[str, str]) -> str:
    return f"translate(t, {quoted(''.join(table))}, {quoted(''.join(table.values()))})"


def _nested(table: dict[str, str]) -> str:
    out = "t"
    for char, letters in table.items():
        out = f"replace({out}, {quoted(char)}, {quoted(letters)})"
    return out


def bodies() -> dict[str, tuple[str, str]]:
    """Name to (return type, body in t)."""
    found = quoted(patterns.NON_ASCII)
    out = {
        "fix_c1_controls": ("STRING", _translate(chars.C1)),
        "fix_character_width": ("STRING", _translate(chars.WIDTHS)),
        "uncurl_quotes": ("STRING", _translate(dict.fromkeys(chars.DOUBLE_QUOTES, '"') | dict.fromkeys(chars.SINGLE_QUOTES, "'"))),
        "fix_latin_ligatures": ("STRING", _nested(chars.LIGATURES)),
        "fix_line_breaks": ("STRING", f"regexp_replace(t, {quoted(chars.LINE_BREAKS)}, {quoted(chr(10))})"),
        "remove_terminal_escapes": ("STRING", f"regexp_replace(t, {quoted(patterns.TERMINAL_ESCAPE)}, '')"),
        "remove_control_chars": ("STRING", f"regexp_replace(t, {quoted(chars.CONTROL_CLASS)}, '')"),
        "is_bad": ("BOOLEAN", f"t RLIKE {found} AND t RLIKE {quoted(patterns.IS_BAD)}"),
        "badness": ("INT", f"CASE WHEN t RLIKE {found} AND t RLIKE {quoted(patterns.IS_BAD)} THEN regexp_count(t, {quoted(patterns.BADNESS)}) WHEN t IS NOT NULL THEN 0 END"),
        "is_control_char": ("BOOLEAN", f"t RLIKE {quoted(patterns.ONE_CONTROL)}"),
        "text_lines": ("ARRAY<STRING>", f"array_remove(split(t, {quoted('(?<=' + chr(92) + 'n)')}), '')"),
    }
    for codec in chars.CANDIDATES:
        held = chars.repertoire(codec)
        also = "" if "\x1a" in held else f" AND NOT contains(t, {quoted(chr(0x1A))})"
        out["possible_" + codec.removeprefix("sloppy-").replace("-", "_")] = ("BOOLEAN", f"NOT t RLIKE {quoted(patterns.outside(held))}{also}")
    return out


def _untouched(config: TextFixerConfig) -> str:
    tests = ["octet_length(t) = char_length(t)"]
    if config.unescape_html:
        tests.append(f"NOT t RLIKE {quoted(chars.ENTITY)}")
    if config.remove_terminal_escapes and not config.remove_control_chars:
        tests.append(f"NOT contains(t, {quoted(chr(27) + '[')})")
    if (plain := _touching(config)) is not None:
        tests.append(f"NOT t RLIKE {quoted(plain)}")
    return " AND ".join(tests)


def register(spark: SparkSession, config: TextFixerConfig = DEFAULT, prefix: str = "") -> list[str]:
    """Registers the functions for the session; returns their names."""
    names = []
    for name, (kind, body) in bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(t STRING) RETURNS {kind} RETURN {body}")
        names.append(prefix + name)

    def register_text(name: str, make) -> None:
        spark.udf.register(name, by_text(make))

    for name, own in (("fix_text", config), ("fix_encoding", ENCODING_ONLY)):
        register_text(f"{prefix}{name}_kernel", lambda t, own=own: kernel.fix_text_safely(t, own))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(t STRING) RETURNS STRING RETURN coalesce({prefix}{name}_kernel(CASE WHEN NOT ({_untouched(own)}) THEN t END), t)")
        names.append(prefix + name)
    register_text(f"{prefix}unescape_html_kernel", kernel.unescape_html)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}unescape_html(t STRING) RETURNS STRING RETURN coalesce({prefix}unescape_html_kernel(CASE WHEN t RLIKE {quoted(chars.ENTITY)} THEN t END), t)")
    spark.udf.register(f"{prefix}fix_and_explain_kernel", explained(config))
    none = "array()" if config.explain else "NULL"
    plain = f"named_struct('text', t, 'steps', CAST({none} AS ARRAY<STRUCT<transformation: STRING>>))"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}fix_and_explain(t STRING) RETURNS {EXPLAINED} "
        f"RETURN CASE WHEN t IS NULL THEN NULL WHEN {_untouched(config)} THEN {plain} ELSE {prefix}fix_and_explain_kernel(CASE WHEN NOT ({_untouched(config)}) THEN t END) END"
    )
    return [*names, f"{prefix}unescape_html", f"{prefix}fix_and_explain"]
