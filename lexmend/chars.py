"""Character tables. What a public standard defines is derived from it; the rest is stated."""

from __future__ import annotations

import unicodedata
from functools import cache
from html.entities import html5

REPLACEMENT = "\ufffd"

# --- Fixed values: single-byte codecs that repaired text may have been decoded with, in order of trial.
CANDIDATES = (
    "latin-1",
    "sloppy-windows-1252",
    "sloppy-windows-1251",
    "sloppy-windows-1250",
    "sloppy-windows-1253",
    "sloppy-windows-1254",
    "sloppy-windows-1257",
    "iso-8859-2",
    "macroman",
    "cp437",
)
#: Further codecs that can be named, but are not tried.
EXTRA_CODECS = (
    "sloppy-windows-1255",
    "sloppy-windows-1256",
    "sloppy-windows-1258",
    "sloppy-iso-8859-3",
    "sloppy-iso-8859-6",
    "sloppy-iso-8859-7",
    "sloppy-iso-8859-8",
    "windows-1252",
    "ascii",
)
#: Bytes without a character in the WHATWG indexes; their other unassigned bytes are C1 controls.
HOLES = {
    "windows-1253": b"\xaa\xd2\xff",
    "windows-1255": b"\xd9\xda\xdb\xdc\xdd\xde\xdf\xfb\xfc\xff",
    "windows-1257": b"\xa1\xa5",
    "iso-8859-3": b"\xa5\xae\xbe\xc3\xd0\xe3\xf0",
    "iso-8859-6": bytes([0xA1, 0xA2, 0xA3, *range(0xA5, 0xAC), *range(0xAE, 0xBB), *range(0xBC, 0xBF), 0xC0, *range(0xDB, 0xE0), *range(0xF3, 0x100)]),
    "iso-8859-7": b"\xae\xd2\xff",
    "iso-8859-8": bytes([0xA1, *range(0xBF, 0xDF), 0xFB, 0xFC, 0xFF]),
}
PYTHON_NAMES = {"macroman": "mac_roman"}
#: Where Python's table differs from the WHATWG index.
ODD_BYTES = {("windows-1255", 0xCA): "\u05ba"}


@cache
def decoded(codec: str) -> str:
    """The characters that bytes 0x00 to 0xFF decode to. Sloppy codecs decode 0x1A to U+FFFD."""
    base = codec.removeprefix("sloppy-")
    holes = HOLES.get(base, b"")
    out = []
    for byte in range(256):
        try:
            char = bytes([byte]).decode(PYTHON_NAMES.get(base, base))
        except UnicodeDecodeError:
            char = REPLACEMENT if byte in holes or base == "ascii" else chr(byte)
        out.append(ODD_BYTES.get((base, byte), REPLACEMENT if byte in holes else char))
    if codec.startswith("sloppy-"):
        out[0x1A] = REPLACEMENT
    return "".join(out)


@cache
def byte_of(codec: str) -> dict[str, int]:
    """Byte of every character. Of several bytes for U+FFFD the last hole counts, or 0x1A without one."""
    table = decoded(codec)
    out = {c: b for b, c in enumerate(table) if b != 0x1A or not codec.startswith("sloppy-")}
    if codec.startswith("sloppy-"):
        out.setdefault(REPLACEMENT, 0x1A)
    return out


@cache
def repertoire(codec: str) -> frozenset[str]:
    """Characters that text decoded with the codec can hold."""
    table = decoded(codec)
    return frozenset([*map(chr, range(0x80)), *table[0x80:]]) - {"\x1a"} | {table[0x1A]}


@cache
def to_bytes_table(codec: str) -> dict[int, int]:
    """For ``str.translate``: character to the character U+0000..U+00FF of its byte."""
    return {ord(c): b for c, b in byte_of(codec).items() if ord(c) != b}


# --- Character classes of the detector of UTF-8 inside other text.
_LATIN = ("latin-1", *(f"sloppy-windows-{n}" for n in (1250, 1251, 1252, 1253, 1254, 1257)))


def _union(first: int, last: int) -> str:
    return "".join(sorted({decoded(c)[b] for c in _LATIN for b in range(first, last + 1)} - {REPLACEMENT}))


LEAD_2, LEAD_3 = _union(0xC2, 0xDF), _union(0xE0, 0xEF)
LEAD_4 = "".join(sorted({*_union(0xF0, 0xF0), *_union(0xF3, 0xF3)}))
_TRAIL = _union(0x80, 0xBF)
#: A blank may stand for the no-break space.
CONTINUATION = _TRAIL + " "
# --- Fixed values: continuation characters that are common next to intact text.
LOOSE = "–—―‘’‚“”„•…"
STRICT = "".join(c for c in _TRAIL if c not in LOOSE)

# --- Fixed values: categories of characters that turn up in wrongly decoded text.
CATEGORIES = {
    "common": "\xa0\xad·´–—―…’",
    "c1": "".join(map(chr, range(0x80, 0xA0))),
    "bad": "¦¤¨¬¯¸ƒˆˇ˘˛˜†‡‰⌐◊\ufffdªº",
    "law": "¶§",
    "currency": "¢£¥₧€",
    "start_punctuation": "¡«¿©΄΅‘‚“„•‹\uf8ff",
    "end_punctuation": "®»˝”›™",
    "numeric": "²³¹±¼½¾×µ÷⁄∂∆∏∑√∞∩∫≈≠≡≤≥№",
    "kaomoji": "ÒÓÔÕÖÙÚÛÜòóôõöøùúûüŐŌŪŲ°",
    "upper_accented": "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑØÜÝĂĀĄĆČĎĐĘĚĒĖĞĢİĪĶĹĽŁĻŃŇŅŒŘŚŞŠŢŤŮŰŸŹŻŽҐ",
    "lower_accented": "ßàáâãäåæçèéêëìíîïðñăąāćčďđęěēėğģīįķĺľłļœŕśşšťüźżžґﬁﬂ",
    "upper_common": "ÞΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡ΢ΣΤΥΦΧΨΩΆΈΉΊΌΎΏΪΫЁЂЃЄЅІЇЈЉЊЋЌЍЎЏАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "lower_common": "αβγδεζηθικλμνξοπρςστυφχψωάέήίΰабвгдежзийклмнопрстуфхцчшщъыьэюяѐёђѓєѕіїјљњћќѝўџ",
    "box": "│┌┐┘├┤┬┼═║╒╓╔╕╖╗╘╙╚╛╜╝╞╟╠╡╢╣╤╥╦╧╨╩╪╫╬▀▄█▌▐░▒▓",
}

# --- Fixed values: Latin ligatures and digraphs that one character holds.
LIGATURES = {
    "Ĳ": "IJ", "ĳ": "ij", "ŉ": "ʼn", "Ǳ": "DZ", "ǲ": "Dz", "ǳ": "dz", "Ǆ": "DŽ", "ǅ": "Dž", "ǆ": "dž",
    "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj",
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ſt", "ﬆ": "st",
}

# --- Fixed values: quotation marks that have a plain form.
DOUBLE_QUOTES = "“”„‟"
SINGLE_QUOTES = "ʼ‘’‚‛"

# --- Fixed values: control characters that text should not hold, as ranges.
CONTROLS = ((0x00, 0x08), (0x0B, 0x0B), (0x0E, 0x1F), (0x7F, 0x7F), (0x206A, 0x206F), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFC))
CONTROL_CLASS = "[" + "".join(f"\\u{a:04X}" if a == b else f"\\u{a:04X}-\\u{b:04X}" for a, b in CONTROLS) + "]"

# --- Fixed values: line breaks, and what is read as a character reference.
LINE_BREAKS = r"\r\n|[\r\u0085\u2028\u2029]"
ENTITY = r"&#?[0-9A-Za-z]{1,24};"

#: Full-width and half-width characters, to the first character of their compatible form.
WIDTHS = {"\u3000": " "} | {chr(i): n for i in range(0xFF01, 0xFFF0) if (n := unicodedata.normalize("NFKC", chr(i))[0]) != chr(i)}

#: C1 controls, to the characters that windows-1252 has in their place.
C1 = {chr(b): c for b, c in enumerate(decoded("sloppy-windows-1252")) if 0x80 <= b < 0xA0 and c != chr(b)}


@cache
def entities() -> dict[str, str]:
    """Every entity with ``&`` and ``;`` to its text: the names of HTML, and their all-caps forms where those are no names themselves."""
    named = {f"&{k}": v for k, v in html5.items() if k.endswith(";")}
    caps = {k.upper(): v.upper() for k, v in named.items() if k == k.lower()}
    # A text with a semicolon could be read as part of another entity: such a name stays as it is.
    return {k: v for k, v in caps.items() if k not in named} | {k: v for k, v in named.items() if ";" not in v}
