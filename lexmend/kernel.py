"""The exact repair of one text, for the few rows that need recursion."""

from __future__ import annotations

import codecs
import re
import unicodedata
from functools import cache

import regex

from lexmend import chars, patterns
from lexmend.config import DEFAULT, TextFixerConfig

ROUNDS = 16
#: Of so many different characters each is replaced by itself.
FEW = 8


def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern, regex.V0)


def _on_bytes(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(r"\z", r"\Z").encode("ascii"))


_IS_BAD = _compiled(patterns.IS_BAD_OF_CLASSES)
_BADNESS = _compiled(patterns.BADNESS_OF_CLASSES)
_RUN = re.compile(patterns.UTF8_RUN)
_ALTERED = _on_bytes(patterns.ALTERED_UTF8)
_A_GRAVE = _on_bytes(patterns.A_GRAVE)
_LOSSY = _on_bytes(patterns.LOSSY_UTF8)
_PAIR = _on_bytes(patterns.CESU8_PAIR)
_SPECIAL = _on_bytes(patterns.SPECIAL_BYTES)
_FOLLOWERS = tuple(x.encode("ascii") for x in patterns.A_GRAVE_FOLLOWERS)
_ENTITY = re.compile(chars.ENTITY)
_ESCAPE = _compiled(patterns.TERMINAL_ESCAPE)
_CONTROLS = re.compile(chars.CONTROL_CLASS)
_BREAKS = re.compile(chars.LINE_BREAKS)
_C1 = str.maketrans(chars.C1)
_LIGATURES = str.maketrans(chars.LIGATURES)
_WIDTHS = str.maketrans(chars.WIDTHS)
_QUOTES = str.maketrans(dict.fromkeys(chars.DOUBLE_QUOTES, '"') | dict.fromkeys(chars.SINGLE_QUOTES, "'"))


def badness(text: str) -> int:
    return 0 if text.isascii() else sum(1 for _ in _BADNESS.finditer(text))


def is_bad(text: str) -> bool:
    return not text.isascii() and _IS_BAD.search(text) is not None


@cache
def _charmap(codec: str):
    """Encoding map of a codec; U+FFFE marks bytes that nothing is encoded to."""
    at = chars.byte_of(codec)
    return codecs.charmap_build("".join(c if at.get(c) == b else "\ufffe" for b, c in enumerate(chars.decoded(codec))))


def encode(text: str, codec: str) -> bytes | None:
    """The bytes that a text was decoded from with the codec, or None if it can't have been."""
    try:
        return codecs.charmap_encode(text, "strict", _charmap(codec))[0]
    except UnicodeEncodeError:
        return None


def decode(data: bytes, codec: str) -> str:
    """The characters that the codec has for the bytes; none fails."""
    return codecs.charmap_decode(data, "strict", chars.decoded(codec))[0]


def possible_encoding(text: str, codec: str) -> bool:
    return text.isascii() if codec == "ascii" else encode(text, codec) is not None


def round_trip(data: bytes, codec: str) -> str | None:
    """The text of UTF-8 that was read with a codec and encoded with it again; None where not every byte comes back."""
    back = encode(decode(data, codec), codec)
    return _strict(back) if back == data else None


def restore_byte_a0(data: bytes) -> bytes:
    def word(m: re.Match) -> bytes:
        return m[0] if m[0].startswith(_FOLLOWERS, 2) else b"\xc3\xa0 " + m[0][2:]

    return _ALTERED.sub(lambda m: m[0].replace(b" ", b"\xa0"), _A_GRAVE.sub(word, data))


def replace_lossy_sequences(data: bytes) -> bytes:
    return _LOSSY.sub(b"\xef\xbf\xbd", data)


def _strict(data: bytes) -> str | None:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return None


def decode_variants(data: bytes) -> str | None:
    """UTF-8 that may hold CESU-8 pairs and Java's null; None where it is neither."""
    out, at = [], 0
    while at < len(data):
        special = _SPECIAL.search(data, at)
        stop = special.start() if special else len(data)
        if stop > at:
            part = _strict(data[at:stop])
            if part is None:
                return None
            out.append(part)
            at = stop
        elif data[at] == 0xC0:
            if at + 1 == len(data):
                return None
            out.append("\0")
            at += 2
        elif len(data) - at >= 6 and _PAIR.search(data, at):
            # A pair anywhere further on vouches for this one.
            a, b, _, c, d = data[at + 1 : at + 6]
            out.append(chr(0x10000 + ((a & 0x0F) << 16) + ((b & 0x3F) << 10) + ((c & 0x0F) << 6) + (d & 0x3F)))
            at += 6
        else:
            return None
    return "".join(out)


def decode_utf8(data: bytes) -> str | None:
    return decode_variants(data) if b"\xed" in data or b"\xc0" in data else _strict(data)


def decode_inconsistent_utf8(text: str) -> str:
    """Repairs runs that look like UTF-8 inside a text that isn't all of that kind."""

    def mend(m: re.Match) -> str:
        run = m[0]
        return fix_encoding(run, DEFAULT)[0] if len(run) < len(text) and is_bad(run) else run

    return _RUN.sub(mend, text)


def _layer(text: str, config: TextFixerConfig) -> tuple[str, bool]:
    """One layer of wrong decoding less, and whether the last resort for C1 controls was reached."""
    if not is_bad(text):
        return text, False
    possible = []
    for codec in chars.CANDIDATES:
        data = encode(text, codec)
        if data is None:
            continue
        possible.append(codec)
        if config.restore_byte_a0 and codec != "macroman" and _ALTERED.search(data):
            data = restore_byte_a0(data)
        if config.replace_lossy_sequences and codec.startswith("sloppy"):
            data = replace_lossy_sequences(data)
        fixed = decode_utf8(data)
        if fixed is not None:
            return fixed, False
    if config.decode_inconsistent_utf8:
        text = decode_inconsistent_utf8(text)
    if "latin-1" in possible:
        if "sloppy-windows-1252" in possible:
            return text, False
        if all(c <= "\xff" for c in text) and (fixed := _sniffed_1252(text)) != text:
            return fixed, False
    if config.fix_c1_controls:
        return text.translate(_C1), True
    return text, False


def _sniffed_1252(text: str) -> str:
    """Latin-1 text read as windows-1252, unless it begins with a byte order mark, which decides then."""
    data = text.encode("latin-1")
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    return text.translate(_C1)


def fix_encoding(text: str, config: TextFixerConfig) -> tuple[str, list[str] | None]:
    """The text with all layers off, and the steps of the last, unchanged round."""
    for _ in range(ROUNDS):
        fixed, c1 = _layer(text, config)
        if fixed == text:
            return text, ["fix_c1_controls"] if c1 else []
        text = fixed
    return text, None


def _entity(m: re.Match) -> str:
    body = m[0]
    if body[1] != "#":
        return chars.entities().get(body, body)
    hexadecimal = body[2] in "xX"
    digits = body[3:-1] if hexadecimal else body[2:-1]
    if not digits or not all(c in ("0123456789abcdefABCDEF" if hexadecimal else "0123456789") for c in digits):
        return body
    code = int(digits, 16 if hexadecimal else 10)
    if code == 0 or code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
        return chars.REPLACEMENT
    char = chr(code).translate(_C1)
    return body if char == ";" else char


def unescape_html(text: str) -> str:
    return _ENTITY.sub(_entity, text) if "&" in text else text


def _mapped(table: dict[int, str]):
    """``str.translate`` with the table. It looks every character up, so it is left to texts with many of the table's."""
    touched = re.compile(patterns.char_class("".join(map(chr, table))))
    apart = not any(touched.search(new) for new in table.values())

    def mapped(text: str) -> str:
        if text.isascii():
            return text
        found = set(touched.findall(text))
        if not apart or len(found) > FEW:
            return text.translate(table)
        for c in found:
            text = text.replace(c, table[ord(c)])
        return text

    return mapped


@cache
def fixers(config: TextFixerConfig) -> tuple[tuple[str, object], ...]:
    """The fixers after the encoding step, in order."""
    every = (
        ("fix_c1_controls", config.fix_c1_controls, _mapped(_C1)),
        ("fix_latin_ligatures", config.fix_latin_ligatures, _mapped(_LIGATURES)),
        ("fix_character_width", config.fix_character_width, _mapped(_WIDTHS)),
        ("uncurl_quotes", config.uncurl_quotes, _mapped(_QUOTES)),
        ("fix_line_breaks", config.fix_line_breaks, lambda t: _BREAKS.sub("\n", t)),
        ("remove_terminal_escapes", config.remove_terminal_escapes, lambda t: _ESCAPE.sub("", t) if "\x1b" in t else t),
        ("remove_control_chars", config.remove_control_chars, lambda t: _CONTROLS.sub("", t)),
        ("normalize", config.normalization is not None, lambda t: t if t.isascii() else unicodedata.normalize(config.normalization, t)),
    )
    return tuple((name, f) for name, on, f in every if on)


def fix_and_explain(text: str, config: TextFixerConfig = DEFAULT) -> tuple[str, list[str] | None]:
    """The text as one segment, fixed until nothing changes, and the names of the steps taken."""
    unescape = "<" not in text if config.unescape_html == "auto" else config.unescape_html
    steps: list[str] = []
    later = fixers(config)
    for _ in range(ROUNDS):
        before = text
        if unescape and (new := unescape_html(text)) != text:
            steps.append("unescape_html")
            text = new
        if config.fix_encoding:
            text, more = fix_encoding(text, config)
            steps += more or []
        for name, fix in later:
            if (new := fix(text)) != text:
                steps.append(name)
                text = new
        if text == before:
            break
    return text, steps if config.explain else None


def segments(text: str, most: int = DEFAULT.max_decode_length) -> list[str]:
    """Lines with their line feeds, cut where they exceed ``most`` bytes, between characters."""
    out = []
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        while len(line) * 4 > most and len(data := line.encode("utf-8", "surrogatepass")) > most:
            stop = most
            while stop > 0 and data[stop] & 0xC0 == 0x80:
                stop -= 1
            head = data[:stop].decode("utf-8", "surrogatepass") or line[0]
            out.append(head)
            line = line[len(head) :]
        if line:
            out.append(line)
    return out


def fix_text(text: str, config: TextFixerConfig = DEFAULT) -> str:
    """Every segment fixed on its own; with "auto", entities are decoded up to the first segment with a ``<``."""
    out, angle = [], False
    quiet = config.but(explain=False)
    with_entities, without_entities = quiet.but(unescape_html=True), quiet.but(unescape_html=False)
    for segment in segments(text, config.max_decode_length):
        angle = angle or "<" in segment
        unescape = not angle if config.unescape_html == "auto" else config.unescape_html
        out.append(fix_and_explain(segment, with_entities if unescape else without_entities)[0])
    return "".join(out)


def fix_text_safely(text: str, config: TextFixerConfig = DEFAULT) -> str:
    """:func:`fix_text`, or the text itself where that fails: one text never ends a job."""
    try:
        return fix_text(text, config)
    except Exception:  # whatever it is, the text is better than nothing
        return text


def fix_and_explain_safely(text: str, config: TextFixerConfig = DEFAULT) -> tuple[str, list[str] | None]:
    """:func:`fix_and_explain`, or the text itself and no steps where that fails."""
    try:
        return fix_and_explain(text, config)
    except Exception:  # as above
        return text, None
