"""Regular expressions that Java and the Python kernel share, built from the tables.

All of them are written with four-digit escapes and explicit Unicode properties, which both
engines read alike.
"""

from __future__ import annotations

from lexmend import chars
from lexmend.chars import CATEGORIES

WORD_CHAR = r"\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\p{IsJoin_Control}"
SPACE_CHAR = r"\p{IsWhite_Space}"


def escaped(text: str) -> str:
    return "".join(f"\\u{ord(c):04X}" for c in text)


def char_class(text: str) -> str:
    """A class of the characters, neighbours as ranges."""
    codes, out = sorted({ord(c) for c in text}), []
    while codes:
        n = 1
        while n < len(codes) and codes[n] == codes[0] + n:
            n += 1
        out.append(f"\\u{codes[0]:04X}" + (f"-\\u{codes[n - 1]:04X}" if n > 1 else ""))
        codes = codes[n:]
    return "[" + "".join(out) + "]"


def code_ranges(codes) -> list[tuple[int, int]]:
    """Runs of neighbouring code points."""
    out: list[list[int]] = []
    for code in sorted(codes):
        if out and out[-1][1] == code - 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return [(a, b) for a, b in out]


def one_of(codes, width: int = 8) -> str:
    """A pattern for one of many code points, as a tree.

    Java tries the ranges of a class one after the other. Here a look at the bounds of a group
    comes before the group, so a character that isn't meant costs few tests.
    """
    ranges = codes if isinstance(codes, list) else code_ranges(codes)
    point = lambda c: f"\\u{c:04X}" if c < 0x10000 else f"\\x{{{c:X}}}"
    group = lambda a, b: f"[{point(a)}-{point(b)}]"
    if len(ranges) <= width:
        return "[" + "".join(group(a, b)[1:-1] for a, b in ranges) + "]"
    step = -(-len(ranges) // width)
    parts = [ranges[i : i + step] for i in range(0, len(ranges), step)]
    return "(?:" + "|".join(f"(?={group(p[0][0], p[-1][1])}){one_of(p, width)}" for p in parts) + ")"


def beyond_ascii(codes) -> str:
    """A pattern for one of many code points, none of ASCII. Most characters of Latin text end at its first or second look."""
    low = {c for c in codes if c < 0x300}
    parts = [one_of(low)] if low else []
    parts += [rf"(?=[^\x00-\u02FF]){one_of(set(codes) - low)}"] if set(codes) - low else []
    return rf"(?=[^\x00-\x7F])(?:{'|'.join(parts)})"


# --- Fixed values: sequences of characters that intact text hardly has. Each is a list of sets;
# --- a set names categories, ``=`` brings single characters, and the names below are special.
SPECIAL = {"latin": "A-Za-z", "lower": "a-z", "space": SPACE_CHAR, "word": WORD_CHAR}
_ACCENTED = "lower_accented upper_accented"
_PUNCTUATION = "start_punctuation end_punctuation"
_SIGNS = "box start_punctuation end_punctuation currency numeric law"
SEQUENCES = (
    ("c1",),
    (f"bad {_ACCENTED} {_SIGNS}", "bad"),
    ("latin", "lower_common upper_common", "bad"),
    ("bad", f"{_ACCENTED} {_SIGNS}"),
    ("lower_accented lower_common box end_punctuation currency numeric", "upper_accented"),
    ("box end_punctuation currency numeric", "lower_accented"),
    ("lower_accented box end_punctuation", "currency"),
    ("space", "upper_accented", "currency"),
    ("upper_accented box", "numeric law"),
    (f"{_ACCENTED} box currency end_punctuation", "start_punctuation", "numeric"),
    (f"{_ACCENTED} currency numeric box law", "end_punctuation", "start_punctuation"),
    ("currency numeric box", "start_punctuation"),
    ("lower", "upper_accented", "start_punctuation currency"),
    ("box", "kaomoji"),
    (f"{_ACCENTED} currency numeric {_PUNCTUATION} law", "box"),
    ("box", "end_punctuation"),
    (_ACCENTED, _PUNCTUATION, "word"),
    ("=Œœ", "not latin"),
    ("upper_accented", "=°"),
    ("=ÂÃÎÐ", f"=€œŠš¢£Ÿž\xa0\xad®©°·»–—´ {_PUNCTUATION}"),
    ("=×", "=²³"),
    ("=ØÙ", "common currency bad numeric start_punctuation =ŸŠ®°µ»", "=ØÙ", "common currency bad numeric start_punctuation =ŸŠ®°µ»"),
    ("=à", "=²µ¹¼½¾"),
    ("=√", "=±∂†≠®™´≤≥¥µø"),
    ("=≈", "=°¢"),
    ("=‚", "=Ä", "=ìîïòôúùû†°¢π"),
    ("=‚", "=âó", "=àä°ê"),
    ("=в", "=Ђ"),
    ("=ВГРС", f"c1 bad {_PUNCTUATION} currency =°µ", "=ВГРС"),
    ("=Г", "=ў", "=В", "=Ђ", "=В", "any", "latin blank"),
    ("=Ã", "=\xa0¡"),
    ("lower", "space?", "=ÃÂ", "blank"),
    ("start", "=ÃÂ", "blank"),
    ("lower =.,?! end_punctuation", "=Â", f"blank {_PUNCTUATION}"),
    ("=β", "=€", "=™\xa0Ά\xad®°"),
    ("=ΒΓΞΟ", f"c1 bad {_PUNCTUATION} currency =°", "=ΒΓΞΟ"),
    ("=ā", "=€"),
)


def _set(spec: str, many) -> str:
    if spec == "any":
        return r"[^\n]"
    if spec == "not latin":
        return "[^A-Za-z]"
    if (codes := _codes(spec)) is not None:
        return many(codes)
    out = ""
    for word in spec.split(" "):
        if word.startswith("="):
            out += char_class(word[1:])[1:-1]
        elif word == "blank":
            out += r" "
        else:
            out += SPECIAL.get(word) or char_class(CATEGORIES[word])[1:-1]
    return f"[{out}]"


def _plain(rule: tuple[str, ...], many) -> str:
    return "".join("^" if x == "start" else _set(x[:-1], many) + "?" if x.endswith("?") else _set(x, many) for x in rule)


def _pinned(rule: tuple[str, ...], start: str, many) -> str:
    """The rule with what may be ASCII before its first other character moved into a lookbehind: it matches at that character."""
    if rule[0] == "start":
        return start + _plain(rule[1:], many)
    if rule[:2] == ("lower", "space?"):
        return f"(?<=[a-z]|[a-z]{_set('space', many)})" + _plain(rule[2:], many)
    if rule[0].split(" ")[0] in SPECIAL:
        return f"(?<={_set(rule[0], char_set)})" + _plain(rule[1:], many)
    return _plain(rule, many)


def _rest(rule: tuple[str, ...]) -> tuple[str, ...]:
    """The sets of a rule from the character at which it is pinned."""
    if rule[0] == "start" or rule[0].split(" ")[0] in SPECIAL:
        return rule[2:] if rule[1].endswith("?") else rule[1:]
    return rule


def _codes(spec: str) -> set[int] | None:
    """The characters of a set, or None if it holds ASCII."""
    out: set[int] = set()
    for word in spec.split(" "):
        if word.startswith("="):
            out.update(map(ord, word[1:]))
        elif word in CATEGORIES:
            out.update(map(ord, CATEGORIES[word]))
        else:
            return None
    return out


def _ahead(many) -> str:
    """What every match begins with: a character that is enough, or one that begins some rule before one that may follow there.

    Letters of intact text seldom stand so, and are passed over after a look or two.
    """
    alone, first, second = set(), set(), set()
    for rule in map(_rest, SEQUENCES):
        follows = _codes(rule[1]) if len(rule) > 1 else None
        if follows is None:
            alone |= _codes(rule[0])
        else:
            first |= _codes(rule[0])
            second |= follows
    return f"(?={many(alone)}|{many(first)}{many(second)})"


def char_set(codes) -> str:
    return char_class("".join(map(chr, codes)))


def _sequences(start: str, many) -> str:
    return f"(?=[^\\x00-\\x7F]){_ahead(many)}(?:{'|'.join(_pinned(r, start, many) for r in SEQUENCES)})"


def _counted(many) -> str:
    return rf"(?=[\s\S]{{0,2}}[^\x00-\x7F])(?:{'|'.join(_plain(r, many) for r in SEQUENCES)})"


NON_ASCII = r"[^\x00-\x7F]"
AT_START, AT_LINE = r"(?<![\s\S])", r"(?<![^\n])"
#: Counts: matches from left to right that don't overlap; each has a character beyond ASCII among its first three.
BADNESS = _counted(one_of)
#: Whether there is any, found faster: ASCII characters, and most others, are passed over.
IS_BAD = _sequences(AT_START, one_of)
#: True of a text if any of its lines is bad on its own; sometimes of others.
MAY_BE_BAD = _sequences(AT_LINE, one_of)
#: The same for engines that look up a class at once.
BADNESS_OF_CLASSES, IS_BAD_OF_CLASSES = _counted(char_set), _sequences(AT_START, char_set)
#: The bare rules, without a look ahead.
BADNESS_OF_RULES = "|".join(_plain(r, char_set) for r in SEQUENCES)


def outside(characters) -> str:
    """A pattern of one character beyond ASCII that is not among ``characters``."""
    return rf"(?=[^\x00-\x7F])(?!{one_of({ord(c) for c in characters if ord(c) >= 0x80})})[\s\S]"


#: Runs of characters that look like UTF-8 read with a single-byte codec.
UTF8_RUN = (
    f"(?<!{char_class(chars.STRICT)})(?:{char_class(chars.LEAD_2)}{char_class(chars.CONTINUATION)}"
    f"|{char_class(chars.LEAD_3)}{char_class(chars.CONTINUATION)}{{2}}|{char_class(chars.LEAD_4)}{char_class(chars.CONTINUATION)}{{3}})+"
)

# Patterns on bytes, each written as the character of its number.
# --- Fixed values: UTF-8 in which a blank stands for byte A0, where that is likely.
ALTERED_UTF8 = (
    r"[\xC2\xC3\xC5\xCE\xD0\xD9] "
    r"|[\xE2\xE3] [\x80-\x84\x86-\x9F\xA1-\xBF]"
    r"|[\xE0-\xE3][\x80-\x84\x86-\x9F\xA1-\xBF] "
    r"|\xF0 [\x80-\xBF][\x80-\xBF]"
    r"|\xF0[\x80-\xBF] [\x80-\xBF]"
    r"|\xF0[\x80-\xBF][\x80-\xBF] "
)
# --- Fixed values: what is special about the word "à", UTF-8 variants and terminals.
#: A word "à" whose second byte turned into the blank behind it, and what follows it in other words.
A_GRAVE = r"\xC3 [^ ]* ?"
A_GRAVE_FOLLOWERS = (" ", "quele", "quela", "quilo", "s ")
# --- Fixed values: UTF-8 and CESU-8 with continuation bytes lost to 1A or, once, to a question mark.
LOSSY_UTF8 = (
    r"[\xC2-\xDF]\x1A"
    r"|[\xC2-\xC3]\?"
    r"|\xED[\xA0-\xAF][\x1A?]\xED[\xB0-\xBF][\x1A?\x80-\xBF]"
    r"|\xED[\xA0-\xAF][\x1A?\x80-\xBF]\xED[\xB0-\xBF][\x1A?]"
    r"|[\xE0-\xEF][\x1A?][\x1A\x80-\xBF]"
    r"|[\xE0-\xEF][\x1A\x80-\xBF][\x1A?]"
    r"|[\xF0-\xF4][\x1A?][\x1A\x80-\xBF][\x1A\x80-\xBF]"
    r"|[\xF0-\xF4][\x1A\x80-\xBF][\x1A?][\x1A\x80-\xBF]"
    r"|[\xF0-\xF4][\x1A\x80-\xBF][\x1A\x80-\xBF][\x1A?]"
    r"|\x1A"
)
#: What the decoder of UTF-8 variants treats apart: Java's null, CESU-8 pairs, other surrogates; cut off ones too.
CESU8_PAIR = r"\xED(?:[\xA0-\xAF]|\z)(?:[\x80-\xBF]|\z)(?:\xED|\z)(?:[\xB0-\xBF]|\z)(?:[\x80-\xBF]|\z)"
SPECIAL_BYTES = rf"\xC0(?:\x80|\z)|\xED(?:[\xA0-\xBF]|\z)(?:[\x80-\xBF]|\z)"

#: A control sequence of terminals that ends in a letter.
TERMINAL_ESCAPE = r"\x1B\[[\p{Nd};]*[A-Za-z]"
#: A text that is one control character.
ONE_CONTROL = rf"\A{chars.CONTROL_CLASS}\z"
