"""The kernel on cases made here, and on golden cases where LEXMEND_GOLDEN names a folder with them."""

import json
import os
import unicodedata
from pathlib import Path

import pytest
import regex
from hypothesis import given
from hypothesis import strategies as st

from lexmend import chars, kernel, patterns
from lexmend.config import DEFAULT, ENCODING_ONLY


def through(text: str, *codecs: str) -> str:
    for codec in codecs:
        text = "".join(chars.decoded(codec)[b] for b in text.encode())
    return text


TEXTS = ("Übergrößenträger — “schön”", "Señor Ñandú, ¿qué tal…?", "l’été à la plage", "Привет, мир!", "日本語のテキスト", "naïve café ☕ 😀", "Żółta gęś", "Καλημέρα κόσμε")


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("codec", ["latin-1", "sloppy-windows-1252", "sloppy-windows-1250", "sloppy-windows-1254", "macroman"])
def test_one_layer(text, codec):
    damaged = through(text, codec)
    fixed = kernel.fix_text(damaged, ENCODING_ONLY)
    assert fixed == text or not kernel.is_bad(damaged)


@pytest.mark.parametrize("text", TEXTS[:3])
def test_layers(text):
    assert kernel.fix_text(through(text, "sloppy-windows-1252", "sloppy-windows-1252", "latin-1"), ENCODING_ONLY) == text


@pytest.mark.parametrize(
    ("text", "fixed"),
    [
        ("", ""),
        ("plain", "plain"),
        ("&lt;b&gt;", "<b>"),
        ("<b>&amp;</b>", "<b>&amp;</b>"),
        ("&amp;amp;amp;", "&"),
        ("P&EACUTE;REZ", "PÉREZ"),
        ("&szlig; &SZLIG;", "ß SS"),
        ("&semi;&notit;&#59;", "&semi;&notit;&#59;"),
        ("&#0;&#xD800;&#x110000;", "�" * 3),
        ("&#128;&#x91;", "€'"),
        ("“quoted” ‘text’", "\"quoted\" 'text'"),
        ("ﬁne ﬄ ĳ ŉ", "fine ffl ij 'n"),
        ("ＬＯＵＤ　ﾊﾝｶｸ", "LOUD ハンカク"),
        ("a\r\nb\rc\u2028d\u2029e\x85f", "a\nb\nc\nd\ne…f"),
        ("\x1b[31;1mred\x1b[0m", "red"),
        ("\ufeffbom\x07\x7f\u206a\ufffc", "bom"),
        ("e\u0301", "\xe9"),
        ("â€œ lost â€�", '" lost �'),
        ("voilÃ  le travail", "voilà le travail"),
        ("\xed\xa0\xbd\xed\xb8\x80 cesu", "😀 cesu"),
    ],
)
def test_cases(text, fixed):
    assert kernel.fix_text(text) == fixed


def test_entities_stop_at_the_first_angle():
    assert kernel.fix_text("&amp;\n&lt;<\n&amp;") == "&\n&lt;<\n&amp;"
    assert kernel.fix_and_explain("&amp;\n<")[0] == "&amp;\n<"
    assert kernel.fix_text("<&amp;", DEFAULT.but(unescape_html=True)) == "<&"


def test_steps():
    assert kernel.fix_and_explain("x") == ("x", [])
    assert kernel.fix_and_explain("‘&eacute;’\r")[1] == ["unescape_html", "uncurl_quotes", "fix_line_breaks"]
    assert kernel.fix_and_explain("\x1b[1m\x07é")[1] == ["remove_terminal_escapes", "remove_control_chars", "normalize"]
    # A layer that is taken off leaves no step.
    assert kernel.fix_and_explain("Ã©tÃ©") == ("été", [])
    assert kernel.fix_and_explain("x\r", DEFAULT.but(explain=False)) == ("x\n", None)


def test_surrogates_need_a_pair_behind_them():
    assert kernel.decode_variants(b"\xed\xa0\x80abc") is None
    assert kernel.decode_variants(b"\xc0\x80x") == "\0x" and kernel.decode_variants(b"x\xc0") is None
    assert kernel.decode_variants(b"\xea\xb0\x80") == "가"
    # An odd pair is read if a whole one follows.
    assert kernel.decode_variants(b"\xed\xa0\x80abc\xed\xa0\xbd\xed\xb8\x80") is not None


def test_restore_byte_a0():
    assert kernel.restore_byte_a0(b"\xc3 la") == b"\xc3\xa0 la"
    assert kernel.restore_byte_a0(b"\xc3 quele") == b"\xc3\xa0quele"
    assert kernel.restore_byte_a0(b"\xc3  x") == b"\xc3\xa0 x"
    assert kernel.restore_byte_a0(b"\xc3 \xc3 x") == b"\xc3\xa0 \xc3\xa0x"


def test_holes():
    assert [b for b, c in enumerate(chars.decoded("sloppy-windows-1253")) if c == "�"] == [0x1A, 0xAA, 0xD2, 0xFF]
    assert chars.byte_of("sloppy-windows-1253")["�"] == 0xFF and chars.byte_of("sloppy-windows-1257")["�"] == 0xA5
    assert chars.byte_of("sloppy-windows-1252")["�"] == 0x1A
    assert not kernel.possible_encoding("\x1a", "sloppy-windows-1252") and kernel.possible_encoding("\x1a", "latin-1")


SIZES = {'common': 9, 'c1': 32, 'bad': 20, 'law': 2, 'currency': 5, 'start_punctuation': 13, 'end_punctuation': 6, 'numeric': 25, 'kaomoji': 24, 'upper_accented': 58, 'lower_accented': 52, 'upper_common': 82, 'lower_common': 78, 'box': 45}


def test_class_sizes():
    assert [len(x) for x in (chars.LEAD_2, chars.LEAD_3, chars.LEAD_4, chars.CONTINUATION, chars.STRICT)] == [124, 66, 9, 159, 147]
    assert len(chars.LIGATURES) == 22 and len(chars.WIDTHS) == 226
    assert {k: len(v) for k, v in chars.CATEGORIES.items()} == SIZES and all(len(set(v)) == len(v) for v in chars.CATEGORIES.values())
    assert len(patterns.SEQUENCES) == 37


@given(st.text(alphabet="ab \n<é😀", max_size=40), st.integers(1, 12))
def test_segments_tile(text, most):
    parts = kernel.segments(text, most)
    assert "".join(parts) == text and all(parts)
    assert all(len(p.encode()) <= most or len(p) == 1 for p in parts)
    assert all("\n" not in p[:-1] for p in parts)


@given(st.text(alphabet=st.characters(min_codepoint=0x20, max_codepoint=0x7E, exclude_characters="&"), max_size=60))
def test_ascii_stays(text):
    assert kernel.fix_text(text) == text and not kernel.is_bad(text)


@given(st.text(max_size=40))
def test_never_raises(text):
    fixed = kernel.fix_text(text)
    assert isinstance(fixed, str)
    assert kernel.is_bad(text) == (kernel.badness(text) > 0)


#: A string for each rule in its order, and one that misses it by a character.
RULES = [
    ("a\x81b", "a\xa1b"), ("é¨", "é´"), ("aЖ¨", "aЖб"), ("¨é", "¨a"), ("éÀ", "ÀÉ"), ("€é", "aé"), ("é€", "a€"), (" É€", " É a"), ("É²", "e²"), ("é„²", "a„²"),
    ("é»«", "a»«"), ("€«", "a«"), ("aÉ«", "aÉ"), ("│ò", "│o"), ("é│", "e│"), ("│»", "│a"), ("é»a", "é» a"), ("œ1", "œa"), ("É°", "e°"), ("Ã©", "Ãa"),
    ("×²", "×2"), ("Ø´Ù·", "Ø´a"), ("àµ", "aµ"), ("√±", "√2"), ("≈°", "≈5"), ("‚Äî", "‚Ä"), ("‚âà", "‚â"), ("вЂ", "ва"), ("Р°Р", "РаР"), ("ГўВЂВ™a", "ГўВ"),
    ("Ã\xa0", "Ãb"), ("aÃ b", "aÃb"), ("Ã b", "C Ã b"), (".Â b", "CÂ b"), ("β€™", "βα"), ("Ξ°Ξ", "ΞαΞ"), ("ā€", "āa"),
]


@pytest.mark.parametrize("number", range(37))
def test_rule(number):
    bad, near = RULES[number]
    assert kernel.badness(bad) > 0 and not kernel.is_bad(near) and kernel.badness(near) == 0
    own = regex.compile(patterns._plain(patterns.SEQUENCES[number], patterns.char_set))
    assert own.search(bad) and not own.search(near)


def test_a_failing_kernel_returns_the_text(monkeypatch):
    import lexmend

    def broken(*_):
        raise RuntimeError("broken")

    monkeypatch.setattr(kernel, "segments", broken)
    monkeypatch.setattr(kernel, "fixers", broken)
    assert kernel.fix_text_safely("“x”") == lexmend.fix_text("“x”") == "“x”"
    done = lexmend.fix_and_explain("“x”")
    assert (done.text, done.steps) == ("“x”", None)


def test_normal_forms_of_both_engines_agree(spark):
    """The normaliser of the JVM and Python's know the same characters, or those that one lacks are passed over by both."""
    from pyspark.sql import functions as F

    from lexmend.functions import normalize

    codes = [c for c in range(0x80, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    frame = spark.createDataFrame([("".join(f"x{chr(c)}" for c in codes[i : i + 400]),) for i in range(0, len(codes), 400)], "t string")
    for form in ("NFC", "NFKD"):
        for r in frame.select("t", normalize("t", form).alias("n")).filter(F.col("t") != F.col("n")).collect():
            assert r["n"] == unicodedata.normalize(form, r["t"])


GOLDEN = os.environ.get("LEXMEND_GOLDEN")


@pytest.mark.skipif(not GOLDEN, reason="LEXMEND_GOLDEN is unset")
def test_golden_cases():
    for path in sorted(Path(GOLDEN).glob("*.json")):
        for case in json.loads(path.read_text(encoding="utf-8")):
            text, fixed = case["original"], case["fixed"]
            only = case.get("fixed-encoding", fixed)
            if case["expect"] == "pass":
                assert kernel.fix_text(text) == fixed, case["label"]
                assert kernel.fix_text(text, ENCODING_ONLY) == only, case["label"]
                assert kernel.fix_text(through(text, "latin-1")) == fixed, case["label"]
            else:
                assert kernel.fix_text(text, ENCODING_ONLY) != only, case["label"]


def test_strings():
    import lexmend

    assert lexmend.fix_text("l’Ã©tÃ©") == "l'été" and lexmend.fix_text("“x”", lexmend.TextFixerConfig(uncurl_quotes=False)) == "“x”"
    done = lexmend.fix_and_explain("“x”\r")
    assert done.text == '"x"\n' and [s.transformation for s in done.steps] == ["uncurl_quotes", "fix_line_breaks"]
    assert lexmend.fix_and_explain("x", lexmend.TextFixerConfig(explain=False)).steps is None
