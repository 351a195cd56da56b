"""Column functions and frame operators against the kernel, text by text."""

import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexmend import chars, functions, kernel
from lexmend.config import DEFAULT, ENCODING_ONLY
from lexmend.operators import bad_lines, badness_by, encodings, explain_column, fix_column, segment_rows, worst

ENTITIES = ["&amp;", "&#x41;", "&#0;", "&#128;", "&SEMI;", "&semi;", "&EACUTE;", "&eacute;", "&#59;", "&#x110000;", "&#xD800;", "&#xffff;", "&notit;", "&#99999999999999;", "&CounterClockwiseContourIntegral;", "&#x;", "&#;", "&#x1F600;", "&SZLIG;", "&frac12;", "&FRAC12;", "&#0065;", "&#12a;"]


def made() -> list[str]:
    rng = random.Random(1)
    alphabet = "".join(chars.CATEGORIES.values()) + chars.CONTINUATION + chars.LEAD_2 + chars.LEAD_3 + chars.LEAD_4 + " \n\r\x1b[0m;?abcZ.<&" + "".join(chars.LIGATURES) + "́̀e가ᄀ\x1a"
    bytes_ = [0x20, 0x1A, 0x3F, 0xC0, 0x80, 0xED, 0xA0, 0xB0, 0xC3, 0xE2, 0xF0, 0x9F, 0x61, 0x71]
    out = ["", "\n", "\n\n", "a\r\nb", "\xc3 quele ", "\xc3  a", "\xc3 la \xc3 b", "\xc3 \xc3 foo", "\xed\xa0\xbd\xed\xb8\x80x", "\xc0\x80", "a &amp; b\nc &lt; <d> &amp;\n e &amp;", "&lt;x\n<", "C O N \xc3 O"]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(1200)]
    out += ["".join(rng.choice([rng.choice(ENTITIES), rng.choice(alphabet), "x"]) for _ in range(rng.randint(1, 8))) for _ in range(250)]
    out += ["".join(chr(rng.choice([*bytes_, rng.randint(0, 255)])) for _ in range(rng.randint(0, 10))) for _ in range(600)]
    for text in ("Größe “schön” — l’été", "Señor, ¿qué tal…? ☃ dÃ©jÃ  vu", "Привет 😀 日本"):
        out += [text, text.encode().decode("latin-1"), "".join(chars.decoded("sloppy-windows-1252")[b] for b in text.encode())]
    return out


TEXTS = made()


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([*enumerate(TEXTS), (-1, None)], "i int, t string").repartition(4).cache()


def check(frame, column, want, only=lambda t: True):
    got = {r["i"]: r["x"] for r in frame.select("i", column.alias("x")).collect()}
    assert got[-1] is None
    wrong = [(t, got[i], want(t)) for i, t in enumerate(TEXTS) if only(t) and got[i] != want(t)]
    assert not wrong, wrong[:3]


FIXERS = dict(kernel.fixers(DEFAULT))


@pytest.mark.parametrize("name", [n for n in FIXERS if n != "normalize"])
def test_fixer(frame, name):
    check(frame, getattr(functions, name)("t"), FIXERS[name])


@pytest.mark.parametrize("form", ["NFC", "NFKC", "NFD", "NFKD"])
def test_normalize(frame, form):
    check(frame, functions.normalize("t", form), lambda t: unicodedata.normalize(form, t))


def test_unescape_html(frame):
    check(frame, functions.unescape_html("t"), kernel.unescape_html)


def test_detection(frame):
    check(frame, functions.is_bad("t"), kernel.is_bad)
    check(frame, functions.badness("t"), kernel.badness)
    check(frame, functions.may_be_bad("t"), lambda t: True, only=lambda t: any(map(kernel.is_bad, kernel.segments(t))))
    check(frame, functions.utf8_runs("t"), lambda t: [m[0] for m in kernel._RUN.finditer(t)])
    check(frame, functions.is_ascii("t"), str.isascii)
    check(frame, functions.is_control_char("t"), lambda t: len(t) == 1 and any(a <= ord(t) <= b for a, b in chars.CONTROLS))


@pytest.mark.parametrize("codec", [*chars.CANDIDATES, *chars.EXTRA_CODECS])
def test_codec(frame, codec):
    def data(text):
        found = kernel.encode(text, codec)
        return None if found is None else found.decode("latin-1")

    if codec != "ascii":
        check(frame, functions.encode("t", codec), data)
    check(frame, functions.possible_encoding("t", codec), lambda t: kernel.possible_encoding(t, codec))
    check(frame, functions.decode("t", codec), lambda t: "".join(chars.decoded(codec)[ord(c)] for c in t), only=lambda t: all(c <= "\xff" for c in t))


def test_bytes(frame):
    latin = lambda t: all(c <= "\xff" for c in t)
    on = lambda f: lambda t: f(t.encode("latin-1")).decode("latin-1")
    check(frame, functions.restore_byte_a0("t"), on(kernel.restore_byte_a0), latin)
    check(frame, functions.replace_lossy_sequences("t"), on(kernel.replace_lossy_sequences), latin)
    check(frame, functions.decode_utf8("t"), lambda t: kernel._strict(t.encode("latin-1")), latin)
    # Where a surrogate stands alone the column function leaves the decision to the kernel.
    lone = lambda t: kernel._SPECIAL.search(t.encode("latin-1").replace(b"\xc0\x80", b"")) is not None
    check(frame, functions.decode_utf8_variants("t"), lambda t: kernel.decode_utf8(t.encode("latin-1")), lambda t: latin(t) and not lone(t))


@pytest.mark.parametrize("most", [1, 3, 1_000_000])
def test_segments(frame, most):
    check(frame, functions.segments("t", most), lambda t: kernel.segments(t, most))


CONFIGS = {
    "default": DEFAULT,
    "encoding only": ENCODING_ONLY,
    "entities": DEFAULT.but(unescape_html=True),
    "no entities": DEFAULT.but(unescape_html=False),
    "NFKC": DEFAULT.but(normalization="NFKC"),
    "NFD": DEFAULT.but(normalization="NFD"),
    "no form": DEFAULT.but(normalization=None),
    "short segments": DEFAULT.but(max_decode_length=7),
    "controls stay": DEFAULT.but(remove_control_chars=False),
    "C1 stay": DEFAULT.but(fix_c1_controls=False),
    "no byte repairs": DEFAULT.but(restore_byte_a0=False, replace_lossy_sequences=False, decode_inconsistent_utf8=False),
}


@pytest.mark.parametrize("name", CONFIGS)
def test_fix_text(frame, name):
    config = CONFIGS[name]
    check(frame, functions.fix_text("t", config), lambda t: kernel.fix_text(t, config))
    out = fix_column(frame.withColumn("_u", F.lit("clash")), "t", config=config)
    assert out.columns == ["i", "t", "_u"]
    got = {r["i"]: r["t"] for r in out.collect()}
    assert got == {i: kernel.fix_text(t, config) for i, t in enumerate(TEXTS)} | {-1: None}


def test_fix_encoding_and_spans(frame):
    check(frame, functions.fix_encoding("t"), lambda t: kernel.fix_text(t, ENCODING_ONLY))
    check(frame, functions.decode_inconsistent_utf8("t"), kernel.decode_inconsistent_utf8)


@pytest.mark.parametrize("explain", [True, False])
def test_explain(frame, explain):
    config = DEFAULT.but(explain=explain)
    got = {r["i"]: r["e"] for r in explain_column(frame, "t", "e", config).collect()}
    assert got.pop(-1) is None
    assert {i: (e["text"], None if e["steps"] is None else [s["transformation"] for s in e["steps"]]) for i, e in got.items()} == {i: kernel.fix_and_explain(t, config) for i, t in enumerate(TEXTS)}


def test_new_column_and_empty_frame(frame):
    out = fix_column(frame.limit(0), "t", "fixed")
    assert out.columns == ["i", "t", "fixed"] and out.count() == 0


def test_a_clean_corpus_needs_no_shuffle(frame, capsys):
    fix_column(frame.select("i", "t"), "t").explain()
    assert "Exchange" not in capsys.readouterr().out.split("InMemoryTableScan")[0]


def test_reports(frame):
    lines = {(r["i"], r["pos"]): r["badness"] for r in bad_lines(frame, "i", "t").collect()}
    want = {(i, p): kernel.badness(s) for i, t in enumerate(TEXTS) for p, s in enumerate(kernel.segments(t)) if kernel.is_bad(s)}
    assert lines == want
    assert segment_rows(frame, "i", "t").count() == sum(len(kernel.segments(t)) for t in TEXTS)
    top = [(r["i"], r["badness"]) for r in worst(frame.filter("i >= 0"), "i", "t", 5).collect()]
    assert top == sorted(((i, kernel.badness(t)) for i, t in enumerate(TEXTS)), key=lambda x: (-x[1], x[0]))[:5]
    total = badness_by(frame.filter("i >= 0").withColumn("k", F.lit(1)), "k", "t").collect()[0]
    assert total["badness"] == sum(map(kernel.badness, TEXTS)) and total["texts"] == len(TEXTS)
    assert {r["codec"]: r["texts"] for r in encodings(frame, "t").collect()}["latin-1"] == sum(all(c <= "\xff" for c in t) for t in TEXTS)


def test_sticky_angle_takes_linear_time(spark):
    long = "a\n" * 10_000 + "b <\n" + "c\n" * 10_000
    texts = ["", "<", "a\nb<\nc", "a\nb", "\n\n<x\n", long, None]
    made = spark.createDataFrame(list(enumerate(texts)), "i int, t string").cache()
    made.select(functions.sticky_angle("t")).filter("i < 5").collect()
    began = time.perf_counter()
    got = {r["i"]: r["x"] for r in made.select("i", functions.sticky_angle("t").alias("x")).collect()}
    assert time.perf_counter() - began < 3
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] is None
            continue
        want, open_ = [], True
        for line in kernel.segments(t):
            open_ = open_ and "<" not in line
            want.append(open_)
        assert got[i] == want
