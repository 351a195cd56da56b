import pytest

from lexmend.config import DEFAULT, TextFixerConfig


def test_defaults():
    assert DEFAULT.unescape_html == "auto" and DEFAULT.normalization == "NFC" and DEFAULT.max_decode_length == 1_000_000 and DEFAULT.explain
    assert len(TextFixerConfig.__dataclass_fields__) == 16


@pytest.mark.parametrize("wrong", [{"unescape_html": "maybe"}, {"unescape_html": 3}, {"normalization": "nfc"}, {"max_decode_length": 0}])
def test_values_that_are_refused(wrong):
    with pytest.raises(ValueError):
        TextFixerConfig(**wrong)


def test_lengths_that_are_refused():
    with pytest.raises(OverflowError):
        TextFixerConfig(max_decode_length=-1)
    with pytest.raises(TypeError):
        TextFixerConfig(max_decode_length=1.5)


def test_changes():
    assert DEFAULT.but(normalization=None).normalization is None and DEFAULT.but(unescape_html=None) == DEFAULT
