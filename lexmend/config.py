"""Options of the text fixer, checked when they are made and resolved when a plan is built."""

from __future__ import annotations

from dataclasses import dataclass, replace

NORMAL_FORMS = ("NFC", "NFKC", "NFD", "NFKD")


@dataclass(frozen=True)
class TextFixerConfig:
    """Which fixers run.

    ``unescape_html``: True, False or "auto" (only up to the first line with a ``<``).
    ``normalization``: one of NFC, NFKC, NFD, NFKD, or None.
    ``max_decode_length``: most bytes of a segment; at least 1.
    ``fix_surrogates`` is accepted for compatibility: strings of Spark hold no lone surrogates.
    ``explain``: whether :func:`fix_and_explain` records steps.
    """

    unescape_html: bool | str = "auto"
    remove_terminal_escapes: bool = True
    fix_encoding: bool = True
    restore_byte_a0: bool = True
    replace_lossy_sequences: bool = True
    decode_inconsistent_utf8: bool = True
    fix_c1_controls: bool = True
    fix_latin_ligatures: bool = True
    fix_character_width: bool = True
    uncurl_quotes: bool = True
    fix_line_breaks: bool = True
    fix_surrogates: bool = True
    remove_control_chars: bool = True
    normalization: str | None = "NFC"
    max_decode_length: int = 1_000_000
    explain: bool = True

    def __post_init__(self) -> None:
        if self.unescape_html is None:
            object.__setattr__(self, "unescape_html", "auto")
        elif not isinstance(self.unescape_html, bool) and self.unescape_html != "auto":
            raise ValueError(f"unescape_html must be True, False or 'auto', not {self.unescape_html!r}")
        if self.normalization is not None and self.normalization not in NORMAL_FORMS:
            raise ValueError(f"normalization must be one of {', '.join(NORMAL_FORMS)} or None, not {self.normalization!r}")
        if isinstance(self.max_decode_length, bool) or not isinstance(self.max_decode_length, int):
            raise TypeError("max_decode_length must be an integer")
        if self.max_decode_length < 0:
            raise OverflowError("max_decode_length can't be negative")
        if self.max_decode_length == 0:
            raise ValueError("max_decode_length must be at least 1")

    def but(self, **changes) -> TextFixerConfig:
        return replace(self, **changes)


DEFAULT = TextFixerConfig()

#: Only the repair of wrongly decoded text.
ENCODING_ONLY = TextFixerConfig(
    unescape_html=False,
    remove_terminal_escapes=False,
    fix_latin_ligatures=False,
    fix_character_width=False,
    uncurl_quotes=False,
    fix_line_breaks=False,
    remove_control_chars=False,
    normalization=None,
)
