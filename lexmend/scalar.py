"""The repair of single strings, outside of Spark."""

from __future__ import annotations

from dataclasses import dataclass

from lexmend import kernel
from lexmend.config import DEFAULT, TextFixerConfig


@dataclass(frozen=True)
class ExplanationStep:
    transformation: str


@dataclass(frozen=True)
class ExplainedText:
    """A repaired text and the steps taken; steps are None if they were not asked for."""

    text: str
    steps: tuple[ExplanationStep, ...] | None


def fix_text(text: str, config: TextFixerConfig | None = None) -> str:
    """The text repaired segment by segment; the text itself if that should fail."""
    return kernel.fix_text_safely(text, config or DEFAULT)


def fix_and_explain(text: str, config: TextFixerConfig | None = None) -> ExplainedText:
    """The text repaired as one segment, and the steps taken; the text itself and None if that should fail."""
    fixed, steps = kernel.fix_and_explain_safely(text, config or DEFAULT)
    return ExplainedText(fixed, None if steps is None else tuple(map(ExplanationStep, steps)))
