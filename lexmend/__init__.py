"""Detection and repair of damaged Unicode text on Spark.

Strings: :func:`fix_text` and :func:`fix_and_explain`. Columns: :mod:`lexmend.functions`. Frames:
:mod:`lexmend.operators`.
"""

from lexmend.config import TextFixerConfig
from lexmend.scalar import ExplainedText, ExplanationStep, fix_and_explain, fix_text

__all__ = ["ExplainedText", "ExplanationStep", "TextFixerConfig", "fix_and_explain", "fix_text"]
