"""Operators on whole frames."""

from lexmend.operators.repair import explain_column, fix_column
from lexmend.operators.reports import bad_lines, badness_by, encodings, segment_rows, worst

__all__ = ["bad_lines", "badness_by", "encodings", "explain_column", "fix_column", "segment_rows", "worst"]
