"""Operators for preparing training text: deduplication, classification, mixing, packing.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames; the
``opN_*`` entries of :mod:`lexmend.llm.queries` are thin views over them.
"""
