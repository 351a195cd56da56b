"""Repair of whole frames.

The plan has no shuffle. A text that no fixer can change, by a cheap test, stays in the JVM; every other one
goes to the kernel, which sees null for the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmend.config import DEFAULT, TextFixerConfig
from lexmend.functions import repair


def fix_column(df: DataFrame, column: str = "text", output: str | None = None, config: TextFixerConfig = DEFAULT) -> DataFrame:
    """``df`` with the repaired texts of ``column`` in ``output`` (the same column if unset)."""
    names = [f"_lexmend_{i}" for i in range(len(df.columns))]
    fixed = repair.fix_text(names[df.columns.index(column)], config).alias(output or column)
    kept = [F.col(n).alias(c) for c, n in zip(df.columns, names, strict=True) if c != (output or column)]
    out = df.toDF(*names).select(*kept, fixed)
    return out.select(*df.columns) if (output or column) in df.columns else out


def explain_column(df: DataFrame, column: str = "text", output: str = "explained", config: TextFixerConfig = DEFAULT) -> DataFrame:
    """``df`` with a struct of the text, fixed as one segment, and the steps taken."""
    return df.withColumn(output, repair.fix_and_explain(column, config))
