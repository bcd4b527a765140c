"""Array columns to rows.

A plain generator makes Spark infer a filter on its array, and pushing that
filter down repeats the whole expression that built the array.  The outer forms
infer nothing; the rows they add for empty arrays are removed afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, keep: list, array, name: str) -> DataFrame:
    """One row per non-NULL element."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def inlined(df: DataFrame, keep: list, array, first: str) -> DataFrame:
    """One row per struct element; ``first`` is a field that is never NULL."""
    return df.select(*keep, F.inline_outer(array)).where(F.col(first).isNotNull())
