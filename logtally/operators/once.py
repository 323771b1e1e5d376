"""A fence for expensive expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, keep: Sequence[str], values: Sequence[Column]) -> DataFrame:
    """``keep`` columns and named ``values``, each value computed exactly once per row.

    A plain projection would not do: the optimizer moves later filters below it and substitutes
    the whole expressions into them, so that a test such as ``reason IS NULL`` would split and
    parse every line again, once per mention. A one-row generator stays in generated code and is
    not crossed by filters on its output.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*values))))
