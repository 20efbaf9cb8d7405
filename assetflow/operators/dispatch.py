"""Transforms chosen by a row's type."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_type(rows: DataFrame, column: str, transforms: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each type's rows through the transform registered for it; rows of other types, null included, as they are.

    Columns that only some transforms add are null in the other rows.
    """
    others = rows.where(F.col(column).isNull() | ~F.col(column).isin(*transforms)) if transforms else rows
    slices = (f(rows.where(F.col(column) == kind)) for kind, f in transforms.items())
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), slices, others)
