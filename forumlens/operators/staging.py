"""Expensive columns that have to be computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, name: str, expression: Column) -> DataFrame:
    """Add a column whose expression is evaluated once per row, where it stands.

    A plain projection is copied into every filter above it, and such a filter is then moved below
    aggregates: a cleaned text that is compared with the empty string would be cleaned twice, the first time
    for rows that are about to be dropped as copies. A one-element explode stays in its place.
    """
    return df.withColumn(name, F.explode(F.array(expression)))
