"""Vectors as whole numbers: which rows can be used, and Arrow lists as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from forumlens.llm.common import col

SCALE = 1024
LARGEST = float(1 << 52)     # beyond it, SCALE times a component does not fit into a long


def as_list(df: DataFrame, vector: str) -> Column:
    """The vector in its own width of four bytes a component, or as doubles."""
    kind = df.schema[vector].dataType
    narrow = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    return col(vector) if narrow else col(vector).cast("array<double>")


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and holds finite components only (of a size that fits into a long)."""
    components = as_list(df, vector)
    return df.filter(components.isNotNull() & F.forall(components, lambda x: x.isNotNull() & (F.abs(x) < F.lit(LARGEST))))


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(1024 x) for every component, as doubles that hold whole numbers."""
    return np.floor(SCALE * values.astype(np.float64))


def by_length(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix of the components) for every length that occurs; lists hold no nulls."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = lists.offsets.to_numpy()
    values, lengths = lists.flatten().to_numpy(zero_copy_only=False), np.diff(offsets)
    starts = offsets[:-1] - offsets[0]
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield length, rows, values[starts[rows][:, None] + np.arange(length)]
