"""Row numbers inside large groups without sorting a group in one task.

A hash rank is uniform, so its first hexadecimal digits cut every group into buckets of equal size. The
position of a row is the number of rows in earlier buckets plus its position inside its own bucket. The
bucket table has at most ``16 ** digits`` rows per group, however large the group is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from forumlens import fixed_values as V
from forumlens.session import small_side

DIGITS = 4


def hash_rank(key: Column | str, seed: int = V.SEED) -> Column:
    """Sixteen hexadecimal digits of SHA-256 over ``seed:key``: the same order on every machine."""
    k = F.col(key) if isinstance(key, str) else key
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), k), 256), 1, 16)


def _same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs])


def attach(left: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """Left join on keys that may be null."""
    if not by:
        raise ValueError("attach needs at least one key")
    renamed = small.withColumnsRenamed({c: f"__k_{c}" for c in by})
    joined = left.join(renamed, _same(left, renamed, [(c, f"__k_{c}") for c in by]), "left")
    return joined.drop(*[f"__k_{c}" for c in by])


def bucket(rank: str, digits: int = DIGITS) -> Column:
    return F.substring(F.col(rank), 1, digits)


def group_row_numbers(df: DataFrame, by: list[str], rank: str, out: str, ties: list[str] | None = None,
                      digits: int = DIGITS) -> DataFrame:
    """1, 2, 3 and so on by ``rank`` inside each group of ``by`` (the whole table when ``by`` is empty).

    Group and bucket are one struct, in which nulls are equal, so the join and the window share one shuffle.
    """
    ties = ties or []
    rows = df.withColumn("__cell", F.struct(*by, bucket(rank, digits).alias("__bucket")))
    counts = rows.groupBy("__cell").agg(F.count(F.lit(1)).alias("__n"))
    earlier = (W.partitionBy(*[F.col("__cell").getField(c) for c in by])
               .orderBy(F.col("__cell.__bucket")).rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("__cell", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    inside = W.partitionBy("__cell").orderBy(rank, *ties)
    joined = rows.join(starts, "__cell")
    return joined.withColumn(out, F.col("__start") + F.row_number().over(inside)).select(*df.columns, out)


def group_sizes(df: DataFrame, by: list[str], out: str = "n") -> DataFrame:
    """One row per group; hot groups shrink before the shuffle."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def with_group_sizes(df: DataFrame, by: list[str], out: str) -> DataFrame:
    """The size of its group on every row: counted, then joined, so no group is gathered in one task."""
    return attach(df, small_side(group_sizes(df, by, out)), by)


def global_row_numbers(df: DataFrame, by: list[str], rank: str, out: str,
                       ties: list[str] | None = None) -> DataFrame:
    """Row numbers over the order (group, rank): groups before this one plus the position inside it.

    Only the table of groups, one row each, is ordered as a whole.
    """
    sizes = group_sizes(df, by, "__size")
    before = W.orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*by, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    placed = attach(group_row_numbers(df, by, rank, "__inside", ties), small_side(starts), by)
    return placed.withColumn(out, F.col("__before") + F.col("__inside")).drop("__before", "__inside")


def alternate(df: DataFrame, by: list[str], rank: str, parts: int, out: str,
              ties: list[str] | None = None) -> DataFrame:
    """Parts 1 to ``parts`` in turn over the rows ordered by group, so each part gets the same mix."""
    numbered = global_row_numbers(df, by, rank, "__row", ties)
    return numbered.withColumn(out, F.pmod(F.col("__row") - 1, F.lit(parts)) + 1).drop("__row")


def first_per_group(df: DataFrame, by: list[str], rank: str, limits: DataFrame, limit: str,
                    ties: list[str] | None = None, out: str = "__position") -> DataFrame:
    """The ``limit`` smallest ranks of each group, where ``limits`` has one row per group.

    A bucket count tells in which bucket each group's last row lies. Rows behind it are dropped where
    they are read, so only about as many rows are shuffled as are taken.
    """
    ties = ties or []
    rows = df.withColumn("__bucket", bucket(rank))
    counts = rows.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy(*by).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    wanted = limits.select(*by, F.col(limit).alias("__limit"))
    cuts = (attach(starts, wanted, by).filter(F.col("__start") < F.col("__limit"))
            .groupBy(*by).agg(F.max("__bucket").alias("__cut"), F.max("__limit").alias("__limit")))
    kept = attach(rows, small_side(cuts), by).filter(F.col("__bucket") <= F.col("__cut"))
    numbered = kept.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(rank, *ties)))
    return numbered.filter(F.col(out) <= F.col("__limit")).drop("__bucket", "__cut", "__limit")
