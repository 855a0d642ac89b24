"""Poll sheets with dates as columns, turned into one row per date and group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens import fixed_values as V
from forumlens.functions.flags import lookup
from forumlens.operators import profile as P

SHARES = ["approve", "disapprove", "not_sure"]
BASES = ["unweighted_base", "base"]


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """A block of text columns as numbers; what is not a number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def sheet_to_rows(wide: DataFrame, group: str, measure: str, dates: list[str], measures: dict[str, str],
                  date_name: str = "date") -> DataFrame:
    """Measures as rows and dates as columns become dates as rows and measures as columns.

    The measures are known, so the second turn is a set of conditional aggregates.
    """
    cells = F.array(*[F.struct(F.lit(d).alias(date_name), F.col(d).alias("__v")) for d in dates])
    long = wide.select(F.col(group).alias("group"), F.trim(F.col(measure)).alias("__m"), F.inline(cells))
    return long.groupBy(date_name, "group").agg(*[
        F.first(F.when(F.col("__m") == raw, F.col("__v")), ignorenulls=True).alias(name)
        for raw, name in measures.items()])


def with_group_type(df: DataFrame, groups: dict = V.POLL_GROUPS, source: str | None = None) -> DataFrame:
    out = df.withColumn("group_type", lookup("group", groups))
    return out if source is None else out.withColumn("source_file", F.lit(source))


def percentages(df: DataFrame, columns: list[str] = SHARES, digits: int = 6) -> DataFrame:
    """Shares as percentages, ties rounded to even."""
    return df.withColumns({c: F.bround(100 * F.col(c), digits) for c in columns})


def coverage(df: DataFrame, period: str, day: str, group: str, month) -> DataFrame:
    return df.groupBy(period).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(day).alias("dates"),
        F.count_distinct(group).alias("groups"), F.count_distinct(month).alias("months"),
        F.min(day).cast("string").alias("first_date"), F.max(day).cast("string").alias("last_date"))


def row_sums(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """How often each total of the shares occurs, in per cent."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in columns])
    return df.groupBy(F.round(100 * total, digits).alias("percentage_total")).agg(F.count(F.lit(1)).alias("rows"))


def share_gates(df: DataFrame, key: list[str], shares: list[str] = SHARES, bases: list[str] = BASES,
                tolerance: float = V.SHARE_TOLERANCE) -> DataFrame:
    """Violations: shares outside 0 to 1, totals off one, empty bases, missing values, repeated keys."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in shares])
    inside = reduce(lambda a, b: a & b, [F.col(c).between(0, 1) for c in shares])
    positive = reduce(lambda a, b: a & b, [F.col(c) > 0 for c in bases])
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*key, *shares, *bases]])
    return P.violations(df, {
        "shares lie in 0 to 1": inside, "shares sum to 1": F.abs(total - 1) <= tolerance,
        "bases are positive": positive, "nothing is missing": present}, {"key is unique": key})
