"""Duplicates: keep-first rules, reports and unique-key gates.

Keeping the first row is an aggregation, not a window: copies collapse on the map side, so a key that
holds a third of the table reaches the reducer as one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens import fixed_values as V
from forumlens.functions.text import flag
from forumlens.sources.layout import ROW


def keep_first(df: DataFrame, key: list[str], order: list[str], exempt: Column | None = None) -> DataFrame:
    """The first row of each key by ``order``; rows equal in all of it are decided by the rest of the row.

    Exempt rows are not copies of anything and all stay. They get a key of their own, the whole row, and
    come back as often as they occurred, so the table is read and shuffled once.
    """
    rest = [c for c in df.columns if c not in key and c not in order]
    if not order + rest:
        return df.distinct()
    payload = F.struct(*[F.col(c) for c in order + rest])

    def columns(source: str) -> list[Column]:
        return [F.col(c) if c in key else F.col(f"{source}.{c}").alias(c) for c in df.columns]

    if exempt is None:
        return df.groupBy(*key).agg(F.min(payload).alias("__first")).select(*columns("__first"))
    groups = df.groupBy(*key, F.when(exempt, payload).alias("__own")).agg(
        F.min(F.when(~exempt, payload)).alias("__first"), F.count(F.lit(1)).alias("__n"))
    copies = F.when(F.col("__own").isNotNull(), F.col("__n")).otherwise(F.lit(1))
    rows = groups.select(*key, F.coalesce("__own", "__first").alias("__row"),
                         F.explode(F.sequence(F.lit(1).cast("bigint"), copies.cast("bigint"))).alias("__copy"))
    return rows.select(*columns("__row"))


def digest(columns: list[str]) -> Column:
    """SHA-256 over some columns, each with its length; equal digests stand for equal values."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
             for c in columns]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def keep_first_at(table: DataFrame, key: list[str], order: list[str], exempt: Column | None = None) -> DataFrame:
    """``keep_first`` on a table with addresses (``sources.layout``): the choice is made on digests of the key, the order and
    the addresses, and the rows are taken by address, so that no text is shuffled or sorted. The wide columns are read
    twice. Rows equal in key and order are decided by a digest of the rest."""
    rest = [c for c in table.columns if c not in key and c not in order and c != ROW]
    narrow = table.select(digest(key).alias("__key"), F.when(F.lit(False) if exempt is None else exempt, F.col(ROW)).alias("__own"),
                          F.struct(*order, digest(rest).alias("__rest") if rest else F.lit(None).alias("__rest"), ROW).alias("__place"))
    first = narrow.groupBy("__key", "__own").agg(F.min("__place").alias("__first"))
    return table.join(first.select(F.col(f"__first.{ROW}")), ROW, "left_semi").drop(ROW)


def has_null(key: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])


def is_deleted(author: str) -> Column:
    """A deleted author stands for many people."""
    return flag(F.col(author) == V.DELETED)


def drop_repeated_posts(df: DataFrame, order: list[str], author="author", thread="submission_id",
                        body="body") -> DataFrame:
    """One copy per author, thread and raw text.

    Rows of deleted authors are never copies; an unknown author counts as one author.
    """
    return keep_first(df, [author, thread, body], order, exempt=is_deleted(author))


def distinct_then_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Whole-row copies out first, then one row per key."""
    return keep_first(df.distinct(), key, order)


def duplicate_report(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows, null keys and rows beyond the first of a key, in one pass."""
    return df.agg(
        F.lit(name).alias("table_name"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(key).isNull()).alias("null_ids"),
        (F.count(F.col(key)) - F.count_distinct(F.col(key))).alias("duplicate_rows"))


def extra_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """How many rows lie beyond the first of their key."""
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.sum(F.col("n") - 1).cast("bigint").alias("duplicate_rows")))


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once; empty when the key is unique."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


class DuplicateKeyError(ValueError):
    """A key that has to be unique is not."""


def require_unique(df: DataFrame, key: list[str], what: str = "table") -> DataFrame:
    """The table itself, or an error that names one repeated key."""
    found = repeated_keys(df, key).first()
    if found is not None:
        raise DuplicateKeyError(f"{what}: {dict(zip(key, found[:len(key)]))} occurs {found['n']} times")
    return df

