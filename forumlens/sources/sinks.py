"""Writing tables, month files and resumable answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def balanced(df: DataFrame, by: list[str]) -> DataFrame:
    """Files of an even size per partition value; a hot value is split into several, small ones merge."""
    return df.hint("rebalance", *[F.col(c) for c in by])


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    by = partition_by or []
    writer = (balanced(df, by) if by else df).write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return path


def _csv(df: DataFrame):
    return (df.write.mode("errorifexists").option("header", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def write_month_csv(df: DataFrame, path: str, month: str = "source_month", months: list[str] | None = None) -> str:
    """One folder of CSV files per month; blanks at the ends of a field are kept.

    Months of the calendar ``months`` that have no row get a file with the header and nothing else.
    """
    _csv(balanced(df, [month])).partitionBy(month).csv(path)
    if months is not None:
        there = df.sparkSession.read.option("header", True).csv(path).select(F.col(month).cast("string"))
        nothing = df.drop(month).limit(0)
        for row in empty_months(there, months, month).collect():
            _csv(nothing.coalesce(1)).csv(f"{path}/{month}={row[0]}")
    return path


def written_months(spark: SparkSession, path: str, month: str = "source_month") -> DataFrame:
    """The months that have a file, be it one with a header only."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(f"{path}/{month}=*").select("path")
    return files.select(F.regexp_extract("path", f"{month}=([^/]+)/", 1).alias(month)).distinct()


def write_labels(df: DataFrame, path: str) -> str:
    (df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).write.mode("errorifexists")
     .option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path))
    return path


def empty_months(df: DataFrame, months: list[str], month: str = "source_month") -> DataFrame:
    """Months of the calendar without a row: they get a header and nothing else."""
    calendar = df.sparkSession.createDataFrame([(m,) for m in months], f"{month} string")
    return calendar.join(df.select(month).distinct(), month, "left_anti")


def unanswered(work: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Work that has no answer yet; a null in a key equals a null."""
    known = answers.select(*[F.col(k).alias(f"__{k}") for k in keys])
    return work.join(known, reduce(lambda a, b: a & b, [work[k].eqNullSafe(known[f"__{k}"]) for k in keys]), "left_anti")


def append_answers(df: DataFrame, path: str) -> str:
    df.write.mode("append").parquet(path)
    return path


class SettingsError(ValueError):
    """Earlier results were made with other settings."""


def require_setting(stored: DataFrame, column: str, expected: str) -> DataFrame:
    """All stored rows carry the expected setting, such as the current prompt version."""
    other = [r[0] for r in stored.filter(~F.col(column).eqNullSafe(F.lit(expected))).select(column).distinct().limit(5).collect()]
    if other:
        raise SettingsError(f"{column} is {other}, expected {expected!r}")
    return stored


def setting_counts(stored: DataFrame, column: str, expected: str) -> DataFrame:
    """Stored rows per setting, and whether the gate would let them pass."""
    return stored.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).withColumn("current", F.col(column) == expected)


def resume(work: DataFrame, path: str, keys: list[str], make, setting: str, value: str) -> DataFrame:
    """Append the results of the rows that have none yet, and return all results.

    A run that was cut short leaves whole files only, so a second run adds just what is missing.
    """
    spark = work.sparkSession
    todo = work
    try:
        done = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    else:
        todo = unanswered(work, require_setting(done, setting, value), keys)
    append_answers(make(todo).withColumn(setting, F.lit(value)), path)
    return spark.read.parquet(path)
