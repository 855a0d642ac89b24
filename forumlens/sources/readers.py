"""Reading month files, label files, narrow columns and rows by id."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from forumlens.operators.profile import require_columns
from forumlens.operators.survey import locate

MONTH_IN_PATH = r"[_=](\d{4}-\d{2})(?=[_./])"

def text_schema(columns: list[str]) -> StructType:
    return StructType([StructField(c, StringType(), True) for c in columns])


def read_month_files(spark: SparkSession, pattern: str, schema: StructType, header: bool = True) -> DataFrame:
    """All CSV files of a pattern, quoted fields may hold line ends, an empty field is missing.

    A file with line ends inside fields is read by one task, so a month is best delivered in several
    files and turned into Parquet once.
    """
    try:
        return (spark.read.schema(schema).option("header", header).option("multiLine", True).option("escape", '"')
                .option("nullValue", "").option("emptyValue", None).csv(pattern))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no files match {pattern}") from error
        raise


def source_month(pattern: str = MONTH_IN_PATH) -> Column:
    """The month in the path of the file that a row comes from."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def read_labels(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV of labels: every field is text, an empty field stays an empty string."""
    rows = (spark.read.schema(text_schema(columns)).option("header", True).option("multiLine", True)
            .option("escape", '"').option("emptyValue", "").csv(path))
    return rows.na.fill("")


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A narrow scan: only the named columns are read from the files."""
    df = spark.read.parquet(path)
    return require_columns(df, columns, path).select(*columns)


def rows_with_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is in a list. Spark broadcasts the list, or shuffles both, by its size."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def read_waves(spark: SparkSession, folder: str, names: dict[str, str], available: list[str]) -> dict[str, DataFrame]:
    """One table per wave; the file of a wave is found by its exact or its simplified name."""
    return {wave: spark.read.parquet(f"{folder}/{locate(name, available)}") for wave, name in names.items()}
