"""What the operators share: reading tables, folds, and appending columns computed from texts in Arrow batches.

Clashing names: an input column whose name equals an output column (Spark compares names without case) is
replaced by the output. Internal columns start with two underscores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window as W

from forumlens.session import cut_lineage, small_side

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # a batch holds few texts, so that a run of very long ones fits into a worker
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings the operators rely on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def id_fold(key: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; rows without an id are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(col(key).cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def without(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The columns of a table but those called like one of the names, compared as Spark does."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def is_sampled(keys: Sequence[str], bound: int, rows: int, salt: int = 0) -> Column:
    """Whether a row belongs to about ``bound`` of ``rows`` rows (to all where there are fewer), by a hash of some columns."""
    if rows <= bound:
        return F.lit(True)
    return F.pmod(F.xxhash64(*[col(k) for k in keys], F.lit(salt)), F.lit(1 << 40)) < F.lit(int(bound / rows * (1 << 40)))


def hash_sample(df: DataFrame, keys: str | Sequence[str], bound: int, rows: int, salt: int = 0) -> DataFrame:
    """About ``bound`` of ``rows`` rows (all where there are fewer), chosen by a hash of the key columns; the choice is
    the same in every run. If no two rows are equal in all of them, the expected number is the bound and its spread the
    square root of the bound, so callers hash id and text and take equal rows once."""
    return df.filter(is_sampled([keys] if isinstance(keys, str) else keys, bound, rows, salt))


def append_from_texts(df: DataFrame, text: str, fields: Sequence[StructField],
                      compute: Callable[[list[str | None]], list], keep: Sequence[str] | None = None) -> DataFrame:
    """Append columns that are computed from the texts of each Arrow batch.

    ``compute`` gets the texts of a batch, nulls included, and returns one Arrow array or list per field. The
    columns in ``keep`` (all by default) pass through Arrow untouched. One narrow step: no shuffle.
    """
    names = [f.name for f in fields]
    kept = [c for c in without(df, names) if keep is None or c in keep]
    width = len(kept)
    if text in kept and df.schema[text].dataType == StringType():  # the text goes through once
        source, place = df.select(*[col(c) for c in kept]), kept.index(text)
    else:
        source, place = df.select(*[col(c) for c in kept], col(text).cast("string").alias("__text")), width
    schema = StructType([source.schema[c] for c in kept] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            found = compute(batch.column(place).to_pylist())
            arrays = [a if isinstance(a, pa.Array) else pa.array(a, kind) for a, kind in zip(found, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(width)] + arrays, kept + names)

    return source.mapInArrow(run, schema)


def numbered(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """Append the place of every row within its tree (``idx``, from 0) and the rows of the tree (``n``).

    Rows equal in all columns of the order may be in any order: spread by a number of their own, they need no common task."""
    spread = rows.withColumn("__spread", F.monotonically_increasing_id())
    placed = cut_lineage(spread.repartitionByRange(tree, *order, "__spread").sortWithinPartitions(tree, *order).drop("__spread")
                         .withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    runs = placed.groupBy("__part", tree).agg(F.min("__at").alias("__from"), F.count(F.lit(1)).alias("__rows"))
    before = W.partitionBy(tree).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumns({"__start": F.coalesce(F.sum("__rows").over(before), F.lit(0)), "n": F.sum("__rows").over(W.partitionBy(tree))})
    return (placed.join(small_side(runs.drop("__rows")), ["__part", tree])
            .withColumn("idx", F.col("__at") - F.col("__from") + F.col("__start")).drop("__at", "__part", "__from", "__start"))


class Book:
    """Queries of the subpackage and the SQL they are checked against."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict = {}

    def add(self, name: str, sql: str | None = None):
        def register(function):
            def run(spark, sf_dir):
                return function(prepared(spark), sf_dir)
            run.__name__, run.__doc__ = name, function.__doc__
            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return function
        return register


BOOK = Book()
