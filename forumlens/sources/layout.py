"""Tables laid out so that rows are found again without moving them.

*Addresses.* Every row of an addressed table has a number of its own (``__row``), by which the table is bucketed and sorted.
What is decided on narrow columns, such as which copy of a text stays, is brought back to the wide rows by that number: the
narrow side is exchanged into the buckets, the wide scan is merged as it stands, and no text is shuffled. Addresses spread
evenly whatever the keys are. Laying a table out costs one exchange of its rows, once.

*Columns by version.* New columns of an addressed table are tables of their own with the same buckets, so adding a column
writes that column only, and reading merges the versions it needs, bucket by bucket. A version is announced by a
one-row file after its checks; until then readers find the ones before.

*Order by key.* A table in key order, with the ranges and Bloom filters that Parquet keeps per row group and page, is read
by a list of keys without looking at most of it.

Numbers are given to rows as they are read, so rows should come from files, or be settled first (``session.cut_lineage``).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROW = "__row"
LIST_KEYS = 10_000       # keys that are pushed into the scan as a list; more are joined, within their range


class Bucketed(NamedTuple):
    """Where a bucketed table is and what has to be known to open it."""
    path: str
    columns: str
    key: str
    buckets: int


def _columns(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def write_bucketed(df: DataFrame, path: str, key: str = ROW, buckets: int | None = None) -> Bucketed:
    """Write one sorted file per bucket. By default there are as many buckets as shuffle partitions, as a join with
    fewer would be exchanged once more."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bucketed_{uuid.uuid4().hex}"
    (df.repartition(n, key).write.mode("errorifexists").format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name))
    spark.sql(f"DROP TABLE {name}")      # the files stay; the catalog of a session forgets them anyway
    return Bucketed(path, _columns(df.schema), key, n)


def open_bucketed(spark: SparkSession, table: Bucketed) -> DataFrame:
    name = f"bucketed_{uuid.uuid4().hex}"
    place = table.path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({table.columns}) USING parquet CLUSTERED BY (`{table.key}`) SORTED BY (`{table.key}`) "
              f"INTO {table.buckets} BUCKETS LOCATION '{place}'")
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def addressed(df: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """Lay a table out by address, and open it."""
    return open_bucketed(df.sparkSession, write_bucketed(df.withColumn(ROW, F.monotonically_increasing_id()), path, ROW, buckets))


# --- columns by version ---------------------------------------------------------------------------------
class PublishError(ValueError):
    """New columns do not fit the table they belong to."""


VERSIONS = "versions"
_RECORD = "version int, path string, columns string, key string, buckets int, rows long"


def versions(spark: SparkSession, root: str) -> list[tuple[int, Bucketed, int]]:
    """(version, table, rows) of every announced version, in order."""
    found = spark.read.schema(_RECORD).parquet(f"{root}/{VERSIONS}").collect()
    return sorted((r.version, Bucketed(f"{root}/{r.path}", r.columns, r.key, r.buckets), r.rows) for r in found)


def _announce(spark: SparkSession, root: str, version: int, name: str, table: Bucketed, rows: int) -> None:
    row = (version, name, table.columns, table.key, table.buckets, rows)
    spark.createDataFrame([row], _RECORD).coalesce(1).write.mode("append").parquet(f"{root}/{VERSIONS}")


def start_table(df: DataFrame, root: str, buckets: int | None = None) -> str:
    """The first version of a table that will get more columns."""
    spark = df.sparkSession
    table = write_bucketed(df.withColumn(ROW, F.monotonically_increasing_id()), f"{root}/v0", ROW, buckets)
    _announce(spark, root, 0, "v0", table, open_bucketed(spark, table).count())
    return root


def current(spark: SparkSession, root: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The table with its columns of all versions, or with some of them; versions without any of these are not read.

    ``__row`` is returned if it is asked for."""
    parts = [open_bucketed(spark, table) for _, table, _ in versions(spark, root)]
    wanted = [c for part in parts for c in part.columns if c != ROW] if columns is None else list(columns)
    chosen = [part.select(ROW, *[c for c in part.columns if c in wanted and c != ROW]) for part in parts]
    read = [part for part in chosen if len(part.columns) > 1] or chosen[:1]
    missing = set(wanted) - {ROW} - {c for part in read for c in part.columns}
    if missing:
        raise PublishError(f"no version has {sorted(missing)}")
    return reduce(lambda a, b: a.join(b, ROW), read).select(*wanted)


def publish(added: DataFrame, root: str) -> dict:
    """Write new columns, one value per address, as a version of their own, check it, and announce it.

    Every address of the table must be there once, and no column may be there already. Nothing that was written before
    is read but the addresses; a version that failed its checks is never announced."""
    spark = added.sparkSession
    known = versions(spark, root)
    old = {c for _, table, _ in known for c in open_bucketed(spark, table).columns} - {ROW}
    if ROW not in added.columns or old & set(added.columns) or len(added.columns) < 2:
        raise PublishError(f"columns are {added.columns}")
    version, (_, base, rows) = known[-1][0] + 1, known[0]
    name = f"v{version}-{uuid.uuid4().hex[:8]}"      # a failed attempt leaves a folder that nobody reads
    table = write_bucketed(added, f"{root}/{name}", ROW, base.buckets)
    new = open_bucketed(spark, table)
    other = (open_bucketed(spark, base).select(ROW, F.lit(1).alias("__n")).unionByName(new.select(ROW, F.lit(-1).alias("__n")))
             .groupBy(ROW).agg(F.sum("__n").alias("__n")).filter("__n <> 0").first())
    if other is not None:
        raise PublishError(f"address {other[0]} does not have one value")
    _announce(spark, root, version, name, table, rows)
    return {"rows": rows, "columns": len(old) + len(added.columns) - 1, "version": version}


# --- order by key -----------------------------------------------------------------------------------------
def write_by_key(df: DataFrame, path: str, key: str, group_bytes: int | None = None, page_rows: int | None = None) -> str:
    """Write a table in the order of a key, with Bloom filters on it. Rows of one key may stand in several files."""
    ranges = df.repartitionByRange(F.col(key), F.monotonically_increasing_id())     # a hot key is cut, too
    writer = ranges.sortWithinPartitions(key).write.mode("errorifexists").option(f"parquet.bloom.filter.enabled#{key}", "true")
    for name, value in (("parquet.block.size", group_bytes), ("parquet.page.row.count.limit", page_rows)):
        writer = writer if value is None else writer.option(name, value)
    writer.parquet(path)
    return path


def rows_of_keys(spark: SparkSession, path: str, columns: Sequence[str], ids: DataFrame, key: str, most: int = LIST_KEYS) -> DataFrame:
    """Rows of a table in key order whose key is in a list.

    A list of up to ``most`` keys becomes a filter of the scan, which skips row groups and pages by their ranges and
    Bloom filters; for a longer one the scan is cut to its range and joined. Null keys match nothing."""
    rows = spark.read.parquet(path)
    wanted = ids.select(F.col(key).alias(key)).filter(F.col(key).isNotNull()).distinct()
    few = [r[0] for r in wanted.limit(most + 1).collect()]
    if len(few) <= most:
        return rows.filter(F.col(key).isin(few)).select(*columns) if few else rows.limit(0).select(*columns)
    low, high = wanted.agg(F.min(key), F.max(key)).first()
    return rows.filter(F.col(key).between(low, high)).join(wanted, key, "left_semi").select(*columns)
