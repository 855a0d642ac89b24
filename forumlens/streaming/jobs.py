"""Incremental jobs over files that keep arriving.

Every job is a query from a file source to a Parquet sink. Its checkpoint records which files are done, so
a run that was cut short continues and a later run takes only what is new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from forumlens.functions.text import mentions

# state of streaming operators in files next to the executors, backed up to the checkpoint folder
DISK_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_files(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet",
               files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run(stream: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Process everything that is there, append it, stop, and return the whole table."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", DISK_STATE)
    query = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start(table))
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(table)


def keyword_ingest(comments: DataFrame, keyword: str, body: str = "body") -> DataFrame:
    """Comments that use the keyword."""
    return comments.filter(mentions(body, keyword))


def month_end(month: str) -> Column:
    """The first moment behind a month such as 2017-01."""
    return F.add_months(F.to_date(F.concat(F.col(month), F.lit("-01"))), 1).cast("timestamp")


class FirstSeen:
    """Each key of a month once, however late its first row or a copy arrives, with state for open months only.

    A month is open until the newest month seen is ``delay`` ahead. Three jobs run one after the other, each with its own
    progress under ``folder``:

    * rows are routed, batch by batch, by the newest month of the batches before: to the open or to the late ones;
    * open rows are deduplicated in the state store; months behind the watermark, which stands where the router's
      clock stood, are dropped from it. What comes out is the published key table of the month, with Bloom filters;
    * late rows are looked up in the key tables of their months, and what is not there yet is added to them.

    A batch that is run again after a crash overwrites what it wrote. Rows without a month stay open for ever.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, month: str, key: str, delay_days: int = 62):
        self.spark, self.folder, self.schema, self.month, self.key, self.delay = spark, folder, schema, month, key, delay_days
        self.state_rows: list[int] = []

    def _written(self, name: str, schema: StructType, before: int | None = None) -> DataFrame:
        """What the batches of a job have written, or those before one of them."""
        rows = self.spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")
        return rows if before is None else rows.filter(F.col("batch") < before)

    def _write(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(f"{self.folder}/{name}/batch={batch}")

    def _run(self, stream: DataFrame, name: str, handle) -> None:
        query = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{self.folder}/progress-{name}")
                 .trigger(availableNow=True).start())
        query.awaitTermination()

    def route(self, stream: DataFrame) -> None:
        clock_schema = StructType().add("newest", "timestamp")
        for name, schema in (("open", self.schema), ("late", self.schema), ("late_keys", self.schema), ("clock", clock_schema)):
            self._write(self.spark.createDataFrame([], schema), name, -1)     # so that there is something to read

        def handle(rows: DataFrame, batch: int) -> None:
            newest = self._written("clock", clock_schema, batch).agg(F.max("newest")).first()[0]
            end = month_end(self.month)
            is_late = F.lit(False) if newest is None else F.coalesce(end <= F.lit(newest) - F.expr(f"INTERVAL {self.delay} DAYS"), F.lit(False))
            rows.persist()
            try:
                self._write(rows.filter(~is_late), "open", batch)
                self._write(rows.filter(is_late), "late", batch)
                self._write(rows.agg(F.max(end).alias("newest")), "clock", batch)
            finally:
                rows.unpersist()

        self._run(stream.select(*self.schema.names), "route", handle)

    def _read(self, name: str) -> DataFrame:
        return self.spark.readStream.schema(self.schema).option("recursiveFileLookup", True).parquet(f"{self.folder}/{name}")

    def dedupe_open(self) -> None:
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", DISK_STATE)
        timed = self._read("open").withColumn("__end", month_end(self.month)).withWatermark("__end", f"{self.delay} days")
        query = (timed.dropDuplicates([self.month, self.key, "__end"]).drop("__end").writeStream.format("parquet").outputMode("append")
                 .option("checkpointLocation", f"{self.folder}/progress-open").option(f"parquet.bloom.filter.enabled#{self.key}", "true")
                 .partitionBy(self.month).trigger(availableNow=True).start(f"{self.folder}/open_keys"))
        query.awaitTermination()
        self.state_rows += [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]

    def open_keys(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/open_keys")

    def add_late(self) -> None:
        def handle(rows: DataFrame, batch: int) -> None:
            new = rows.dropDuplicates([self.month, self.key]).persist()
            try:
                months = [r[0] for r in new.select(self.month).distinct().collect()]      # late months of a batch: a calendar's worth
                known = self.open_keys().unionByName(self._written("late_keys", self.schema, batch).drop("batch"))
                there = known.filter(F.col(self.month).isin(months)).select(F.col(self.month).alias("__m"), F.col(self.key).alias("__k"))
                same = (F.col(self.month) == F.col("__m")) & F.col(self.key).eqNullSafe(F.col("__k"))
                self._write(new.join(there, same, "left_anti"), "late_keys", batch)
            finally:
                new.unpersist()

        self._run(self._read("late"), "late", handle)

    def run(self, stream: DataFrame) -> DataFrame:
        """Take in everything that is there, and return all first rows."""
        self.route(stream)
        self.dedupe_open()
        self.add_late()
        return self.open_keys().unionByName(self._written("late_keys", self.schema).drop("batch"))


def score_new(comments: DataFrame, label: Callable[[DataFrame], DataFrame], table: str, checkpoint: str,
              answers: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Score rows as they arrive, and return all scores; rows that an earlier table already answers are left out.

    Each batch is a version of its own, named by its number. A batch that is run again, after a crash between
    writing and committing, writes the same version anew, so every row has its scores once."""
    def handle(rows: DataFrame, batch: int) -> None:
        todo = rows if answers is None else rows.join(answers.select(*keys), keys, "left_anti")
        label(todo).write.mode("overwrite").parquet(f"{table}/batch={batch}")

    query = comments.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return comments.sparkSession.read.option("basePath", table).parquet(table).drop("batch")
