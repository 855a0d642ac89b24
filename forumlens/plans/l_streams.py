"""Streaming jobs, each checked against the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens import session
from forumlens.plans import book as B
from forumlens.plans import fixtures as X
from forumlens.plans.k_models import SCORED, label_comments
from forumlens.sources.sinks import write_table
from forumlens.streaming import jobs as J

BOOK = B.Book()
add = BOOK.add


ARRIVALS = 4


def comment_stream(spark, sf_dir, again: str = "false"):
    """Comments whose files arrive in four batches. Every batch has rows of all months, so months and threads
    go on after later ones began; rows that satisfy ``again`` arrive a second time, one batch later."""
    documents = X.table(spark, sf_dir, "documents")
    folder = session.new_table_path(spark, "arrivals")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))
    parts = F.when(F.expr(again), F.array(part, F.pmod(part + 1, F.lit(ARRIVALS)))).otherwise(F.array(part))
    documents.withColumn("arrival", F.explode(parts)).write.partitionBy("arrival").parquet(folder)
    files = len(spark.read.parquet(folder).inputFiles())
    schema = spark.read.parquet(folder).schema
    arriving = J.read_files(spark, folder, schema, files_per_batch=max(1, files // ARRIVALS))
    return X.cmt_from(arriving.drop("arrival"))


def finish(stream, spark, name):
    table = session.new_table_path(spark, name)
    return J.run(stream, table, f"{table}-progress")


@add("l01_incremental_ingest", X.oracle("cmt", f"SELECT id, created_utc, source_month, author, body FROM cmt WHERE {B.sql_mentions('body')}"))
def l01(spark, sf_dir):
    rows = J.keyword_ingest(comment_stream(spark, sf_dir).select("id", "created_utc", "source_month", "author", "body"), B.KEYWORD)
    return finish(rows, spark, "ingest")


@add("l02_stateful_dedupe", X.oracle("cmt", f"SELECT DISTINCT source_month, id FROM cmt WHERE {B.sql_mentions('body')}"))
def l02(spark, sf_dir):
    """A tenth of the rows arrives twice, in different batches; months close while their rows still arrive."""
    rows = J.keyword_ingest(comment_stream(spark, sf_dir, "doc_id % 10 = 3"), B.KEYWORD).select("source_month", "id")
    return J.FirstSeen(spark, session.new_table_path(spark, "first"), rows.schema, "source_month", "id").run(rows)


@add("l03_incremental_scoring", X.oracle("cmt", "SELECT * FROM scored WHERE (id, created_utc) NOT IN (SELECT id, created_utc FROM cmt WHERE subreddit = 'right')", *SCORED))
def l03(spark, sf_dir):
    """One community was answered before; the stream scores the others."""
    done = X.cmt(spark, sf_dir).filter("subreddit = 'right'").select("id", "created_utc")
    path = write_table(done, session.new_table_path(spark, "answered"))
    rows = comment_stream(spark, sf_dir).select("id", "created_utc", "body")
    table = session.new_table_path(spark, "scores")
    return J.score_new(rows, label_comments, table, f"{table}-progress", spark.read.parquet(path), ["id", "created_utc"])
