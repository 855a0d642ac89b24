"""Duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens.functions import flags as G
from forumlens.functions import text as T
from forumlens.operators import dedupe as D
from forumlens.plans import book as B
from forumlens.plans import fixtures as X
from forumlens.session import new_table_path
from forumlens.sources import layout as L

BOOK = B.Book()
add = BOOK.add
REST = "k, submission_id, lang, parent_id, source_month, subreddit, author, author_flair_text, body, score"


@add("e01_first_per_id", X.oracle("cmt", f"SELECT id, created_utc, author, body FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_utc, {REST}) AS rn FROM cmt) WHERE rn = 1"))
def e01(spark, sf_dir):
    """The comments are laid out by address first; choosing and taking rows then moves no text."""
    rows = X.cmt(spark, sf_dir).select("id", "created_utc", "author", "body")
    return D.keep_first_at(L.addressed(rows, new_table_path(spark, "comments")), ["id"], ["created_utc"])


@add("e02_first_per_month_and_id", X.oracle("cmt", f"""
    SELECT source_month, id, created_utc, body FROM (
      SELECT *, row_number() OVER (PARTITION BY source_month, id ORDER BY created_utc, body) AS rn FROM (
        SELECT source_month, CASE WHEN author IS NULL THEN NULL ELSE id END AS id, created_utc, body FROM cmt WHERE {B.sql_mentions('body')}))
    WHERE rn = 1 OR id IS NULL"""))
def e02(spark, sf_dir):
    """Matches once per month and id; rows without an id are all kept."""
    rows = X.cmt(spark, sf_dir).filter(T.mentions("body", B.KEYWORD)).select(
        "source_month", F.when(F.col("author").isNotNull(), F.col("id")).alias("id"), "created_utc", "body")
    return D.keep_first(rows, ["source_month", "id"], ["created_utc"], exempt=D.has_null(["id"]))


# rows that survive the account filter, then one copy per author, thread and raw text
SINGLE = (
    ("people", f"SELECT * FROM cmt WHERE NOT {B.SQL_BOT}"),
    ("single", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY author, submission_id, body ORDER BY created_utc, id) AS rn FROM people)
        WHERE rn = 1 OR coalesce(author = '[deleted]', false)"""),
)


@add("e03_copy_paste", X.oracle("cmt", "SELECT id, created_utc, author, submission_id, body FROM single", *SINGLE))
def e03(spark, sf_dir):
    rows = X.cmt(spark, sf_dir).filter(~G.is_bot_or_moderator()).select("id", "created_utc", "author", "submission_id", "body")
    table = L.addressed(rows, new_table_path(spark, "comments"))
    return D.keep_first_at(table, ["author", "submission_id", "body"], ["created_utc", "id"], exempt=D.is_deleted("author"))


@add("e04_distinct_then_key", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS rn
    FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)) WHERE rn = 1""")
def e04(spark, sf_dir):
    rows = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return D.distinct_then_first(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@add("e05_duplicate_report", X.oracle("cmt sub", """
    SELECT 'comments' AS table_name, count(*) AS rows, count(*) FILTER (WHERE id IS NULL) AS null_ids, count(id) - count(DISTINCT id) AS duplicate_rows FROM cmt
    UNION ALL SELECT 'submissions', count(*), count(*) FILTER (WHERE id IS NULL), count(id) - count(DISTINCT id) FROM sub"""))
def e05(spark, sf_dir):
    return D.duplicate_report(X.cmt(spark, sf_dir), "id", "comments").unionByName(
        D.duplicate_report(X.sub(spark, sf_dir), "id", "submissions"))


@add("e06_duplicate_key_count", "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def e06(spark, sf_dir):
    return D.extra_rows(X.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@add("e07_unique_key_gate", X.oracle("cmt", "SELECT id, count(*) AS n FROM cmt GROUP BY id HAVING count(*) > 1"))
def e07(spark, sf_dir):
    return D.repeated_keys(X.cmt(spark, sf_dir), ["id"])
