"""Unions, type repair and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens.operators import polls
from forumlens.operators import profile as P
from forumlens.plans import book as B
from forumlens.plans import d_survey as D
from forumlens.plans import fixtures as X

BOOK = B.Book()
add = BOOK.add


@add("b01_union_by_name", X.oracle("cmt sub", """
    SELECT id, created_utc, author, score, body, NULL::DOUBLE AS upvote_ratio, NULL AS title FROM cmt
    UNION ALL SELECT id, created_utc, author, score, NULL, upvote_ratio, title FROM sub"""))
def b01(spark, sf_dir):
    comments = X.cmt(spark, sf_dir).select("id", "created_utc", "author", "score", "body")
    posts = X.sub(spark, sf_dir).select("id", "created_utc", "author", "score", "upvote_ratio", "title")
    return comments.unionByName(posts, allowMissingColumns=True)


@add("b02_union_with_kind", X.oracle("cmt sub", "SELECT 'comment' AS kind, id, subreddit, body AS text FROM cmt UNION ALL SELECT 'submission', id, subreddit, title FROM sub"))
def b02(spark, sf_dir):
    comments = X.cmt(spark, sf_dir).select(F.lit("comment").alias("kind"), "id", "subreddit", F.col("body").alias("text"))
    posts = X.sub(spark, sf_dir).select(F.lit("submission").alias("kind"), "id", "subreddit", F.col("title").alias("text"))
    return comments.unionByName(posts)


MIXED = ["edited", "stickied", "pinned", "author_flair_text", "quarantine"]
MIX = ("mix", """SELECT id, created_utc, edited, CASE WHEN stickied THEN 'True' ELSE 'False' END AS stickied,
    CASE WHEN subreddit = 'main' THEN ' true ' WHEN subreddit = 'ask' THEN 'FALSE' END AS pinned, author_flair_text,
    CASE WHEN subreddit = 'left' THEN '0.0' WHEN subreddit = 'right' THEN 'False' END AS quarantine FROM cmt""")


def mixed(spark, sf_dir):
    place = F.col("subreddit")
    return X.cmt(spark, sf_dir).select(
        "id", "created_utc", "edited", F.when(F.col("stickied"), "True").otherwise("False").alias("stickied"),
        F.when(place == "main", " true ").when(place == "ask", "FALSE").alias("pinned"), "author_flair_text",
        F.when(place == "left", "0.0").when(place == "right", "False").alias("quarantine"))


_KINDS = "count(*) FILTER (WHERE lower(trim({c})) IN ('true', 'false')) AS logical, count(*) FILTER (WHERE lower(trim({c})) NOT IN ('true', 'false') AND try_cast(trim({c}) AS DOUBLE) IS NOT NULL) AS number, count(*) FILTER (WHERE lower(trim({c})) NOT IN ('true', 'false') AND try_cast(trim({c}) AS DOUBLE) IS NULL) AS other_text, count(*) - count({c}) AS nulls"


@add("b03_mixed_types", X.oracle("cmt", "SELECT *, CASE WHEN logical + number + other_text = 0 THEN 'none' WHEN number + other_text = 0 THEN 'boolean' ELSE 'string' END AS repair FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {_KINDS.format(c=c)} FROM mix" for c in MIXED) + ")", MIX))
def b03(spark, sf_dir):
    return P.mixed_types(mixed(spark, sf_dir), MIXED)


@add("b04_type_repair", X.oracle("cmt", "SELECT id, created_utc, edited, lower(trim(stickied)) = 'true' AS stickied, lower(trim(pinned)) = 'true' AS pinned, author_flair_text, quarantine FROM mix", MIX))
def b04(spark, sf_dir):
    return P.repair_types(mixed(spark, sf_dir), MIXED)


@add("b05_keep_list", X.oracle("cmt", "SELECT id, submission_id, created_utc, author, body, 16 AS columns, 5 AS kept, 11 AS dropped FROM cmt"))
def b05(spark, sf_dir):
    kept, counts = P.keep_columns(X.cmt(spark, sf_dir), ["id", "submission_id", "created_utc", "author", "body"], "comments")
    return kept.select("*", *[F.lit(v).alias(k) for k, v in counts.items()])


@add("b06_rename", X.oracle("thr_cmt", "SELECT submission_id AS post_id, id AS comment_id, comment AS text FROM thr_cmt"))
def b06(spark, sf_dir):
    names = {"submission_id": "post_id", "id": "comment_id", "comment": "text"}
    return X.thr_cmt(spark, sf_dir).withColumnsRenamed(names).select(*names.values())


@add("b07_narrow_casts", X.oracle("cmt", "SELECT id, created_utc, CAST(score AS INTEGER) AS score, CAST(controversiality AS TINYINT) AS controversiality, CAST(substr(source_month, 1, 4) AS SMALLINT) AS year FROM cmt"))
def b07(spark, sf_dir):
    return X.cmt(spark, sf_dir).select(
        "id", "created_utc", F.col("score").cast("int").alias("score"), F.col("controversiality").cast("tinyint").alias("controversiality"),
        F.substring("source_month", 1, 4).cast("smallint").alias("year"))


TEXTUAL = ("textual", "SELECT grp, measure, CAST(d1995 AS VARCHAR) AS d1995, CASE WHEN measure = 'P' THEN 'n/a' ELSE d1996 || '.5' END AS d1996, CAST(d1997 AS VARCHAR) AS d1997 FROM poll_wide")


@add("b08_numeric_block", X.oracle("poll_wide", "SELECT grp, measure, " + ", ".join(f"try_cast({c} AS DOUBLE) AS {c}" for c in ("d1995", "d1996", "d1997")) + " FROM textual", TEXTUAL))
def b08(spark, sf_dir):
    text = X.poll_wide(spark, sf_dir).select(
        "grp", "measure", F.col("d1995").cast("string").alias("d1995"),
        F.when(F.col("measure") == "P", "n/a").otherwise(F.concat(F.col("d1996").cast("string"), F.lit(".5"))).alias("d1996"),
        F.col("d1997").cast("string").alias("d1997"))
    return polls.numbers(text, ["d1995", "d1996", "d1997"])


@add("b09_sheet_to_rows", D.poll_sql('SELECT sheet_date, "group", ' + ", ".join(f"max(CASE WHEN measure = '{m}' THEN v END) AS {n}" for m, n in D.MEASURES.items()) + ", 'priority' AS group_type, 'orders' AS source_file FROM (SELECT sheet_date, grp AS \"group\", measure, v FROM cells) GROUP BY 1, 2"))
def b09(spark, sf_dir):
    rows = polls.sheet_to_rows(X.poll_wide(spark, sf_dir), "grp", "measure", D.DATES, D.MEASURES, "sheet_date")
    groups = {g: "priority" for g in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")}
    return polls.with_group_type(rows, groups, "orders")


@add("b10_percentages", D.poll_sql('SELECT sheet_date, "group", ' + ", ".join(f"round_even(100 * {c}, 6) AS {c}" for c in polls.SHARES) + " FROM poll"))
def b10(spark, sf_dir):
    return polls.percentages(D.poll_rows(spark, sf_dir)).select("sheet_date", "group", *polls.SHARES)


@add("b11_reorder_and_sort", D.poll_sql('SELECT "group", sheet_date, base, approve FROM poll ORDER BY 1, 2'))
def b11(spark, sf_dir):
    return D.poll_rows(spark, sf_dir).select("group", "sheet_date", "base", "approve").orderBy("group", "sheet_date")
