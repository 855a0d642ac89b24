"""Positions, stratum sizes, bins and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens.functions import text as T
from forumlens.operators import dedupe, profile
from forumlens.operators import ranking as R
from forumlens.operators.quantiles import quartile_labels
from forumlens.plans import book as B
from forumlens.session import cut_lineage
from forumlens.plans import fixtures as X

BOOK = B.Book()
add = BOOK.add
STRATA = ["subreddit", "source_month"]

# comments that use the keyword, once per id
CAND = ("cand", f"""SELECT *, substr(sha256('42:' || id), 1, 16) AS rank FROM (SELECT id, min(subreddit) AS subreddit, min(source_month) AS source_month, min(created_utc) AS created_utc
    FROM cmt WHERE {B.sql_mentions('body')} GROUP BY id)""")


def candidates(spark, sf_dir):
    """Comments that use the keyword, once per id, without their text."""
    rows = X.cmt(spark, sf_dir).filter(T.mentions("body", B.KEYWORD)).select("id", *STRATA, "created_utc")
    return dedupe.keep_first(rows, ["id"], ["created_utc"])


def ranked(spark, sf_dir):
    """Written once: the positions look at the rows twice, and the keyword search is not repeated."""
    return cut_lineage(candidates(spark, sf_dir).withColumn("rank", R.hash_rank("id")))


def cand_sql(body: str, *more) -> str:
    return X.oracle("cmt", body, CAND, *more)


@add("h01_rank_in_stratum", cand_sql("SELECT id, row_number() OVER (PARTITION BY subreddit, source_month ORDER BY rank) AS position FROM cand"))
def h01(spark, sf_dir):
    return R.group_row_numbers(ranked(spark, sf_dir), STRATA, "rank", "position", ["id"]).select("id", "position")


_PARTS = ("parts", "SELECT *, (row_number() OVER (ORDER BY subreddit, source_month, rank) - 1) % 2 + 1 AS part FROM cand")


@add("h02_order_in_part", cand_sql("SELECT id, part, row_number() OVER (PARTITION BY part ORDER BY rank) AS \"order\" FROM parts", _PARTS))
def h02(spark, sf_dir):
    parts = cut_lineage(R.alternate(ranked(spark, sf_dir), STRATA, "rank", 2, "part", ["id"]))
    return R.group_row_numbers(parts, ["part"], "rank", "order", ["id"]).select("id", "part", "order")


@add("h03_alternating_parts", cand_sql("SELECT subreddit, part, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT *, (row_number() OVER (ORDER BY subreddit, source_month, rank) - 1) % 3 + 1 AS part FROM cand) GROUP BY 1, 2"))
def h03(spark, sf_dir):
    parts = R.alternate(ranked(spark, sf_dir), STRATA, "rank", 3, "part", ["id"])
    return parts.groupBy("subreddit", "part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@add("h04_stratum_size", cand_sql("SELECT id, count(*) OVER (PARTITION BY subreddit, source_month) AS stratum_size FROM cand"))
def h04(spark, sf_dir):
    return R.with_group_sizes(ranked(spark, sf_dir), STRATA, "stratum_size").select("id", "stratum_size")


@add("h05_quartile_bins", X.oracle("cmt", f"""
    SELECT label, count(*) AS n, min(words) AS low, max(words) AS high FROM (
      SELECT words, CASE WHEN words <= q1 THEN CAST(q0 AS BIGINT) || '-' || CAST(floor(q1) AS BIGINT) || ' words' WHEN words <= q2 THEN CAST(floor(q1) AS BIGINT) + 1 || '-' || CAST(floor(q2) AS BIGINT) || ' words'
        WHEN words <= q3 THEN CAST(floor(q2) AS BIGINT) + 1 || '-' || CAST(floor(q3) AS BIGINT) || ' words' ELSE CAST(floor(q3) AS BIGINT) + 1 || '-' || CAST(floor(q4) AS BIGINT) || ' words' END AS label
      FROM w, (SELECT min(words) AS q0, quantile_cont(words, 0.25) AS q1, quantile_cont(words, 0.5) AS q2, quantile_cont(words, 0.75) AS q3, max(words) AS q4 FROM w)) GROUP BY 1""",
    ("w", f"SELECT {B.sql_words('body')} AS words FROM cmt")))
def h05(spark, sf_dir):
    words = cut_lineage(X.cmt(spark, sf_dir).select(T.word_count("body").alias("words")))
    binned = quartile_labels(words, "words", "label", "words")
    return binned.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("words").alias("low"), F.max("words").alias("high"))


@add("h06_time_order", X.oracle("cmt", "SELECT id, created_utc, source_month FROM cmt ORDER BY created_utc, id"))
def h06(spark, sf_dir):
    return X.cmt(spark, sf_dir).select("id", "created_utc", "source_month").orderBy("created_utc", "id")


@add("h07_confident_errors", X.oracle("rate", "SELECT id, final, model_a, p_pro FROM rate WHERE final <> model_a ORDER BY p_pro DESC, id LIMIT 20"))
def h07(spark, sf_dir):
    wrong = X.rate(spark, sf_dir).filter("final <> model_a")
    return wrong.select("id", "final", "model_a", "p_pro").orderBy(F.desc("p_pro"), "id").limit(20)


@add("h08_fixed_order", X.oracle("cmt", "SELECT CAST(p AS INTEGER) AS position, subreddit, coalesce(n, 0) AS n FROM (VALUES (1, 'right'), (2, 'left'), (3, 'none'), (4, 'ask'), (5, 'main')) v(p, subreddit) LEFT JOIN (SELECT subreddit, count(*) AS n FROM cmt GROUP BY 1) USING (subreddit) ORDER BY p"))
def h08(spark, sf_dir):
    counts = R.group_sizes(X.cmt(spark, sf_dir), ["subreddit"])
    return profile.fixed_order(counts, "subreddit", ["right", "left", "none", "ask", "main"], {"n": 0}).orderBy("position")


@add("h09_first_per_key", X.oracle("svy_raw", "SELECT wave_id, min(rid) AS rid, arg_min(party, rid) AS party, arg_min(educ, rid) AS educ FROM svy_raw GROUP BY 1"))
def h09(spark, sf_dir):
    rows = X.svy_raw(spark, sf_dir).select("wave_id", "rid", "party", "educ")
    return dedupe.keep_first(rows, ["wave_id"], ["rid"])
