"""Views that give the test tables the shape of discussions, surveys and ratings.

``VIEWS`` holds the SQL that the checks prepend as common table expressions. The Spark side builds the
same rows; the comment view is written as one scan with an explode instead of three scans in a union.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.operators.tone import word_table

MONTH = """CASE WHEN doc_id % 24 < 6 THEN '2017' WHEN doc_id % 24 < 12 THEN '2018' WHEN doc_id % 24 < 18 THEN '2025' ELSE '2026' END
      || '-0' || (doc_id % 6 + 1)"""
PLACE = """CASE WHEN doc_id % 7 < 4 THEN 'main' WHEN doc_id % 7 = 4 THEN 'ask' WHEN doc_id % 7 = 5 THEN 'left' ELSE 'right' END"""

# eight neighbouring documents are one thread, whose post is made from the first of them; every thirteenth post is missing
THREAD = "(doc_id - doc_id % 8)"

CMT_BASE = f"""
  SELECT doc_id AS k, 'c' || doc_id AS id, 's' || {THREAD} AS submission_id, lang,
    CASE WHEN doc_id % 3 = 0 OR doc_id % 8 = 0 THEN 't3_s' || {THREAD} ELSE 't1_c' || (doc_id - 1) END AS parent_id,
    1483228800 + doc_id * 3600 AS created_utc,
    {MONTH} AS source_month,
    {PLACE} AS subreddit,
    CASE WHEN doc_id % 11 = 0 THEN '[deleted]' WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN 'AutoModerator'
         ELSE 'u' || (doc_id % 37) END AS author,
    CASE doc_id % 6 WHEN 0 THEN ' Nimble Navigator ' WHEN 1 THEN 'Nonsupporter' WHEN 2 THEN 'Undecided'
         WHEN 3 THEN 'Toaster' WHEN 4 THEN '' ELSE NULL END AS author_flair_text,
    CASE doc_id % 5 WHEN 0 THEN '&gt; the quoted line' || chr(10) || chr(10) || text
         WHEN 1 THEN text || ' [link](https://ex.org/a) &amp; more'
         WHEN 2 THEN 'see https://ex.org/' || doc_id || ' ' || text
         WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN '&gt; the only quote' ELSE '&gt; the quote' || chr(10) || 'own words' END
         ELSE text END AS body,
    CAST(doc_id % 101 - 50 AS INT) AS score, CAST(doc_id % 2 AS INT) AS controversiality,
    CASE WHEN doc_id % 19 = 0 THEN 'moderator' END AS distinguished, doc_id % 23 = 0 AS stickied,
    CASE doc_id % 4 WHEN 1 THEN '1483230000.0' WHEN 3 THEN NULL ELSE 'False' END AS edited
  FROM {{documents}}"""

CMT = """
  SELECT * FROM cmt_base
  UNION ALL SELECT k, 'd' || k, submission_id, lang, parent_id, created_utc + 60, source_month, subreddit, author,
    author_flair_text, body, score, controversiality, distinguished, stickied, edited FROM cmt_base WHERE k % 29 = 0
  UNION ALL SELECT k, id, submission_id, lang, parent_id, created_utc + 120, source_month, subreddit, author,
    author_flair_text, body, score, controversiality, distinguished, stickied, edited FROM cmt_base WHERE k % 31 = 0"""

SUB = f"""
  SELECT 's' || doc_id AS id, 1483228800 + doc_id * 3600 AS created_utc,
    {MONTH} AS source_month,
    {PLACE} AS subreddit,
    CASE WHEN doc_id % 11 = 0 THEN '[deleted]' ELSE 'u' || (doc_id % 37) END AS author,
    CASE doc_id % 9 WHEN 0 THEN '[Removed by moderator]' WHEN 1 THEN '?I_support_Trump' ELSE split_part(text, chr(10), 1) END AS title,
    CASE doc_id % 4 WHEN 0 THEN '[deleted]' WHEN 1 THEN '[removed]' WHEN 2 THEN NULL ELSE text END AS selftext,
    CASE WHEN doc_id % 24 < 12 THEN NULL ELSE CAST(doc_id % 100 AS DOUBLE) / 100 END AS upvote_ratio,
    CASE WHEN doc_id % 19 = 0 THEN 'moderator' END AS distinguished,
    CAST(doc_id % 101 AS INT) AS score, CAST(doc_id % 13 AS INT) AS num_comments, lang
  FROM {{documents}} WHERE doc_id % 104 <> 40"""

THR_POST = "SELECT 'p' || conv_id AS submission_id, text AS post FROM {conversations} WHERE turn = 0 AND conv_id % 10 <> 9"

THR_CMT = """
  SELECT 'm' || conv_id || '_' || turn AS id, 'p' || conv_id AS submission_id, conv_id, turn, text AS comment,
    CASE WHEN turn = 1 THEN 't3_p' || conv_id ELSE 't1_m' || conv_id || '_' || (turn - 1) END AS parent_id,
    turn = 1 AS is_top_level
  FROM {conversations} WHERE turn > 0 AND (conv_id + turn) % 5 <> 4"""

THR_ANS = """
  SELECT id, v.prompt_version,
    CASE (conv_id + turn + v.n) % 4 WHEN 0 THEN 'pro' WHEN 1 THEN 'against' WHEN 2 THEN 'neutral' ELSE 'maybe' END AS raw_output,
    CASE WHEN (conv_id + turn) % 6 = 5 THEN '{"top":[]}' ELSE
      '{"top":[{"token":"pro","logprob":-' || (turn + 1) || '.5},{"token":"against","logprob":-' || (v.n + 1)
      || '.25},{"token":"other","logprob":-0.5}]}' END AS answer_json,
    700 + 10 * turn + 300 * v.n AS prompt_tokens, 600 AS cached_tokens
  FROM thr_cmt CROSS JOIN (SELECT 'v1' AS prompt_version, 0 AS n UNION ALL SELECT 'v2-post', 1) v"""

SVY_RAW = """
  SELECT CAST(c_custkey AS DOUBLE) AS rid, 1 + abs(c_acctbal) AS weight,
    CASE WHEN c_nationkey < 8 THEN 'A17' WHEN c_nationkey < 16 THEN 'B18' ELSE 'P25' END AS wave_id,
    CASE WHEN c_nationkey < 16 THEN 'phone' ELSE 'panel' END AS family,
    CASE c_custkey % 10 WHEN 8 THEN CASE WHEN c_nationkey < 16 THEN 9 ELSE 99 END WHEN 9 THEN NULL
         ELSE c_custkey % 2 + 1 END AS q_appr,
    CASE WHEN c_custkey % 10 < 8 THEN c_custkey % 3 % 2 + 1 END AS q_str,
    CASE WHEN c_nationkey < 8 THEN 40517 + 100 * (c_custkey % 7) WHEN c_nationkey < 16 THEN 180110 + c_custkey % 7 END AS date_code,
    CASE WHEN c_nationkey >= 16 THEN '2' || (c_custkey % 9) || '-Jan-2025 21:38:38' END AS date_text,
    CASE WHEN c_nationkey < 16 THEN CASE WHEN c_custkey % 41 = 0 THEN 99 ELSE 18 + c_custkey % 80 END END AS age,
    CASE WHEN c_nationkey >= 16 THEN c_custkey % 4 + 1 END AS agecat,
    CASE WHEN c_nationkey < 16 THEN c_custkey % 9 + 1 ELSE c_custkey % 3 + 1 END AS educ,
    CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 9 END AS party, c_custkey % 6 + 1 AS ideo, c_custkey % 2 + 1 AS sex
  FROM {customer}"""

POLL_WIDE = """
  SELECT o_orderpriority AS grp, o_orderstatus AS measure,
    count(CASE WHEN extract(year FROM o_orderdate) = 1995 THEN 1 END) AS d1995,
    count(CASE WHEN extract(year FROM o_orderdate) = 1996 THEN 1 END) AS d1996,
    count(CASE WHEN extract(year FROM o_orderdate) = 1997 THEN 1 END) AS d1997,
    count(CASE WHEN extract(year FROM o_orderdate) = 1998 THEN 1 END) AS d1998
  FROM {orders} GROUP BY o_orderpriority, o_orderstatus"""

RATE_BASE = f"""
  SELECT d.doc_id AS k, 'c' || d.doc_id AS id, 's' || {THREAD.replace('doc_id', 'd.doc_id')} AS submission_id, d.lang AS grp,
    CASE WHEN d.doc_id % 24 < 12 THEN 'T1' ELSE 'T2' END AS term, d.n_chars,
    CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 2 ELSE 1 END AS t
  FROM {{documents}} d JOIN {{labels}} l ON d.doc_id = l.doc_id"""


def _rating(shift: str) -> str:
    return f"CASE (t + {shift}) % 3 WHEN 0 THEN 'against' WHEN 1 THEN 'neutral' ELSE 'pro' END"


RATE = f"""
  SELECT id, k, submission_id, grp, term, n_chars,
    CASE t WHEN 0 THEN 'against' WHEN 1 THEN 'neutral' ELSE 'pro' END AS final,
    CASE WHEN k % 50 = 0 THEN 'skip' ELSE {_rating("CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END")} END AS label_1,
    CASE WHEN k % 70 = 0 THEN 'skip' ELSE {_rating("CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END")} END AS label_2,
    {_rating("CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END")} AS model_a,
    {_rating("CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END")} AS model_b,
    CAST(k % 7 AS DOUBLE) / 10 AS p_against, CAST(k % 4 AS DOUBLE) / 10 AS p_pro, CAST(k % 21 - 10 AS DOUBLE) / 10 AS tone,
    1 + k % 9 AS stratum_size
  FROM rate_base"""

# questions of a codebook: what users ask, numbered, with what they are answered; nine waves
ITEMS = """SELECT concat('W', CAST(u.conv_id % 9 AS STRING)) AS wave,
  concat(CASE u.conv_id % 4 WHEN 0 THEN 'date' WHEN 1 THEN 'Age' WHEN 2 THEN 'q' ELSE 'pol' END, CAST(u.conv_id AS STRING), '_', CAST(u.turn AS STRING)) AS variable,
  u.conv_id * 100 + u.turn AS ordinal, concat('Q', CAST(u.turn + 1 AS STRING), '. ', u.text) AS question, a.text AS answers
  FROM {c} AS u LEFT JOIN {c} AS a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'"""
LEX = "SELECT 'the' AS word, 1.0 AS w UNION ALL SELECT 'of', -0.5 UNION ALL SELECT 'and', 0.25 UNION ALL SELECT 'not', -2.0"

_TABLES = ("documents", "conversations", "labels", "customer", "orders", "lineitem")


def _plain(sql: str) -> str:
    for table in _TABLES:
        sql = sql.replace("{" + table + "}", table)
    return sql


VIEWS = {
    "cmt": [("cmt_base", _plain(CMT_BASE)), ("cmt", CMT)],
    "sub": [("sub", _plain(SUB))],
    "thr_post": [("thr_post", _plain(THR_POST))],
    "thr_cmt": [("thr_cmt", _plain(THR_CMT))],
    "thr_ans": [("thr_cmt", _plain(THR_CMT)), ("thr_ans", THR_ANS)],
    "svy_raw": [("svy_raw", _plain(SVY_RAW))],
    "poll_wide": [("poll_wide", _plain(POLL_WIDE))],
    "rate": [("rate_base", _plain(RATE_BASE)), ("rate", RATE)],
    "items": [("items", ITEMS.replace("{c}", "conversations").replace("STRING", "VARCHAR"))],
    "lex": [("lex", LEX)],
}


def oracle(views: str, body: str, *tables: tuple[str, str]) -> str:
    """SQL text: the named views and extra tables as common table expressions, then ``body``."""
    parts: dict[str, str] = {}
    for view in views.split():
        parts.update(VIEWS[view])
    parts.update(tables)
    ctes = ",\n".join(f"{name} AS {'MATERIALIZED ' if '/* once */' in sql else ''}({sql})" for name, sql in parts.items())
    kind = "WITH RECURSIVE" if "/* recursive */" in ctes else "WITH"
    return (f"{kind} {ctes}\n" if ctes else "") + body


# --- the same views as DataFrames ------------------------------------------------------------------

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cmt_from(documents: DataFrame) -> DataFrame:
    base = documents.sparkSession.sql(CMT_BASE, documents=documents)
    copies = F.expr("""filter(array(
        struct('c' AS letter, 0L AS delay, true AS kept),
        struct('d' AS letter, 60L AS delay, k % 29 = 0 AS kept),
        struct('c' AS letter, 120L AS delay, k % 31 = 0 AS kept)), x -> x.kept)""")
    return (
        base.withColumn("copy", F.explode(copies))
        .withColumn("id", F.concat(F.col("copy.letter"), F.col("k").cast("string")))
        .withColumn("created_utc", F.col("created_utc") + F.col("copy.delay"))
        .drop("copy")
    )


def cmt(spark, sf_dir):
    return cmt_from(table(spark, sf_dir, "documents"))


def sub(spark, sf_dir):
    return spark.sql(SUB, documents=table(spark, sf_dir, "documents"))


def items(spark, sf_dir):
    return spark.sql(ITEMS, c=table(spark, sf_dir, "conversations"))


def thr_post(spark, sf_dir):
    return spark.sql(THR_POST, conversations=table(spark, sf_dir, "conversations"))


def thr_cmt(spark, sf_dir):
    return spark.sql(THR_CMT, conversations=table(spark, sf_dir, "conversations"))


def thr_ans(spark, sf_dir):
    """Two answers per comment: one scan, exploded over the two prompt versions."""
    versions = F.expr("array(struct('v1' AS prompt_version, 0L AS n), struct('v2-post' AS prompt_version, 1L AS n))")
    both = thr_cmt(spark, sf_dir).withColumn("v", F.explode(versions))
    top = F.concat(F.lit('{"top":[{"token":"pro","logprob":-'), (F.col("turn") + 1).cast("string"),
                   F.lit('.5},{"token":"against","logprob":-'), (F.col("v.n") + 1).cast("string"),
                   F.lit('.25},{"token":"other","logprob":-0.5}]}'))
    kind = (F.col("conv_id") + F.col("turn") + F.col("v.n")) % 4
    return both.select(
        "id", F.col("v.prompt_version").alias("prompt_version"),
        F.when(kind == 0, "pro").when(kind == 1, "against").when(kind == 2, "neutral").otherwise("maybe").alias("raw_output"),
        F.when((F.col("conv_id") + F.col("turn")) % 6 == 5, '{"top":[]}').otherwise(top).alias("answer_json"),
        (700 + 10 * F.col("turn") + 300 * F.col("v.n")).alias("prompt_tokens"),
        F.lit(600).alias("cached_tokens"))


def svy_raw(spark, sf_dir):
    return spark.sql(SVY_RAW, customer=table(spark, sf_dir, "customer"))


def poll_wide(spark, sf_dir):
    return spark.sql(POLL_WIDE, orders=table(spark, sf_dir, "orders"))


def rate(spark, sf_dir):
    base = spark.sql(RATE_BASE, documents=table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))
    return spark.sql(RATE.replace("FROM rate_base", "FROM {rate_base}"), rate_base=base)


BOOSTERS = {"in": 0.293, "to": -0.293, "en": 0.293, "le": -0.293}
NEGATIONS = ["that", "ha", "de"]
CONTRASTS = ["or", "ou"]


def tone_words(spark):
    """What words do to the tone of a text."""
    one = lambda words: spark.createDataFrame([(w,) for w in words], "word string")
    return word_table(lex(spark), spark.createDataFrame(list(BOOSTERS.items()), "word string, w double"), one(NEGATIONS), one(CONTRASTS))


def lex(spark):
    return spark.createDataFrame([("the", 1.0), ("of", -0.5), ("and", 0.25), ("not", -2.0)], "word string, w double")
