"""Sources and sinks, each through files in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens import session
from forumlens.functions import text as T
from forumlens.operators import profile as P
from forumlens.operators import survey as S
from forumlens.plans import book as B
from forumlens.plans import d_survey as D
from forumlens.plans import fixtures as X
from forumlens.plans.g_profiles import STUDY_MONTHS
from forumlens.sources import readers as R
from forumlens.sources import layout as L
from forumlens.sources import sinks as K

BOOK = B.Book()
add = BOOK.add
FILE_COLUMNS = ["id", "author", "author_flair_text", "body"]


def month_files(spark, sf_dir, months=None):
    path = session.new_table_path(spark, "months")
    return K.write_month_csv(X.cmt(spark, sf_dir).select(*FILE_COLUMNS, "source_month"), path, months=months)


@add("a01_read_month_files", X.oracle("cmt", "SELECT id, author, nullif(author_flair_text, '') AS author_flair_text, body FROM cmt"))
def a01(spark, sf_dir):
    return R.read_month_files(spark, month_files(spark, sf_dir) + "/*", R.text_schema(FILE_COLUMNS))


@add("a02_scan_totals", X.oracle("cmt", f"SELECT source_month, count(*) AS processed, count(*) FILTER (WHERE {B.sql_mentions('body')}) AS retained FROM cmt GROUP BY 1"))
def a02(spark, sf_dir):
    return X.cmt(spark, sf_dir).groupBy("source_month").agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(T.mentions("body", B.KEYWORD)).alias("retained"))


@add("a03_month_from_path", X.oracle("cmt", "SELECT id, source_month, length(body) AS chars FROM cmt"))
def a03(spark, sf_dir):
    rows = R.read_month_files(spark, month_files(spark, sf_dir) + "/*", R.text_schema(FILE_COLUMNS))
    return rows.select("id", R.source_month().alias("source_month"), F.length("body").cast("bigint").alias("chars"))


@add("a04_required_columns", X.oracle("cmt", "SELECT count(id) AS id, count(body) AS body, count(submission_id) AS submission_id, count(author) AS author FROM cmt"))
def a04(spark, sf_dir):
    required = ["id", "body", "submission_id", "author"]
    rows = P.require_columns(X.cmt(spark, sf_dir), required, "comments")
    return rows.agg(*[F.count(c).alias(c) for c in required])


@add("a05_projected_scan", "SELECT doc_id, lang, n_chars FROM documents")
def a05(spark, sf_dir):
    return R.read_columns(spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang", "n_chars"])


@add("a06_scan_by_id_list", X.oracle("cmt rate", "SELECT id, created_utc, body FROM cmt WHERE id IN (SELECT id FROM rate WHERE label_1 = 'skip')"))
def a06(spark, sf_dir):
    """Comments stored in the order of their ids; the list is pushed into the scan."""
    ids = X.rate(spark, sf_dir).filter("label_1 = 'skip'").select("id")
    path = L.write_by_key(X.cmt(spark, sf_dir).select("id", "created_utc", "body"), session.new_table_path(spark, "by_id"), "id")
    return L.rows_of_keys(spark, path, ["id", "created_utc", "body"], ids, "id")


@add("a07_id_filter", X.oracle("cmt rate", "SELECT id, submission_id, parent_id, author, score FROM cmt WHERE id IN (SELECT id FROM rate)"))
def a07(spark, sf_dir):
    """The list is too long for a filter: the scan is cut to its range and joined."""
    columns = ["id", "submission_id", "parent_id", "author", "score"]
    path = L.write_by_key(X.cmt(spark, sf_dir).select(*columns, "body"), session.new_table_path(spark, "by_id"), "id")
    return L.rows_of_keys(spark, path, columns, X.rate(spark, sf_dir), "id", most=20)


@add("a08_wave_sources", D.resp_sql("SELECT wave_id, approval, age_group, count(*) AS n, round(sum(weight_raw), 4) AS weight FROM resp GROUP BY 1, 2, 3"))
def a08(spark, sf_dir):
    """Waves written under their own names and found again by a differently spelled one."""
    folder = session.new_table_path(spark, "waves")
    for wave, rows in D.waves_of(X.svy_raw(spark, sf_dir)).items():
        K.write_table(rows, f"{folder}/{wave}-public.data")
    found = R.read_waves(spark, folder, {w: f"{w.lower()}_Public data" for w in D.ORDER}, [f"{w}-public.data" for w in D.ORDER])
    return S.harmonise(found, D.WAVES, weights=False).groupBy("wave_id", "approval", "age_group").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("weight_raw"), 4).alias("weight"))


@add("a09_label_files", X.oracle("rate", "SELECT id, CASE WHEN label_1 = 'skip' THEN '' ELSE label_1 END AS label, CAST(k AS VARCHAR) AS k FROM rate"))
def a09(spark, sf_dir):
    rows = X.rate(spark, sf_dir).select("id", F.when(F.col("label_1") == "skip", "").otherwise(F.col("label_1")).alias("label"), "k")
    path = K.write_labels(rows, session.new_table_path(spark, "labels"))
    return R.read_labels(spark, path, ["id", "label", "k"])


@add("a10_parquet_sink", X.oracle("cmt", "SELECT id, created_utc, source_month, author, body, score, stickied FROM cmt"))
def a10(spark, sf_dir):
    rows = X.cmt(spark, sf_dir).select("id", "created_utc", "source_month", "author", "body", "score", "stickied")
    path = K.write_table(rows, session.new_table_path(spark, "comments"), ["source_month"])
    return spark.read.schema(rows.schema).parquet(path)


@add("a11_month_csv_sink", X.oracle("cmt", "SELECT source_month, count(*) AS rows, count(author) AS authors, CAST(sum(length(body)) AS BIGINT) AS chars FROM cmt GROUP BY 1 UNION ALL SELECT '2019-01', 0, 0, 0"))
def a11(spark, sf_dir):
    """Rows per month file; one month of the calendar has a file with a header only."""
    path = month_files(spark, sf_dir, [*STUDY_MONTHS, "2019-01"])
    rows = R.read_month_files(spark, path + "/*", R.text_schema(FILE_COLUMNS))
    counted = rows.groupBy(R.source_month().alias("source_month")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("author").alias("authors"), F.sum(F.length("body")).alias("chars"))
    return K.written_months(spark, path).join(counted, "source_month", "left").na.fill(0, ["rows", "authors", "chars"])


@add("a12_publish_columns", X.oracle("cmt rate", "SELECT c.id, c.created_utc, c.body, r.model_a AS label, r.p_pro FROM cmt c LEFT JOIN rate r ON c.id = r.id"))
def a12(spark, sf_dir):
    """Two columns, published one after the other."""
    root = L.start_table(X.cmt(spark, sf_dir).select("id", "created_utc", "body"), session.new_table_path(spark, "scored"))
    rate = X.rate(spark, sf_dir)
    for column in (F.col("model_a").alias("label"), F.col("p_pro")):
        L.publish(L.current(spark, root, [L.ROW, "id"]).join(rate.select("id", column), "id", "left").drop("id"), root)
    return L.current(spark, root)


@add("a13_checkpointed_parts", X.oracle("cmt", "SELECT id, created_utc, CAST(length(body) AS BIGINT) AS chars, 'limit=512' AS settings FROM cmt"))
def a13(spark, sf_dir):
    """A first run that got through one community, then a second one that does the rest."""
    path = session.new_table_path(spark, "parts")
    work = X.cmt(spark, sf_dir).select("id", "created_utc", "body", "subreddit")
    make = lambda rows: rows.select("id", "created_utc", F.length("body").cast("bigint").alias("chars"))
    K.resume(work.filter("subreddit = 'main'"), path, ["id", "created_utc"], make, "settings", "limit=512")
    return K.resume(work, path, ["id", "created_utc"], make, "settings", "limit=512")


@add("a14_append_answers", X.oracle("thr_ans", "SELECT id, prompt_version, raw_output, prompt_tokens FROM thr_ans"))
def a14(spark, sf_dir):
    """Answers of one prompt are there already; only the missing pairs are appended."""
    path = session.new_table_path(spark, "answers")
    answers = X.thr_ans(spark, sf_dir).select("id", "prompt_version", "raw_output", "prompt_tokens")
    K.append_answers(answers.filter("prompt_version = 'v1' or raw_output = 'pro'"), path)
    todo = K.unanswered(answers, spark.read.parquet(path), ["id", "prompt_version"])
    K.append_answers(todo, path)
    return spark.read.parquet(path)


@add("a15_version_gate", X.oracle("thr_ans", "SELECT prompt_version, count(*) AS rows, prompt_version = 'v1' AS current FROM thr_ans GROUP BY 1"))
def a15(spark, sf_dir):
    return K.setting_counts(X.thr_ans(spark, sf_dir), "prompt_version", "v1")
