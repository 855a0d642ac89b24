"""Flags and text functions over the comment, post and rating views."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens.functions import flags as G
from forumlens.functions import text as T
from forumlens.operators import survey as S
from forumlens.operators.staging import computed_once
from forumlens.plans import book as B
from forumlens.plans import d_survey
from forumlens.plans import fixtures as X

BOOK = B.Book()
add = BOOK.add
KEY = ("id", "created_utc")


def on_comments(name: str, out: str, expression, sql: str):
    """One expression over every comment."""
    @add(name, X.oracle("cmt", f"SELECT id, created_utc, {sql} AS {out} FROM cmt"))
    def query(spark, sf_dir):
        return X.cmt(spark, sf_dir).select(*KEY, expression().alias(out))


on_comments("c01_keyword_mention", "mentions", lambda: T.mentions("body", B.KEYWORD), B.sql_mentions("body"))


@add("c02_mention_any_field", X.oracle("sub", f"SELECT id, {B.sql_mentions('title')} OR {B.sql_mentions('selftext')} AS mentions FROM sub"))
def c02(spark, sf_dir):
    return X.sub(spark, sf_dir).select("id", T.mentions_any(["title", "selftext"], B.KEYWORD).alias("mentions"))


@add("c03_strip_id_prefix", X.oracle("thr_cmt", "SELECT id, regexp_replace(parent_id, '^t[13]_', '') AS parent FROM thr_cmt"))
def c03(spark, sf_dir):
    return X.thr_cmt(spark, sf_dir).select("id", T.strip_id_prefix("parent_id").alias("parent"))


@add("c04_placeholder_flags", X.oracle("sub", """
    SELECT id, coalesce(selftext = '[deleted]', false) AS selftext_deleted, coalesce(selftext = '[removed]', false) AS selftext_removed,
      CASE WHEN selftext IN ('[deleted]', '[removed]') THEN '' ELSE coalesce(selftext, '') END AS selftext FROM sub"""))
def c04(spark, sf_dir):
    return X.sub(spark, sf_dir).select(
        "id", T.is_placeholder("selftext", "[deleted]").alias("selftext_deleted"),
        T.is_placeholder("selftext", "[removed]").alias("selftext_removed"),
        T.without_placeholders("selftext").alias("selftext"))


@add("c05_junk_title", X.oracle("sub", f"SELECT id, {B.SQL_JUNK} AS title_unusable, CASE WHEN {B.SQL_JUNK} THEN '' ELSE title END AS title FROM sub"))
def c05(spark, sf_dir):
    junk = T.is_junk_title("title")
    return X.sub(spark, sf_dir).select("id", junk.alias("title_unusable"), F.when(junk, "").otherwise(F.col("title")).alias("title"))


on_comments("c06_bot_or_moderator", "is_bot", G.is_bot_or_moderator, B.SQL_BOT)
on_comments("c07_clean_text", "body_clean", lambda: T.clean_text("body"), B.sql_clean("body"))
on_comments("c08_quote_removal", "text", lambda: T.without_quotes("body"), B.sql_no_quotes("body"))
on_comments("c09_link_to_text", "text", lambda: T.links_to_text("body"), B.sql_link_text("body"))
on_comments("c10_url_removal", "text", lambda: T.without_urls("body"), B.sql_no_urls("body"))
on_comments("c11_entity_decode", "text", lambda: T.decode_entities("body"), B.sql_entities("body"))
on_comments("c12_zero_width_removal", "text", lambda: T.without_zero_width(F.concat(F.lit("\u200b"), "body")),
            B.sql_no_zero_width("chr(8203) || body"))
on_comments("c13_whitespace_collapse", "text", lambda: T.collapse_space(F.concat(F.lit("\u00a0 "), "body", F.lit(" \n\t\n "))),
            B.sql_collapse("chr(160) || ' ' || body || ' ' || chr(10) || chr(9) || chr(10) || ' '"))


@add("c14_title_and_body", X.oracle("sub", f"SELECT id, {B.sql_strip(f'''coalesce(title, '') || {B.LF} || {B.LF} || coalesce(selftext, '')''')} AS text FROM sub"))
def c14(spark, sf_dir):
    return X.sub(spark, sf_dir).select("id", T.title_and_body("title", "selftext").alias("text"))


@add("c15_drop_empty", X.oracle("cmt", f"SELECT id, created_utc, body_clean FROM (SELECT *, {B.sql_clean('body')} AS body_clean FROM cmt) WHERE body_clean <> ''"))
def c15(spark, sf_dir):
    cleaned = computed_once(X.cmt(spark, sf_dir).select(*KEY, "body"), "body_clean", T.clean_text("body"))
    return cleaned.select(*KEY, "body_clean").filter("body_clean != ''")


on_comments("c16_keyword_only_in_quote", "only_in_quote", lambda: ~T.mentions(T.clean_text("body"), B.KEYWORD),
            f"NOT {B.sql_mentions(B.sql_clean('body'))}")


@add("c17_mention_changed", X.oracle("cmt", f"""
    SELECT count(*) AS rows, count(*) FILTER (WHERE {B.sql_mentions('body')} <> {B.sql_mentions(B.sql_clean('body'))}) AS changed FROM cmt"""))
def c17(spark, sf_dir):
    raw, left = T.mentions("body", B.KEYWORD), T.mentions(T.clean_text("body"), B.KEYWORD)
    return X.cmt(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"), F.count_if(raw != left).alias("changed"))


@add("c18_labelling_eligibility", X.oracle("cmt", f"""
    SELECT id, created_utc, coalesce({B.sql_mentions('body_clean')} AND contains(lower(body_clean), 'the'), false) AS eligible
    FROM (SELECT *, {B.sql_clean('body')} AS body_clean FROM cmt)"""))
def c18(spark, sf_dir):
    rows = X.cmt(spark, sf_dir).withColumn("body_clean", T.clean_text("body"))
    only_quote = ~T.mentions("body_clean", B.KEYWORD)
    return rows.select(*KEY, T.flag(~only_quote & T.contains_keyword("body_clean", B.KEYWORD)).alias("eligible"))


@add("c19_post_eligibility", X.oracle("sub", f"""
    SELECT id, {B.sql_mentions('text')} AND NOT junk AND NOT bot AND {B.sql_words('text')} BETWEEN 5 AND 250 AS eligible
    FROM (SELECT id, {B.SQL_JUNK} AS junk, {B.SQL_BOT} AS bot,
      {B.sql_clean(f"CASE WHEN {B.SQL_JUNK} THEN '' ELSE title END || {B.LF} || {B.LF} || CASE WHEN selftext IN ('[deleted]', '[removed]') THEN '' ELSE coalesce(selftext, '') END")} AS text
      FROM sub)"""))
def c19(spark, sf_dir):
    from forumlens.operators.cleaning import Settings, prepare_posts
    posts = prepare_posts(X.sub(spark, sf_dir), Settings(keyword=B.KEYWORD, junk_title=T.V.JUNK_TITLE))
    ok = (F.col("mentions_keyword") & ~F.col("title_unusable") & ~F.col("is_mod_or_bot_post")
          & T.length_window("text_clean"))
    return posts.select("id", ok.alias("eligible"))


@add("c20_word_count_window", X.oracle("cmt", f"SELECT id, created_utc, {B.sql_words('body')} AS words, {B.sql_words('body')} BETWEEN 5 AND 250 AS in_window FROM cmt"))
def c20(spark, sf_dir):
    return X.cmt(spark, sf_dir).select(*KEY, T.word_count("body").alias("words"), T.length_window("body").alias("in_window"))


@add("c21_top_level_share", X.oracle("thr_cmt", """
    SELECT count(*) AS rows, count(*) FILTER (WHERE parent_id LIKE 't3\\_%' ESCAPE '\\') AS top_level,
      count(*) FILTER (WHERE is_top_level <> (parent_id LIKE 't3\\_%' ESCAPE '\\')) AS mismatches,
      round(avg(CASE WHEN is_top_level THEN 1.0 ELSE 0.0 END), 6) AS top_share FROM thr_cmt"""))
def c21(spark, sf_dir):
    again = G.is_top_level()
    return X.thr_cmt(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(again).alias("top_level"),
        F.count_if(F.col("is_top_level") != again).alias("mismatches"),
        F.round(F.avg(F.col("is_top_level").cast("double")), 6).alias("top_share"))


on_comments("c22_edited_flag", "edited", G.is_edited, "edited <> 'False'")


@add("c23_edited_split", X.oracle("cmt", "SELECT id, created_utc, edited <> 'False' AS is_edited, try_cast(edited AS DOUBLE) AS edited_utc FROM cmt"))
def c23(spark, sf_dir):
    return X.cmt(spark, sf_dir).select(*KEY, G.is_edited().alias("is_edited"), G.edited_at_seconds().alias("edited_utc"))


on_comments("c24_deleted_author", "author_deleted", G.is_deleted_author, "coalesce(author = '[deleted]', false)")
on_comments("c25_utc_time", "created_at", lambda: F.date_format(G.utc_time(), "yyyy-MM-dd HH:mm:ss"),
            "strftime(make_timestamp(created_utc * 1000000), '%Y-%m-%d %H:%M:%S')")


@add("c26_period_and_term", X.oracle("cmt", f"SELECT id, created_utc, CAST(substr(source_month, 1, 4) AS SMALLINT) AS year, {B.SQL_PERIOD} AS period, substr({B.SQL_PERIOD}, 1, 2) AS term FROM cmt"))
def c26(spark, sf_dir):
    period = G.period_of_month()
    return X.cmt(spark, sf_dir).select(*KEY, G.year_of_month().cast("smallint").alias("year"), period.alias("period"),
                                       G.term_of_period(period).alias("term"))


@add("c27_study_window", """SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month, count(*) AS n
    FROM orders WHERE year(o_orderdate) IN (1995, 1997) AND month(o_orderdate) BETWEEN 1 AND 6 GROUP BY 1, 2""")
def c27(spark, sf_dir):
    orders = X.table(spark, sf_dir, "orders").filter(G.in_study_window("o_orderdate", ("1995", "1997")))
    return orders.groupBy(F.year("o_orderdate").cast("bigint").alias("year"), F.month("o_orderdate").cast("bigint").alias("month")).agg(
        F.count(F.lit(1)).alias("n"))


@add("c28_era", X.oracle("svy_raw", "SELECT wave_id, CASE WHEN year(interview_date) >= 2025 THEN 'second' WHEN interview_date IS NOT NULL THEN 'first' END AS presidency, count(*) AS n FROM resp GROUP BY 1, 2", *d_survey.RESP))
def c28(spark, sf_dir):
    resp = d_survey.respondents(spark, sf_dir)
    return resp.groupBy("wave_id", G.era("interview_date").alias("presidency")).agg(F.count(F.lit(1)).alias("n"))


@add("c29_flair_stance", X.oracle("cmt", f"SELECT id, created_utc, {B.SQL_FLAIR} AS author_flair_text, {B.SQL_STANCE} AS stance FROM cmt"))
def c29(spark, sf_dir):
    return X.cmt(spark, sf_dir).select(*KEY, G.trimmed_flair().alias("author_flair_text"), G.declared_stance(only_in=B.COMMUNITY).alias("stance"))


@add("c30_truncate", X.oracle("thr_cmt", "SELECT id, substr(comment, 1, 200) AS text, CAST(length(substr(comment, 1, 4000)) AS BIGINT) AS chars_used FROM thr_cmt"))
def c30(spark, sf_dir):
    return X.thr_cmt(spark, sf_dir).select("id", T.truncate("comment", 200).alias("text"), F.length(T.truncate("comment")).cast("bigint").alias("chars_used"))


on_comments("c31_snippet", "snippet", lambda: T.snippet("body"), f"substr(regexp_replace(body, '{B.WS}+', ' ', 'g'), 1, 160)")


@add("c32_question_mark", X.oracle("cmt", f"SELECT coalesce({B.sql_strip('body')} LIKE '%?', false) AS question, subreddit, count(*) AS n FROM cmt GROUP BY 1, 2"))
def c32(spark, sf_dir):
    return X.cmt(spark, sf_dir).groupBy(T.ends_with_question("body").alias("question"), "subreddit").agg(F.count(F.lit(1)).alias("n"))


@add("c33_threshold_label", X.oracle("rate", "SELECT id, CASE WHEN tone >= 0.05 THEN 'pro' WHEN tone <= -0.05 THEN 'against' ELSE 'neutral' END AS label FROM rate"))
def c33(spark, sf_dir):
    return X.rate(spark, sf_dir).select("id", G.label_by_threshold("tone").alias("label"))


SCORED = "SELECT id, CASE WHEN label_1 <> 'skip' THEN p_against END AS a, CASE WHEN label_1 <> 'skip' THEN 1 - p_against - p_pro END AS n, CASE WHEN label_1 <> 'skip' THEN p_pro END AS p FROM rate"


@add("c34_argmax_label", X.oracle("rate", "SELECT id, CASE WHEN a IS NULL OR n IS NULL OR p IS NULL THEN NULL WHEN a >= n AND a >= p THEN 'against' WHEN n >= p THEN 'neutral' ELSE 'pro' END AS label FROM scored", ("scored", SCORED)))
def c34(spark, sf_dir):
    scored = F.col("label_1") != "skip"
    rows = X.rate(spark, sf_dir).select("id", F.when(scored, F.col("p_against")).alias("a"),
                                        F.when(scored, 1 - F.col("p_against") - F.col("p_pro")).alias("n"),
                                        F.when(scored, F.col("p_pro")).alias("p"))
    return rows.select("id", G.argmax_label({"against": "a", "neutral": "n", "pro": "p"}).alias("label"))


@add("c35_signed_score", X.oracle("rate", "SELECT id, round(p_pro - p_against, 6) AS score FROM rate"))
def c35(spark, sf_dir):
    return X.rate(spark, sf_dir).select("id", F.round(G.signed_score(), 6).alias("score"))


@add("c36_outcome", X.oracle("rate", """
    SELECT id, CASE WHEN model_b = final THEN 'now right' WHEN model_a = final THEN 'now wrong' ELSE 'still wrong' END AS outcome,
      CASE WHEN final = label_1 THEN 'annotator 1' WHEN final = label_2 THEN 'annotator 2' ELSE 'neither' END AS sided FROM rate"""))
def c36(spark, sf_dir):
    return X.rate(spark, sf_dir).select("id", G.outcome("model_a", "model_b", "final").alias("outcome"),
                                        G.sided_with("final", "label_1", "label_2").alias("sided"))


on_comments("c37_escape_newlines", "line", lambda: T.escape_newlines("body"),
            "replace(replace(body, chr(13), '\\r'), chr(10), '\\n')")
