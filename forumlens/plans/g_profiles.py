"""Counts, funnels, profiles and crosstabs."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens import fixed_values as V
from forumlens.functions import flags as G
from forumlens.operators import cleaning as C
from forumlens.operators import polls
from forumlens.operators import profile as P
from forumlens.operators.quantiles import exact_quantiles
from forumlens.plans import book as B
from forumlens.session import cut_lineage
from forumlens.plans import d_survey as D
from forumlens.plans import fixtures as X
from forumlens.plans.f_joins import CLEAN, COMMENT_FUNNEL, FLAGGED, MONTHS, POST_FUNNEL, POSTS, SETTINGS, linked

BOOK = B.Book()
add = BOOK.add
STUDY_MONTHS = [m for m in MONTHS if not m.endswith("07")]


def flagged(spark, sf_dir):
    return C.flagged_posts(X.sub(spark, sf_dir), X.cmt(spark, sf_dir), B.KEYWORD)


@add("g01_comment_funnel", X.oracle("cmt", "SELECT * FROM comment_funnel", COMMENT_FUNNEL))
def g01(spark, sf_dir):
    return C.comment_month_funnel(X.cmt(spark, sf_dir), B.KEYWORD, MONTHS)


@add("g02_post_funnel", X.oracle("cmt sub", "SELECT * FROM post_funnel", *FLAGGED, POST_FUNNEL))
def g02(spark, sf_dir):
    return C.post_month_funnel(flagged(spark, sf_dir))


@add("g03_relevance_types", X.oracle("cmt sub", "SELECT count(*) FILTER (WHERE mentions_keyword AND NOT has_keyword_comment) AS direct_only, count(*) FILTER (WHERE NOT mentions_keyword AND has_keyword_comment) AS comment_only, count(*) FILTER (WHERE mentions_keyword AND has_keyword_comment) AS both FROM flagged", *FLAGGED))
def g03(spark, sf_dir):
    return C.relevance_types(flagged(spark, sf_dir))


@add("g04_cleaning_funnel", X.oracle("cmt", """
    SELECT stage, rows, round(100 * rows / raw, 2) AS pct_of_raw FROM (
      SELECT (SELECT count(*) FROM cmt) AS raw, unnest(['raw', 'bot_or_mod', 'duplicate', 'empty_after_clean', 'kept', 'kept_only_in_quote']) AS stage,
        unnest([(SELECT count(*) FROM cmt), (SELECT count(*) FROM cmt) - (SELECT count(*) FROM people), (SELECT count(*) FROM people) - (SELECT count(*) FROM single),
          (SELECT count(*) FROM cleaned WHERE body_clean = ''), (SELECT count(*) FROM cc), (SELECT count(*) FROM cc WHERE only_in_quote)]) AS rows)""", *CLEAN))
def g04(spark, sf_dir):
    return C.comment_funnel(X.cmt(spark, sf_dir), SETTINGS)


@add("g05_top_removed_accounts", X.oracle("cmt", f"SELECT author, count(*) AS n FROM cmt WHERE {B.SQL_BOT} GROUP BY 1 ORDER BY n DESC, author NULLS FIRST LIMIT 15"))
def g05(spark, sf_dir):
    return P.top_counts(X.cmt(spark, sf_dir).filter(G.is_bot_or_moderator()), "author", 15)


@add("g06_before_after", X.oracle("cmt sub", """
    SELECT coalesce(kind, 'TOTAL') AS kind, CAST(sum(b) AS BIGINT) AS rows_before, CAST(sum(a) AS BIGINT) AS rows_after, CAST(sum(cb) AS BIGINT) AS cols_before, CAST(sum(ca) AS BIGINT) AS cols_after,
      round(100.0 * (1 - sum(a) / sum(b)), 2) AS rows_removed_pct
    FROM (SELECT 'comments' AS kind, (SELECT count(*) FROM cmt) AS b, (SELECT count(*) FROM cc) AS a, 16 AS cb, 22 AS ca
      UNION ALL SELECT 'submissions', (SELECT count(*) FROM sub), (SELECT count(*) FROM linked WHERE fate = 'kept'), 12, 32) GROUP BY ROLLUP (kind)""", *CLEAN, *POSTS))
def g06(spark, sf_dir):
    return P.overview({"comments": X.cmt(spark, sf_dir), "submissions": X.sub(spark, sf_dir)},
                      {"comments": cleaned_comments(spark, sf_dir), "submissions": cleaned_posts(spark, sf_dir)})


def cleaned_comments(spark, sf_dir):
    return C.clean_comments(X.cmt(spark, sf_dir), SETTINGS).select(*C.COMMENT_SCHEMA)


def cleaned_posts(spark, sf_dir):
    """Columns that the test tables do not have are made from those that they have."""
    posts = X.sub(spark, sf_dir).withColumns({
        "author_flair_text": F.when(F.col("score") % 4 == 0, " Undecided "), "is_self": F.col("score") % 2 == 0,
        "domain": F.concat(F.lit("self."), "subreddit"), "url": F.concat(F.lit("https://ex.org/"), "id"),
        "link_flair_text": F.lit(None).cast("string"), "removed_by_category": F.lit(None).cast("string"),
        "stickied": F.col("score") % 7 == 0})
    comments = C.clean_comments(X.cmt(spark, sf_dir), SETTINGS)
    return C.clean_posts(posts, comments, SETTINGS).select(*C.POST_SCHEMA)


_TIMES = f"""make_timestamp(created_utc * 1000000) AS created_at, CAST(substr(source_month, 1, 4) AS SMALLINT) AS "year", {B.SQL_PERIOD} AS period, substr({B.SQL_PERIOD}, 1, 2) AS term, {B.SQL_STANCE} AS stance"""


@add("g06b_comments_clean", X.oracle("cmt", f"""SELECT id, submission_id, parent_id, created_utc, source_month, subreddit, author, {B.SQL_FLAIR} AS author_flair_text, body, score,
    CAST(controversiality AS TINYINT) AS controversiality, stickied, edited <> 'False' AS edited, body_clean, only_in_quote, coalesce(author = '[deleted]', false) AS author_deleted,
    starts_with(parent_id, 't3_') AS is_top_level, {_TIMES} FROM cc""", *CLEAN))
def g06b(spark, sf_dir):
    """The cleaned comments in their final schema."""
    return C.final_table(cleaned_comments(spark, sf_dir), C.COMMENT_SCHEMA)


@add("g06c_submissions_clean", X.oracle("cmt sub", f"""SELECT id, created_utc, source_month, subreddit, author, {B.SQL_FLAIR} AS author_flair_text, title, selftext, is_self, 'self.' || subreddit AS domain,
    'https://ex.org/' || id AS url, NULL::VARCHAR AS link_flair_text, score, num_comments, upvote_ratio, NULL::VARCHAR AS removed_by_category, score % 7 = 0 AS stickied, mentions_keyword, has_keyword_comment,
    selftext_deleted, selftext_removed, author_deleted, title_unusable, is_mod_or_bot_post, text, text_clean, {_TIMES}, in_scope
    FROM (SELECT *, score % 2 = 0 AS is_self, CASE WHEN score % 4 = 0 THEN ' Undecided ' END AS author_flair_text FROM linked WHERE fate = 'kept')""", *CLEAN, *POSTS))
def g06c(spark, sf_dir):
    """The cleaned posts in their final schema."""
    return C.final_table(cleaned_posts(spark, sf_dir), C.POST_SCHEMA)


_SIDE = """SELECT coalesce(a.category, b.category) AS category, coalesce(comments, 0) AS comments, coalesce(submissions, 0) AS submissions
    FROM (SELECT {c} AS category, count(*) AS comments FROM cmt GROUP BY 1) a FULL JOIN (SELECT {c} AS category, count(*) AS submissions FROM sub GROUP BY 1) b ON a.category = b.category"""


@add("g07_counts_per_category", X.oracle("cmt sub", "SELECT 'month' AS by, * FROM (" + _SIDE.format(c="source_month") + ") UNION ALL SELECT 'community', * FROM (" + _SIDE.format(c="subreddit") + ") UNION ALL SELECT 'period', * FROM (" + _SIDE.format(c=B.SQL_PERIOD) + ")"))
def g07(spark, sf_dir):
    """Both tables by month, community and period: counted once by (month, community), then rolled up."""
    tables = {}
    for name, df in (("comments", X.cmt(spark, sf_dir)), ("submissions", X.sub(spark, sf_dir))):
        by = F.array(F.struct(F.lit("month").alias("by"), F.col("source_month").alias("category")),
                     F.struct(F.lit("community").alias("by"), F.col("subreddit").alias("category")),
                     F.struct(F.lit("period").alias("by"), G.period_of_month().alias("category")))
        pairs = df.groupBy("source_month", "subreddit").agg(F.count(F.lit(1)).alias("n"))
        tables[name] = pairs.select("n", F.inline(by)).withColumn("t", F.lit(name))
    stacked = tables["comments"].unionByName(tables["submissions"])
    return stacked.groupBy("by", "category").agg(*[
        F.coalesce(F.sum(F.when(F.col("t") == name, F.col("n"))), F.lit(0)).alias(name) for name in tables])


@add("g08_share_of_total", D.resp_sql("SELECT source_family, mode, count(*) AS rows, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM resp GROUP BY 1, 2"))
def g08(spark, sf_dir):
    return P.shares(D.respondents(spark, sf_dir), ["source_family", "mode"])


@add("g09_crosstab_with_margins", """SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'All' ELSE o_orderpriority END AS o_orderpriority,
    CASE WHEN grouping(o_orderstatus) = 1 THEN 'All' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)""")
def g09(spark, sf_dir):
    return P.crosstab_with_margins(X.table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@add("g10_row_shares", X.oracle("rate", "SELECT grp, " + ", ".join(f"round(count(*) FILTER (WHERE final = '{c}') / count(*), 6) AS {c}" for c in V.CLASSES) + " FROM rate GROUP BY 1"))
def g10(spark, sf_dir):
    return P.row_shares(X.rate(spark, sf_dir), "grp", "final", V.CLASSES)


@add("g11_flag_sum_and_mean", X.oracle("cmt", f"SELECT {B.SQL_PERIOD} AS period, count(*) FILTER (WHERE only_in_quote) AS only_in_quote_n, round(avg(CASE WHEN only_in_quote THEN 1.0 ELSE 0 END), 6) AS only_in_quote_share FROM cc GROUP BY 1", *CLEAN))
def g11(spark, sf_dir):
    return P.flag_rates(C.clean_comments(X.cmt(spark, sf_dir), SETTINGS), ["only_in_quote"], ["period"])


def _pct(flag: str) -> str:
    return f"round(100 * avg(CASE WHEN {flag} THEN 1.0 WHEN NOT {flag} THEN 0 END), 6)"


@add("g12_flag_pct_by_month", X.oracle("cmt", f"SELECT source_month, {_pct('author_deleted')} AS author_deleted, {_pct('only_in_quote')} AS only_in_quote, {_pct('is_top_level')} AS is_top_level, {_pct('edited')} AS edited, {_pct('stickied')} AS stickied FROM (SELECT source_month, coalesce(author = '[deleted]', false) AS author_deleted, only_in_quote, starts_with(parent_id, 't3_') AS is_top_level, edited <> 'False' AS edited, stickied FROM cc) GROUP BY 1", *CLEAN))
def g12(spark, sf_dir):
    clean = C.clean_comments(X.cmt(spark, sf_dir), SETTINGS)
    return P.flag_pct(clean, ["author_deleted", "only_in_quote", "is_top_level", "edited", "stickied"], ["source_month"])


NULL_COLUMNS = ["id", "author", "author_flair_text", "body", "distinguished", "edited"]


def _nulls(by: str, group: str) -> str:
    return " UNION ALL ".join(f"SELECT {by} '{c}' AS column_name, count(*) - count({c}) AS nulls, round(100.0 * (count(*) - count({c})) / count(*), 1) AS null_pct, count({c}) = 0 AS all_null FROM cmt {group}" for c in NULL_COLUMNS)


@add("g13_null_profile", X.oracle("cmt", _nulls("", "")))
def g13(spark, sf_dir):
    return P.null_profile(X.cmt(spark, sf_dir), NULL_COLUMNS)


@add("g14_null_pct_by_month", X.oracle("cmt", "SELECT column_name, " + ", ".join(f"max(CASE WHEN source_month = '{m}' THEN null_pct END) AS \"{m}\"" for m in STUDY_MONTHS) + " FROM n GROUP BY 1", ("n", _nulls("source_month,", "GROUP BY source_month"))))
def g14(spark, sf_dir):
    long = P.null_profile(X.cmt(spark, sf_dir), NULL_COLUMNS, ["source_month"])
    return P.spread(long, ["column_name"], "source_month", STUDY_MONTHS, F.col("null_pct"))


@add("g15_pseudo_missing", X.oracle("cmt", " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{v}' AS value, count(*) FILTER (WHERE {c} = '{v}') AS rows, round(100.0 * count(*) FILTER (WHERE {c} = '{v}') / count(*), 6) AS pct FROM cmt" for c in ("author", "body", "author_flair_text") for v in V.PSEUDO_MISSING)))
def g15(spark, sf_dir):
    return P.pseudo_missing(X.cmt(spark, sf_dir), ["author", "body", "author_flair_text"])


LOW = ["subreddit", "author", "score", "controversiality", "distinguished", "stickied", "edited", "lang", "author_flair_text", "source_month", "submission_id"]
_KIND = "CASE WHEN v IS NULL THEN 'null' WHEN v IN ('False', 'false', '0', '0.0') THEN 'f' WHEN v IN ('True', 'true', '1', '1.0') THEN 't' ELSE 'o' END"
LOW_LONG = ("low_long", " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS v, {'true' if c == 'stickied' else 'false'} AS is_bool FROM cmt" for c in LOW))


@add("g16_low_cardinality_scan", X.oracle("cmt", f"""
    SELECT column_name, count(DISTINCT v) AS n_values, round(100.0 * count(*) FILTER (WHERE kd = 'f') / count(*), 6) AS false_like_pct, round(100.0 * count(*) FILTER (WHERE kd = 't') / count(*), 6) AS true_like_pct,
      round(100.0 * count(*) FILTER (WHERE kd = 'o') / count(*), 6) AS other_pct, round(100.0 * count(*) FILTER (WHERE kd = 'null') / count(*), 6) AS null_pct,
      NOT bool_or(is_bool) AND count(*) FILTER (WHERE kd = 'o') = 0 AND count(v) > 0 AS bool_like
    FROM (SELECT *, {_KIND} AS kd FROM low_long) GROUP BY 1 HAVING count(DISTINCT v) <= 5""", LOW_LONG))
def g16(spark, sf_dir):
    return P.low_cardinality_scan(X.cmt(spark, sf_dir), LOW)


@add("g17_constant_columns", X.oracle("cmt", "SELECT column_name, min(v) AS value FROM low_long GROUP BY 1 HAVING count(DISTINCT v) = 1", LOW_LONG))
def g17(spark, sf_dir):
    return P.constant_columns(X.cmt(spark, sf_dir), LOW)


@add("g18_value_by_month", X.oracle("cmt", "SELECT coalesce(edited, '<NA>') AS edited, " + ", ".join(f"count(*) FILTER (WHERE source_month = '{m}') AS \"{m}\"" for m in STUDY_MONTHS) + " FROM cmt GROUP BY 1"))
def g18(spark, sf_dir):
    return P.crosstab(X.cmt(spark, sf_dir), "edited", "source_month", STUDY_MONTHS, null_as="<NA>")


@add("g19_coverage", """SELECT o_orderstatus AS period, count(*) AS rows, count(DISTINCT CAST(o_orderdate AS DATE)) AS dates, count(DISTINCT o_orderpriority) AS groups, count(DISTINCT month(o_orderdate)) AS months,
    CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_date, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_date FROM orders GROUP BY 1""")
def g19(spark, sf_dir):
    orders = X.table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("period"), F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority")
    # the days are few: count the combinations first, then count distinct on those
    cells = orders.groupBy("period", "day", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("period").agg(
        F.sum("n").alias("rows"), F.count_distinct("day").alias("dates"), F.count_distinct("o_orderpriority").alias("groups"),
        F.count_distinct(F.month("day")).alias("months"), F.min("day").cast("string").alias("first_date"),
        F.max("day").cast("string").alias("last_date"))


@add("g20_value_ranges", D.poll_sql(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(min({c}), 6) AS min, round(max({c}), 6) AS max FROM poll" for c in ("approve", "disapprove", "not_sure", "base"))))
def g20(spark, sf_dir):
    ranges = P.value_ranges(D.poll_rows(spark, sf_dir), ["approve", "disapprove", "not_sure", "base"])
    return ranges.select("column_name", F.round("min", 6).alias("min"), F.round("max", 6).alias("max"))


@add("g21_row_sums", D.poll_sql("SELECT round(100 * (approve + disapprove + not_sure), 6) AS percentage_total, count(*) AS rows FROM poll GROUP BY 1"))
def g21(spark, sf_dir):
    return polls.row_sums(D.poll_rows(spark, sf_dir), polls.SHARES)


QUARTILES = {"min": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "max": 1.0}


@add("g22_numeric_summary", D.resp_sql(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, " + ", ".join(f"round(quantile_cont({c}, {p}), 6) AS {n}" for n, p in QUARTILES.items()) + " FROM resp" for c in ("age", "weight_raw", "weight_norm"))))
def g22(spark, sf_dir):
    columns = ["age", "weight_raw", "weight_norm"]
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])
    long = D.respondents(spark, sf_dir, weights=True).select(F.inline(pairs))
    moments = long.groupBy("column_name").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("sd"))
    cuts = exact_quantiles(long, ["column_name"], "v", QUARTILES)
    return moments.join(cuts.select("column_name", *[F.round(q, 6).alias(q) for q in QUARTILES]), "column_name")


@add("g23_group_min_mean_max", D.resp_sql("SELECT wave_id, round(min(weight_norm), 6) AS min, round(avg(weight_norm), 6) AS mean, round(max(weight_norm), 6) AS max FROM resp GROUP BY 1"))
def g23(spark, sf_dir):
    return D.respondents(spark, sf_dir, weights=True).groupBy("wave_id").agg(*[F.round(f("weight_norm"), 6).alias(n) for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))])


@add("g24_field_span", D.resp_sql("SELECT wave_id, CAST(min(interview_date) AS VARCHAR) AS first, CAST(max(interview_date) AS VARCHAR) AS last, count(interview_date) AS n, CAST(date_diff('day', min(interview_date), max(interview_date)) AS BIGINT) AS days FROM resp GROUP BY 1"))
def g24(spark, sf_dir):
    return D.respondents(spark, sf_dir).groupBy("wave_id").agg(
        F.min("interview_date").cast("string").alias("first"), F.max("interview_date").cast("string").alias("last"),
        F.count("interview_date").alias("n"), F.datediff(F.max("interview_date"), F.min("interview_date")).cast("bigint").alias("days"))


@add("g25_wave_overview", D.resp_sql("SELECT CAST(CASE wave_id WHEN 'A17' THEN 1 WHEN 'B18' THEN 2 ELSE 3 END AS INTEGER) AS position, wave_id, arg_min(source_family, orig_id) AS type, count(*) AS rows, CAST(min(interview_date) AS VARCHAR) AS first_date, CAST(max(interview_date) AS VARCHAR) AS last_date FROM resp GROUP BY wave_id"))
def g25(spark, sf_dir):
    per_wave = D.respondents(spark, sf_dir).groupBy("wave_id").agg(
        F.min_by("source_family", "orig_id").alias("type"), F.count(F.lit(1)).alias("rows"),
        F.min("interview_date").cast("string").alias("first_date"), F.max("interview_date").cast("string").alias("last_date"))
    return P.fixed_order(per_wave, "wave_id", D.ORDER).orderBy("position")


FREQ = ["approval", "approval_strength", "party_lean", "ideology", "gender", "age_group", "education"]


@add("g26_frequency_with_nulls", D.resp_sql(" UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS rows, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM resp GROUP BY 2" for c in FREQ)))
def g26(spark, sf_dir):
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in FREQ])
    return P.shares(D.respondents(spark, sf_dir).select(F.inline(pairs)), ["value"], within=["column_name"])


@add("g27_length_quantiles", X.oracle("cmt", "SELECT subreddit, round(quantile_cont(length(body), 0.5), 6) AS median, round(quantile_cont(length(body), 0.9), 6) AS q90, round(avg(CASE WHEN length(body) > 4000 THEN 1.0 ELSE 0 END), 6) AS cut_share FROM cmt GROUP BY 1"))
def g27(spark, sf_dir):
    lengths = cut_lineage(X.cmt(spark, sf_dir).select("subreddit", F.length("body").alias("chars")))
    cuts = exact_quantiles(lengths, ["subreddit"], "chars", {"median": 0.5, "q90": 0.9})
    over = lengths.groupBy("subreddit").agg(F.round(F.avg((F.col("chars") > V.TEXT_MAX_CHARS).cast("double")), 6).alias("cut_share"))
    return cuts.select("subreddit", F.round("median", 6).alias("median"), F.round("q90", 6).alias("q90")).join(over, "subreddit")


@add("g28_tokens_per_version", X.oracle("thr_ans", "SELECT prompt_version, round(quantile_cont(prompt_tokens, 0.5), 6) AS median_tokens, CAST(max(prompt_tokens) AS BIGINT) AS longest FROM thr_ans GROUP BY 1"))
def g28(spark, sf_dir):
    answers = X.thr_ans(spark, sf_dir)
    cuts = exact_quantiles(answers, ["prompt_version"], "prompt_tokens", {"median_tokens": 0.5, "longest": 1.0})
    return cuts.select("prompt_version", F.round("median_tokens", 6).alias("median_tokens"), F.col("longest").cast("bigint").alias("longest"))


@add("g29_answers_wide", X.oracle("thr_ans", "SELECT id, max(CASE WHEN prompt_version = 'v1' THEN raw_output END) AS v1, max(CASE WHEN prompt_version = 'v2-post' THEN raw_output END) AS \"v2-post\" FROM thr_ans GROUP BY 1"))
def g29(spark, sf_dir):
    return P.spread(X.thr_ans(spark, sf_dir), ["id"], "prompt_version", ["v1", "v2-post"], F.col("raw_output"))


@add("g31_throughput", X.oracle("thr_ans", "SELECT prompt_version, count(*) AS texts, round(sum(prompt_tokens) / 2000.0, 6) AS seconds, round(count(*) / (sum(prompt_tokens) / 2000.0), 6) AS texts_per_second, round(sum(cached_tokens) / sum(prompt_tokens), 6) AS cached_share, round(4514780 / (count(*) / (sum(prompt_tokens) / 2000.0)) / 86400, 6) AS days_for_all FROM thr_ans GROUP BY 1"))
def g31(spark, sf_dir):
    from forumlens.operators.scoring import throughput
    answers = X.thr_ans(spark, sf_dir).withColumn("seconds", F.col("prompt_tokens") / 2000.0)
    return throughput(answers, ["prompt_version"], rows_in_all=4_514_780)


RATERS = ["final", "model_a", "model_b"]


@add("g32_label_shares", X.oracle("rate", " UNION ALL ".join(f"SELECT '{r}' AS rater, {r} AS label, count(*) AS rows, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM rate GROUP BY 2" for r in RATERS)))
def g32(spark, sf_dir):
    pairs = F.array(*[F.struct(F.lit(r).alias("rater"), F.col(r).alias("label")) for r in RATERS])
    return P.shares(X.rate(spark, sf_dir).select(F.inline(pairs)), ["label"], within=["rater"])


@add("g33_class_share_by_group", X.oracle("rate", " UNION ALL ".join(f"SELECT grp, '{r}' AS rater, round(100 * avg(CASE WHEN {r} = 'against' THEN 1.0 ELSE 0 END), 6) AS against, round(100 * avg(CASE WHEN {r} = 'pro' THEN 1.0 ELSE 0 END), 6) AS pro FROM rate GROUP BY 1" for r in RATERS)))
def g33(spark, sf_dir):
    pairs = F.array(*[F.struct(F.lit(r).alias("rater"), F.col(r).alias("label")) for r in RATERS])
    return X.rate(spark, sf_dir).select("grp", F.inline(pairs)).groupBy("grp", "rater").agg(*[
        F.round(100 * F.avg((F.col("label") == c).cast("double")), 6).alias(c) for c in ("against", "pro")])


@add("g34_median_score_per_class", X.oracle("rate", "SELECT 'signed' AS model, final, round(quantile_cont(p_pro - p_against, 0.5), 6) AS median FROM rate GROUP BY 2 UNION ALL SELECT 'tone', final, round(quantile_cont(tone, 0.5), 6) FROM rate GROUP BY 2"))
def g34(spark, sf_dir):
    pairs = F.array(F.struct(F.lit("signed").alias("model"), G.signed_score().alias("score")),
                    F.struct(F.lit("tone").alias("model"), F.col("tone").alias("score")))
    long = X.rate(spark, sf_dir).select("final", F.inline(pairs))
    return exact_quantiles(long, ["model", "final"], "score", {"median": 0.5}).withColumn("median", F.round("median", 6))


PERIOD_NAMES = list(V.PERIODS.values())
_KINDS = ("kinds", f"SELECT 'comment' AS kind, subreddit, {B.SQL_PERIOD} AS period FROM cmt UNION ALL SELECT 'submission', subreddit, {B.SQL_PERIOD} FROM sub")


@add("g35_sample_composition", X.oracle("cmt sub", "SELECT kind, coalesce(subreddit, 'All') AS subreddit, " + ", ".join(f"count(*) FILTER (WHERE period = '{p}') AS \"{p}\"" for p in PERIOD_NAMES) + ", count(*) AS \"all\" FROM kinds GROUP BY GROUPING SETS ((kind, subreddit), (kind))", _KINDS))
def g35(spark, sf_dir):
    parts = [df.select(F.lit(kind).alias("kind"), "subreddit", G.period_of_month().alias("period"))
             for kind, df in (("comment", X.cmt(spark, sf_dir)), ("submission", X.sub(spark, sf_dir)))]
    counted = parts[0].unionByName(parts[1]).groupBy("kind", "subreddit").agg(
        *[F.count_if(F.col("period") == p).alias(p) for p in PERIOD_NAMES], F.count(F.lit(1)).alias("all"))
    rolled = counted.rollup("kind", "subreddit").agg(*[F.sum(c).alias(c) for c in [*PERIOD_NAMES, "all"]])
    return rolled.filter("kind is not null").withColumn("subreddit", F.coalesce("subreddit", F.lit("All")))


@add("g36_follow_up_consistency", D.resp_sql("SELECT coalesce(approval, 'missing') AS approval, " + ", ".join(f"count(*) FILTER (WHERE coalesce(approval_strength, 'missing') = '{s}') AS {s}" for s in ("very_strongly", "not_so_strongly", "dk", "missing")) + " FROM resp GROUP BY 1"))
def g36(spark, sf_dir):
    return P.crosstab(D.respondents(spark, sf_dir), "approval", "approval_strength", ["very_strongly", "not_so_strongly", "dk", "missing"], null_as="missing")
