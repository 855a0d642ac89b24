"""Joins between posts, comments, answers and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens import fixed_values as V
from forumlens.operators import cleaning as C
from forumlens.operators import threads as H
from forumlens.plans import book as B
from forumlens.plans import fixtures as X
from forumlens.plans.e_duplicates import SINGLE
from forumlens.session import cut_lineage

BOOK = B.Book()
add = BOOK.add
SETTINGS = C.Settings(keyword=B.KEYWORD, flair_community=B.COMMUNITY)
MONTHS = [f"{y}-{m:02d}" for y in V.PERIODS for m in range(1, 8)]

# --- SQL of the cleaning pipeline ------------------------------------------------------------------
CLEAN = (*SINGLE,
         ("cleaned", f"SELECT *, {B.sql_clean('body')} AS body_clean FROM single"),
         ("cc", f"SELECT *, NOT {B.sql_mentions('body_clean')} AS only_in_quote FROM cleaned WHERE body_clean <> ''"))
POSTS = (
    ("posts0", f"SELECT *, {B.SQL_JUNK} AS title_unusable, {B.SQL_BOT} AS is_mod_or_bot_post FROM sub"),
    ("posts1", f"""SELECT * EXCLUDE (title, selftext), CASE WHEN title_unusable THEN '' ELSE title END AS title,
        coalesce(selftext = '[deleted]', false) AS selftext_deleted, coalesce(selftext = '[removed]', false) AS selftext_removed,
        coalesce(author = '[deleted]', false) AS author_deleted,
        CASE WHEN selftext IN ('[deleted]', '[removed]') THEN '' ELSE coalesce(selftext, '') END AS selftext FROM posts0"""),
    ("posts2", f"SELECT *, {B.sql_strip(f'''coalesce(title, '') || {B.LF} || {B.LF} || selftext''')} AS text FROM posts1"),
    ("posts3", f"SELECT *, {B.sql_clean('text')} AS text_clean FROM posts2"),
    ("posts", f"SELECT *, {B.sql_mentions('text_clean')} AS mentions_keyword FROM posts3"),
    ("kids", "SELECT submission_id, bool_or(NOT only_in_quote) AS direct FROM cc GROUP BY 1"),
    ("linked0", """SELECT p.*, k.submission_id IS NOT NULL AS has_child, coalesce(k.direct, false) AS has_keyword_comment
        FROM posts p LEFT JOIN kids k ON p.id = k.submission_id"""),
    ("linked", """SELECT *, mentions_keyword OR has_keyword_comment AS in_scope,
        CASE WHEN title_unusable AND NOT has_child THEN 'junk title, no comment left'
             WHEN NOT (mentions_keyword OR has_keyword_comment) AND NOT has_child THEN 'out of scope, no comment left' ELSE 'kept' END AS fate FROM linked0"""),
)
TALKING = ("talking", f"SELECT DISTINCT submission_id FROM cmt WHERE {B.sql_mentions('body')}")
FLAGGED = (TALKING, ("flagged", f"""SELECT s.*, t.submission_id IS NOT NULL AS has_keyword_comment,
    {B.sql_mentions('title')} OR {B.sql_mentions('selftext')} AS mentions_keyword FROM sub s LEFT JOIN talking t ON s.id = t.submission_id"""))


@add("f01_has_child_flag", X.oracle("cmt sub", "SELECT id, has_keyword_comment FROM flagged", *FLAGGED))
def f01(spark, sf_dir):
    posts = X.sub(spark, sf_dir).select("id")
    return H.has_keyword_child(posts, X.cmt(spark, sf_dir), B.KEYWORD)


@add("f02_relevance_union", X.oracle("cmt sub", "SELECT id, mentions_keyword, has_keyword_comment FROM flagged WHERE mentions_keyword OR has_keyword_comment", *FLAGGED))
def f02(spark, sf_dir):
    flagged = H.relevant_posts(X.sub(spark, sf_dir), X.cmt(spark, sf_dir), B.KEYWORD)
    return flagged.filter("in_scope").select("id", "mentions_keyword", "has_keyword_comment")


def linked(spark, sf_dir):
    """Prepared posts with the fate that their surviving comments decide. Texts of comments stay behind."""
    comments = C.clean_comments(X.cmt(spark, sf_dir), SETTINGS)
    return C.link_posts(C.prepare_posts(X.sub(spark, sf_dir), SETTINGS), comments, SETTINGS)


@add("f03_conditional_parent_removal", X.oracle("cmt sub", "SELECT id, title_unusable, has_child FROM linked WHERE NOT (title_unusable AND NOT has_child)", *CLEAN, *POSTS))
def f03(spark, sf_dir):
    return linked(spark, sf_dir).filter("not (title_unusable and not has_child)").select("id", "title_unusable", "has_child")


@add("f04_no_signal_removal", X.oracle("cmt sub", "SELECT id, in_scope, has_keyword_comment, fate FROM linked", *CLEAN, *POSTS))
def f04(spark, sf_dir):
    return linked(spark, sf_dir).select("id", "in_scope", "has_keyword_comment", "fate")


COMMENT_FUNNEL = ("comment_funnel", f"""
    SELECT month, all_comments, kept AS keyword_comments, CASE WHEN all_comments = 0 THEN 0.0::DOUBLE ELSE round(kept / all_comments, 6) END AS comment_retention_rate, hits - kept AS duplicate_comments_dropped
    FROM (SELECT m.month, count(c.source_month) AS all_comments, count(*) FILTER (WHERE hit) AS hits,
        count(DISTINCT id) FILTER (WHERE hit) + count(*) FILTER (WHERE hit AND id IS NULL) AS kept
      FROM (SELECT unnest({MONTHS!r}) AS month) m LEFT JOIN (SELECT source_month, id, {B.sql_mentions('body')} AS hit FROM cmt) c ON m.month = c.source_month GROUP BY 1)""")
POST_FUNNEL = ("post_funnel", """
    SELECT source_month AS month, count(*) AS all_submissions, count(*) FILTER (WHERE mentions_keyword OR has_keyword_comment) AS relevant_submissions,
      count(*) FILTER (WHERE mentions_keyword) AS direct_submissions, count(*) FILTER (WHERE has_keyword_comment) AS submissions_with_keyword_comment,
      count(*) FILTER (WHERE NOT mentions_keyword AND has_keyword_comment) AS comment_only_submissions FROM flagged GROUP BY 1""")


@add("f05_month_funnel", X.oracle("cmt sub", "SELECT * FROM comment_funnel LEFT JOIN post_funnel USING (month)", *FLAGGED, COMMENT_FUNNEL, POST_FUNNEL))
def f05(spark, sf_dir):
    """The monthly filtering funnel of comments and posts."""
    return C.month_funnel(X.cmt(spark, sf_dir), X.sub(spark, sf_dir), B.KEYWORD, MONTHS)


@add("f06_post_of_comment", X.oracle("thr_cmt thr_post", f"SELECT c.id, c.comment, {B.sql_strip('coalesce(p.post, chr(32))')} AS post FROM thr_cmt c LEFT JOIN thr_post p USING (submission_id)"))
def f06(spark, sf_dir):
    rows = X.thr_cmt(spark, sf_dir).select("id", "submission_id", "comment")
    return H.with_post(rows, X.thr_post(spark, sf_dir)).select("id", "comment", "post")


@add("f07_post_required", X.oracle("thr_cmt thr_post", "SELECT c.id, c.comment, p.post FROM thr_cmt c JOIN thr_post p USING (submission_id)"))
def f07(spark, sf_dir):
    rows = X.thr_cmt(spark, sf_dir).select("id", "submission_id", "comment")
    return H.with_post(rows, X.thr_post(spark, sf_dir), how="inner").select("id", "comment", "post")


PARENT = ("with_parent", f"""SELECT c.*, {B.sql_strip("coalesce(p.comment, '')")} AS parent FROM thr_cmt c
    LEFT JOIN thr_cmt p ON NOT c.is_top_level AND regexp_replace(c.parent_id, '^t1_', '') = p.id""")
CONTEXT = (PARENT, ("placed", f"""SELECT *, CASE WHEN is_top_level AND post <> '' THEN 'post' WHEN NOT is_top_level AND parent <> '' THEN 'earlier comment' ELSE 'none' END AS context
    FROM (SELECT c.*, {B.sql_strip("coalesce(p.post, '')")} AS post FROM with_parent c LEFT JOIN thr_post p USING (submission_id))"""))


@add("f08_parent_comment", X.oracle("thr_cmt", "SELECT id, parent FROM with_parent WHERE NOT is_top_level", PARENT))
def f08(spark, sf_dir):
    replies = H.with_parent_comment(X.thr_cmt(spark, sf_dir)).filter(~F.col("is_top_level"))
    return replies.select("id", "parent")


def placed(spark, sf_dir):
    rows = H.with_parent_comment(X.thr_cmt(spark, sf_dir))
    return H.with_context(H.with_post(rows, X.thr_post(spark, sf_dir)))


@add("f09_context_by_place", X.oracle("thr_cmt thr_post", "SELECT turn, context, count(*) AS n, CAST(sum(length(CASE context WHEN 'post' THEN post WHEN 'earlier comment' THEN parent ELSE '' END)) AS BIGINT) AS chars FROM placed GROUP BY 1, 2", *CONTEXT))
def f09(spark, sf_dir):
    return placed(spark, sf_dir).groupBy("turn", "context").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("context_text")).alias("chars"))


@add("f10_validated_join", X.oracle("rate", "SELECT id, final, model_a, model_b FROM rate"))
def f10(spark, sf_dir):
    rate = cut_lineage(X.rate(spark, sf_dir).select("id", "final", "model_a", "model_b"))  # read by all three sides
    first = H.join_validated(rate.select("id", "final"), rate.select("id", "model_a"), ["id"])
    return H.join_validated(first, rate.select("id", "model_b"), ["id"])


ORPHANS = ("orphans", "SELECT c.* FROM thr_cmt c WHERE NOT EXISTS (SELECT 1 FROM thr_post p WHERE p.submission_id = c.submission_id)")


@add("f11_orphans", X.oracle("thr_cmt thr_post", "SELECT count(*) AS orphan_comments, count(DISTINCT submission_id) AS missing_posts FROM orphans", ORPHANS))
def f11(spark, sf_dir):
    lost = H.orphans(X.thr_cmt(spark, sf_dir).select("submission_id"), X.thr_post(spark, sf_dir), key="submission_id")
    return lost.agg(F.count(F.lit(1)).alias("orphan_comments"), F.count_distinct("submission_id").alias("missing_posts"))


@add("f12_orphan_origin", X.oracle("cmt sub", """
    SELECT CASE WHEN r.id IS NULL THEN 'already absent' ELSE 'removed by cleaning' END AS origin, count(*) AS posts
    FROM (SELECT DISTINCT submission_id FROM cmt WHERE submission_id NOT IN (SELECT id FROM sub WHERE selftext IS NOT NULL)) m
    LEFT JOIN sub r ON r.id = m.submission_id GROUP BY 1"""))
def f12(spark, sf_dir):
    raw = X.sub(spark, sf_dir)
    return H.orphan_origin(X.cmt(spark, sf_dir).select("submission_id"), raw.filter("selftext is not null"), raw)


@add("f13_orphans_per_month", X.oracle("cmt sub", "SELECT source_month, count(*) AS orphan_comments FROM cmt WHERE submission_id NOT IN (SELECT id FROM sub) GROUP BY 1"))
def f13(spark, sf_dir):
    rows = X.cmt(spark, sf_dir).select("submission_id", "source_month")
    return H.orphans(rows, X.sub(spark, sf_dir)).groupBy("source_month").agg(F.count(F.lit(1)).alias("orphan_comments"))


@add("f14_leakage_exclusion", X.oracle("rate", """
    SELECT count(*) AS pool, count(*) FILTER (WHERE submission_id IN (SELECT submission_id FROM rate WHERE label_1 = 'skip')) AS same_thread,
      count(*) FILTER (WHERE id IN (SELECT id FROM rate WHERE label_1 = 'skip')) AS same_comment FROM rate"""))
def f14(spark, sf_dir):
    """Rows in threads of a held-out set, counted with one join per key."""
    rate = X.rate(spark, sf_dir)
    held = rate.filter("label_1 = 'skip'")
    pool = rate.select("id", "submission_id")
    left = H.without_threads(pool, held).agg(F.count(F.lit(1)).alias("left"))
    same = pool.join(held.select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("same_comment"))
    whole = pool.agg(F.count(F.lit(1)).alias("pool"))
    one = F.lit(1).alias("one")
    joined = (whole.select("*", one).join(left.select("*", one), "one").join(same.select("*", one), "one"))
    return joined.select("pool", (F.col("pool") - F.col("left")).alias("same_thread"), "same_comment")


@add("f15_id_set_equality", X.oracle("cmt rate", """
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 0 ELSE 1 END AS in_left, CASE WHEN b.id IS NULL THEN 0 ELSE 1 END AS in_right
    FROM (SELECT DISTINCT id FROM cmt) a FULL JOIN (SELECT DISTINCT id FROM rate) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL"""))
def f15(spark, sf_dir):
    return H.same_ids(X.cmt(spark, sf_dir), X.rate(spark, sf_dir), "id")


@add("f16_split_disjointness", X.oracle("rate", "SELECT submission_id, count(DISTINCT term) AS n_splits FROM rate GROUP BY 1 HAVING count(DISTINCT term) > 1"))
def f16(spark, sf_dir):
    """Threads that occur in both terms: a split by term would not keep threads whole."""
    return H.split_overlap(X.rate(spark, sf_dir), "submission_id", "term")


@add("f17_ignored_label_rows", X.oracle("rate", """
    SELECT l.part, count(*) AS label_rows, count(s.id) AS used, count(*) - count(s.id) AS ignored
    FROM (SELECT id, k % 3 + 1 AS part FROM rate) l LEFT JOIN (SELECT id, k % 2 + 1 AS part FROM rate) s ON l.id = s.id AND l.part = s.part GROUP BY 1"""))
def f17(spark, sf_dir):
    rate = X.rate(spark, sf_dir)
    labels = rate.select("id", (F.col("k") % 3 + 1).alias("part"))
    sample = rate.select("id", (F.col("k") % 2 + 1).alias("part"), F.lit(1).alias("here"))
    joined = labels.join(sample, ["id", "part"], "left")
    return joined.groupBy("part").agg(F.count(F.lit(1)).alias("label_rows"), F.count("here").alias("used"),
                                      F.count_if(F.col("here").isNull()).alias("ignored"))


@add("f18_raw_and_clean", X.oracle("cmt sub", """
    SELECT 'comments' AS kind, (SELECT count(*) FROM cmt) AS rows_raw, (SELECT count(*) FROM cc) AS rows_clean, 16 AS columns_raw, 24 AS columns_clean
    UNION ALL SELECT 'submissions', (SELECT count(*) FROM sub), (SELECT count(*) FROM linked WHERE fate = 'kept'), 12, 27""", *CLEAN, *POSTS))
def f18(spark, sf_dir):
    raw_c, raw_s = X.cmt(spark, sf_dir), X.sub(spark, sf_dir)
    clean_c = C.clean_comments(raw_c, SETTINGS)
    with_flair = raw_s.withColumn("author_flair_text", F.lit(None).cast("string"))  # the view has no flair
    clean_s = C.clean_posts(with_flair, clean_c, SETTINGS)
    parts = None
    for kind, raw, clean in (("comments", raw_c, clean_c), ("submissions", raw_s, clean_s)):
        both = (raw.agg(F.count(F.lit(1)).alias("rows_raw")).withColumn("kind", F.lit(kind))
                .join(clean.agg(F.count(F.lit(1)).alias("rows_clean")).withColumn("kind", F.lit(kind)), "kind"))
        both = both.withColumns({"columns_raw": F.lit(len(raw.columns)), "columns_clean": F.lit(len(clean.columns))})
        parts = both if parts is None else parts.unionByName(both)
    return parts
