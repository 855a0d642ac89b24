import pytest
from pyspark.sql import functions as F

from forumlens.operators import cleaning as C
from forumlens.operators import dedupe as D
from forumlens.operators import threads as H
from forumlens.operators.profile import MissingColumnsError, QualityError, require_columns, require_no_violations, violations
from forumlens.plans import fixtures as X
from forumlens.plans.f_joins import MONTHS

COMMENT = ("id string, submission_id string, parent_id string, created_utc long, source_month string, subreddit string, "
           "author string, author_flair_text string, body string, score int, controversiality int, distinguished string, "
           "stickied boolean, edited string")


def comment(i, author, body, thread="s1", **more):
    row = {"id": f"c{i}", "submission_id": thread, "parent_id": f"t3_{thread}", "created_utc": 100 + i, "source_month": "2017-01",
           "subreddit": "politics", "author": author, "author_flair_text": None, "body": body, "score": 1, "controversiality": 0,
           "distinguished": None, "stickied": False, "edited": "False", **more}
    return tuple(row.values())


@pytest.fixture
def comments(spark):
    return spark.createDataFrame([
        comment(1, "ann", "Trump again"), comment(2, "ann", "Trump again"), comment(3, "ann", "Trump again", "s2"),
        comment(4, "[deleted]", "Trump again"), comment(5, "[deleted]", "Trump again"),
        comment(6, None, "Trump again"), comment(7, None, "Trump again"),
        comment(8, "AutoModerator", "Trump rule"), comment(9, "mod", "Trump rule", distinguished="moderator"),
        comment(10, "bob", "> Trump quoted"), comment(11, "bob", "> Trump quoted\nsource?", "s3")], COMMENT)


def test_comment_cleaning_and_funnel(comments):
    clean = C.clean_comments(comments)
    kept = {r["id"]: r["only_in_quote"] for r in clean.collect()}
    assert kept == {"c1": False, "c3": False, "c4": False, "c5": False, "c6": False, "c11": True}
    funnel = {r["stage"]: r["rows"] for r in C.comment_funnel(comments).collect()}
    assert funnel == {"raw": 11, "bot_or_mod": 2, "duplicate": 2, "empty_after_clean": 1, "kept": 6, "kept_only_in_quote": 1}
    assert funnel["raw"] == sum(funnel[s] for s in ("bot_or_mod", "duplicate", "empty_after_clean", "kept"))
    assert dict(clean.dtypes)["controversiality"] == "tinyint" and dict(clean.dtypes)["year"] == "smallint"


def test_equal_exempt_rows_all_stay(spark):
    rows = spark.createDataFrame([comment(1, "[deleted]", "x")] * 5 + [comment(1, "ann", "x")] * 5, COMMENT)
    kept = D.drop_repeated_posts(rows, ["created_utc", "id"])
    assert sorted((r["author"], r["count"]) for r in kept.groupBy("author").count().collect()) == [("[deleted]", 5), ("ann", 1)]


def test_cleaning_runs_once_per_row(comments):
    """The text is cleaned behind the removal of copies and not a second time in a filter below it."""
    plan = C.clean_comments(comments)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("&gt;|>") == 1
    assert "Python" not in plan


def test_posts_follow_their_comments(spark, comments):
    posts = spark.createDataFrame([
        ("s1", "[Removed by moderator]", "[removed]", "x"), ("s2", "A title", None, "x"), ("s3", "Other", "text", "x"),
        ("s4", "[Removed by moderator]", "", "x"), ("s5", "Trump speaks", "[deleted]", "x"), ("s6", "Weather", "rain", "x")],
        "id string, title string, selftext string, author string").withColumns({
            "created_utc": F.lit(1), "source_month": F.lit("2017-01"), "subreddit": F.lit("politics"),
            "author_flair_text": F.lit(None).cast("string"), "distinguished": F.lit(None).cast("string")})
    linked = C.link_posts(C.prepare_posts(posts), C.clean_comments(comments))
    fate = {r["id"]: (r["fate"], r["in_scope"]) for r in linked.collect()}
    assert fate == {
        "s1": ("kept", True), "s2": ("kept", True), "s3": ("kept", False),
        "s4": ("junk title, no comment left", False), "s5": ("kept", True), "s6": ("out of scope, no comment left", False)}
    clean = C.clean_posts(posts, C.clean_comments(comments))
    assert {r["id"]: r["text_clean"] for r in clean.collect()} == {"s1": "", "s2": "A title", "s3": "Other\ntext", "s5": "Trump speaks"}


def test_month_funnel_has_empty_months(spark, sf_dir):
    funnel = C.month_funnel(X.cmt(spark, sf_dir), X.sub(spark, sf_dir), "the", MONTHS).collect()
    assert {r["month"] for r in funnel} == set(MONTHS)
    empty = [r for r in funnel if r["month"].endswith("-07")]
    assert all(r["all_comments"] == 0 and r["comment_retention_rate"] == 0.0 for r in empty) and len(empty) == 4


def test_keep_first_null_keys_and_gate(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 1, "z"), (None, 1, "z")], "id string, t int, v string")
    kept = D.keep_first(rows, ["id"], ["t"], exempt=D.has_null(["id"])).collect()
    assert sorted((r["id"] or "", r["v"]) for r in kept) == [("", "z"), ("", "z"), ("a", "y")]
    with pytest.raises(D.DuplicateKeyError):
        D.require_unique(rows, ["id"])
    report = D.duplicate_report(rows, "id", "t").first()
    assert (report["rows"], report["null_ids"], report["duplicate_rows"]) == (4, 2, 1)


def test_validated_join_rejects_copies(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b")], "id int, v string")
    right = spark.createDataFrame([(1, "c")], "id int, w string")
    with pytest.raises(Exception, match="left side: 1 occurs 2 times"):
        H.join_validated(left, right, ["id"], "1:1").collect()
    with pytest.raises(Exception, match="right side: 1 occurs 2 times"):
        H.join_validated(right, left, ["id"], "m:1").count()
    assert H.join_validated(left, right, ["id"], "m:1").count() == 2


def test_gates(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, None), (2, -1.0)], "id int, w double")
    report = violations(rows, {"w is positive": F.col("w") > 0}, {"id is unique": ["id"]})
    assert {r["rule"]: r["n_bad"] for r in report.collect()} == {"w is positive": 2, "id is unique": 1}
    with pytest.raises(QualityError):
        require_no_violations(report)
    with pytest.raises(MissingColumnsError):
        require_columns(rows, ["id", "body"])


def test_hot_thread_is_split(spark):
    """One thread holds most comments: the join splits its partition instead of giving it to one task."""
    for key, value in {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.autoBroadcastJoinThreshold": "-1",
                       "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}.items():
        spark.conf.set(key, value)
    try:
        comments = spark.range(0, 200_000, 1, 8).select(
            F.concat(F.lit("c"), "id").alias("id"), F.when(F.col("id") % 3 < 2, "s0").otherwise(F.concat(F.lit("s"), F.col("id") % 500)).alias("submission_id"),
            F.sha2(F.col("id").cast("string"), 256).alias("comment"))
        posts = spark.range(500).select(F.concat(F.lit("s"), "id").alias("submission_id"), F.lit("post").alias("post"))
        joined = H.with_post(comments, posts)
        assert joined.select(F.count("post"), F.count_distinct("id")).first() == (200_000, 200_000)
        joined.write.format("noop").mode("overwrite").save()
        sizes = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "skew" in plan.lower() or sizes < 200_000
    finally:
        for key in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold",
                    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
