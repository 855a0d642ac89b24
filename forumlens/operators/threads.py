"""Joins between posts, comments and answers, and checks on them.

All of them are equi-joins. A thread that holds a large part of the comments is split at run time by the
skew handling of adaptive execution, see ``forumlens.session``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens import fixed_values as V
from forumlens.functions.text import mentions, mentions_any, strip, strip_id_prefix


def children_of(comments: DataFrame, thread: str = "submission_id", flags: dict | None = None) -> DataFrame:
    """One row per thread: how many comments it has and which flags occur. Collapses before the shuffle."""
    flags = flags or {}
    return comments.filter(F.col(thread).isNotNull()).groupBy(thread).agg(
        F.count(F.lit(1)).alias("n_children"), *[F.bool_or(c).alias(name) for name, c in flags.items()])


def flag_parents(posts: DataFrame, comments: DataFrame, flags: dict, key: str = "id",
                 thread: str = "submission_id") -> DataFrame:
    """Add to each post whether it has a child and whether one of its children has each flag."""
    kids = children_of(comments, thread, flags).withColumnRenamed(thread, "__thread")
    joined = posts.join(kids, posts[key] == kids["__thread"], "left")
    added = {"has_child": F.col("n_children").isNotNull(),
             **{name: F.coalesce(F.col(name), F.lit(False)) for name in flags}}
    return joined.withColumns(added).drop("__thread", "n_children")


def has_keyword_child(posts: DataFrame, comments: DataFrame, keyword: str, body="body",
                      out: str = "has_keyword_comment") -> DataFrame:
    """Mark posts under which somebody uses the keyword."""
    talking = comments.filter(mentions(body, keyword)).select("submission_id")
    return flag_parents(posts, talking, {}).withColumnRenamed("has_child", out)


def relevant_posts(posts: DataFrame, comments: DataFrame, keyword: str, fields=("title", "selftext")) -> DataFrame:
    """Posts that use the keyword themselves or have a comment that does."""
    flagged = has_keyword_child(posts, comments, keyword)
    return (flagged.withColumn("mentions_keyword", mentions_any(list(fields), keyword))
            .withColumn("in_scope", F.col("mentions_keyword") | F.col("has_keyword_comment")))


def _one_per_key(df: DataFrame, on: list[str], side: str) -> DataFrame:
    """The table itself; running it fails where a key occurs twice. The rows are grouped by the key that the join
    needs them grouped by, so the check costs no pass of its own."""
    others = [c for c in df.columns if c not in on]
    row = F.first(F.struct(*others)) if others else F.first(F.lit(1))
    message = F.concat(F.lit(f"{side}: "), F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in on]),
                       F.lit(" occurs "), F.col("__n").cast("string"), F.lit(" times"))
    grouped = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"), row.alias("__row"))
    checked = grouped.filter(F.when(F.col("__n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    return checked.select(*on, *[F.col("__row").getField(c).alias(c) for c in others])


def join_validated(left: DataFrame, right: DataFrame, on: list[str], cardinality: str = "1:1",
                   how: str = "inner") -> DataFrame:
    """Join that fails on a repeated key: ``1:1`` on either side, ``m:1`` on the right side."""
    if cardinality not in ("1:1", "m:1"):
        raise ValueError(f"unknown cardinality {cardinality!r}")
    one = _one_per_key(left, on, "left side") if cardinality == "1:1" else left
    return one.join(_one_per_key(right, on, "right side"), on, how)


def with_post(comments: DataFrame, posts: DataFrame, text: str = "post", how: str = "left") -> DataFrame:
    """The post of each comment; with a left join a missing post becomes an empty text."""
    joined = comments.join(posts, "submission_id", how)
    return joined.withColumn(text, strip(F.coalesce(F.col(text), F.lit("")))) if how == "left" else joined


def with_parent_comment(comments: DataFrame, text: str = "comment", out: str = "parent") -> DataFrame:
    """The comment that each reply answers, from the same table.

    A direct answer to a post has no parent here. It gets a key of its own that no id equals, as a null key
    would send all of them to one task.
    """
    parents = comments.select(F.col("id").alias("__pid"), F.col(text).alias(out))
    child = comments.withColumn("__key", F.when(
        ~F.col("is_top_level"), strip_id_prefix("parent_id", f"^{V.COMMENT_PREFIX}")
    ).otherwise(F.concat(F.lit("none:"), F.col("id"))))
    joined = child.join(parents, F.col("__key") == F.col("__pid"), "left").drop("__pid", "__key")
    return joined.withColumn(out, strip(F.coalesce(F.col(out), F.lit(""))))


def with_context(comments: DataFrame, post: str = "post", parent: str = "parent") -> DataFrame:
    """Context by place: the post for a direct answer, the earlier comment for a reply, else nothing."""
    kind = (F.when(F.col("is_top_level") & (F.col(post) != ""), "post")
            .when(~F.col("is_top_level") & (F.col(parent) != ""), "earlier comment").otherwise("none"))
    text = (F.when(F.col("context") == "post", F.col(post))
            .when(F.col("context") == "earlier comment", F.col(parent)).otherwise(""))
    return comments.withColumn("context", kind).withColumn("context_text", text)


def orphans(comments: DataFrame, posts: DataFrame, thread: str = "submission_id", key: str = "id") -> DataFrame:
    """Comments whose post is not in the table."""
    ids = posts.select(F.col(key).alias(thread)).distinct()
    return comments.join(ids, thread, "left_anti")


def orphan_origin(comments: DataFrame, clean_posts: DataFrame, raw_posts: DataFrame,
                  thread: str = "submission_id", key: str = "id") -> DataFrame:
    """Missing posts: never collected, or removed by the cleaning."""
    missing = orphans(comments, clean_posts, thread, key).select(thread).distinct()
    known = raw_posts.select(F.col(key).alias("__raw")).distinct()
    joined = missing.join(known, missing[thread] == known["__raw"], "left")
    origin = F.when(F.col("__raw").isNull(), "already absent").otherwise("removed by cleaning")
    return joined.groupBy(origin.alias("origin")).agg(F.count(F.lit(1)).alias("posts"))


def same_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids that only one of two tables holds; empty when both hold the same set."""
    sides = (left.select(key, F.lit(1).alias("in_left"), F.lit(0).alias("in_right"))
             .unionByName(right.select(key, F.lit(0).alias("in_left"), F.lit(1).alias("in_right"))))
    return (sides.groupBy(key).agg(F.max("in_left").alias("in_left"), F.max("in_right").alias("in_right"))
            .filter(F.col("in_left") != F.col("in_right")))


def without_threads(rows: DataFrame, held_out: DataFrame, thread: str = "submission_id") -> DataFrame:
    """Rows whose thread is not part of a held-out set."""
    return rows.join(held_out.select(thread).distinct(), thread, "left_anti")


def split_overlap(rows: DataFrame, thread: str, split: str) -> DataFrame:
    """Threads that occur in more than one split; empty when the splits are disjoint."""
    return (rows.groupBy(thread).agg(F.count_distinct(split).alias("n_splits")).filter("n_splits > 1"))
