"""The cleaning pipeline of comments and posts, and its funnels."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens import fixed_values as V
from forumlens.functions import flags as G
from forumlens.functions import text as T
from forumlens.operators.dedupe import drop_repeated_posts, keep_first
from forumlens.operators.staging import computed_once
from forumlens.operators.threads import flag_parents
from forumlens.session import cut_lineage


@dataclass(frozen=True)
class Settings:
    """What one study fixes: keyword, accounts, windows and flair names."""

    keyword: str = V.KEYWORD
    bots: tuple = tuple(V.BOT_AUTHORS)
    junk_title: str = V.JUNK_TITLE
    periods: dict = field(default_factory=lambda: dict(V.PERIODS))
    flair_community: str = V.FLAIR_COMMUNITY
    flair_stance: dict = field(default_factory=lambda: dict(V.FLAIR_STANCE))
    order: tuple = ("created_utc", "id")
    full_entities: bool = True


def time_columns(df: DataFrame, settings: Settings) -> DataFrame:
    return df.withColumns({
        "created_at": G.utc_time("created_utc"),
        "year": G.year_of_month().cast("smallint"),
        "period": G.period_of_month("source_month", settings.periods),
    }).withColumn("term", G.term_of_period("period"))


def flair_columns(df: DataFrame, settings: Settings) -> DataFrame:
    return df.withColumns({
        "author_flair_text": G.trimmed_flair(),
        "stance": G.declared_stance(only_in=settings.flair_community, mapping=settings.flair_stance),
    })


def with_clean_text(df: DataFrame, source: str, out: str, settings: Settings) -> DataFrame:
    """The cleaned text, computed once per row."""
    return computed_once(df, out, T.clean_text(source, settings.full_entities))


def clean_comments(comments: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Accounts out, copies out, own words kept; a keyword only in a quote is flagged and kept.

    Copies are decided on the raw text and after the accounts are gone: the order decides the counts.
    """
    people = comments.filter(~G.is_bot_or_moderator(bots=settings.bots))
    single = drop_repeated_posts(people, list(settings.order))
    own = with_clean_text(single, "body", "body_clean", settings).filter(F.col("body_clean") != "")
    flagged = own.withColumns({
        "only_in_quote": ~T.mentions("body_clean", settings.keyword),
        "author_deleted": G.is_deleted_author(),
        "is_top_level": G.is_top_level(),
        "edited": G.is_edited(),
        "score": F.col("score").cast("int"),
        "controversiality": F.col("controversiality").cast("tinyint"),
    })
    return flair_columns(time_columns(flagged, settings), settings).drop("distinguished")


def prepare_posts(posts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Placeholders blanked and flagged, junk titles blanked, title and body joined and cleaned."""
    flagged = posts.withColumns({
        "selftext_deleted": T.is_placeholder("selftext", V.DELETED),
        "selftext_removed": T.is_placeholder("selftext", V.REMOVED),
        "author_deleted": G.is_deleted_author(),
        "title_unusable": T.is_junk_title("title", settings.junk_title),
        "is_mod_or_bot_post": G.is_bot_or_moderator(bots=settings.bots),
    })
    blanked = flagged.withColumns({
        "selftext": T.without_placeholders("selftext"),
        "title": F.when(F.col("title_unusable"), F.lit("")).otherwise(F.col("title")),
    }).withColumn("text", T.title_and_body("title", "selftext"))
    cleaned = with_clean_text(blanked, "text", "text_clean", settings)
    return cleaned.withColumn("mentions_keyword", T.mentions("text_clean", settings.keyword))


def link_posts(posts: DataFrame, comments_clean: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add to prepared posts what their surviving comments say, and why a post would be dropped."""
    direct = {"has_keyword_comment": ~F.col("only_in_quote")}
    linked = flag_parents(posts, comments_clean.select("submission_id", "only_in_quote"), direct)
    scope = F.col("mentions_keyword") | F.col("has_keyword_comment")
    fate = (F.when(F.col("title_unusable") & ~F.col("has_child"), "junk title, no comment left")
            .when(~F.col("in_scope") & ~F.col("has_child"), "out of scope, no comment left")
            .otherwise("kept"))
    return linked.withColumn("in_scope", scope).withColumn("fate", fate)


def clean_posts(posts: DataFrame, comments_clean: DataFrame, settings: Settings = Settings()) -> DataFrame:
    kept = link_posts(prepare_posts(posts, settings), comments_clean, settings).filter(F.col("fate") == "kept")
    return flair_columns(time_columns(kept, settings), settings).drop("fate", "has_child", "distinguished")


# the columns of the cleaned tables, in order, with the types that differ from those of the raw columns
COMMENT_SCHEMA = {
    **dict.fromkeys(["id", "submission_id", "parent_id", "created_utc", "source_month", "subreddit", "author",
                     "author_flair_text", "body"]),
    "score": "int", "controversiality": "tinyint", "stickied": "boolean", "edited": "boolean", "body_clean": "string",
    "only_in_quote": "boolean", "author_deleted": "boolean", "is_top_level": "boolean", "created_at": "timestamp",
    "year": "smallint", "period": "string", "term": "string", "stance": "string"}
POST_SCHEMA = {
    **dict.fromkeys(["id", "created_utc", "source_month", "subreddit", "author", "author_flair_text", "title", "selftext"]),
    "is_self": "boolean", "domain": "string", "url": "string", "link_flair_text": "string", "score": "int", "num_comments": "int",
    "upvote_ratio": "double", "removed_by_category": "string", "stickied": "boolean", "mentions_keyword": "boolean",
    "has_keyword_comment": "boolean", "selftext_deleted": "boolean", "selftext_removed": "boolean", "author_deleted": "boolean",
    "title_unusable": "boolean", "is_mod_or_bot_post": "boolean", "text": "string", "text_clean": "string",
    "created_at": "timestamp", "year": "smallint", "period": "string", "term": "string", "stance": "string", "in_scope": "boolean"}


def final_table(df: DataFrame, schema: dict, order: tuple = ("created_utc", "id")) -> DataFrame:
    """A cleaned table with its final columns and types, ordered by time. Spark orders it by ranges, in all tasks."""
    return df.orderBy(*order).select(*[F.col(c).cast(t) if t else F.col(c) for c, t in schema.items()])


def stage_of(body_clean: Column, keyword_left: Column) -> Column:
    return (F.when(body_clean == "", "empty_after_clean")
            .when(keyword_left, "kept").otherwise("kept_only_in_quote"))


def comment_funnel(comments: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows per stage and their share of the raw rows.

    Copies are counted where they collapse: a group of n equal comments gives n - 1 duplicates, and its
    text is cleaned once.
    """
    exempt = T.flag(F.col("author") == V.DELETED)
    bot = G.is_bot_or_moderator(bots=settings.bots)
    marked = comments.select("author", "submission_id", "body", bot.alias("bot"), exempt.alias("exempt"))
    groups = (marked.withColumns({
        "body": F.when(~F.col("bot"), F.col("body")),
        "author": F.when(~F.col("bot"), F.col("author")),
        "submission_id": F.when(~F.col("bot"), F.col("submission_id"))})
        .groupBy("bot", "exempt", "author", "submission_id", "body").agg(F.count(F.lit(1)).alias("n")))
    survivors = F.when(F.col("exempt"), F.col("n")).otherwise(F.lit(1))
    cleaned = with_clean_text(groups, "body", "text", settings)
    counted = cleaned.select(
        "bot", "n", survivors.alias("left"),
        F.when(~F.col("bot"), stage_of(F.col("text"), T.mentions("text", settings.keyword))).alias("stage"))

    def total(condition: Column, amount: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, amount)), F.lit(0))

    kept = F.col("stage").isin("kept", "kept_only_in_quote")
    wide = counted.agg(
        F.sum("n").alias("raw"),
        total(F.col("bot"), F.col("n")).alias("bot_or_mod"),
        total(~F.col("bot"), F.col("n") - F.col("left")).alias("duplicate"),
        total(F.col("stage") == "empty_after_clean", F.col("left")).alias("empty_after_clean"),
        total(kept, F.col("left")).alias("kept"),
        total(F.col("stage") == "kept_only_in_quote", F.col("left")).alias("kept_only_in_quote"))
    stages = ["raw", "bot_or_mod", "duplicate", "empty_after_clean", "kept", "kept_only_in_quote"]
    pairs = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).cast("bigint").alias("rows")) for s in stages])
    return wide.select("raw", F.inline(pairs)).select(
        "stage", "rows", F.round(100 * F.col("rows") / F.col("raw"), 2).alias("pct_of_raw"))


def month_calendar(df: DataFrame, months: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(m,) for m in months], "month string")


def keyword_summary(comments: DataFrame, keyword: str) -> DataFrame:
    """What the funnels need, from one look at the texts: matches by month, id and thread, and the number of
    all other rows per month. Rows without a match collapse before the shuffle."""
    hit = T.mentions("body", keyword)
    rows = comments.select(F.col("source_month").alias("month"), "id", "submission_id", hit.alias("hit"))
    return rows.groupBy("month", "hit", F.when(F.col("hit"), F.col("id")).alias("id"),
                        F.when(F.col("hit"), F.col("submission_id")).alias("submission_id")).agg(
        F.count(F.lit(1)).alias("n"))


def comment_month_funnel(comments: DataFrame, keyword: str, months: list[str] | None = None) -> DataFrame:
    """Per month: all comments, kept ones, their rate, and repeated ids among the matches.

    Rows without an id are all kept.
    """
    return _month_rates(keyword_summary(comments, keyword), months)


def _month_rates(summary: DataFrame, months: list[str] | None) -> DataFrame:
    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    per_month = summary.groupBy("month").agg(
        F.sum("n").alias("all_comments"),
        rows(F.col("hit")).alias("hits"),
        F.count_distinct("id").alias("distinct_ids"),
        rows(F.col("hit") & F.col("id").isNull()).alias("without_id"))
    if months is not None:
        per_month = month_calendar(summary, months).join(per_month, "month", "left").na.fill(
            0, ["all_comments", "hits", "distinct_ids", "without_id"])
    kept = F.col("distinct_ids") + F.col("without_id")
    rate = F.coalesce(F.try_divide(kept.cast("double"), F.col("all_comments").cast("double")), F.lit(0.0))
    return per_month.select(
        "month", "all_comments", kept.alias("keyword_comments"),
        F.round(rate, 6).alias("comment_retention_rate"),
        (F.col("hits") - kept).alias("duplicate_comments_dropped"))


def flagged_posts(posts: DataFrame, comments: DataFrame, keyword: str,
                  fields: tuple = ("title", "selftext")) -> DataFrame:
    """Posts once per id, with the two relevance flags."""
    return _flag_posts(posts, comments.filter(T.mentions("body", keyword)).select("submission_id"), keyword, fields)


def _flag_posts(posts: DataFrame, talking: DataFrame, keyword: str, fields: tuple = ("title", "selftext")) -> DataFrame:
    single = keep_first(posts, ["id"], ["created_utc"])
    linked = flag_parents(single, talking, {}).withColumnRenamed("has_child", "has_keyword_comment")
    return linked.withColumn("mentions_keyword", T.mentions_any(list(fields), keyword))


def post_month_funnel(flagged: DataFrame) -> DataFrame:
    direct, child = F.col("mentions_keyword"), F.col("has_keyword_comment")
    return flagged.groupBy(F.col("source_month").alias("month")).agg(
        F.count(F.lit(1)).alias("all_submissions"),
        F.count_if(direct | child).alias("relevant_submissions"),
        F.count_if(direct).alias("direct_submissions"),
        F.count_if(child).alias("submissions_with_keyword_comment"),
        F.count_if(~direct & child).alias("comment_only_submissions"))


def relevance_types(flagged: DataFrame) -> DataFrame:
    direct, child = F.col("mentions_keyword"), F.col("has_keyword_comment")
    return flagged.agg(
        F.count_if(direct & ~child).alias("direct_only"),
        F.count_if(~direct & child).alias("comment_only"),
        F.count_if(direct & child).alias("both"))


def month_funnel(comments: DataFrame, posts: DataFrame, keyword: str, months: list[str] | None = None) -> DataFrame:
    """The comment funnel with the post funnel of the same month next to it; the comments are read once."""
    summary = cut_lineage(keyword_summary(comments, keyword))
    talking = summary.filter(F.col("hit")).select("submission_id")
    return _month_rates(summary, months).join(post_month_funnel(_flag_posts(posts, talking, keyword)), "month", "left")
