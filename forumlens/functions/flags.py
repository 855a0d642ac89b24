"""Row flags, time labels and label rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from forumlens import fixed_values as V
from forumlens.functions.text import _col, flag, strip


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lookup(column: Column | str, mapping: dict) -> Column:
    """The value of a literal map, null for an unknown key."""
    return F.try_element_at(literal_map(mapping), _col(column))


def is_bot_or_moderator(author="author", distinguished="distinguished", bots=tuple(V.BOT_AUTHORS)) -> Column:
    """Accounts from a curated list or marked as moderator; no guess from the name."""
    return flag(_col(distinguished) == "moderator") | flag(_col(author).isin(list(bots)))


def is_deleted_author(author="author") -> Column:
    return flag(_col(author) == V.DELETED)


def is_top_level(parent="parent_id") -> Column:
    return _col(parent).startswith(V.POST_PREFIX)


def is_edited(edited="edited") -> Column:
    """Null stays null: it is not known whether such a row was edited."""
    return _col(edited) != "False"


def edited_at_seconds(edited="edited") -> Column:
    return _col(edited).try_cast("double")


def utc_time(seconds="created_utc") -> Column:
    return F.timestamp_seconds(_col(seconds))


def year_of_month(month="source_month") -> Column:
    return F.substring(_col(month), 1, 4)


def period_of_month(month="source_month", periods: dict = V.PERIODS) -> Column:
    return lookup(year_of_month(month), periods)


def term_of_period(period: Column | str) -> Column:
    return F.substring(_col(period), 1, 2)


def in_study_window(day: Column | str, years=tuple(V.PERIODS), months=V.STUDY_MONTHS) -> Column:
    d = _col(day)
    return F.year(d).isin([int(y) for y in years]) & F.month(d).between(*months)


def era(day: Column | str, second_from: int = V.SECOND_ERA_FROM) -> Column:
    return F.when(F.year(_col(day)) >= second_from, "second").when(_col(day).isNotNull(), "first")


def trimmed_flair(flair="author_flair_text") -> Column:
    return F.nullif(strip(flair), F.lit(""))


def declared_stance(flair="author_flair_text", community="subreddit",
                    only_in: str = V.FLAIR_COMMUNITY, mapping: dict = V.FLAIR_STANCE) -> Column:
    """Stance from the author's flair, where the community uses flair for that."""
    clean = trimmed_flair(flair)
    known = lookup(F.lower(clean), mapping)
    return F.when(_col(community) == only_in,
                  F.when(clean.isNotNull(), F.coalesce(known, F.lit("other"))))


def label_by_threshold(score: Column | str, threshold: float = V.TONE_THRESHOLD,
                       classes: list[str] = V.CLASSES) -> Column:
    against, neutral, pro = classes
    s = _col(score)
    return F.when(s >= threshold, pro).when(s <= -threshold, against).otherwise(neutral)


def argmax_label(probabilities: dict[str, str]) -> Column:
    """The class with the highest probability; the first one wins a tie, a row without scores gets null."""
    items = list(probabilities.items())
    best = F.greatest(*[F.col(c) for _, c in items]) if len(items) > 1 else F.col(items[0][1])
    scored = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for _, c in items])
    picked = reduce(lambda acc, item: acc.when(F.col(item[1]) == best, item[0]), items, F)
    return F.when(scored, picked)


def signed_score(p_pro="p_pro", p_against="p_against") -> Column:
    return _col(p_pro) - _col(p_against)


def outcome(before: Column | str, after: Column | str, truth: Column | str) -> Column:
    """What a second answer did to a first one."""
    b, a, t = _col(before), _col(after), _col(truth)
    return F.when(a == t, "now right").when(b == t, "now wrong").otherwise("still wrong")


def sided_with(final: Column | str, first: Column | str, second: Column | str) -> Column:
    f = _col(final)
    return F.when(f == _col(first), "annotator 1").when(f == _col(second), "annotator 2").otherwise("neither")
