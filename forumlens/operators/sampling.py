"""Deterministic stratified samples, quotas and splits.

Chance comes from SHA-256 over the id, so the sample depends neither on the machine nor on how the data
is partitioned. Small tables with one row per stratum are ordered as a whole; rows never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from forumlens import fixed_values as V
from forumlens.operators.ranking import (
    alternate, attach, first_per_group, group_row_numbers, group_sizes, hash_rank)
from forumlens.session import cut_lineage, small_side


def allocate(sizes: DataFrame, strata: list[str], total: int, size: str = "stratum_size",
             out: str = "stratum_sampled") -> DataFrame:
    """Split ``total`` over the strata as evenly as their sizes allow.

    A small stratum is taken whole and what it could not give goes to the others. With the strata in order
    of size the common cap follows from a running sum; the remainder goes out one by one in key order.
    """
    everything = W.partitionBy()
    by_size = W.orderBy(size, *strata)
    ordered = sizes.withColumns({
        "__rn": F.row_number().over(by_size),
        "__before": F.coalesce(F.sum(size).over(by_size.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "__strata": F.count(F.lit(1)).over(everything),
        "__all": F.sum(size).over(everything)})
    share = F.floor((F.lit(total) - F.col("__before")) / (F.col("__strata") - F.col("__rn") + 1)).cast("bigint")
    capped = ordered.withColumn("__share", share).withColumn("__cap", F.coalesce(
        F.min(F.when(F.col(size) > F.col("__share"), F.struct("__rn", "__share"))).over(everything).getField("__share"),
        F.max(size).over(everything)))
    base = capped.withColumns({
        "__n": F.least(F.col(size), F.col("__cap")), "__larger": (F.col(size) > F.col("__cap")).cast("int")})
    rest = F.lit(total) - F.sum("__n").over(everything)
    turn = F.sum("__larger").over(W.orderBy(*strata).rowsBetween(W.unboundedPreceding, 0))
    taken = F.col("__n") + F.when((F.col("__larger") == 1) & (turn <= rest), 1).otherwise(0)
    short = F.raise_error(F.concat(F.lit("only "), F.col("__all").cast("string"), F.lit(f" eligible rows for a sample of {total}")))
    return base.withColumn(out, F.when(F.col("__all") < total, short.cast("bigint")).otherwise(taken).cast("bigint")).drop(
        "__rn", "__before", "__strata", "__all", "__share", "__cap", "__n", "__larger")


def settled_ranks(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Eligible rows with their hash rank, written once: sizes, cuts and the draw all read them again, and
    whatever decided their eligibility, often a look at the text, is not repeated."""
    return cut_lineage(rows.withColumn("rank", hash_rank(key, seed)))


def total_of(sizes: DataFrame, percent: int, size: str = "stratum_size") -> int:
    """A whole number of rows: a percentage of all eligible rows, rounded down."""
    return sizes.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"] * percent // 100


def stratified_sample(eligible: DataFrame, strata: list[str], total: int | None = None, parts: int = 2, key: str = "id",
                      seed: int = V.SEED, texts: DataFrame | None = None, percent: int | None = None) -> DataFrame:
    """A sample spread evenly over the strata, dealt out to parts with a reading order inside each.

    Its size is ``total`` rows or ``percent`` of the eligible ones. ``eligible`` is narrow. With ``texts``, a table of id and text, the texts are looked up last.
    """
    ranked = settled_ranks(eligible, key, seed)
    sizes = cut_lineage(group_sizes(ranked, strata, "stratum_size"))
    plan = small_side(allocate(sizes, strata, total if percent is None else total_of(sizes, percent)))
    chosen = first_per_group(ranked, strata, "rank", plan, "stratum_sampled", [key]).drop("__position")
    # the sample is small and looked at several times from here on
    placed = alternate(cut_lineage(attach(chosen, plan, strata)), strata, "rank", parts, "part", [key])
    out = group_row_numbers(cut_lineage(placed), ["part"], "rank", "order", [key]).drop("rank")
    return out if texts is None else with_texts(out, texts, key)


def with_texts(sample: DataFrame, texts: DataFrame, key: str = "id") -> DataFrame:
    """The texts of a sample: the large table is cut down to the chosen ids before anything else.

    The sample is settled first, so its size decides how the two are joined and it is not drawn twice.
    """
    chosen = small_side(sample)
    return chosen.join(texts.join(chosen.select(key), key, "left_semi"), key, "left")


def fingerprint(sample: DataFrame, key: str = "id", digits: int = 4) -> DataFrame:
    """A digest of the ids of a sample that does not depend on their order.

    The ids are cut into ``16 ** digits`` buckets by their hash; a bucket's digest is over its sorted ids, one per
    line, and the result is over the digests in the order of the buckets. So no task sees all ids.
    """
    ids = sample.select(F.col(key).alias("__id"), F.substring(F.sha2(F.col(key).cast("string"), 256), 1, digits).alias("__bucket"))
    buckets = ids.groupBy("__bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("__id")), "\n"), 256).alias("digest"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("__bucket", "digest"))), lambda x: x["digest"])
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(ordered, "\n"), 256).alias("sha256"))


def require_fingerprint(sample: DataFrame, expected: str, key: str = "id") -> DataFrame:
    found = fingerprint(sample, key).first()["sha256"]
    if found != expected:
        raise ValueError(f"the sample has fingerprint {found}, expected {expected}")
    return sample


def even_quota(total: Column, groups: Column, position: Column, offset: Column) -> Column:
    """An even share; the remainder goes to the groups from position ``offset`` on."""
    extra = F.pmod(position - offset, groups) < F.pmod(total, groups)
    return F.floor(total / groups).cast("bigint") + extra.cast("bigint")


def even_quotas(groups: DataFrame, total: int, order: list, offset: int = 0, out: str = "quota") -> DataFrame:
    position = F.row_number().over(W.orderBy(*order)) - 1
    return groups.withColumn(out, even_quota(F.lit(total), F.count(F.lit(1)).over(W.partitionBy()), position, F.lit(offset)))


def two_level_quotas(sizes: DataFrame, outer: str, inner: str, inner_values: list, total: int,
                     size: str = "n") -> DataFrame:
    """Equal per outer group, then equal per inner value, remainders in turn; larger outer groups first."""
    spark = sizes.sparkSession
    outers = sizes.groupBy(outer).agg(F.sum(size).alias("__size"))
    order = W.orderBy(F.desc("__size"), outer)
    placed = outers.withColumns({"__i": F.row_number().over(order) - 1, "__k": F.count(F.lit(1)).over(W.partitionBy())})
    outer_quota = placed.withColumn("__q", even_quota(F.lit(total), F.col("__k"), F.col("__i"), F.lit(0)))
    values = F.array(*[F.struct(F.lit(v).alias(inner), F.lit(j).alias("__j")) for j, v in enumerate(inner_values)])
    each = outer_quota.select(outer, "__i", "__q", F.inline(values))
    quota = even_quota(F.col("__q"), F.lit(len(inner_values)), F.col("__j"), F.col("__i"))
    have = sizes.select(outer, inner, F.col(size).alias("available"))
    full = attach(each.withColumn("quota", quota), have, [outer, inner])
    return full.select(outer, inner, "quota", F.coalesce("available", F.lit(0)).alias("available"))


def quota_sample(rows: DataFrame, outer: str, inner: str, inner_values: list, total: int, key: str = "id",
                 seed: int = V.SEED) -> DataFrame:
    """Rows by hash order inside each cell of the two-level quotas; an error where a cell is short."""
    ranked = settled_ranks(rows, key, seed)
    quotas = two_level_quotas(group_sizes(ranked, [outer, inner]), outer, inner, inner_values, total)
    where = F.concat_ws(" ", F.lit("not enough rows in"), outer, inner)
    checked = quotas.withColumn("quota", F.when(F.col("available") < F.col("quota"), F.raise_error(where).cast("bigint"))
                                .otherwise(F.col("quota")))
    return first_per_group(ranked, [outer, inner], "rank", small_side(checked.select(outer, inner, "quota")), "quota", [key]).drop("__position")


def n_per_group(rows: DataFrame, by: list[str], n: int, key: str = "id", seed: int = V.SEED) -> DataFrame:
    """``n`` rows of each group in hash order."""
    ranked = settled_ranks(rows, key, seed)
    limits = group_sizes(ranked, by, "__size").withColumn("__wanted", F.lit(n)).drop("__size")
    return first_per_group(ranked, by, "rank", small_side(limits), "__wanted", [key]).withColumnRenamed("__position", "position")


def random_subset(rows: DataFrame, n: int, key: str = "id", seed: int = V.SEED) -> DataFrame:
    """``n`` rows in hash order; a distributed top-n."""
    return rows.withColumn("rank", hash_rank(key, seed)).orderBy("rank", key).limit(n)


def split_name(fold: str = "fold") -> Column:
    """Fold 0 is the test part, fold 1 the validation part, the rest trains."""
    return F.when(F.col(fold) == 0, "test").when(F.col(fold) == 1, "validation").otherwise("train")


def design_weight(size: str, sampled: str) -> Column:
    return F.col(size) / F.col(sampled)


def weighted_percent(condition: Column, weight: Column) -> Column:
    """Aggregate: weighted share of rows in per cent."""
    return 100 * F.sum(F.when(condition, weight).otherwise(F.lit(0.0))) / F.sum(weight)


def over_limits(rows: DataFrame, length: str, weight: str, limits: list[int] = V.TOKEN_LIMITS) -> DataFrame:
    """Share of rows longer than each limit, plain and weighted, in one pass."""
    wide = rows.agg(*[a for t in limits for a in (
        (100 * F.avg((F.col(length) > t).cast("double"))).alias(f"__p{t}"),
        weighted_percent(F.col(length) > t, F.col(weight).cast("double")).alias(f"__w{t}"))])
    cells = F.array(*[F.struct(F.lit(t).alias("limit"), F.round(f"__p{t}", 6).alias("share_of_sample"),
                               F.round(f"__w{t}", 6).alias("share_weighted")) for t in limits])
    return wide.select(F.inline(cells))
