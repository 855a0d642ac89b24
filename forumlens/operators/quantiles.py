"""Exact quantiles with linear interpolation that never sort a whole column in one task.

A mergeable sketch with a guaranteed rank error brackets each wanted order statistic. A second pass counts
the values below the bracket and keeps only distinct values inside it, cut into slices, so the exact step sorts a sliver
of a sliver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from forumlens.operators.ranking import attach
from forumlens.session import cut_lineage, small_side

ACCURACY = 10_000


SLICES = 256


def _slice(value: str, low: str, high: str) -> Column:
    """The slice of a bracket that a value lies in; slices are in the order of the values."""
    share = F.try_divide(F.col(value) - F.col(low), F.col(high) - F.col(low))
    return F.coalesce(F.least(F.floor(share * SLICES), F.lit(SLICES - 1)), F.lit(0)).cast("int")


def exact_quantiles(df: DataFrame, by: list[str], value: str, probabilities: dict[str, float],
                    accuracy: int = ACCURACY, settle: bool = False) -> DataFrame:
    """One row per group with a column per entry of ``probabilities``; nulls are left out.

    The values are read twice. ``settle`` writes them once first, for values that are costly to compute, such
    as the length of a text.
    """
    keys = by or ["__all"]
    rows = df if by else df.withColumn("__all", F.lit(0))
    rows = rows.select(*keys, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    rows = cut_lineage(rows) if settle else rows
    extremes = {0.0: "__min", 1.0: "__max"}
    inner = {n: p for n, p in probabilities.items() if p not in extremes}
    names, probs = list(inner), list(inner.values())
    slack = 4.0 / accuracy
    low = [max(0.0, p - slack) for p in probs]
    high = [min(1.0, p + slack) for p in probs]
    sketch = [F.percentile_approx("__v", low, accuracy).alias("__low"), F.percentile_approx("__v", high, accuracy).alias("__high")]
    brackets = cut_lineage(rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), *(sketch if inner else [])))
    ends = brackets.select(*keys, *[F.col(extremes[p]).alias(n) for n, p in probabilities.items() if p in extremes])
    if not inner:
        return ends.select(*by, *probabilities)
    # in a small group the rank error is below one row, so the whole group is its own bracket
    small = F.col("__n") <= accuracy
    spec = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(p).alias("p"),
                 F.when(small | F.lit(lo == 0.0), F.col("__min")).otherwise(F.col("__low")[i]).alias("lo"),
                 F.when(small | F.lit(hi == 1.0), F.col("__max")).otherwise(F.col("__high")[i]).alias("hi"))
        for i, (name, p, lo, hi) in enumerate(zip(names, probs, low, high))])
    wanted = small_side(brackets.select(*keys, F.col("__n"), spec.alias("__spec")))
    marked = attach(rows, wanted, keys)
    # below a bracket only the number of values matters: one counter per quantile, and no row is repeated for it
    below = marked.groupBy(*keys).agg(*[
        F.count_if(F.col("__v") < F.col("__spec")[i].getField("lo")).alias(f"__b{i}") for i in range(len(names))])
    counts = below.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(f"__b{i}").alias("n")) for i, n in enumerate(names)])).alias("b"))
    # inside, every distinct value is counted; a row is repeated only for the brackets that it lies in
    inside = F.filter("__spec", lambda s: F.col("__v").between(s["lo"], s["hi"]))
    cells = cut_lineage(
        marked.select(*keys, "__n", "__v", F.explode(inside).alias("s"))
        .groupBy(*keys, "__n", F.col("s.name").alias("__name"), F.col("s.p").alias("__p"), _slice("__v", "s.lo", "s.hi").alias("__slice"), "__v")
        .agg(F.count(F.lit(1)).alias("__c")))
    # a bracket is cut into slices of equal width; only those that hold the wanted positions are ordered
    named = counts.select(*keys, F.col("b.name").alias("__name"), F.col("b.n").alias("__below"))
    group = [*keys, "__name"]
    place = F.col("__p") * (F.col("__n") - 1)
    lower, upper = F.floor(place), F.ceil(place)
    slices = cells.groupBy(*group, "__p", "__n", "__slice").agg(F.sum("__c").alias("__s"))
    earlier = W.partitionBy(*group).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    placed = attach(slices, small_side(named), group).withColumn("__start", F.col("__below") + F.coalesce(F.sum("__s").over(earlier), F.lit(0)))

    def holds(position: Column) -> Column:
        return (F.col("__start") <= position) & (position < F.col("__start") + F.col("__s"))

    chosen = small_side(placed.filter(holds(lower) | holds(upper)).select(*group, "__slice", "__start", "__below"))
    ordered = W.partitionBy(*group, "__slice").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    running = (attach(cells, chosen, [*group, "__slice"]).filter(F.col("__start").isNotNull())
               .withColumn("__to", F.col("__start") + F.sum("__c").over(ordered)))

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("__to") > position, F.col("__v")))

    outside = (F.max("__below") > F.max(lower)) | (F.max("__to") <= F.max(upper))
    points = running.groupBy(*group).agg(
        F.when(outside, F.raise_error(F.lit("quantile outside its bracket")).cast("double")).otherwise(at(lower)).alias("__a"),
        at(upper).alias("__b"), F.max(place - lower).alias("__f"))
    one = points.select(*keys, "__name", (F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__f")).alias("__q"))
    wide = one.groupBy(*keys).agg(*[
        F.max(F.when(F.col("__name") == name, F.col("__q"))).alias(name) for name in names])
    lost = F.raise_error(F.lit("quantile outside its bracket")).cast("double")
    checked = attach(ends, wide, keys).withColumns({n: F.coalesce(F.col(n), lost) for n in names})
    return checked.select(*by, *probabilities)


def quartile_labels(df: DataFrame, value: str, out: str, unit: str) -> DataFrame:
    """Four bins of about equal size, closed on the right, with a readable range as the label."""
    cuts = exact_quantiles(df, [], value, {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q4": 1.0})
    keyed = df.withColumn("__one", F.lit(1))
    joined = attach(keyed, F.broadcast(cuts.withColumn("__one", F.lit(1))), ["__one"])
    first = F.col("q0").cast("bigint")

    def label(start: Column, end: str) -> Column:
        return F.concat(start.cast("string"), F.lit("-"), F.floor(end).cast("bigint").cast("string"), F.lit(f" {unit}"))

    def after(edge: str) -> Column:
        return F.floor(edge).cast("bigint") + 1

    picked = (F.when(F.col(value) <= F.col("q1"), label(first, "q1"))
              .when(F.col(value) <= F.col("q2"), label(after("q1"), "q2"))
              .when(F.col(value) <= F.col("q3"), label(after("q2"), "q3"))
              .when(F.col(value).isNotNull(), label(after("q3"), "q4")))
    return joined.withColumn(out, picked).drop("__one", "q0", "q1", "q2", "q3", "q4")
