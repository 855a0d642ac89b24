"""Bootstrap intervals and standard errors from tables of counts.

A resample of rows changes a statistic only through how often each combination of labels is drawn. So the
rows are counted once into cells, and each replicate is one multinomial draw over the cells: the distribution
of drawing the rows one by one, at a cost that does not grow with the table. The same method is used at every size.
Leaving one row out changes one cell, so the jackknife standard error takes one replicate per cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from forumlens import fixed_values as V
from forumlens.session import cut_lineage

def count_cells(df: DataFrame, by: list[str], labels: list[str]) -> DataFrame:
    return df.groupBy(*by, *labels).agg(F.count(F.lit(1)).alias("n"))


def _multinomial(seed: int):
    @F.pandas_udf("array<bigint>")
    def draw(replicate: pd.Series, group: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for r, g, c in zip(replicate, group, counts):
            cell = np.asarray(c, dtype="float64")
            rng = np.random.default_rng([seed, int(r), int(g) & 0xFFFFFFFF])
            out.append(rng.multinomial(int(cell.sum()), cell / cell.sum()))
        return pd.Series(out)
    return draw


def _packed(cells: DataFrame, by: list[str], labels: list[str]) -> DataFrame:
    """The cells of each group as one array; there are at most as many as combinations of labels."""
    return cells.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*labels, "n"))).alias("__cells"))


def resample(cells: DataFrame, by: list[str], labels: list[str], n_boot: int = V.N_BOOT, seed: int = V.SEED) -> DataFrame:
    """How often each cell is drawn in each replicate; every replicate draws as many rows as the group has."""
    group = F.xxhash64(*by) if by else F.lit(0).cast("bigint")
    replicates = (_packed(cells, by, labels).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
                  .repartition("replicate"))
    drawn = replicates.withColumn("__m", _multinomial(seed)("replicate", group, F.col("__cells.n")))
    pairs = drawn.select(*by, "replicate", F.explode(F.arrays_zip("__cells", "__m")).alias("z"))
    return pairs.select(*by, "replicate", *[F.col(f"z.__cells.{c}").alias(c) for c in labels], F.col("z.__m").alias("m"))


def leave_one_out(cells: DataFrame, by: list[str], labels: list[str]) -> DataFrame:
    """The cells with one row of the cell number ``replicate`` left out; ``times``: the rows that this stands for."""
    numbered = _packed(cells, by, labels).select(*by, "__cells", F.posexplode("__cells").alias("replicate", "__out"))
    pairs = numbered.select(*by, "replicate", F.col("__out.n").alias("times"), F.posexplode("__cells").alias("__at", "z"))
    return pairs.select(*by, "replicate", "times", *[F.col(f"z.{c}").alias(c) for c in labels],
                        (F.col("z.n") - (F.col("__at") == F.col("replicate")).cast("long")).alias("m"))


def jackknife(cells: DataFrame, by: list[str], labels: list[str], statistics) -> DataFrame:
    """The jackknife standard error of every statistic, as ``<name>_se``, one row per group."""
    out = leave_one_out(cells, by, labels)
    values = statistics(out, [*by, "replicate", "times"], F.col("m"))
    names = [c for c in values.columns if c not in (*by, "replicate", "times")]
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # a few rows per group, one for each cell
    n = F.sum("times")
    centred = values.select(*by, "times", *[(F.col(c) - F.sum(F.col(c) * F.col("times")).over(group)
                                             / F.sum(F.when(F.col(c).isNotNull(), F.col("times"))).over(group)).alias(c) for c in names])
    return centred.groupBy(*by).agg(n.alias("__rows"), *[F.sqrt((n - 1) / n * F.sum(F.col("times") * F.col(c) * F.col(c))).alias(f"{c}_se") for c in names])


def interval(values: DataFrame, by: list[str], columns: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Lower and upper quantile over the replicates of each group: at most ``n_boot`` values each."""
    return values.groupBy(*by).agg(*[a for c in columns for a in (
        F.percentile(c, low).alias(f"{c}_low"), F.percentile(c, high).alias(f"{c}_high"))])


def with_intervals(df: DataFrame, by: list[str], labels: list[str], statistics, n_boot: int = V.N_BOOT,
                   seed: int = V.SEED) -> DataFrame:
    """Statistics of the data with interval ends, standard errors and the number of rows, one row per group.

    ``statistics`` maps a table of cells and its weight column to one row per group of the given keys.
    """
    cells = cut_lineage(count_cells(df, by, labels))
    point = statistics(cells, by, F.col("n"))
    names = [c for c in point.columns if c not in by]
    bounds = interval(statistics(resample(cells, by, labels, n_boot, seed), [*by, "replicate"], F.col("m")), by, names)
    errors = jackknife(cells, by, labels, statistics)
    if not by:
        one = F.lit(1).alias("__one")
        for side in (bounds, errors):
            point = point.select("*", one).join(F.broadcast(side.select("*", one)), "__one").drop("__one")
        return point
    return point.join(bounds, by).join(errors, by)


# between so many standard errors from the value a 95 % interval has to end: 1.96, give or take the skew of small
# groups and the noise of the replicates
REACH = (1.0, 3.0)
TINY = 1e-9
ENOUGH = 30  # below so many rows the two have no reason to agree


def ends_fit(value: Column, low: Column, high: Column, error: Column) -> Column:
    """Whether both ends of an interval stand at a plausible distance from the value; null for small groups."""
    fits = F.when(error <= TINY, (F.abs(low - value) < 1e-6) & (F.abs(high - value) < 1e-6)).otherwise(
        ((value - low) / error).between(*REACH) & ((high - value) / error).between(*REACH))
    return F.when(F.col("__rows") >= ENOUGH, fits)


def as_rows(wide: DataFrame, by: list[str], names: list[str], digits: int = 6) -> DataFrame:
    """One row per statistic with value, standard error, ci_low, ci_high and whether the interval fits the error."""
    cells = F.array(*[F.struct(F.lit(n).alias("measure"), F.round(n, digits).alias("value"),
                               F.round(f"{n}_low", digits).alias("ci_low"), F.round(f"{n}_high", digits).alias("ci_high"),
                               F.round(f"{n}_se", digits).alias("se"),
                               ends_fit(F.col(n), F.col(f"{n}_low"), F.col(f"{n}_high"), F.col(f"{n}_se")).alias("ci_fits"))
                      for n in names])
    return wide.select(*by, F.inline(cells))
