"""Profiles of any table: missing values, pseudo-missing values, flags, counts, ranges and crosstabs.

Most profiles are one aggregation with a counter per question, which leaves one row per group; only that
row is turned into a long table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from forumlens import fixed_values as V
from forumlens.operators.ranking import attach


class MissingColumnsError(ValueError):
    """A table lacks columns that the next step needs."""


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: list[str], what: str = "table") -> DataFrame:
    """Stop before any work when a column is missing."""
    missing = missing_columns(df, required)
    if missing:
        raise MissingColumnsError(f"{what}: missing required columns: {missing}")
    return df


def keep_columns(df: DataFrame, keep: list[str], what: str = "table") -> tuple[DataFrame, dict]:
    """The named columns, and how many columns were there, kept and dropped."""
    require_columns(df, keep, what)
    counts = {"columns": len(df.columns), "kept": len(keep), "dropped": len(df.columns) - len(keep)}
    return df.select(*keep), counts


def _long(wide: DataFrame, keys: list[str], entries: list[tuple[str, dict]], name: str) -> DataFrame:
    """Turn a row of aggregates into one row per entry."""
    items = F.array(*[F.struct(F.lit(label).alias(name), *[c.alias(n) for n, c in columns.items()])
                      for label, columns in entries])
    return wide.select(*keys, F.inline(items))


def null_profile(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Null count and share per column, for the whole table or per group."""
    columns, by = columns or [c for c in df.columns if c not in (by or [])], by or []
    wide = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"__null_{i}") for i, c in enumerate(columns)])
    return _long(wide, by, [
        (c, {"nulls": F.col(f"__null_{i}"),
             "null_pct": F.round(100.0 * F.col(f"__null_{i}") / F.col("__rows"), 1),
             "all_null": F.col(f"__null_{i}") == F.col("__rows")})
        for i, c in enumerate(columns)], "column_name")


def spread(long: DataFrame, rows: list[str], across: str, values: list, cell: Column, fill=None) -> DataFrame:
    """Long to wide over a known list of values: conditional aggregates, no job to look the values up."""
    wide = long.groupBy(*rows).agg(*[
        F.max(F.when(F.col(across) == v, cell)).alias(str(v)) for v in values])
    return wide if fill is None else wide.na.fill(fill, [str(v) for v in values])


def pseudo_missing(df: DataFrame, columns: list[str], values: list[str] = V.PSEUDO_MISSING) -> DataFrame:
    """Share of rows that hold text meaning "no value"."""
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *[
        F.count_if(F.col(c) == v).alias(f"__{i}_{j}")
        for i, c in enumerate(columns) for j, v in enumerate(values)])
    cells = [F.struct(F.lit(c).alias("column_name"), F.lit(v).alias("value"),
                      F.col(f"__{i}_{j}").alias("rows"),
                      F.round(100.0 * F.col(f"__{i}_{j}") / F.col("__rows"), 6).alias("pct"))
             for i, c in enumerate(columns) for j, v in enumerate(values)]
    return wide.select(F.inline(F.array(*cells)))


def low_cardinality_columns(df: DataFrame, columns: list[str], limit: int = 5) -> list[str]:
    """Columns that can have at most ``limit`` different values.

    The sketch is only a filter: for so few values its estimate cannot exceed the truth by one, so no
    column is lost, and the exact count happens on the survivors. One row of estimates reaches the driver.
    """
    estimates = df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"), F.lit(10))).alias(f"e{i}")
                         for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if (estimates[f"e{i}"] or 0) <= limit + 1]


def value_kind(value: Column) -> Column:
    return (F.when(value.isNull(), "null").when(value.isin(V.FALSE_LIKE), "False-like")
            .when(value.isin(V.TRUE_LIKE), "True-like").otherwise("other"))


def value_counts(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows per value of several columns, values as text, null as a value of its own."""
    by = by or []
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(*by, F.inline(pairs)).groupBy(*by, "column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def low_cardinality_scan(df: DataFrame, columns: list[str], limit: int = 5) -> DataFrame:
    """Columns with few values: share of false-like, true-like, other and null, and whether the column is
    a flag in disguise."""
    candidates = low_cardinality_columns(df, columns, limit)
    if not candidates:
        return df.sparkSession.createDataFrame([], "column_name string, n_values long, false_like_pct double, true_like_pct double, "
                                                   "other_pct double, null_pct double, bool_like boolean")
    boolean = [c for c in candidates if dict(df.dtypes)[c] == "boolean"]
    counts = value_counts(df, candidates)
    kind = value_kind(F.col("value"))
    shares = counts.withColumn("kind", kind).groupBy("column_name").agg(
        F.count("value").alias("n_values"),
        F.sum("n").alias("__rows"),
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"__{i}")
          for i, k in enumerate(["False-like", "True-like", "other", "null"])])
    share = {name: F.round(100.0 * F.col(f"__{i}") / F.col("__rows"), 6)
             for i, name in enumerate(["false_like_pct", "true_like_pct", "other_pct", "null_pct"])}
    disguised = (~F.col("column_name").isin(boolean) if boolean else F.lit(True)) & \
        (F.col("__2") == 0) & (F.col("__0") + F.col("__1") > 0)
    return shares.filter(F.col("n_values") <= limit).select(
        "column_name", "n_values", *[c.alias(n) for n, c in share.items()], disguised.alias("bool_like"))


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with a single value next to nulls: the smallest value equals the largest."""
    wide = df.agg(*[f(F.col(c).cast("string")).alias(f"__{n}_{i}") for i, c in enumerate(columns)
                    for n, f in (("lo", F.min), ("hi", F.max))])
    long = _long(wide, [], [(c, {"value": F.col(f"__lo_{i}"), "last": F.col(f"__hi_{i}")})
                            for i, c in enumerate(columns)], "column_name")
    return long.filter(F.col("value") == F.col("last")).select("column_name", "value")


def mixed_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """Which kinds of value the text of a column holds: logical, number, other text, null."""
    wide_aggs = []
    for i, c in enumerate(columns):
        v = F.trim(F.col(c))
        is_bool = F.lower(v).isin("true", "false")
        is_number = v.try_cast("double").isNotNull()
        wide_aggs += [F.count_if(is_bool).alias(f"__b{i}"), F.count_if(~is_bool & is_number).alias(f"__n{i}"),
                      F.count_if(~is_bool & ~is_number).alias(f"__t{i}"), F.count_if(v.isNull()).alias(f"__z{i}")]
    wide = df.agg(*wide_aggs)
    return _long(wide, [], [
        (c, {"logical": F.col(f"__b{i}"), "number": F.col(f"__n{i}"), "other_text": F.col(f"__t{i}"),
             "nulls": F.col(f"__z{i}"),
             "repair": F.when(F.col(f"__b{i}") + F.col(f"__n{i}") + F.col(f"__t{i}") == 0, "none")
             .when(F.col(f"__n{i}") + F.col(f"__t{i}") == 0, "boolean").otherwise("string")})
        for i, c in enumerate(columns)], "column_name")


def to_boolean(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    value = F.lower(F.trim(c.cast("string")))
    return F.when(value == "true", True).when(value == "false", False)


def repair_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that hold only true and false become boolean, the others text.

    The decision needs one row of counters from a scan of those columns.
    """
    plan = {r["column_name"]: r["repair"] for r in mixed_types(df, columns).collect()}
    return df.withColumns({c: to_boolean(c) if plan[c] == "boolean" else F.col(c).cast("string")
                           for c in columns if plan[c] != "none"})


def flag_rates(df: DataFrame, flags: list[str], by: list[str]) -> DataFrame:
    """How often and how commonly each flag is set; unknown flags are skipped in the mean."""
    return df.groupBy(*by).agg(*[a for c in flags for a in (
        F.count_if(F.col(c)).alias(f"{c}_n"),
        F.round(F.avg(F.col(c).cast("int")), 6).alias(f"{c}_share"))])


def flag_pct(df: DataFrame, flags: list[str], by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.round(100 * F.avg(F.col(c).cast("int")), 6).alias(c) for c in flags])


def counts_side_by_side(tables: dict[str, DataFrame], by: str) -> DataFrame:
    """Rows per category in several tables, zero where one table lacks the category."""
    stacked = None
    for name, df in tables.items():
        part = df.groupBy(F.col(by).alias("category")).agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.lit(name))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy("category").agg(*[
        F.coalesce(F.sum(F.when(F.col("t") == name, F.col("n"))), F.lit(0)).alias(name) for name in tables])


def shares(df: DataFrame, by: list[str], within: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Rows and percentage per category. The window runs over the table of categories."""
    counted = df.groupBy(*(within or []), *by).agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(W.partitionBy(*(within or [])))
    return counted.withColumn("pct", F.round(100.0 * F.col("rows") / total, digits))


def crosstab(df: DataFrame, row: str, column: str, values: list, null_as: str | None = None,
             weight: Column | None = None) -> DataFrame:
    """Counts of ``row`` by known values of ``column``; absent cells are zero."""
    r, c = F.col(row), F.col(column)
    if null_as is not None:
        r, c = F.coalesce(r.cast("string"), F.lit(null_as)), F.coalesce(c.cast("string"), F.lit(null_as))
    return df.groupBy(r.alias(row)).agg(*[F.count_if(c == v).alias(str(v)) for v in values])


def crosstab_with_margins(df: DataFrame, row: str, column: str, total: str = "All") -> DataFrame:
    """Long crosstab with row, column and grand totals. The cube runs over the counted pairs."""
    pairs = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    cube = pairs.cube(row, column).agg(F.sum("n").alias("n"), F.grouping(row).alias("gr"), F.grouping(column).alias("gc"))
    return cube.select(
        F.when(F.col("gr") == 1, total).otherwise(F.col(row)).alias(row),
        F.when(F.col("gc") == 1, total).otherwise(F.col(column)).alias(column), "n")


def row_shares(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Crosstab whose rows sum to one; absent cells are zero."""
    counted = df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"__{i}") for i, v in enumerate(values)])
    whole = sum((F.col(f"__{i}") for i in range(len(values))), F.lit(0))
    return counted.select(row, *[
        F.round(F.coalesce(F.try_divide(F.col(f"__{i}").cast("double"), whole.cast("double")), F.lit(0.0)), 6).alias(str(v))
        for i, v in enumerate(values)])


def top_counts(df: DataFrame, key: str, k: int = 15) -> DataFrame:
    """The ``k`` most frequent keys, ties by key."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(k))


def overview(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns before and after per table, share of rows removed, and a total row."""
    stacked = None
    for side, tables in (("before", before), ("after", after)):
        for kind, df in tables.items():
            part = df.agg(F.count(F.lit(1)).alias("n")).select(
                F.lit(kind).alias("kind"), F.lit(side).alias("side"), "n", F.lit(len(df.columns)).cast("bigint").alias("columns"))
            stacked = part if stacked is None else stacked.unionByName(part)
    rolled = stacked.rollup("kind").agg(*[
        F.sum(F.when(F.col("side") == side, F.col(column))).alias(f"{name}_{side}")
        for name, column in (("rows", "n"), ("cols", "columns")) for side in ("before", "after")])
    return rolled.select(
        F.coalesce("kind", F.lit("TOTAL")).alias("kind"), "rows_before", "rows_after", "cols_before", "cols_after",
        F.round(100.0 * (1 - F.col("rows_after") / F.col("rows_before")), 2).alias("rows_removed_pct"))


def value_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    wide = df.agg(*[f(c).cast("double").alias(f"__{n}_{i}") for i, c in enumerate(columns)
                    for n, f in (("lo", F.min), ("hi", F.max))])
    return _long(wide, [], [(c, {"min": F.col(f"__lo_{i}"), "max": F.col(f"__hi_{i}")})
                            for i, c in enumerate(columns)], "column_name")


def violations(df: DataFrame, rules: dict[str, Column], unique: dict[str, list[str]] | None = None) -> DataFrame:
    """How many rows break each rule. A null condition breaks its rule."""
    wide = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"__{i}") for i, ok in enumerate(rules.values())])
    out = _long(wide, [], [(name, {"n_bad": F.col(f"__{i}")}) for i, name in enumerate(rules)], "rule")
    for name, key in (unique or {}).items():
        extra = (df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
                 .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_bad")))
        out = out.unionByName(extra.select(F.lit(name).alias("rule"), "n_bad"))
    return out


class QualityError(ValueError):
    """A table breaks one of its rules."""


def require_no_violations(report: DataFrame) -> DataFrame:
    broken = report.filter("n_bad > 0").orderBy("rule").collect()
    if broken:
        raise QualityError("; ".join(f"{r['rule']}: {r['n_bad']}" for r in broken))
    return report


def codebook(df: DataFrame, wave: str, columns: list[str]) -> DataFrame:
    """Distinct values and share missing per wave and column.

    Values are counted before they are counted distinct, so a frequent value travels once per task.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("v")) for c in columns])
    counted = (df.select(wave, F.inline(pairs)).groupBy(wave, "variable", "v").agg(F.count(F.lit(1)).alias("n")))
    return counted.groupBy(wave, "variable").agg(
        F.count("v").alias("unique_values"),
        F.round(100.0 * F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)) / F.sum("n"), 1).alias("missing_pct"))


def safe_name(text: str) -> str:
    """Letters and digits only, lower case: the form in which file names are compared."""
    return re.sub(r"[\W_]", "", text.lower())


def fixed_order(df: DataFrame, key: str, categories: list, fill: dict | None = None) -> DataFrame:
    """Rows in a given order of categories; a category without rows is there with the fill values."""
    dimension = df.sparkSession.createDataFrame([(i + 1, c) for i, c in enumerate(categories)], f"position int, {key} string")
    joined = attach(dimension, df, [key])
    return joined.na.fill(fill) if fill else joined
