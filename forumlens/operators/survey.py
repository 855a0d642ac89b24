"""Survey waves: harmonise into one table of respondents, weight, check and describe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens import fixed_values as V
from forumlens.functions.flags import lookup
from forumlens.operators import profile as P
from forumlens.operators.ranking import attach
from forumlens.session import cut_lineage, small_side

ROLES = ["id", "weight", "approval", "strength", "date", "party", "ideology", "gender", "age",
         "age_category", "education", "education_category", "mode"]


def code_label(code: Column | str, mapping: dict) -> Column:
    """Category of a numeric code; a code that is not in the map gives null."""
    c = F.col(code) if isinstance(code, str) else code
    return lookup(c.cast("int"), mapping)


def ladder(value: Column | str, steps: list[tuple], refused_from: int) -> Column:
    """Category by inclusive upper bounds; refused answers and nulls give null."""
    v = F.col(value) if isinstance(value, str) else value
    rule = F.when(v.isNull() | (v >= refused_from), F.lit(None).cast("string"))
    for upper, name in steps:
        rule = rule.otherwise(name) if upper is None else rule.when(v <= upper, name)
    return rule


def age_group(age: Column | str) -> Column:
    return ladder(age, V.AGE_GROUPS, V.AGE_REFUSED_FROM)


def education_group(code: Column | str) -> Column:
    return ladder(code, V.EDUCATION_GROUPS, V.EDUCATION_REFUSED_FROM)


def six_digits(code: Column | str) -> Column:
    """A numeric date with its lost leading zero."""
    c = F.col(code) if isinstance(code, str) else code
    text = c.cast("bigint").cast("string")
    return F.when(F.length(text) >= 6, text).otherwise(F.lpad(text, 6, "0"))


def parse_day(value: Column | str, style: str) -> Column:
    """The day of an interview; what does not parse becomes null."""
    c = F.col(value) if isinstance(value, str) else value
    if style == "mddyy":
        return F.try_to_date(six_digits(c), "MMddyy")
    if style == "yymmdd":
        return F.try_to_date(six_digits(c), "yyMMdd")
    if style == "date":
        return c.cast("date")
    if style == "atp":
        return F.try_to_timestamp(c, F.lit("d-MMM-yyyy HH:mm:ss")).cast("date")
    raise ValueError(f"unknown date style {style!r}")


def date_styles(df: DataFrame, wave: str, code: str) -> DataFrame:
    """Both readings of a numeric date, per wave: how many fail, earliest and latest day."""
    parsed = df.filter(F.col(code).isNotNull()).select(
        wave, parse_day(code, "mddyy").alias("mddyy"), parse_day(code, "yymmdd").alias("yymmdd"))
    wide = parsed.groupBy(wave).agg(*[a for s in ("mddyy", "yymmdd") for a in (
        F.count_if(F.col(s).isNull()).alias(f"bad_{s}"), F.min(s).alias(f"first_{s}"), F.max(s).alias(f"last_{s}"))])
    items = F.array(*[F.struct(F.lit(s).alias("style"), F.col(f"bad_{s}").alias("not_parsed"),
                               F.col(f"first_{s}").cast("string").alias("earliest"),
                               F.col(f"last_{s}").cast("string").alias("latest")) for s in ("mddyy", "yymmdd")])
    return wide.select(wave, F.inline(items))


def id_text(column: str, dtype: str) -> Column:
    """Respondent id as text: whole numbers without a decimal point, text trimmed."""
    numeric = dtype in ("double", "float", "int", "bigint", "smallint", "tinyint") or dtype.startswith("decimal")
    return F.col(column).cast("bigint").cast("string") if numeric else F.trim(F.col(column))


def variables(wave: dict) -> list[tuple[str, str]]:
    """The raw variable of every role that the wave has."""
    return [(role, wave[role]) for role in ROLES if wave.get(role)]


def harmonise_wave(df: DataFrame, wave: dict) -> DataFrame:
    """One wave in the common schema, as a single projection. The weight stays raw here."""
    P.require_columns(df, [name for _, name in variables(wave)], wave["wave_id"])
    types = dict(df.dtypes)
    if wave.get("asked"):
        df = df.filter(F.col(wave["asked"]).isNotNull())
    text = F.lit(None).cast("string")
    exact_age = wave.get("age") is not None
    age = F.col(wave["age"]) if exact_age else None
    return df.select(
        F.lit(wave["wave_id"]).alias("wave_id"),
        F.lit(wave["family"]).alias("source_family"),
        id_text(wave["id"], types[wave["id"]]).alias("orig_id"),
        parse_day(wave["date"], wave["date_format"]).alias("interview_date"),
        (code_label(wave["mode"], V.PANEL_MODE) if wave.get("mode") else F.lit(wave["family"])).alias("mode"),
        code_label(wave["approval"], V.APPROVAL).alias("approval"),
        (code_label(wave["strength"], V.STRENGTH) if wave.get("strength") else text).alias("approval_strength"),
        code_label(wave["party"], V.PARTY).alias("party_lean"),
        code_label(wave["ideology"], V.IDEOLOGY).alias("ideology"),
        code_label(wave["gender"], V.GENDER_PHONE if exact_age else V.GENDER_PANEL).alias("gender"),
        (F.when(age < V.AGE_REFUSED_FROM, age.cast("double")) if exact_age
         else F.lit(None).cast("double")).alias("age"),
        (age_group(age) if exact_age else code_label(wave["age_category"], V.AGE_CATEGORY)).alias("age_group"),
        (education_group(wave["education"]) if wave.get("education")
         else code_label(wave["education_category"], V.EDUCATION_PANEL)).alias("education"),
        F.col(wave["weight"]).cast("double").alias("weight_raw"))


def normalised_weights(respondents: DataFrame, wave: str = "wave_id", weight: str = "weight_raw") -> DataFrame:
    """Weight over the mean weight of the wave. The means are one row per wave; no window over a wave."""
    means = respondents.groupBy(wave).agg(F.avg(weight).alias("__mean"))
    return attach(respondents, small_side(means), [wave]).withColumn("weight_norm", F.col(weight) / F.col("__mean")).drop("__mean")


def harmonise(sources: dict[str, DataFrame], waves: list[dict] = V.WAVES, weights: bool = True) -> DataFrame:
    """All waves in one table of respondents, weights rescaled to mean one inside each wave.

    Rescaling needs a first pass over the weights; leave it out where only raw weights are used.
    """
    absent = [w["wave_id"] for w in waves if w["wave_id"] not in sources]
    if absent:
        raise FileNotFoundError(f"no input for waves {absent}")
    parts = [harmonise_wave(sources[w["wave_id"]], w) for w in waves]
    respondents = reduce(lambda a, b: a.unionByName(b), parts)
    return normalised_weights(respondents) if weights else respondents


def locate(name: str, available: list[str]) -> str:
    """The input of a wave: by its exact name, else by its letters and digits, and only if that is unique."""
    if name in available:
        return name
    hits = [a for a in available if P.safe_name(a) == P.safe_name(name)]
    if len(hits) != 1:
        raise FileNotFoundError(f"cannot find {name}, candidates {hits}")
    return hits[0]


def crosswalk(spark, waves: list[dict], labels: dict | None = None) -> DataFrame:
    """Which raw variable became which role, with the start of its question text."""
    labels = labels or {}
    rows = [(w["wave_id"], role, name, (labels.get((w["wave_id"], name)) or "")[:150])
            for w in waves for role, name in variables(w)]
    return spark.createDataFrame(rows, "wave_id string, role string, raw_variable string, raw_label string")


def wave_quality(respondents: DataFrame) -> DataFrame:
    """Field dates, sizes and weighted approval per wave; "don't know" stays in the base."""
    asked = F.col("approval").isNotNull()
    weight = F.when(asked, F.col("weight_raw"))
    return respondents.groupBy("wave_id").agg(
        F.min("interview_date").cast("string").alias("field_start"),
        F.max("interview_date").cast("string").alias("field_end"),
        F.count(F.lit(1)).alias("n_respondents"),
        F.count_if(asked).alias("n_asked_approval"),
        F.round(100 * F.sum(F.when(F.col("approval") == "approve", weight).otherwise(F.lit(0.0)))
                / F.sum(weight), 6).alias("approve_pct"))


def respondent_gates(respondents: DataFrame, max_days: int = V.MAX_FIELD_DAYS) -> DataFrame:
    """Violations: repeated respondents, dates that did not parse, bad weights, long fieldwork."""
    row_rules = P.violations(respondents, {
        "interview date is known": F.col("interview_date").isNotNull(),
        "weight is positive": F.col("weight_raw") > 0,
    }, {"respondent is unique in a wave": ["wave_id", "orig_id"]})
    spans = respondents.groupBy("wave_id").agg(
        F.datediff(F.max("interview_date"), F.min("interview_date")).alias("days"))
    long_waves = spans.agg(F.count_if(F.col("days") > max_days).alias("n_bad"))
    return row_rules.unionByName(long_waves.select(F.lit(f"fieldwork at most {max_days} days").alias("rule"), "n_bad"))


def bin_check(df: DataFrame, age: str = "age", group: str = "age_group", edges=(17, 29, 49, 64, 120),
              names=("18-29", "30-49", "50-64", "65+")) -> DataFrame:
    """Ages binned a second, independent way and compared with the stored group."""
    rule = F
    for low, high, name in zip(edges, edges[1:], names):
        rule = rule.when((F.col(age) > low) & (F.col(age) <= high), name)
    known = df.filter(F.col(age).isNotNull()).select(rule.alias("binned"), F.col(group).alias("stored"))
    return known.agg(F.count(F.lit(1)).alias("rows"),
                     F.count_if(~F.col("binned").eqNullSafe(F.col("stored"))).alias("mismatches"))


def name_overlap(book: DataFrame, families: dict[str, list[str]], wave: str = "wave", variable: str = "variable") -> DataFrame:
    """Names shared by all waves, by the waves of each family, between families, and how widely."""
    waves = sorted({w for ws in families.values() for w in ws})
    name = F.lower(F.col(variable)).alias("name")
    per_name = book.groupBy(name).agg(
        F.count_distinct(wave).alias("n_waves"),
        *[F.count_distinct(F.when(F.col(wave).isin(ws), F.col(wave))).alias(f"in_{f}") for f, ws in families.items()])
    shared_by = [F.count_if(F.col(f"in_{f}") == len(ws)).alias(f"shared_by_{f}") for f, ws in families.items()]
    across = reduce(lambda a, b: a & b, [F.col(f"in_{f}") > 0 for f in families])
    return per_name.agg(
        F.count(F.lit(1)).alias("names"),
        F.count_if(F.col("n_waves") == len(waves)).alias("in_all_waves"), *shared_by,
        F.count_if(across).alias("in_every_family"),
        F.count_if(F.col("n_waves") == 1).alias("in_one_wave"),
        F.count_if(F.col("n_waves") >= 2).alias("in_two_or_more"),
        F.count_if(F.col("n_waves") >= 5).alias("in_five_or_more"))


def unique_candidates(df: DataFrame, wave: str, candidates: list[str]) -> DataFrame:
    """Whether the values of a candidate id differ in every row of a wave."""
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("v")) for c in candidates])
    counted = df.select(wave, F.inline(pairs)).groupBy(wave, "variable", "v").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(wave, "variable").agg((F.max("n") == 1).alias("all_different"))


def names_matching(book: DataFrame, pattern: str, wave: str = "wave", variable: str = "variable") -> DataFrame:
    """Variables of each wave whose name starts with a pattern, as one list in their order. A wave may have any number of
    them: ranges of names are put in order by themselves, and joined at last."""
    hits = cut_lineage(book.filter(F.col(variable).rlike(f"(?i)^(?:{pattern})")).select(wave, variable))
    dealt = hits.repartitionByRange(wave, variable).withColumn("__range", F.spark_partition_id())
    listed = dealt.groupBy(wave, "__range").agg(F.array_join(F.sort_array(F.collect_list(variable)), ", ").alias("__names"))
    ranges = F.sort_array(F.collect_list(F.struct("__range", "__names")))
    return listed.groupBy(wave).agg(F.array_join(F.transform(ranges, lambda r: r["__names"]), ", ").alias("variables_found"))


def kept_summary(book: DataFrame, walk: DataFrame) -> DataFrame:
    """Variables per wave: all, kept by the crosswalk, dropped."""
    roles = walk.select(F.col("wave_id").alias("wave"), F.col("raw_variable").alias("variable")).distinct()
    joined = book.join(roles.withColumn("kept", F.lit(1)), ["wave", "variable"], "left")
    return joined.groupBy("wave").agg(
        F.count(F.lit(1)).alias("total"), F.count("kept").alias("kept"),
        F.count_if(F.col("kept").isNull()).alias("dropped"),
        F.round(100.0 * F.count("kept") / F.count(F.lit(1)), 1).alias("kept_pct"))


def panel_overlap(respondents: DataFrame, first: str, second: str, key: str = "orig_id") -> DataFrame:
    """Respondents of one wave, of another, and of both: one grouping, no join."""
    rows = respondents.filter(F.col("wave_id").isin(first, second))
    per_person = rows.groupBy(key).agg(
        F.max((F.col("wave_id") == first).cast("int")).alias("a"), F.max((F.col("wave_id") == second).cast("int")).alias("b"))
    return per_person.agg(F.sum("a").alias("in_first"), F.sum("b").alias("in_second"),
                          F.sum(F.col("a") * F.col("b")).cast("bigint").alias("in_both"))
