"""Agreement, evaluation, bootstrap and change statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens import fixed_values as V
from forumlens.functions import flags as G
from forumlens.operators import agreement as A
from forumlens.operators import bootstrap as Z
from forumlens.operators import ranking as R
from forumlens.operators.quantiles import quartile_labels
from forumlens.plans import book as B
from forumlens.plans import fixtures as X
from forumlens.plans.i_sampling import WEIGHTED, folded, FOLDS, weighted

BOOK = B.Book()
add = BOOK.add
CLASSES = V.CLASSES
COUNTS = A.Counts()


# --- SQL: counters and measures --------------------------------------------------------------------
def conf_sql(source: str, truth: str, predicted: str, by: str = "", value: str = "count(*)") -> str:
    def cell(a, b):
        hit = f"{truth} = '{a}' AND {predicted} = '{b}'"
        return f"count(*) FILTER (WHERE {hit})" if value == "count(*)" else f"coalesce(sum({value}) FILTER (WHERE {hit}), 0)"
    cells = ", ".join(f"CAST({cell(a, b)} AS DOUBLE) AS t{i}p{j}" for i, a in enumerate(CLASSES) for j, b in enumerate(CLASSES))
    inside = f"WHERE {truth} IN ('against', 'neutral', 'pro') AND {predicted} IN ('against', 'neutral', 'pro')"
    return f"SELECT {by + ',' if by else ''} {cells} FROM {source} {inside} {'GROUP BY ' + by if by else ''}"


_R = [f"(t{i}p0 + t{i}p1 + t{i}p2)" for i in range(3)]
_C = [f"(t0p{j} + t1p{j} + t2p{j})" for j in range(3)]
_N = f"({' + '.join(_R)})"
_HIT = "(t0p0 + t1p1 + t2p2)"
ACC = f"({_HIT} / {_N})"
_PE = "(" + " + ".join(f"{_R[i]} * {_C[i]}" for i in range(3)) + f") / ({_N} * {_N})"
KAPPA = f"(CASE WHEN {_PE} >= 1 THEN NULL ELSE ({ACC} - {_PE}) / (1 - {_PE}) END)"
_WSEEN = "(0.5 * (t0p1 + t1p0 + t1p2 + t2p1) + t0p2 + t2p0)"
_WEXP = f"(0.5 * ({_R[0]} * {_C[1]} + {_R[1]} * {_C[0]} + {_R[1]} * {_C[2]} + {_R[2]} * {_C[1]}) + {_R[0]} * {_C[2]} + {_R[2]} * {_C[0]})"
WKAPPA = f"(1 - {_WSEEN} * {_N} / nullif({_WEXP}, 0))"
OPPOSITE = f"((t0p2 + t2p0) / {_N})"
SAME = "((t0p0 + t2p2) / nullif(t0p0 + t2p2 + t0p2 + t2p0, 0))"
SPEC = [f"(2 * t{i}p{i} / nullif({_R[i]} + {_C[i]}, 0))" for i in range(3)]
F1 = [f"coalesce({s}, 0)" for s in SPEC]
MACRO = f"(({' + '.join(F1)}) / 3)"
SET = {"comments": _N, "agreement": ACC, "cohen_kappa": KAPPA, "weighted_kappa": WKAPPA, "against_vs_pro": OPPOSITE, "same_direction": SAME}
SCORES = {"accuracy": ACC, "macro_f1": MACRO, "kappa": KAPPA}


def cols(items: dict) -> str:
    return ", ".join(f"round({e}, 6) AS {n}" for n, e in items.items())


def long_sql(source: str, keys: list[str], items: dict) -> str:
    k = "".join(f"{c}, " for c in keys)
    return " UNION ALL ".join(f"SELECT {k}'{n}' AS measure, {e} AS value FROM {source}" for n, e in items.items())


def sql(body: str, *tables) -> str:
    return X.oracle("rate", body, *tables)


MODELS = ["model_a", "model_b"]
LONG = ("long", " UNION ALL ".join(f"SELECT *, '{m}' AS model, {m} AS label FROM rate" for m in MODELS))
PAIRS = ("pairs", "SELECT * FROM rate WHERE label_1 <> 'skip' AND label_2 <> 'skip'")


def pairs(spark, sf_dir):
    return X.rate(spark, sf_dir).filter("label_1 <> 'skip' and label_2 <> 'skip'")


def models_long(spark, sf_dir, keep):
    return A.unpivot_raters(X.rate(spark, sf_dir), ["final", *keep], MODELS)


@add("j01_confusion_counts", sql("SELECT final AS truth, predicted, count(id) AS n FROM (SELECT unnest(['against', 'neutral', 'pro']) AS final), (SELECT unnest(['against', 'neutral', 'pro']) AS predicted) LEFT JOIN (SELECT id, final AS f, model_a AS p FROM rate) ON f = final AND p = predicted GROUP BY 1, 2"))
def j01(spark, sf_dir):
    return A.confusion_long(A.confusion(X.rate(spark, sf_dir), "final", "model_a"))


@add("j02_cohen_kappa", sql(f"SELECT model, round({KAPPA}, 6) AS kappa FROM c", LONG, ("c", conf_sql("long", "final", "label", "model"))))
def j02(spark, sf_dir):
    wide = A.confusion(models_long(spark, sf_dir, []), "final", "label", ["model"])
    return A.measures(wide, ["model"], {"kappa": COUNTS.kappa()})


@add("j03_weighted_kappa", sql(f"SELECT model, round({WKAPPA}, 6) AS weighted_kappa FROM c", LONG, ("c", conf_sql("long", "final", "label", "model"))))
def j03(spark, sf_dir):
    wide = A.confusion(models_long(spark, sf_dir, []), "final", "label", ["model"])
    return A.measures(wide, ["model"], {"weighted_kappa": COUNTS.weighted_kappa()})


ANNOTATORS = (PAIRS, ("c", conf_sql("pairs", "label_1", "label_2")))


@add("j04_agreement_set", sql(f"SELECT {cols(SET)} FROM c", *ANNOTATORS))
def j04(spark, sf_dir):
    return A.measures(A.confusion(pairs(spark, sf_dir), "label_1", "label_2"), [], COUNTS.agreement_set())


@add("j05_specific_agreement", sql(" UNION ALL ".join(f"SELECT '{c}' AS label, round({SPEC[i]}, 6) AS agreement FROM c" for i, c in enumerate(CLASSES)), *ANNOTATORS))
def j05(spark, sf_dir):
    wide = A.confusion(pairs(spark, sf_dir), "label_1", "label_2")
    return A.long_measures(wide, [], {c: F.round(COUNTS.specific(i), 6) for i, c in enumerate(CLASSES)}, "label", "agreement")


@add("j06_marginal_test", sql("SELECT round(chi2, 6) AS chi2, round(exp(-chi2 / 2), 6) AS p FROM (SELECT (e * d1 * d1 - 2 * b * d1 * d2 + a * d2 * d2) / (a * e - b * b) AS chi2 FROM (SELECT " + f"{_R[0]} - {_C[0]} AS d1, {_R[1]} - {_C[1]} AS d2, {_R[0]} + {_C[0]} - 2 * t0p0 AS a, {_R[1]} + {_C[1]} - 2 * t1p1 AS e, -(t0p1 + t1p0) AS b FROM c))", *ANNOTATORS))
def j06(spark, sf_dir):
    wide = A.confusion(pairs(spark, sf_dir), "label_1", "label_2").select(COUNTS.marginal_chi2().alias("chi2"))
    return wide.select(F.round("chi2", 6).alias("chi2"), F.round(F.exp(-F.col("chi2") / 2), 6).alias("p"))


# --- bootstrap -------------------------------------------------------------------------------------
def left_out_sql(source: str, labels: list[str], by: list[str] | None = None) -> tuple:
    """Tables ``cells``: how many rows each combination of labels has; ``left_out``: all rows but one of a cell."""
    by = by or []
    keys = "".join(f"{c}, " for c in by)
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    same = "".join(f" AND n.{c} = d.{c}" for c in by)
    return (
        ("numbered", f"SELECT {keys}{', '.join(labels)}, dense_rank() OVER ({part} ORDER BY {', '.join(labels)}) AS cell, "
                     f"row_number() OVER (PARTITION BY {keys}{', '.join(labels)}) AS place FROM {source}"),
        ("cells", f"SELECT {keys}cell AS replicate, count(*) AS times FROM numbered GROUP BY {keys}cell"),
        ("left_out", f"SELECT d.replicate, n.* FROM cells d JOIN numbered n ON NOT (n.cell = d.replicate AND n.place = 1){same}"))


def error_sql(replicates: str, keys: list[str], by: list[str] | None = None, values: tuple = ("value",)) -> str:
    """The jackknife standard errors of the replicates, one row per ``keys``."""
    by = by or []
    k = ", ".join(f"q.{c}" for c in keys)
    on = "".join(f" AND q.{c} = d.{c}" for c in by)
    inner = ", ".join(f"q.{v}, sum(q.{v} * d.times) OVER w / sum(d.times) FILTER (WHERE q.{v} IS NOT NULL) OVER w AS mean_{v}" for v in values)
    outer = ", ".join(f"sqrt((sum(times) - 1.0) / sum(times) * sum(times * ({v} - mean_{v}) * ({v} - mean_{v}))) AS {v}_se" for v in values)
    plain = ", ".join(keys)
    return (f"SELECT {plain}, sum(times) AS size, {outer} FROM (SELECT {k}, d.times, {inner} FROM {replicates} q JOIN cells d ON q.replicate = d.replicate{on} "
            f"WINDOW w AS (PARTITION BY {k})) GROUP BY {plain}")


def interval_sql(point: str, errors: str, keys: list[str], more: str = "") -> str:
    """Values and errors; both ends of the interval must fit the error."""
    k, on = ", ".join(f"p.{c}" for c in keys), " AND ".join(f"p.{c} = e.{c}" for c in keys)
    return f"SELECT {k}, round(p.value, 6) AS value, round(e.value_se, 6) AS se, CASE WHEN e.size >= 30 THEN true END AS ci_fits{more} FROM {point} p JOIN {errors} e ON {on}"


CHECKED = ("value", "se", "ci_fits")  # the ends themselves are random draws


def fits(name: str):
    return Z.ends_fit(F.col(name), F.col(f"{name}_low"), F.col(f"{name}_high"), F.col(f"{name}_se"))


def agreement_statistics(columns):
    def statistics(cells, by, weight):
        return A.confusion(cells, "label_1", "label_2", by, weight=weight).select(*by, *[c.alias(n) for n, c in columns.items()])
    return statistics


@add("j07_bootstrap_intervals", sql(interval_sql("point", "errors", ["measure"]), PAIRS, *left_out_sql("pairs", ["label_1", "label_2"]),
                                    ("c", conf_sql("pairs", "label_1", "label_2")), ("point", long_sql("c", [], SET)),
                                    ("rc", conf_sql("left_out", "label_1", "label_2", "replicate")), ("replicates", long_sql("rc", ["replicate"], SET)),
                                    ("errors", error_sql("replicates", ["measure"]))))
def j07(spark, sf_dir):
    columns = COUNTS.agreement_set()
    wide = Z.with_intervals(pairs(spark, sf_dir), [], ["label_1", "label_2"], agreement_statistics(columns))
    return Z.as_rows(wide, [], list(columns)).select("measure", *CHECKED)


@add("j08_paired_difference", sql(interval_sql("point", "errors", ["measure"], ", abs(p.value) > 1.959964 * e.value_se AS excludes_zero"),
    *left_out_sql("rate", ["final", "model_a", "model_b"]),
    ("pa", long_sql(f"({conf_sql('rate', 'final', 'model_a')})", [], SCORES)), ("pb", long_sql(f"({conf_sql('rate', 'final', 'model_b')})", [], SCORES)),
    ("point", "SELECT pa.measure, pb.value - pa.value AS value FROM pa JOIN pb ON pa.measure = pb.measure"),
    ("qa", long_sql(f"({conf_sql('left_out', 'final', 'model_a', 'replicate')})", ["replicate"], SCORES)),
    ("qb", long_sql(f"({conf_sql('left_out', 'final', 'model_b', 'replicate')})", ["replicate"], SCORES)),
    ("replicates", "SELECT qa.measure, qa.replicate, qb.value - qa.value AS value FROM qa JOIN qb ON qa.measure = qb.measure AND qa.replicate = qb.replicate"),
    ("errors", error_sql("replicates", ["measure"]))))
def j08(spark, sf_dir):
    """The same resamples for both models: cells of (truth, first, second) are drawn together."""
    first, second = A.Counts(prefix="a_"), A.Counts(prefix="b_")

    def statistics(cells, by, weight):
        wide = cells.groupBy(*by).agg(*first.aggregates("final", "model_a", weight), *second.aggregates("final", "model_b", weight))
        a, b = first.scores(), second.scores()
        return wide.select(*by, *[(b[n] - a[n]).alias(n) for n in a])

    names = list(first.scores())
    wide = Z.with_intervals(X.rate(spark, sf_dir), [], ["final", "model_a", "model_b"], statistics)
    excludes = (F.col("ci_low") > 0) | (F.col("ci_high") < 0)
    return Z.as_rows(wide, [], names).select("measure", *CHECKED, excludes.alias("excludes_zero"))


_Q = "(SELECT min(n_chars) AS q0, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS q2, quantile_cont(n_chars, 0.75) AS q3, max(n_chars) AS q4 FROM pairs)"
_BIN = ("CASE WHEN n_chars <= q1 THEN CAST(q0 AS BIGINT) || '-' || CAST(floor(q1) AS BIGINT) || ' characters' WHEN n_chars <= q2 THEN CAST(floor(q1) AS BIGINT) + 1 || '-' || CAST(floor(q2) AS BIGINT) || ' characters' "
        "WHEN n_chars <= q3 THEN CAST(floor(q2) AS BIGINT) + 1 || '-' || CAST(floor(q3) AS BIGINT) || ' characters' ELSE CAST(floor(q3) AS BIGINT) + 1 || '-' || CAST(floor(q4) AS BIGINT) || ' characters' END")
GROUPED = ("grouped", f"""SELECT 'grp' AS "grouping", grp AS gvalue, label_1, label_2 FROM pairs UNION ALL SELECT 'term', term, label_1, label_2 FROM pairs
    UNION ALL SELECT 'length', {_BIN}, label_1, label_2 FROM pairs, {_Q}""")
TWO = {"agreement": ACC, "cohen_kappa": KAPPA}


@add("j09_agreement_in_groups", sql(interval_sql("point", "errors", ['"grouping"', "gvalue", "measure"]), PAIRS, GROUPED,
                                    *left_out_sql("grouped", ["label_1", "label_2"], ['"grouping"', "gvalue"]),
                                    ("point", long_sql(f"({conf_sql('grouped', 'label_1', 'label_2', '''grouping, gvalue'''.replace('grouping', chr(34) + 'grouping' + chr(34)))})", ['"grouping"', "gvalue"], TWO)),
                                    ("replicates", long_sql(f"({conf_sql('left_out', 'label_1', 'label_2', chr(34) + 'grouping' + chr(34) + ', gvalue, replicate')})", ['"grouping"', "gvalue", "replicate"], TWO)),
                                    ("errors", error_sql("replicates", ['"grouping"', "gvalue", "measure"], ['"grouping"', "gvalue"]))))
def j09(spark, sf_dir):
    rows = quartile_labels(pairs(spark, sf_dir), "n_chars", "length", "characters")
    long = A.unpivot_groups(rows, ["grp", "term", "length"], ["label_1", "label_2"]).withColumnRenamed("value", "gvalue")
    columns = {n: c for n, c in COUNTS.agreement_set().items() if n in TWO}
    wide = Z.with_intervals(long, ["grouping", "gvalue"], ["label_1", "label_2"], agreement_statistics(columns))
    return Z.as_rows(wide, ["grouping", "gvalue"], list(columns)).select("grouping", "gvalue", "measure", *CHECKED)


# --- evaluation ------------------------------------------------------------------------------------
BY_MODEL = (LONG, ("c", conf_sql("long", "final", "label", "model")))


@add("j10_scores", sql(f"SELECT model, {cols(SCORES)} FROM c", *BY_MODEL))
def j10(spark, sf_dir):
    wide = A.confusion(models_long(spark, sf_dir, []), "final", "label", ["model"])
    return A.measures(wide, ["model"], COUNTS.scores())


@add("j11_majority_baseline", sql("SELECT label, round(n / total, 6) AS accuracy, round(2 * n / (total + n) / 3, 6) AS macro_f1 FROM (SELECT final AS label, count(*) AS n, sum(count(*)) OVER () AS total FROM rate GROUP BY 1) ORDER BY n DESC, label LIMIT 1"))
def j11(spark, sf_dir):
    return A.majority_class(X.rate(spark, sf_dir), "final")


@add("j12_per_class", sql(" UNION ALL ".join(f"SELECT model, '{c}' AS label, round(coalesce(t{i}p{i} / nullif({_C[i]}, 0), 0), 6) AS precision, round(coalesce(t{i}p{i} / nullif({_R[i]}, 0), 0), 6) AS recall, round({F1[i]}, 6) AS f1, CAST({_R[i]} AS BIGINT) AS support FROM c" for i, c in enumerate(CLASSES)), *BY_MODEL))
def j12(spark, sf_dir):
    wide = A.confusion(models_long(spark, sf_dir, []), "final", "label", ["model"])
    return A.per_class(wide, ["model"])


RATERS = ["label_1", "label_2", "model_a", "model_b"]
RATER_PAIRS = ("rp", " UNION ALL ".join(f"SELECT '{a}' AS rater_a, '{b}' AS rater_b, {a} AS label_a, {b} AS label_b FROM rate" for i, a in enumerate(RATERS) for b in RATERS[:i]))


@add("j13_rater_agreement", sql(f"SELECT rater_a, rater_b, round({KAPPA}, 6) AS kappa, round(100 * {ACC}, 6) AS same_pct FROM c", RATER_PAIRS, ("c", conf_sql("rp", "label_a", "label_b", "rater_a, rater_b"))))
def j13(spark, sf_dir):
    long = A.rater_pairs(X.rate(spark, sf_dir), RATERS)
    wide = A.confusion(long, "label_a", "label_b", ["rater_a", "rater_b"])
    return A.measures(wide, ["rater_a", "rater_b"], {"kappa": COUNTS.kappa(), "same_pct": 100 * COUNTS.accuracy()})


@add("j14_accuracy_by_group", sql(" UNION ALL ".join(f"SELECT '{g}' AS \"grouping\", {g} AS value, model, count(*) AS n, round(100 * avg(CASE WHEN label = final THEN 1.0 ELSE 0 END), 6) AS accuracy_pct FROM long GROUP BY 2, 3" for g in ("grp", "term")), LONG))
def j14(spark, sf_dir):
    long = A.unpivot_groups(models_long(spark, sf_dir, ["grp", "term"]), ["grp", "term"], ["final", "model", "label"])
    return long.groupBy("grouping", "value", "model").agg(
        F.count(F.lit(1)).alias("n"), F.round(100 * F.avg((F.col("label") == F.col("final")).cast("double")), 6).alias("accuracy_pct"))


@add("j15_metrics_by_group", sql(f"SELECT grp, term, model, CAST({_N} AS BIGINT) AS n, round({ACC}, 6) AS accuracy, round({MACRO}, 6) AS macro_f1 FROM c", LONG, ("c", conf_sql("long", "final", "label", "grp, term, model"))))
def j15(spark, sf_dir):
    wide = A.confusion(models_long(spark, sf_dir, ["grp", "term"]), "final", "label", ["grp", "term", "model"])
    return wide.select("grp", "term", "model", COUNTS.total().cast("bigint").alias("n"),
                       *A.rounded({"accuracy": COUNTS.accuracy(), "macro_f1": COUNTS.macro_f1()}))


@add("j16_label_transitions", sql("SELECT model_a AS before, model_b AS after, count(*) AS n, count(*) FILTER (WHERE model_a <> model_b AND model_b = final) AS became_right, count(*) FILTER (WHERE model_a <> model_b AND model_a = final) AS became_wrong, count(*) FILTER (WHERE model_a <> model_b AND model_a <> final AND model_b <> final) AS still_wrong FROM rate GROUP BY 1, 2"))
def j16(spark, sf_dir):
    return A.transitions(X.rate(spark, sf_dir), "model_a", "model_b", "final")


@add("j17_accuracy_before_after", sql("SELECT CASE WHEN term = 'T1' THEN 'answers the post' ELSE 'answers another comment' END AS position, count(*) AS comments, round(100 * avg(CASE WHEN model_a = final THEN 1.0 ELSE 0 END), 6) AS before_pct, round(100 * avg(CASE WHEN model_b = final THEN 1.0 ELSE 0 END), 6) AS after_pct FROM rate GROUP BY 1"))
def j17(spark, sf_dir):
    position = F.when(F.col("term") == "T1", "answers the post").otherwise("answers another comment")
    return X.rate(spark, sf_dir).groupBy(position.alias("position")).agg(
        F.count(F.lit(1)).alias("comments"),
        *[F.round(100 * F.avg((F.col(m) == F.col("final")).cast("double")), 6).alias(n) for m, n in (("model_a", "before_pct"), ("model_b", "after_pct"))])


@add("j18_both_right", sql("SELECT model_a = final AS a_right, model_b = final AS b_right, count(*) AS n FROM rate GROUP BY 1, 2"))
def j18(spark, sf_dir):
    return X.rate(spark, sf_dir).groupBy((F.col("model_a") == F.col("final")).alias("a_right"), (F.col("model_b") == F.col("final")).alias("b_right")).agg(F.count(F.lit(1)).alias("n"))


@add("j19_error_kinds", sql("SELECT final, model_a, count(*) AS n FROM rate WHERE final <> model_a GROUP BY 1, 2 ORDER BY n DESC, 1, 2"))
def j19(spark, sf_dir):
    return A.error_kinds(X.rate(spark, sf_dir), "final", "model_a")


@add("j20_all_agree_share", sql("SELECT grp, round(avg(CASE WHEN final = model_a AND final = model_b THEN 1.0 ELSE 0 END), 6) AS all_agree, round(avg(CASE WHEN final <> model_a AND final <> model_b AND model_a <> model_b THEN 1.0 ELSE 0 END), 6) AS all_differ FROM rate GROUP BY 1"))
def j20(spark, sf_dir):
    kinds = F.size(F.array_distinct(F.array("final", "model_a", "model_b")))
    return X.rate(spark, sf_dir).groupBy("grp").agg(F.round(F.avg((kinds == 1).cast("double")), 6).alias("all_agree"), F.round(F.avg((kinds == 3).cast("double")), 6).alias("all_differ"))


DIFFER = (PAIRS, ("differ", "SELECT *, CASE WHEN label_1 < label_2 THEN label_1 || ' / ' || label_2 ELSE label_2 || ' / ' || label_1 END AS kind, substr(sha256('42:' || id), 1, 16) AS rank FROM pairs WHERE label_1 <> label_2"),
          ("reviewed", "SELECT *, (row_number() OVER (ORDER BY kind, rank) - 1) % 2 + 1 AS reviewer FROM differ"))


def disagreements(spark, sf_dir):
    rows = pairs(spark, sf_dir).filter("label_1 <> label_2").withColumns({
        "kind": A.disagreement_kind("label_1", "label_2"), "rank": R.hash_rank("id")})
    return R.alternate(rows, ["kind"], "rank", 2, "reviewer", ["id"])


@add("j21_reviewers", sql("SELECT id, kind, reviewer FROM reviewed", *DIFFER))
def j21(spark, sf_dir):
    return disagreements(spark, sf_dir).select("id", "kind", "reviewer")


@add("j22_opposite_pairs", sql("SELECT id, grp, term, label_1, label_2 FROM pairs WHERE (label_1 = 'against' AND label_2 = 'pro') OR (label_1 = 'pro' AND label_2 = 'against')", PAIRS))
def j22(spark, sf_dir):
    code = lambda c: G.lookup(c, {name: i for i, name in enumerate(CLASSES)})
    return pairs(spark, sf_dir).filter(F.abs(code("label_1") - code("label_2")) == len(CLASSES) - 1).select("id", "grp", "term", "label_1", "label_2")


@add("j23_final_labels", sql("""SELECT p.id, CASE WHEN label_1 = label_2 THEN label_1 ELSE decision END AS label, CASE WHEN label_1 = label_2 THEN 'both annotators' WHEN decision IS NOT NULL THEN 'review' ELSE 'pending' END AS source,
      CASE WHEN decision = 'skip' OR label_1 = label_2 OR decision IS NULL THEN NULL WHEN decision = label_1 THEN 'annotator 1' WHEN decision = label_2 THEN 'annotator 2' ELSE 'neither' END AS sided
    FROM pairs p LEFT JOIN (SELECT id, CASE WHEN tone < -0.8 THEN 'skip' ELSE model_b END AS decision FROM reviewed WHERE reviewer = 1 OR tone >= 0) d ON p.id = d.id
    WHERE coalesce(decision, '') <> 'skip'""", *DIFFER))
def j23(spark, sf_dir):
    """Reviewer 2 has not finished: some disagreements are pending; skipped ones are out."""
    decisions = disagreements(spark, sf_dir).filter("reviewer = 1 or tone >= 0").select(
        "id", F.when(F.col("tone") < -0.8, "skip").otherwise(F.col("model_b")).alias("decision"))
    out = A.final_labels(pairs(spark, sf_dir), decisions).filter("coalesce(label, '') <> 'skip'")
    sided = F.when((F.col("source") == "review"), G.sided_with("decision", "label_1", "label_2"))
    return out.select("id", "label", "source", sided.alias("sided"))


@add("j24_skip_filter", sql("SELECT term, count(*) AS labelled FROM pairs GROUP BY 1", PAIRS))
def j24(spark, sf_dir):
    return pairs(spark, sf_dir).groupBy("term").agg(F.count(F.lit(1)).alias("labelled"))


# --- change over time ------------------------------------------------------------------------------
SOURCES = ["final", "model_a", "model_b"]


def share_columns(weight, condition=None, tag=""):
    """Aggregates: share against, share pro and net stance of every source."""
    base = weight if condition is None else F.when(condition, weight)
    out = []
    for s in SOURCES:
        a = F.sum(F.when(F.col(s) == "against", base).otherwise(F.lit(0)))
        p = F.sum(F.when(F.col(s) == "pro", base).otherwise(F.lit(0)))
        n = F.sum(base)
        out += [F.try_divide(a, n).alias(f"{tag}{s}_against"), F.try_divide(p, n).alias(f"{tag}{s}_pro"),
                F.try_divide(p - a, n).alias(f"{tag}{s}_net")]
    return out


MEASURES = ["against", "pro", "net"]


def share_sql(source: str, by: list[str]) -> str:
    keys = "".join(f"{c}, " for c in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    parts = []
    for s in SOURCES:
        e = {"against": f"avg(CASE WHEN {s} = 'against' THEN 1.0 ELSE 0 END)", "pro": f"avg(CASE WHEN {s} = 'pro' THEN 1.0 ELSE 0 END)"}
        e["net"] = f"{e['pro']} - {e['against']}"
        f = {"against": "avg(CASE WHEN final = 'against' THEN 1.0 ELSE 0 END)", "pro": "avg(CASE WHEN final = 'pro' THEN 1.0 ELSE 0 END)"}
        f["net"] = f"{f['pro']} - {f['against']}"
        parts += [f"SELECT {keys}'{s}' AS source, '{m}' AS measure, count(*) AS n, {e[m]} AS value, ({e[m]}) - ({f[m]}) AS gap FROM {source} {group}" for m in MEASURES]
    return " UNION ALL ".join(parts)


@add("j25_shares_and_gaps", sql("""SELECT p.grp, p.source, p.measure, p.n, round(p.value, 6) AS value, round(e.value_se, 6) AS se, CASE WHEN e.size >= 30 THEN true END AS fits,
      round(p.gap, 6) AS gap, round(e.gap_se, 6) AS gap_se, CASE WHEN e.size >= 30 THEN true END AS gap_fits
    FROM point p JOIN errors e ON p.grp = e.grp AND p.source = e.source AND p.measure = e.measure""",
    *left_out_sql("rate", SOURCES, ["grp"]), ("point", share_sql("rate", ["grp"])), ("replicates", share_sql("left_out", ["grp", "replicate"])),
    ("errors", error_sql("replicates", ["grp", "source", "measure"], ["grp"], ("value", "gap")))))
def j25(spark, sf_dir):
    def statistics(cells, by, weight):
        wide = cells.groupBy(*by).agg(F.sum(weight).alias("rows"), *share_columns(weight))
        return wide.select(*by, "rows", *[F.col(f"{s}_{m}") for s in SOURCES for m in MEASURES],
                           *[(F.col(f"{s}_{m}") - F.col(f"final_{m}")).alias(f"{s}_{m}_gap") for s in SOURCES for m in MEASURES])

    wide = Z.with_intervals(X.rate(spark, sf_dir), ["grp"], SOURCES, statistics)
    r = lambda c: F.round(c, 6)
    cells = F.array(*[F.struct(
        F.lit(s).alias("source"), F.lit(m).alias("measure"), F.col("rows").cast("bigint").alias("n"),
        r(f"{s}_{m}").alias("value"), r(f"{s}_{m}_se").alias("se"), fits(f"{s}_{m}").alias("fits"),
        r(f"{s}_{m}_gap").alias("gap"), r(f"{s}_{m}_gap_se").alias("gap_se"), fits(f"{s}_{m}_gap").alias("gap_fits"))
        for s in SOURCES for m in MEASURES])
    return wide.select("grp", F.inline(cells))


def change_sql(source: str, by: list[str]) -> str:
    keys = "".join(f"{c}, " for c in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""

    def change(s, m):
        def share(c, t):
            return f"avg(CASE WHEN {s} = '{c}' THEN 1.0 ELSE 0 END) FILTER (WHERE term = '{t}')"
        if m == "net":
            return f"(({share('pro', 'T2')} - {share('against', 'T2')}) - ({share('pro', 'T1')} - {share('against', 'T1')}))"
        return f"({share(m, 'T2')} - {share(m, 'T1')})"
    return " UNION ALL ".join(f"SELECT {keys}'{s}' AS source, '{m}' AS measure, {change(s, m)} AS value, {change(s, m)} - {change('final', m)} AS extra FROM {source} {group}"
                              for s in SOURCES for m in MEASURES)


@add("j26_change_between_terms", sql("""SELECT p.source, p.measure, round(p.value, 6) AS change, round(e.value_se, 6) AS se, CASE WHEN e.size >= 30 THEN true END AS fits,
      round(p.extra, 6) AS minus_reference, round(e.extra_se, 6) AS minus_se, CASE WHEN e.size >= 30 THEN true END AS minus_fits
    FROM point p JOIN errors e ON p.source = e.source AND p.measure = e.measure""",
    *left_out_sql("rate", [*SOURCES, "term"]), ("point", change_sql("rate", [])), ("replicates", change_sql("left_out", ["replicate"])),
    ("errors", error_sql("replicates", ["source", "measure"], None, ("value", "extra")))))
def j26(spark, sf_dir):
    def statistics(cells, by, weight):
        wide = cells.groupBy(*by).agg(*share_columns(weight, F.col("term") == "T1", "t1_"), *share_columns(weight, F.col("term") == "T2", "t2_"))
        change = {f"{s}_{m}": F.col(f"t2_{s}_{m}") - F.col(f"t1_{s}_{m}") for s in SOURCES for m in MEASURES}
        return wide.select(*by, *[c.alias(n) for n, c in change.items()],
                           *[(change[f"{s}_{m}"] - change[f"final_{m}"]).alias(f"{s}_{m}_x") for s in SOURCES for m in MEASURES])

    wide = Z.with_intervals(X.rate(spark, sf_dir), [], [*SOURCES, "term"], statistics)
    r = lambda c: F.round(c, 6)
    cells = F.array(*[F.struct(
        F.lit(s).alias("source"), F.lit(m).alias("measure"), r(f"{s}_{m}").alias("change"), r(f"{s}_{m}_se").alias("se"), fits(f"{s}_{m}").alias("fits"),
        r(f"{s}_{m}_x").alias("minus_reference"), r(f"{s}_{m}_x_se").alias("minus_se"), fits(f"{s}_{m}_x").alias("minus_fits"))
        for s in SOURCES for m in MEASURES])
    return wide.select(F.inline(cells))


# --- weighted checks, settings, weights ------------------------------------------------------------
@add("j27_weighted_bias", sql(f"SELECT grp, n, round({ACC}, 6) AS accuracy, round({MACRO}, 6) AS macro_f1, " + ", ".join(f"round(100 * ({_C[i]} - {_R[i]}) / {_N}, 6) AS {c}_bias_pp" for i, c in enumerate(CLASSES)) + " FROM c JOIN (SELECT grp, count(*) AS n FROM weighted GROUP BY 1) USING (grp)", WEIGHTED, ("c", conf_sql("weighted", "final", "model_a", "grp", "w"))))
def j27(spark, sf_dir):
    inside = weighted(spark, sf_dir)
    wide = inside.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *COUNTS.aggregates("final", "model_a", F.col("w")))
    return wide.select("grp", "n", *A.rounded({"accuracy": COUNTS.accuracy(), "macro_f1": COUNTS.macro_f1(),
                                              **{f"{c}_bias_pp": COUNTS.share_gap(i) for i, c in enumerate(CLASSES)}}))


@add("j28_external_check", sql("SELECT grp AS stance, count(*) AS n, round(100 * sum(CASE WHEN model_a = 'pro' THEN w ELSE 0 END) / sum(w), 6) AS first_pro_pct, round(100 * sum(CASE WHEN model_b = 'pro' THEN w ELSE 0 END) / sum(w), 6) AS second_pro_pct FROM weighted WHERE term = 'T2' GROUP BY 1", WEIGHTED))
def j28(spark, sf_dir):
    from forumlens.operators.sampling import weighted_percent
    return weighted(spark, sf_dir).filter("term = 'T2'").groupBy(F.col("grp").alias("stance")).agg(
        F.count(F.lit(1)).alias("n"), *[F.round(weighted_percent(F.col(m) == "pro", F.col("w")), 6).alias(n)
                                        for m, n in (("model_a", "first_pro_pct"), ("model_b", "second_pro_pct"))])


SUBSETS = (LONG, ("sub2", "SELECT *, 'whole' AS subset FROM long UNION ALL SELECT *, 'long' FROM long WHERE n_chars > 512"), ("c", conf_sql("sub2", "final", "label", "model, subset")))


@add("j29_settings_table", sql(f"SELECT c.model AS setting, c.subset, CAST({_N} AS BIGINT) AS n, {cols(SCORES)}, changed_pct FROM c JOIN (SELECT model, subset, round(100 * avg(CASE WHEN label <> model_a THEN 1.0 ELSE 0 END), 6) AS changed_pct FROM sub2 GROUP BY 1, 2) d ON c.model = d.model AND c.subset = d.subset", *SUBSETS))
def j29(spark, sf_dir):
    """Two settings of one model, on the long texts and on all; the base setting is on the same row."""
    long = A.unpivot_raters(X.rate(spark, sf_dir), ["final", "n_chars", F.col("model_a").alias("base")], MODELS, "setting")
    subsets = F.when(F.col("n_chars") > 512, F.array(F.lit("whole"), F.lit("long"))).otherwise(F.array(F.lit("whole")))
    rows = long.withColumn("subset", F.explode(subsets))
    wide = rows.groupBy("setting", "subset").agg(
        *COUNTS.aggregates("final", "label"), F.avg((F.col("label") != F.col("base")).cast("double")).alias("changed"))
    return wide.select("setting", "subset", COUNTS.total().cast("bigint").alias("n"), *A.rounded(COUNTS.scores()),
                       F.round(100 * F.col("changed"), 6).alias("changed_pct"))


@add("j30_class_weights", sql("SELECT final AS label, count(*) AS n, round(sum(count(*)) OVER () / (3.0 * count(*)), 6) AS balanced_weight, round(sqrt(sum(count(*)) OVER () / (3.0 * count(*))), 6) AS mild_weight FROM folded WHERE split = 'train' GROUP BY 1", *FOLDS))
def j30(spark, sf_dir):
    return A.class_weights(folded(spark, sf_dir).filter("split = 'train'"), "final")


@add("g30_scores_pivot", sql("SELECT \"grouping\", value, n, " + ", ".join(f"max(CASE WHEN model = '{m}' THEN {e} END) AS {m}_{n}" for m in MODELS for n, e in (("accuracy", "accuracy"), ("macro_f1", "macro_f1"))) + " FROM s GROUP BY 1, 2, 3", LONG,
    ("g", " UNION ALL ".join(f"SELECT '{g}' AS \"grouping\", {g} AS value, model, final, label FROM long" for g in ("grp", "term"))),
    ("c", conf_sql("g", "final", "label", '"grouping", value, model')), ("s", f'SELECT "grouping", value, model, CAST({_N} AS BIGINT) AS n, round({ACC}, 6) AS accuracy, round({MACRO}, 6) AS macro_f1 FROM c')))
def g30(spark, sf_dir):
    long = A.unpivot_groups(models_long(spark, sf_dir, ["grp", "term"]), ["grp", "term"], ["final", "model", "label"])
    wide = A.confusion(long, "final", "label", ["grouping", "value", "model"])
    scored = wide.select("grouping", "value", "model", COUNTS.total().cast("bigint").alias("n"),
                         *A.rounded({"accuracy": COUNTS.accuracy(), "macro_f1": COUNTS.macro_f1()}))
    pivot = scored.groupBy("grouping", "value", "n").pivot("model", MODELS).agg(F.max("accuracy").alias("accuracy"), F.max("macro_f1").alias("macro_f1"))
    return pivot
