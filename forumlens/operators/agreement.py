"""Agreement, evaluation and change statistics from tables of counts.

One aggregation turns rows into one line of k x k counters per group. Every measure is then an expression
over those counters, for the data as for each bootstrap replicate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens import fixed_values as V


def _total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


class Counts:
    """Measures over the cells ``t{i}p{j}``: class i of the first rater, class j of the second."""

    def __init__(self, classes: list[str] = V.CLASSES, prefix: str = ""):
        self.classes, self.k, self.prefix = list(classes), len(classes), prefix

    def name(self, i: int, j: int) -> str:
        return f"{self.prefix}t{i}p{j}"

    def cell(self, i: int, j: int) -> Column:
        return F.col(self.name(i, j)).cast("double")

    def aggregates(self, truth: str, predicted: str, weight: Column | None = None) -> list[Column]:
        """The counters, as aggregates over rows or over weighted cells."""
        out = []
        for i, a in enumerate(self.classes):
            for j, b in enumerate(self.classes):
                hit = (F.col(truth) == a) & (F.col(predicted) == b)
                value = F.count_if(hit) if weight is None else F.coalesce(F.sum(F.when(hit, weight)), F.lit(0))
                out.append(value.alias(self.name(i, j)))
        return out

    def row(self, i):
        return _total(self.cell(i, j) for j in range(self.k))

    def column(self, j):
        return _total(self.cell(i, j) for i in range(self.k))

    def total(self):
        return _total(self.cell(i, j) for i in range(self.k) for j in range(self.k))

    def hits(self):
        return _total(self.cell(i, i) for i in range(self.k))

    def accuracy(self):
        return F.try_divide(self.hits(), self.total())

    def _kappa(self, distance) -> Column:
        cells = [(i, j) for i in range(self.k) for j in range(self.k) if i != j]
        seen = _total(self.cell(i, j) * F.lit(float(distance(i, j))) for i, j in cells)
        by_chance = _total(self.row(i) * self.column(j) * F.lit(float(distance(i, j))) for i, j in cells)
        return F.lit(1.0) - F.try_divide(seen * self.total(), by_chance)

    def kappa(self):
        """Agreement above chance; null when chance agreement is complete."""
        return self._kappa(lambda i, j: 1.0)

    def weighted_kappa(self):
        """Linear weights: the distance between two classes counts."""
        return self._kappa(lambda i, j: abs(i - j) / (self.k - 1))

    def opposite_share(self):
        last = self.k - 1
        return F.try_divide(self.cell(0, last) + self.cell(last, 0), self.total())

    def same_direction(self):
        last = self.k - 1
        same = self.cell(0, 0) + self.cell(last, last)
        return F.try_divide(same, same + self.cell(0, last) + self.cell(last, 0))

    def specific(self, i: int) -> Column:
        return F.try_divide(2 * self.cell(i, i), self.row(i) + self.column(i))

    def precision(self, i: int) -> Column:
        return F.coalesce(F.try_divide(self.cell(i, i), self.column(i)), F.lit(0.0))

    def recall(self, i: int) -> Column:
        return F.coalesce(F.try_divide(self.cell(i, i), self.row(i)), F.lit(0.0))

    def f1(self, i: int) -> Column:
        return F.coalesce(self.specific(i), F.lit(0.0))

    def macro_f1(self):
        return _total(self.f1(i) for i in range(self.k)) / self.k

    def share_gap(self, i: int) -> Column:
        """How much more often the second rater uses class i, in points."""
        return 100 * F.try_divide(self.column(i) - self.row(i), self.total())

    def marginal_chi2(self) -> Column:
        """Stuart-Maxwell statistic of equal label use, three classes."""
        d1, d2 = self.row(0) - self.column(0), self.row(1) - self.column(1)
        a = self.row(0) + self.column(0) - 2 * self.cell(0, 0)
        e = self.row(1) + self.column(1) - 2 * self.cell(1, 1)
        b = -(self.cell(0, 1) + self.cell(1, 0))
        return F.try_divide(e * d1 * d1 - 2 * b * d1 * d2 + a * d2 * d2, a * e - b * b)

    def agreement_set(self) -> dict[str, Column]:
        return {"comments": self.total(), "agreement": self.accuracy(), "cohen_kappa": self.kappa(),
                "weighted_kappa": self.weighted_kappa(), "against_vs_pro": self.opposite_share(),
                "same_direction": self.same_direction()}

    def scores(self) -> dict[str, Column]:
        return {"accuracy": self.accuracy(), "macro_f1": self.macro_f1(), "kappa": self.kappa()}


def confusion(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None,
              classes: list[str] = V.CLASSES, weight: Column | None = None) -> DataFrame:
    """One line of counters per group. Rows with a label outside the classes are not counted."""
    counts = Counts(classes)
    inside = F.col(truth).isin(counts.classes) & F.col(predicted).isin(counts.classes)
    return df.filter(inside).groupBy(*(by or [])).agg(*counts.aggregates(truth, predicted, weight))


def confusion_long(wide: DataFrame, by: list[str] | None = None, classes: list[str] = V.CLASSES) -> DataFrame:
    """The counters as rows; cells that never occur are there with zero."""
    counts = Counts(classes)
    cells = F.array(*[F.struct(F.lit(a).alias("truth"), F.lit(b).alias("predicted"), F.col(counts.name(i, j)).alias("n"))
                      for i, a in enumerate(counts.classes) for j, b in enumerate(counts.classes)])
    return wide.select(*(by or []), F.inline(cells))


def rounded(columns: dict[str, Column], digits: int = 6) -> list[Column]:
    return [F.round(c, digits).alias(n) for n, c in columns.items()]


def measures(wide: DataFrame, by: list[str], columns: dict[str, Column], digits: int = 6) -> DataFrame:
    return wide.select(*by, *rounded(columns, digits))


def long_measures(wide: DataFrame, by: list[str], columns: dict[str, Column], name: str = "measure",
                  value: str = "value") -> DataFrame:
    cells = F.array(*[F.struct(F.lit(n).alias(name), c.alias(value)) for n, c in columns.items()])
    return wide.select(*by, F.inline(cells))


def unpivot_raters(df: DataFrame, keep: list[str], raters: list[str], rater: str = "model",
                   label: str = "label") -> DataFrame:
    cells = F.array(*[F.struct(F.lit(r).alias(rater), F.col(r).alias(label)) for r in raters])
    return df.select(*keep, F.inline(cells))


def unpivot_groups(df: DataFrame, groups: list[str], keep: list[str]) -> DataFrame:
    """Each row once per grouping, as (grouping, value)."""
    cells = F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("value")) for g in groups])
    return df.select(*keep, F.inline(cells))


def rater_pairs(df: DataFrame, raters: list[str], keep: list[str] | None = None) -> DataFrame:
    """Both labels of every pair of raters on a row; the pairs come from the row itself, not from a join."""
    pairs = F.array(*[F.struct(F.lit(a).alias("rater_a"), F.lit(b).alias("rater_b"),
                               F.col(a).alias("label_a"), F.col(b).alias("label_b"))
                      for i, a in enumerate(raters) for b in raters[:i]])
    return df.select(*(keep or []), F.inline(pairs))


def per_class(wide: DataFrame, by: list[str], classes: list[str] = V.CLASSES) -> DataFrame:
    counts = Counts(classes)
    cells = F.array(*[F.struct(
        F.lit(c).alias("label"), F.round(counts.precision(i), 6).alias("precision"), F.round(counts.recall(i), 6).alias("recall"),
        F.round(counts.f1(i), 6).alias("f1"), counts.row(i).cast("bigint").alias("support")) for i, c in enumerate(classes)])
    return wide.select(*by, F.inline(cells))


def transitions(df: DataFrame, before: str, after: str, truth: str, classes: list[str] = V.CLASSES) -> DataFrame:
    """Label moves between two answers with what each move did to the truth."""
    b, a, t = F.col(before), F.col(after), F.col(truth)
    return df.groupBy(b.alias("before"), a.alias("after")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((a != b) & (a == t)).alias("became_right"),
        F.count_if((a != b) & (b == t)).alias("became_wrong"),
        F.count_if((a != b) & (a != t) & (b != t)).alias("still_wrong"))


def error_kinds(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return (df.filter(F.col(truth) != F.col(predicted)).groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), truth, predicted))


def disagreement_kind(first: str, second: str) -> Column:
    return F.array_join(F.sort_array(F.array(first, second)), " / ")


def final_labels(pairs: DataFrame, decisions: DataFrame, first: str = "label_1", second: str = "label_2") -> DataFrame:
    """The common label, else the decision of the review; a row without a decision yet is pending."""
    joined = pairs.join(decisions, "id", "left")
    same = F.col(first) == F.col(second)
    return joined.withColumns({
        "label": F.when(same, F.col(first)).otherwise(F.col("decision")),
        "source": F.when(same, "both annotators").when(F.col("decision").isNotNull(), "review").otherwise("pending")})


def majority_class(df: DataFrame, truth: str, classes: list[str] = V.CLASSES) -> DataFrame:
    """The most frequent class and its scores as a constant answer; the first class wins a tie."""
    wide = df.agg(*[F.count_if(F.col(truth) == c).alias(f"__{i}") for i, c in enumerate(classes)])
    names = [F.col(f"__{i}").cast("double") for i in range(len(classes))]
    best, whole = F.greatest(*names), _total(names)
    label = reduce(lambda acc, i: acc.when(names[i] == best, classes[i]), range(len(classes)), F)
    return wide.select(label.alias("label"), F.round(best / whole, 6).alias("accuracy"),
                       F.round(2 * best / (whole + best) / len(classes), 6).alias("macro_f1"))


def class_weights(df: DataFrame, label: str, classes: list[str] = V.CLASSES) -> DataFrame:
    """Weights that let every class contribute alike, and their square roots."""
    wide = df.agg(*[F.count_if(F.col(label) == c).alias(f"__{i}") for i, c in enumerate(classes)])
    whole = _total(F.col(f"__{i}") for i in range(len(classes)))
    cells = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"__{i}").alias("n"),
                               (whole / (len(classes) * F.col(f"__{i}"))).alias("w")) for i, c in enumerate(classes)])
    return wide.select(F.inline(cells)).select(
        "label", "n", F.round("w", 6).alias("balanced_weight"), F.round(F.sqrt("w"), 6).alias("mild_weight"))
