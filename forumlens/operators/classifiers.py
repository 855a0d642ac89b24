"""Linear text classifiers on word or character n-grams."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens import fixed_values as V
from forumlens.functions.text import SPACE, strip
from forumlens.operators import agreement as A
from forumlens.operators import newton, ngrams
from forumlens.operators.scoring import words_of
from forumlens.operators.staging import computed_once


MERGED = 1 << 20         # terms of portions that a task holds before it sums them up; if that leaves many, it passes on all others as they are


def accents() -> tuple[str, str]:
    """Latin letters with a mark and their plain forms, from the decomposition rules."""
    marked, plain = [], []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base != chr(code) and base.isascii() and base.isalpha():
            marked.append(chr(code))
            plain.append(base)
    return "".join(marked), "".join(plain)


def without_accents(column: Column) -> Column:
    marked, plain = accents()
    return F.translate(column, marked, plain)


def word_terms(text: Column) -> Column:
    """Words and pairs of neighbouring words."""
    words = words_of(without_accents(text))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)),
                       lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))


def plain_words(text: Column) -> Column:
    """What stands between blanks, lower case."""
    return F.filter(F.split(strip(F.lower(text)), f"{SPACE}+"), lambda w: w != "")


def character_terms(text: Column, low: int = ngrams.LOW, high: int = ngrams.HIGH) -> Column:
    """Character n-grams inside words padded with one blank; a short word counts once as a whole."""
    padded = F.transform(plain_words(text), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(word: Column) -> Column:
        sizes = F.sequence(F.lit(low), F.least(F.lit(high), F.greatest(F.lit(low), F.length(word))))
        return F.flatten(F.transform(sizes, lambda n: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1))), lambda i: F.substring(word, i, n))))

    return F.flatten(F.transform(padded, grams))


@dataclass
class TextClassifier:
    """Term counts, dampened and weighted by rarity, into one linear separator with squared hinge loss per class."""

    kind: str = "word"
    max_features: int = 120_000
    c: float = 1.0
    tolerance: float = newton.TOLERANCE
    classes: tuple = tuple(V.CLASSES)

    def words(self, text: str) -> Column:
        """The words that the terms are made of."""
        found = words_of(without_accents(F.col(text))) if self.kind == "word" else plain_words(F.col(text))
        return F.coalesce(found, F.array().cast("array<string>"))

    def terms(self, text: str) -> Column:
        found = word_terms(F.col(text)) if self.kind == "word" else character_terms(F.col(text))
        return F.coalesce(found, F.array().cast("array<string>"))

    def vocabulary(self, terms: DataFrame, rows: int, kind: str | None = None) -> list[tuple[str, int, int]]:
        """(term, occurrences, rows with it) of the most frequent terms within the limits of the kind; of terms with equal
        occurrences, those that sort first. At most ``max_features`` of them reach the driver."""
        within = (F.col("rows") >= 3) & (F.col("rows") <= 0.995 * rows) if self.kind == "word" else F.col("rows") >= 5
        kept = occurrences(terms, kind).filter(within).orderBy(F.desc("n"), "term").limit(self.max_features)
        return [(r.term, r.n, r.rows) for r in kept.collect()]

    def fit(self, rows: DataFrame, text: str, label: str) -> "FittedClassifier":
        """``rows`` are read three times, so they should be written before."""
        code = F.array_position(F.array(*[F.lit(c) for c in self.classes]), F.col(label)) - 1
        train = rows.select(self.words(text).alias("terms"), code.cast("int").alias("label"))
        size = rows.count()
        known = self.vocabulary(train.select("terms"), size, self.kind)
        model = FittedClassifier(self, known, size, np.zeros((len(self.classes), len(known) + 1)), np.zeros(len(self.classes)))
        model.weights, model.gradient = newton.fit(model.blocks(train), len(known), len(self.classes), self.c, self.tolerance, model.rarity())
        return model


def occurrences(terms: DataFrame, kind: str | None = None) -> DataFrame:
    """(term, n, rows): how often each term occurs, and in how many rows. ``terms`` has lists of terms, or with a ``kind`` of
    the words that these are made of. A task sums up its portions before the shuffle."""
    names = ["term", "n", "rows"]

    def merged(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("term").aggregate([("n", "sum"), ("rows", "sum")]).rename_columns(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, waiting, worth = [], 0, True
        for batch in batches:
            for _, part in ngrams.portions(batch.column("terms")):
                found, _, ids, n = ngrams.counted(part, kind)
                sums = np.bincount(ids, n, len(found)).astype(np.int64), np.bincount(ids, minlength=len(found)).astype(np.int64)
                kept.append(pa.table([found, *map(pa.array, sums)], names))
                waiting += len(found)
                if waiting > MERGED and worth:
                    kept = [merged(kept)]
                    waiting, worth = len(kept[0]), len(kept[0]) <= MERGED // 2
                if not worth:
                    yield from pa.concat_tables(kept).to_batches(MERGED)
                    kept = []
        if kept:
            yield from merged(kept).to_batches(MERGED)

    found = terms.select("terms").mapInArrow(run, "term string, n bigint, rows bigint")
    return found.groupBy("term").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))


@dataclass
class FittedClassifier:
    spec: TextClassifier
    known: list
    rows: int
    weights: np.ndarray
    gradient: np.ndarray

    def rarity(self) -> np.ndarray:
        """The weight of each term by the rows without it."""
        return np.array([math.log((1 + self.rows) / (1 + n)) + 1 for _, _, n in self.known])

    def vectors(self, rows: DataFrame) -> Callable[[pa.ListArray], Iterator[tuple]]:
        """For the tasks of a plan over ``rows``: counts of terms, portion by portion of some lists of words, each with the
        number of its first row: the rows' factors, which make unit vectors of dampened counts times rarity; the number of
        their terms; and these terms' places and counts."""
        shared = rows.sparkSession.sparkContext.broadcast((pa.array([t for t, _, _ in self.known], pa.string()), self.rarity()))
        kind = self.spec.kind

        def run(words: pa.ListArray) -> Iterator[tuple]:
            names, weight = shared.value
            for start, part in ngrams.portions(words):
                terms, at, ids, n = ngrams.counted(part, kind)
                places = pc.index_in(terms, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.intp)[ids]
                kept = places >= 0
                at, places, n = at[kept], places[kept], n[kept]
                squares = np.bincount(at, (newton.dampened(n) * weight[places]) ** 2, len(part))
                yield start, 1 / np.sqrt(np.where(squares > 0, squares, 1)), np.bincount(at, minlength=len(part)), places, n

        return run

    def blocks(self, train: DataFrame) -> DataFrame:
        """The vectors, but for the rarity of terms, and labels of rows with ``terms``, the words of a text, and ``label``."""
        vectors = self.vectors(train)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                labels = batch.column("label").fill_null(-1).to_numpy(zero_copy_only=False)
                for start, scales, *found in vectors(batch.column("terms")):
                    yield newton.block(labels[start:start + len(scales)], scales, *found)

        return train.select("terms", "label").mapInArrow(run, newton.BLOCK)

    def predict(self, rows: DataFrame, text: str, out: str = "predicted") -> DataFrame:
        weights, vectors = rows.sparkSession.sparkContext.broadcast(self.weights * np.append(self.rarity(), 1.0)), self.vectors(rows)

        @F.arrow_udf("int")
        def best(words: pa.Array) -> pa.Array:
            parts = [newton.Entries(*found, weights.value.shape[1] - 1) for _, *found in vectors(words)]
            found = [np.argmax([part.times(w) for w in weights.value], axis=0) for part in parts]
            return pa.array(np.concatenate([np.zeros(0, np.int32), *found]), pa.int32())

        names = F.array(*[F.lit(c) for c in self.spec.classes])
        return computed_once(rows, out, F.get(names, best(self.spec.words(text)))).select(*rows.columns, out)


def evaluate(predicted: DataFrame, label: str, out: str = "predicted") -> DataFrame:
    counts = A.Counts()
    wide = A.confusion(predicted, label, out)
    return wide.select(counts.total().cast("bigint").alias("n"), *A.rounded(counts.scores()))


def select_and_refit(train: DataFrame, validation: DataFrame, test: DataFrame, text: str, label: str,
                     candidates: dict[str, TextClassifier]) -> DataFrame:
    """Fit every candidate, keep the best macro-F1 on the validation part, refit it on both parts, test once."""
    rows, scores = None, {}
    for name, spec in candidates.items():
        found = evaluate(spec.fit(train, text, label).predict(validation, text), label)
        row = found.select(F.lit(name).alias("model"), F.lit("validation").alias("part"), "*")
        scores[name] = row.first()["macro_f1"]
        rows = row if rows is None else rows.unionByName(row)
    best = max(scores, key=lambda n: (scores[n], n))
    final = candidates[best].fit(train.unionByName(validation), text, label)
    tested = evaluate(final.predict(test, text), label)
    return rows.unionByName(tested.select(F.lit(best).alias("model"), F.lit("test").alias("part"), "*"))
