"""Batch scoring of texts with any classifier, and figures from answer logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens import fixed_values as V
from forumlens.functions.flags import argmax_label
from forumlens.operators.staging import computed_once

Scorer = Callable[[list[str]], "object"]


PADDED = 64_000          # characters of a model's batch, counted with its padding


def packs(lengths: np.ndarray, padded: int = PADDED) -> list[tuple[int, int]]:
    """Cut lengths, which rise, into runs whose number times the longest stays within a budget; one text always fits."""
    found, start = [], 0
    for i, length in enumerate(lengths.tolist()):
        if i > start and (i + 1 - start) * length > padded:
            found.append((start, i))
            start = i
    return [*found, (start, len(lengths))] if len(lengths) else []


def probabilities_udf(make_scorer: Callable[[], Scorer], classes: list[str] = V.CLASSES, padded: int = PADDED):
    """A column function from text to class probabilities.

    The scorer is made once per Python worker. The texts of an Arrow batch are scored from short to long, packed into
    batches of texts of about one length, whose size is a number of characters with the padding. A null text is not scored.
    """
    names = [f"p_{c}" for c in classes]

    @F.pandas_udf(", ".join(f"{n} float" for n in names))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for texts in batches:
            out = pd.DataFrame(float("nan"), index=texts.index, columns=names, dtype="float32")
            known = texts.dropna()
            if len(known):
                known = known.iloc[known.str.len().argsort(kind="stable")]
                found = [pd.DataFrame(scorer(known.iloc[a:b].tolist()), columns=names) for a, b in packs(known.str.len().to_numpy(), padded)]
                out.loc[known.index, names] = pd.concat(found).set_axis(known.index).astype("float32")
            yield out
    return score


def padding(df: DataFrame, text: Column | str, padded: int = PADDED, plain: int | None = None) -> DataFrame:
    """One row: texts, their characters, and characters with padding, if texts are sorted by length and packed, or, with
    ``plain``, taken as they come in batches of that many."""
    t = F.col(text) if isinstance(text, str) else text
    lengths = df.select(F.length(t).alias("n")).filter(F.col("n").isNotNull())

    def run(batches):
        for batch in batches:
            n = batch.column(0).to_numpy()
            cuts = packs(np.sort(n), padded) if plain is None else [(i, min(i + plain, len(n))) for i in range(0, len(n), plain)]
            runs = [np.sort(n)[a:b] if plain is None else n[a:b] for a, b in cuts]
            yield pa.RecordBatch.from_arrays([pa.array([len(n)]), pa.array([int(n.sum())]), pa.array([sum(len(r) * int(r.max()) for r in runs)])],
                                             ["texts", "characters", "padded"])

    rows = lengths if plain is not None else lengths.sortWithinPartitions("n")
    return (rows.mapInArrow(run, "texts long, characters long, padded long")
            .agg(*[F.sum(c).alias(c) for c in ("texts", "characters", "padded")]))


def with_label(df: DataFrame, text: Column | str, skip: Column, make_scorer: Callable[[], Scorer],
               classes: list[str] = V.CLASSES, prefix: str = "student") -> DataFrame:
    """Label and probabilities next to every row; skipped rows get nulls.

    Only the texts that are scored travel to Python; all other columns stay where they are, so nothing has
    to be joined back. The rows of a task are sorted by the length of the text, so that texts that are scored together
    are about as long.
    """
    t = F.col(text) if isinstance(text, str) else text
    chosen = computed_once(df, "__text", F.when(~skip, t)).sortWithinPartitions(F.length("__text"))
    scored = chosen.withColumn("__p", probabilities_udf(make_scorer, classes)("__text"))
    named = scored.withColumns({f"{prefix}_p_{c}": F.col(f"__p.p_{c}") for c in classes}).drop("__p", "__text")
    label = argmax_label({c: f"{prefix}_p_{c}" for c in classes})
    return named.withColumn(f"{prefix}_label", label).select(
        *df.columns, f"{prefix}_label", *[f"{prefix}_p_{c}" for c in classes])


def throughput(answers: DataFrame, by: list[str], rows_in_all: int) -> DataFrame:
    """Texts, seconds, speed, share of cached tokens, and days for a whole table at that speed."""
    speed = F.col("texts") / F.col("__seconds")
    out = answers.groupBy(*by).agg(
        F.count(F.lit(1)).alias("texts"), F.sum("seconds").alias("__seconds"),
        F.round(F.sum("cached_tokens") / F.sum("prompt_tokens"), 6).alias("cached_share"))
    return out.select(
        *by, "texts", F.round("__seconds", 6).alias("seconds"), F.round(speed, 6).alias("texts_per_second"),
        "cached_share", F.round(F.lit(rows_in_all) / speed / 86400, 6).alias("days_for_all"))


def smoke_run(df: DataFrame, rows: int, label, order: list[str]) -> DataFrame:
    """Label shares of the first rows of a table by an order: a quick look before the whole is scored."""
    scored = label(df.orderBy(*order).limit(rows))
    return scored.groupBy("student_label").agg(F.count(F.lit(1)).alias("rows"))


def words_of(text: Column) -> Column:
    """Words of at least two characters, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def term_statistics(df: DataFrame, text: str, min_docs: int = 3) -> DataFrame:
    """Documents per term and inverse document frequency.

    A document lists each of its terms once before they are counted, so the count needs no distinct and a
    common term shrinks to one row per task.
    """
    terms = df.select(F.explode(F.array_distinct(words_of(F.col(text)))).alias("term"))
    counted = terms.groupBy("term").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs)
    size = df.agg(F.count(F.lit(1)).alias("n"))
    with_size = counted.withColumn("one", F.lit(1)).join(F.broadcast(size.withColumn("one", F.lit(1))), "one")
    return with_size.select("term", "docs", F.round(F.log((1 + F.col("n")) / (1 + F.col("docs"))) + 1, 6).alias("idf"))
