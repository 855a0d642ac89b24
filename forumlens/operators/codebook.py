"""Searching question texts through an inverted index.

The index has one row per word of a text and its place, stored in the order of the words with their ranges and Bloom
filters (``sources.layout``), next to the list of different words. A phrase is found like a part of the text in which
everything but letters and digits is one blank: its first word may be the end of a word, its last one the beginning, a
single word any part; such words are looked up in the list, and only their rows of the index are read. Places that
follow each other make a phrase. So a search costs what its words cost, not what the texts do.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.functions.text import question_key
from forumlens.session import small_side
from forumlens.sources.layout import rows_of_keys, write_by_key

WORD = "[a-z0-9]+"


def write_index(book: DataFrame, text: str, ids: list[str], path: str) -> str:
    """Index a column of texts; ``ids`` name a text."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    write_by_key(book.select(*ids, F.posexplode(words).alias("__place", "word")), f"{path}/places", "word")
    spark = book.sparkSession
    (spark.read.parquet(f"{path}/places").groupBy("word").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/words"))
    return path


def _fits(word: str, first: bool, last: bool) -> Column:
    column = F.col("word")
    if first and last:
        return column.contains(word)
    return column.endswith(word) if first else column.startswith(word) if last else column == word


def search(spark: SparkSession, path: str, ids: list[str], phrases: list[str]) -> DataFrame:
    """The ids of all texts that hold every phrase, each once."""
    split = [re.findall(WORD, phrase.lower()) for phrase in phrases]
    if not split or not all(split):
        raise ValueError("a phrase needs a letter or digit")
    known = spark.read.parquet(f"{path}/words")
    wanted = reduce(DataFrame.unionByName, [
        known.filter(_fits(word, i == 0, i == len(words) - 1)).select("word", F.lit(p).alias("__phrase"), F.lit(i).alias("__offset"))
        for p, words in enumerate(split) for i, word in enumerate(words)])
    wanted = small_side(wanted)
    places = rows_of_keys(spark, f"{path}/places", [*ids, "__place", "word"], wanted, "word").join(wanted, "word")
    lengths = F.array(*[F.lit(len(words)) for words in split])
    starts = places.groupBy(*ids, "__phrase", (F.col("__place") - F.col("__offset")).alias("__start")).agg(F.count(F.lit(1)).alias("__n"))
    whole = starts.filter(F.col("__n") == F.get(lengths, F.col("__phrase")))
    return whole.groupBy(*ids).agg(F.count_distinct("__phrase").alias("__n")).filter(F.col("__n") == len(split)).select(*ids)


def keys_across_waves(book: DataFrame, words: int = 12, question: str = "question", wave: str = "wave", order: str = "ordinal") -> DataFrame:
    """Per comparable question text: in how many waves it is, how often, and the variable that asked it first."""
    keyed = book.withColumn("key", question_key(question, words))
    return keyed.groupBy("key").agg(F.count_distinct(wave).alias("n_waves"), F.count(F.lit(1)).alias("n"),
                                    F.min(F.struct(order, "variable"))["variable"].alias("first_variable"))


def follow_up(spark: SparkSession, answers: str, ids: list[str], phrases: list[str], main: DataFrame) -> DataFrame:
    """Per wave the first variable behind the main question whose answers hold all the phrases. ``answers``: an index of answer
    texts by (wave, variable, ordinal); ``main``: (wave, main_ordinal)."""
    found = search(spark, answers, ids, phrases).join(small_side(main), "wave").filter("ordinal > main_ordinal")
    return found.groupBy("wave").agg(F.min(F.struct("ordinal", "variable"))["variable"].alias("follow_up"))
