"""Lengths of texts in subwords, by the longest match from the left over a given vocabulary.

A text is lower-cased and falls into words (runs of letters and digits, or one other sign). A word with its end mark
is cut from the left into the longest pieces of the vocabulary; one that cannot be cut to its end, or is too long, is one
unknown token. The vocabulary stands in one table of prefixes, each with whether it is a piece itself, so a walk over a word
looks at every place of it once per piece; each word of an Arrow batch is cut once per worker.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

END = "</w>"             # of a word, in vocabularies that mark it
MAX_WORD = 100           # characters of a word that is cut
MAX_FILE_BYTES = 64 << 20
SPECIAL = 2              # tokens that are put around a text
KEPT = 500_000           # words whose lengths are kept

WORDS = re.compile(r"[^\W_]+|_|[^\s\w]")


def read_vocabulary(path: str) -> list[str]:
    """Pieces of a vocabulary file: one per line, or the keys of ``model.vocab`` in JSON."""
    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError(f"{path}: too large for a vocabulary")
    with open(path, encoding="utf-8") as file:
        return list(json.load(file)["model"]["vocab"]) if path.endswith(".json") else [line.rstrip("\n") for line in file if line.rstrip("\n")]


def prefixes(pieces: Iterable[str]) -> dict[str, bool]:
    """Every prefix of a piece, and whether it is a piece."""
    found: dict[str, bool] = {}
    for piece in pieces:
        for end in range(1, len(piece)):
            found.setdefault(piece[:end], False)
        if piece:
            found[piece] = True
    return found


def cut(word: str, known: dict[str, bool], end: str = END) -> list[str] | None:
    """The pieces of a word, or None if it cannot be cut to its end."""
    if len(word) > MAX_WORD:
        return None
    whole, start, out = word + end, 0, []
    while start < len(whole):
        longest = None
        for stop in range(start + 1, len(whole) + 1):
            is_piece = known.get(whole[start:stop])
            if is_piece is None:
                break
            if is_piece:
                longest = stop
        if longest is None:
            return None
        out.append(whole[start:longest])
        start = longest
    return out


def token_length(spark: SparkSession, text: Column | str, path: str, end: str = END, special: int = SPECIAL) -> Column:
    """Tokens of a text with the special ones around it; a null text counts as empty. The vocabulary, of a measured size, is broadcast."""
    shared = spark.sparkContext.broadcast(prefixes(read_vocabulary(path)))

    @F.pandas_udf("int")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, seen = shared.value, {}
        for texts in batches:
            out = []
            for content in texts:
                total = special
                for word in WORDS.findall(content.lower()) if content else ():
                    n = seen.get(word)
                    if n is None:
                        pieces = cut(word, known, end)
                        n = seen[word] = 1 if pieces is None else len(pieces)
                    total += n
                out.append(total)
            if len(seen) > KEPT:
                seen.clear()
            yield pd.Series(out, dtype="int32")

    return lengths(text)
