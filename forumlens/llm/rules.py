"""Quality rules by compression bands.

Every text is compressed with zstandard, as a whole and in fixed chunks. Text whose compressed size is too small a
share of its bytes repeats itself, text whose share is too large is noise (random characters, encoded data). The
limits depend on the length, because short texts compress less. A whole text is judged by the band of its length; a
chunk by the band of the chunk size; a text is also rejected if more than ``bad_chunk_share`` of its chunks are out
of their band, which finds texts that are half clean and half junk.

Results on edges: a null text has no words and fails the word rule; an empty text likewise, with ratio null and no
chunks. Texts shorter than the first band have no band. Repeated rows are judged alike, one by one. Whole texts are
read; a chunk is a slice of the same bytes, so memory stays at a small multiple of the text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField

from forumlens.llm.common import BOOK, append_from_texts, col, table

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


class Band(NamedTuple):
    """Limits of compressed / raw bytes for texts of at least ``from_bytes`` bytes."""
    from_bytes: int
    lowest: float
    highest: float


# Natural prose falls from about 0.7 at 200 bytes to about 0.35 at 100 kB. The lower limits stand at half of that, the
# upper ones between prose and base64 noise (about 0.77 at any length, and more when short).
BANDS = (Band(100, 0.25, 1.10), Band(500, 0.22, 0.90), Band(2_000, 0.20, 0.75), Band(10_000, 0.16, 0.72),
         Band(100_000, 0.12, 0.70))
CHUNK_BYTES = 2_048
BAD_CHUNK_SHARE = 0.5
LEVEL = 3


def band_of(size: int, bands: tuple[Band, ...] = BANDS) -> Band | None:
    found = None
    for band in bands:
        if size >= band.from_bytes:
            found = band
    return found


def out_of_band(size: int, compressed: int, bands: tuple[Band, ...] = BANDS) -> int:
    """-1: too repetitive, 1: incompressible, 0: inside the band or too short for one."""
    band = band_of(size, bands)
    if band is None:
        return 0
    ratio = compressed / size
    return -1 if ratio < band.lowest else 1 if ratio > band.highest else 0


def words_of(raw: bytes) -> list[bytes]:
    return raw.split()  # splits at space and \x09-\x0D only, as bytes know no other blanks


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(numbers) + ids[1:]
    if len(numbers) < 1 << 20:
        triples = pairs[:-1] * len(numbers) + ids[2:]
    else:  # the product would not fit into 64 bits: number the pairs first
        triples = np.unique(pairs[:-1], return_inverse=True)[1] * len(numbers) + ids[2:]
    _, inverse, counts = np.unique(triples, return_inverse=True, return_counts=True)
    repeated = counts[inverse] > 1
    if not repeated.any():
        return 0
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= repeated
    return int(covered.sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


class _Judge:
    def __init__(self, bands, chunk_bytes, bad_chunk_share, level):
        self.bands, self.chunk, self.share = bands, chunk_bytes, bad_chunk_share
        self.compress = zstandard.ZstdCompressor(level=level).compress

    def __call__(self, text: str | None) -> tuple:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        words = words_of(raw)
        n = len(words)
        word_chars = len(text) - sum(text.count(c) for c in BLANKS)
        symbols = sum(text.count(c) for c in SYMBOLS)
        repeats = repeat_words(words)
        failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
        size = len(raw)
        packed = len(self.compress(raw)) if size else 0
        whole = out_of_band(size, packed, self.bands) if size else 0
        chunks = [raw[i:i + self.chunk] for i in range(0, size, self.chunk)]
        sides = [out_of_band(len(c), len(self.compress(c)), self.bands) for c in chunks] if len(chunks) > 1 else [whole] * len(chunks)
        low, high = sides.count(-1), sides.count(1)
        if whole:
            verdict = "repetitive" if whole < 0 else "incompressible"
        elif low + high > self.share * len(sides):
            verdict = "repetitive chunks" if low >= high else "incompressible chunks"
        else:
            verdict = "in band"
        return (n, word_chars, symbols, duplicate_lines(raw), repeats, failed, not failed and verdict == "in band",
                packed / size if size else None, len(chunks), low + high, verdict)


FIELDS = [StructField("n_words", LongType()), StructField("word_chars", LongType()), StructField("n_symbols", LongType()),
          StructField("n_dup_lines", LongType()), StructField("n_repeat_words", LongType()),
          StructField("base_failed", BooleanType()), StructField("kept", BooleanType()), StructField("ratio", DoubleType()),
          StructField("n_chunks", LongType()), StructField("n_bad_chunks", LongType()), StructField("verdict", StringType())]


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None, bands: tuple[Band, ...] = BANDS,
          chunk_bytes: int = CHUNK_BYTES, bad_chunk_share: float = BAD_CHUNK_SHARE, level: int = LEVEL) -> DataFrame:
    """Counts, compression ratio and verdict of every text, next to the kept columns. One pass, no shuffle."""
    def compute(texts):
        one = _Judge(bands, chunk_bytes, bad_chunk_share, level)
        return [list(column) for column in zip(*map(one, texts))] or [[] for _ in FIELDS]

    return append_from_texts(docs, text, FIELDS, compute, keep)


def passing(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows that the rules keep, with their own columns only."""
    marked = judge(docs.select(F.struct("*").alias("__row"), col(text).alias("__content")), "__content", ["__row"], **limits)
    return marked.filter("kept").select("__row.*")


@BOOK.add("op9_compression_bands")
def compression_bands(spark, sf_dir):
    """Counts and compression verdict of every document."""
    return judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
