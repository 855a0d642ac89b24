"""Language identification by language-bitmask n-gram filters.

Texts are lower-cased; runs of anything but letters become one blank. N-grams of the sizes ``GRAMS`` (over letters
and word borders) are learned per language: an n-gram belongs to a language if at least ``min_share`` of that
language's sampled documents have it, and if its share there is at least ``min_ratio`` of its largest share in any
language. All n-grams go into one bit-sliced Bloom filter: a table of bit masks, one bit per language (a 64-bit word for every 64
languages), in which an n-gram sets its languages' bits at ``HASHES`` places. Looking an n-gram up is one "and" of the masks at its places and
gives all languages that contain it at once.

A text is decided by popcounts: for each language, the number of its n-grams whose mask has the language's bit. Some of
these are false positives, at a rate f that the filter's fill of the language tells, so the count c of n n-grams is
corrected to (c - n f) / (1 - f). The largest corrected count wins (ties: the language that sorts first); the score is
the corrected count divided by n, between 0 and 1.

Fitting is bounded: about ``SAMPLE`` labelled documents, chosen by a hash of id and text (equal rows once), are read whole. The n-grams of
all partitions are counted there and summed by Spark; those above the share limit come to the driver, at most (n-grams
of an average document) / ``min_share`` per language. The filter has a fixed size of 8 bytes times ``SLOTS`` for every
64 languages, and is broadcast.

Results on edges: null texts and texts without a letter are ``und`` with score 0; so is every text if no labelled row
was there to learn from. A text without any known n-gram gets the language with most sampled documents, score 0.
Repeated rows are predicted alike. Very long texts are read in slices that are cut between words where possible.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from forumlens.llm.common import BOOK, append_from_texts, col, hash_sample, id_fold, table
from forumlens.session import cut_lineage

GRAMS = (3, 4)
HASHES = 4
SLOTS = 1 << 18
SAMPLE = 20_000
MIN_SHARE = 0.02
MIN_RATIO = 0.25
SLICE = 1 << 18          # characters of a batch that are worked on at once
UNKNOWN = "und"

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For every code point whether it is a letter."""
    if not _LETTERS:
        table_ = np.zeros(0x110000, bool)
        for point in range(0x110000):
            if chr(point).isalpha():
                table_[point] = True
        _LETTERS.append(table_)
    return _LETTERS[0]


def _points(text: str) -> np.ndarray:
    """Code points of a text, with one zero for every run of other characters than letters and at both ends."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _is_letter()[raw]
    kept = letters.copy()
    kept[1:] |= letters[:-1]                       # the first character behind a word stands for the run
    kept[0] = True
    return np.where(letters, raw, 0)[kept]


def _slices(text: str) -> list[str]:
    """A long text in slices, cut where a word ends if there is such a place."""
    if len(text) <= SLICE:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = min(start + SLICE, len(text))
        if end < len(text):
            back = end
            while back > start and text[back - 1].isalpha():
                back -= 1
            end = back if back > start else end
        out.append(text[start:end])
        start = end
    return out


def grams_of(points: np.ndarray, sizes: tuple[int, ...] = GRAMS) -> np.ndarray:
    """64-bit codes of all n-grams that have word borders at their ends only."""
    points = points.astype(np.uint64)
    out = []
    for size in sizes:
        if len(points) < size:
            continue
        n = len(points) - size + 1
        code = np.full(n, size, np.uint64)
        inner = np.ones(n, bool)
        for i in range(size):
            piece = points[i:i + n]
            code = (code ^ piece) * _MULTIPLY
            code ^= code >> np.uint64(29)
            if 0 < i < size - 1:
                inner &= piece != 0
        out.append(code[inner])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Filters(NamedTuple):
    """The bit-sliced filter: masks by slot, the languages of the bits, and their false positive rates."""
    languages: list[str]
    usual: int                  # the language with most sampled documents
    masks: np.ndarray
    rates: np.ndarray
    sizes: tuple[int, ...]


def _places(codes: np.ndarray, slots: int) -> list[np.ndarray]:
    """The slots of each code; every hash has its own part of the table."""
    part = slots // HASHES
    found = []
    for i in range(HASHES):
        mixed = (codes ^ np.uint64(0x632BE59BD9B4E019 * (i + 1) & 0xFFFFFFFFFFFFFFFF)) * _MULTIPLY
        found.append((mixed >> np.uint64(33)) % np.uint64(part) + np.uint64(i * part))
    return found


def build(grams: dict[str, np.ndarray], documents: dict[str, int], slots: int = SLOTS, sizes: tuple[int, ...] = GRAMS) -> Filters:
    """The filter of the n-grams of each language."""
    languages = sorted(grams)
    masks = np.zeros((max(1, -(-len(languages) // 64)), slots), np.uint64)
    rates = np.zeros(len(languages))
    for bit, language in enumerate(languages):
        hit = np.zeros(slots, bool)
        for places in _places(grams[language], slots):
            hit[places] = True
        masks[bit // 64, hit] |= np.uint64(1 << bit % 64)
        rates[bit] = np.prod(hit.reshape(HASHES, -1).mean(axis=1))
    usual = max(range(len(languages)), key=lambda i: (documents[languages[i]], -i)) if languages else -1
    return Filters(languages, usual, masks, rates, sizes)


def counts(texts: list[str], filters: Filters) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of each text, and how many of them each language contains (before correction)."""
    total = np.zeros(len(texts))
    found = np.zeros((len(texts), len(filters.languages)))
    waiting: list[tuple[int, str]] = []

    def flush():
        if not waiting:
            return
        points = [_points(piece) for _, piece in waiting]
        codes = [grams_of(p, filters.sizes) for p in points]
        owner = np.repeat([i for i, _ in waiting], [len(c) for c in codes])
        flat = np.concatenate(codes)
        if len(flat):
            places = _places(flat, filters.masks.shape[1])
            total[:] += np.bincount(owner, minlength=len(texts))
            for word, slots in enumerate(filters.masks):
                mask = slots[places[0]]
                for more in places[1:]:
                    mask &= slots[more]
                for bit in range(min(64, len(filters.languages) - 64 * word)):
                    found[:, 64 * word + bit] += np.bincount(owner, (mask >> np.uint64(bit)) & np.uint64(1), minlength=len(texts))
        waiting.clear()

    size = 0
    for i, text in enumerate(texts):
        for piece in _slices(text):
            waiting.append((i, piece))
            size += len(piece)
            if size >= SLICE:
                flush()
                size = 0
    flush()
    return total, found


def decide(texts: list[str | None], filters: Filters) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    if not filters.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    total, found = counts([t or "" for t in texts], filters)
    corrected = np.clip((found - total[:, None] * filters.rates) / np.maximum(1 - filters.rates, 1e-9), 0, None)
    best = corrected.argmax(axis=1)
    value = corrected[np.arange(len(texts)), best]
    best = np.where(value > 0, best, filters.usual)
    score = np.clip(value / np.maximum(total, 1), 0, 1)
    return ([filters.languages[b] if n else UNKNOWN for b, n in zip(best, total)],
            [float(s) if n else 0.0 for s, n in zip(score, total)])


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample: int = SAMPLE,
        min_share: float = MIN_SHARE, min_ratio: float = MIN_RATIO, slots: int = SLOTS,
        sizes: tuple[int, ...] = GRAMS) -> Filters:
    """Learn the filter from the rows with text and label."""
    known = labelled.filter(col(label).isNotNull())
    rows = known.select(F.count(F.lit(1))).first()[0]
    chosen = hash_sample(known.select(col(key), col(text), col(label)), [key, text], sample, rows).dropDuplicates().filter(col(text).isNotNull())

    def run(batches):
        """(language, n-gram, documents that have it); n-gram null: documents in all."""
        for batch in batches:
            per: dict[str, list[np.ndarray]] = {}
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = [grams_of(_points(piece), sizes) for piece in _slices(content)]
                per.setdefault(name, []).append(np.unique(np.concatenate(codes)))
            for name, several in per.items():
                codes, n = np.unique(np.concatenate(several), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * (len(codes) + 1), pa.string()), pa.array([None, *codes.view(np.int64).tolist()], pa.int64()),
                     pa.array([len(several), *n.tolist()], pa.int64())], ["language", "gram", "n"])

    # read twice below: settle it
    summed = cut_lineage(chosen.select(col(label).cast("string"), col(text).cast("string"))
              .mapInArrow(run, "language string, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n")))
    sums = {r["language"]: r["n"] for r in summed.filter("gram IS NULL").collect()}
    least = F.create_map(*[F.lit(x) for name, n in sums.items() for x in (name, min_share * n)]) if sums else F.lit(None)
    grams = summed.filter(F.col("gram").isNotNull())
    grams = (grams.filter(F.col("n") >= least[F.col("language")]) if sums else grams).toPandas()
    share = grams.n / grams.language.map(sums)
    largest = share.groupby(grams.gram).transform("max")
    grams = grams[share >= min_ratio * largest]
    return build({name: grams[grams.language == name].gram.to_numpy(np.int64).view(np.uint64) for name in sums}, sums, slots, sizes)


def predict(docs: DataFrame, filters: Filters, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append language and score of every text. The filter is broadcast; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    return append_from_texts(docs, text, [StructField("lang_pred", StringType()), StructField("score", DoubleType())],
                             lambda texts: list(decide(texts, shared.value)), keep)


@BOOK.add("op1_language_filters")
def language_filters(spark, sf_dir):
    """Language of every document, learned from the documents outside fold 1 of 3."""
    docs = table(spark, sf_dir, "documents")
    held_out = id_fold("doc_id", 3) == 1
    filters = fit(docs.filter(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), filters, keep=["doc_id", "held_out"])
