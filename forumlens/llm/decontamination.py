"""Benchmark decontamination by SimHash windows of the size of the items.

Words are runs of letters, digits and underscores, lower-cased; shingles are five words. A window of a document that
is as many words long as a benchmark item gets a SimHash fingerprint of its weighted shingles. All fingerprints within
``RADIUS`` bits of an item's are found by multi-index hashing: the 64 bits are cut into 8 blocks, of which at least one
differs in at most RADIUS // 8 bits, so looking up each block's near values misses nothing. Candidates are verified by
the exact similarity: the cosine of the two weighted shingle counts, which is the quantity that a SimHash distance
estimates. It is taken twice: with plain counts, and with a weight of one divided by the number of different items that
have a shingle, so that phrases shared by many items count little. A window is a hit where either is ``SIMILARITY`` =
0.8 or more, so an edited copy of an item is found however many items share its text; the larger one is reported. The
radius lies 3.5 standard deviations above the distance expected at that similarity, and where the weights of a window
are not all one, both fingerprints are looked up. Items are counted over the whole benchmark, equal texts once.

A window without any shingle of an item has similarity zero to it: words are looked up in the items' vocabulary, five
known words in a row in the items' shingles, and only windows over such places are fingerprinted and looked up, among the
items that have a shingle there. (At a radius of 24 of 64 bits blocks alone tell little apart: nearly all pairs pass
them.) Fingerprints of all windows of a stretch come from running sums, one pass per item size.

The benchmark goes along with the tasks, ``BLOCK_ITEMS`` items or ``BLOCK_BYTES`` of text at a time: a larger benchmark
means more passes, each with an index of bounded size. Items of one to four words, whose text occurs
by chance, are a hit where the words of a whole line are theirs; items without a word are not looked for (``unsearched``).

Results on edges: null and empty texts are clean. A document shorter than an item is one window. Null items and items
with equal text count once each under their own id; null item ids are left out. Overlapping hits of one item count
once, the best one. Repeated rows are judged alike. Without items every document is clean.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from forumlens.llm.common import BOOK, append_from_texts, col, table
from forumlens.session import cut_lineage

WORDS = 5
SIMILARITY = 0.8
RADIUS = 24
BLOCKS = 8
BLOCK_ITEMS = 50_000     # items of a pass, and
BLOCK_BYTES = 16 << 20   # bytes of their texts
SHORT_LINE = 4096        # characters of a line that may be an item of few words
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingle_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of all shingles; a text of fewer words is one shingle."""
    rows = [" ".join(words)] if len(words) < WORDS else list(map(" ".join, zip(*[words[i:] for i in range(WORDS)])))
    return np.fromiter((xxhash.xxh64_intdigest(r.encode("utf-8", "surrogatepass")) for r in rows), np.uint64, len(rows))


def bit_votes(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row per shingle: its weight, positive at the bits that are set."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return (bits.astype(np.float64) * 2 - 1) * weights[:, None]


def to_prints(votes: np.ndarray) -> np.ndarray:
    """Fingerprints from rows of votes."""
    return np.packbits(votes > 0, axis=1, bitorder="little").view("<u8").reshape(-1)


def cosine(a: Counter, b: Counter, weight) -> float:
    """Cosine of two shingle counts, each shingle scaled by its weight."""
    both = sum(n * b[s] * weight(s) ** 2 for s, n in a.items() if s in b)
    size = math.sqrt(sum((n * weight(s)) ** 2 for s, n in a.items()) * sum((n * weight(s)) ** 2 for s, n in b.items()))
    return both / size if size else 0.0


class Index:
    """Items of a benchmark, by size: fingerprints in blocks, and what is needed to find and verify windows."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS, similarity: float = SIMILARITY,
                 shared: dict[int, int] | None = None):
        """``shared`` has the shingles of several items of the whole benchmark; without it these items are all."""
        self.radius, self.similarity = radius, similarity
        self.ids: list[int] = []
        self.counts: list[Counter] = []
        sizes: list[int] = []
        texts = [(i, words_of(t)) for i, t in sorted(items)]
        self.short: dict[tuple, list[int]] = {}
        for i, w in texts:
            if 0 < len(w) < WORDS:
                self.short.setdefault(tuple(w), []).append(i)
        texts = [(i, w) for i, w in texts if len(w) >= WORDS]
        hashes = [shingle_hashes(w) for _, w in texts]
        if shared is None:
            shared = Counter()
            for h in {" ".join(w): h for (_, w), h in zip(texts, hashes)}.values():
                shared.update(set(h.tolist()))
        self.has = {s: n for s, n in shared.items() if n > 1}
        self.vocabulary: dict[str, int] = {}
        items_with: dict[int, list[int]] = {}
        prints, plain = [], []
        for row, ((i, w), h) in enumerate(zip(texts, hashes)):
            self.ids.append(i)
            sizes.append(len(w))
            self.counts.append(Counter(h.tolist()))
            prints.append(to_prints(bit_votes(h, self.weights(h)).sum(axis=0, keepdims=True))[0])
            plain.append(to_prints(bit_votes(h, np.ones(len(h))).sum(axis=0, keepdims=True))[0])
            numbers = np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64)
            for code in set(self.codes(numbers).tolist()):
                items_with.setdefault(code, []).append(row)
        self.sizes, self.prints = np.array(sizes, np.int64), np.array(prints, np.uint64)
        self.plain = np.array(plain, np.uint64)
        self.known = np.array(sorted(items_with), np.int64)
        self.items_with = {c: np.array(r) for c, r in items_with.items()}
        # for two values of the 8 bits of a block, whether they are near enough
        self.near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= radius // BLOCKS

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        return np.fromiter((1 / self.has.get(h, 1) for h in hashes.tolist()), np.float64, len(hashes))

    @staticmethod
    def codes(numbers: np.ndarray) -> np.ndarray:
        """One number per five words in a row; 0 where a word is unknown."""
        n = len(numbers) - WORDS + 1
        code, known = np.zeros(max(n, 0), np.uint64), np.ones(max(n, 0), bool)
        for i in range(WORDS if n > 0 else 0):
            part = numbers[i:i + n]
            known &= part > 0
            code = (code ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(31)
        return np.where(known, code.view(np.int64), 0)

    def candidates(self, prints: np.ndarray, rows: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius, among some items, by weighted or plain fingerprints."""
        of = (self.plain if plain else self.prints)[rows]
        left, right = (x.astype("<u8").view(np.uint8).reshape(-1, BLOCKS) for x in (prints, of))
        reached = np.zeros((len(prints), len(rows)), bool)
        for b in range(BLOCKS):
            reached |= self.near[left[:, b][:, None], right[:, b]]
        window, item = np.nonzero(reached)
        close = np.bitwise_count(prints[window] ^ of[item]) <= self.radius
        return window[close], rows[item[close]]

    def places(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places in a list of words where a shingle of an item begins, and the shingle."""
        numbers = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        code = self.codes(numbers)
        some = np.flatnonzero(code)
        if not len(some) or not len(self.known):
            return some[:0], code[:0]
        at = np.minimum(np.searchsorted(self.known, code[some]), len(self.known) - 1)
        some = some[self.known[at] == code[some]]
        return some, code[some]

    def hits(self, text: str | None) -> list[dict]:
        """Best hits of every item in a text; hits of one item do not overlap."""
        words = words_of(text) if text else []
        out = self.short_hits(text) if words and self.short else []
        if len(words) < WORDS or not self.ids:
            return out
        places, codes = self.places(words)
        if not len(places):
            return out
        wanted: dict[int, dict[int, list[np.ndarray]]] = {}
        for place, code in zip(places.tolist(), codes.tolist()):
            rows = self.items_with[code]
            for size in set(self.sizes[rows].tolist()):
                wanted.setdefault(size, {}).setdefault(place, []).append(rows[self.sizes[rows] == size])
        found: dict[int, list[tuple[float, int, int]]] = {}
        for size, where in wanted.items():
            order = sorted(where)
            for first, last in stretches(order, size, len(words)):
                near = order[bisect_left(order, first):bisect_left(order, last + size)]
                self.stretch(words, first, last, size, np.unique(np.concatenate([r for p in near for r in where[p]])), found)
        spans = word_spans(text) if found else []
        for row, windows in found.items():
            taken: list[tuple[int, int]] = []
            for similarity, start, end in sorted(windows, key=lambda w: (-w[0], w[1])):
                if all(end <= a or start >= b for a, b in taken):
                    taken.append((start, end))
                    out.append({"item_id": self.ids[row], "start": spans[start][0], "end": spans[end - 1][1],
                                "similarity": similarity})
        return sorted(out, key=lambda h: (h["start"], h["item_id"]))

    def short_hits(self, text: str) -> list[dict]:
        """Lines whose words are those of an item of fewer than five words."""
        out, at = [], 0
        for line in text.split("\n"):
            for i in self.short.get(tuple(words_of(line)) if len(line) < SHORT_LINE else (), ()):
                spans = word_spans(line)
                out.append({"item_id": i, "start": at + spans[0][0], "end": at + spans[-1][1], "similarity": 1.0})
            at += len(line) + 1
        return out

    def stretch(self, words: list[str], first: int, last: int, size: int, rows: np.ndarray, found: dict) -> None:
        """Windows of a size that begin at the words from ``first`` up to ``last``, against some items."""
        size_here = min(size, len(words))
        for begin in range(first, last + 1, 4096):
            stop = min(begin + 4095, last)
            hashes = shingle_hashes(words[begin:stop + size_here])
            span = max(size_here - WORDS + 1, 1)
            pairs: set[tuple[int, int]] = set()
            weights, prints = np.ones(len(hashes)), None
            for plain in (True, False) if self.has else (True,):
                own = weights if plain else self.weights(hashes)
                if prints is None or (own != weights).any():
                    votes = np.vstack([np.zeros(64), np.cumsum(bit_votes(hashes, own), axis=0)])
                    prints = to_prints(np.round(votes[span:] - votes[:-span], 9))
                pairs.update(zip(*(x.tolist() for x in self.candidates(prints, rows, plain))))
            for window, row in sorted(pairs):
                counts = Counter(hashes[window:window + span].tolist())
                similarity = cosine(counts, self.counts[row], lambda s: 1)
                if self.has:
                    similarity = max(similarity, cosine(counts, self.counts[row], lambda s: 1 / self.has.get(s, 1)))
                if similarity >= self.similarity:
                    found.setdefault(row, []).append((similarity, begin + window, begin + window + size_here))


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where the words of a text stand in it; a letter's lower case may be longer than the letter."""
    low = text.lower()
    spans = [m.span() for m in _WORD.finditer(low)]
    if len(low) == len(text):
        return spans
    ends = np.cumsum([len(c.lower()) for c in text])       # of every letter, in the lower-cased text
    return [(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b - 1, "right")) + 1) for a, b in spans]


def unsearched(benchmark: DataFrame, text: str = "text") -> int:
    """Items without a word, which are not looked for."""
    return benchmark.filter(F.length(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"[^\p{L}\p{N}_]", "")) == 0).count()


def stretches(places: list[int], size: int, n: int) -> list[tuple[int, int]]:
    """Ranges of window starts such that the window has one of the places."""
    out: list[tuple[int, int]] = []
    end = max(0, n - size)
    for place in places:
        first, last = max(0, min(place - (size - WORDS), end)), min(place, end)
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


HIT = StructType([StructField("item_id", LongType()), StructField("start", IntegerType()), StructField("end", IntegerType()),
                  StructField("similarity", DoubleType())])


def as_words(items: DataFrame) -> DataFrame:
    """The words of every text in ``t`` between single blanks, so that texts of equal words are equal."""
    return append_from_texts(items.select("t"), "t", [StructField("w", StringType())],
                             lambda texts: [[" ".join(words_of(t)) for t in texts]], []).select(F.col("w").alias("t"))


def item_shingles(items: DataFrame) -> DataFrame:
    """(t, s): the different shingles of every text in ``t``, as signed numbers."""
    found = append_from_texts(items, "t", [StructField("s", ArrayType(LongType()))],
                              lambda texts: [[list(set(shingle_hashes(w).view(np.int64).tolist())) if len(w := words_of(t)) >= WORDS
                                              else [] for t in texts]])
    return found.select(*items.columns, F.explode("s").alias("s"))


def item_blocks(benchmark: DataFrame, text: str = "text", key: str = "item_id", size: int = BLOCK_ITEMS, bytes_: int = BLOCK_BYTES):
    """Lists of about ``size`` or ``bytes_`` at most, one at a time on the driver, by the hash of the items: the items,
    and how many different texts of the whole benchmark have each of their shingles, where several have it."""
    items = benchmark.filter(col(key).isNotNull() & col(text).isNotNull()).select(col(key).cast("long").alias("i"), col(text).alias("t"))
    count, total = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    blocks = max(1, math.ceil(count / size), math.ceil(total / bytes_))
    shared = cut_lineage(item_shingles(as_words(items).distinct()).groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    for block in range(blocks):
        chosen = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block)
        own = shared if blocks == 1 else shared.join(item_shingles(chosen.select("t")).select("s").distinct(), "s")
        yield [(r["i"], r["t"]) for r in chosen.collect()], {r["s"] % (1 << 64): r["n"] for r in own.select("s", "n").collect()}


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "hits", keep: list[str] | None = None,
         block_items: int = BLOCK_ITEMS, **options) -> DataFrame:
    """Append the hits of every text: item, code points from start to end, similarity. No shuffle."""
    context = docs.sparkSession.sparkContext
    kept = [c for c in docs.columns if c.lower() != out.lower() and (keep is None or c in keep)]
    found, columns = docs.select(*[col(c) for c in kept], col(text).alias("__content")), []
    for number, (items, shared) in enumerate(item_blocks(benchmark, size=block_items)):
        index = context.broadcast(Index(items, shared=shared, **options))
        columns.append(f"__hits{number}")
        found = append_from_texts(found, "__content", [StructField(columns[-1], ArrayType(HIT))],
                                  lambda texts, index=index: [[index.value.hits(t) for t in texts]])
    return found.select(*[col(c) for c in kept], (F.concat(*columns) if columns else F.array().cast(ArrayType(HIT))).alias(out))


def clean_rows(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows without any hit, with their own columns."""
    marked = find(docs, benchmark, text, "__hits", **options)
    return marked.filter(F.size("__hits") == 0).select(*[col(c) for c in docs.columns])


@BOOK.add("op2_simhash_windows")
def simhash_windows(spark, sf_dir):
    """Benchmark items in every document."""
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_hits"),
                        F.sort_array(F.array_distinct("hits.item_id")).alias("items"),
                        F.array_max("hits.similarity").alias("best_similarity"))
