"""Near duplicates by SimHash fingerprints and anchor points.

Fingerprint: ASCII letters lower-cased, words between blanks, shingles of three words (fewer words: all of them; none:
fingerprint zero), XXH64 with seed 42 of every shingle, and a bit is 1 where more than half of the hashes have it.

Links: two fingerprints link at ``RADIUS`` = 3 or fewer differing bits. Of a linked pair, one of the two 32-bit halves
differs in at most one bit. Anchors of a half are the words of a covering code: the Hamming code of length 31 (every
word is within distance 1 of a code word) with one free bit, so the covering radius is 1. Every fingerprint is sent to
all anchors within covering radius plus threshold, 1 + 1 = 2, of either half: 2 or 17 anchors. The anchor next to the
one of a pair is within distance 2 of the other, so each pair meets at an anchor. There are 2^27 anchors for each half,
so unrelated fingerprints rarely meet.

Equal fingerprints collapse before anything is replicated, so a group of exact copies is one row. At an anchor, the
fingerprints that link are found group by group, and each is linked to the smallest of its group there: as many links
as fingerprints, not as pairs. Where very many different fingerprints stand around one anchor, it is split by the four
bytes of the other half, one of which is equal in every linked pair. Links become components by alternating large-star
and small-star rounds on tables, each cut by a checkpoint; nothing but counters reaches the driver. What stands on a hub (a
node with more than 1 in ``HUBS`` of the rows that are joined; there are at most ``HUBS`` of them) is joined from memory, so no
task gets all neighbours of one node, nor all copies of one text.

Results on edges: null and empty texts have fingerprint zero, which links like any other. The id of a component is
its smallest id; null ids count as larger than all, and a component without any other id has a null id. Repeated rows
are copies. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from forumlens.llm.common import BOOK, append_from_texts, col, table, without
from forumlens.session import cut_lineage, small_side

WORDS = 3
SEED = 42
RADIUS = 3
BLOCK = 1 << 14          # shingles whose bits are counted at once
HOT_ANCHOR = 20_000      # fingerprints around one anchor above which it is split
HOT_SAMPLE = 16          # one fingerprint in so many is looked at to find such anchors
HUBS = 2048              # a key with more than one in so many rows is joined from memory
MAX_ROUNDS = 60


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit number."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        shingles = list(map(b" ".join, zip(*[parts[i:] for i in range(words)])))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at:at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", keep: list[str] | None = None,
                 words: int = WORDS, seed: int = SEED) -> DataFrame:
    """Append the fingerprint of every text as a signed 64-bit number. No shuffle."""
    return append_from_texts(docs, text, [StructField(out, LongType())],
                             lambda texts: [[fingerprint(t, words, seed) for t in texts]], keep)


# --- anchors --------------------------------------------------------------------------------------------

def _syndromes(half: np.ndarray) -> np.ndarray:
    """For 32-bit halves: the exclusive or of the places (1 to 31) of the set bits but the topmost, free one."""
    found = np.zeros(len(half), np.uint64)
    for place in range(1, 32):
        found ^= ((half >> np.uint64(place - 1)) & np.uint64(1)) * np.uint64(place)
    return found


_PAIRS = np.array([[(1 << (i - 1)) | (1 << ((i ^ s) - 1)) if s and 0 < (i ^ s) and i < (i ^ s) else 0
                    for i in range(1, 32)] for s in range(32)], np.uint64)  # bits to flip for each syndrome; 0: no pair
_FREE = np.uint64(1 << 31)


def anchors_of(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchors: all code words within distance 2 of each half."""
    rows = np.arange(len(half))
    s = _syndromes(half)
    nearest = np.where(s == 0, half, half ^ (np.uint64(1) << (np.maximum(s, np.uint64(1)) - np.uint64(1))))
    flips = _PAIRS[s.astype(np.int64)]
    at, which = np.nonzero(flips)
    return (np.concatenate([rows, rows, at]),
            np.concatenate([nearest, nearest ^ _FREE, half[at] ^ flips[at, which]]))


def _replicas(batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and fingerprints; bit 32 of an anchor tells the half."""
    full = batch.view(np.uint64)
    anchors, prints = [], []
    for side, half in enumerate((full & np.uint64(0xFFFFFFFF), full >> np.uint64(32))):
        rows, found = anchors_of(half)
        anchors.append(found | np.uint64(side << 32))
        prints.append(full[rows])
    return np.concatenate(anchors).view(np.int64), np.concatenate(prints).view(np.int64)


def to_anchors(prints: DataFrame, column: str = "fingerprint") -> DataFrame:
    """(anchor, fingerprint) for every anchor in reach of each fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, found = _replicas(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(found)], ["anchor", "fingerprint"])

    return prints.select(col(column)).mapInArrow(run, "anchor long, fingerprint long")


def groups_at_anchor(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints that link to another one, and the smallest of their group.

    A group grows from its smallest member: whatever is in reach of a member joins and leaves the rest, so
    members are only compared with what no group has yet."""
    rest = np.unique(prints)
    linked, roots = [], []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        front = [root]
        while front and len(rest):
            near = np.bitwise_count((rest ^ front.pop()).view(np.uint64)) <= radius
            found = rest[near]
            if len(found):
                rest = rest[~near]
                linked.append(found)
                roots.append(np.full(len(found), root))
                front.extend(found)
    if not linked:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(linked), np.concatenate(roots)


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a partition come sorted by anchor; the last anchor of a batch waits for the next batch."""
        def result(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch | None:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            ends = np.r_[starts[1:], len(keys)]
            several = np.flatnonzero(ends - starts > 1)
            found = [groups_at_anchor(prints[starts[i]:ends[i]], radius) for i in several]
            if not found:
                return None
            a, b = (np.concatenate(x) for x in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            if keys[0] == keys[-1] and (not waiting or waiting[-1][0][-1] == keys[0]):
                waiting.append((keys, prints))
                continue
            last = int(np.searchsorted(keys == keys[-1], True))
            done = result(*(np.concatenate(x) for x in zip(*waiting, (keys[:last], prints[:last]))))
            waiting = [(keys[last:], prints[last:])]
            if done is not None:
                yield done
        if waiting:
            done = result(*(np.concatenate(x) for x in zip(*waiting)))
            if done is not None:
                yield done

    return run


def links(prints: DataFrame, column: str = "fingerprint", radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints with the same components as all pairs within the radius.

    Two halves and a covering radius of 1 hold for a radius of up to 3."""
    if radius > 3:
        raise ValueError("the anchors cover up to 3 differing bits")
    distinct = prints.select(col(column).alias("fingerprint")).distinct()
    sample = distinct.filter(F.pmod(F.xxhash64("fingerprint"), F.lit(HOT_SAMPLE)) == 0)
    hot = (to_anchors(sample).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
           .filter(F.col("n") * HOT_SAMPLE >= HOT_ANCHOR).select("anchor", F.lit(True).alias("hot")))
    placed = to_anchors(distinct).join(small_side(hot), "anchor", "left")
    # the half that the anchor does not belong to, byte by byte
    other = F.when(F.col("anchor").bitwiseAND(F.lit(1 << 32)) == 0, F.shiftrightunsigned("fingerprint", 32)).otherwise(
        F.col("fingerprint").bitwiseAND(F.lit(0xFFFFFFFF)))
    bytes_ = [F.shiftright(other, 8 * i).bitwiseAND(F.lit(255)) + F.lit(256 * i + 1) for i in range(4)]
    split = placed.withColumn("part", F.explode(F.when(F.col("hot"), F.array(*bytes_)).otherwise(F.array(F.lit(0).cast("long")))))
    keyed = split.select(F.col("anchor").bitwiseOR(F.shiftleft(F.col("part"), 33)).alias("anchor"), "fingerprint")
    return (keyed.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare(radius), "a long, b long")
            .distinct())


# --- components -----------------------------------------------------------------------------------------

def _smaller(edges: DataFrame) -> DataFrame:
    """Edges with the larger end first, each once."""
    return (edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())


def with_looked_up(rows: DataFrame, side: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows with a side that has one row per key and the number of its rows as ``__n``, of ``total`` rows at least.

    Keys with ``total / HUBS`` rows or more, at most ``HUBS`` of them, are joined by broadcast, all others by shuffle."""
    is_hub = F.col("__n") * F.lit(HUBS) >= F.lit(max(total, HUBS))
    marked = rows.join(F.broadcast(side.filter(is_hub).withColumn("__hub", F.lit(True))), key, "left")
    values = [c for c in side.columns if c != key]
    rest = marked.filter("__hub IS NULL").drop("__hub", *values).join(side.filter(~is_hub), key, how)
    return marked.filter("__hub").drop("__hub").unionByName(rest)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("__n"))
    return with_looked_up(both.filter("b > a"), least, "a", n).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("__n"))
    tied = with_looked_up(edges, least, "a", n).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node but the smallest of a component, and that smallest node."""
    now = cut_lineage(_smaller(edges))
    mark = (now.count(), None)
    for _ in range(MAX_ROUNDS):
        now = cut_lineage(_smaller(_small_star(_smaller(_large_star(now, mark[0])), mark[0])))
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == (row["n"], row["s"]):
            return now
        mark = (row["n"], row["s"])
    raise RuntimeError("components did not settle")


def components_of(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS,
                  extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, extra columns, fingerprint, component_id) for every row."""
    prints = cut_lineage(fingerprints(docs, text, "__print", [key, *extra]))
    distinct = prints.groupBy("__print").agg(F.min(col(key)).alias("__lead"), F.count(F.lit(1)).alias("__copies"))
    roots = components(links(distinct, "__print", radius)).select(F.col("a").alias("__print"), F.col("b").alias("__to"))
    placed = cut_lineage(distinct.join(roots, "__print", "left").withColumn("__root", F.coalesce("__to", "__print"))
                         .select("__print", "__lead", "__root", "__copies"))
    n_prints, n_rows = placed.agg(F.count(F.lit(1)), F.coalesce(F.sum("__copies"), F.lit(0))).first()
    # only fingerprints with a link need their component's smallest id looked up
    least = placed.groupBy("__root").agg(F.min("__lead").alias("__id"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    named = with_looked_up(placed, least, "__root", n_prints, "left").select(
        "__print", F.when(F.col("__n").isNotNull(), F.col("__id")).otherwise(F.col("__lead")).alias("component_id"),
        F.col("__root").alias("__component"), F.col("__copies").alias("__n"))
    kept = without(prints.drop("__print"), ["fingerprint", "component_id"])
    return with_looked_up(prints, cut_lineage(named), "__print", n_rows).select(
        *[col(c) for c in kept], F.lower(F.lpad(F.hex("__print"), 16, "0")).alias("fingerprint"), "component_id", "__component")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row of each group of near duplicates, with the columns of the table.

    It is the row with the smallest id, then with the smallest digest of its columns; of wholly equal rows one."""
    columns = [col(c) for c in docs.columns]
    digest = ["__row1", "__row2"]  # 128 bits, so that different rows are told apart in tables of any size
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])  # the hash passes over nulls
    marked = docs.withColumns({"__row1": F.xxhash64(nulls, *columns), "__row2": F.xxhash64(F.lit(1), nulls, *columns)})
    groups = components_of(marked, text, key, radius, tuple(digest))
    order = F.struct(col(key).isNull().alias("none"), col(key).alias("id"), *digest)
    first = groups.groupBy("__component").agg(F.min(order).alias("first"))
    wanted = first.select("first.__row1", "first.__row2")
    # the join and the removal of equal rows need the same distribution, so the texts are exchanged once
    return marked.join(wanted, digest, "left_semi").dropDuplicates(digest).select(*columns)


@BOOK.add("op6_simhash_components")
def simhash_components(spark, sf_dir):
    """Fingerprint and component of every document."""
    return components_of(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("__component")
