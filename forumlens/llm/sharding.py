"""Sharding by histogram sort.

Rows are ordered by (hash of the text, id, number of the row), so equal texts stand together and everything else is
shuffled. The order is cut into shards of nearly equal bytes. The cuts are found by counting: every round counts, exactly
and in all partitions, the bytes between candidate keys, with the smallest and largest key that occurs there; each wanted
cut lies between two candidates, and the next round places its candidates inside that gap only. A cut is settled when its
gap holds one row or fewer bytes than the tolerance. A group of copies of one text, however large, is cut by id, and one
of wholly equal rows by their numbers: the gap shrinks to one hash after one round, then to one id. Only candidates and
their counts reach the driver, at most ``PROBES`` per cut.

With the cuts known, the keys alone are put in order once by Spark, which gives every key its place in its shard, and every
``PIECE_ROWS``-th key is the border of a piece. Rows are exchanged once, to their pieces, and a slot is the place of the
piece's border plus the place within the piece: no shard is sorted in one task, and no piece has more rows than that,
whatever their size. The borders, one for every ``PIECE_ROWS`` rows of the table, are sent to the tasks.

The law is ``bytes``: sizes of shards are equal up to the tolerance and one row on either side. Rows are numbered as they
are read, which must be in the same partitions both times: from files, or settled (``session.cut_lineage``).

Results on edges: a null text has no bytes and the checksum 0; every row has 16 bytes besides its text. Null ids sort
before all others. An empty table gives an empty table. Ids that are no whole numbers are ordered by their hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window as W

from forumlens.llm.common import BOOK, col, numbered, table, without
from forumlens.session import cut_lineage

SHARDS = 40
ROW_BYTES = 16
TOLERANCE = 1e-4         # of the mean bytes of a shard
PROBES = 128             # candidates in the gap of each cut and round
PIECE_ROWS = 100_000     # rows of a piece, exactly, but for a shard's last one
MAX_ROUNDS = 64
_SIGN = np.uint64(1 << 63)


WORDS = 3                # 64-bit numbers of a key


def packed(*parts: np.ndarray) -> np.ndarray:
    """Signed 64-bit numbers side by side as bytes that sort like the tuple."""
    columns = np.stack([p.astype(np.int64).view(np.uint64) ^ _SIGN for p in parts], axis=1)
    return np.ascontiguousarray(columns.astype(">u8")).view(f"S{8 * len(parts)}").reshape(-1)


def to_number(key: bytes) -> int:
    return int.from_bytes(key.ljust(8 * WORDS, b"\0"), "big")  # numpy drops zero bytes at the end


def to_bytes(number: int) -> bytes:
    return min(number, (1 << 64 * WORDS) - 1).to_bytes(8 * WORDS, "big")


def bins(candidates: list[bytes], keys: np.ndarray) -> np.ndarray:
    """How many candidates are at most each key."""
    return np.searchsorted(np.array(candidates, f"S{8 * WORDS}"), keys, "right")


def histogram(keys: DataFrame, candidates: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """For each bin between candidates: bytes, rows, smallest and largest key."""
    def run(batches):
        n = len(candidates) + 1
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low, high = np.full(n, (1 << 64 * WORDS) - 1, object), np.full(n, -1, object)
        probes = [to_bytes(c) for c in candidates]
        for batch in batches:
            *parts, sizes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(WORDS + 1))
            if not len(sizes):
                continue
            key = packed(*parts)
            bin_ = bins(probes, key)
            order = np.argsort(key, kind="stable")     # candidates are ordered as keys are, so bins come out in order
            bin_, key = bin_[order], key[order]
            there, starts = np.unique(bin_, return_index=True)
            ends = np.r_[starts[1:], len(bin_)] - 1
            size += np.bincount(bin_, sizes[order], n).astype(np.int64)
            rows += np.bincount(bin_, minlength=n)
            for b, s, e in zip(there.tolist(), starts.tolist(), ends.tolist()):
                low[b], high[b] = min(low[b], to_number(key[s])), max(high[b], to_number(key[e]))
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(size[used], pa.int64()), pa.array(rows[used], pa.int64()),
             pa.array([to_bytes(low[b]) for b in used], pa.binary()), pa.array([to_bytes(high[b]) for b in used], pa.binary())],
            ["bin", "bytes", "rows", "low", "high"])

    found = (keys.select(*KEY, "__size").mapInArrow(run, "bin int, bytes long, rows long, low binary, high binary")
             .groupBy("bin").agg(F.sum("bytes"), F.sum("rows"), F.min("low"), F.max("high")).collect())
    return {r[0]: (r[1], r[2], to_number(bytes(r[3])), to_number(bytes(r[4]))) for r in found}


def splitters(keys: DataFrame, total: int, parts: int, tolerance: int) -> list[int]:
    """Keys at which the parts 1, 2 and so on begin, so that the bytes below each are as near as can be to its share."""
    # each open cut has a gap: (bytes below it, smallest key, largest key); at first the whole table
    targets = [total * i // parts for i in range(1, parts)]
    whole = histogram(keys, [])
    if not whole or parts < 2:
        return []
    _, _, low, high = whole[0]
    gaps = {t: (0, low, high) for t in targets}
    settled: dict[int, int] = {}
    for _ in range(MAX_ROUNDS):
        if not gaps:
            break
        candidates = sorted({c for _, low, high in gaps.values() for c in spread(low, high)})
        found = histogram(keys, candidates)
        ends, below = [], 0
        for b in range(len(candidates) + 1):
            below += found.get(b, (0, 0, 0, 0))[0]
            ends.append(below)
        for target in list(gaps):
            b = int(np.searchsorted(ends, target, "right"))
            size, rows, low, high = found[b]
            before = ends[b] - size
            if rows == 1 or low == high or size <= tolerance:
                # cut in front of the gap or behind it, whichever is nearer
                settled[target] = low if target - before <= ends[b] - target else high + 1
                del gaps[target]
            else:
                gaps[target] = (before, low, high)
    if gaps:
        raise RuntimeError("cuts did not settle")
    return [settled[t] for t in targets]


def spread(low: int, high: int) -> list[int]:
    """Candidates for a gap: its first key, the key behind its last, and between them steps over its hashes, over its
    ids where it has one hash only, or over the numbers of its rows where they are all equal."""
    inner: set[int] = set()
    for shift in range(64 * (WORDS - 1), -1, -64):
        first, last = low >> shift, high >> shift
        if first != last:
            inner = {(first + max(1, (last - first) * i // PROBES)) << shift for i in range(1, PROBES + 1)}
            break
    return sorted({c for c in inner if low < c} | {low, high, high + 1})


KEY = ["__first", "__second", "__tie"]


def _keys(docs: DataFrame, text: str, key: str) -> DataFrame:
    whole = isinstance(docs.schema[key].dataType, IntegralType)
    second: Column = col(key).cast("long") if whole else F.xxhash64(col(key))
    return (docs.withColumn("__first", F.xxhash64(col(text)))
            .withColumn("__second", F.coalesce(second, F.lit(-(1 << 63))))
            .withColumn("__tie", F.monotonically_increasing_id())
            .withColumn("__size", F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("long") + F.lit(ROW_BYTES)))


def _placed(borders: list[bytes], shards: list[int], starts: list[int]) -> Column:
    """From keys to the part between two borders, its shard and its first slot; there is one part more than borders."""
    from pyspark.sql.functions import pandas_udf

    owners, firsts = np.array(shards, np.int32), np.array(starts, np.int64)

    @pandas_udf("part int, shard int, start long")
    def place(first, second, tie):
        import pandas as pd

        part = bins(borders, packed(first.to_numpy(), second.to_numpy(), tie.to_numpy()))
        return pd.DataFrame({"part": part.astype(np.int32), "shard": owners[part], "start": firsts[part]})

    return place(*KEY)


def shard(docs: DataFrame, text: str = "text", key: str = "doc_id", shards: int = SHARDS, tolerance: float = TOLERANCE,
          piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Append size, shard and slot to every row."""
    narrow = cut_lineage(_keys(docs.select(*{key: 0, text: 0}), text, key).select(*KEY, "__size"))
    total = narrow.agg(F.coalesce(F.sum("__size"), F.lit(0))).first()[0]
    cuts = sorted(to_bytes(c) for c in splitters(narrow, total, shards, int(tolerance * total / shards)))
    parts = list(range(len(cuts) + 1))
    placed = numbered(narrow.select(*KEY, _placed(cuts, parts, [0] * len(parts))["shard"].alias("__shard")), "__shard", KEY)
    # the first key of every shard and of every piece of it, in order; the table below all of them is empty
    borders = sorted((packed(*(np.array([r[c]]) for c in KEY)).tobytes(), r["__shard"], r["idx"])
                     for r in placed.filter(F.col("idx") % piece_rows == 0).collect())
    kept = without(docs, ["size", "shard", "slot"])
    place = _placed([b[0] for b in borders], [0, *[b[1] for b in borders]], [0, *[b[2] for b in borders]])
    rows = _keys(docs, text, key).withColumn("__place", place).withColumn("__part", F.col("__place.part"))
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*KEY))
    return rows.select(*[col(c) for c in kept], F.col("__size").alias("size"), F.col("__place.shard").alias("shard"),
                       (F.col("__place.start") + inside - 1).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; rows of a piece are in one file, ordered by slot."""
    sharded.write.partitionBy("shard").parquet(path)


@BOOK.add("op7_histogram_shards")
def histogram_shards(spark, sf_dir):
    """Shard and slot of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sharded = shard(docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"))
