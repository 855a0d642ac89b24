"""Grouped stratified folds: threads stay whole, and every stratum is spread evenly.

The rule is greedy: threads come in falling order of the spread of their counts over the strata, and each goes to
the fold that leaves the smallest mean, over the strata, of the standard deviation of the folds' shares; of equal folds the
one with fewer rows, then the first. Every choice depends on all earlier ones, but not on the thread itself, only on its
counts. So threads with the same counts are one signature with a multiplicity, built by Spark, and the sequential part
runs over signatures, streamed in order through one task that keeps folds times strata counters.

Choices depend on the folds' counts only up to what all folds share: with d = folds x count - sum of the counts, adding
a thread with v rows of a stratum to fold i makes the sum of squares Q + 2 folds v d_i + folds (folds - 1) v^2, all whole
numbers. A run of equal threads therefore goes round in a cycle as soon as the folds' parts of the run differ as they did
before, and the rest of the run, however long, follows from the cycle without a step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens import fixed_values as V
from forumlens.operators.ranking import attach, group_row_numbers, hash_rank
from forumlens.session import cut_lineage, small_side


ROUNDING = 1e-13         # costs as near as this are equal


class Balance:
    """How far each fold's count of a stratum is from the folds' mean, times the folds, and the folds' rows."""

    def __init__(self, totals: dict[str, int], folds: int):
        self.totals, self.folds = totals, folds
        self.off: dict[str, list[int]] = {}
        self.rows = [0] * folds

    def best(self, counts: list[tuple[str, int]]) -> int:
        """The fold for a thread with these counts."""
        n = self.folds
        costs = [0.0] * n
        for stratum, v in counts:
            off = self.off.setdefault(stratum, [0] * n)
            fixed, slope, total = sum(d * d for d in off) + n * (n - 1) * v * v, 2 * n * v, self.totals[stratum]
            for i, d in enumerate(off):
                costs[i] += math.sqrt(fixed + slope * d) / total
        near = min(costs) * (1 + ROUNDING)
        return min((i for i in range(n) if costs[i] <= near), key=lambda i: (self.rows[i], i))

    def add(self, counts: list[tuple[str, int]], fold: int) -> None:
        for stratum, v in counts:
            off = [d - v for d in self.off.setdefault(stratum, [0] * self.folds)]
            off[fold] += self.folds * v
            self.off[stratum] = off
            self.rows[fold] += v

    def deal(self, counts: list[tuple[str, int]], times: int) -> tuple[list[int], list[int]]:
        """Folds for a run of equal threads: those of the first ones, then a cycle that goes on for the rest."""
        chosen: list[int] = []
        got, seen = [0] * self.folds, {(0,) * self.folds: 0}
        for step in range(1, times + 1):
            fold = self.best(counts)
            self.add(counts, fold)
            chosen.append(fold)
            got[fold] += 1
            least = min(got)
            mark = tuple(g - least for g in got)
            if mark in seen:
                first = seen[mark]
                cycle = chosen[first:]
                rounds, rest = divmod(times - step, len(cycle))
                each = rounds * (len(cycle) // self.folds) * sum(v for _, v in counts)
                self.rows = [r + each for r in self.rows]       # a whole cycle gives every fold the same
                for fold in cycle[:rest]:
                    self.add(counts, fold)
                return chosen[:first], cycle
            seen[mark] = step
        return chosen, []


def _dealt(totals: dict[str, int], folds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balance = Balance(totals, folds)
        for batch in batches:
            plans = [balance.deal([(c["stratum"], c["n"]) for c in cells], times)
                     for cells, times in zip(batch.column("cells").to_pylist(), batch.column("threads").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("cells"), *[pa.array([p[i] for p in plans], pa.list_(pa.int32())) for i in (0, 1)]],
                                             ["cells", "first", "cycle"])

    return run


def signatures(rows: DataFrame, thread: str, strata: list[str], seed: int) -> DataFrame:
    """(thread, cells, rank): the rows of each thread by stratum, and its hash rank. Written once, as it is read several times."""
    stratum = F.concat_ws("|", *strata)
    cells = rows.groupBy(thread, stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    listed = cells.groupBy(thread).agg(F.array_sort(F.collect_list(F.struct("stratum", "n"))).alias("cells"))
    return cut_lineage(listed.withColumn("rank", hash_rank(F.coalesce(F.col(thread).cast("string"), F.lit("")), seed)))


def grouped_folds(rows: DataFrame, thread: str, strata: list[str], folds: int = V.N_FOLDS, seed: int = V.SEED, out: str = "fold") -> DataFrame:
    """The fold of every row. Threads without an id are one thread; ties of the order are broken by a hash."""
    threads = signatures(rows, thread, strata, seed)
    totals = {r[0]: r[1] for r in threads.select(F.inline("cells")).groupBy("stratum").agg(F.sum("n")).collect()}   # one per stratum
    squares, whole = (F.aggregate("cells", F.lit(0).cast("bigint"), f) for f in (lambda s, c: s + c["n"] * c["n"], lambda s, c: s + c["n"]))
    name = F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["stratum"], c["n"].cast("string"))), ",")
    several = (threads.groupBy("cells").agg(F.count(F.lit(1)).alias("threads"))
               .select("*", (F.lit(len(totals)) * squares - whole * whole).alias("spread"), hash_rank(name, seed).alias("turn")))
    ordered = several.repartition(1).sortWithinPartitions(F.desc("spread"), "turn", "cells")
    plans = ordered.select("cells", "threads").mapInArrow(
        _dealt(totals, folds), "cells array<struct<stratum:string,n:bigint>>, first array<int>, cycle array<int>")
    numbered = group_row_numbers(threads, ["cells"], "rank", "place", [thread])
    planned = attach(numbered, small_side(plans), ["cells"])
    later = F.pmod(F.col("place") - F.size("first") - 1, F.size("cycle")) + 1
    fold = F.when(F.col("place") <= F.size("first"), F.get("first", (F.col("place") - 1).cast("int"))).otherwise(
        F.get("cycle", (later - 1).cast("int")))
    return attach(rows, planned.select(thread, fold.alias(out)), [thread])


def signature_share(rows: DataFrame, thread: str, strata: list[str], seed: int = V.SEED) -> tuple[int, int]:
    """Threads and their distinct signatures: the sequential part takes as many steps as there are of the latter."""
    threads = signatures(rows, thread, strata, seed)
    return threads.count(), threads.select("cells").distinct().count()
