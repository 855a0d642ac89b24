"""Linear separators with squared hinge loss, fitted by a distributed trust-region Newton method.

For every class: half the squared length of the weights plus C times the sum of max(0, 1 - y w.x)^2, y = 1 for rows of
the class and -1 for all others, with a constant feature for the offset. The function is convex with one minimum. A step
minimises its second-order model inside a trust region by conjugate gradients; the matrix is never formed, only its
products with a vector, which like the gradient are sums over rows. The products of one step precondition the next. One pass over the rows serves the current question
of every class: its loss and gradient, or one product. Tasks add up dense vectors of their rows; those are
added in a tree, ``FAN`` at a time, and the driver gets the last few. It keeps some sixty vectors per class.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Generator, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.session import cut_lineage

FAN = 16
AT_ONCE = 1 << 15        # entries
TOLERANCE = 1e-5         # of the gradient's length at the start
MAX_STEPS = 100
MAX_PRODUCTS = 200
KEPT = 25                # products of a step that the next one learns from


BLOCK = "labels binary, scales binary, lengths binary, places binary, values binary"


def block(labels: np.ndarray, scales: np.ndarray, lengths: np.ndarray, places: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Some rows as five runs of bytes: their labels, factors and numbers of entries, and the places and values of these.
    Values that are whole numbers are counts, which are dampened when read; they take as few bytes as the largest needs."""
    if np.issubdtype(values.dtype, np.integer):
        values = values.astype(np.min_scalar_type(min(int(values.max(initial=0)), 2 ** 32 - 1)))
    parts = ((labels, np.int32), (scales, np.float64), (lengths, np.int32), (places, np.int32), (values, values.dtype))
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x, t).tobytes()], pa.binary()) for x, t in parts],
                                      [c.split()[0] for c in BLOCK.split(", ")])


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows with sparse vectors ``features`` and ``label``."""
    for batch in batches:
        indices, values = (batch.column("features").field(c) for c in ("indices", "values"))
        yield block(batch.column("label").fill_null(-1).to_numpy(), np.ones(len(batch)), indices.value_lengths().fill_null(0).to_numpy(zero_copy_only=False),
                    indices.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False))


def dampened(counts: np.ndarray) -> np.ndarray:
    """Counts by their logarithm: 1 for one, and 1 more for e times as many."""
    if counts.dtype == np.uint8:
        return (1.0 + np.log(np.maximum(np.arange(256), 1)))[counts]
    return 1.0 + np.log(counts, dtype=np.float64)


class Entries:
    """The entries of some rows, one row after the other, with products in both directions; the last place is the constant
    feature. Both go over a run of whole rows at a time, whose entries stay in the processor's cache."""

    def __init__(self, scales: np.ndarray, lengths: np.ndarray, places: np.ndarray, values: np.ndarray, size: int):
        self.scales, self.lengths, self.places, self.size = scales, lengths, places.astype(np.intp, copy=False), size
        self.values = values if values.dtype == np.float64 else dampened(values)
        self.ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        self.filled = np.flatnonzero(lengths)
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(self.ends[1:] // AT_ONCE)) + 1, [len(lengths)]])).tolist()
        self.runs = [(first, last, slice(self.ends[first], self.ends[last])) for first, last in zip(cuts, cuts[1:])]
        self.products = np.empty(len(values))

    @classmethod
    def of_block(cls, scales: bytes, lengths: bytes, places: bytes, values: bytes, size: int) -> "Entries":
        places = np.frombuffer(places, np.int32)
        kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}.get(len(values) // max(len(places), 1), np.float64)
        return cls(np.frombuffer(scales), np.frombuffer(lengths, np.int32), places, np.frombuffer(values, kind), size)

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.full(len(self.lengths), w[self.size])
        for _, _, part in self.runs:
            products = self.products[part]
            np.take(w, self.places[part], out=products, mode="clip")
            products *= self.values[part]
        if len(self.filled):
            out[self.filled] += self.scales[self.filled] * np.add.reduceat(self.products, self.ends[self.filled])
        return out

    def back(self, coefficients: np.ndarray) -> np.ndarray:
        scaled = coefficients * self.scales
        for first, last, part in self.runs:
            np.multiply(np.repeat(scaled[first:last], self.lengths[first:last]), self.values[part], out=self.products[part])
        out = np.bincount(self.places, self.products, self.size + 1).astype(np.float64, copy=False)  # whole numbers, if empty
        out[self.size] += coefficients.sum()
        return out


# weights, whose loss and gradient are asked for; or a vector for a product, with the rows that count for it
Question = tuple[np.ndarray, dict[int, bytes] | None]
Answer = tuple[float, np.ndarray, dict[int, bytes]]


def answers(blocks: RDD, size: int, c: float, columns: np.ndarray, questions: dict[int, Question]) -> dict[int, Answer]:
    """``columns`` are factors of the places, which are applied here and not by the tasks. For each class with a question, the sums over all rows of the blocks: (loss, gradient, rows short of the margin), or
    (0, product, nothing). The rows come as one bit each, by partition, so that a product needs no margins again."""
    shared = blocks.context.broadcast({label: (vector * columns, live) for label, (vector, live) in questions.items()})
    asked = sorted(questions)

    def run(part: int, found: Iterator[tuple]) -> Iterator[tuple[int, tuple[np.ndarray, dict]]]:
        total, live, first = np.zeros((len(asked), size + 2)), [[] for _ in asked], 0
        known = [None if bits is None else np.unpackbits(np.frombuffer(bits[part], np.uint8)).view(bool) for _, bits in map(shared.value.get, asked)]
        for labels, *parts in found:
            labels, entries = np.frombuffer(labels, np.int32), Entries.of_block(*parts, size)
            for k, label in enumerate(asked):
                vector = shared.value[label][0]
                if known[k] is None:
                    y = np.where(labels == label, 1.0, -1.0)
                    short = np.maximum(1 - y * entries.times(vector), 0)
                    total[k, -1] += c * (short * short).sum()
                    total[k, :-1] += entries.back(-2 * c * short * y)
                    live[k].append(short > 0)
                else:
                    total[k, :-1] += entries.back(np.where(known[k][first:first + len(labels)], 2 * c * entries.times(vector), 0))
            first += len(labels)
        bits = {label: np.packbits(np.concatenate([np.zeros(0, bool), *live[k]])).tobytes() for k, label in enumerate(asked) if known[k] is None}
        yield part, (total, {part: bits})

    found, width = blocks.mapPartitionsWithIndex(run), blocks.getNumPartitions()
    while width > FAN:
        width = -(-width // FAN)
        found = found.map(lambda pair: (pair[0] // FAN, pair[1])).groupByKey(width).mapValues(added)
    whole, bits = added([sums for _, sums in sorted(found.collect(), key=lambda pair: pair[0])])
    shared.destroy()
    return {label: (float(whole[k, -1]), whole[k, :-1] * columns, {part: of[label] for part, of in bits.items() if label in of}) for k, label in enumerate(asked)}


def added(parts: Iterable[tuple[np.ndarray, dict]]) -> tuple[np.ndarray, dict]:
    parts = list(parts)
    return sum(total for total, _ in parts), {part: of for _, bits in parts for part, of in bits.items()}


def eased(rest: np.ndarray, products: list[tuple[np.ndarray, np.ndarray, float]], least: float) -> np.ndarray:
    """About what the matrix turns into ``rest``, by the limited-memory rule over vectors, their products with a matrix that
    stood near, and the products of both: so the last step's products spare this one some of its own."""
    out, shares = rest.copy(), []
    for vector, product, curve in reversed(products):
        shares.append(float(vector @ out) / curve)
        out -= shares[-1] * product
    out /= least
    for (vector, product, curve), share in zip(products, reversed(shares)):
        out += (share - float(product @ out) / curve) * vector
    return out


def newton(size: int, tolerance: float) -> Generator[Question, Answer, tuple[np.ndarray, float]]:
    """The method for one class: asks questions, gets sums over rows, and returns the weights and how far the gradient fell."""
    w = np.zeros(size + 1)
    loss, gradient, live = yield w, None
    start = radius = float(np.linalg.norm(gradient))
    if not start:
        return w, 0.0
    products, least = [], 1.0
    for _ in range(MAX_STEPS):
        length = float(np.linalg.norm(gradient))
        if length <= tolerance * start:
            break
        # the step: conjugate gradients on the second-order model, up to the border of the region, and no closer than it takes to end
        step, rest, at_border = np.zeros_like(w), -gradient, False
        direction, asked = eased(rest, products, least), deque(maxlen=KEPT)
        square, enough = float(rest @ direction), max(min(0.1, np.sqrt(length / start)) * length, 0.8 * tolerance * start)
        for _ in range(MAX_PRODUCTS):
            if np.linalg.norm(rest) <= enough:
                break
            product = direction + (yield direction, live)[1]
            curve = float(direction @ product)
            asked.append((direction, product, curve))
            along = square / curve
            if np.linalg.norm(step + along * direction) > radius:
                a, b, c = float(direction @ direction), float(step @ direction), float(step @ step) - radius * radius
                along, at_border = (np.sqrt(b * b - a * c) - b) / a, True
            step, rest = step + along * direction, rest - along * product
            if at_border:
                break
            nearer = eased(rest, products, least)
            new = float(rest @ nearer)
            direction, square = nearer + new / square * direction, new
        products = list(asked)
        least = min((curve / float(vector @ vector) for vector, _, curve in products), default=1.0)
        hoped = -0.5 * float(gradient @ step - step @ rest)
        new_loss, new_gradient, new_live = yield w + step, None
        new_loss, new_gradient = new_loss + 0.5 * float((w + step) @ (w + step)), new_gradient + w + step
        gained = loss - new_loss
        size_of_step = float(np.linalg.norm(step))
        if gained > 1e-4 * hoped:
            w, loss, gradient, live = w + step, new_loss, new_gradient, new_live
        if gained < 0.25 * hoped:
            radius = 0.25 * size_of_step
        elif gained > 0.75 * hoped and at_border:
            radius *= 2
        if hoped <= 1e-15 * abs(loss):      # nothing left but rounding
            break
    return w, float(np.linalg.norm(gradient)) / start


def fit(rows: DataFrame, size: int, classes: int, c: float = 1.0, tolerance: float = TOLERANCE,
        columns: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights (one row per class, the offset last) and the gradient's length at the solution by that at the start.

    ``rows`` are blocks, or have ``features``, sparse vectors of ``size`` places, and ``label``, 0 to ``classes`` - 1. An entry
    is its value times the factor of its row and, if there are ``columns``, that of its place. They are
    read once per question, as blocks kept in memory, by one task per core, dealt evenly: a task answers with dense vectors, so
    what a question moves depends on the cores and not on the rows, but for a bit per row and class."""
    columns = np.ones(size + 1) if columns is None else np.append(columns, 1.0)
    width = rows.sparkSession.sparkContext.defaultParallelism
    blocks = cut_lineage((rows if "places" in rows.columns else rows.mapInArrow(pack, BLOCK)).repartition(width)).rdd
    blocks = blocks.map(lambda row: tuple(bytes(x) for x in row)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        runs = {label: newton(size, tolerance) for label in range(classes)}
        waiting = {label: next(run) for label, run in runs.items()}
        weights, fallen = np.zeros((classes, size + 1)), np.zeros(classes)
        while waiting:
            for label, answer in answers(blocks, size, c, columns, waiting).items():
                try:
                    waiting[label] = runs[label].send(answer)
                except StopIteration as done:
                    weights[label], fallen[label] = done.value
                    del waiting[label]
    finally:
        blocks.unpersist()
    return weights, fallen
