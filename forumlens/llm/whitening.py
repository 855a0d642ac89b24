"""Whitening of embeddings by their principal components, refined from float32 eigenvectors.

Every component c counts as the whole number x = floor(1024 c) + 100000. Two passes over the vectors give the covariance V: the
first sums x exactly; the second subtracts the whole number next to the mean and adds up products of what is left, so that
they are centred before they are multiplied and, as whole numbers below 2^53, do not depend on the order in which tasks are
added up. Each task sends one matrix of sums, whatever its rows; Spark adds them up, and the driver gets one matrix.

The eigenvectors of V are found in float32 and corrected by Ogita-Aishima iterations, which only multiply matrices, here
in extended precision: with R = I - X'X and S = X'VX, eigenvalues are S_ii / (1 - R_ii), and X becomes X + XE with
E_ij = (S_ij + l_j R_ij) / (l_j - l_i), each step squaring the error. Where eigenvalues are nearer to each other than the error
of their estimates, that quotient says nothing: E_ij is then R_ij / 2, which keeps the columns orthogonal, and each run of
such columns (a cluster) gets a sub-solve, the eigenvectors of its own small matrix, shifted by its mean so that digits that
the eigenvalues share do not count. Eigenvalues within ``CLOSE`` of each other are always solved that way, as a division by
their difference would magnify rounding. Iterations end when corrections no longer shrink.

Components are numbered by falling eigenvalue; the sign makes the largest entry positive. A third pass measures the
covariance of the whitened vectors, a last one writes them. All passes read the vector column only and are narrow.

Results on edges: rows without a vector, or with a component that is null, not finite or too large for a long, are
dropped. Vectors of each length are a fit list of their own (n, sums, components). A component without variance, as in a table
of equal rows, has whitened 0 and explained 0, and does not count in ``identity_error`` (the largest over all lengths). A deviation
beyond a long is null. Repeated rows stay and are whitened alike; a null id stays. An empty table gives an empty table.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.llm.common import BOOK, col, table
from forumlens.llm.vectors import as_list, by_length, scaled, usable

SHIFT = 100_000
COMPONENTS = 8
EXACT = float(1 << 53)
MAX_STEPS = 30
CLOSE = 1e-8             # of the norm of the matrix
MAX_LENGTH = 8192        # the matrix of one length goes to the driver
_END = (1 << 63) - 1


# --- eigenvectors -----------------------------------------------------------------------------------------
def clusters_of(values: np.ndarray, gap: float) -> list[tuple[int, int]]:
    """Runs of two and more neighbouring values (which fall) that are at most ``gap`` apart."""
    close = np.r_[False, values[:-1] - values[1:] <= gap, False]
    edges = np.flatnonzero(close[1:] != close[:-1])
    return [(int(a), int(b) + 1) for a, b in zip(edges[::2], edges[1::2])]


def refine(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One Ogita-Aishima step: eigenvalues, corrected vectors, the largest correction, and how far apart eigenvalues
    have to be for a correction by their difference."""
    product = matrix @ vectors
    off = np.eye(len(matrix), dtype=matrix.dtype) - vectors.T @ vectors
    inner = vectors.T @ product
    values = np.diag(inner) / (1 - np.diag(off))
    error = inner - np.diag(values)
    size = lambda m: float(np.sqrt((m * m).sum()))
    gap = max(2 * (size(error) + size(matrix) * size(off)), CLOSE * size(matrix))
    apart = values[None, :] - values[:, None]
    clear = np.abs(apart) > gap
    step = np.where(clear, (inner + values[None, :] * off) / np.where(clear, apart, 1), off / 2)
    order = np.argsort(-values, kind="stable")
    return values[order], (vectors + vectors @ step)[:, order], float(np.abs(step).max(initial=0)), gap


def solve_clusters(matrix: np.ndarray, vectors: np.ndarray, values: np.ndarray, gap: float) -> np.ndarray:
    """Turn the columns of each cluster into the eigenvectors of its own small matrix."""
    out = vectors.copy()
    for first, last in clusters_of(values, gap):
        part = vectors[:, first:last]
        middle = values[first:last].mean()
        small = part.T @ (matrix @ part - middle * part)
        small = (small + small.T) / 2
        scale = np.abs(small).max()
        if scale > 0:
            turn = np.linalg.eigh((small / scale).astype(np.float64))[1][:, ::-1]
            out[:, first:last] = part @ turn.astype(matrix.dtype)
    return out


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix, to double precision."""
    wide = np.asarray(matrix, np.longdouble)
    scale = np.abs(wide).max(initial=0)
    n = len(wide)
    if not scale > 0:
        return np.zeros(n), np.eye(n)
    wide = wide / scale
    vectors = np.linalg.eigh(wide.astype(np.float32))[1][:, ::-1].astype(np.longdouble)
    last = np.inf
    for _ in range(MAX_STEPS):
        values, vectors, step, gap = refine(wide, vectors)
        vectors = solve_clusters(wide, vectors, values, gap)
        if step >= last / 2:      # no longer converging: nothing but rounding is left
            break
        last = step
    for _ in range(2):            # the step for columns that cannot be told apart, on all: orthogonal to the last digit
        vectors = vectors + vectors @ (np.eye(n, dtype=wide.dtype) - vectors.T @ vectors) / 2
    vectors /= np.sqrt((vectors * vectors).sum(axis=0))
    values = np.maximum((vectors * (wide @ vectors)).sum(axis=0), 0)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)])
    return (values * scale).astype(np.float64), vectors.astype(np.float64)


# --- sums over the table ------------------------------------------------------------------------------------
class Sums(NamedTuple):
    """Rows, exact sums of x and the whole numbers next to the means, of one length."""
    n: int
    totals: list[int]
    centre: np.ndarray


class Model(NamedTuple):
    """The sums of a length, its first components as columns, and their eigenvalues and shares."""
    sums: Sums
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def _whole_sums(x: np.ndarray) -> list[int]:
    """Column sums as Python numbers, exact."""
    if float(np.abs(x).max(initial=0)) * max(len(x), 1) < EXACT:
        return [int(v) for v in x.sum(axis=0)]
    return [sum(map(int, column)) for column in x.T.tolist()]


def sums_of(rows: DataFrame) -> dict[int, Sums]:
    """Sums of x for each length, from one row per task and component; one row per component reaches the driver."""
    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for length, at, values in by_length(batch.column(0)):
                one = found.setdefault(length, [0, [0] * min(length, MAX_LENGTH)])
                one[0] += len(at)
                if length <= MAX_LENGTH:
                    one[1] = [a + b for a, b in zip(one[1], _whole_sums(scaled(values)))]
        flat = [(length, i, n, str(v)) for length, (n, totals) in found.items() for i, v in enumerate(totals)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], kind) for i, kind in enumerate(
            (pa.int32(), pa.int32(), pa.int64(), pa.string()))], ["length", "i", "n", "total"])

    added = (rows.mapInArrow(run, "length int, i int, n long, total string").groupBy("length", "i")
             .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for r in added:
        found.setdefault(r.length, {})[r.i] = (r.n, int(r.total))
    if found and max(found) > MAX_LENGTH:
        raise ValueError(f"vectors of {max(found)} components: their covariance is too large for one matrix")
    out = {}
    for length, columns in sorted(found.items()):
        n, totals = columns[0][0], [columns[i][1] for i in range(length)]
        out[length] = Sums(n, [t + SHIFT * n for t in totals], np.array([round(t / n) for t in totals], np.float64))
    return out


def covariances(rows: DataFrame, sums: dict[int, Sums]) -> dict[int, np.ndarray]:
    """V of each length: sums of products of centred whole numbers, from one matrix per task."""
    def run(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, _, values in by_length(batch.column(0)):
                if length:
                    x = scaled(values) - sums[length].centre
                    found[length] = found.get(length, 0) + x.T @ x
        for length, products in found.items():
            i, j = np.triu_indices(length)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), length, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                              pa.array(products[i, j])], ["length", "i", "j", "total"])

    added = (rows.mapInArrow(run, "length int, i int, j int, total double").groupBy("length", "i", "j")
             .agg(F.sum("total").alias("total")).toArrow())
    of, i, j, total = (added.column(c).to_numpy() for c in ("length", "i", "j", "total"))
    out = {}
    for length, s in sums.items():
        at = of == length
        products = np.zeros((length, length), np.longdouble)
        products[i[at], j[at]] = products[j[at], i[at]] = total[at]
        rest = rest_of_mean(s)
        out[length] = products / s.n - np.outer(rest, rest)
    return out


def rest_of_mean(s: Sums) -> np.ndarray:
    """Mean of x minus its whole part, which is exact before the division."""
    return np.array([(t - (int(c) + SHIFT) * s.n) / np.longdouble(s.n) for t, c in zip(s.totals, s.centre.tolist())], np.longdouble)


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> dict[int, Model]:
    """The model of every length of vectors."""
    rows = usable(df, vector).select(as_list(df, vector).alias("vector"))
    sums = sums_of(rows)
    out = {}
    for length, v in covariances(rows, sums).items():
        values, vectors = eigen(v)
        trace = float(np.trace(v))
        values[values <= trace * length * np.finfo(np.float64).eps] = 0        # nothing but rounding
        first = slice(0, min(components, length))
        out[length] = Model(sums[length], vectors[:, first], values[first], values[first] / trace if trace > 0 else np.zeros(len(values[first])))
    return out


# --- whitened rows ------------------------------------------------------------------------------------------
def whitened(values: np.ndarray, model: Model) -> np.ndarray:
    """Whitened components of vectors; each row is added up by itself, so it does not depend on the others."""
    centred = scaled(values) - model.sums.centre - rest_of_mean(model.sums).astype(np.float64)
    with np.errstate(divide="ignore"):
        weights = np.where(model.values > 0, model.components / np.sqrt(model.values), 0)
    return np.stack([np.ascontiguousarray(centred * w).sum(axis=1) for w in weights.T], axis=1)


def deviations(values: np.ndarray, s: Sums) -> list[int | None]:
    """Sum of (n x - S)^2 over the components, exact."""
    x = scaled(values) - s.centre
    rest = [t - (int(c) + SHIFT) * s.n for t, c in zip(s.totals, s.centre.tolist())]
    reach = float(np.abs(x).max(initial=0)) * s.n + max(map(abs, rest), default=0)
    if reach * reach * max(len(rest), 1) < _END / 2:
        d = x.astype(np.int64) * s.n - np.array(rest, np.int64)
        return (d * d).sum(axis=1).tolist()
    found = [sum((int(a) * s.n - r) ** 2 for a, r in zip(row, rest)) for row in x.tolist()]
    return [d if d <= _END else None for d in found]


def identity_error(df: DataFrame, models: dict[int, Model], vector: str = "embedding") -> float:
    """Largest entry of the covariance of the whitened rows minus the identity, measured over the table."""
    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for length, _, values in by_length(batch.column(0)):
                if length:
                    w = whitened(values, models[length])
                    one = found.setdefault(length, [np.zeros(w.shape[1]), np.zeros((w.shape[1],) * 2)])
                    one[0] += w.sum(axis=0)
                    one[1] += w.T @ w           # w has mean zero, so this is centred
        flat = [(length, i, j, float(v)) for length, (total, products) in found.items()
                for i, row in enumerate(np.vstack([total, products]).tolist()) for j, v in enumerate(row)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], kind) for k, kind in enumerate(
            (pa.int32(), pa.int32(), pa.int32(), pa.float64()))], ["length", "i", "j", "total"])

    rows = usable(df, vector).select(as_list(df, vector).alias("vector"))
    added = (rows.mapInArrow(run, "length int, i int, j int, total double").groupBy("length", "i", "j")
             .agg(F.sum("total").alias("total")).collect())
    worst = 0.0
    for length, model in models.items():
        k, n = len(model.values), model.sums.n
        found = np.zeros((k + 1, k))
        for r in added:
            if r.length == length:
                found[r.i, r.j] = r.total / n
        live = model.values > 0
        off = found[1:] - np.outer(found[0], found[0]) - np.eye(k)
        worst = max(worst, float(np.abs(off[live][:, live]).max(initial=0)))
    return worst


def whiten(df: DataFrame, models: dict[int, Model], vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, component, n, deviation, whitened, explained) of every usable row. One narrow step."""
    rows = usable(df, vector).select(col(key), as_list(df, vector).alias("__vector"))
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for length, at, values in by_length(batch.column(1)):
                if not length:
                    continue
                m = models[length]
                w = whitened(values, m)
                k = w.shape[1]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(at) * k, m.sums.n, np.int64)), pa.array([d for d in deviations(values, m.sums) for _ in range(k)], pa.int64()),
                    pa.array(w.reshape(-1)), pa.array(np.tile(m.explained, len(at)))],
                    [key, "component", "n", "deviation", "whitened", "explained"])

    return rows.mapInArrow(run, f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double")


@BOOK.add("op11_refined_whitening")
def refined_whitening(spark, sf_dir):
    """The first eight whitened components of every vector."""
    vectors = table(spark, sf_dir, "embeddings")
    models = fit(vectors)
    return whiten(vectors, models).withColumn("identity_error", F.lit(identity_error(vectors, models)))
