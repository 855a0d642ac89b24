"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows whose label says good; unlabelled are rows of the web corpus, whatever their label. A small
network g is fitted to minimise the non-negative unbiased risk

    p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)])

with the logistic loss l and the class prior p, by mini-batches in a fixed order. Where the estimate in the brackets of
a batch falls below zero, its gradient is turned round (the usual correction against overfitting). The prior is
always estimated from positives and unlabelled rows alone: classifiers tell positives from unlabelled rows, and among the
rows they score highest, which are nearly all positives, the share of the unlabelled by the share of the positives is the
prior; each scores the half of the sample that it has not seen. The share of good rows among the labelled ones is kept next
to it for comparison (``Model.labelled``), and used for nothing. The score is the logistic of g, between 0 and 1, so that a
score is an estimate of the chance of label 1. It is summed feature by feature in a fixed order, so that it does not depend
on the texts around it.

Features come from whole texts: shares of symbols, capitals, digits, blanks and separators, lengths of words and
lines, repeated words, neighbours and lines, and the share of words by shape (upper case, with which sign behind it).
They do not depend on label, language, source or id.

Fitting is bounded: about ``POSITIVES`` positive and ``UNLABELLED`` unlabelled rows, chosen by a hash of id and text
(equal rows once, so that the bounds hold for any key), whose few dozen features come to the driver.

Results on edges: null texts count as empty; an empty text has the score of its features (all zero and "empty" one).
Without any positive row, or any unlabelled one, every score is the smoothed share of good labels (0.5 without labels).
Labels of repeated ids count once (the larger one), labels that are null are no labels. Repeated rows score alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, StructField

from forumlens.llm.common import BOOK, append_from_texts, col, hash_sample, id_fold, is_sampled, table
from forumlens.session import small_side

POSITIVES = 15_000
UNLABELLED = 15_000
THRESHOLD = 0.7
HIDDEN = 24
EPOCHS = 60
BATCH = 512
RATE = 0.01
DECAY = 1e-4

SIGNS = "!?.,;:#*$%&|<>-_=+/\\\"'()[]{}@~^`"      # one feature each, as a share of the characters
_SPACES = re.compile(r"[ \t]{2,}")


def features(text: str | None) -> list[float]:
    """Numbers that describe a whole text."""
    text = text or ""
    n = len(text)
    words = text.split()
    w = len(words)
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x]
    if not n or not w:
        return [0.0] * (len(SIGNS) + 21) + [1.0]
    counts = Counter(words)
    distinct = len(counts)
    # the expected number of distinct words grows slower than the words, hence the logarithms
    spread = math.log(1 + distinct) / math.log(1 + w)
    pairs = Counter(zip(words, words[1:]))
    same = sum(c for (a, b), c in pairs.items() if a == b) / w
    pair_repeat = 1 - len(pairs) / max(1, w - 1)
    top = max(counts.values()) / w
    letters = sum(map(str.isalpha, words))
    upper = sum(map(str.isupper, words))
    titled = sum(map(str.istitle, words))
    chars = n - text.count(" ") - text.count("\n")
    digits = sum(map(text.count, "0123456789"))
    lengths = np.fromiter(map(len, words), np.float64, w)
    line_counts = Counter(lines)
    repeated_lines = 1 - len(line_counts) / max(1, len(lines))
    stops = sum(text.count(x) for x in (". ", ".\n", "! ", "? ")) + (text[-1] in ".!?")
    return ([text.count(s) / n for s in SIGNS]
            + [math.log1p(w) / 10, math.log1p(n) / 12, spread, same, pair_repeat, top, letters / w, upper / w, titled / w,
               digits / n, float(lengths.mean()) / 10, float(lengths.std()) / 10, min(float(lengths.max()), 200) / 40,
               math.log1p(len(lines)) / 8, repeated_lines, min(w / max(1, len(lines)), 200) / 100, len(_SPACES.findall(text)) / n,
               min(stops / w, 1.0), (n - chars) / n, float(len(lines) > 0 and text.count("\t") / n), distinct / w, 0.0])


SIZE = len(features("one text"))


class Model(NamedTuple):
    """Standardised features to a score; ``layers`` is empty for a constant score."""
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple
    prior: float
    labelled: float


def _one_by_one(x: np.ndarray, layers) -> np.ndarray:
    """The output for every row, added up in one order whatever the number of rows (a matrix product may change it)."""
    w1, b1, w2, b2 = layers
    inner = np.tile(b1, (len(x), 1))
    for j in range(x.shape[1]):
        inner += x[:, j:j + 1] * w1[j]
    hidden, out = np.tanh(inner), np.full(len(x), b2[0])
    for j in range(hidden.shape[1]):
        out += hidden[:, j] * w2[j]
    return out


def _forward(x: np.ndarray, layers) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    return hidden, hidden @ w2 + b2[0]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, hidden: int = HIDDEN, epochs: int = EPOCHS,
          batch: int = BATCH, rate: float = RATE, decay: float = DECAY, seed: int = 7) -> tuple:
    """Layers that minimise the non-negative unbiased risk, by Adam over mini-batches in a seeded order.

    Without a prior the loss is the plain one of telling positive from unlabelled rows."""
    generator = np.random.default_rng(seed)
    width = positive.shape[1]
    layers = [generator.normal(0, 1 / math.sqrt(width), (width, hidden)), np.zeros(hidden),
              generator.normal(0, 1 / math.sqrt(hidden), hidden), np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in layers]
    batch = min(batch, len(positive), len(unlabelled))
    rounds = max(1, min(len(positive), len(unlabelled)) // batch)
    step = 0
    for epoch in range(epochs):
        order_p, order_u = generator.permutation(len(positive)), generator.permutation(len(unlabelled))
        for i in range(rounds):
            p, u = positive[order_p[i::rounds]], unlabelled[order_u[i::rounds]]
            hidden_p, out_p = _forward(p, layers)
            hidden_u, out_u = _forward(u, layers)
            soft = np.logaddexp
            up, uu = _sigmoid(out_p), _sigmoid(out_u)
            if prior is None:
                slope_p, slope_u = (up - 1) / len(p), uu / len(u)
            elif soft(0, out_u).mean() >= prior * soft(0, out_p).mean():     # l(-g) = log(1 + exp(g))
                slope_p = prior * (up - 1) / len(p) - prior * up / len(p)
                slope_u = uu / len(u)
            else:
                slope_p, slope_u = prior * up / len(p), -uu / len(u)
            gradient = [0.0] * 4
            for x, h, slope in ((p, hidden_p, slope_p), (u, hidden_u, slope_u)):
                inner = slope[:, None] * layers[2] * (1 - h * h)
                gradient = [g + d for g, d in zip(gradient, (x.T @ inner, inner.sum(0), h.T @ slope, np.array([slope.sum()])))]
            step += 1
            now = rate * (0.5 * (1 + math.cos(math.pi * epoch / epochs)))
            for k, (layer, g, (m, v)) in enumerate(zip(layers, gradient, moments)):
                g = g + (decay * layer if k in (0, 2) else 0)
                m[:] = 0.9 * m + 0.1 * g
                v[:] = 0.999 * v + 0.001 * g * g
                layer -= now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return tuple(layers)


def smallest_ratio(positive: np.ndarray, unlabelled: np.ndarray, chance: float = 0.1) -> float:
    """The least share of unlabelled scores above a cut, by the share of positive scores above it.

    Where scores are high, unlabelled rows are nearly all positives, and the ratio is the class prior. Cuts with few rows
    above are noisy, so the one with the least upper confidence bound of the ratio is taken."""
    cuts = np.unique(positive)
    above_p, above_u = (1 - np.searchsorted(np.sort(x), cuts, "left") / len(x) for x in (positive, unlabelled))
    slack = sum(math.sqrt(math.log(4 / chance) / 2 / len(x)) for x in (positive, unlabelled))
    at = ((above_u + slack) / above_p).argmin()
    return float(above_u[at] / above_p[at])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = 2, epochs: int = 12) -> float:
    """Share of positives among unlabelled rows: classifiers of positives against unlabelled rows score the fold that they
    have not seen, and the scores of both kinds are compared (``smallest_ratio``); the mean over the folds."""
    found = []
    for fold in range(folds):
        held_p, held_u = (np.arange(len(x)) % folds == fold for x in (positive, unlabelled))
        if not (held_p.any() and held_u.any()) or held_p.all() or held_u.all():
            return 0.5
        layers = train(positive[~held_p], unlabelled[~held_u], None, epochs=epochs)
        found.append(smallest_ratio(*(_forward(x, layers)[1] for x in (positive[held_p], unlabelled[held_u]))))
    return float(np.clip(np.mean(found), 0.02, 0.98))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
        positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learn from the labels given; ``docs`` are the unlabelled corpus, which includes the labelled rows."""
    known = (labels.filter(col(label).isNotNull() & col(key).isNotNull()).groupBy(col(key).alias("__key"))
             .agg(F.max(col(label)).alias("__label")))
    good, all_ = known.select(F.coalesce(F.sum(F.when(F.col("__label") == 1, 1)), F.lit(0)), F.count(F.lit(1))).first()
    trusted = hash_sample(known.filter("__label = 1"), "__key", positives, good, salt=1).select("__key", F.lit(True).alias("__good"))
    chosen = small_side(trusted)
    narrow = docs.select(col(key).alias("__key"))
    rows = narrow.select(F.count(F.lit(1))).first()[0]
    good_rows = narrow.join(chosen, "__key", "left_semi").select(F.count(F.lit(1))).first()[0]  # an id may stand on many rows
    # both samples in one pass over the texts: the trusted ids are few and joined from memory
    parts = ["__key", "__content"]
    sample = (docs.select(col(key).alias("__key"), col(text).cast("string").alias("__content")).join(chosen, "__key", "left")
              .withColumns({"__good": F.col("__good").isNotNull() & is_sampled(parts, positives, good_rows, salt=1),
                            "__web": is_sampled(parts, unlabelled, rows, salt=2)})
              .filter("__good OR __web").withColumn("__mark", F.xxhash64(F.lit(5), *parts)))
    vectors = append_from_texts(sample, "__content", [StructField("vector", ArrayType(FloatType()))],
                                lambda texts: [[features(t) for t in texts]], ["__key", "__mark", "__good", "__web"])
    found = vectors.dropDuplicates(["__key", "__mark"]).orderBy("__key", "__mark").toArrow()
    matrix = np.array(found.column("vector").to_pylist(), np.float64).reshape(-1, SIZE)
    is_good, is_web = (found.column(c).to_numpy().astype(bool) for c in ("__good", "__web"))
    share = float((good + 1) / (all_ + 2)) if all_ else 0.5
    if not is_good.any() or not is_web.any():
        return Model(np.zeros(SIZE), np.ones(SIZE), (), share, share)
    mean, scale = matrix.mean(axis=0), matrix.std(axis=0) + 1e-3
    scaled = np.clip((matrix - mean) / scale, -8, 8)
    prior = estimate_prior(scaled[is_good], scaled[is_web])
    return Model(mean, scale, train(scaled[is_good], scaled[is_web], prior), prior, share)


def scores(texts: list[str | None], model: Model) -> np.ndarray:
    if not model.layers:
        return np.full(len(texts), model.prior)
    if not texts:
        return np.zeros(0)
    scaled = np.clip((np.array([features(t) for t in texts]) - model.mean) / model.scale, -8, 8)
    return _sigmoid(_one_by_one(scaled, model.layers))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD,
          keep: list[str] | None = None) -> DataFrame:
    """Append score and prediction of every text. The model, a few kB, goes along with the tasks; no shuffle."""
    fields = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]

    def compute(texts):
        found = scores(texts, model)
        return [found.tolist(), (found >= threshold).astype(int).tolist()]

    return append_from_texts(docs, text, fields, compute, keep)


def good_rows(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with their own columns."""
    marked = append_from_texts(docs, text, [StructField("__good", BooleanType())],
                               lambda texts: [(scores(texts, model) >= threshold).tolist()])
    return marked.filter("__good").drop("__good")


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The production model: labels and corpus outside fold 2 of 4."""
    inside = id_fold("doc_id", 4) != 2
    return fit(docs.filter(inside), labels.filter(inside))


@BOOK.add("op8_positive_unlabelled_quality")
def positive_unlabelled_quality(spark, sf_dir):
    """Quality of every document, learned from labels outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    docs = docs.select("doc_id", (id_fold("doc_id", 4) == 2).alias("held_out"), "text")
    return score(docs, model, keep=["doc_id", "held_out"])
