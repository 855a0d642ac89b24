"""Folds and classifiers against step-by-step versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from forumlens.operators import newton
from forumlens.operators.classifiers import TextClassifier, occurrences
from forumlens.operators.folds import Balance, grouped_folds, signature_share


# --- folds ------------------------------------------------------------------------------------------------
def rank(key):
    return hashlib.sha256(f"42:{key}".encode()).hexdigest()[:16]


def brute_folds(rows, folds=10):
    """The greedy rule thread by thread: shares of the strata, their standard deviation over the folds, its mean."""
    strata = sorted({s for _, s in rows})
    threads = {}
    for t, s in rows:
        threads.setdefault(t, Counter())[s] += 1
    vectors = {t: np.array([c[s] for s in strata], float) for t, c in threads.items()}
    total = sum(vectors.values())

    def order(t):
        cells = sorted(threads[t].items())
        v = vectors[t]
        return (-(len(strata) * (v * v).sum() - v.sum() ** 2), rank(",".join(f"{s}:{n}" for s, n in cells)), cells, rank(t or ""), t or "")

    counts, out = np.zeros((folds, len(strata))), {}
    for t in sorted(threads, key=order):
        costs = []
        for i in range(folds):
            counts[i] += vectors[t]
            costs.append(np.std(counts / total, axis=0).mean())
            counts[i] -= vectors[t]
        near = [i for i in range(folds) if costs[i] <= min(costs) + 1e-12]
        out[t] = min(near, key=lambda i: (counts[i].sum(), i))
        counts[out[t]] += vectors[t]
    return out


def some_threads(seed, n=700):
    rng = random.Random(seed)
    rows = []
    for t in range(n):
        for _ in range(rng.choice([1, 1, 1, 1, 2, 2, 3, 5, 12])):
            rows.append((f"t{t}", rng.choice("aaaabbc") + "|" + rng.choice("xy")))
    return rows + [("hot", rng.choice("abc") + "|x") for _ in range(300)] + [(None, "a|x")] * 4


@pytest.mark.parametrize("seed, folds", [(1, 10), (2, 3), (3, 10)])
def test_folds_equal_the_greedy_rule_thread_by_thread(spark, seed, folds):
    rows = some_threads(seed)
    df = spark.createDataFrame([(t, *s.split("|")) for t, s in rows], "thread string, label string, place string")
    found = grouped_folds(df, "thread", ["label", "place"], folds).collect()
    assert len(found) == len(rows)
    expected = brute_folds(rows, folds)
    assert {r.thread: r.fold for r in found} == expected


def test_runs_of_equal_threads_go_round_in_a_cycle():
    rng = random.Random(5)
    totals = {"a": 3000, "b": 700, "c": 90}
    for _ in range(40):
        folds = rng.choice([2, 3, 10])
        runs = [(sorted((s, rng.randrange(1, 6)) for s in rng.sample("abc", rng.randrange(1, 4))), rng.choice([1, 2, 7, 40, 333])) for _ in range(8)]
        fast, slow = Balance(totals, folds), Balance(totals, folds)
        for counts, times in runs:
            first, cycle = fast.deal(counts, times)
            got = [first[i] if i < len(first) else cycle[(i - len(first)) % len(cycle)] for i in range(times)]
            expected = []
            for _ in range(times):
                expected.append(slow.best(counts))
                slow.add(counts, expected[-1])
            assert got == expected and fast.rows == slow.rows and fast.off == slow.off
    steps = []
    balance = Balance(totals, 10)
    real = balance.best
    balance.best = lambda c: steps.append(1) or real(c)
    balance.deal([("a", 1)], 10 ** 9)
    assert len(steps) == 10 and sum(balance.rows) == 10 ** 9


def test_signatures_are_fewer_than_threads(spark):
    df = spark.range(20_000).select((F.col("id") / 2).cast("int").cast("string").alias("thread"), F.pmod(F.hash("id"), F.lit(3)).cast("string").alias("label"))
    threads, distinct = signature_share(df, "thread", ["label"])
    assert (threads, distinct) == (10_000, 6)
    folds = grouped_folds(df, "thread", ["label"]).groupBy("fold", "label").count().collect()
    by = {}
    for r in folds:
        by.setdefault(r.label, []).append(r["count"])
    assert all(len(v) == 10 and max(v) - min(v) <= 0.02 * sum(v) / 10 for v in by.values())


# --- separators -------------------------------------------------------------------------------------------
def brute_weights(x, y, c):
    """The minimum by full Newton steps with halving, until the gradient is nothing but rounding."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    value = lambda v: 0.5 * v @ v + c * (np.maximum(1 - y * (x @ v), 0) ** 2).sum()
    for _ in range(200):
        short = np.maximum(1 - y * (x @ w), 0)
        gradient = w - 2 * c * x.T @ (y * short)
        if np.abs(gradient).max() < 1e-12:
            break
        live = x[short > 0]
        step, t = np.linalg.solve(np.eye(len(w)) + 2 * c * live.T @ live, -gradient), 1.0
        while value(w + t * step) > value(w) and t > 1e-12:
            t /= 2
        w = w + t * step
    return w


@pytest.mark.parametrize("c, parts", [(1.0, 1), (20.0, 7), (0.01, 40)])
def test_weights_equal_a_brute_force_solver(spark, c, parts):
    rng = np.random.default_rng(7)
    n, size = 240, 25
    x = rng.normal(size=(n, size)) * (rng.random((n, size)) < 0.2)
    x[5] = 0
    labels = np.argmax(x[:, :3] + rng.normal(scale=0.5, size=(n, 3)), axis=1)
    rows = [(Vectors.sparse(size, np.flatnonzero(v).tolist(), v[np.flatnonzero(v)].tolist()), int(k)) for v, k in zip(x, labels)]
    df = spark.createDataFrame(rows, ["features", "label"]).withColumn("label", F.col("label").cast("int")).repartition(parts)
    weights, fallen = newton.fit(df, size, 3, c, tolerance=1e-9)
    assert (fallen <= 1e-8).all()
    for k in range(3):
        assert np.abs(weights[k] - brute_weights(x, np.where(labels == k, 1, -1), c)).max() < 1e-6
    loose, fallen = newton.fit(df, size, 3, c)
    assert (fallen <= newton.TOLERANCE).all() and np.abs(loose - weights).max() < 1e-2


def test_vocabulary_breaks_ties_by_term(spark):
    texts = [("zeta alpha", "pro"), ("zeta alpha beta", "against"), ("alpha zeta beta beta", "neutral"), ("beta zeta alpha", "pro"), ("gamma", "pro"), (None, "pro")]
    df = spark.createDataFrame(texts, "text string, label string")
    spec = TextClassifier(max_features=4)
    terms = df.select(spec.terms("text").alias("terms"))
    counts = {r.term: (r.n, r["rows"]) for r in occurrences(terms).collect()}
    assert counts["beta"] == (4, 3) and counts["zeta alpha"] == (3, 3) and counts["beta beta"] == (1, 1)
    assert spec.vocabulary(terms, 6) == [("alpha", 4, 4), ("beta", 4, 3), ("zeta", 4, 4), ("zeta alpha", 3, 3)]
    fitted = spec.fit(df, "text", "label")
    assert fitted.rows == 6 and fitted.weights.shape == (3, 5) and (fitted.gradient <= 1e-5).all()
    assert fitted.predict(df, "text").count() == 6
    none = TextClassifier(kind="character").fit(df.limit(1), "text", "label")
    assert none.known == [] and {r.predicted for r in none.predict(df, "text").collect()} <= set(spec.classes)


def test_rows_without_entries_count_where_they_stand_alone(spark):
    x = np.array([[1.0, 0], [0.5, 2], [0, 1], [0, 0], [0, 0], [0, 0]])
    labels = [0, 1, 0, 1, 1, 0]
    rows = [(Vectors.sparse(2, np.flatnonzero(v).tolist(), v[np.flatnonzero(v)].tolist()), k) for v, k in zip(x, labels)]
    df = spark.createDataFrame(rows[:3], ["features", "label"]).coalesce(1).unionByName(spark.createDataFrame(rows[3:], ["features", "label"]).coalesce(1))
    weights, fallen = newton.fit(df, 2, 2, 0.3, tolerance=1e-9)
    assert (fallen <= 1e-8).all()
    for k in range(2):
        assert np.abs(weights[k] - brute_weights(x, np.where(np.array(labels) == k, 1, -1), 0.3)).max() < 1e-6


def test_a_question_is_answered_by_one_task_per_core_at_most(spark, monkeypatch):
    """What is moved for a question must not grow with the partitions of the rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5))
    labels = (x[:, 0] > 0).astype(int)
    df = spark.createDataFrame([(Vectors.sparse(5, range(5), v.tolist()), int(k)) for v, k in zip(x, labels)], ["features", "label"]).repartition(40)
    parts, real = [], newton.answers

    def answers(rows, *args):
        parts.append(getattr(rows, "rdd", rows).getNumPartitions())
        return real(rows, *args)

    monkeypatch.setattr(newton, "answers", answers)
    for fan in (16, 2):  # the last: sums in a tree
        monkeypatch.setattr(newton, "FAN", fan)
        weights, _ = newton.fit(df, 5, 2, tolerance=1e-9)
        assert np.abs(weights[1] - brute_weights(x, 2 * labels - 1, 1.0)).max() < 1e-6
    assert max(parts) <= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("kind", ["word", "character"])
@pytest.mark.parametrize("portion", [1, 40, 1 << 20])
def test_terms_counted_by_batches_equal_the_lists_of_terms(spark, monkeypatch, kind, portion):
    from forumlens.operators import ngrams
    texts = ["", None, "a", "ab ab ab", "Füße über füße über", "x y  zz\tzz zz", "\U0001f600\U0001f600 \U0001f600 ab", "ab_1 é́ ab", "?! ?!", "long" * 30 + " ab"] * 2
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    spec = TextClassifier(kind)
    lists = [r.t for r in df.select(spec.terms("text").alias("t")).collect()]
    n, rows = Counter(t for terms in lists for t in terms), Counter(t for terms in lists for t in set(terms))
    import pyarrow as pa
    monkeypatch.setattr(ngrams, "PORTION", portion)
    words = pa.array([r.t for r in df.select(spec.words("text").alias("t")).collect()], pa.list_(pa.string()))
    got, covered = {}, 0
    for start, part in ngrams.portions(words):
        assert start == covered
        covered += len(part)
        names, row, ids, counts = ngrams.counted(part, kind)
        for r, i, c in zip(row.tolist(), ids.tolist(), counts.tolist()):
            got[start + r, names[i].as_py()] = c
    assert covered == len(texts)
    assert got == {(i, t): c for i, terms in enumerate(lists) for t, c in Counter(terms).items()}
    found = occurrences(df.select(spec.words("text").alias("terms")), kind).collect()
    assert {r.term: (r.n, r["rows"]) for r in found} == {t: (n[t], rows[t]) for t in n}


def small_problem():
    """Correlated columns of very different weight, whose second-order models are far from round."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 40)) @ np.diag(np.geomspace(1, 0.01, 40)) + 3 * rng.random((300, 1)) * rng.random(40)
    return x, (x[:, 0] + rng.normal(size=300) > 0).astype(int)


def test_a_product_asks_for_one_pass_over_the_entries(monkeypatch):
    """Margins are needed once per weights: a product takes the rows that are short of it as they were answered."""
    x, labels = small_problem()
    rows = (labels.astype(np.int32).tobytes(), np.ones(300).tobytes(), np.full(300, 40, np.int32).tobytes(), np.tile(np.arange(40, dtype=np.int32), 300).tobytes(), x.tobytes())

    class Blocks:  # one partition, read where the test runs
        def __init__(self, found=None):
            self.found, self.context = found, self
        def broadcast(self, value):
            return type("Shared", (), {"value": value, "destroy": lambda self: None})()
        def mapPartitionsWithIndex(self, run):
            return Blocks(list(run(0, iter([rows]))))
        def getNumPartitions(self):
            return 1
        def collect(self):
            return self.found

    passes, real = [], newton.Entries.times
    monkeypatch.setattr(newton.Entries, "times", lambda self, w: passes.append(1) or real(self, w))
    ones, w, v = np.ones(41), np.full(41, 0.1), np.linspace(-1, 1, 41)
    loss, gradient, short = newton.answers(Blocks(), 40, 2.0, ones, {1: (w, None)})[1]
    product = newton.answers(Blocks(), 40, 2.0, ones, {1: (v, short)})[1][1]
    assert len(passes) == 2
    wide, y = np.column_stack([x, np.ones(300)]), 2 * labels - 1
    margin = np.maximum(1 - y * (wide @ w), 0)
    assert np.allclose(loss, 2 * (margin ** 2).sum()) and np.allclose(gradient, -4 * wide.T @ (y * margin))
    assert np.allclose(product, 4 * wide.T @ ((margin > 0) * (wide @ v)))


def test_products_of_a_step_spare_some_of_the_next(spark, monkeypatch):
    x, labels = small_problem()
    df = spark.createDataFrame([(Vectors.dense(v.tolist()).toArray().tolist(), int(k)) for v, k in zip(x, labels)], "v array<double>, label int")
    df = spark.createDataFrame(df.rdd.map(lambda r: (Vectors.sparse(40, range(40), r.v), r.label)), ["features", "label"]).withColumn("label", F.col("label").cast("int"))
    asked, real = [], newton.answers
    monkeypatch.setattr(newton, "answers", lambda *a: asked.append(len(a[-1])) or real(*a))
    weights, fallen = newton.fit(df.coalesce(3), 40, 2, 5.0, tolerance=1e-9)
    eased = sum(asked)
    assert (fallen <= 1e-9).all() and np.abs(weights[1] - brute_weights(x, 2 * labels - 1, 5.0)).max() < 1e-6
    asked.clear()
    monkeypatch.setattr(newton, "KEPT", 0)
    monkeypatch.setattr(newton, "eased", lambda rest, *_: rest.copy())
    plain, _ = newton.fit(df.coalesce(3), 40, 2, 5.0, tolerance=1e-9)
    assert np.abs(weights - plain).max() < 1e-6 and eased < 0.8 * sum(asked)


def test_counts_take_few_bytes_and_come_back_dampened():
    for n, kind in (([1, 2, 255], 1), ([1, 256, 3], 2), ([70_000, 1, 2], 4), ([], 1)):
        n = np.array(n, np.int64)
        labels, scales, lengths, places, values = (c[0].as_py() for c in newton.block(np.zeros(2), np.array([0.5, 2]), np.array([len(n), 0]), np.arange(len(n)), n).columns)
        assert len(values) == kind * len(n)
        entries = newton.Entries.of_block(scales, lengths, places, values, 3)
        assert np.allclose(entries.values, 1 + np.log(n)) and np.allclose(entries.times(np.array([1.0, 1, 1, 7])), [0.5 * entries.values.sum() + 7, 7])


def test_pieces_of_odd_words():
    import pyarrow as pa
    from forumlens.operators import ngrams
    words = ["a", "\x00", "ab", "abc", "aaaa", "\U0001f600é\x00", "long" * 9, "漢字漢字"]
    expected = [[f" {w} "[i:i + n] for n in range(3, min(5, len(w) + 2) + 1) for i in range(len(w) + 3 - n)] for w in words]
    names, places, counts = ngrams.pieces(pa.array(words))
    names, ends = names.to_pylist(), np.cumsum(counts)
    assert [Counter(names[p] for p in places[e - c:e]) for c, e in zip(counts, ends)] == [Counter(w) for w in expected]
    assert len(set(names)) == len(names) and [len(x) for x in ngrams.pieces(pa.array([], pa.string()))] == [0, 0, 0]


def test_sums_of_pairs_whatever_their_size():
    from forumlens.operators import ngrams
    rows, ids, n = np.array([1, 0, 1, 1]), np.array([5, 2, 5, 0]), np.array([1, 3, 4, 2])
    for width, big in ((6, 1), (1 << 40, 1), (6, 1 << 59)):
        got = ngrams._summed(rows, ids, n * big, width)
        assert [list(map(int, g)) for g in got] == [[0, 1, 1], [2, 0, 5], [3 * big, 2 * big, 5 * big]]


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
def test_a_task_sums_terms_of_its_portions_before_the_shuffle(spark, monkeypatch, limit):
    from forumlens.operators import classifiers
    monkeypatch.setattr(classifiers, "MERGED", limit)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    df = spark.createDataFrame([(["ab", "cd", "ab"],), (["cd"],), (None,), (["ef", "ab"],)] * 9, "terms array<string>").coalesce(1)
    try:
        assert {r.term: (r.n, r["rows"]) for r in occurrences(df).collect()} == {"ab": (27, 18), "cd": (18, 18), "ef": (9, 9)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_blocks_are_dealt_evenly_however_the_rows_stand(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4))
    labels = (x[:, 0] > 0).astype(int)
    df = spark.createDataFrame([(Vectors.sparse(4, range(4), v.tolist()), int(k)) for v, k in zip(x, labels)], ["features", "label"])
    df = df.limit(380).coalesce(1).unionByName(df.exceptAll(df.limit(380)).coalesce(1))
    dealt, real = [], newton.answers

    def answers(blocks, *args):
        dealt.append(blocks.map(lambda b: len(b[0])).glom().map(sum).collect() if not dealt else None)
        return real(blocks, *args)

    monkeypatch.setattr(newton, "answers", answers)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        newton.fit(df, 4, 2)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(dealt[0]) == spark.sparkContext.defaultParallelism and sum(dealt[0]) == 1600
    assert max(dealt[0]) <= 1.5 * 1600 / len(dealt[0])
