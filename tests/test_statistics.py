import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from forumlens.operators.folds import grouped_folds
from forumlens.operators import agreement as A
from forumlens.operators import bootstrap as Z
from forumlens.operators import ranking as R
from forumlens.operators import sampling as S
from forumlens.operators.quantiles import exact_quantiles, quartile_labels


def water_fill(sizes, total):
    """Raise the cap one by one, the slow and obvious way."""
    cap = max(c for c in range(max(sizes.values()) + 1) if sum(min(n, c) for n in sizes.values()) <= total)
    taken = {k: min(n, cap) for k, n in sizes.items()}
    for key in sorted(k for k, n in sizes.items() if n > cap)[:total - sum(taken.values())]:
        taken[key] += 1
    return taken


@pytest.mark.parametrize("seed", range(6))
def test_allocation(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02d}": rng.choice([1, 2, 5, 30, 100, rng.randint(1, 300)]) for i in range(rng.randint(1, 9))}
    total = rng.randint(1, sum(sizes.values()))
    table = spark.createDataFrame(list(sizes.items()), "s string, stratum_size long")
    got = {r["s"]: r["stratum_sampled"] for r in S.allocate(table, ["s"], total).collect()}
    assert got == water_fill(sizes, total) and sum(got.values()) == total


def test_allocation_of_everything_and_too_much(spark):
    table = spark.createDataFrame([("a", 3), ("b", 5)], "s string, stratum_size long")
    assert {r["stratum_sampled"] for r in S.allocate(table, ["s"], 8).collect()} == {3, 5}
    with pytest.raises(Exception, match="only 8 eligible rows"):
        S.allocate(table, ["s"], 9).collect()


@pytest.fixture(scope="module")
def people(spark):
    """One stratum holds most of the rows."""
    return spark.range(3000).select(
        F.concat(F.lit("p"), "id").alias("id"),
        F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "warm").otherwise(F.lit(None)).alias("s"))


def expected_ranks(people):
    frame = people.toPandas()
    frame["rank"] = [hashlib.sha256(f"42:{i}".encode()).hexdigest()[:16] for i in frame["id"]]
    frame["s"] = frame["s"].astype(object).where(frame["s"].notna(), "")
    return frame.sort_values(["s", "rank"])


def test_row_numbers_equal_a_plain_sort(people):
    ranked = people.withColumn("rank", R.hash_rank("id"))
    want = expected_ranks(people)
    want["n"] = want.groupby("s").cumcount() + 1
    want["row"] = np.arange(len(want)) + 1
    got = R.group_row_numbers(ranked, ["s"], "rank", "n").select("id", "n").toPandas().set_index("id")["n"]
    assert got.to_dict() == want.set_index("id")["n"].to_dict()
    rows = R.global_row_numbers(ranked, ["s"], "rank", "row").select("id", "row").toPandas().set_index("id")["row"]
    assert rows.to_dict() == want.set_index("id")["row"].to_dict()


def test_first_per_group_drops_rows_before_the_shuffle(people):
    limits = people.sparkSession.createDataFrame([("hot", 40), ("warm", 10000), (None, 3)], "s string, k long")
    ranked = people.withColumn("rank", R.hash_rank("id"))
    got = R.first_per_group(ranked, ["s"], "rank", limits, "k")
    want = expected_ranks(people)
    ids = set(want[want["s"] == "hot"]["id"][:40]) | set(want[want["s"] == "warm"]["id"]) | set(want[want["s"] == ""]["id"][:3])
    assert {r["id"] for r in got.collect()} == ids


def test_sample_is_the_same_for_any_partitioning(people):
    rows = people.filter("s is not null")
    first = S.stratified_sample(rows, ["s"], 100)
    second = S.stratified_sample(rows.repartition(17), ["s"], 100)
    a, b = (sorted((r["id"], r["part"], r["order"]) for r in df.collect()) for df in (first, second))
    assert a == b and len(a) == 100
    parts = first.groupBy("part").agg(F.count("*").alias("n"), F.max("order").alias("m")).collect()
    assert all(p["n"] == p["m"] == 50 for p in parts)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    buckets = {}
    for x in sorted(x[0] for x in a):
        buckets.setdefault(sha(x)[:4], []).append(x)
    digest = sha("\n".join(sha("\n".join(buckets[b])) for b in sorted(buckets)))
    assert S.fingerprint(first).first()["sha256"] == digest
    with pytest.raises(ValueError):
        S.require_fingerprint(first, "0" * 64)


def test_quota_sample_fails_when_a_cell_is_short(spark):
    rows = spark.createDataFrame([("a1", "x", "p"), ("a2", "x", "q"), ("a3", "y", "p")], "id string, o string, i string")
    with pytest.raises(Exception, match="not enough rows in y q"):
        S.quota_sample(rows, "o", "i", ["p", "q"], 4).collect()


def test_folds_keep_threads_whole(spark):
    rows = spark.range(2000).select(F.col("id"), F.concat(F.lit("t"), F.col("id") % 150).alias("thread"),
                                    (F.col("id") % 3).cast("string").alias("label"))
    folds = grouped_folds(rows, "thread", ["label"])
    assert folds.count() == 2000
    assert folds.groupBy("thread").agg(F.count_distinct("fold").alias("n")).filter("n > 1").isEmpty()
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 1.3 * min(sizes)


PROBS = {"a": 0.0, "b": 0.025, "c": 0.25, "d": 0.5, "e": 0.9, "f": 1.0}


@pytest.mark.parametrize("n, accuracy", [(1, 100), (2, 100), (97, 10_000), (4_000, 50), (60_000, 200)])
def test_quantiles_are_exact(spark, n, accuracy):
    rng = np.random.default_rng(n)
    values = np.where(rng.random(n) < 0.33, 7.25, rng.normal(size=n).round(3) * 10)
    frame = pd.DataFrame({"g": rng.integers(0, 2, n).astype(str), "v": values})
    df = spark.createDataFrame(frame)
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", PROBS, accuracy).collect()}
    for g, part in frame.groupby("g"):
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(np.quantile(part["v"], p), abs=1e-9)


def test_quartile_labels_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 9)], "w int")
    labels = {r["w"]: r["l"] for r in quartile_labels(df, "w", "l", "words").collect()}
    cut = pd.qcut(pd.Series(range(1, 9)), 4, labels=False)
    assert [sorted(set(labels.values())).index(labels[i]) for i in range(1, 9)] == list(cut)


MATRIX = [[20, 5, 1], [10, 30, 4], [0, 6, 24]]


def rating_rows(spark, matrix=MATRIX):
    rows = [(A.V.CLASSES[i], A.V.CLASSES[j]) for i in range(3) for j in range(3) for _ in range(matrix[i][j])]
    return spark.createDataFrame(rows, "label_1 string, label_2 string")


def test_agreement_measures(spark):
    m = np.array(MATRIX, dtype=float)
    p, rows, cols = m / m.sum(), m.sum(1) / m.sum(), m.sum(0) / m.sum()
    w = np.abs(np.subtract.outer(np.arange(3), np.arange(3))) / 2
    got = A.measures(A.confusion(rating_rows(spark), "label_1", "label_2"), [], {**A.Counts().agreement_set(), "macro": A.Counts().macro_f1(), "chi2": A.Counts().marginal_chi2()}, 9).first()
    assert got["agreement"] == pytest.approx(np.trace(p))
    assert got["cohen_kappa"] == pytest.approx((np.trace(p) - rows @ cols) / (1 - rows @ cols))
    assert got["weighted_kappa"] == pytest.approx(1 - (w * p).sum() / (w * np.outer(rows, cols)).sum())
    assert got["against_vs_pro"] == pytest.approx(1 / 100) and got["same_direction"] == pytest.approx(44 / 45)
    assert got["macro"] == pytest.approx((2 * np.diag(m) / (m.sum(1) + m.sum(0))).mean())
    d = (m.sum(1) - m.sum(0))[:2]
    cov = -(m + m.T)[:2, :2]
    np.fill_diagonal(cov, (m.sum(1) + m.sum(0) - 2 * np.diag(m))[:2])
    assert got["chi2"] == pytest.approx(d @ np.linalg.solve(cov, d))


def test_one_class_has_no_kappa(spark):
    wide = A.confusion(rating_rows(spark, [[5, 0, 0], [0, 0, 0], [0, 0, 0]]), "label_1", "label_2")
    got = A.measures(wide, [], {**A.Counts().scores(), "same": A.Counts().same_direction()}).first()
    assert got["kappa"] is None and got["accuracy"] == 1.0 and got["macro_f1"] == pytest.approx(1 / 3, abs=1e-6)


def statistics(cells, by, weight):
    wide = A.confusion(cells, "label_1", "label_2", by, weight=weight)
    return wide.select(*by, A.Counts().accuracy().alias("accuracy"), A.Counts().kappa().alias("kappa"))


def test_bootstrap_draws_as_many_rows_as_there_are(spark):
    cells = Z.count_cells(rating_rows(spark), [], ["label_1", "label_2"])
    draws = Z.resample(cells, [], ["label_1", "label_2"], 50, 42)
    sums = [r["m"] for r in draws.groupBy("replicate").agg(F.sum("m").alias("m")).collect()]
    assert sums == [100] * 50


def test_intervals_and_errors_against_brute_force(spark):
    rows = rating_rows(spark)
    found = Z.with_intervals(rows, [], ["label_1", "label_2"], statistics, 2000, 42).first()
    kept = np.array([np.array(MATRIX) - np.eye(9)[i].reshape(3, 3) for i in range(9) for _ in range(np.array(MATRIX).ravel()[i])])
    shares = kept[:, range(3), range(3)].sum(1) / 99
    assert found["accuracy_se"] == pytest.approx(np.sqrt(99 / 100 * ((shares - shares.mean()) ** 2).sum()))
    assert found["accuracy_se"] == pytest.approx(np.sqrt(0.74 * 0.26 / 99))   # the closed form for a share
    m = np.array(MATRIX).ravel()
    brute = np.random.default_rng(0).multinomial(100, m / 100, 4000).reshape(-1, 3, 3)
    accuracy = brute[:, range(3), range(3)].sum(1) / 100
    for end, q in (("low", 0.025), ("high", 0.975)):
        assert found[f"accuracy_{end}"] == pytest.approx(np.quantile(accuracy, q), abs=0.02)
    assert all(r["ci_fits"] for r in Z.as_rows(Z.with_intervals(rows, [], ["label_1", "label_2"], statistics), [], ["accuracy", "kappa"]).collect())


@pytest.mark.parametrize("rows", [0, 200_000])
def test_joins_agree_on_both_sides_of_the_broadcast_limit(spark, monkeypatch, rows):
    from forumlens import session
    monkeypatch.setattr(session, "BROADCAST_ROWS", rows)
    frame = spark.range(3000).select("id", (F.col("id") % 7).cast("string").alias("g"))
    sized = R.with_group_sizes(frame, ["g"], "n")
    assert {(r["g"], r["n"]) for r in sized.select("g", "n").distinct().collect()} == {(str(i), 429 if i < 4 else 428) for i in range(7)}


@pytest.mark.parametrize("kind", ["word", "character"])
def test_classifier_learns_marked_texts(spark, kind):
    from forumlens.operators.classifiers import TextClassifier, evaluate
    marks = {"against": "gräßlich bad", "neutral": "maybe so", "pro": "lovely best"}
    rows = [(i, f"text {i % 7} {marks[c]} {'filler ' * (i % 5)}" if i % 11 else "", c) for i in range(90) for c in A.V.CLASSES]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    fitted = TextClassifier(kind).fit(df, "text", "label")
    found = evaluate(fitted.predict(df, "text"), "label").first()
    assert found["n"] == 270 and found["accuracy"] > 0.9
    assert fitted.predict(df.withColumn("text", F.lit(None).cast("string")), "text").count() == 270
