"""Operators on embeddings against brute force."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle_check import compare, connect

from forumlens.llm import search, whitening
from forumlens.llm.common import prepared, table

SCHEMA = "vec_id long, embedding array<double>, label int, Rank string, score string"


@pytest.fixture(autouse=True)
def ready(spark):
    prepared(spark)


def odd_vectors():
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.1, 0.75, 1 / 3]) for _ in range(4)]) for i in range(260)]
    rows += [(i, rows[7][1]) for i in range(260, 400)]                     # a common vector
    rows += [rows[0], rows[0], rows[100], (100, [9.0, 9.0, 9.0, 9.0]), (None, [0.5] * 4), (None, [0.5] * 4), (None, None), (500, None), (600, []),
             (601, []), (700, [1.0, None, 2.0, 1.0]), (800, [math.nan, 1.0, 1.0, 1.0]), (900, [math.inf, 0.0, 0.0, 0.0]), (1000, [1.0, 2.0]),
             (1001, [3.0, -2.0]), (1002, [0.0, 0.0]), (1100, [1.0] * 5), (-100, [-3.0, 2.0, 0.5, 0.0]), (1200, [1e300, 0.0, 0.0, 0.0])]
    rng.shuffle(rows)
    return rows


def usable(rows):
    return [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) and abs(x) < 2 ** 52 for x in v)]


def brute_search(rows, top=10, divisor=100):
    once = sorted({(i is None, i or 0, tuple(v)) for i, v in usable(rows)})
    out = []
    for none, i, v in once:
        if none or i % divisor:
            continue
        found = [(-min(max(sum(a * b for a, b in zip(v, w)), -(2 ** 63 - 1)), 2 ** 63 - 1), n, j) for n, j, w in once if len(w) == len(v) and (n or j != i)]
        out += [(i, r + 1, None if n else j, -s) for r, (s, n, j) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def test_search_on_odd_rows(spark):
    rows = odd_vectors()
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA).repartition(5)
    for options in ({}, {"tile_bytes": 8 * 5 * 9, "shards": 3, "fan": 2}, {"shards": 1}, {"top": 3, "divisor": 20}):
        found = [tuple(r) for r in search.search(df, **options).collect()]
        expected = brute_search(rows, **{k: v for k, v in options.items() if k in ("top", "divisor")})
        assert sorted(found, key=str) == expected
    assert search.search(df).columns == ["query_id", "rank", "vec_id", "score"]
    assert search.search(df.filter("label = 0")).count() == 0
    assert search.search(df.filter("vec_id = 0")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.data())
def test_blocks_select_exactly(width, data):
    number = st.one_of(st.integers(-3, 3), st.integers(-2 ** 20, 2 ** 20), st.integers(-2 ** 61, 2 ** 61))
    kind = data.draw(st.sampled_from([st.integers(-3, 3), number]))
    matrix = lambda n: np.array(data.draw(st.lists(st.lists(kind, min_size=width, max_size=width), min_size=n, max_size=n)), float).reshape(n, width)
    q, c = matrix(data.draw(st.integers(1, 5))), matrix(data.draw(st.integers(1, 30)))
    ids = np.arange(0, 3 * len(c), 3)
    query_ids = np.array([data.draw(st.integers(-1, 3 * len(c))) for _ in range(len(q))])
    known, before = data.draw(st.integers(0, len(c))), (search.QUERIES, search.CANDIDATES)
    try:
        search.QUERIES, search.CANDIDATES = data.draw(st.sampled_from([(512, 8192), (2, 4)]))
        scores, places = search.best_of_tile(q, query_ids, c, ids[:known], 4)
    finally:
        search.QUERIES, search.CANDIDATES = before
    for i in range(len(q)):
        exact = [sum(int(a) * int(b) for a, b in zip(q[i].tolist(), c[j].tolist())) for j in range(len(c))]
        best = sorted((-min(max(s, -(2 ** 63 - 1)), 2 ** 63 - 1), j) for j, s in enumerate(exact) if j >= known or ids[j] != query_ids[i])[:4]
        assert [(-int(s), int(p)) for s, p in zip(scores[i], places[i]) if p >= 0] == best


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_search_query_equals_its_sql(spark, sf):
    assert not compare(search.BOOK.queries["op12_tiled_search"](spark, sf), connect(sf), search.BOOK.sql["op12_tiled_search"])


# --- whitening --------------------------------------------------------------------------------------------
def brute_whitening(rows):
    """(n, exact deviation, whitened rows up to the sign, explained shares) of each length."""
    out = {}
    for length in {len(v) for _, v in usable(rows)} - {0}:
        x = [[a + 100_000 for a in v] for _, v in usable(rows) if len(v) == length]
        n, total = len(x), [sum(c) for c in zip(*x)]
        deviation = [sum((n * a - t) ** 2 for a, t in zip(v, total)) for v in x]
        centred = np.array([[(n * a - t) / n for a, t in zip(v, total)] for v in x])
        v = centred.T @ centred / n
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
        out[length] = (n, deviation, centred @ vectors / np.sqrt(values), values / np.trace(v))
    return out


def test_whitening_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    n, deviation, white, explained = brute_whitening(rows)[64]
    found = whitening.BOOK.queries["op11_refined_whitening"](spark, sf).toPandas().sort_values(["vec_id", "component"])
    assert list(found.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(found) == 8 * len(rows) and set(found.n) == {n}
    wide = found.pivot(index="vec_id", columns="component", values="whitened")
    order = {i: k for k, (i, _) in enumerate(rows)}
    expected = white[[order[i] for i in wide.index]]
    got = wide.to_numpy()
    assert np.abs(got * np.sign((got * expected).sum(axis=0)) - expected).max() < 1e-9
    assert (found.groupby("vec_id").deviation.first().to_numpy() == [deviation[order[i]] for i in wide.index]).all()
    assert np.allclose(found.groupby("component").explained.first(), explained, rtol=1e-9)
    assert found.identity_error.nunique() == 1 and found.identity_error.iloc[0] < 1e-9


def test_whitening_on_odd_rows(spark):
    rows = odd_vectors()
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA).repartition(5)
    models, expected = whitening.fit(df), brute_whitening(rows)
    assert set(models) == set(expected)
    found = whitening.whiten(df, models).collect()
    assert len(found) == sum(min(8, k) * e[0] for k, e in expected.items())
    assert sorted(r.deviation for r in found if r.n == expected[4][0] and r.component == 1) == sorted(expected[4][1])
    live = [r.whitened for r in found if r.n == expected[4][0] and r.component == 1]
    assert np.allclose(sorted(map(abs, live)), sorted(abs(expected[4][2][:, 0])), atol=1e-9)
    single = [r for r in found if r.n == 1]
    assert single and all(r.whitened == 0 and r.explained == 0 and r.deviation == 0 for r in single)
    assert whitening.identity_error(df, models) < 1e-9
    none = df.filter("label = 0")
    assert whitening.fit(none) == {} and whitening.whiten(none, {}).count() == 0 and whitening.identity_error(none, {}) == 0
    again = {}
    for r in whitening.whiten(df.repartition(3), models).collect():     # rows do not depend on their batch
        again.setdefault((r.vec_id, r.component, r.deviation), set()).add(r.whitened)
    assert {k: v for k, v in again.items()} == {(r.vec_id, r.component, r.deviation): {x.whitened for x in found if (x.vec_id, x.component, x.deviation)
                                                == (r.vec_id, r.component, r.deviation)} for r in found}


def spectrum(kind):
    rng = np.random.default_rng(4)
    values = {"spread": np.linspace(1, 2, 48), "pair": np.r_[100, 99.9999999999, np.linspace(1, 2, 46)], "two levels": np.r_[np.full(8, 5.0), np.ones(40)],
              "tight": np.r_[5 + 1e-9 * np.arange(8), 1 + 1e-7 * np.arange(40)], "tighter": np.r_[5 + 1e-12 * np.arange(24), 1e-9 * np.arange(24)],
              "falling": np.logspace(0, -14, 48), "spike": np.r_[1e6, np.linspace(1, 1.0001, 47)], "rank one": np.r_[1.0, np.zeros(47)]}[kind]
    turn = np.linalg.qr(rng.normal(size=(48, 48)))[0]
    matrix = (turn * values) @ turn.T
    return (matrix + matrix.T) / 2, np.sort(values)[::-1]


@pytest.mark.parametrize("kind", ["spread", "pair", "two levels", "tight", "tighter", "falling", "spike", "rank one"])
def test_refined_eigenvectors(kind):
    matrix, values = spectrum(kind)
    found, vectors = whitening.eigen(matrix)
    wide, v = matrix.astype(np.longdouble), vectors.astype(np.longdouble)
    size = np.abs(matrix).max()
    assert np.abs(found - values).max() <= 1e-13 * values.max() and (np.diff(found) <= 0).all()
    assert np.abs(wide @ v - v * found).max() <= 1e-15 * size            # residual of the float32 start: 1e-7
    assert np.abs(vectors.T @ vectors - np.eye(48)).max() <= 2e-15
    start = np.linalg.eigh(matrix.astype(np.float32))[1][:, ::-1]
    assert np.abs(matrix @ start - start * found).max() > 1e-9 * size


def test_clusters_and_steps():
    assert whitening.clusters_of(np.array([9.0, 5, 4.9, 4.8, 1, 0.95]), 0.11) == [(1, 4), (4, 6)]
    assert whitening.clusters_of(np.array([3.0]), 1) == [] and whitening.clusters_of(np.zeros(3), 0) == [(0, 3)]
    matrix, _ = spectrum("spread")
    wide = (matrix / np.abs(matrix).max()).astype(np.longdouble)
    vectors = np.linalg.eigh(wide.astype(np.float32))[1][:, ::-1].astype(np.longdouble)
    errors = []
    for _ in range(3):                                                   # each step squares the error
        _, vectors, step, _ = whitening.refine(wide, vectors)
        errors.append(step)
    assert errors[0] < 1e-4 and errors[1] < errors[0] ** 1.5 and errors[2] < 1e-12
