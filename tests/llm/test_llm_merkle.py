"""The Merkle manifest against a plain tree."""

import hashlib
import random
import zlib

import llm_cases as C
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle_check import compare, connect
from pyspark.sql import functions as F

from forumlens.llm import merkle
from forumlens.llm.common import prepared, table


@pytest.fixture(autouse=True)
def ready(spark):
    prepared(spark)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    values = [None if v is None else str(v) for v in (row.doc_id, row.source, row.lang, None if row.n_chars is None else row.n_chars + more, row.text)]
    return h(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def climb(nodes, at, value):
    """Root, siblings on the way and the root with a node replaced."""
    siblings = []
    while len(nodes) > 1:
        run = nodes[at // 2 * 2:at // 2 * 2 + 2]
        siblings += [run[1 - at % 2]] if len(run) > 1 else []
        changed = list(run)
        changed[at % 2] = value
        nodes, at, value = [h(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)], at // 2, h(*changed)
    return nodes[0], siblings, value


def brute(rows):
    order = sorted(rows, key=lambda r: (r.lang is not None, (r.lang or "").encode(), r.doc_id is not None, r.doc_id or 0, leaf_of(r)))
    by = {}
    for r in order:
        by.setdefault(r.lang, []).append(r)
    leaves = {k: [leaf_of(r) for r in v] for k, v in by.items()}
    subroots = [climb(v, 0, v[0])[0] for v in leaves.values()]
    out = []
    for place, (lang, group) in enumerate(by.items()):
        for i, r in enumerate(group):
            bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            subroot, low, value = climb(leaves[lang], i, leaf_of(r, 1) if bad else leaf_of(r))
            root, high, value = climb(subroots, place, value)
            out.append((r.doc_id, leaves[lang][i], subroot, root, h(*low, *high), value, value == root))
    return sorted(out, key=str)


def columns(df):
    return sorted((tuple(r)[:7] for r in df.collect()), key=str)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=9), st.integers(1, 3))
def test_hashes_equal_the_library_from_any_state(blocks, lanes):
    rng, before = random.Random(len(blocks)), merkle.LANES
    digests = [[hashlib.sha256(rng.randbytes(9)).hexdigest() for _ in range(n)] for n in blocks]
    try:
        merkle.LANES = lanes
        state = merkle.started(len(blocks))
        for step in range(5):
            at = np.array([step < n for n in blocks])
            if at.any():
                words = merkle.in_hex(merkle.from_bytes([bytes.fromhex(d[step]) for d in digests if len(d) > step]))
                state[:, at] = merkle.compress(state[:, at], words)
                state = merkle.from_bytes(merkle.to_bytes(state))        # a state can be kept and sent along
        assert [d.hex() for d in merkle.to_bytes(merkle.finish_each(state, np.array(blocks)))] == [h(*d) for d in digests]
    finally:
        merkle.LANES = before


@pytest.mark.parametrize("depth", [12, 2, 1])
def test_manifest_on_odd_rows(spark, depth):
    docs = C.odd_documents(spark).repartition(5)
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").collect()
    found = merkle.fold_all(docs, merkle.tampered(docs), with_paths=True, depth=depth)
    assert columns(found) == brute(rows)
    assert all(merkle.follow(bytes(r.path), r.leaf) == r.root for r in found.collect())
    assert all(r.verified and r.folded_root == r.root for r in merkle.fold_all(docs).collect())


def test_small_trees(spark):
    docs = C.odd_documents(spark, clash=False)
    assert merkle.fold_all(C.no_documents(spark)).count() == 0
    one = docs.filter("doc_id = 3")
    r = merkle.fold_all(one, merkle.tampered(one)).first()
    assert (r.leaf, r.subroot, r.proof_sha256) == (r.root, r.root, h())
    alike = docs.filter("doc_id = 9").select("*", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("col")   # wholly equal rows
    found = merkle.fold_all(alike, merkle.tampered(alike))
    assert columns(found) == brute(alike.collect()) and found.select("proof_sha256").distinct().count() > 1


def test_many_groups_and_rounds(spark):
    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"),
                                   F.when(F.col("id") < 400, "big").when(F.col("id") < 640, F.concat(F.lit("l"), F.col("id") % 60)).alias("lang"),
                                   F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    assert columns(merkle.fold_all(docs, merkle.tampered(docs), depth=3)) == brute(docs.collect())


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_manifest_query_against_a_plain_tree_and_sql(spark, sf):
    found = merkle.BOOK.queries["op13_merkle_manifest"](spark, sf)
    assert columns(found) == brute(table(spark, sf, "documents").collect())
    assert 0 < found.filter("NOT verified").count() < found.count() / 4
    assert not compare(found, connect(sf), merkle.SQL)
