"""Tone and batch scoring against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forumlens import session
from forumlens.operators import scoring, tone
from forumlens.plans import fixtures as X

WEIGHTS = {"the": 1.0, "of": -0.5, "and": 0.25, "not": -2.0}
TEXTS = ["the", "THE", "a THE b", "in the", "to the of", "that the", "that in the", "THAT IN the x", "in in in the", "the that the", "of or the", "or the", "the or",
         "the of or and not or of", "the!!!!!! ok", "of!? what??", "the?????", "in the! to OF and that x x x x of", "", "?!", "nothing here", None, "ÉTÉ the de le THE",
         "the-the not_the the's", "x y z the", "in y z the", "in w y z the", "to IN that THE of"]


@pytest.fixture(autouse=True)
def ready(spark):
    session.configure(spark)


def plain_tone(text):
    text = text or ""
    words = re.findall(r"\w{2,}", text)
    loud = [w.upper() == w and w.lower() != w for w in words]
    shouts = 0 < sum(loud) < len(words)
    sign = lambda v: (v > 0) - (v < 0)
    split = next((i for i, w in enumerate(words) if w.lower() in X.CONTRASTS), None)
    total = 0.0
    for i, w in enumerate(words):
        v = WEIGHTS.get(w.lower())
        if v is None:
            continue
        v += sign(v) * 0.733 if shouts and loud[i] else 0
        for d, fade in ((1, 1.0), (2, 0.95), (3, 0.9)):
            if i < d or words[i - d].lower() in WEIGHTS:
                continue
            p = words[i - d].lower()
            if p in X.BOOSTERS:
                v += (sign(v) * X.BOOSTERS[p] + (sign(v) * 0.733 if shouts and loud[i - d] else 0)) * fade
            if p in X.NEGATIONS:
                v *= -0.74
        total += v * (1 if split in (None, i) else 0.5 if i < split else 1.5)
    calls, asks = text.count("!"), text.count("?")
    total += sign(total) * (min(calls, 4) * 0.292 + (0 if asks < 2 else asks * 0.18 if asks <= 3 else 0.96))
    return total / math.sqrt(total * total + 15)


@pytest.mark.parametrize("limits", [{}, {"rows": 3}, {"size": 100}])
def test_tone_equals_a_plain_version(spark, limits):
    rng = random.Random(2)
    pool = [*WEIGHTS, *X.BOOSTERS, *X.NEGATIONS, *X.CONTRASTS, "word", "other", "x"]
    texts = TEXTS + [" ".join(rng.choice((str.lower, str.upper, str.title))(rng.choice(pool)) + rng.choice(["", "", "!", "?", ","]) for _ in range(rng.randrange(25)))
                     for _ in range(400)]
    df = spark.createDataFrame([(7 if i % 3 == 0 else i, t) for i, t in enumerate(texts)], "id long, body string").repartition(4)   # one id on a third
    found = tone.lexicon_tone(df, "body", X.tone_words(spark), **limits)
    assert found.columns == ["id", "body", "tone"]
    rows = found.collect()
    assert Counter((r.id, r.body) for r in rows) == Counter((7 if i % 3 == 0 else i, t) for i, t in enumerate(texts))
    for r in rows:
        assert r.tone == pytest.approx(plain_tone(r.body), abs=1e-12)


def test_tone_of_all_comments(spark):
    comments = X.cmt(spark, "/root/testdata/sf0.01").select("id", "body")
    for r in tone.lexicon_tone(comments, "body", X.tone_words(spark)).collect():
        assert r.tone == pytest.approx(plain_tone(r.body), abs=1e-9)


def test_tone_of_words_alone(spark):
    texts = spark.createDataFrame([(1, "good good bad"), (2, "nothing here"), (3, None), (4, "bad")], "id int, t string")
    weights = spark.createDataFrame([("good", 1.5), ("good", 0.5), ("bad", -1.0), (None, 3.0)], "word string, w double")
    found = {r.id: round(r.tone, 6) for r in tone.lexicon_tone(texts, "t", tone.word_table(weights)).collect()}
    assert found == {1: round(3 / 24 ** 0.5, 6), 2: 0.0, 3: 0.0, 4: -0.25}
    assert {r.tone for r in tone.lexicon_tone(texts, "t", tone.word_table(weights.limit(0))).collect()} == {0.0}


# --- batches ----------------------------------------------------------------------------------------------
@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 500), max_size=60), st.integers(1, 900))
def test_packs_fill_the_budget(lengths, padded):
    lengths = np.sort(np.array(lengths, int))
    cuts = scoring.packs(lengths, padded)
    assert [i for a, b in cuts for i in range(a, b)] == list(range(len(lengths)))
    for n, (a, b) in enumerate(cuts):
        assert b - a == 1 or (b - a) * lengths[b - 1] <= padded
        if n + 1 < len(cuts):
            assert (b + 1 - a) * lengths[b] > padded        # the next text would not have fitted


def test_labels_do_not_depend_on_the_packing(spark):
    texts = X.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    sizes = spark.sparkContext.accumulator(0)

    def make():
        def score(batch):
            sizes.add(len(batch) * max(map(len, batch)))
            n = np.array([[1 + t.count("a"), 1 + t.count("e"), 1 + t.count("o")] for t in batch], float)
            return n / n.sum(axis=1, keepdims=True)
        return score

    found = scoring.with_label(texts, "text", F.col("doc_id") % 5 == 0, make).collect()
    assert len(found) == texts.count()
    for r in found:
        n = [1 + r.text.count(c) for c in "aeo"]
        assert (r.student_label is None) == (r.doc_id % 5 == 0)
        if r.student_label is not None:
            assert r.student_p_against == pytest.approx(n[0] / sum(n), abs=1e-6)
    chosen = texts.filter("doc_id % 5 <> 0")
    before, after = scoring.padding(chosen, "text", plain=32).first(), scoring.padding(chosen, "text").first()
    assert before.texts == after.texts == chosen.count() and before.characters == after.characters
    waste = lambda r: 1 - r.characters / r.padded
    assert waste(after) < 0.2 < waste(before)
    assert scoring.padding(chosen.limit(0), "text").first().padded is None
