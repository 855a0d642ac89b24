"""Corpus stages against brute force where texts are edited copies."""

import random
from collections import Counter

import pytest

from forumlens.llm import decontamination
from forumlens.llm.common import prepared


@pytest.fixture(autouse=True)
def ready(spark):
    prepared(spark)


def plain_hits(items, text):
    """Items of which a window has a cosine of plain shingle counts of 0.8 or more."""
    words, out = decontamination.words_of(text), set()
    grams = lambda w: Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    for key, item in items:
        own = decontamination.words_of(item)
        size = min(len(own), len(words))
        if any(decontamination.cosine(grams(words[i:i + size]), grams(own), lambda s: 1) >= 0.8 for i in range(len(words) - size + 1)):
            out.add(key)
    return out


def test_edited_copies_of_repeated_and_templated_items(spark):
    rng = random.Random(12)
    prose = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    repeated, half, template = prose(40), prose(45), prose(50)
    texts = [repeated, repeated, half, half[:-1] + ["other"], half[:-2] + ["two", "more"], prose(35)]
    texts += [template[:25] + [f"slot{i}"] + template[25:] for i in range(5)]
    items = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = []
    for _, text in items:
        for at in (0.0, 0.3, 0.5, 0.8):
            words = text.split()
            words[int(at * len(words))] = "edited"
            docs.append(" ".join(prose(20) + words + prose(20)))
    docs.append(" ".join(prose(100)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    expected = [plain_hits(items, d) for d in docs]
    assert all(expected[:-1]) and not expected[-1]
    results = []
    for block in (50_000, 3):
        found = sorted(decontamination.find(table, bench, block_items=block).collect())
        results.append([{(h.item_id, h.start, h.end, round(h.similarity, 9)) for h in r.hits} for r in found])
        for r, wanted in zip(found, expected):
            assert wanted <= {h.item_id for h in r.hits}
    assert results[0] == results[1]
    assert [r.doc_id for r in decontamination.clean_rows(table, bench).collect()] == [len(docs) - 1]
