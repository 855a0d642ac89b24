"""Searches and lengths of texts against plain versions and a library."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forumlens import session
from forumlens.operators import codebook, subwords
from forumlens.plans import fixtures as X
from forumlens.plans.k_models import VOCABULARY


@pytest.fixture(autouse=True)
def ready(spark):
    session.configure(spark)


def plain(text):
    return re.sub("[^a-z0-9]+", " ", (text or "").lower()).strip()


def test_search_equals_a_scan(spark):
    rng = random.Random(3)
    words = ["pre", "president", "presidents", "job", "handling", "his", "a", "an", "Q1a.", "re-election", "É", "naïve"]
    rows = [(f"w{i % 5}", f"v{i}", i, " ".join(rng.choice(words) for _ in range(rng.randrange(9))) if i % 11 else None) for i in range(300)]
    book = spark.createDataFrame(rows, "wave string, variable string, ordinal int, question string")
    index = codebook.write_index(book, "question", ["wave", "variable"], session.new_table_path(spark, "index"))
    for phrases in (["president"], ["handling his job"], ["pre", "job"], ["ling h"], ["an", "a a", "his"], ["nothing like it"], ["re-elec", "pres"], ["a a a"], ["1a"]):
        found = codebook.search(spark, index, ["wave", "variable"], phrases).collect()
        expected = {(w, v) for w, v, _, q in rows if all(plain(p) in plain(q) for p in phrases)}
        assert len(found) == len(expected) and {tuple(r) for r in found} == expected
    with pytest.raises(ValueError):
        codebook.search(spark, index, ["wave", "variable"], ["?!"])
    main = spark.createDataFrame([("w0", 100), ("w1", 295), ("w9", 0)], "wave string, main_ordinal int")
    answers = codebook.write_index(book, "question", ["wave", "variable", "ordinal"], session.new_table_path(spark, "index"))
    found = {r.wave: r.follow_up for r in codebook.follow_up(spark, answers, ["wave", "variable", "ordinal"], ["job"], main).collect()}
    expected = {}
    for w, v, o, q in rows:
        if w in ("w0", "w1") and o > {"w0": 100, "w1": 295}[w] and "job" in plain(q):
            expected.setdefault(w, v)
    assert found == expected


def test_a_search_reads_the_rows_of_its_words(spark):
    from test_layout import rows_read

    book = spark.range(60_000).select(F.col("id").alias("n"), F.concat(F.lit("w"), F.sha2(F.col("id").cast("string"), 256), F.lit(" every")).alias("q"))
    index = codebook.write_index(book, "q", ["n"], session.new_table_path(spark, "index"))
    word = book.filter("n = 4711").first().q.split()[0]
    found = codebook.search(spark, index, ["n"], [word])
    assert [r.n for r in found.collect()] == [4711] and rows_read(found) < 60_000


# --- subwords ---------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    pieces = subwords.read_vocabulary(VOCABULARY)
    model = models.WordPiece({p: i for i, p in enumerate([*pieces, "<unknown>"])}, unk_token="<unknown>", continuing_subword_prefix="",
                             max_input_chars_per_word=subwords.MAX_WORD + len(subwords.END))
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(r"\s"), "removed")

    def lengths(texts):
        marked = [" ".join(w + subwords.END for w in subwords.WORDS.findall(t.lower())) for t in texts]
        return [len(e.ids) + subwords.SPECIAL for e in tokenizer.encode_batch(marked, add_special_tokens=False)]

    return lengths


def test_lengths_of_all_texts_equal_the_library(spark, library):
    texts = X.table(spark, "/root/testdata/sf0.01", "documents").select("text")
    found = texts.select("text", subwords.token_length(spark, "text", VOCABULARY).alias("n")).collect()
    assert [r.n for r in found] == library([r.text or "" for r in found])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text("the antiosr'-_9é", max_size=40), st.text(max_size=20)), max_size=4))
def test_cuts_equal_the_library(library, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    known = subwords.prefixes(subwords.read_vocabulary(VOCABULARY)) if not KNOWN else KNOWN[0]
    KNOWN[:] = [known]
    mine = []
    for t in texts:
        cuts = [subwords.cut(w, known) for w in subwords.WORDS.findall(t.lower())]
        mine.append(subwords.SPECIAL + sum(1 if c is None else len(c) for c in cuts))
    assert mine == library(texts)


KNOWN: list = []


def test_lengths_on_odd_texts(spark, tmp_path):
    (tmp_path / "pieces.txt").write_text("a\nab\nb</w>\na</w>\n")
    rows = [(None,), ("",), ("AB ab a",), ("aaaab c",), ("a" * 101,), ("aab?",)]
    df = spark.createDataFrame(rows, "t string").repartition(1)
    found = {r.t: r.n for r in df.select("t", subwords.token_length(spark, "t", str(tmp_path / "pieces.txt")).alias("n")).collect()}
    assert found == {None: 2, "": 2, "AB ab a": 2 + 1 + 1 + 1, "aaaab c": 2 + 1 + 1, "a" * 101: 3, "aab?": 2 + 1 + 1}


def test_names_matching_lists_the_names_of_each_wave(spark, sf_dir):
    from forumlens.operators.survey import names_matching
    from forumlens.plans import d_survey
    names = [f"Age{i}" for i in range(300)] + ["age_1", "age_1", "dated", "update", "DATE", "é", None]
    book = spark.createDataFrame([(w, n) for w in "ab" for n in names] + [("c", "page")], "wave string, variable string").repartition(7)
    found = {r.wave: r.variables_found for r in names_matching(book, "date|age").collect()}
    assert found == {w: ", ".join(sorted(n for n in names if n and n.lower().startswith(("date", "age")))) for w in "ab"}
    waves = {r.wave: r.variables_found for r in d_survey.BOOK.queries["d20_names_matching"](spark, sf_dir).collect()}
    assert waves["A17"] == "age, date_code" and waves["P25"] == "agecat, date_text" and {f"W{i}" for i in (0, 1)} <= set(waves)
