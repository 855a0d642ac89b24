import html
import random
import re

import pytest

from forumlens import fixed_values as V
from forumlens.functions import flags as G
from forumlens.functions import text as T


def apply(spark, expression, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["out"] for r in rows.select("i", expression.alias("out")).orderBy("i").collect()]


def test_golden_toy_example(spark):
    raw = ["&gt; Trump said X\n\nI disagree with that &amp; so does [this](https://x.com/a).",
           "&gt; quoted text\nTrump is doing fine https://t.co/abc"]
    clean = apply(spark, T.clean_text("t"), raw)
    assert clean == ["I disagree with that & so does this.", "Trump is doing fine"]
    assert apply(spark, T.mentions("t", "trump"), clean) == [False, True]


EDGES = [
    None, "", "   ", "> only a quote", "a\r\n> quote\r\nb", "  nbsp  ", "x &amp;gt; y", "a​b",
    "line  one \n\n\n  line two\t\t", "[t](https://a.b/c) and [n](not-a-link) and [r](/r/x)", "www.a.b c https://d",
    "\x1f sep \x1c", " > not a new line", "  >indented quote\nkept", "café 　 wide",
]


def python_clean(text):
    """The same steps by the standard library, as a second opinion."""
    out = text or ""
    for pattern, value in ((V.QUOTE_LINE, ""), (V.MARKDOWN_LINK, r"\1"), (V.URL, "")):
        out = re.sub(pattern, value, out)
    out = "".join(c for c in html.unescape(out) if c != V.ZERO_WIDTH_SPACE)
    lines = [re.sub("[ \t]+", " ", line).strip() for line in out.split("\n")]
    return "\n".join(line for line in lines if line)


def test_clean_text_on_edges(spark):
    assert apply(spark, T.clean_text("t"), EDGES) == [python_clean(t) for t in EDGES]


def test_entities_equal_the_standard_table(spark):
    random.seed(7)
    pieces = ["&", "&amp;", "&lt", "&notit;", "&#65;", "&#x41", "&#128;", "&#0;", "&#55296;", "&#1114112;",
              "&#99999999999999999999;", "&#x1F600;", "&copy=2", "AT&T", "&nosuch;", "&#13;", "&#xFFFE;", ";", "x",
              "&ampamp;", "&#x;", "&#", "&NotEqualTilde;", "\n", "&l", "&am\tp;", "&Aacute", "&fjlig;"]
    texts = ["".join(random.choices(pieces, k=random.randint(1, 6))) for _ in range(400)] + pieces
    assert apply(spark, T.decode_entities("t"), texts) == [html.unescape(t) for t in texts]


@pytest.mark.parametrize("text, found", [
    ("Trump", True), ("TRUMP's", True), ("trumped", False), ("étrump", False), ("trumpé", False),
    ("_trump_", False), ("(trump)", True), (None, False), ("a\ntrump", True)])
def test_keyword_is_a_whole_word(spark, text, found):
    assert apply(spark, T.mentions("t", "trump"), [text]) == [found]


def test_eligibility_uses_the_substring(spark):
    assert apply(spark, T.contains_keyword("t", "trump"), ["Trumpism", "none", None]) == [True, False, None]


def test_junk_titles(spark):
    titles = ["[Removed by moderator]", " *[ removed  by moderator ]* ", "?I_support_Trump", "I_do_not_support_trump!",
              "I support Trump", "[removed by moderator] again", None, "?I_support_Trump\n"]
    pattern = re.compile(V.JUNK_TITLE, re.IGNORECASE)
    expected = [bool(pattern.match(t)) if t else False for t in titles]
    assert apply(spark, T.is_junk_title("t"), titles) == expected


def test_word_window_and_snippet(spark):
    assert apply(spark, T.length_window("t", 2, 3), ["a", "a b", "a b c", "a b c d", None]) == [False, True, True, False, False]
    assert apply(spark, T.snippet("t", 5), ["a \n\n b  c d e"]) == ["a b c"]
    assert apply(spark, T.ends_with_question("t"), ["why? ", "why", None]) == [True, False, False]
    assert apply(spark, T.truncate("t", 2), ["\U0001f600ab"]) == ["\U0001f600a"]
    assert apply(spark, T.escape_newlines("t"), ["a\r\nb"]) == ["a\\r\\nb"]


def test_question_key(spark):
    texts = ["Q.1 Do you approve?", "QA1a. Do you approve!", "q 12 Do you approve", "", "q1", None]
    assert apply(spark, T.question_key("t"), texts)[:5] == ["do you approve"] * 3 + ["", ""]


def test_flair_and_edited(spark):
    rows = spark.createDataFrame([
        (" Nimble Navigator ", "AskTrumpSupporters", "False"), ("Toaster", "AskTrumpSupporters", "1483230000.0"),
        ("", "AskTrumpSupporters", None), ("Undecided", "politics", "False")],
        "author_flair_text string, subreddit string, edited string")
    out = rows.select(G.declared_stance().alias("s"), G.is_edited().alias("e"), G.edited_at_seconds().alias("u")).collect()
    assert [r["s"] for r in out] == ["supporter", "other", None, None]
    assert [r["e"] for r in out] == [False, True, None, False]
    assert [r["u"] for r in out] == [None, 1483230000.0, None, None]


def test_labels_and_ties(spark):
    rows = spark.createDataFrame([(0.4, 0.2, 0.4), (0.1, 0.5, 0.4), (None, None, None)], "a double, n double, p double")
    labels = rows.select(G.argmax_label({"against": "a", "neutral": "n", "pro": "p"}).alias("l"))
    assert [r["l"] for r in labels.collect()] == ["against", "neutral", None]
    tones = spark.createDataFrame([(0.05,), (-0.05,), (0.049,)], "t double")
    assert [r["l"] for r in tones.select(G.label_by_threshold("t").alias("l")).collect()] == ["pro", "against", "neutral"]
