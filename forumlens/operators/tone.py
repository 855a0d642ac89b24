"""Tone of a text from weighted words and the words around them.

The words of a text are folded in order with the three before each at hand. A weighted word counts more in capitals (if the
text is not all capitals), more or less behind a booster, whose effect fades with the distance, and turns round behind a
negation; words with a weight of their own do neither. Before the first contrast word weights count half, behind it one and
a half times. Final signs push the sum further from zero, and it is squeezed into -1 to 1. All words come from tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.operators.staging import computed_once
from forumlens.session import BROADCAST_BYTES, BROADCAST_ROWS, cut_lineage

# fixed values of the rule: capitals, fading with the distance, negation, before and behind a contrast, squeeze
CAPITALS = 0.733
FADING = (1.0, 0.95, 0.9)
NEGATED = -0.74
BEFORE, BEHIND = 0.5, 1.5
SQUEEZE = 15.0
# and of signs: per exclamation mark up to four, per question mark where there are two or three, four and more question marks
EXCLAIMED, EXCLAMATIONS, ASKED, ASKED_OFTEN = 0.292, 4, 0.18, 0.96

SALTS = 64
MAPS = 1024              # that a word table is dealt out to at most
WORD = r"[\p{L}\p{N}_]{2,}"
_INFO = "struct<weight:double,boost:double,negation:boolean,contrast:boolean>"


def word_table(weights: DataFrame, boosters: DataFrame | None = None, negations: DataFrame | None = None, contrasts: DataFrame | None = None) -> DataFrame:
    """(word, info): what each word does. ``weights`` and ``boosters`` have (word, w), the others (word); words are in lower
    case, and weights of one word add up."""
    none = F.lit(None).cast("double")
    parts = [weights.select("word", F.col("w").cast("double").alias("weight"), none.alias("boost"), F.lit(False).alias("negation"), F.lit(False).alias("contrast"))]
    if boosters is not None:
        parts.append(boosters.select("word", none.alias("weight"), F.col("w").cast("double").alias("boost"), F.lit(False).alias("negation"), F.lit(False).alias("contrast")))
    for table, negation in ((negations, True), (contrasts, False)):
        if table is not None:
            parts.append(table.select("word", none.alias("weight"), none.alias("boost"), F.lit(negation).alias("negation"), F.lit(not negation).alias("contrast")))
    every = reduce(DataFrame.unionByName, parts).filter(F.col("word").isNotNull())
    info = F.struct(F.sum("weight").alias("weight"), F.sum("boost").alias("boost"), F.max("negation").alias("negation"), F.max("contrast").alias("contrast"))
    return every.groupBy("word").agg(info.alias("info"))


def _is_capitals(word: Column) -> Column:
    return (F.lower(word) != word) & (F.upper(word) == word)


def _looked_up(word: Column) -> Column:
    """What a word does, from the list of maps in ``__known``: a map is searched from its start, so words are dealt out to many."""
    return F.try_element_at(F.get("__known", F.pmod(F.xxhash64(word), F.size("__known")).cast("int")), word)


def folded(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Append the tone of texts next to the maps of their words (``__known``)."""
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))

    def info(word: Column, place: Column) -> Column:
        return F.struct(_looked_up(F.lower(word)).alias("does"), _is_capitals(word).alias("loud"), (place + 1).alias("place"))

    # evaluated once per row, as the lambdas below refer to them for every word
    rows = computed_once(rows, "__words", F.transform(words, info)).drop("__known")
    louds = F.size(F.filter("__words", lambda x: x["loud"]))
    split = F.coalesce(F.get(F.filter("__words", lambda x: x["does"]["contrast"]), F.lit(0))["place"], F.lit(0))
    rows = computed_once(rows, "__text", F.struct(((louds > 0) & (louds < F.size("__words"))).alias("shouts"), split.alias("split")))
    shouts, split = F.col("__text.shouts"), F.col("__text.split")

    def louder(value: Column, loud: Column) -> Column:
        return F.when(shouts & loud, F.signum(value) * CAPITALS).otherwise(0.0)

    def after(value: Column, before: Column) -> Column:
        """A value after a look at one of the words before; words that are unknown, or have a weight, change nothing."""
        does = before["word"]["does"]
        pushed = F.when(does["boost"].isNotNull(), (F.signum(value) * does["boost"] + louder(value, before["word"]["loud"])) * before["fade"])
        turned = F.when(does["negation"], NEGATED).otherwise(1.0)
        return F.when(does.isNotNull() & does["weight"].isNull(), (value + F.coalesce(pushed, F.lit(0.0))) * turned).otherwise(value)

    def value(word: Column) -> Column:
        place = word["place"]
        three = F.reverse(F.slice("__words", F.greatest(place - 3, F.lit(1)), F.least(place - 1, F.lit(3))))
        fades = F.array(*[F.lit(f) for f in FADING])
        before = F.transform(three, lambda x, i: F.struct(x.alias("word"), F.get(fades, i).alias("fade")))
        weight = word["does"]["weight"]
        own = F.aggregate(before, weight + louder(weight, word["loud"]), after)
        return own * F.when((split == 0) | (place == split), 1.0).when(place < split, BEFORE).otherwise(BEHIND)

    weighted = F.filter("__words", lambda x: x["does"]["weight"].isNotNull())
    total = F.aggregate(weighted, F.lit(0.0), lambda s, word: s + value(word))
    rows = computed_once(rows, "__total", total)
    content = F.coalesce(F.col(text), F.lit(""))
    marks = lambda sign: F.length(content) - F.length(F.replace(content, F.lit(sign), F.lit("")))
    asked = F.when(marks("?") < 2, 0.0).when(marks("?") <= 3, marks("?") * ASKED).otherwise(ASKED_OFTEN)
    rows = computed_once(rows, "__total", F.col("__total") + F.signum("__total") * (F.least(marks("!"), F.lit(EXCLAMATIONS)) * EXCLAIMED + asked))
    tone = F.col("__total") / F.sqrt(F.col("__total") * F.col("__total") + SQUEEZE)
    return rows.withColumn(out, tone).drop("__words", "__text", "__total")


def lexicon_tone(df: DataFrame, text: str, words: DataFrame, out: str = "tone", rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Append the tone of every text; a text without a weighted word, like a null text, has zero. ``words``: see ``word_table``.

    The word table is counted and measured. Up to ``rows`` and ``size`` bytes it goes along with the tasks: one scan, no shuffle.
    Beyond, every row gets a map of its own words: distinct words per row, numbered by row and salted so that frequent
    words are spread, are joined to the table and collected by row. Both give the same answers to the same fold."""
    known = cut_lineage(words)
    count, used = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word") + 40), F.lit(0))).first()
    entries = F.map_from_entries(F.collect_list(F.struct("word", "info")))
    nothing = F.map_from_entries(F.array().cast(f"array<struct<word:string,info:{_INFO}>>"))
    if count <= rows and used <= size:
        dealt_to = max(1, min(MAPS, count // 4))
        place = F.pmod(F.xxhash64("word"), F.lit(dealt_to)).cast("int").alias("place")
        maps = known.groupBy(place).agg(entries.alias("map")).agg(F.map_from_entries(F.collect_list(F.struct("place", "map"))).alias("maps"))
        dealt = F.transform(F.sequence(F.lit(0), F.lit(dealt_to - 1)), lambda i: F.coalesce(F.try_element_at("maps", i), nothing))
        side = cut_lineage(maps.select(dealt.alias("__known"), F.lit(1).alias("__one")))
        joined = df.withColumn("__one", F.lit(1)).join(F.broadcast(side), "__one").drop("__one")
    else:
        numbered = cut_lineage(df.withColumn("__id", F.monotonically_increasing_id()))
        salt = F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int").alias("__salt")
        found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
        each = numbered.select("__id", salt, F.explode(F.array_distinct(found)).alias("word"))
        spread = known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = each.join(spread, ["word", "__salt"]).groupBy("__id").agg(entries.alias("__known"))
        joined = numbered.join(own, "__id", "left").withColumn("__known", F.array(F.coalesce("__known", nothing))).drop("__id")
    return folded(joined, text, out).select(*df.columns, out)
