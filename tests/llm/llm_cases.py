"""Small tables with every odd row the operators have to stand."""

from pyspark.sql import types as T

CLASHES = ["score", "lang_pred", "spans", "kept", "fingerprint", "component_id", "n_tokens", "ids", "decoded", "shard", "slot",
           "size", "host", "path", "rule", "Verdict", "predicted", "hits", "n_words", "over_limit"]
PROSE = ("The morning train left the old station before anybody had read the news. Two clerks argued about the price of "
         "coffee, and a child counted the bridges on the way to the sea. Nobody on board knew what the day would bring.")
LONG = "".join(f"Sentence {i} of a very long report says that unit {i * 7919 % 1000} was seen near gate {i % 97}. " for i in range(6000))
VARIED = PROSE + (" Later the fog lifted, gulls followed the wagons, and a retired sailor explained every lighthouse between the "
                  "harbour and the cape. His stories were long, partly true, and better than any timetable printed in the capital. "
                  "By noon the conductor had sold all tickets twice, apologised to everybody, and opened a box of oranges.")
TEXTS = [PROSE, PROSE, PROSE.upper(), "", " \n\t ", None, "a", "été ça là où", "日本語 テキスト", "x" * 5000, LONG, "1 2 3\n1 2 3\n1 2 3",
         "don't stop <|endoftext|> now", "\U0001f600\U0001f600 ok ▁ok", PROSE + "\n" + PROSE, VARIED]

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def rows():
    out = [(i, t, ["en", "fr", None][i % 3], f"src{i % 2}", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    return out + [out[0], (None, PROSE, None, None, None), (None, None, None, None, None), (0, "another text under a used id", "en", None, 5)]


def odd_documents(spark, clash=True):
    df = spark.createDataFrame(rows(), SCHEMA)
    if clash:
        from pyspark.sql import functions as F
        df = df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHES])
    return df


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def key(rows_):
    return sorted(rows_, key=lambda r: str(r))
