import datetime
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from forumlens import fixed_values as V
from forumlens import session
from forumlens.operators import profile as P
from forumlens.operators import requests as Q
from forumlens.operators import scoring as K
from forumlens.operators import survey as S
from forumlens.operators.classifiers import character_terms, without_accents, word_terms
from forumlens.plans.k_models import make_rule_scorer
from forumlens.sources import readers, sinks


def test_dates(spark):
    rows = spark.createDataFrame([(40517.0, "28-Jan-2025 21:38:38"), (180110.0, "nonsense"), (None, None), (133199.0, "1-Feb-2025 01:02:03")], "c double, t string")
    out = rows.select(S.parse_day("c", "mddyy").alias("m"), S.parse_day("c", "yymmdd").alias("y"), S.parse_day("t", "atp").alias("t")).collect()
    assert [r["m"] for r in out] == [datetime.date(2017, 4, 5), None, None, None]
    assert [r["y"] for r in out] == [datetime.date(2004, 5, 17), datetime.date(2018, 1, 10), None, None]
    assert [r["t"] for r in out] == [datetime.date(2025, 1, 28), None, None, datetime.date(2025, 2, 1)]


def test_recodes(spark):
    rows = spark.createDataFrame([(18.0, 1), (29.0, 3), (30.0, 5), (64.0, 8), (65.0, 9), (99.0, None), (None, 4)], "a double, e int")
    out = rows.select(S.age_group("a").alias("a"), S.education_group("e").alias("e")).collect()
    assert [r["a"] for r in out] == ["18-29", "18-29", "30-49", "50-64", "65+", None, None]
    assert [r["e"] for r in out] == ["hs_or_less", "hs_or_less", "some_college", "college_grad_plus", None, None, "some_college"]


def test_default_waves_harmonise(spark):
    """Every wave of the default configuration, on two made-up respondents each."""
    sources = {}
    for wave in V.WAVES:
        names = [n for _, n in S.variables(wave)]
        date = {"mddyy": 60817, "yymmdd": 180110, "date": datetime.date(2018, 3, 7), "atp": "28-Jan-2025 21:38:38"}[wave["date_format"]]
        row = {n: 1 for n in names}
        row[wave["date"]] = date
        second = {**row, wave["id"]: 2, wave["weight"]: 3, wave["approval"]: None if wave.get("asked") else 9}
        sources[wave["wave_id"]] = spark.createDataFrame(pd.DataFrame([row, second]))
    resp = S.harmonise(sources)
    assert resp.count() == 2 * 9 - 1 and len(resp.columns) == 15
    quality = {r["wave_id"]: r for r in S.wave_quality(resp).collect()}
    assert quality["Jan18"]["approve_pct"] == 25.0 and quality["Typology17"]["n_respondents"] == 1
    assert {r["rule"]: r["n_bad"] for r in S.respondent_gates(resp).collect()} == {
        "interview date is known": 0, "weight is positive": 0, "respondent is unique in a wave": 0, "fieldwork at most 21 days": 0}
    means = resp.groupBy("wave_id").agg(F.avg("weight_norm").alias("m")).collect()
    assert all(r["m"] == pytest.approx(1) for r in means)


def test_locate():
    assert S.locate("June18.zip", ["June18.zip", "june_18.zip"]) == "June18.zip"
    assert S.locate("Apr17-public-4_3.zip", ["apr17 public 4.3 ZIP", "x"]) == "apr17 public 4.3 ZIP"
    with pytest.raises(FileNotFoundError):
        S.locate("May18", ["Jun18"])


def test_low_cardinality(spark):
    rows = spark.range(1000).select((F.col("id") % 5).cast("string").alias("five"), (F.col("id") % 6).cast("string").alias("six"),
                                    F.when(F.col("id") % 2 == 0, "0.0").alias("flag"), F.lit("x").alias("same"))
    found = {r["column_name"]: r for r in P.low_cardinality_scan(rows, rows.columns).collect()}
    assert set(found) == {"five", "flag", "same"}
    assert found["flag"]["bool_like"] and found["flag"]["null_pct"] == 50.0 and not found["same"]["bool_like"]
    assert [r["column_name"] for r in P.constant_columns(rows, rows.columns).collect()] == ["flag", "same"]
    assert P.low_cardinality_scan(rows.select("six"), ["six"]).count() == 0


def test_type_repair(spark):
    rows = spark.createDataFrame([(" True", "1", None), ("false ", "True", None), (None, "x", None)], "a string, b string, c string")
    fixed = P.repair_types(rows, ["a", "b", "c"])
    assert dict(fixed.dtypes)["a"] == "boolean" and dict(fixed.dtypes)["b"] == "string"
    assert [r["a"] for r in fixed.collect()] == [True, False, None]


def test_month_files_round_trip(spark):
    rows = spark.createDataFrame([("a", ' "q", \n x ', "2017-01"), ("b", None, "2017-01"), ("c", "", "2018-02")], "id string, body string, source_month string")
    path = sinks.write_month_csv(rows, session.new_table_path(spark, "t"))
    back = readers.read_month_files(spark, path + "/*", readers.text_schema(["id", "body"])).select("id", "body", readers.source_month().alias("m"))
    assert sorted((r["id"], r["body"], r["m"]) for r in back.collect()) == [("a", ' "q", \n x ', "2017-01"), ("b", None, "2017-01"), ("c", None, "2018-02")]
    assert [r["source_month"] for r in sinks.empty_months(rows, ["2017-01", "2017-02"]).collect()] == ["2017-02"]
    with pytest.raises(FileNotFoundError):
        readers.read_month_files(spark, path + "/nothing-*", readers.text_schema(["id"]))


def test_month_without_rows_gets_a_header(spark):
    rows = spark.createDataFrame([("a", "x", "2017-01")], "id string, body string, source_month string")
    path = sinks.write_month_csv(rows, session.new_table_path(spark, "t"), months=["2017-01", "2017-02"])
    assert sorted(r[0] for r in sinks.written_months(spark, path).collect()) == ["2017-01", "2017-02"]
    text = spark.read.text(f"{path}/source_month=2017-02").collect()
    assert [r["value"] for r in text] == ["id,body"]
    assert readers.read_month_files(spark, path + "/*", readers.text_schema(["id", "body"])).count() == 1


def test_resume_knows_rows_with_null_keys(spark):
    path = session.new_table_path(spark, "answers")
    work = spark.createDataFrame([("a",), (None,)], "id string")
    for _ in range(3):
        assert sinks.resume(work, path, ["id"], lambda df: df.withColumn("n", F.lit(1)), "v", "1").count() == 2


def test_resume_scores_each_row_once_and_checks_settings(spark):
    path = session.new_table_path(spark, "answers")
    work = spark.range(10).select(F.concat(F.lit("c"), "id").alias("id"))
    make = lambda df: df.withColumn("n", F.length("id"))
    sinks.resume(work.limit(4), path, ["id"], make, "prompt_version", "v1")
    assert sinks.resume(work, path, ["id"], make, "prompt_version", "v1").count() == 10
    with pytest.raises(sinks.SettingsError):
        sinks.resume(work, path, ["id"], make, "prompt_version", "v2")


def test_answers(spark):
    rows = spark.createDataFrame([
        ("pro", '{"top":[{"token":"pro","logprob":-0.5},{"token":"against","logprob":-1.5},{"token":"x","logprob":0}]}'),
        ("PRO ", '{"top":[]}'), ("neutral", None)], "raw_output string, answer_json string")
    got = Q.parse_answers(rows).collect()
    a, b = math.exp(-0.5), math.exp(-1.5)
    assert got[0]["p_pro"] == pytest.approx(a / (a + b)) and got[0]["p_neutral"] == 0 and got[0]["score"] == pytest.approx((a - b) / (a + b))
    assert got[1]["label"] == "error" and got[1]["p_pro"] is None and got[2]["label"] == "neutral"
    assert [r["raw_output"] for r in Q.error_rows(Q.parse_answers(rows)).collect()] == ["PRO "]


def test_prompt_fingerprint_gate():
    messages = Q.static_messages("system é", [("a", "pro")])
    assert len(messages) == 3
    assert Q.require_prompt(messages, Q.prompt_fingerprint(messages)) is messages
    with pytest.raises(ValueError):
        Q.require_prompt(messages[:1], Q.prompt_fingerprint(messages))


def test_scoring_skips_rows_and_keeps_the_rest(spark):
    rows = spark.createDataFrame([(1, "the the not", False), (2, "the", True), (3, None, False)], "id int, t string, q boolean")
    got = {r["id"]: r for r in K.with_label(rows, "t", F.col("q"), make_rule_scorer).collect()}
    assert got[1]["student_label"] == "pro" and got[1]["student_p_pro"] == pytest.approx(0.5)
    assert got[2]["student_label"] is None and got[3]["student_p_against"] is None


def grams(text):
    out = []
    for word in text.lower().split():
        padded = f" {word} "
        for n in range(3, 6):
            out += [padded[i:i + n] for i in range(max(len(padded) - n + 1, 1))]
            if len(padded) <= n:
                break
    return out


def test_terms(spark):
    rows = spark.createDataFrame([("A café in Paris", ), ("x", ), ("", )], "t string")
    got = rows.select(word_terms(F.col("t")).alias("w"), character_terms(F.col("t")).alias("c")).collect()
    assert got[0]["w"] == ["cafe", "in", "paris", "cafe in", "in paris"] and got[1]["w"] == [] and got[2]["w"] == []
    assert [sorted(r["c"]) for r in got] == [sorted(grams(t)) for t in ("A café in Paris", "x", "")]
    assert rows.select(without_accents(F.lit("Åéł")).alias("a")).first()["a"] == "Aeł"
