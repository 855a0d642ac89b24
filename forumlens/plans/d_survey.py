"""Survey waves and polls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from forumlens import fixed_values as V
from forumlens import session
from forumlens.operators import codebook as C
from forumlens.operators import polls
from forumlens.operators import profile as P
from forumlens.operators import survey as S
from forumlens.plans import book as B
from forumlens.plans import fixtures as X

BOOK = B.Book()
add = BOOK.add

# the waves of the test tables; in the second wave the strength question stands in for a filter
WAVES = [
    {"wave_id": "A17", "family": "phone", "id": "rid", "weight": "weight", "approval": "q_appr", "strength": "q_str",
     "asked": "q_appr", "date": "date_code", "date_format": "mddyy", "party": "party", "ideology": "ideo",
     "gender": "sex", "age": "age", "education": "educ"},
    {"wave_id": "B18", "family": "phone", "id": "rid", "weight": "weight", "approval": "q_appr", "strength": None,
     "date": "date_code", "date_format": "yymmdd", "party": "party", "ideology": "ideo", "gender": "sex",
     "age": "age", "education": "educ"},
    {"wave_id": "P25", "family": "panel", "id": "rid", "weight": "weight", "approval": "q_appr", "strength": "q_str",
     "date": "date_text", "date_format": "atp", "party": "party", "ideology": "ideo", "gender": "sex",
     "age_category": "agecat", "education_category": "educ", "mode": "sex"},
]
ORDER = ["A17", "B18", "P25"]


def waves_of(raw):
    return {w["wave_id"]: raw.filter(F.col("wave_id") == w["wave_id"]) for w in WAVES}


def respondents(spark, sf_dir, weights=False):
    return S.harmonise(waves_of(X.svy_raw(spark, sf_dir)), WAVES, weights)


_APPR = "CASE q_appr WHEN 1 THEN 'approve' WHEN 2 THEN 'disapprove' WHEN 9 THEN 'dk' WHEN 99 THEN 'dk' END"
_STR = "CASE q_str WHEN 1 THEN 'very_strongly' WHEN 2 THEN 'not_so_strongly' WHEN 9 THEN 'dk' WHEN 99 THEN 'dk' END"
_AGE = "CASE WHEN age IS NULL OR age >= 99 THEN NULL WHEN age <= 29 THEN '18-29' WHEN age <= 49 THEN '30-49' WHEN age <= 64 THEN '50-64' ELSE '65+' END"
_AGECAT = "CASE agecat WHEN 1 THEN '18-29' WHEN 2 THEN '30-49' WHEN 3 THEN '50-64' WHEN 4 THEN '65+' END"
_EDUC = "CASE WHEN educ IS NULL OR educ >= 9 THEN NULL WHEN educ <= 3 THEN 'hs_or_less' WHEN educ <= 5 THEN 'some_college' ELSE 'college_grad_plus' END"
_EDUCCAT = "CASE educ WHEN 1 THEN 'college_grad_plus' WHEN 2 THEN 'some_college' WHEN 3 THEN 'hs_or_less' END"
_MDY = "try_cast('20' || right(six, 2) || '-' || left(six, 2) || '-' || substr(six, 3, 2) AS DATE)"
_YMD = "try_cast('20' || left(six, 2) || '-' || substr(six, 3, 2) || '-' || right(six, 2) AS DATE)"
SIX = ("six_raw", "SELECT *, lpad(CAST(date_code AS VARCHAR), 6, '0') AS six FROM svy_raw")
RESP = (
    SIX,
    ("resp0", f"""
      SELECT wave_id, family AS source_family, CAST(CAST(rid AS BIGINT) AS VARCHAR) AS orig_id,
        CASE WHEN wave_id = 'A17' THEN {_MDY} WHEN wave_id = 'B18' THEN {_YMD}
             ELSE CAST(try_strptime(date_text, '%d-%b-%Y %H:%M:%S') AS DATE) END AS interview_date,
        CASE WHEN family = 'phone' THEN 'phone' ELSE CASE sex WHEN 1 THEN 'atp_web' WHEN 2 THEN 'atp_phone' END END AS mode,
        {_APPR} AS approval, CASE WHEN wave_id <> 'B18' THEN {_STR} END AS approval_strength,
        CASE party WHEN 1 THEN 'rep_lean' WHEN 2 THEN 'dem_lean' WHEN 9 THEN 'other_dk' END AS party_lean,
        CASE ideo WHEN 1 THEN 'very_conservative' WHEN 2 THEN 'conservative' WHEN 3 THEN 'moderate' WHEN 4 THEN 'liberal' WHEN 5 THEN 'very_liberal' END AS ideology,
        CASE sex WHEN 1 THEN 'man' WHEN 2 THEN 'woman' END AS gender,
        CASE WHEN age < 99 THEN CAST(age AS DOUBLE) END AS age,
        CASE WHEN family = 'phone' THEN {_AGE} ELSE {_AGECAT} END AS age_group,
        CASE WHEN family = 'phone' THEN {_EDUC} ELSE {_EDUCCAT} END AS education,
        weight AS weight_raw
      FROM six_raw WHERE wave_id <> 'A17' OR q_appr IS NOT NULL"""),
    ("resp", "SELECT *, weight_raw / avg(weight_raw) OVER (PARTITION BY wave_id) AS weight_norm FROM resp0"),
)


def resp_sql(body: str, *more) -> str:
    return X.oracle("svy_raw", body, *RESP, *more)


@add("d01_code_to_category", X.oracle("svy_raw", f"SELECT wave_id, {_APPR} AS approval, {_STR} AS strength, count(*) AS n FROM svy_raw GROUP BY 1, 2, 3"))
def d01(spark, sf_dir):
    return X.svy_raw(spark, sf_dir).groupBy(
        "wave_id", S.code_label("q_appr", V.APPROVAL).alias("approval"), S.code_label("q_str", V.STRENGTH).alias("strength")
    ).agg(F.count(F.lit(1)).alias("n"))


@add("d02_education_groups", X.oracle("svy_raw", f"SELECT CAST(rid AS BIGINT) AS rid, {_EDUC} AS education FROM svy_raw"))
def d02(spark, sf_dir):
    return X.svy_raw(spark, sf_dir).select(F.col("rid").cast("bigint").alias("rid"), S.education_group("educ").alias("education"))


@add("d03_age_groups", X.oracle("svy_raw", f"SELECT CAST(rid AS BIGINT) AS rid, {_AGE} AS age_group FROM svy_raw"))
def d03(spark, sf_dir):
    return X.svy_raw(spark, sf_dir).select(F.col("rid").cast("bigint").alias("rid"), S.age_group("age").alias("age_group"))


@add("d04_bin_check", resp_sql("SELECT count(*) AS rows, count(*) FILTER (WHERE age_group IS DISTINCT FROM CASE WHEN age > 17 AND age <= 29 THEN '18-29' WHEN age > 29 AND age <= 49 THEN '30-49' WHEN age > 49 AND age <= 64 THEN '50-64' WHEN age > 64 AND age <= 120 THEN '65+' END) AS mismatches FROM resp WHERE age IS NOT NULL"))
def d04(spark, sf_dir):
    return S.bin_check(respondents(spark, sf_dir))


@add("d05_date_parse", X.oracle("svy_raw", f"""
    SELECT CAST(rid AS BIGINT) AS rid, CAST({_MDY} AS VARCHAR) AS mddyy, CAST({_YMD} AS VARCHAR) AS yymmdd,
      CAST(CAST(try_strptime(date_text, '%d-%b-%Y %H:%M:%S') AS DATE) AS VARCHAR) AS stamp,
      CAST(DATE '2017-01-01' + CAST(rid % 700 AS INTEGER) AS VARCHAR) AS typed FROM six_raw""", SIX))
def d05(spark, sf_dir):
    return X.svy_raw(spark, sf_dir).select(
        F.col("rid").cast("bigint").alias("rid"), S.parse_day("date_code", "mddyy").cast("string").alias("mddyy"),
        S.parse_day("date_code", "yymmdd").cast("string").alias("yymmdd"), S.parse_day("date_text", "atp").cast("string").alias("stamp"),
        # a wave whose file already types the column, at the start of its day
        S.parse_day(F.to_timestamp(F.date_add(F.lit("2017-01-01").cast("date"), (F.col("rid") % 700).cast("int"))), "date").cast("string").alias("typed"))


@add("d06_date_style", X.oracle("svy_raw", """
    SELECT wave_id, 'mddyy' AS style, count(*) FILTER (WHERE m IS NULL) AS not_parsed, CAST(min(m) AS VARCHAR) AS earliest, CAST(max(m) AS VARCHAR) AS latest FROM p GROUP BY 1
    UNION ALL SELECT wave_id, 'yymmdd', count(*) FILTER (WHERE y IS NULL), CAST(min(y) AS VARCHAR), CAST(max(y) AS VARCHAR) FROM p GROUP BY 1""",
    SIX, ("p", f"SELECT wave_id, {_MDY} AS m, {_YMD} AS y FROM six_raw WHERE date_code IS NOT NULL")))
def d06(spark, sf_dir):
    return S.date_styles(X.svy_raw(spark, sf_dir), "wave_id", "date_code")


@add("d07_id_text", X.oracle("svy_raw", "SELECT wave_id, CAST(CAST(rid AS BIGINT) AS VARCHAR) AS orig_id FROM svy_raw"))
def d07(spark, sf_dir):
    raw = X.svy_raw(spark, sf_dir)
    return raw.select("wave_id", S.id_text("rid", dict(raw.dtypes)["rid"]).alias("orig_id"))


RESP_OUT = """wave_id, source_family, orig_id, CAST(interview_date AS VARCHAR) AS interview_date, mode, approval, approval_strength,
    party_lean, ideology, gender, age, age_group, education, round(weight_raw, 6) AS weight_raw, round(weight_norm, 6) AS weight_norm"""


def printable(resp):
    return resp.withColumns({"interview_date": F.col("interview_date").cast("string"),
                             "weight_raw": F.round("weight_raw", 6), "weight_norm": F.round("weight_norm", 6)})


@add("d08_harmonise_waves", resp_sql(f"SELECT {RESP_OUT} FROM resp"))
def d08(spark, sf_dir):
    return printable(respondents(spark, sf_dir, weights=True))


@add("d09_asked_only", X.oracle("svy_raw", "SELECT wave_id, count(*) AS rows, count(q_appr) AS asked FROM svy_raw GROUP BY 1"))
def d09(spark, sf_dir):
    raw = X.svy_raw(spark, sf_dir)
    return raw.groupBy("wave_id").agg(F.count(F.lit(1)).alias("rows"), F.count("q_appr").alias("asked"))


@add("d10_weight_normalisation", resp_sql("SELECT wave_id, orig_id, round(weight_norm, 6) AS weight_norm FROM resp"))
def d10(spark, sf_dir):
    raw = X.svy_raw(spark, sf_dir)
    kept = raw.filter((F.col("wave_id") != "A17") | F.col("q_appr").isNotNull()).select(
        "wave_id", S.id_text("rid", "double").alias("orig_id"), F.col("weight").alias("weight_raw"))
    return S.normalised_weights(kept).select("wave_id", "orig_id", F.round("weight_norm", 6).alias("weight_norm"))


# columns of the raw table as a codebook: wave, ordinal, variable, question text, answer labels
COLUMNS = ["rid", "weight", "q_appr", "q_str", "date_code", "date_text", "age", "agecat", "educ", "party", "ideo", "sex"]
TEXTS = {
    "rid": ("Unique respondent id", ""), "weight": ("Final weight", ""),
    "q_appr": ("Q.1 Do you approve or disapprove of the way the president is handling his job?", "approve; disapprove"),
    "q_str": ("QA1a Do you feel that way very strongly or not so strongly?", "Very strongly; Not so strongly"),
    "date_code": ("Interview date", ""), "date_text": ("Interview start", ""), "age": ("Q5 What is your age?", ""),
    "agecat": ("Age in four groups", ""), "educ": ("Highest level of school", ""), "party": ("Party summary", ""),
    "ideo": ("Ideology", ""), "sex": ("Sex", "")}


def codebook(spark, sf_dir):
    """Every variable that has a value in a wave, with its texts attached."""
    raw = X.svy_raw(spark, sf_dir)
    book = P.codebook(raw, "wave_id", COLUMNS).withColumnRenamed("wave_id", "wave").filter("unique_values > 0")
    texts = spark.createDataFrame([(c, i + 1, *TEXTS[c]) for i, c in enumerate(COLUMNS)],
                                  "variable string, ordinal int, question string, answers string")
    return book.join(F.broadcast(texts), "variable")


_PAIRS = " UNION ALL ".join(f"SELECT wave_id, '{c}' AS variable, CAST({c} AS VARCHAR) AS v FROM svy_raw" for c in COLUMNS)
_TEXTS = " UNION ALL ".join("SELECT '{}' AS variable, {} AS ordinal, '{}' AS question, '{}' AS answers".format(c, i + 1, *[t.replace("'", "''") for t in TEXTS[c]])
                            for i, c in enumerate(COLUMNS))
CODEBOOK = (("long", _PAIRS),
            ("profile", "SELECT wave_id, variable, count(DISTINCT v) AS unique_values, round(100.0 * (count(*) - count(v)) / count(*), 1) AS missing_pct FROM long GROUP BY 1, 2"),
            ("texts", _TEXTS),
            ("bookt", "SELECT wave_id AS wave, p.variable, unique_values, missing_pct, ordinal, question, answers FROM profile p JOIN texts t ON p.variable = t.variable WHERE unique_values > 0"))
_WALK_ROWS = [(w["wave_id"], role, name) for w in WAVES for role, name in S.variables(w)]
WALK = ("walk", " UNION ALL ".join(f"SELECT '{a}' AS wave_id, '{b}' AS role, '{c}' AS raw_variable" for a, b, c in _WALK_ROWS))


def book_sql(body: str, *more) -> str:
    return X.oracle("svy_raw", body, *CODEBOOK, *more)


def walk(spark):
    return S.crosswalk(spark, WAVES, {(w["wave_id"], c): TEXTS[c][0] for w in WAVES for c in COLUMNS})


@add("d11_crosswalk", book_sql("SELECT w.wave_id, max(CASE WHEN role = 'approval' THEN w.raw_variable END) AS approval, max(CASE WHEN role = 'date' THEN w.raw_variable END) AS date, max(CASE WHEN role = 'strength' THEN w.raw_variable END) AS strength, count(*) AS roles, count(b.variable) AS filled FROM walk w LEFT JOIN bookt b ON w.wave_id = b.wave AND w.raw_variable = b.variable GROUP BY 1", WALK))
def d11(spark, sf_dir):
    found = codebook(spark, sf_dir).select(F.col("wave").alias("wave_id"), F.col("variable").alias("raw_variable"), F.lit(1).alias("here"))
    joined = walk(spark).join(found, ["wave_id", "raw_variable"], "left")
    role = lambda r: F.max(F.when(F.col("role") == r, F.col("raw_variable"))).alias(r)
    return joined.groupBy("wave_id").agg(role("approval"), role("date"), role("strength"),
                                         F.count(F.lit(1)).alias("roles"), F.count("here").alias("filled"))


@add("d12_wave_quality", resp_sql("""
    SELECT wave_id, CAST(min(interview_date) AS VARCHAR) AS field_start, CAST(max(interview_date) AS VARCHAR) AS field_end, count(*) AS n_respondents,
      count(approval) AS n_asked_approval,
      round(100 * sum(CASE WHEN approval = 'approve' THEN weight_raw ELSE 0 END) / sum(CASE WHEN approval IS NOT NULL THEN weight_raw END), 6) AS approve_pct FROM resp GROUP BY 1"""))
def d12(spark, sf_dir):
    return S.wave_quality(respondents(spark, sf_dir))


@add("d13_respondent_gates", resp_sql("""
    SELECT 'interview date is known' AS rule, count(*) FILTER (WHERE interview_date IS NULL) AS n_bad FROM resp
    UNION ALL SELECT 'weight is positive', count(*) FILTER (WHERE NOT coalesce(weight_raw > 0, false)) FROM resp
    UNION ALL SELECT 'respondent is unique in a wave', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM resp GROUP BY wave_id, orig_id)
    UNION ALL SELECT 'fieldwork at most 21 days', count(*) FILTER (WHERE days > 21) FROM (SELECT date_diff('day', min(interview_date), max(interview_date)) AS days FROM resp GROUP BY wave_id)"""))
def d13(spark, sf_dir):
    return S.respondent_gates(respondents(spark, sf_dir))


@add("d14_codebook", X.oracle("svy_raw", "SELECT * FROM profile", *CODEBOOK[:2]))
def d14(spark, sf_dir):
    return P.codebook(X.svy_raw(spark, sf_dir), "wave_id", COLUMNS)


@add("d15_name_overlap", book_sql("""
    SELECT count(*) AS names, count(*) FILTER (WHERE w = 3) AS in_all_waves, count(*) FILTER (WHERE ph = 2) AS shared_by_phone, count(*) FILTER (WHERE pa = 1) AS shared_by_panel,
      count(*) FILTER (WHERE ph > 0 AND pa > 0) AS in_every_family, count(*) FILTER (WHERE w = 1) AS in_one_wave, count(*) FILTER (WHERE w >= 2) AS in_two_or_more, count(*) FILTER (WHERE w >= 5) AS in_five_or_more
    FROM (SELECT lower(variable) AS name, count(DISTINCT wave) AS w, count(DISTINCT wave) FILTER (WHERE wave IN ('A17', 'B18')) AS ph, count(DISTINCT wave) FILTER (WHERE wave = 'P25') AS pa FROM bookt GROUP BY 1)"""))
def d15(spark, sf_dir):
    return S.name_overlap(codebook(spark, sf_dir), {"phone": ["A17", "B18"], "panel": ["P25"]})


IDS = ["wave", "variable", "ordinal"]
_PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_ASKED, _ANSWERED = ["an", "e e"], ["ti", "en e"]


def _holds(column: str, phrases: list[str]) -> str:
    return " AND ".join(f"contains({_PLAIN.format(column)}, '{p}')" for p in phrases)


def index_of(spark, sf_dir, text):
    return C.write_index(X.items(spark, sf_dir), text, IDS, session.new_table_path(spark, f"index-{text}"))


@add("d16_question_search", X.oracle("items", f"SELECT wave, count(*) AS n, min(variable) AS first_name FROM items WHERE {_holds('question', _ASKED)} GROUP BY 1"))
def d16(spark, sf_dir):
    """Questions that hold a word part and a phrase over two words, by the index."""
    return C.search(spark, index_of(spark, sf_dir, "question"), IDS, _ASKED).groupBy("wave").agg(
        F.count(F.lit(1)).alias("n"), F.min("variable").alias("first_name"))


_KEYED = ("keyed", "SELECT wave, variable, ordinal, regexp_replace(trim(regexp_replace(regexp_replace(lower(question), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), '^((qa?|[a-z]*[0-9][a-z0-9]*)( |$))+', '') AS k FROM items")


@add("d17_question_key", X.oracle("items", "SELECT array_to_string(list_slice(string_split(k, ' '), 1, 2), ' ') AS key, count(DISTINCT wave) AS n_waves, count(*) AS n, arg_min(variable, (ordinal, variable)) AS first_variable FROM keyed GROUP BY 1", _KEYED))
def d17(spark, sf_dir):
    """Questions that begin alike, matched across the waves."""
    return C.keys_across_waves(X.items(spark, sf_dir), words=2)


@add("d18_follow_up", X.oracle("items", f"""SELECT i.wave, arg_min(variable, (ordinal, variable)) AS follow_up FROM items i
    JOIN (SELECT wave, min(ordinal) AS main_ordinal FROM items WHERE {_holds('question', _ASKED[:1])} GROUP BY 1) m ON i.wave = m.wave AND i.ordinal > m.main_ordinal
    WHERE {_holds('answers', _ANSWERED)} GROUP BY 1"""))
def d18(spark, sf_dir):
    main = C.search(spark, index_of(spark, sf_dir, "question"), IDS, _ASKED[:1]).groupBy("wave").agg(F.min("ordinal").alias("main_ordinal"))
    return C.follow_up(spark, index_of(spark, sf_dir, "answers"), IDS, _ANSWERED, main)


@add("d19_unique_id_candidate", X.oracle("svy_raw", "SELECT wave_id, variable, count(*) = count(DISTINCT v) + CASE WHEN count(*) - count(v) = 1 THEN 1 ELSE 0 END AS all_different FROM long WHERE variable IN ('rid', 'weight', 'date_code') GROUP BY 1, 2", CODEBOOK[0]))
def d19(spark, sf_dir):
    return S.unique_candidates(X.svy_raw(spark, sf_dir), "wave_id", ["rid", "weight", "date_code"])


@add("d20_names_matching", X.oracle("svy_raw items", """SELECT wave, string_agg(variable, ', ' ORDER BY variable) AS variables_found
    FROM (SELECT wave, variable FROM bookt UNION ALL SELECT wave, variable FROM items) WHERE regexp_matches(variable, '(?i)^(date|age)') GROUP BY 1""", *CODEBOOK))
def d20(spark, sf_dir):
    """Of the variables with a value in a survey wave and of the questions that users ask: per wave, the list of matching names."""
    book = codebook(spark, sf_dir).select("wave", "variable").unionByName(X.items(spark, sf_dir).select("wave", "variable"))
    return S.names_matching(book, "date|age")


@add("d21_kept_summary", book_sql("""
    SELECT wave, count(*) AS total, count(r.v) AS kept, count(*) - count(r.v) AS dropped, round(100.0 * count(r.v) / count(*), 1) AS kept_pct
    FROM bookt b LEFT JOIN (SELECT DISTINCT wave_id, raw_variable AS v FROM walk) r ON b.wave = r.wave_id AND b.variable = r.v GROUP BY 1""", WALK))
def d21(spark, sf_dir):
    return S.kept_summary(codebook(spark, sf_dir), walk(spark))


_PANEL = ("panel", "SELECT 'W1' AS wave_id, rid AS orig_id FROM svy_raw WHERE sex = 1 UNION ALL SELECT 'W2', rid FROM svy_raw WHERE party <> 9")


@add("d22_panel_overlap", X.oracle("svy_raw", """SELECT CAST(sum(a) AS BIGINT) AS in_first, CAST(sum(b) AS BIGINT) AS in_second, CAST(sum(a * b) AS BIGINT) AS in_both
    FROM (SELECT orig_id, max(CASE WHEN wave_id = 'W1' THEN 1 ELSE 0 END) AS a, max(CASE WHEN wave_id = 'W2' THEN 1 ELSE 0 END) AS b FROM panel GROUP BY 1)""", _PANEL))
def d22(spark, sf_dir):
    raw = X.svy_raw(spark, sf_dir)
    first = raw.filter("sex = 1").select(F.lit("W1").alias("wave_id"), F.col("rid").alias("orig_id"))
    second = raw.filter("party <> 9").select(F.lit("W2").alias("wave_id"), F.col("rid").alias("orig_id"))
    return S.panel_overlap(first.unionByName(second), "W1", "W2")


# --- polls -----------------------------------------------------------------------------------------
DATES = ["d1995", "d1996", "d1997", "d1998"]
MEASURES = {"F": "approve", "O": "disapprove", "P": "not_sure"}


def poll_rows(spark, sf_dir):
    """Counts per date and group, as shares of the group's total."""
    long = polls.sheet_to_rows(X.poll_wide(spark, sf_dir), "grp", "measure", DATES, MEASURES, "sheet_date")
    counts = long.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("double") for c in polls.SHARES})
    base = reduce(lambda a, b: a + b, [F.col(c) for c in polls.SHARES])
    return counts.withColumn("base", base).withColumns({
        **{c: F.try_divide(F.col(c), base) for c in polls.SHARES}, "unweighted_base": F.col("base")})


_CELL = " UNION ALL ".join(f"SELECT '{d}' AS sheet_date, grp, measure, {d} AS v FROM poll_wide" for d in DATES)
POLL = (("cells", _CELL),
        ("poll0", 'SELECT sheet_date, grp AS "group", ' + ", ".join(f"coalesce(max(CASE WHEN measure = '{m}' THEN v END), 0)::DOUBLE AS {n}" for m, n in MEASURES.items()) + " FROM cells GROUP BY 1, 2"),
        ("poll", 'SELECT sheet_date, "group", approve / nullif(b, 0) AS approve, disapprove / nullif(b, 0) AS disapprove, not_sure / nullif(b, 0) AS not_sure, b AS base, b AS unweighted_base FROM (SELECT *, approve + disapprove + not_sure AS b FROM poll0)'))


def poll_sql(body: str, *more) -> str:
    return X.oracle("poll_wide", body, *POLL, *more)


@add("d23_poll_gates", poll_sql("""
    SELECT 'shares lie in 0 to 1' AS rule, count(*) FILTER (WHERE NOT coalesce(approve BETWEEN 0 AND 1 AND disapprove BETWEEN 0 AND 1 AND not_sure BETWEEN 0 AND 1, false)) AS n_bad FROM poll
    UNION ALL SELECT 'shares sum to 1', count(*) FILTER (WHERE NOT coalesce(abs(approve + disapprove + not_sure - 1) <= 0.010001, false)) FROM poll
    UNION ALL SELECT 'bases are positive', count(*) FILTER (WHERE NOT coalesce(base > 0, false)) FROM poll
    UNION ALL SELECT 'nothing is missing', count(*) FILTER (WHERE approve IS NULL OR disapprove IS NULL OR not_sure IS NULL) FROM poll
    UNION ALL SELECT 'key is unique', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM poll GROUP BY sheet_date, "group")"""))
def d23(spark, sf_dir):
    return polls.share_gates(poll_rows(spark, sf_dir), ["sheet_date", "group"])
