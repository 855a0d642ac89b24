"""Requests, answers, scoring and classifiers."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import functions as F

from forumlens import fixed_values as V
from forumlens.functions import flags as G
from forumlens.functions import text as T
from forumlens.operators import classifiers as M
from forumlens.operators import requests as Q
from forumlens.operators import sampling
from forumlens.operators import scoring as S
from forumlens.operators.quantiles import exact_quantiles
from forumlens.operators.staging import computed_once
from forumlens.operators.subwords import token_length
from forumlens.operators.threads import join_validated
from forumlens.operators.tone import lexicon_tone
from forumlens.plans import book as B
from forumlens.session import cut_lineage
from forumlens.plans import fixtures as X
from forumlens.plans.f_joins import CONTEXT, placed
from forumlens.plans.i_sampling import FOLDS, WEIGHTED, folded, weighted
from forumlens.sources.readers import rows_with_ids

BOOK = B.Book()
add = BOOK.add


# --- classifiers -----------------------------------------------------------------------------------
def labelled_texts(spark, sf_dir):
    """Texts with their label and split; threads stay whole. Written once, as fits and tests read them."""
    texts = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), "text")
    return cut_lineage(folded(spark, sf_dir).select("k", "id", "final", "split").join(texts, "k"))


def train_and_test(spark, sf_dir, kind):
    """Rows per side of the split; number, occurrences and digest of the terms, in order; whether the gradient at the solution
    is below a ten-thousandth of its length at the start, and whether the test rows are told apart better than by the most
    frequent label of the training rows."""
    rows = labelled_texts(spark, sf_dir)
    train, rest = rows.filter("split = 'train'"), rows.filter("split <> 'train'")
    fitted = M.TextClassifier(kind).fit(train, "text", "final")
    found = M.evaluate(fitted.predict(rest, "text"), "final")
    usual = train.groupBy("final").count().orderBy(F.desc("count"), "final").first()["final"]
    plain = M.evaluate(rest.withColumn("predicted", F.lit(usual)), "final").first()["macro_f1"]
    number = lambda n: F.lit(n).cast("bigint")
    return found.select(number(fitted.rows).alias("train_rows"), F.col("n").alias("test_rows"), number(len(fitted.known)).alias("terms"),
                        number(sum(n for _, n, _ in fitted.known)).alias("occurrences"), number(sum(n for _, _, n in fitted.known)).alias("rows_with_terms"),
                        F.lit(hashlib.sha256("\n".join(t for t, _, _ in fitted.known).encode()).hexdigest()).alias("vocabulary"),
                        F.lit(bool((fitted.gradient <= 1e-4).all())).alias("converged"), (F.col("macro_f1") > plain).alias("beats_majority"))


MARKED, PLAIN_LETTERS = M.accents()
TEXTS = ("texts", "SELECT f.k, f.final, f.split, d.text FROM folded f JOIN documents d ON f.k = d.doc_id")
# the terms of a training text: words and pairs of neighbours, or pieces of 3 to 5 characters inside padded words
WORDS = (("lists", f"SELECT k, regexp_extract_all(lower(translate(text, '{MARKED}', '{PLAIN_LETTERS}')), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM texts WHERE split = 'train'"),
         ("terms", "SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM lists"))
PIECES = (("padded", f"SELECT k, ' ' || unnest(list_filter(string_split_regex({B.sql_strip('lower(text)')}, '{B.WS}+'), lambda x: x <> '')) || ' ' AS w FROM texts WHERE split = 'train'"),
          ("terms", "SELECT k, substr(w, CAST(i AS BIGINT), CAST(n AS BIGINT)) AS term FROM (SELECT k, w, n, unnest(range(1, greatest(length(w) - n + 1, 1) + 1)) AS i FROM (SELECT k, w, unnest(range(3, least(5, greatest(3, length(w))) + 1)) AS n FROM padded))"))


def model_sql(terms: tuple, limits: str) -> str:
    chosen = ("chosen", f"""SELECT term, count(*) AS n, count(DISTINCT k) AS rows FROM terms GROUP BY term HAVING {limits}
        ORDER BY n DESC, term LIMIT 120000""")
    return X.oracle("rate", """SELECT count(*) FILTER (WHERE split = 'train') AS train_rows, count(*) FILTER (WHERE split <> 'train') AS test_rows,
      (SELECT count(*) FROM chosen) AS terms, (SELECT CAST(sum(n) AS BIGINT) FROM chosen) AS occurrences, (SELECT CAST(sum(rows) AS BIGINT) FROM chosen) AS rows_with_terms,
      (SELECT sha256(string_agg(term, chr(10) ORDER BY n DESC, term)) FROM chosen) AS vocabulary, true AS converged, true AS beats_majority FROM folded""", *FOLDS, TEXTS, *terms, chosen)


@add("k01_word_classifier", model_sql(WORDS, "count(DISTINCT k) >= 3 AND count(DISTINCT k) <= 0.995 * (SELECT count(*) FROM lists)"))
def k01(spark, sf_dir):
    return train_and_test(spark, sf_dir, "word")


@add("k02_character_classifier", model_sql(PIECES, "count(DISTINCT k) >= 5"))
def k02(spark, sf_dir):
    return train_and_test(spark, sf_dir, "character")


@add("k03_selection_and_refit", X.oracle("rate", """SELECT model, part, n, true AS above_chance, chosen FROM (
    SELECT unnest(['word', 'character']) AS model, 'validation' AS part, count(*) FILTER (WHERE split = 'validation') AS n, NULL::BOOLEAN AS chosen FROM folded
    UNION ALL SELECT 'best', 'test', count(*) FILTER (WHERE split = 'test'), true FROM folded)""", *FOLDS))
def k03(spark, sf_dir):
    """Which model is chosen depends on the fit; that it is the best one on the validation rows does not."""
    rows = labelled_texts(spark, sf_dir)
    part = lambda name: rows.filter(F.col("split") == name)
    found = cut_lineage(M.select_and_refit(part("train"), part("validation"), part("test"), "text", "final",
                                           {k: M.TextClassifier(k) for k in ("word", "character")}))
    best = found.filter("part = 'validation'").agg(F.max(F.struct("macro_f1", "model"))["model"].alias("m")).first()["m"]
    tested = F.col("part") == "test"
    return found.select(F.when(tested, "best").otherwise(F.col("model")).alias("model"), "part", "n",
                        (F.col("macro_f1") > 0.25).alias("above_chance"), F.when(tested, F.col("model") == best).alias("chosen"))


@add("k04_term_statistics", X.oracle("", """SELECT term, count(*) AS docs, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1, 6) AS idf
    FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'))) AS term FROM documents) GROUP BY 1 HAVING count(*) >= 3"""))
def k04(spark, sf_dir):
    return S.term_statistics(X.table(spark, sf_dir, "documents"), "text")


# --- scoring ---------------------------------------------------------------------------------------
def make_rule_scorer():
    """Class weights from two word counts; stands in for a model."""
    def score(texts):
        against = np.array([1 + t.count("not") for t in texts], dtype="float64")
        pro = np.array([1 + t.count("the") for t in texts], dtype="float64")
        neutral = np.array([1 + t.count("and") for t in texts], dtype="float64")
        total = against + neutral + pro
        return np.column_stack([against / total, neutral / total, pro / total])
    return score


def _times(word: str) -> str:
    return f"(length(t) - length(replace(t, '{word}', ''))) // {len(word)} + 1"


SCORED = (("texts", f"SELECT id, created_utc, CASE WHEN {B.sql_mentions('c')} THEN c END AS t FROM (SELECT id, created_utc, {B.sql_clean('body')} AS c FROM cmt)"),
          ("weights", f"SELECT id, created_utc, {_times('not')} AS a, {_times('and')} AS n, {_times('the')} AS p FROM texts"),
          ("scored", "SELECT id, created_utc, CASE WHEN a IS NULL THEN NULL WHEN a >= n AND a >= p THEN 'against' WHEN n >= p THEN 'neutral' ELSE 'pro' END AS student_label, "
           + ", ".join(f"round(CAST(CAST(CAST({x} AS DOUBLE) / (a + n + p) AS REAL) AS DOUBLE), 6) AS student_p_{c}" for x, c in (("a", "against"), ("n", "neutral"), ("p", "pro"))) + " FROM weights"))


def label_comments(rows):
    """Comments whose own words use the keyword are scored, the others get nulls."""
    clean = computed_once(rows, "body_clean", T.clean_text("body"))
    scored = S.with_label(clean, "body_clean", ~T.mentions("body_clean", B.KEYWORD), make_rule_scorer)
    return scored.select("id", "created_utc", "student_label", *[F.round(F.col(f"student_p_{c}").cast("double"), 6).alias(f"student_p_{c}") for c in V.CLASSES])


@add("k05_batch_scoring", X.oracle("cmt", "SELECT * FROM scored", *SCORED))
def k05(spark, sf_dir):
    return label_comments(X.cmt(spark, sf_dir).select("id", "created_utc", "body"))


@add("k06_smoke_run", X.oracle("cmt", "SELECT student_label, count(*) AS rows FROM (SELECT * FROM scored ORDER BY created_utc, id LIMIT 2000) GROUP BY 1", *SCORED))
def k06(spark, sf_dir):
    """The feature is a look at the first 2,000 rows."""
    return S.smoke_run(X.cmt(spark, sf_dir).select("id", "created_utc", "body"), 2000, label_comments, ["created_utc", "id"])


# a vocabulary of lower-case words and their parts, whose ends are marked
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def token_sql() -> str:
    """Longest matches from the left: the longest piece at every place of every word, then the steps from place to place."""
    return X.oracle("rate", " UNION ALL ".join(f"SELECT {t} AS \"limit\", round(100 * avg(CASE WHEN tokens > {t} THEN 1.0 ELSE 0 END), 6) AS share_of_sample, round(100 * sum(CASE WHEN tokens > {t} THEN w ELSE 0 END) / sum(w), 6) AS share_weighted FROM tok" for t in V.TOKEN_LIMITS), WEIGHTED,
        ("vocab", f"SELECT unnest(json_keys(content, '$.model.vocab')) AS piece FROM read_text('{VOCABULARY}')"),
        ("spoken", r"SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+|[^\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}\p{L}\p{N}]')) AS word FROM documents WHERE doc_id IN (SELECT k FROM rate)"),
        ("different", "/* once */ SELECT DISTINCT word, word || '</w>' AS whole FROM spoken WHERE length(word) <= 100"),
        ("parts", """/* once */ SELECT whole, i, max(n) AS n FROM (SELECT whole, i, unnest(range(1, least(length(whole) - i + 2, 33))) AS n FROM (SELECT whole, unnest(range(1, length(whole) + 1)) AS i FROM different))
            JOIN vocab ON piece = substr(whole, CAST(i AS BIGINT), CAST(n AS BIGINT)) GROUP BY 1, 2"""),
        ("steps", """SELECT word, whole, CAST(1 AS BIGINT) AS i, 0 AS pieces FROM different
            UNION ALL /* recursive */ SELECT word, s.whole, s.i + n, pieces + 1 FROM steps s JOIN parts p ON p.whole = s.whole AND p.i = s.i"""),
        ("lengths", "SELECT word, max(pieces) AS pieces FROM steps WHERE i > length(whole) GROUP BY 1"),
        ("counted", "SELECT doc_id, CAST(sum(coalesce(pieces, 1)) AS BIGINT) AS n FROM spoken LEFT JOIN lengths USING (word) GROUP BY 1"),
        ("tok", "SELECT w, coalesce(n, 0) + 2 AS tokens FROM weighted r JOIN documents d ON r.k = d.doc_id LEFT JOIN counted c ON c.doc_id = d.doc_id"))


@add("k07_token_lengths", token_sql())
def k07(spark, sf_dir):
    """Shares of the sample, plain and weighted, that are longer than each limit in subwords."""
    texts = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), "text")
    rated = weighted(spark, sf_dir).select("k", "w").join(texts, "k")
    return sampling.over_limits(rated.select("w", token_length(spark, "text", VOCABULARY).alias("tokens")), "tokens", "w")


# --- requests and answers --------------------------------------------------------------------------
SYSTEM = "Say whether the author of the text is pro, against or neutral."
EXAMPLES = [("Text:\nA fine plan.", "pro"), ("Text:\nA poor plan.", "against"), ("Text:\nThe plan is out.", "neutral")]
PREFIX = Q.static_messages(SYSTEM, EXAMPLES)
PREFIX_TEXT = json.dumps(PREFIX).replace("'", "''")
VERSIONS = {"v1": Q.prompt_fingerprint(PREFIX), "v2-post": Q.prompt_fingerprint(PREFIX[:1])}
TURNS = ("turns", """SELECT id, context, 'Text:' || chr(10) || substr(comment, 1, 4000) AS alone,
    'Post:' || chr(10) || CASE WHEN post = '' THEN '(no post)' ELSE substr(post, 1, 1000) END || chr(10) || chr(10) || 'Comment:' || chr(10) || substr(comment, 1, 4000) AS with_post,
    CASE context WHEN 'post' THEN 'Post:' || chr(10) || substr(post, 1, 1000) || chr(10) || chr(10) WHEN 'earlier comment' THEN 'Earlier comment:' || chr(10) || substr(parent, 1, 1000) || chr(10) || chr(10) ELSE '' END
      || 'Comment:' || chr(10) || substr(comment, 1, 4000) AS by_place, post, comment FROM placed""")


def turns(spark, sf_dir):
    rows = placed(spark, sf_dir)
    return rows.select("id", "context", "post", "comment", Q.last_turn("comment").alias("alone"),
                       Q.last_turn_with_post("post", "comment").alias("with_post"),
                       Q.last_turn_by_place("context", "context_text", "comment").alias("by_place"))


@add("k08_request_table", X.oracle("thr_cmt thr_post", f"SELECT id, form, CAST({len(PREFIX) + 1} AS INTEGER) AS n_messages, 'user' AS last_role, last_content FROM (" + " UNION ALL ".join(f"SELECT id, '{f}' AS form, {f} AS last_content FROM turns" for f in ("alone", "with_post", "by_place")) + ")", *CONTEXT, TURNS))
def k08(spark, sf_dir):
    """Requests in three forms: the comment alone, with its post, and with the context of its place."""
    forms = F.array(*[F.struct(F.lit(f).alias("form"), Q.request(PREFIX, F.col(f)).alias("messages")) for f in ("alone", "with_post", "by_place")])
    rows = turns(spark, sf_dir).select("id", F.inline(forms))
    last = F.element_at("messages", -1)
    return rows.select("id", "form", F.size("messages").alias("n_messages"), last["role"].alias("last_role"), last["content"].alias("last_content"))


@add("k09_request_lengths", X.oracle("thr_cmt thr_post", " UNION ALL ".join(f"SELECT '{f}' AS form, count(*) AS rows, round(quantile_cont(length({f}), 0.5), 6) AS median, CAST(max(length({f})) AS BIGINT) AS longest, count(*) FILTER (WHERE length(post) > 1000) AS cut_posts, count(*) FILTER (WHERE post = '') AS without_post FROM turns" for f in ("alone", "with_post")), *CONTEXT, TURNS))
def k09(spark, sf_dir):
    forms = F.array(*[F.struct(F.lit(f).alias("form"), F.length(f).alias("chars")) for f in ("alone", "with_post")])
    rows = cut_lineage(turns(spark, sf_dir).select(F.inline(forms), F.length("post").alias("post_chars")))
    counts = rows.groupBy("form").agg(F.count(F.lit(1)).alias("rows"), F.max("chars").cast("bigint").alias("longest"),
                                      F.count_if(F.col("post_chars") > V.CONTEXT_MAX_CHARS).alias("cut_posts"), F.count_if(F.col("post_chars") == 0).alias("without_post"))
    return counts.join(exact_quantiles(rows, ["form"], "chars", {"median": 0.5}), "form").withColumn("median", F.round("median", 6))


@add("k10_prompt_fingerprint", X.oracle("thr_ans", f"""SELECT prompt_version, any_value(CASE prompt_version WHEN 'v1' THEN sha256('{PREFIX_TEXT}') ELSE sha256('{json.dumps(PREFIX[:1])}') END) AS sha256, count(*) AS answers, count(*) FILTER (WHERE prompt_version = 'v1') AS current FROM thr_ans GROUP BY 1"""))
def k10(spark, sf_dir):
    """Answers per prompt with the fingerprint of its fixed messages, and how many fit the current one."""
    stamped = X.thr_ans(spark, sf_dir).withColumn("sha256", G.lookup("prompt_version", VERSIONS))
    return stamped.groupBy("prompt_version", "sha256").agg(
        F.count(F.lit(1)).alias("answers"), F.count_if(F.col("sha256") == VERSIONS["v1"]).alias("current"))


TOKENS = ("tokens", "SELECT *, " + ", ".join(f"coalesce(exp(CAST(nullif(regexp_extract(answer_json, '\"token\":\"{c}\",\"logprob\":(-?[0-9.]+)', 1), '') AS DOUBLE)), 0) AS w_{c}" for c in V.CLASSES) + " FROM thr_ans")
PARSED = (TOKENS, ("parsed", "SELECT *, CASE WHEN raw_output IN ('against', 'neutral', 'pro') THEN raw_output ELSE 'error' END AS label, " + ", ".join(f"w_{c} / nullif(w_against + w_neutral + w_pro, 0) AS p_{c}" for c in V.CLASSES) + " FROM tokens"))


@add("k11_answer_parsing", X.oracle("thr_ans", "SELECT id, prompt_version, label, " + ", ".join(f"round(p_{c}, 6) AS p_{c}" for c in V.CLASSES) + ", round(p_pro - p_against, 6) AS score FROM parsed", *PARSED))
def k11(spark, sf_dir):
    parsed = Q.parse_answers(X.thr_ans(spark, sf_dir))
    return parsed.select("id", "prompt_version", "label", *[F.round(c, 6).alias(c) for c in ("p_against", "p_neutral", "p_pro", "score")])


@add("k12_error_rows", X.oracle("thr_ans", "SELECT id, prompt_version, raw_output FROM parsed WHERE label = 'error'", *PARSED))
def k12(spark, sf_dir):
    return Q.error_rows(Q.parse_answers(X.thr_ans(spark, sf_dir))).select("id", "prompt_version", "raw_output")


@add("k13_determinism_gate", X.oracle("rate", "SELECT count(*) AS rows, count(*) FILTER (WHERE model_a <> model_b) AS differ, 0::BIGINT AS missing FROM rate"))
def k13(spark, sf_dir):
    rate = X.rate(spark, sf_dir)
    return Q.label_differences(rate.select("id", F.col("model_a").alias("label")), rate.select("id", F.col("model_b").alias("label")))


@add("k14_control_rows", X.oracle("rate", "SELECT id, label_1 AS expected, model_a AS label FROM rate WHERE label_1 = label_2 AND label_1 <> 'skip' AND label_1 <> model_a"))
def k14(spark, sf_dir):
    """Texts on which both annotators agree are the controls."""
    rate = X.rate(spark, sf_dir)
    known = rate.filter("label_1 = label_2 and label_1 <> 'skip'").select("id", F.col("label_1").alias("label"))
    return Q.failed_controls(rate.select("id", F.col("model_a").alias("label")), known)


def _cases(values: dict, otherwise: str = "NULL") -> str:
    return f"CASE lower(x) {' '.join(f'WHEN {w!r} THEN {v}' for w, v in values.items())} ELSE {otherwise} END"


def _tone_step(before: str, distance: int, fade: float) -> str:
    """The values of the weighted words after a look at the word at some distance."""
    p = f"i - {distance}"
    loud = f"CASE WHEN shouts AND loud[{p}] THEN sign({before}[i]) * 0.733 ELSE 0.0 END"
    pushed = f"({before}[i] + CASE WHEN boost[{p}] IS NOT NULL THEN (sign({before}[i]) * boost[{p}] + {loud}) * {fade} ELSE 0.0 END)"
    return f"[CASE WHEN i > {distance} AND weight[{p}] IS NULL THEN {pushed} * CASE WHEN turns[{p}] THEN -0.74 ELSE 1.0 END ELSE {before}[i] END for i in range(1, len(w) + 1)]"


LEXED = (("words", r"SELECT id, created_utc, body, regexp_extract_all(coalesce(body, ''), '[\p{L}\p{N}_]{2,}') AS w FROM cmt"),
         ("infos", f"""SELECT *, [{_cases({'the': '1.0::DOUBLE', 'of': '-0.5::DOUBLE', 'and': '0.25::DOUBLE', 'not': '-2.0::DOUBLE'}, 'NULL::DOUBLE')} for x in w] AS weight,
             [{_cases({k: f'{v}::DOUBLE' for k, v in X.BOOSTERS.items()}, 'NULL::DOUBLE')} for x in w] AS boost,
             [lower(x) IN ({', '.join(map(repr, X.NEGATIONS))}) for x in w] AS turns, [lower(x) IN ({', '.join(map(repr, X.CONTRASTS))}) for x in w] AS contrast,
             [upper(x) = x AND lower(x) <> x for x in w] AS loud FROM words"""),
         ("marked", "SELECT *, len([x for x in loud if x]) BETWEEN 1 AND len(w) - 1 AS shouts, coalesce(list_position(contrast, true), 0) AS split FROM infos"),
         ("t0", "SELECT *, [weight[i] + CASE WHEN shouts AND loud[i] THEN sign(weight[i]) * 0.733 ELSE 0.0 END for i in range(1, len(w) + 1)] AS v0 FROM marked"),
         ("t1", f"SELECT *, {_tone_step('v0', 1, 1.0)} AS v1 FROM t0"), ("t2", f"SELECT *, {_tone_step('v1', 2, 0.95)} AS v2 FROM t1"),
         ("t3", f"SELECT *, {_tone_step('v2', 3, 0.9)} AS v3 FROM t2"),
         ("sums", """SELECT id, created_utc, coalesce(list_sum([v3[i] * CASE WHEN split = 0 OR i = split THEN 1.0 WHEN i < split THEN 0.5 ELSE 1.5 END for i in range(1, len(w) + 1) if v3[i] IS NOT NULL]), 0.0) AS s,
             length(body) - length(replace(body, '!', '')) AS calls, length(body) - length(replace(body, '?', '')) AS asks FROM t3"""),
         ("whole", "SELECT id, created_utc, s + sign(s) * coalesce(least(calls, 4) * 0.292 + CASE WHEN asks < 2 THEN 0.0 WHEN asks <= 3 THEN asks * 0.18 ELSE 0.96 END, 0) AS s FROM sums"),
         ("toned", "SELECT id, created_utc, s / sqrt(s * s + 15) AS tone FROM whole"))


@add("k15_lexicon_tone", X.oracle("cmt", "SELECT id, created_utc, round(tone, 6) AS tone, CASE WHEN tone >= 0.05 THEN 'pro' WHEN tone <= -0.05 THEN 'against' ELSE 'neutral' END AS label FROM toned", *LEXED))
def k15(spark, sf_dir):
    toned = lexicon_tone(X.cmt(spark, sf_dir).select("id", "created_utc", "body"), "body", X.tone_words(spark))
    return toned.select("id", "created_utc", F.round("tone", 6).alias("tone"), G.label_by_threshold("tone").alias("label"))


@add("k16_result_export", X.oracle("cmt rate", f"SELECT r.id, s.snippet, final, model_a, model_b, p_pro, round(p_pro - p_against, 6) AS score FROM rate r JOIN (SELECT id, min(substr(regexp_replace(body, '{B.WS}+', ' ', 'g'), 1, 160)) AS snippet FROM cmt GROUP BY 1) s ON r.id = s.id"))
def k16(spark, sf_dir):
    """One row per rated text with every label; the one-to-one joins are checked. Only rated comments are cut out
    of the table and cleaned."""
    rate = cut_lineage(X.rate(spark, sf_dir).select("id", "final", "model_a", "model_b", "p_pro", F.round(G.signed_score(), 6).alias("score")))
    rated = rows_with_ids(X.cmt(spark, sf_dir).select("id", "body"), rate)
    snippets = rated.groupBy("id").agg(F.min(T.snippet("body")).alias("snippet"))
    first = join_validated(rate.select("id", "final"), rate.select("id", "model_a", "model_b"), ["id"])
    second = join_validated(first, rate.select("id", "p_pro", "score"), ["id"])
    return second.join(snippets, "id")
