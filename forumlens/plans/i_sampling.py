"""Samples, quotas, weights and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens import fixed_values as V
from forumlens.functions import flags as G
from forumlens.functions import text as T
from forumlens.operators import profile as P
from forumlens.operators import ranking as R
from forumlens.operators import sampling as S
from forumlens.operators.folds import grouped_folds
from forumlens.operators.quantiles import exact_quantiles
from forumlens.plans import book as B
from forumlens.plans import fixtures as X
from forumlens.session import cut_lineage, small_side
from forumlens.sources.readers import rows_with_ids
from forumlens.plans.h_windows import STRATA, cand_sql, candidates

BOOK = B.Book()
add = BOOK.add
PERCENT = 60  # of the eligible rows, so that some strata are taken whole
TOTAL = f"(SELECT count(*) * {PERCENT} // 100 FROM cand)"

# the cap is found by trying every value, independent of the running-sum rule on the Spark side
SIZES = ("sizes", "SELECT subreddit, source_month, count(*) AS stratum_size FROM cand GROUP BY 1, 2")
CAP = ("cap", f"SELECT max(c) AS cap FROM (SELECT c, sum(least(stratum_size, c)) AS taken FROM sizes, (SELECT unnest(range(0, (SELECT max(stratum_size) + 1 FROM sizes))) AS c) GROUP BY c) WHERE taken <= {TOTAL}")
PLAN = ("plan", f"""SELECT subreddit, source_month, stratum_size, CAST(least(stratum_size, cap) + CASE WHEN stratum_size > cap AND turn <= {TOTAL} - (SELECT sum(least(stratum_size, cap)) FROM sizes, cap) THEN 1 ELSE 0 END AS BIGINT) AS stratum_sampled
    FROM (SELECT *, sum(CASE WHEN stratum_size > cap THEN 1 ELSE 0 END) OVER (ORDER BY subreddit, source_month) AS turn FROM sizes, cap)""")
CHOSEN = ("chosen", """SELECT c.*, p.stratum_size, p.stratum_sampled FROM (SELECT *, row_number() OVER (PARTITION BY subreddit, source_month ORDER BY rank) AS rn FROM cand) c
    JOIN plan p ON c.subreddit = p.subreddit AND c.source_month = p.source_month WHERE rn <= stratum_sampled""")
SAMPLE = ("sample", """SELECT *, row_number() OVER (PARTITION BY part ORDER BY rank) AS "order" FROM (SELECT *, (row_number() OVER (ORDER BY subreddit, source_month, rank) - 1) % 2 + 1 AS part FROM chosen)""")
DRAWN = (SIZES, CAP, PLAN, CHOSEN, SAMPLE)


def drawn(spark, sf_dir):
    return S.stratified_sample(candidates(spark, sf_dir), STRATA, percent=PERCENT)


def drawn_with_text(spark, sf_dir):
    """The sample with its cleaned texts; copies of an id give one text."""
    sample = small_side(drawn(spark, sf_dir))
    raw = rows_with_ids(X.cmt(spark, sf_dir).select("id", "body"), sample)
    texts = raw.select("id", T.clean_text("body").alias("text")).groupBy("id").agg(F.min("text").alias("text"))
    return sample.join(texts, "id", "left")


@add("i01_even_allocation", cand_sql("SELECT * FROM plan", *DRAWN[:3]))
def i01(spark, sf_dir):
    sizes = cut_lineage(R.group_sizes(candidates(spark, sf_dir), STRATA, "stratum_size"))
    return S.allocate(sizes, STRATA, S.total_of(sizes, PERCENT))


@add("i02_hash_rank", cand_sql("SELECT id, rank FROM cand"))
def i02(spark, sf_dir):
    return candidates(spark, sf_dir).select("id", R.hash_rank("id").alias("rank"))


@add("i03_stratified_sample", cand_sql(f"""SELECT s.id, subreddit, source_month, part, "order", stratum_size, stratum_sampled, text
    FROM sample s JOIN (SELECT id, min({B.sql_clean('body')}) AS text FROM cmt GROUP BY 1) t ON s.id = t.id""", *DRAWN))
def i03(spark, sf_dir):
    return drawn_with_text(spark, sf_dir).select("id", *STRATA, "part", "order", "stratum_size", "stratum_sampled", "text")


@add("i04_sample_fingerprint", cand_sql("SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(digest, chr(10) ORDER BY bucket)) AS sha256 FROM (SELECT substr(sha256(id), 1, 4) AS bucket, count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY id)) AS digest FROM sample GROUP BY 1)", *DRAWN))
def i04(spark, sf_dir):
    return S.fingerprint(drawn(spark, sf_dir))


@add("i05_even_quotas", X.oracle("cmt", "SELECT subreddit, 502 // k + CASE WHEN (i - 1 + k) % k < 502 % k THEN 1 ELSE 0 END AS quota FROM (SELECT subreddit, row_number() OVER (ORDER BY subreddit) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT subreddit FROM cmt))"))
def i05(spark, sf_dir):
    return S.even_quotas(X.cmt(spark, sf_dir).select("subreddit").distinct(), 502, ["subreddit"], offset=1)


PERIODS = list(V.PERIODS.values())
# eligible comments with their period, once per id
POOL = ("pool", f"SELECT id, min(subreddit) AS subreddit, min({B.SQL_PERIOD}) AS period, substr(sha256('42:' || id), 1, 16) AS rank FROM cmt GROUP BY id")
QUOTAS = ("quotas", f"""SELECT subreddit, period, q // 4 + CASE WHEN (j - i % 4 + 4) % 4 < q % 4 THEN 1 ELSE 0 END AS quota FROM (
    SELECT subreddit, i, 26 // k + CASE WHEN i < 26 % k THEN 1 ELSE 0 END AS q FROM (
      SELECT subreddit, row_number() OVER (ORDER BY n DESC, subreddit) - 1 AS i, count(*) OVER () AS k FROM (SELECT subreddit, count(*) AS n FROM pool GROUP BY 1))),
    (SELECT unnest({PERIODS!r}) AS period, unnest([0, 1, 2, 3]) AS j)""")


def pool(spark, sf_dir):
    return X.cmt(spark, sf_dir).groupBy("id").agg(F.min("subreddit").alias("subreddit"), F.min(G.period_of_month()).alias("period"))


@add("i06_two_level_quotas", X.oracle("cmt", """SELECT id, p.subreddit, p.period, quota FROM (SELECT *, row_number() OVER (PARTITION BY subreddit, period ORDER BY rank) AS rn FROM pool) p
    JOIN quotas q ON p.subreddit = q.subreddit AND p.period = q.period WHERE rn <= quota""", POOL, QUOTAS))
def i06(spark, sf_dir):
    rows = pool(spark, sf_dir)
    sample = S.quota_sample(rows, "subreddit", "period", PERIODS, 26)
    quotas = S.two_level_quotas(R.group_sizes(rows, ["subreddit", "period"]), "subreddit", "period", PERIODS, 26)
    return R.attach(sample, quotas.select("subreddit", "period", "quota"), ["subreddit", "period"]).select("id", "subreddit", "period", "quota")


@add("i07_n_per_group", X.oracle("cmt", "SELECT id, subreddit, period, rn AS position FROM (SELECT *, row_number() OVER (PARTITION BY subreddit, period ORDER BY rank) AS rn FROM pool) WHERE rn <= 7", POOL))
def i07(spark, sf_dir):
    return S.n_per_group(pool(spark, sf_dir), ["subreddit", "period"], 7).select("id", "subreddit", "period", F.col("position").cast("bigint").alias("position"))


@add("i08_random_subset", X.oracle("cmt", "SELECT id, rank FROM pool ORDER BY rank, id LIMIT 50", POOL))
def i08(spark, sf_dir):
    return S.random_subset(pool(spark, sf_dir), 50).select("id", "rank")


# the greedy rule thread by thread: counters of every fold and stratum, f folds and k strata, in one list
_OFF = "10 * n[(c - 1) * 10 + j] - list_sum(n[(c - 1) * 10 + 1 : c * 10])"
_COST = f"""list_sum([sqrt(CAST(list_sum([({_OFF}) * ({_OFF}) for j in range(1, 11)]) + 20 * v[c] * ({_OFF.replace('+ j]', '+ i]')}) + 90 * v[c] * v[c] AS DOUBLE)) / y[c]
    for c in range(1, len(v) + 1) if v[c] > 0])"""
FOLDS = (("cells", "SELECT submission_id, concat_ws('|', final, grp, term) AS stratum, count(*) AS n FROM rate GROUP BY 1, 2"),
         ("strata", "SELECT stratum, CAST(sum(n) AS BIGINT) AS y FROM cells GROUP BY 1"),
         ("totals", "SELECT list(y ORDER BY stratum) AS y FROM strata"),
         ("dense", """SELECT t.submission_id, list(coalesce(c.n, 0) ORDER BY s.stratum) AS v, CAST(sum(c.n) AS BIGINT) AS size,
             count(*) * CAST(sum(c.n * c.n) AS BIGINT) - CAST(sum(c.n) AS BIGINT) * CAST(sum(c.n) AS BIGINT) AS spread, string_agg(s.stratum || ':' || c.n, ',' ORDER BY s.stratum) AS name
             FROM (SELECT DISTINCT submission_id FROM cells) t CROSS JOIN strata s LEFT JOIN cells c ON c.submission_id = t.submission_id AND c.stratum = s.stratum GROUP BY 1"""),
         ("turns", """SELECT *, row_number() OVER (ORDER BY spread DESC, substr(sha256('42:' || name), 1, 16), name,
             substr(sha256('42:' || submission_id), 1, 16), submission_id) AS turn FROM dense"""),
         ("greedy", f"""SELECT CAST(0 AS BIGINT) AS turn, [CAST(0 AS BIGINT) for x in range(10 * len(y))] AS n, [CAST(0 AS BIGINT) for x in range(10)] AS filled, CAST(-1 AS BIGINT) AS fold, NULL::VARCHAR AS submission_id FROM totals
             UNION ALL /* recursive */
             SELECT turn, [n[k] + CASE WHEN (k - 1) % 10 = fold THEN v[(k - 1) // 10 + 1] ELSE 0 END for k in range(1, len(n) + 1)],
                 [filled[k] + CASE WHEN k - 1 = fold THEN size ELSE 0 END for k in range(1, 11)], fold, submission_id
             FROM (SELECT *, list_sort([{{'filled': filled[i], 'i': i}} for i in range(1, 11) if costs[i] <= list_min(costs) * (1 + 1e-13)])[1].i - 1 AS fold
                   FROM (SELECT t.turn, n, filled, v, size, t.submission_id, [{_COST} for i in range(1, 11)] AS costs
                         FROM greedy g JOIN turns t ON t.turn = g.turn + 1 CROSS JOIN totals))"""),
         ("folded", """SELECT r.*, CAST(f.fold AS INTEGER) AS fold, CASE f.fold WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split
             FROM rate r JOIN greedy f ON r.submission_id = f.submission_id"""))


def folded(spark, sf_dir):
    rows = X.rate(spark, sf_dir)
    return grouped_folds(rows, "submission_id", ["final", "grp", "term"]).withColumn("split", S.split_name())


@add("i09_grouped_folds", X.oracle("rate", "SELECT id, submission_id, fold, split FROM folded", *FOLDS))
def i09(spark, sf_dir):
    return folded(spark, sf_dir).select("id", "submission_id", "fold", "split")


@add("i10_split_balance", X.oracle("rate", "SELECT split, final, count(*) AS rows, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS pct FROM folded GROUP BY 1, 2", *FOLDS))
def i10(spark, sf_dir):
    return P.shares(folded(spark, sf_dir), ["final"], within=["split"])


WEIGHTED = ("weighted", "SELECT *, CAST(stratum_size AS DOUBLE) / count(*) OVER (PARTITION BY grp, term) AS w FROM rate")


def weighted(spark, sf_dir):
    """Ratings with the size of their stratum over the rows sampled from it."""
    rows = R.with_group_sizes(X.rate(spark, sf_dir), ["grp", "term"], "sampled")
    return rows.withColumn("w", S.design_weight("stratum_size", "sampled"))


@add("i11_design_weight", X.oracle("rate", "SELECT id, round(w, 6) AS w FROM weighted", WEIGHTED))
def i11(spark, sf_dir):
    return weighted(spark, sf_dir).select("id", F.round("w", 6).alias("w"))


@add("i12_weighted_percent", X.oracle("rate", " UNION ALL ".join(f"SELECT {t} AS \"limit\", round(100 * avg(CASE WHEN n_chars > {t} THEN 1.0 ELSE 0 END), 6) AS share_of_sample, round(100 * sum(CASE WHEN n_chars > {t} THEN w ELSE 0 END) / sum(w), 6) AS share_weighted FROM weighted" for t in V.TOKEN_LIMITS), WEIGHTED))
def i12(spark, sf_dir):
    return S.over_limits(weighted(spark, sf_dir), "n_chars", "w")


@add("i13_sample_description", cand_sql(f"""
    SELECT CASE WHEN grouping(source_month) = 1 THEN 'All' ELSE source_month END AS source_month, CASE WHEN grouping(subreddit) = 1 THEN 'All' ELSE subreddit END AS subreddit, count(*) AS n, NULL::DOUBLE AS median, NULL::DOUBLE AS q90
    FROM sample GROUP BY CUBE (source_month, subreddit)
    UNION ALL SELECT 'text length', 'All', count(*), round(quantile_cont(chars, 0.5), 6), round(quantile_cont(chars, 0.9), 6) FROM (SELECT length(min({B.sql_clean('body')})) AS chars FROM cmt WHERE id IN (SELECT id FROM sample) GROUP BY id)""", *DRAWN))
def i13(spark, sf_dir):
    sample = drawn_with_text(spark, sf_dir)
    months = P.crosstab_with_margins(sample, "source_month", "subreddit")
    lengths = sample.select(F.length("text").alias("chars"))
    cuts = exact_quantiles(lengths, [], "chars", {"median": 0.5, "q90": 0.9}).select(F.round("median", 6).alias("median"), F.round("q90", 6).alias("q90"))
    one = F.lit(1).alias("one")
    tail = (lengths.agg(F.count(F.lit(1)).alias("n")).select("n", one).join(cuts.select("*", one), "one")
            .select(F.lit("text length").alias("source_month"), F.lit("All").alias("subreddit"), "n", "median", "q90"))
    none = F.lit(None).cast("double")
    return months.withColumns({"median": none, "q90": none}).unionByName(tail)
