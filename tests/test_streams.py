"""Streaming jobs: what arrives late, twice, or in a batch that runs again."""

import os
import random

import pytest
from pyspark.sql import functions as F

from forumlens import session
from forumlens.streaming import jobs

SCHEMA = "id string, source_month string, created_utc long, body string"


@pytest.fixture(autouse=True)
def ready(spark):
    session.configure(spark)


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def arriving(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    return jobs.keyword_ingest(jobs.read_files(spark, folder, schema, files_per_batch=1), "the").select("source_month", "id")


def forget_commit(progress):
    """As if the process had died after the last batch had written and before it was committed."""
    folder = f"{progress}/commits"
    last = max(int(f) for f in os.listdir(folder) if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{folder}/{name}"):
            os.remove(f"{folder}/{name}")
    return last


def test_streams_take_only_new_files(spark):
    folder, where = session.new_table_path(spark, "in"), session.new_table_path(spark, "first")

    def run():
        stream = arriving(spark, folder)
        return sorted((r.id or "", r.source_month) for r in jobs.FirstSeen(spark, where, stream.schema, "source_month", "id").run(stream).collect())

    arrive(spark, folder, [("a", "2017-01", 100, "the x"), ("a", "2017-01", 160, "the x"), ("b", "2017-01", 200, "none")])
    assert run() == [("a", "2017-01")]
    arrive(spark, folder, [("a", "2017-01", 220, "the x"), ("c", "2017-01", 300, "the y"), ("a", "2017-02", 320, "the x")])
    assert run() == [("a", "2017-01"), ("a", "2017-02"), ("c", "2017-01")] == run()
    arrive(spark, folder, [("late", "2016-01", 1, "the first of an old month"), ("c", "2017-01", 300, "the y"), (None, "2016-01", 1, "the x")] * 2)
    assert run() == [("", "2016-01"), ("a", "2017-01"), ("a", "2017-02"), ("c", "2017-01"), ("late", "2016-01")]


def test_months_out_of_order_lose_and_double_nothing(spark):
    rng = random.Random(9)
    folder, where = session.new_table_path(spark, "in"), session.new_table_path(spark, "first")
    months = [f"{y}-{m:02}" for y in (2017, 2018, 2019) for m in range(1, 13)]
    seen, stream = set(), None
    first = None
    for batch in range(0, 36, 6):
        rows = []
        for month in months[batch:batch + 6]:
            rows += [(f"k{rng.randrange(60)}", month, 1, "the x") for _ in range(60)]
            rows += [(f"k{rng.randrange(80)}", rng.choice(months[:batch + 6]), 1, "the late x") for _ in range(15)]
        arrive(spark, folder, rows)
        seen |= {(r[1], r[0]) for r in rows}
        stream = arriving(spark, folder)
        first = jobs.FirstSeen(spark, where, stream.schema, "source_month", "id")
        found = [(r.source_month, r.id) for r in first.run(stream).collect()]
        assert len(found) == len(set(found)) and set(found) == seen
        if batch:                       # at the end of a run only months that are open have state: 62 days, so three or so
            assert first.state_rows[-1] <= 4 * 80 < len(seen) or batch < 12
    assert first.state_rows[-1] < len(seen) / 5


@pytest.mark.parametrize("job", ["route", "late"])
def test_a_batch_that_runs_again_leaves_each_key_once(spark, job):
    folder, where = session.new_table_path(spark, "in"), session.new_table_path(spark, "first")
    arrive(spark, folder, [(f"k{i}", "2019-05", 1, "the x") for i in range(20)])
    arrive(spark, folder, [(f"k{i}", "2017-05", 1, "the x") for i in range(30)])
    stream = arriving(spark, folder)
    first = jobs.FirstSeen(spark, where, stream.schema, "source_month", "id")
    expected = sorted(first.run(stream).collect())
    assert len(expected) == 50
    forget_commit(f"{where}/progress-{job}")
    arrive(spark, folder, [("k3", "2017-05", 1, "the x"), ("new", "2017-05", 1, "the x"), ("k3", "2019-05", 1, "the x")])
    stream = arriving(spark, folder)
    again = sorted(jobs.FirstSeen(spark, where, stream.schema, "source_month", "id").run(stream).collect())
    assert len(again) == len(set(again)) == 51 and set(expected) < set(again)


def test_scores_of_a_batch_that_runs_again(spark):
    folder, table = session.new_table_path(spark, "in"), session.new_table_path(spark, "scores")
    schema = spark.createDataFrame([], SCHEMA).schema
    done = spark.createDataFrame([("k1",)], "id string")
    calls = []

    def label(rows):
        calls.append(1)
        return rows.select("id", F.length("body").alias("score"))

    def run():
        stream = jobs.read_files(spark, folder, schema, files_per_batch=1)
        return sorted(tuple(r) for r in jobs.score_new(stream, label, table, f"{table}-progress", done, ["id"]).collect())

    arrive(spark, folder, [(f"k{i}", "2017-01", 1, "the x") for i in range(4)])
    arrive(spark, folder, [(f"k{i}", "2017-01", 1, "the xyz") for i in range(4, 9)])
    first = run()
    assert [k for k, _ in first] == ["k0", "k2", "k3", "k4", "k5", "k6", "k7", "k8"] and len(calls) == 2
    forget_commit(f"{table}-progress")
    assert run() == first and len(calls) == 3           # written anew, not once more
    arrive(spark, folder, [("k9", "2017-01", 1, "the")])
    assert run() == [*first, ("k9", 3)] and len(calls) == 4
