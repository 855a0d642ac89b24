"""Addressed, versioned and ordered tables: results, and what their plans move and read."""

import re

import pytest
from pyspark.sql import functions as F

from forumlens import session
from forumlens.operators import dedupe as D
from forumlens.sources import layout as L


@pytest.fixture(autouse=True)
def ready(spark):
    session.configure(spark)


def path(spark):
    return session.new_table_path(spark, "t")


def final_plan(df):
    """The executed plan, with the stages that adaptive execution made of it."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan()


def nodes(plan):
    if plan.nodeName() == "AdaptiveSparkPlan":
        yield from nodes(plan.executedPlan())
        return
    yield plan
    if plan.nodeName().endswith("QueryStage"):
        yield from nodes(plan.plan())
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def exchanged(df):
    """Columns and bytes of every shuffle of a finished plan."""
    return [(n.output().mkString(" "), n.metrics().apply("shuffleBytesWritten").value()) for n in nodes(final_plan(df)) if n.nodeName() == "Exchange"]


def rows_read(df):
    return sum(n.metrics().apply("numOutputRows").value() for n in nodes(final_plan(df)) if n.nodeName().startswith("Scan parquet"))


def posts(spark, n=4000):
    """A third of the rows is one text by one author; some fields are null, some authors deleted."""
    text = F.concat(F.lit("body "), F.repeat(F.sha2(F.col("id").cast("string"), 512), 20))
    kind = F.col("id") % 3
    return spark.range(n).select(
        F.concat(F.lit("i"), F.col("id") % 1500).alias("id"), (F.col("id") % 7).alias("t"),
        F.when(kind == 0, "same").when(F.col("id") % 11 == 0, "[deleted]").when(F.col("id") % 13 != 0, F.concat(F.lit("a"), F.col("id") % 5)).alias("author"),
        F.when(kind == 0, "x").when(F.col("id") % 17 != 0, F.when(F.col("id") % 4 == 0, F.substring(text, 1, 6)).otherwise(text)).alias("body")).repartition(6)


def test_keep_first_by_address_equals_keep_first(spark):
    source = session.cut_lineage(posts(spark))
    table = L.addressed(source, path(spark))
    for key, order, exempt in ((["author", "body"], ["t", "id"], D.is_deleted("author")), (["id"], ["t", "author", "body"], None),
                               (["author"], ["t", "id", "body"], D.has_null(["author"])), (["t"], ["id", "author", "body"], None)):
        found = D.keep_first_at(table, key, order, exempt)
        assert found.columns == source.columns
        expected = D.keep_first(source, key, order, exempt)
        assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    assert D.keep_first_at(L.addressed(source.filter("t > 9"), path(spark)), ["id"], ["t"]).count() == 0


def test_wholly_equal_rows_leave_one(spark):
    source = session.cut_lineage(spark.range(50).select(F.lit("a").alias("k"), F.lit(None).cast("string").alias("v")))
    assert D.keep_first_at(L.addressed(source, path(spark)), ["k"], ["v"]).count() == 1
    assert D.keep_first_at(L.addressed(source, path(spark)), ["k"], ["v"], exempt=F.lit(True)).count() == 50


def test_keeping_the_first_moves_no_text(spark):
    source = session.cut_lineage(posts(spark))
    text_bytes = source.agg(F.sum(F.octet_length("body"))).first()[0]
    found = D.keep_first_at(L.addressed(source, path(spark)), ["author", "body"], ["t", "id"], D.is_deleted("author"))
    moved = exchanged(found)
    assert moved and not any(re.search(r"\bbody#", columns) for columns, _ in moved)
    assert sum(size for _, size in moved) < 0.1 * text_bytes
    for node in nodes(found._jdf.queryExecution().executedPlan()):
        if node.nodeName() in ("SortAggregate", "Sort"):
            assert not re.search(r"\bbody#", node.output().mkString(" "))


def test_columns_are_added_without_reading_or_moving_the_table(spark):
    source = session.cut_lineage(posts(spark).withColumn("id", F.concat("id", F.lit("-"), F.monotonically_increasing_id().cast("string"))))
    root = L.start_table(source, path(spark))
    scores = session.cut_lineage(source.filter("t < 5").select("id", (F.col("t") + 1).alias("first"), F.length("body").alias("second")))
    for name in ("first", "second"):
        narrow = L.current(spark, root, [L.ROW, "id"])
        assert "body" not in narrow._jdf.queryExecution().executedPlan().toString()
        report = L.publish(narrow.join(scores.select("id", name), "id", "left").drop("id"), root)
    assert report == {"rows": 4000, "columns": 6, "version": 2}
    whole = L.current(spark, root)
    assert whole.columns == ["id", "t", "author", "body", "first", "second"]
    assert exchanged(whole) == [] and not [n for n in nodes(whole._jdf.queryExecution().executedPlan()) if n.nodeName() == "Sort"]
    expected = source.join(scores, "id", "left").select(whole.columns)
    assert sorted(map(str, whole.collect())) == sorted(map(str, expected.collect()))
    one = L.current(spark, root, ["second"])
    assert rows_read(one) == 4000 and one.columns == ["second"]
    assert len([n for n in nodes(one._jdf.queryExecution().executedPlan()) if n.nodeName().startswith("Scan parquet")]) == 1


def test_columns_that_do_not_fit_are_not_announced(spark):
    root = L.start_table(spark.range(5).withColumnRenamed("id", "k"), path(spark))
    old = L.current(spark, root, [L.ROW, "k"])
    one = old.select(L.ROW, F.lit(1).alias("s"))
    for wrong in (old.filter("k > 0").select(L.ROW, F.lit(1).alias("s")), one.unionByName(one), one.withColumn(L.ROW, F.col(L.ROW) + 7), old, one.drop(L.ROW), one.select(L.ROW)):
        with pytest.raises(L.PublishError):
            L.publish(wrong, root)
    with pytest.raises(L.PublishError, match="no version has"):
        L.current(spark, root, ["nothing"])
    assert L.current(spark, root).columns == ["k"] and len(L.versions(spark, root)) == 1
    empty = L.start_table(spark.range(0).withColumnRenamed("id", "k"), path(spark))
    assert L.publish(L.current(spark, empty, [L.ROW]).withColumn("s", F.lit(1)), empty)["rows"] == 0


def test_a_list_of_keys_reads_little_of_the_table(spark):
    n = 200_000
    source = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("body"))
    where = L.write_by_key(source, path(spark), "id", group_bytes=1 << 20, page_rows=1000)
    ids = source.filter("body IN ('text 7', 'text 99', 'text 100000', 'text 199999')").select("id").unionByName(
        spark.createDataFrame([("nobody",), (None,), ("7" * 64,)], "id string"))
    found = L.rows_of_keys(spark, where, ["id", "body"], ids, "id")
    assert sorted(r.body for r in found.collect()) == ["text 100000", "text 199999", "text 7", "text 99"]
    assert rows_read(found) < 0.05 * n
    joined = L.rows_of_keys(spark, where, ["body"], ids.filter("id < '9'"), "id", most=1)
    assert sorted(r.body for r in joined.collect()) == sorted(r.body for r in found.filter("id < '9'").collect())
    assert L.rows_of_keys(spark, where, ["body"], ids.filter("id IS NULL"), "id").count() == 0


def test_a_hot_key_is_cut_over_files(spark):
    source = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # the table is small
    where = L.write_by_key(source, path(spark), "id")
    session.configure(spark)
    hot = spark.read.parquet(where).filter("id = 'hot'")
    assert hot.count() == 10_000 and hot.select(F.input_file_name().alias("f")).distinct().count() > 1
    few = spark.createDataFrame([("hot",), ("1",)], "id string")
    assert L.rows_of_keys(spark, where, ["v"], few, "id").count() == 10_001
