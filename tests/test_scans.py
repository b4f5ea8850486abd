"""Numbers, windows and carried values by blocks against plain window functions; partitioned database reads."""

import random
import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tradelake.operators import relational, scans
from tradelake.queries import QUERIES
from tradelake.sources import jdbc


@pytest.fixture(scope="module")
def series(spark):
    """One long series, short ones, a null key; notes are rare."""
    rng = random.Random(1)
    rows = [(k, t, rng.choice([None, 1.0, 2.5, float(t)]), rng.choice([None] * 30 + ["", " ", f"{k}{t}"])) for k, n in (("long key a", 700), ("long key b", 3), ("long key c", 90), (None, 40), ("z", 1)) for t in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t int, v double, note string").repartition(5)


def test_numbers_follow_the_order(spark, series):
    got = scans.numbered(series, ["k", "t"], "n")
    want = series.withColumn("n", F.row_number().over(Window.orderBy("k", "t")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    # keys that begin alike, and rows that are all alike, are dealt to several tasks
    many = spark.range(20_000).select(F.concat(F.lit("the same beginning "), F.lpad(F.col("id").cast("string"), 9, "0")).alias("k")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one task
    placed = scans.numbered(many, ["k"], "n")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tasks = [r.n for r in placed.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()]
    assert len(tasks) > 1 and max(tasks) < 3 * sorted(tasks)[len(tasks) // 2]
    assert scans.numbered(series.where("false"), ["k", "t"], "n").count() == 0


@pytest.mark.parametrize("rows", [4, 37, 10_000])
def test_windows_by_blocks(series, rows):
    def windows(df, keys):
        w = Window.partitionBy(*keys).orderBy("t")
        return df.withColumns({"lag": F.lag("v", 2).over(w), "lead": F.lead("v", 3).over(w), "mean": relational.rolling("v", w, 5, "mean"), "dev": F.stddev_samp("v").over(w.rowsBetween(-4, 0))})

    rounded = lambda df: sorted(str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.collect())
    got = scans.in_blocks(series, ["k"], ["t"], 4, 3, windows, rows)
    want = windows(series, ["k"])
    assert rounded(got.select(*want.columns)) == rounded(want)


@pytest.mark.parametrize("rows", [1, 7, 10_000])
def test_values_are_carried_over_blocks(series, rows):
    got = scans.carried(series, ["k"], ["t"], "note", "last", rows)
    want = series.withColumn("last", relational.carry_forward("note", Window.partitionBy("k").orderBy("t")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert scans.carried(series.where("k = 'z'"), [], ["t"], "note", "last", rows).count() == 1


def test_a_database_table_is_read_in_parts(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    rows = spark.range(1000).select((F.col("id") * 3).alias("ID"), F.when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("n"), "id")).alias("NAME"))
    rows.coalesce(1).write.format("jdbc").options(url=url, dbtable="RECORDS", driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    got = jdbc.read_jdbc(spark, url, "RECORDS", "ID", task_rows=150, options=options)
    assert got.rdd.getNumPartitions() == 7 and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    some = jdbc.read_jdbc(spark, url, "RECORDS", "ID", ["ID"], "NAME is null", 50, options)
    assert some.columns == ["ID"] and some.rdd.getNumPartitions() == 3 and some.count() == 143
    asked = got.where("ID < 9").select("NAME")
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(ID), *LessThan(ID,9)]" in plan and asked.count() == 3
    assert jdbc.read_jdbc(spark, url, "RECORDS", "ID", where="ID < 0", options=options).count() == 0
    one = jdbc.read_jdbc(spark, url, "RECORDS", "ID", where="ID = 3", task_rows=1, options=options)
    assert one.rdd.getNumPartitions() == 1 and one.count() == 1


def test_a_task_sorts_a_bounded_number_of_rows(spark):
    """More rows are dealt to more tasks, and a key's rows meet."""
    df = spark.range(4000).selectExpr("id div 4 as k", "id")
    parts = scans.dealt(df, ["k"], 4000, 200).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.countDistinct("k").alias("keys")).collect()
    assert len(parts) == 20 and all(r.n == 4 * r.keys and r.n <= 400 for r in parts)
    assert scans.dealt(df, ["k"], 10).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = QUERIES["carry_forward"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_orderkey" in plan
