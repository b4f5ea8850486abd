"""Tables that batches are loaded into: reruns, loads that end early, periods that are not touched."""

import os

import pytest
from pyspark.sql import functions as F

from tradelake.operators import merge
from tradelake.sources import tables

SCHEMA = "k string, p int, v double, batch_id string"


def accumulate(old, new):
    return merge.merge_accumulate(old, new, ["k", "p"], ["v"])


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def load(spark, path, batch_id, data, **counts):
    frame = spark.createDataFrame([(*r, batch_id) for r in data], SCHEMA)
    return tables.merge_batch(spark, path, frame, batch_id, "p", accumulate, **counts), frame.schema


def test_only_touched_periods_are_read_and_written(spark, tmp_path):
    home = str(tmp_path)
    first, schema = load(spark, home, "B 1/x", [("a", 1, 1.0), ("b", 2, 2.0), ("c", None, 3.0)], rows_loaded=3)
    assert first["periods"] == ["1", "2", "none"] and first["rows_before"] == 0 and first["rows_after"] == 3
    seen = []
    frame = spark.createDataFrame([("a", 1, 5.0, "B2"), ("d", 4, 4.0, "B2")], schema)
    record = tables.merge_batch(spark, home, frame, "B2", "p", lambda old, new: (seen.append(old.inputFiles()), accumulate(old, new))[1])
    assert all("__period=1" in f for f in seen[0]) and seen[0]
    assert record["rows_before"] == 1 and record["rows_after"] == 2
    kept = {p: f for p, f in record["folders"].items() if p in ("2", "none")}
    assert kept == {p: f for p, f in first["folders"].items() if p in ("2", "none")}
    want = [("a", 1, 5.0, "B2"), ("b", 2, 2.0, "B 1/x"), ("c", None, 3.0, "B 1/x"), ("d", 4, 4.0, "B2")]
    assert rows(tables.read(spark, home, schema)) == want
    assert rows(tables.read(spark, home, schema, ["4", "9"])) == want[3:]
    assert tables.clean(spark, home) == 1 and rows(tables.read(spark, home, schema)) == want
    assert [(r.number, r.batch_id, r.status, r.rows_loaded, r.rows_after) for r in tables.batch_log(spark, home).orderBy("number").collect()] == [(0, "B 1/x", "SUCCESS", 3, 3), (1, "B2", "SUCCESS", None, 2)]


def test_a_batch_counts_once(spark, tmp_path):
    home = str(tmp_path)
    one, schema = load(spark, home, "B1", [("a", 1, 1.0)])
    again, _ = load(spark, home, "B1", [("a", 1, 1.0)])
    assert again == one and rows(tables.read(spark, home, schema)) == [("a", 1, 1.0, "B1")]
    frame = spark.createDataFrame([("x",)], "r string")
    assert tables.append_batch(spark, home + "/log", frame, "B1") == tables.append_batch(spark, home + "/log", frame, "B1")
    tables.append_batch(spark, home + "/log", frame.where("false"), "B2", status="FAILED")
    assert rows(tables.read(spark, home + "/log", frame.schema)) == [("x",)]
    assert rows(tables.batch_log(spark, home + "/log").select("batch_id", "status", "rows_after")) == [("B1", "SUCCESS", 1), ("B2", "FAILED", 0)]


@pytest.mark.parametrize("at", ["_create", "_rows", "_commit"])
def test_a_load_that_ends_early_changes_nothing_and_can_be_repeated(spark, tmp_path, monkeypatch, at):
    home = str(tmp_path)
    _, schema = load(spark, home, "B1", [("a", 1, 1.0), ("b", 2, 2.0)])

    def killed(*args, **kw):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(tables, at, killed)
        with pytest.raises(KeyboardInterrupt):
            load(spark, home, "B2", [("a", 1, 9.0), ("c", 2, 1.0)])
    assert rows(tables.read(spark, home, schema)) == [("a", 1, 1.0, "B1"), ("b", 2, 2.0, "B1")]
    assert tables.committed(spark, home, "B2") is None and tables.batch_log(spark, home).count() == 1
    load(spark, home, "B2", [("a", 1, 9.0), ("c", 2, 1.0)])
    assert rows(tables.read(spark, home, schema)) == [("a", 1, 9.0, "B2"), ("b", 2, 2.0, "B1"), ("c", 2, 1.0, "B2")]
    assert tables.clean(spark, home) >= 4 and tables.read(spark, home, schema).count() == 3
    assert not [f for _, _, names in os.walk(home) for f in names if f.endswith(".tmp")]


def test_of_two_loads_at_once_one_commits(spark, tmp_path):
    home = str(tmp_path)
    _, schema = load(spark, home, "B1", [("a", 1, 1.0)])

    def slow(old, new):
        load(spark, home, "B3", [("z", 3, 3.0)])
        return accumulate(old, new)

    frame = spark.createDataFrame([("b", 1, 2.0, "B2")], schema)
    with pytest.raises(tables.LoadConflict):
        tables.merge_batch(spark, home, frame, "B2", "p", slow)
    assert rows(tables.read(spark, home, schema)) == [("a", 1, 1.0, "B1"), ("z", 3, 3.0, "B3")] and tables.committed(spark, home, "B2") is None
    load(spark, home, "B2", [("b", 1, 2.0)])
    assert rows(tables.read(spark, home, schema).select("k")) == [("a",), ("b",), ("z",)]


def test_an_empty_table_and_an_empty_batch(spark, tmp_path):
    home = str(tmp_path)
    frame = spark.createDataFrame([], SCHEMA)
    assert tables.read(spark, home, frame.schema).count() == 0 == tables.batch_log(spark, home).count() == tables.clean(spark, home)
    record = tables.merge_batch(spark, home, frame, "B0", "p", accumulate)
    assert record["periods"] == [] and record["rows_after"] == 0 and tables.read(spark, home, frame.schema).count() == 0
    assert tables.merge_batch(spark, home, frame.withColumn("v", F.lit(1.0)), "B0", "p", accumulate) == record


def test_a_batch_is_made_once(spark, tmp_path):
    """Its periods and its rows are read from what is stored."""
    made = spark.sparkContext.accumulator(0)

    def count(x):
        made.add(1)
        return x

    frame = spark.createDataFrame([(f"k{i}", i % 3, 1.0, "B1") for i in range(30)], SCHEMA)
    counted = frame.withColumn("p", F.udf(count, "int")("p")).repartition(2)
    record = tables.merge_batch(spark, str(tmp_path), counted, "B1", "p", accumulate)
    assert made.value == 30 and record["rows_after"] == 30 and record["periods"] == ["0", "1", "2"]
    assert not os.listdir(tmp_path / "_incoming")


def test_a_stored_batch_is_not_stored_again(spark, tmp_path, monkeypatch):
    """And columns that the others of their row give are made when the rows are in place."""
    written, write = [], tables.write_table
    monkeypatch.setattr(tables, "write_table", lambda df, path, *parts: (written.append(path), write(df, path, *parts)))
    frame = spark.createDataFrame([("a", 1, 1.0, "B1"), ("b", None, 2.0, "B1")], SCHEMA).withColumn("h", F.md5("k"))
    record = tables.merge_batch(spark, str(tmp_path), frame, "B1", "p", accumulate, stored=True, derived={"h": F.md5("k")})
    assert record["rows_after"] == 2 and len(written) == 1 and not os.path.exists(tmp_path / "_incoming")
    assert rows(tables.read(spark, str(tmp_path), frame.schema)) == rows(frame)
