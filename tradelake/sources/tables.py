"""Tables that batches are loaded into: by period, or appended. A batch is loaded once, however often it is run.

A table is a folder of Parquet folders and of small commit records, <number>.json, each of which replaces the one before: it
lists the folder that every period's rows are in, and names its batch. A load writes new folders for the periods that its batch
touches, and its last step is to create the next record, which only one load can. Readers go by the newest record, so a load
that ends early has changed nothing, and what it wrote is removed by clean().
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sinks import write_table

#: A batch may touch so many periods: their names pass through the driver, and calendars are short.
MOST_PERIODS = 100_000
RECORD = "number long, batch_id string, status string, rows_extracted long, rows_loaded long, rows_rejected long, rows_before long, rows_after long"


class LoadConflict(Exception):
    """Another load has committed since this one began; it can be run again."""


def _at(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    place, files = _at(spark, path)
    return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Put text at path unless something is there: written beside it and renamed, which a reader sees whole or not at all."""
    jvm = spark.sparkContext._jvm
    beside, files = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = files.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    place = _at(spark, path)[0]
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, place, options)
    except Exception as error:  # only what says that the record is there
        if "AlreadyExists" not in str(error):
            raise
        files.delete(beside, False)
        return False
    return True


def _remove(spark: SparkSession, path: str) -> None:
    place, files = _at(spark, path)
    files.delete(place, True)


def _record(spark: SparkSession, path: str, number: int) -> dict:
    place, files = _at(spark, f"{path}/_commits/{number}.json")
    stream = files.open(place)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def newest(spark: SparkSession, path: str) -> dict:
    """The record that readers go by; number -1 of an empty table."""
    numbers = [int(n[:-5]) for n in _names(spark, f"{path}/_commits") if n.endswith(".json")]
    return _record(spark, path, max(numbers)) if numbers else {"number": -1, "folders": {}}


def committed(spark: SparkSession, path: str, batch_id: str) -> dict | None:
    """The record of a batch, if it was committed. Each load leaves a note of the number that it was about to take."""
    note = quote(batch_id, safe="")
    for name in _names(spark, f"{path}/_batches/{note}"):
        number = int(name)
        if _at(spark, f"{path}/_commits/{number}.json")[1].exists(_at(spark, f"{path}/_commits/{number}.json")[0]):
            found = _record(spark, path, number)
            if found["batch_id"] == batch_id:
                return found
    return None


def _commit(spark: SparkSession, path: str, record: dict) -> dict:
    place, files = _at(spark, f"{path}/_batches/{quote(record['batch_id'], safe='')}/{record['number']}")
    files.create(place, True).close()
    if not _create(spark, f"{path}/_commits/{record['number']}.json", json.dumps(record)):
        raise LoadConflict(f"{path} has a record {record['number']} already")
    return record


def read(spark: SparkSession, path: str, schema: T.StructType, periods: list[str] | None = None) -> DataFrame:
    """The rows of committed batches; of the given periods only, where these are given, from no other folders."""
    folders = newest(spark, path)["folders"]
    chosen = sorted({f for p, f in folders.items() if periods is None or p in periods})
    if not chosen:
        return spark.createDataFrame([], schema).limit(0)  # Spark knows it to be empty: a first load joins and sorts nothing
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in chosen])


def _period(period: str) -> Column:
    return F.coalesce(F.expr(period).cast("string"), F.lit("none"))


def periods_of(df: DataFrame, period: str) -> list[str]:
    rows = df.select(_period(period).alias("p")).distinct().limit(MOST_PERIODS + 1).collect()
    if len(rows) > MOST_PERIODS:
        raise ValueError(f"a batch touches more than {MOST_PERIODS} periods")
    return sorted(r.p for r in rows)


def _rows(spark: SparkSession, path: str, folders: list[str]) -> int:
    return spark.read.parquet(*[f"{path}/{f}" for f in folders]).count() if folders else 0


def merge_batch(spark: SparkSession, path: str, batch: DataFrame, batch_id: str, period: str, how: Callable[[DataFrame, DataFrame], DataFrame], stored: bool = False, derived: dict[str, Column] | None = None, **counts: int) -> dict:
    """Merge a batch into the table by how(old rows, batch) and return its record; that of the first time if it was loaded
    before. Only rows of the periods that the batch touches are read and written, so keys must lie in one period:
    period, a SQL expression, is part of them. counts go into the record. stored says that the batch is a stored table already. Columns
    that others of their row give, in this table and in the batch, can be named in derived: they are not shuffled."""
    if done := committed(spark, path, batch_id):
        return done
    last = newest(spark, path)
    # its periods and its rows are both read, and what it is made of may be dear
    held = f"{path}/_incoming/{uuid.uuid4().hex}"
    if not stored:
        write_table(batch, held)
        batch = spark.read.schema(batch.schema).parquet(held)
    touched = periods_of(batch, period)
    old = read(spark, path, batch.schema, touched)
    place = f"data/{uuid.uuid4().hex}"
    merged = how(old, batch).withColumn("__period", _period(period))
    # periods are dealt by size: a large one goes to several tasks and files
    dealt = merged.drop(*(derived or {})).hint("rebalance", "__period").withColumns(derived or {}).select(*merged.columns)
    write_table(dealt, f"{path}/{place}", "__period")
    new = {p: f"{place}/__period={quote(p, safe='-_ ')}" for p in touched}
    written = set(_names(spark, f"{path}/{place}"))
    new = {p: f for p, f in new.items() if f.rpartition("/")[2] in written}
    before = [f for p, f in last["folders"].items() if p in touched]
    folders = {p: f for p, f in last["folders"].items() if p not in touched} | new
    record = {"rows_extracted": None, "rows_loaded": None, "rows_rejected": None} | counts
    record |= {"number": last["number"] + 1, "batch_id": batch_id, "status": "SUCCESS", "rows_before": _rows(spark, path, before), "rows_after": _rows(spark, path, list(new.values())), "periods": touched, "folders": folders}
    _remove(spark, held)
    return _commit(spark, path, record)


def append_batch(spark: SparkSession, path: str, rows: DataFrame, batch_id: str, status: str = "SUCCESS", **counts: int) -> dict:
    """Add a batch's rows as a folder of their own; nothing where the batch is in the table already. A failed load is logged by
    its status."""
    if done := committed(spark, path, batch_id):
        return done
    last = newest(spark, path)
    folder = f"data/{uuid.uuid4().hex}"
    write_table(rows, f"{path}/{folder}")
    record = {"rows_extracted": None, "rows_loaded": None, "rows_rejected": None} | counts
    record |= {"number": last["number"] + 1, "batch_id": batch_id, "status": status, "rows_before": 0, "rows_after": _rows(spark, path, [folder]), "folders": last["folders"] | {f"batch {batch_id}": folder}}
    return _commit(spark, path, record)


def batch_log(spark: SparkSession, path: str) -> DataFrame:
    """A row for each committed batch, with its counts and status."""
    if not any(n.endswith(".json") for n in _names(spark, f"{path}/_commits")):
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).json(f"{path}/_commits/*.json")


def clean(spark: SparkSession, path: str) -> int:
    """Delete the folders that the newest record does not list: those of earlier versions and of loads that ended early. Only for
    a table that nothing reads or loads meanwhile. Returns how many went."""
    live = set(newest(spark, path)["folders"].values())
    gone = 0
    for name in _names(spark, f"{path}/data"):
        parts = [f"data/{name}/{n}" for n in _names(spark, f"{path}/data/{name}") if n.startswith("__period=")]
        for folder in parts or [f"data/{name}"]:
            if folder not in live:
                _remove(spark, f"{path}/{folder}")
                gone += 1
    _remove(spark, f"{path}/_incoming")
    return gone
