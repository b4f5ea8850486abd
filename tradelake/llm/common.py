"""Shared helpers: the scratch folder, cut lineage, row numbers for ids, connected components, Arrow text access."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a null id where ids are compared; smaller than every other id.
NULL_ID = -(2**63)
#: A key with more than 1 / HUBS of all rows is joined by broadcast: there are less than HUBS of them. Below HUB_ROWS
#: rows no key is a burden.
HUBS, HUB_ROWS = 1000, 100_000
_CLEANUP, _BATCH, _BYTES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows and bytes that a Python worker is handed at once while tables are written: whole texts are long.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_made: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local session gets a folder of its
    own; on a cluster that would lose data, so it is an error there."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    path = path or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tradelake-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/tradelake-{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """From now on Python workers are handed BATCH_ROWS rows and BATCH_BYTES bytes at once at most."""
    rows = int(spark.conf.get(_BATCH, "10000"))
    spark.conf.set(_BATCH, min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS)
    spark.conf.set(_BYTES, BATCH_BYTES)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back, which cuts its lineage and survives lost executors. The
    shuffle files of the write go with its end."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = {k: spark.conf.get(k, v) for k, v in ((_CLEANUP, "false"), (_BATCH, "10000"), (_BYTES, "64MB"))}
    try:
        spark.conf.set(_CLEANUP, "true")
        small_batches(spark)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    release()
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    _made.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    if path in _made:
        _made.remove(path)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of materialise(); only for those that nothing unfinished reads."""
    for df in tables:
        path = _paths.pop(df, None) if df is not None else None
        if path:
            _delete(df.sparkSession, path)


def result_only(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """materialise() what make returns, and delete every other table that was written on the way."""
    before = set(_made)
    out = materialise(make(), name)
    for path in set(_made) - before - {_paths[out]}:
        _delete(out.sparkSession, path)
    return out


_kept: dict[tuple, object] = {}


def keep(name: tuple, make: Callable[[], object]) -> object:
    """What is dear to make, made once by a worker process and kept between tasks; of these only the last asked for is kept."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def release() -> None:
    """Give this process's freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], uses: tuple | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow. Worker processes serve one stage after another: so what another stage had them keep() goes first, and
    when the task is done its freed memory goes back to the system."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in [n for n in _kept if n != uses]:
            del _kept[name]
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string or binary column and the n+1 offsets of its rows in them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        return utf8_slices(column.cast(pa.large_binary()))
    n = len(column)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def each_text(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each row; null rows are empty."""
    data, ends = utf8_slices(column)
    raw = data.tobytes()
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield raw[a:b]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_long_id(docs: DataFrame, name: str, column: str = "doc_id") -> DataFrame:
    """docs with the added long column name, in the order of the ids: an integer id itself, else a number for each of the
    distinct ids (sorted by range partitions and stored, so that all readers see the same). A null id is NULL_ID."""
    if isinstance(docs.schema[column].dataType, T.IntegralType):
        return docs.withColumn(name, F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID)))
    ids = docs.select(F.col(column).alias(fresh(docs, "id_"))).distinct().dropna()
    own = ids.columns[0]
    placed = ids.repartitionByRange(partitions(docs.sparkSession), own).sortWithinPartitions(own)
    ranks = materialise(placed.withColumn(fresh(docs, "rank_"), F.monotonically_increasing_id()), "ranks")
    joined = docs.join(ranks, F.col(column) == F.col(own), "left")
    return joined.withColumn(name, F.coalesce(F.col(ranks.columns[1]), F.lit(NULL_ID))).drop(*ranks.columns)


def join_by_key(rows: DataFrame, sides: DataFrame, key: str, size: Column, total: int) -> DataFrame:
    """rows joined with sides, which has one row for each key; size says how many of the total rows a key has. The fewer
    than HUBS keys with the most rows are broadcast, so that their rows stay where they are; the others are shuffled."""
    heavy = size > max(total // HUBS, HUB_ROWS)
    hubs = F.broadcast(sides.where(heavy))
    rest = rows.join(F.broadcast(sides.where(heavy).select(key)), key, "left_anti").join(sides.where(~heavy).hint("merge"), key)
    return rows.join(hubs, key).unionByName(rest)


def attach_by_key(rows: DataFrame, sides: DataFrame, key: str, size: str) -> DataFrame:
    """rows left-joined with sides, a stored table that has one row for some of the keys and in column size how many of rows
    each has. Where keys are common enough to burden a task they are broadcast, as in join_by_key()."""
    total, most = sides.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    least = max(int(total) // HUBS, HUB_ROWS)
    if most <= least:
        return rows.join(sides.hint("merge"), key, "left")
    hubs = sides.where(F.col(size) > least)
    rest = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(sides.where(F.col(size) <= least).hint("merge"), key, "left")
    return rows.join(F.broadcast(hubs), key).unionByName(rest)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge list of long ids; root is the smallest id of the component.

    Alternates large-star and small-star steps until the edge set stops changing. Each step is a minimum per
    node (combined before the shuffle) and a join with it, for which the edges of a hub stay where they are, and
    every round is written to the shared scratch folder, and the one before it deleted.
    """

    def oriented(df: DataFrame) -> DataFrame:
        return df.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct()

    now = materialise(oriented(edges.select(F.col(a).cast("long").alias("hi"), F.col(b).cast("long").alias("lo"))), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
                now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
            )
        before, total = tuple(mark), 2 * mark[0]
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = materialise(join_by_key(both.where("v > u"), low, "u", F.col("n"), total).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "edges-large")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        small = join_by_key(large, low, "hi", F.col("n"), total).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        last, now = now, materialise(oriented(small.unionByName(low.select("hi", F.col("m").alias("lo")))), "edges")
        discard(last, large)
