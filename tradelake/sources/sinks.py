"""Sinks: how layer tables are written."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_kept: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def overwrite_stage(df: DataFrame, path: str) -> None:
    """The stage table is always what the last run read."""
    df.write.mode("overwrite").parquet(path)


def write_audit_snapshot(df: DataFrame, path: str, run_date: str) -> None:
    """A dated copy of an extract; a second run of a day replaces that day's only."""
    df.withColumn("run_date", F.lit(run_date).cast("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)


def append_audit(df: DataFrame, path: str) -> None:
    """Rejects and late rows are only ever added."""
    df.write.mode("append").parquet(path)


def scratch_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of spark.checkpoint.dir. Where it is unset, a local session gets a folder
    of its own; on a cluster no other machine would see that, so it is an error there."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tradelake-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one."""
    return f"{scratch_folder(spark)}/tradelake-{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, *parts: str) -> None:
    """Write df as Parquet, in folders by the columns parts where these are given. Texts of hexadecimal digits and the like pack to half
    of what the default leaves of them; the shuffle files of the write go with its end."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    try:
        conf.set(_CLEANUP, "true")
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*parts) if parts else writer).parquet(path)
    finally:
        conf.set(_CLEANUP, before)


def store(df: DataFrame, name: str) -> str:
    """Write df under a new name in the shared folder, and return the path."""
    path = new_folder(df.sparkSession, name)
    write_table(df, path)
    return path


def kept(df: DataFrame, name: str, key: Column | None = None, hashes: tuple[str, ...] = ()) -> DataFrame:
    """df as a stored table, from which others read: it is made once, and joins know its size; what kept() returned is not stored
    again. Of the columns hashes only what differs from key, which the row's other columns give, is stored: a hash does not compress,
    and it is made again when the table is read."""
    if df in _kept:
        return df
    hashes = tuple(c for c in hashes if c in df.columns)
    slim = df.withColumns({c: F.when(~F.col(c).eqNullSafe(key), F.struct(F.col(c).alias("other"))) for c in hashes}) if hashes else df
    path = store(slim, name)
    out = df.sparkSession.read.schema(slim.schema).parquet(path)
    if hashes:
        out = out.withColumns({c: F.when(F.col(c).isNull(), key).otherwise(F.col(f"{c}.other")) for c in hashes})
    _kept[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of kept(); only for those that nothing reads any more."""
    for df in tables:
        path = _kept.pop(df, None)
        if path:
            place, files = _place(df.sparkSession, path)
            files.delete(place, True)


def _place(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def state_of(spark: SparkSession, path: str) -> tuple[int, int]:
    """(bytes, time of change) of a file or folder: others if it was written again."""
    place, files = _place(spark, path)
    status = files.getFileStatus(place)
    return files.getContentSummary(place).getLength(), status.getModificationTime()


def save_slice(spark: SparkSession, path: str, new: DataFrame, predicate: Column) -> None:
    """Replace the rows for which predicate holds. Spark cannot overwrite what it reads, so the new table is written beside the
    old one and then takes its place by renaming: a run that fails leaves either the old table or, under the name of the
    copy, the new one."""
    from ..operators.merge import replace_slice  # which writes its stored tables here

    beside, before = (f"{path}.{uuid.uuid4().hex}" for _ in range(2))
    replace_slice(spark.read.parquet(path), new, predicate).write.parquet(beside)
    old, files = _place(spark, path)
    aside, _ = _place(spark, before)
    if not files.rename(old, aside) or not files.rename(_place(spark, beside)[0], old):
        raise OSError(f"{beside} could not take the place of {path}")
    files.delete(aside, True)
