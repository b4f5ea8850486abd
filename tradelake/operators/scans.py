"""Numbers, windows and carried values over one long order, by all tasks: sorted ranges, prefix sums and halos.

A window function puts a series, and one without a partition all rows, into one task. Here rows are sorted by ranges of the whole
order and stored; the ranges' sizes, one number a task, give every row its place. Windows with bounded frames are then computed
in blocks of neighbouring places, each with a halo of the rows that its frames reach over, and what is carried on without a
bound goes from block to block as one value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import store


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df, stored in the order, with the added long column name: 1, 2, ... by the columns of order (nulls first). Rows that these
    do not tell apart are numbered in any one order. Ranges are cut by all columns of order, so equal beginnings of keys do not
    meet in one task."""
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    held = spark.read.schema(placed.schema).parquet(store(placed, "numbered"))
    part = F.shiftright("__at", 33)
    sizes = {r.p: r.n for r in held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one for each task
    before, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, before))
        before += sizes[p]
    small = spark.createDataFrame(offsets, "__part long, __before long")
    place = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return held.withColumn("__part", part).join(F.broadcast(small), "__part").withColumn(name, place).drop("__at", "__part", "__before")


def dealt(df: DataFrame, keys: list[str], total: int, rows: int = 250_000) -> DataFrame:
    """df, which has about total rows, dealt by keys to so many tasks that each gets about `rows` rows, for windows over these keys:
    what a task sorts does not grow with df. Small partitions are not put together again by their compressed size."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-total // rows)), *keys)


def in_blocks(df: DataFrame, keys: list[str], order: list[str], behind: int, ahead: int, windows: Callable[[DataFrame, list[str]], DataFrame], rows: int = 1_000_000) -> DataFrame:
    """windows(df, keys) for window functions over series (keys) in the order, whose frames reach over `behind` rows before and
    `ahead` rows after a row at most; windows gets rows with halos and the keys to partition by. A block has about `rows` rows of
    its own, whichever series they are of, so a long series is shared by many tasks."""
    size = max(rows, behind, ahead, 1)
    placed = numbered(df, [*keys, *order], "__row")
    block, inside = F.floor((F.col("__row") - 1) / size).cast("long"), (F.col("__row") - 1) % size
    copies = [F.struct(block.alias("b"), F.lit(True).alias("own"))]
    if behind:
        copies.append(F.when(inside >= size - behind, F.struct((block + 1).alias("b"), F.lit(False).alias("own"))))
    if ahead:
        copies.append(F.when((inside < ahead) & (block > 0), F.struct((block - 1).alias("b"), F.lit(False).alias("own"))))
    spread = placed.withColumn("__c", F.explode(F.array_compact(F.array(*copies)))).select(*df.columns, F.col("__c.b").alias("__block"), F.col("__c.own").alias("__own"))
    return windows(spread, ["__block", *keys]).where("__own").drop("__block", "__own")


def carried(df: DataFrame, keys: list[str], order: list[str], column: str, name: str, rows: int = 1_000_000) -> DataFrame:
    """df with the added column name: the last value of column that is neither null nor blank, up to and with a row, in its series.

    Within blocks by a window; a block hands on what stands at its end, so the blocks' last values, a row each, are all that
    meets in one task."""
    placed = numbered(df, [*keys, *order], "__row").withColumn("__block", F.floor((F.col("__row") - 1) / rows).cast("long"))
    value = F.nullif(F.trim(F.col(column)), F.lit(""))
    own = F.last(value, ignorenulls=True).over(Window.partitionBy("__block", *keys).orderBy("__row").rowsBetween(Window.unboundedPreceding, 0))
    filled = placed.withColumn("__own", own)
    series = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    ends = filled.groupBy("__block").agg(F.max_by(F.struct(series.alias("s"), F.col("__own").alias("v")), "__row").alias("e")).select("__block", "e.s", "e.v")
    # a series lies in neighbouring blocks, so the last value handed on is its own or of a series that ended before it
    w = Window.orderBy("__block")
    handed = F.last(F.when(F.col("v").isNotNull(), F.struct("s", "v")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    given = ends.withColumn("h", handed).select(F.col("__block").alias("__to"), F.col("h.s").alias("__s"), F.col("h.v").alias("__v"))
    joined = filled.join(given, filled["__block"] == given["__to"], "left")
    same = series.eqNullSafe(F.col("__s"))
    return joined.withColumn(name, F.coalesce("__own", F.when(same, F.col("__v")))).select(*df.columns, name)
