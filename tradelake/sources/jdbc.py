"""Partitioned reads of database tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task fetches, about.
TASK_ROWS = 500_000


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, columns: list[str] | None = None, where: str | None = None, task_rows: int = TASK_ROWS, options: dict[str, str] | None = None) -> DataFrame:
    """The rows of a table for which where holds, by as many queries as the table's size asks for: key, an integer, date or
    timestamp column, is cut into equal strides between its least and greatest value there. Rows without a key, and those that
    are added beyond these bounds meanwhile, come with the first and the last stride.

    The condition goes into the database's own query, and so do filters and columns that are asked of the result."""
    source = lambda **more: spark.read.format("jdbc").options(**{"url": url, **(options or {}), **more})
    condition = f" where {where}" if where else ""
    low, high, n = source(query=f"select min({key}) as low, max({key}) as high, count(*) as n from {table}{condition}").load().first()
    wanted = ", ".join(columns) if columns else "*"
    rows = source(dbtable=f"(select {wanted} from {table}{condition}) t")
    parts = -(-n // task_rows)
    if parts > 1 and low is not None and low != high:
        rows = rows.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return rows.load()


def read_bilateral_records(spark: SparkSession, url: str, records: str, countries: str, products: str, key: str = "id", task_rows: int = TASK_ROWS, options: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, countries, products) as relational.denormalize_bilateral() takes them; the records are read by their key."""
    small = [read_jdbc(spark, url, t, "1", task_rows=2**62, options=options) for t in (countries, products)]
    return read_jdbc(spark, url, records, key, task_rows=task_rows, options=options), *small
