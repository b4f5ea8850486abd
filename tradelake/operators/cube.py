"""OLAP cubes: roll-ups along hierarchies, slices, pivots and calculated measures."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of the hierarchies, from the top.
TIME, PRODUCT, COUNTRY = ["year", "quarter", "month"], ["chapter", "heading", "hs_code"], ["continent", "region", "partner_name"]


@dataclass(frozen=True)
class CubeSpec:
    """Base measures (name -> aggregate) and calculated ones (name -> expression over them, applied in order)."""

    measures: dict[str, Column]
    calculated: dict[str, Column] = field(default_factory=dict)


def money(c: str) -> Column:
    return F.sum(c).cast("double")


def trade_cube() -> CubeSpec:
    vnd = F.col("value_vnd")
    export, import_ = F.sum(F.when(F.col("flow_type"), vnd)), F.sum(F.when(~F.col("flow_type"), vnd))
    return CubeSpec(
        {"value": money("value"), "value_vnd": money("value_vnd"), "quantity": money("quantity"), "trades": F.count("*"), "export_vnd": export.cast("double"), "import_vnd": import_.cast("double")},
        {
            "surplus": F.coalesce("export_vnd", F.lit(0.0)) - F.coalesce("import_vnd", F.lit(0.0)),
            "asymmetry": F.abs(F.col("surplus")) / F.nullif(F.col("value_vnd"), F.lit(0.0)),
        },
    )


def slicer(df: DataFrame, where: Column | None = None, years: list[int] | None = None, months: list[int] | None = None) -> DataFrame:
    """The cube's slice: a condition, and the dashboard's filter by years and months."""
    for c, values in (("year", years), ("month", months)):
        if values is not None:
            df = df.where(F.col(c).isin(*values))
    return df if where is None else df.where(where)


def tile(df: DataFrame, rows: list[str], spec: CubeSpec, wanted: list[str], where: Column | None = None, pivot: tuple[str, list] | None = None) -> DataFrame:
    """Members of rows (none: the total) by the wanted measures; groups without facts do not show. With a pivot
    (column, members) the first wanted measure is spread over the members."""
    df = slicer(df, where)
    if pivot:
        column, members = pivot
        return df.groupBy(*rows).pivot(column, members).agg(spec.measures[wanted[0]])
    out = df.groupBy(*rows).agg(*[m.alias(n) for n, m in spec.measures.items()])
    for n, c in spec.calculated.items():
        out = out.withColumn(n, c)
    return out.select(*rows, *wanted)


def rollup(df: DataFrame, levels: list[str], measures: dict[str, Column]) -> DataFrame:
    """Totals of every level of a hierarchy; level 0 is the All member."""
    out = df.rollup(*levels).agg(F.grouping_id().alias("g"), *[m.alias(n) for n, m in measures.items()])
    depth = F.lit(len(levels)) - F.length(F.replace(F.bin("g"), F.lit("0"), F.lit("")))
    return out.select(*levels, depth.cast("int").alias("level"), *measures)


def cube_by(df: DataFrame, dims: list[str], measures: dict[str, Column]) -> DataFrame:
    """All combinations of dimensions, each with an All member (shown as grouped_<dim> = 1)."""
    return df.cube(*dims).agg(*[F.grouping(d).cast("int").alias(f"grouped_{d}") for d in dims], *[m.alias(n) for n, m in measures.items()])


def growth(df: DataFrame, measure: str, order: str = "time_key", keys: list[str] | None = None) -> DataFrame:
    """df with growth: change against the month before in the calendar (order is year * 100 + month), across years; null where
    that month has no facts."""
    following = F.when(F.col(order) % 100 == 12, F.col(order) + 89).otherwise(F.col(order) + 1)
    before = df.select(*(keys or []), following.alias(order), F.col(measure).alias("__before"))
    joined = df.join(before, [*(keys or []), order], "left")
    return joined.withColumn("growth", (F.col(measure) - F.col("__before")) / F.nullif("__before", F.lit(0.0))).drop("__before")


def tail_member(df: DataFrame, order: str = "time_key") -> DataFrame:
    """The rows of the last member that has facts."""
    return df.join(df.agg(F.max(order).alias(order)), order)


def share_percent(df: DataFrame, measure: str) -> DataFrame:
    """df with share: percent of the grand total, which is a join with a single row and no window over all rows."""
    total = df.agg(F.sum(measure).alias("__total"))
    return df.join(total).withColumn("share", F.col(measure) / F.nullif("__total", F.lit(0.0)) * 100).drop("__total")


def utilization_rate(counts: DataFrame) -> DataFrame:
    """Agreement counts (fta_name, time_key, trades, with ALL rows) as percent of ALL in the same period."""
    total = counts.where("fta_name = 'ALL'").select("time_key", F.col("trades").alias("__all"))
    own = counts.where("fta_name <> 'ALL'").join(total, "time_key")
    return own.withColumn("rate", F.col("trades") / F.nullif(F.col("__all").cast("double"), F.lit(0.0)) * 100).drop("__all")


def ingest_monitor(df: DataFrame) -> DataFrame:
    """Flag as text, date and hour of arrival."""
    return df.select("source_system", F.col("is_late").cast("string").alias("late_flag"), F.date_format("created_at", "yyyy-MM-dd").alias("created_date"), F.hour("created_at").alias("created_hour"))


def watermark_monitor(df: DataFrame, now: str) -> DataFrame:
    hours = F.round((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("updated_at")) / 3600.0, 1)
    return df.withColumn("hours_since_update", hours)
