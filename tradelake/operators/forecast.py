"""Seasonal forecasts per series, and the cleaned view that shows them beside the actuals."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import sanitize_forecast
from . import relational as R

MIN_OBS, HOLDOUT_FROM, HOLDOUT_MOST, TRAIN_LEAST = 6, 11, 3, 9
SERIES = ["product_key", "partner_key", "flow_type"]


def chapter_series(fact: DataFrame, dim_product: DataFrame) -> DataFrame:
    """Monthly VND totals by chapter, partner and flow, under the chapter's proxy product key."""
    chapters = dim_product.select("product_key", "chapter")
    totals = fact.join(chapters, "product_key").groupBy("chapter", "partner_key", "flow_type", "time_key").agg(F.sum("value_vnd").alias("y"))
    proxy = R.chapter_proxy(dim_product).select("chapter", F.col("proxy_key").alias("product_key"))
    return totals.join(proxy, "chapter").select("chapter", *SERIES, "time_key", "y")


def series_gate(series: DataFrame, keys: list[str]) -> DataFrame:
    """Series with at least MIN_OBS rows, with n_obs and the size of the hold-out: 0 below 11 rows, else min(n - 9, 3)."""
    gated = series.groupBy(*keys).agg(F.count("*").alias("n_obs")).where(F.col("n_obs") >= MIN_OBS)
    return gated.withColumn("n_test", F.when(F.col("n_obs") >= HOLDOUT_FROM, F.least(F.col("n_obs") - TRAIN_LEAST, F.lit(HOLDOUT_MOST))).otherwise(0).cast("int"))


_PENALTY = np.diag([0.0, 0.1, 1.0, 1.0, 1.0, 1.0]) + 1e-9 * np.eye(6)


def _design(months: np.ndarray) -> np.ndarray:
    """Trend and two yearly harmonics."""
    t = months / 12.0
    return np.column_stack([np.ones(len(t)), t, *[f(2 * np.pi * k * t) for k in (1, 2) for f in (np.sin, np.cos)]])


def _fit(x: np.ndarray, y: np.ndarray, starts: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Ridge weights of the series that begin at starts, from their rows in use."""
    own = x * used[:, None]
    a = np.add.reduceat(own[:, :, None] * x[:, None, :], starts)
    b = np.add.reduceat(own * y[:, None], starts)
    return np.linalg.solve(a + _PENALTY, b[:, :, None])[:, :, 0]


def _quantile(values: np.ndarray, series: np.ndarray, starts: np.ndarray, n: np.ndarray, q: float) -> np.ndarray:
    """The q-quantile of each series' values, between neighbours in proportion."""
    ordered = values[np.lexsort((values, series))]
    at = q * (n - 1)
    low = np.floor(at).astype(int)
    a, b = ordered[starts + low], ordered[starts + np.minimum(low + 1, n - 1)]
    return a + (b - a) * (at - low)


def forecast_groups(series: DataFrame, keys: list[str], horizon: int = 12) -> DataFrame:
    """(keys, time_key, point, lower, upper, mape) for horizon months after each series' last month; mape is that of the
    hold-out tail, null without one. Rows without a value do not count; series with fewer than MIN_OBS rows give none.

    Each series is a ridge regression on trend and two yearly harmonics, with the residuals' 10 % and 90 % quantiles as its
    band. A series is a few hundred months at most, so it travels as one row, and a batch of series is solved at once."""
    kinds = [series.schema[k] for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(len(keys))
            n = rows.value_lengths().to_numpy().astype(int)
            if not len(n):
                continue
            month, y = (rows.flatten().field(i).to_numpy(zero_copy_only=False).astype(float) for i in range(2))
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            own = np.repeat(np.arange(len(n)), n)
            base, last = month[starts], month[starts + n - 1]
            x = _design(month - base[own])
            test = np.where(n >= HOLDOUT_FROM, np.minimum(n - TRAIN_LEAST, HOLDOUT_MOST), 0)
            held = np.arange(len(own)) - starts[own] >= (n - test)[own]
            miss = np.abs((y - (x * _fit(x, y, starts, ~held)[own]).sum(1)) / (y + 1e-9)) * held
            mape = np.where(test > 0, np.add.reduceat(miss, starts) / np.maximum(test, 1) * 100, np.nan)
            w = _fit(x, y, starts, np.ones(len(own), bool))
            left = y - (x * w[own]).sum(1)
            low, high = (_quantile(left, own, starts, n, q) for q in (0.1, 0.9))
            which = np.repeat(np.arange(len(n)), horizon)
            ahead = last[which] + np.tile(np.arange(1, horizon + 1), len(n))
            point = (_design(ahead - base[which]) * w[which]).sum(1)
            columns = [batch.column(i).take(pa.array(which)) for i in range(len(keys))]
            key = (ahead // 12 * 100 + ahead % 12 + 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(key), pa.array(point), pa.array(point + low[which]), pa.array(point + high[which]), pa.array(mape[which], from_pandas=True)], [*keys, "time_key", "point", "lower", "upper", "mape"])

    month = (F.floor(F.col("time_key") / 100) * 12 + F.col("time_key") % 100 - 1).cast("int").alias("month")
    observed = series.where("y is not null").select(*keys, F.struct(month, F.col("y").cast("double").alias("y")).alias("row"))
    whole = observed.groupBy(*keys).agg(F.array_sort(F.collect_list("row")).alias("rows")).where(F.size("rows") >= MIN_OBS)
    out = T.StructType([*kinds, T.StructField("time_key", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("point", "lower", "upper", "mape")]])
    return whole.mapInArrow(run, out)


def to_forecast_table(forecast: DataFrame, model_version: str) -> DataFrame:
    clean = {n: sanitize_forecast(c) for n, c in (("forecast_value", "point"), ("lower_bound", "lower"), ("upper_bound", "upper"))}
    return forecast.select("time_key", *SERIES, F.lit(model_version).alias("model_version"), *[c.alias(n) for n, c in clean.items()])


def holdout_mape(df: DataFrame, keys: list[str]) -> DataFrame:
    """mean |(y - yhat) / (y + 1e-9)| * 100."""
    return df.groupBy(*keys).agg((F.avg(F.abs((F.col("y") - F.col("yhat")) / (F.col("y") + 1e-9))) * 100).alias("mape"))


def future_calendar(dim_time: DataFrame, horizon: int) -> DataFrame:
    """dim_time with the horizon months after its last one."""
    last = dim_time.agg(F.max("time_key").alias("t")).select(F.make_date(F.floor(F.col("t") / 100).cast("int"), (F.col("t") % 100).cast("int"), F.lit(1)).alias("d"))
    d = last.select(F.explode(F.sequence(F.add_months("d", 1), F.add_months("d", horizon), F.expr("interval 1 month"))).alias("d"))
    new = d.select((F.year("d") * 100 + F.month("d")).cast("int").alias("time_key"), F.year("d").alias("year"), F.quarter("d").alias("quarter"), F.month("d").alias("month"))
    return dim_time.unionByName(new.join(dim_time, "time_key", "left_anti").select(*dim_time.columns))


def series_cap(fact: DataFrame, keys: list[str]) -> DataFrame:
    """Three times the largest month: no forecast of the series may be above it."""
    return fact.groupBy(*keys).agg((F.max("value_vnd") * 3).cast("double").alias("cap"))


def clean_forecast_view(fact: DataFrame, forecast: DataFrame) -> DataFrame:
    """Actuals of the forecast series beside their forecasts, of which 0 <= lower <= point <= upper holds in every row
    and so in every sum; point is capped where the series has a history.

    Months and forecasts lie beneath one another, dealt by series once: the series' cap, whether it has forecasts, and the month that a
    forecast stands beside are windows over one sorted order. A null in a key equals nothing."""
    keys = [*SERIES, "time_key"]
    months = fact.groupBy(*keys).agg(F.sum("value_vnd").cast("double").alias("actual_value"), F.max("value_vnd").alias("top"))
    rows = months.withColumn("foreseen", F.lit(False)).unionByName(forecast.select(*keys, "forecast_value", "lower_bound", "upper_bound", F.lit(True).alias("foreseen")), allowMissingColumns=True)
    placed = rows.repartition(*SERIES).sortWithinPartitions(*keys)
    series, month = Window.partitionBy(*SERIES), Window.partitionBy(*keys)
    whole = reduce(Column.__and__, [F.col(k).isNotNull() for k in SERIES])
    dated = whole & F.col("time_key").isNotNull()
    met = placed.withColumns({"cap": F.when(whole, (F.max("top").over(series) * 3).cast("double")), "panel": whole & F.max("foreseen").over(series)})
    met = met.withColumns({"own": F.when(dated, F.max("actual_value").over(month)), "beside": dated & F.max("foreseen").over(month)})
    clean = met.where("foreseen or panel and not beside").withColumn("point", F.when(F.col("foreseen"), F.greatest(F.least("forecast_value", "cap"), F.lit(0.0))))
    low, high = F.least(F.greatest(F.least("lower_bound", "cap"), F.lit(0.0)), "point"), F.greatest(F.least("upper_bound", "cap"), "point")
    shown = {"actual_value": F.when(F.col("foreseen"), F.col("own")).otherwise(F.col("actual_value")), "forecast_value": F.col("point")} | {n: F.when(F.col("foreseen"), c) for n, c in (("lower_bound", low), ("upper_bound", high))}
    return clean.select("time_key", *SERIES, *[c.alias(n) for n, c in shown.items()])


def series_positions(series: DataFrame, keys: list[str]) -> DataFrame:
    """series with is_test: its hold-out rows."""
    w = Window.partitionBy(*keys).orderBy(F.col("time_key").desc())
    return series.join(series_gate(series, keys), keys).withColumn("is_test", F.row_number().over(w) <= F.col("n_test"))
