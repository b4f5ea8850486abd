"""Risk features, labels, thresholds and naive baselines for exchange rates and trade balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import store
from . import boosting
from . import relational as R

MIN_DAYS, MIN_MONTHS, MIN_LABELLED = 120, 12, 4
FX_FEATURES = ["rate", "change_pct", "vol_7", "vol_30", "mean_7", "mean_30", "change_pct_lag1", "change_pct_lag2", "change_pct_lag3", "day_of_week", "month"]
BALANCE_FEATURES = ["export_value", "import_value", "balance", "balance_delta", "export_growth", "import_growth", "balance_lag1", "balance_lag2", "balance_lag3", "month", "late_ratio"]


class SkipJob(Exception):
    """There is too little history to model."""


def fx_features(rates: DataFrame, keys: list[str]) -> DataFrame:
    """rates (keys, rate_date, rate double) with changes, rolling means and deviations, lags and calendar fields."""
    w = Window.partitionBy(*keys).orderBy("rate_date")
    df = rates.withColumn("change_pct", R.pct_change("rate", w))
    df = df.withColumns({f"{n}_{k}": R.rolling("change_pct", w, k, how) for k in (7, 30) for n, how in (("mean", "mean"), ("vol", "std"))})
    return R.lags(df, "change_pct", w).withColumns({"day_of_week": F.weekday("rate_date"), "month": F.month("rate_date")})


def fx_labels(features: DataFrame, keys: list[str], horizons: list[int]) -> DataFrame:
    """The change k rows ahead, for each horizon k."""
    w = Window.partitionBy(*keys).orderBy("rate_date")
    return features.withColumns({f"target_{k}": R.horizon_label("change_pct", w, k) for k in horizons})


def balance_features(monthly: DataFrame, late: DataFrame, keys: list[str]) -> DataFrame:
    """monthly (keys, year, month, export_value, import_value, n) with balance, changes, lags and the share of late rows, which
    late (keys, year, month, late_count) has by series."""
    w = Window.partitionBy(*keys).orderBy("year", "month")
    zero = F.lit(0).cast("decimal(28,2)")
    df = R.late_ratio(monthly.withColumn("total_count", F.col("n")), late, keys)
    df = df.withColumns({"export_value": F.coalesce("export_value", zero).cast("double"), "import_value": F.coalesce("import_value", zero).cast("double")})
    df = df.withColumn("balance", F.col("export_value") - F.col("import_value"))
    df = df.withColumns({"balance_delta": R.delta("balance", w), "export_growth": R.pct_change("export_value", w), "import_growth": R.pct_change("import_value", w)})
    return R.lags(df, "balance", w)


def naive_metrics(labelled: DataFrame, target: str, naive: str | float) -> DataFrame:
    """MAE and RMSE of a baseline that predicts a column or a constant."""
    error = F.col(target) - (F.col(naive) if isinstance(naive, str) else F.lit(naive))
    return labelled.where(F.col(target).isNotNull()).agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.count("*").alias("n"))


def horizon_calendar(anchors: DataFrame, run_month: str | Column, days: int, months: int) -> DataFrame:
    """(anchor columns, kind, i, k, target) for each row of anchors (as_of date, last_month date): FX targets are as_of +
    i days; balance targets are months from the run month on, i = 1 being k = max(1, months between) rows ahead."""
    run = F.lit(run_month).cast("date") if isinstance(run_month, str) else run_month
    gap = F.greatest(F.lit(1), F.months_between(run, F.col("last_month")).cast("int"))
    i = F.col("i")
    fx = anchors.select("*", F.lit("fx").alias("kind"), F.explode(F.sequence(F.lit(1), F.lit(days))).alias("i")).withColumns({"k": i, "target": F.date_add("as_of", i)})
    balance = anchors.select("*", F.lit("balance").alias("kind"), F.explode(F.sequence(F.lit(1), F.lit(months))).alias("i"))
    return fx.unionByName(balance.withColumns({"k": gap + i - 1, "target": F.add_months(F.col("last_month"), gap + i - 1)}))


def persistence_fallback(predicted: DataFrame, last: str = "last_value") -> DataFrame:
    """Horizons with fewer than MIN_LABELLED labelled rows predict the last value."""
    return predicted.withColumn("prediction", F.when(F.col("n_labelled") < MIN_LABELLED, F.col(last)).otherwise(F.col("prediction")))


def require_history(df: DataFrame, least: int) -> None:
    if df.limit(least).count() < least:
        raise SkipJob(f"fewer than {least} rows")


def train_horizons(features: DataFrame, columns: list[str], source: str, keys: list[str], order: str, horizons: list[int], trees: int = 200, depth: int = 4, rate: float = 0.1, level: str | None = None) -> DataFrame:
    """(keys, as_of, horizon, prediction, n_labelled, last_value, level, metrics): boosted trees for each horizon over all
    series, fitted on the first 80 % of each in time, that predict from each series' newest row with all features. level is
    a column of that row to pass on. A series with too few labelled rows gets its last value.

    mae and rmse are those of the model over the last 20 % of all series, naive_mae and naive_rmse those of `no change`
    (level given) or of the last value there; null without such rows. Features and labels of all horizons are computed in
    one pass and stored, and the trees of all horizons are grown together."""
    w = Window.partitionBy(*keys).orderBy(order)
    carried = [c for c in (level,) if c]
    inputs, targets, marks = [f"__f{i}" for i in range(len(columns))], [f"__y{k}" for k in horizons], [f"__t{k}" for k in horizons]
    full = features.withColumns({f"__y{k}": R.horizon_label(source, w, k).cast("double") for k in horizons}).na.drop(subset=columns)
    numbers = full.select(*keys, order, F.col(source).cast("double").alias("__last"), *[F.col(c).cast("double").alias(f"__c{i}") for i, c in enumerate(carried)], *[F.col(c).cast("double").alias(f"__f{i}") for i, c in enumerate(columns)], *targets)
    whole = Window.partitionBy(*keys)
    has = {k: F.col(f"__y{k}").isNotNull().cast("int") for k in horizons}
    split = {f"__t{k}": F.sum(has[k]).over(w.rowsBetween(Window.unboundedPreceding, 0)) <= F.floor(F.sum(has[k]).over(whole) * 0.8) for k in horizons}
    rows = features.sparkSession.read.parquet(store(numbers.withColumns(split), "risk-features"))
    model, (absolute, squared, tested) = boosting.fit(rows, inputs, targets, marks, trees, depth, rate)
    naive = {k: F.when(~F.col(f"__t{k}"), F.col(f"__y{k}") - (F.lit(0.0) if level else F.col("__last"))) for k in horizons}
    base = rows.agg(*[F.coalesce(F.sum(has[k]), F.lit(0)).alias(f"n{k}") for k in horizons], *[F.avg(F.abs(naive[k])).alias(f"a{k}") for k in horizons], *[F.sqrt(F.avg(naive[k] * naive[k])).alias(f"s{k}") for k in horizons]).first()
    counts = rows.groupBy(*keys).agg(*[F.sum(has[k]).alias(f"n{k}") for k in horizons])
    newest = R.latest_row(rows.select(*keys, order, "__last", *[f"__c{i}" for i in range(len(carried))], *inputs), keys, order)
    predicted = boosting.predict(newest, inputs, model, [f"p{k}" for k in horizons]).join(counts, keys)

    def of(i: int, k: int) -> Column:
        """The horizon's numbers; those of a model that no rows could be fitted to are null."""
        few = base[f"n{k}"] < MIN_LABELLED
        errors = [None, None] if few or not tested[i] else [float(absolute[i] / tested[i]), float((squared[i] / tested[i]) ** 0.5)]
        values = [*errors, *([None, None] if few else [base[f"a{k}"], base[f"s{k}"]])]
        guess = F.lit(None).cast("double") if few else F.col(f"p{k}")
        metrics = [F.lit(v).cast("double").alias(n) for v, n in zip(values, ("mae", "rmse", "naive_mae", "naive_rmse"), strict=True)]
        return F.struct(F.lit(k).alias("horizon"), guess.alias("prediction"), F.col(f"n{k}").alias("n_labelled"), *metrics)

    each = predicted.select(*keys, F.col(order).alias("as_of"), F.col("__last").alias("last_value"), *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carried)], F.explode(F.array(*[of(i, k) for i, k in enumerate(horizons)])).alias("h"))
    rows_out = persistence_fallback(each.select("*", "h.*").drop("h"))
    return rows_out.select(*keys, "as_of", "horizon", "prediction", "n_labelled", "last_value", *carried, "mae", "rmse", "naive_mae", "naive_rmse")


def risk_flags(pred: DataFrame, threshold: DataFrame, upper: bool, keys: list[str] | None = None) -> DataFrame:
    """high_risk: the prediction lies beyond the tail threshold, of its series where keys are given."""
    over = F.col("prediction") > F.col("threshold") if upper else F.col("prediction") < F.col("threshold")
    joined = pred.join(threshold, keys, "left") if keys else pred.join(threshold)
    return joined.withColumn("high_risk", F.coalesce(over, F.lit(False)))


def fx_targets(flagged: DataFrame) -> DataFrame:
    """Predicted changes as rates: the rate of the last day moved by the change, and the day that each is for."""
    return flagged.withColumns({"target_date": F.date_add("as_of", F.col("horizon")), "predicted_rate": F.col("rate") * (1 + F.col("prediction")), "as_of_rate": F.col("rate")})


def risk_report_data(targets: DataFrame, keys: list[str]) -> DataFrame:
    """The report's rows, one per series and target: change and rate predicted, flag and threshold, and the rate of the last day."""
    return targets.select(*keys, "target_date", "horizon", F.col("prediction").alias("predicted_change"), "predicted_rate", "high_risk", "threshold", "as_of", "as_of_rate")
