"""Joins, set operations, aggregations, windows and top-k of the trade model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# ---- joins ----
def denormalize_bilateral(records: DataFrame, country: DataFrame, product: DataFrame) -> DataFrame:
    """trade records with the names of both countries and, if known, of the product."""
    exporter = country.select(F.col("id").alias("exporter_id"), F.col("name").alias("exporter_name"))
    importer = country.select(F.col("id").alias("importer_id"), F.col("name").alias("importer_name"))
    label = product.select(F.col("code").alias("product_code"), F.col("label").alias("product_label"))
    return records.join(exporter, "exporter_id").join(importer, "importer_id").join(label, "product_code", "left")


def attach_time(df: DataFrame, dim_time: DataFrame) -> DataFrame:
    return df.join(dim_time, ["year", "month"])


def as_of_dimension(fact: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner", period: str = "period_start") -> DataFrame:
    """The dimension version that was valid on the period's first day: effective_date <= period < expiry_date."""
    d = dim.select(*[F.col(c).alias(f"__{c}") if c in (*keys, "effective_date", "expiry_date") else F.col(c) for c in dim.columns])
    same = reduce(Column.__and__, [fact[k] == d[f"__{k}"] for k in keys])
    valid = (d["__effective_date"] <= fact[period]) & (fact[period] < d["__expiry_date"])
    return fact.join(d, same & valid, how).drop(*[f"__{c}" for c in (*keys, "effective_date", "expiry_date")])


def new_keys_only(df: DataFrame, dim: DataFrame, key: str | list[str]) -> DataFrame:
    return df.join(dim, key, "left_anti")


def changed_rows(src: DataFrame, current: DataFrame, key: str, attrs: list[str]) -> DataFrame:
    """Source rows with any attribute, null read as blank, unlike the current version's."""
    now = current.select(key, *[F.col(a).alias(f"__{a}") for a in attrs])
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    differs = reduce(Column.__or__, [text(a) != text(f"__{a}") for a in attrs])
    return src.join(now, key).where(differs).drop(*[f"__{a}" for a in attrs])


def matched_null_safe(df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A semi or anti join on keys where null equals null."""
    o = other.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return df.join(o, reduce(Column.__and__, [df[k].eqNullSafe(o[f"__{k}"]) for k in keys]), how)


def delete_matching(target: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return target.join(keys.select(*on).distinct(), on, "left_anti")


def co_membership(trade: DataFrame, members: DataFrame, home: str) -> DataFrame:
    """(trade_id, fta_id) pairs of which the partner and the home country are both members of the agreement."""
    at_home = members.where(F.col("country_code") == home).select("fta_id").distinct()
    partners = members.join(at_home, "fta_id", "left_semi").select("fta_id", F.col("country_code").alias("partner_code")).distinct()
    return trade.join(partners, "partner_code").select("trade_id", "fta_id").distinct()


def agreement_bridge(members: DataFrame, dim_fta: DataFrame, dim_country: DataFrame) -> DataFrame:
    now_f = dim_fta.where("is_current").select("fta_id", "fta_key")
    now_c = dim_country.where("is_current").select("country_code", "country_key")
    return members.join(now_f, "fta_id").join(now_c, "country_code").select("fta_key", "country_key").distinct()


def role_play_currency(rates: DataFrame, dim_currency: DataFrame) -> DataFrame:
    """Rates with the key of the currency dimension in both its roles."""
    for role in ("base", "quote"):
        rates = rates.join(dim_currency.select(F.col("currency_code").alias(f"{role}_currency"), F.col("currency_key").alias(f"{role}_key")), f"{role}_currency")
    return rates


def actual_vs_forecast(actual: DataFrame, forecast: DataFrame, keys: list[str]) -> DataFrame:
    return actual.join(forecast, keys, "full_outer")


def restrict_to_panel(actual: DataFrame, forecast: DataFrame, keys: list[str]) -> DataFrame:
    return actual.join(forecast.select(*keys).distinct(), keys, "left_semi")


def late_ratio(monthly: DataFrame, late: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """monthly (keys, year, month, total_count) with the share of late rows (keys, year, month, late_count) of each series."""
    share = F.coalesce("late_count", F.lit(0)) / F.nullif(F.col("total_count").cast("double"), F.lit(0.0))
    return monthly.join(late, [*(keys or []), "year", "month"], "left").withColumn("late_ratio", F.coalesce(share, F.lit(0.0)))


def chapter_proxy(dim_product: DataFrame) -> DataFrame:
    """For each chapter the smallest current product key, which stands for it."""
    return dim_product.where("is_current").groupBy("chapter").agg(F.min("product_key").alias("proxy_key"))


# ---- sets ----
def union_sources(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def with_total_member(df: DataFrame, totals: DataFrame, member: str, name: str = "ALL") -> DataFrame:
    """Rows of the members and a row ALL per period that holds the denominator."""
    return df.unionByName(totals.withColumn(member, F.lit(name)))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in a total order (DISTINCT ON)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def dedupe_keep_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row per key; combined before the shuffle, so a frequent key is no heavy task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__r")).select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns])


# ---- aggregations ----
def rollup_to_grain(df: DataFrame, keys: list[str], sums: list[str], seq: str) -> DataFrame:
    """One row per key (null is a key): sums (all null: 0), and the last non-null value of every other column."""
    last = [c for c in df.columns if c not in (*keys, *sums, seq)]
    total = [F.coalesce(F.sum(c), F.lit(0)).cast("decimal(28,2)").alias(c) for c in sums]
    return df.groupBy(*keys).agg(*total, *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in last])


def most_frequent(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The most frequent value of each column on its own; of equals the smallest. Counted by value first, so that
    a group's values are never gathered."""
    out = None
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(key, c).agg(F.count("*").alias("__n"))
        best = counts.groupBy(key).agg(F.min(F.struct(-F.col("__n"), F.col(c))).alias("__b")).select(key, F.col(f"__b.{c}").alias(c))
        out = best if out is None else out.join(best, key, "full_outer")
    return df.select(key).distinct().join(out, key, "left")


def month_end_rate(rates: DataFrame, base: str, quote: str) -> DataFrame:
    """The last rate of each month of one currency pair."""
    pair = rates.where((F.col("base_currency") == base) & (F.col("quote_currency") == quote))
    return pair.groupBy(F.year("rate_date").alias("year"), F.month("rate_date").alias("month")).agg(F.max_by("vnd_per_usd", "rate_date").alias("exchange_rate"))


def agreement_keys(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("trade_id").agg(F.array_sort(F.collect_set("fta_key")).alias("fta_keys"))


def conditional_sums(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum(F.when(F.col("flow_type"), F.col(value))).alias("export_value"), F.sum(F.when(~F.col("flow_type"), F.col(value))).alias("import_value"), F.count("*").alias("n")
    )


def _trades_by_agreement(fact: DataFrame) -> DataFrame:
    """(time_key, partner_code, fta_key, trades): agreements hang on the partner and the period, so facts are counted by
    these first and never by agreement one by one."""
    counted = fact.groupBy("time_key", "partner_code", "fta_keys").agg(F.count("*").alias("trades"))
    return counted.select("time_key", "partner_code", "trades", F.explode("fta_keys").alias("fta_key"))


def utilization_by_agreement(fact: DataFrame, dim_fta: DataFrame) -> DataFrame:
    """Distinct trades per agreement name and period, and a row ALL per period with all trades. Versions of one name count a
    trade once."""
    named = _trades_by_agreement(fact).join(dim_fta.select("fta_key", "fta_name"), "fta_key").select("time_key", "partner_code", "fta_name", "trades").distinct()
    own = named.groupBy("fta_name", "time_key").agg(F.sum("trades").alias("trades"))
    return with_total_member(own, fact.groupBy("time_key").agg(F.count("*").alias("trades")), "fta_name")


def utilization_summary(fact: DataFrame) -> DataFrame:
    """Trades per agreement version, of all trades, and their percentage."""
    total = fact.agg(F.count("*").alias("total"))
    own = _trades_by_agreement(fact).groupBy("fta_key").agg(F.sum("trades").alias("trades"))
    return own.join(total).withColumn("rate", F.round((F.col("trades").cast("decimal(18,4)") * 100 / F.nullif("total", F.lit(0))), 2).cast("double"))


def advance_watermark(df: DataFrame, watermark: DataFrame) -> DataFrame:
    """The newest period per source; the stored one is replaced only by a strictly newer one."""
    seen = df.groupBy("source_system").agg(F.max(F.col("year") * 100 + F.col("month")).alias("__p"))
    old = watermark.select("source_system", (F.col("last_year") * 100 + F.col("last_month")).alias("__old"))
    p = F.greatest("__p", "__old")
    return old.join(seen, "source_system", "full_outer").select("source_system", F.floor(p / 100).cast("int").alias("last_year"), (p % 100).cast("int").alias("last_month"))


def advance_year_watermark(rates: DataFrame, watermark: DataFrame) -> DataFrame:
    seen = rates.groupBy("source_system").agg(F.max(F.year("rate_date")).alias("__y"))
    return watermark.join(seen, "source_system", "full_outer").select("source_system", F.greatest("__y", "last_year").cast("int").alias("last_year"))


def tail_threshold(df: DataFrame, column: str, k: float = 2.0, upper: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """mean ± k times the sample deviation."""
    side = F.avg(column) + (k if upper else -k) * F.stddev_samp(column)
    return df.groupBy(*keys).agg(side.alias("threshold"))


def source_profile(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.countDistinct("exporter_id").alias("exporters"), F.countDistinct("importer_id").alias("importers"))


def layer_counts(frames: dict[str, DataFrame], batch_id: str | None = None) -> DataFrame:
    scoped = {n: f.where(F.col("batch_id") == batch_id) if batch_id is not None and "batch_id" in f.columns else f for n, f in frames.items()}
    return reduce(DataFrame.unionByName, [f.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n, f in scoped.items()])


# ---- windows and top-k ----
def series_window(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def lags(df: DataFrame, column: str, w: Window, steps: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    return df.withColumns({f"{column}_lag{k}": F.lag(column, k).over(w) for k in steps})


def pct_change(column: str, w: Window) -> Column:
    """Change against the row before; null for a change from zero."""
    before = F.lag(column).over(w)
    return F.col(column) / F.nullif(before, F.lit(0).cast("double")) - 1


def delta(column: str, w: Window) -> Column:
    return F.col(column) - F.lag(column).over(w)


def rolling(column: str, w: Window, n: int, how: str) -> Column:
    """Mean or sample deviation of n rows; null until all n have a value."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(column).over(frame) == n, (F.avg if how == "mean" else F.stddev_samp)(column).over(frame))


def horizon_label(column: str, w: Window, k: int) -> Column:
    return F.lead(column, k).over(w)


def time_split(df: DataFrame, keys: list[str], order: str, share: float = 0.8) -> DataFrame:
    """is_train: the first floor(share * n) rows of each series."""
    w = Window.partitionBy(*keys)
    return df.withColumn("is_train", F.row_number().over(w.orderBy(order)) <= F.floor(F.count("*").over(w) * share))


def carry_forward(column: str, w: Window) -> Column:
    return F.last(F.nullif(F.trim(F.col(column)), F.lit("")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def latest_row(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__r")).select(*keys, "__r.*")


def top_count(df: DataFrame, n: int, measure: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(measure).desc(), F.col(tie)).limit(n)


def best_match(pairs: DataFrame, query: str, score: str, candidate: str, floor: float) -> DataFrame:
    """The best candidate per query at or above floor; of equals the first by name."""
    good = pairs.where(F.col(score) >= floor)
    return good.groupBy(query).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(candidate).alias("c"))).alias("__b")).select(query, F.col("__b.c").alias(candidate), (-F.col("__b.s")).alias(score))
