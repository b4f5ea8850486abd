"""Star schema plans: the trade fact, the exchange-rate fact, and the join of facts with their dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import surrogate_key, time_key, to_local_currency
from ..operators import merge
from ..operators import relational as R
from ..schemas import TRADE_KEY


def home_agreements(members: DataFrame, dim_fta: DataFrame, home: str) -> DataFrame:
    """(partner_code, fta_keys, effective_date, expiry_date): the agreement versions that a partner shares with the home
    country, for each span of time in which these are the same. They hang on the partner and the time alone, so they are
    found once per partner and not per trade."""
    partners = members.select(F.col("country_code").alias("partner_code"), F.col("country_code").alias("trade_id")).distinct()
    shared = R.co_membership(partners, members, home).withColumnRenamed("trade_id", "partner_code")
    versions = shared.join(dim_fta.select("fta_id", "fta_key", "effective_date", "expiry_date"), "fta_id").drop("fta_id")
    cuts = versions.select("partner_code", F.explode(F.array("effective_date", "expiry_date")).alias("at")).distinct()
    after = F.lead("at").over(Window.partitionBy("partner_code").orderBy("at"))
    spans = cuts.withColumn("until", after).where("until is not null")
    inside = spans.join(versions, "partner_code").where("effective_date <= at and at < expiry_date")
    keys = F.array_sort(F.collect_set("fta_key")).alias("fta_keys")
    return inside.groupBy("partner_code", F.col("at").alias("effective_date"), F.col("until").alias("expiry_date")).agg(keys)


def build_trade_fact(grain: DataFrame, dim_product: DataFrame, dim_country: DataFrame, rates: DataFrame, members: DataFrame, dim_fta: DataFrame, home: str, pair: tuple[str, str] = ("VND", "USD")) -> DataFrame:
    """Facts at their grain: product, country and agreements as valid on the month's first day, and the value in local
    currency at the month's last rate of the pair. Facts without a dimension version are left out (unresolved_facts() has
    them)."""
    facts = grain.withColumn("period_start", F.make_date("year", "month", F.lit(1)))
    products = dim_product.select("hs_code", "product_key", "effective_date", "expiry_date")
    partners = dim_country.select(F.col("country_code").alias("partner_code"), F.col("country_key").alias("partner_key"), "effective_date", "expiry_date")
    joined = R.as_of_dimension(R.as_of_dimension(facts, products, ["hs_code"]), partners, ["partner_code"])
    with_agreements = R.as_of_dimension(joined, home_agreements(members, dim_fta, home), ["partner_code"], "left")
    rich = with_agreements.join(R.month_end_rate(rates, *pair), ["year", "month"], "left")
    return rich.select(
        surrogate_key(*TRADE_KEY).alias("trade_key"), time_key("year", "month").alias("time_key"), "product_key", "partner_key", "flow_type", "source_system",
        "value", "quantity", "exchange_rate", to_local_currency("value", "exchange_rate").alias("value_vnd"), "fta_keys", "partner_code", *[c for c in ("unit", "batch_id") if c in grain.columns],
    )


def upsert_facts(facts: DataFrame, new: DataFrame) -> DataFrame:
    """The stored facts with those of a new run: a fact with the same business key (that its trade_key stands for) is replaced."""
    return merge.merge_overwrite(facts, new, ["trade_key"])


def unresolved_facts(grain: DataFrame, dim_product: DataFrame, dim_country: DataFrame) -> DataFrame:
    """Facts without a product or country version for their period; the product is tested first."""
    facts = grain.withColumn("period_start", F.make_date("year", "month", F.lit(1)))
    products = dim_product.select("hs_code", "product_key", "effective_date", "expiry_date")
    partners = dim_country.select(F.col("country_code").alias("partner_code"), F.col("country_key").alias("partner_key"), "effective_date", "expiry_date")
    joined = R.as_of_dimension(R.as_of_dimension(facts, products, ["hs_code"], "left"), partners, ["partner_code"], "left")
    reason = F.when(F.col("product_key").isNull(), "no_product_version").when(F.col("partner_key").isNull(), "no_country_version")
    return joined.withColumn("reject_reason", reason).where("reject_reason is not null").select(*TRADE_KEY, "reject_reason")


def build_fx_fact(rates: DataFrame, dim_currency: DataFrame, dim_time: DataFrame) -> DataFrame:
    dated = rates.withColumns({"year": F.year("rate_date"), "month": F.month("rate_date")})
    return R.attach_time(R.role_play_currency(dated, dim_currency), dim_time.select("year", "month", "time_key")).select("rate_date", "time_key", "base_key", "quote_key", "vnd_per_usd")


def one_rate_a_day(rates: DataFrame) -> DataFrame:
    """Rates at the grain of the exchange-rate fact: of several rates of a day and pair the largest. To be taken before the
    dimensions are joined: where a source has one pair only, the join with the currencies is a product of its rows."""
    return rates.groupBy("rate_date", "base_currency", "quote_currency").agg(F.max("vnd_per_usd").alias("vnd_per_usd"))


def star(fact: DataFrame, dim_product: DataFrame, dim_country: DataFrame, dim_time: DataFrame) -> DataFrame:
    """Facts with their dimensions as the cube sees them: current versions only, so facts of ended versions do not show
    in slices by product or country."""
    products = dim_product.where("is_current").select("product_key", "hs_code", "heading", "chapter", "product_name")
    partners = dim_country.where("is_current").select(F.col("country_key").alias("partner_key"), "country_name", "region", "continent")
    return fact.join(products, "product_key").join(partners, "partner_key").join(dim_time, "time_key")
