"""Filters, business rules and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import normalize_currency


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def filter_target_trade(df: DataFrame, target: str, min_value: float, exporter: str = "exporter_name", importer: str = "importer_name") -> DataFrame:
    """Single products traded with target above min_value (value_k is in thousands)."""
    total = F.upper(F.trim("product_code")) == "TOTAL"
    either = F.trim(F.col(exporter)).ilike(target) | F.trim(F.col(importer)).ilike(target)
    return df.where(F.col("product_code").isNotNull() & ~total & either & (F.coalesce("value_k", F.lit(0).cast("decimal(18,2)")) * 1000 > min_value))


def kept_dropped_counts(df: DataFrame, keep: Column) -> DataFrame:
    return df.agg(F.count_if(keep).alias("kept"), F.count_if(~F.coalesce(keep, F.lit(False))).alias("dropped"))


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def reject_reason(iso: Column) -> Column:
    """The first rule that a trade row breaks, null if none: iso says whether the partner code is a real one."""
    return (
        F.when(blank("hs_code"), "missing_hs_code")
        .when(~F.col("hs_code").rlike("^[0-9]{2,8}$"), "invalid_hs_code_format")
        .when(blank("partner_code"), "missing_partner_code")
        .when(~iso, "invalid_partner_code")
        .when(F.coalesce(F.col("value") <= 0, F.lit(True)), "invalid_value")
    )


def judged(df: DataFrame, iso: DataFrame) -> DataFrame:
    """df with reject_reason; iso has the real codes in its column iso3."""
    codes = iso.select(F.upper("iso3").alias("__iso")).distinct()
    joined = df.join(codes, F.upper("partner_code") == F.col("__iso"), "left")
    return joined.withColumn("reject_reason", reject_reason(F.col("__iso").isNotNull())).drop("__iso")


def valid_trade(df: DataFrame, iso: DataFrame) -> DataFrame:
    return judged(df, iso).where("reject_reason is null").drop("reject_reason")


def classify_rejects(df: DataFrame, iso: DataFrame) -> DataFrame:
    """Exactly the rows that valid_trade() leaves out, with the reason."""
    return judged(df, iso).where("reject_reason is not null")


def invalid_codes(df: DataFrame, iso: DataFrame) -> DataFrame:
    """Distinct partner codes, in upper case, that are not real ones."""
    codes = df.where(~blank("partner_code")).select(F.upper("partner_code").alias("partner_code")).distinct()
    return codes.join(iso.select(F.upper("iso3").alias("partner_code")), "partner_code", "left_anti")


def rated(df: DataFrame) -> DataFrame:
    """Rate rows typed, with reject_reason; the date is tested before the rate."""
    day = F.try_to_date(F.trim("rate_date"), "yyyy-MM-dd")
    rate = F.col("rate").try_cast("decimal(18,10)")
    reason = F.when(day.isNull(), "invalid_rate_date").when(F.coalesce(rate <= 0, F.lit(True)), "invalid_rate_value")
    kept = [c for c in df.columns if c not in ("rate_date", "base_currency", "quote_currency", "rate")]
    return df.select(*kept, day.alias("rate_date"), normalize_currency("base_currency").alias("base_currency"), normalize_currency("quote_currency").alias("quote_currency"), rate.alias("rate"), reason.alias("reject_reason"))


def split_rate_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, rejects)."""
    all_rows = rated(df)
    return all_rows.where("reject_reason is null").drop("reject_reason"), all_rows.where("reject_reason is not null")


def scope_to_batch(df: DataFrame, batch_id: str | None) -> DataFrame:
    return df if batch_id is None else df.where(F.col("batch_id") == batch_id)


def reject_summary(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("reject_reason").agg(F.count("*").alias("n"))
