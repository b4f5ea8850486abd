"""Trade agreements: typing, members, use by trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean
from ..sources.agreement_columns import HEADERS, PROVISIONS, RENAMED, YES_NO
from .match import resolve_country_by_name

#: Lower-cased labels and their spelling.
STATUSES = {
    "entry into force": "Entry into Force",
    "under negotiation": "Under Negotiation",
    "terminated": "Terminated",
    "signed & pending ratification": "Signed & Pending ratification",
    "suspension": "Suspension",
}
SCOPES = {
    "bilateral": "Bilateral",
    "country - bloc": "Country - Bloc",
    "plurilateral": "Plurilateral",
    "bloc - bloc": "Bloc - Bloc",
}
SOURCE = "APTIAD"


def typed(column: str) -> Column:
    """The typed form of a stage column of agreements, under its later name."""
    if column == "aptiad_no":
        out = F.col(column).try_cast("int")
    elif column == "members_raw":
        out = clean.parse_members(column)
    elif column in ("status", "scope"):
        out = clean.normalize_label(column, STATUSES if column == "status" else SCOPES)
    elif column in YES_NO:
        out = clean.yes_no(column)
    elif "year" in column.split("_"):
        out = clean.four_digit_year(column)
    else:
        out = clean.null_if_blank(column)
    return out.alias(RENAMED.get(column, f"provision_{column}" if column in PROVISIONS else column))


def agreements_to_ods(df: DataFrame) -> DataFrame:
    """Typed agreement records from stage columns (those that df has): blank texts are null, years need four digits,
    status and scope are normalised, members become a list, yes/no columns booleans, provisions get a prefix."""
    kept = [F.col(c) for c in ("snapshot_date", "batch_id") if c in df.columns]
    return df.select(*[typed(c) for c in HEADERS.values() if c in df.columns], F.lit(SOURCE).alias("source_system"), *kept)


def explode_members(fta: DataFrame, ref: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((fta_id, country_code) of members whose name resolves, names that do not with their count)."""
    names = fta.select("fta_id", F.explode("members").alias("name")).where("trim(name) <> ''").withColumn("name", F.trim("name"))
    resolved = names.join(resolve_country_by_name(names, ref, aliases).select("name", "iso3"), "name", "left")
    return (
        resolved.where("iso3 is not null").select("fta_id", F.col("iso3").alias("country_code")).distinct(),
        resolved.where("iso3 is null").groupBy("name").agg(F.count("*").alias("n")),
    )


def fact_agreement_bridge(fact: DataFrame) -> DataFrame:
    return fact.select("trade_key", F.explode("fta_keys").alias("fta_key"))


def agreement_dimension(dim_fta: DataFrame) -> DataFrame:
    """Names of current agreements, and ALL."""
    names = dim_fta.where("is_current").select("fta_name").distinct()
    return names.unionByName(names.sparkSession.range(1).select(F.lit("ALL").alias("fta_name")))
