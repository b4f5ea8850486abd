"""Layer plans: stage to ods, ods to nds, nds to dds, and their chain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean
from ..operators import agreements, late, match, merge, rules
from ..operators import relational as R
from ..schemas import ODS_TRADE, TRADE_KEY
from ..sources import sinks, tables
from ..sources.sinks import kept
from . import star as S

#: Keywords, in order, and the commodity code that they stand for.
KEYWORD_RULES = [
    ("soybean", "120190"),
    ("soybeans", "120190"),
    ("casava", "071410"),
    ("cassava", "071410"),
    ("seafood", "030399"),
    ("fish", "030399"),
    ("shrimp", "030617"),
    ("prawn", "030617"),
    ("chemicals", "380300"),
    ("motor vehicle", "870390"),
    ("motor vehicles", "870390"),
    ("vehicles", "870390"),
    ("plastic", "392690"),
    ("rattan", "940383"),
    ("bamboo", "940382"),
    ("animal fodder", "230990"),
    ("pottery", "691200"),
    ("crude oil", "270900"),
]
#: Misspelt country names.
COUNTRY_ALIASES = {
    "MYANMA": "Myanmar",
    "MEHICO": "Mexico",
    "BRAXIN": "Brazil",
    "HUNGARI": "Hungary",
    "ACHENTINA": "Argentina",
    "PHILIPIN": "Philippines",
    "NIGIERIA": "Nigeria",
    "UCRAINA": "Ukraine",
}


@dataclass
class References:
    """iso: (iso3, name, region, continent); aliases: (alias, name); nomenclature: (hscode, description, level); variants of
    country names: (variant, iso3)."""

    iso: DataFrame
    aliases: DataFrame
    nomenclature: DataFrame
    variants: DataFrame | None = None


def csv_to_unified(df: DataFrame) -> DataFrame:
    """Reports of partner countries: the reporter is the partner, so what it imports is an export here."""
    year, month = clean.split_period("period")
    flow = F.when(F.lower(F.trim("flow_desc")) == "import", True).when(F.lower(F.trim("flow_desc")) == "export", False)
    return df.select(year.alias("year"), month.alias("month"), F.col("cmd_code").alias("hs_code"), F.col("cmd_desc").alias("product_name"), F.col("reporter_iso").alias("partner_code"), F.col("reporter_desc").alias("partner_name"), flow.alias("flow_type"), F.col("primary_value").alias("value"), F.col("qty").alias("quantity"), F.col("qty_unit").alias("unit"), F.lit("UN_COMTRADE").alias("source_system"))


def text_to_unified(df: DataFrame) -> DataFrame:
    return df.select("year", "month", F.lit("").alias("hs_code"), F.col("goods").alias("product_name"), F.lit("").alias("partner_code"), F.col("country").alias("partner_name"), "flow_type", "value", "quantity", F.lit("ton").alias("unit"), F.lit("NSO").alias("source_system"))


def bilateral_to_unified(df: DataFrame, target: str, min_value: float = 0) -> DataFrame:
    """df: exporter_name, importer_name, product_code, product_label, year, month, value_k. Target as importer is an
    import; the other side is the partner."""
    kept = rules.filter_target_trade(df, target, min_value)
    imports = F.trim("importer_name").ilike(target)
    partner = F.when(imports, F.col("exporter_name")).otherwise(F.col("importer_name"))
    return kept.select("year", "month", F.col("product_code").alias("hs_code"), F.col("product_label").alias("product_name"), F.lit("").alias("partner_code"), partner.alias("partner_name"), (~imports).alias("flow_type"), (F.col("value_k") * 1000).cast("decimal(18,6)").alias("value"), F.lit(0).cast("decimal(18,6)").alias("quantity"), F.lit("").alias("unit"), F.lit("TRADE_MAP").alias("source_system"))


def hs_description(df: DataFrame, nomenclature: DataFrame, column: str = "hs_code") -> DataFrame:
    """df with hs_description: that of the code or else of its longest known even prefix; blank if there is none. It hangs on the
    code alone, so it is found once a code and not per row: all rows of shorter codes would meet in one task."""
    table = kept(nomenclature.select(F.col("hscode").alias("__code"), F.col("description").alias("__text")), "nomenclature")
    codes, found = df.select(F.col(column).alias("__own")).where("__own is not null").distinct(), []
    for n in (8, 6, 4, 2):
        name = f"__d{n}"
        codes = codes.join(table.withColumnRenamed("__text", name), F.when(F.length("__own") >= n, F.left("__own", F.lit(n))) == F.col("__code"), "left").drop("__code")
        found.append(name)
    described = kept(codes.select("__own", F.coalesce(*found).alias("hs_description")), "descriptions")
    return df.join(described, F.col(column) == F.col("__own"), "left").drop("__own").withColumn("hs_description", F.coalesce("hs_description", F.lit("")))


def stage_rows(unified: DataFrame, refs: References, watermark: DataFrame, ods: DataFrame, batch_id: str, arrival: str | None = None) -> DataFrame:
    """The batch's rows of ods: blank codes inferred, hierarchy and description, countries by code or name, late rows
    marked, rolled up to the grain. Of texts that differ within the grain the last to arrive counts: by the column arrival, where
    there is one, else by the texts."""
    corpus = refs.nomenclature.where("level = 6").select(F.col("hscode").alias("doc_id"), F.col("description").alias("text"))
    coded = match.infer_codes(unified, "hs_code", "product_name", "hs_code", KEYWORD_RULES, corpus)
    code, chapter, heading = clean.hs_hierarchy("hs_code")
    coded = hs_description(coded.withColumns({"chapter": chapter, "heading": heading, "hs_code": code}), refs.nomenclature)
    coded = coded.withColumn("product_name", F.coalesce(F.nullif("hs_description", F.lit("")), "product_name")).drop("hs_description")
    resolved = match.resolve_country_by_name(coded.select(F.col("partner_name").alias("name")), refs.iso, refs.aliases, variants=refs.variants).select(F.upper("name").alias("__name"), F.col("iso3").alias("__iso")).dropDuplicates(["__name"])
    resolved = kept(resolved, "names")
    named = coded.join(resolved, F.upper(F.trim("partner_name")) == F.col("__name"), "left").withColumn("partner_code", F.coalesce(F.nullif(F.trim("partner_code"), F.lit("")), "__iso")).drop("__name", "__iso")
    # names and lateness hang on the key, so they are found once a group and are not carried through the roll-up. Nearly every row is a
    # group of its own: rows are dealt by key as they are, and what orders them is made where they are summed
    texts = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("value", "quantity", "unit", "product_name")])
    parts = int(unified.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moved = named.withColumn("blank", F.col("chapter") == "").select(*TRADE_KEY, "value", "quantity", "unit", "product_name", "blank", *([F.col(arrival).alias("arrived")] if arrival else []))
    own = moved.repartition(parts, *TRADE_KEY).withColumn("seq", F.struct("arrived", texts) if arrival else texts).drop("arrived")
    level = lambda n: F.when(F.col("blank"), "").otherwise(F.left("hs_code", F.lit(n)))
    summed = R.rollup_to_grain(own, TRADE_KEY, ["value", "quantity"], "seq").withColumns({"chapter": level(2), "heading": level(4)})
    placed = match.resolve_country_by_code(summed, refs.iso).withColumns({"quarter": clean.quarter_of("month"), "batch_id": F.lit(batch_id)})
    rolled = late.detect_late(placed, watermark, ods, TRADE_KEY)
    return rolled.withColumn("ods_id", clean.surrogate_key(*TRADE_KEY)).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ods.schema.fields])


#: Surrogate keys of trade rows, which the business key gives.
HASHES = ("ods_id", "trade_id")


def kept_trade(df: DataFrame, name: str) -> DataFrame:
    """A table of trade rows, stored without the hashes that their business key gives."""
    return kept(df, name, clean.surrogate_key(*TRADE_KEY), HASHES)


def staged(unified: DataFrame, refs: References, watermark: DataFrame, ods: DataFrame, batch_id: str, arrival: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the batch's rows, which are stored; new ods): stage_rows() merged into ods. Where that is empty, the batch is the new table."""
    first = ods.isEmpty()
    ods = ods.limit(0) if first else ods  # Spark knows it to be empty: nothing is joined
    stage = kept(unified, "stage")
    typed = kept_trade(stage_rows(stage, refs, watermark, ods, batch_id, arrival), "ods-batch")
    sinks.discard(stage)
    return typed, typed if first else merge.merge_accumulate(ods, typed, TRADE_KEY, ["value", "quantity"])


def stage_to_ods(unified: DataFrame, refs: References, watermark: DataFrame, ods: DataFrame, batch_id: str, arrival: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new ods, new watermark, late rows): stage_rows() merged into ods. Stage and batch are stored, as each is read several times."""
    typed, new_ods = staged(unified, refs, watermark, ods, batch_id, arrival)
    return new_ods, R.advance_watermark(typed, watermark), typed.where("is_late_arriving")


#: The period of a trade row, by which its table is laid out; it is part of the key.
PERIOD = "year * 100 + month"


def load_batch(unified: DataFrame, refs: References, watermark: DataFrame, home: str, batch_id: str, arrival: str | None = None) -> dict:
    """Load one batch into the tables under home: its rows into ods, those that break a rule with their payload into rejects,
    late keys into late_audit. Returns the record of ods. A batch that is there already changes nothing, and one whose run ended
    early is taken up where it ended; rows read and written follow the batch."""
    spark = unified.sparkSession
    if done := tables.committed(spark, f"{home}/ods", batch_id):
        return done
    unified = kept(unified, "stage")
    touched = tables.periods_of(unified, PERIOD)
    ods = tables.read(spark, f"{home}/ods", ODS_TRADE, touched)
    rows = kept_trade(stage_rows(unified, refs, watermark, ods, batch_id, arrival), "ods-batch")
    extracted, loaded = unified.count(), rows.count()
    sinks.discard(unified)
    broken = rules.classify_rejects(rows, refs.iso)
    payload = broken.select("batch_id", F.lit("ods_trade").alias("source_table"), "reject_reason", clean.reject_payload(*rows.columns).alias("payload"))
    rejected = tables.append_batch(spark, f"{home}/rejects", payload, batch_id)["rows_after"]
    tables.append_batch(spark, f"{home}/late_audit", rows.where("is_late_arriving").select(*TRADE_KEY, "batch_id"), batch_id)
    accumulate = lambda old, new: merge.merge_accumulate(old, new, TRADE_KEY, ["value", "quantity"])
    record = tables.merge_batch(spark, f"{home}/ods", rows, batch_id, PERIOD, accumulate, stored=True, derived={"ods_id": clean.surrogate_key(*TRADE_KEY)}, rows_extracted=extracted, rows_loaded=loaded, rows_rejected=rejected)
    sinks.discard(rows)
    return record


def ods_to_nds(ods: DataFrame, fta: DataFrame, rates: DataFrame, refs: References, home: str, batch_id: str | None = None) -> dict[str, DataFrame]:
    """The normalised tables of the (batch's) valid rows, and their rejects."""
    scoped = rules.scope_to_batch(ods, batch_id)
    valid, rejects = rules.valid_trade(scoped, refs.iso), rules.classify_rejects(scoped, refs.iso)
    trade = valid.withColumn("trade_id", clean.surrogate_key(*TRADE_KEY))
    country = R.most_frequent(trade, "partner_code", ["partner_name", "region", "continent"])
    product = R.first_of(trade.select("hs_code", "product_name", "heading", "chapter"), ["hs_code"], [F.col("product_name").asc_nulls_last(), "heading", "chapter"])
    member, unresolved = agreements.explode_members(fta, refs.iso, refs.aliases)
    member = kept(member, "members")  # a few rows, which are met by all trades: joins are to know that
    used = R.co_membership(trade.withColumn("trade_id", F.unhex("trade_id")), member, home).withColumn("trade_id", F.lower(F.hex("trade_id")))
    clean_rates, rate_rejects = rules.split_rate_rejects(rates)
    return {
        "country": country, "product": product, "time": trade.select("year", "quarter", "month").distinct(), "fta": fta.drop("members"), "fta_member": member, "fta_member_unresolved": unresolved,
        "trade_transaction": trade, "fta_utilization": used, "currency": clean_rates.select(F.col("base_currency").alias("currency_code")).unionByName(clean_rates.select(F.col("quote_currency").alias("currency_code"))).distinct(),
        "exchange_rate": clean_rates.withColumn("vnd_per_usd", clean.inverse_rate("rate")), "rejects": rejects, "rate_rejects": rate_rejects,
    }


def nds_to_dds(nds: dict[str, DataFrame], dims: dict[str, DataFrame], run_date: str, home: str) -> dict[str, DataFrame]:
    """The star schema: dimensions with history, which are stored, the agreement bridge and the facts; with normalised currencies
    also their dimension and the exchange-rate fact, in the months that have trade. dims holds the dimensions so far, and under fact_trade the facts, if there are any: facts with the same business key are replaced."""
    country = merge.scd2_apply(dims["dim_country"], nds["country"].withColumnRenamed("partner_code", "country_code").withColumnRenamed("partner_name", "country_name"), "country_code", ["country_name", "region", "continent"], run_date, "country_key")
    product = merge.scd2_apply(dims["dim_product"], nds["product"], "hs_code", ["product_name", "heading", "chapter"], run_date, "product_key")
    fta = merge.scd2_apply(dims["dim_fta"], nds["fta"], "fta_id", ["fta_name"], run_date, "fta_key")
    country, product, fta = kept(country, "dds-country"), kept(product, "dds-product"), kept(fta, "dds-fta")
    time = nds["time"].select(clean.time_key("year", "month").alias("time_key"), "year", "quarter", "month")
    fact = S.build_trade_fact(nds["trade_transaction"], product, country, nds["exchange_rate"], nds["fta_member"], fta, home)
    if "fact_trade" in dims:
        fact = S.upsert_facts(dims["fact_trade"], fact)
    rated = {}
    if "currency" in nds:
        currency = merge.merge_currencies(dims.get("dim_currency"), nds["currency"])
        rated = {"dim_currency": kept(currency, "dds-currency")}
        rated["fact_exchange_rate"] = S.build_fx_fact(S.one_rate_a_day(nds["exchange_rate"]), rated["dim_currency"], time)
    return rated | {"dim_country": country, "dim_product": product, "dim_fta": fta, "dim_time": time, "dim_fta_country": R.agreement_bridge(nds["fta_member"], fta, country), "fact_trade": fact, "fact_rejects": S.unresolved_facts(nds["trade_transaction"], product, country)}


def batch_metrics(extracted: DataFrame, loaded: DataFrame, rejects: DataFrame, stored: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Rows per batch in each of the three, and the batch's status: it failed if rows came and none was loaded. With the rows
    stored before and the business key, also how many loaded rows replaced one (rows_upserted)."""
    counts = [df.groupBy("batch_id").agg(F.count("*").alias(n)) for df, n in ((extracted, "rows_extracted"), (loaded, "rows_loaded"), (rejects, "rows_rejected"))]
    if stored is not None:
        counts.append(R.matched_null_safe(loaded, stored, keys, "left_semi").groupBy("batch_id").agg(F.count("*").alias("rows_upserted")))
    out = counts[0]
    for c in counts[1:]:
        out = out.join(c, "batch_id", "full_outer")
    return out.na.fill(0).withColumn("status", F.when((F.col("rows_extracted") > 0) & (F.col("rows_loaded") == 0), "FAILED").otherwise("SUCCESS"))


def layered_load(unified: DataFrame, fta: DataFrame, rates: DataFrame, refs: References, ods: DataFrame, watermark: DataFrame, dims: dict[str, DataFrame], run_date: str, home: str, batch_id: str, full: bool = True) -> dict[str, DataFrame]:
    """Stage to star, with every layer's tables stored before the next reads them; with full=False only the batch's rows go on
    from ods."""
    typed, new_ods = staged(unified, refs, watermark, ods, batch_id)
    new_ods, late_rows = kept_trade(new_ods, "ods-trade"), kept_trade(typed.where("is_late_arriving"), "ods-late")
    new_watermark = kept(R.advance_watermark(typed, watermark), "ods-watermark")
    if new_ods is not typed:
        sinks.discard(typed)
    hashed = ("trade_transaction", "rejects")
    nds = {n: (kept_trade if n in hashed else kept)(df, f"nds-{n}") for n, df in ods_to_nds(new_ods, fta, rates, refs, home, None if full else batch_id).items()}
    return {"ods": new_ods, "watermark": new_watermark, "late": late_rows, **{f"nds_{n}": df for n, df in nds.items()}, **nds_to_dds(nds, dims, run_date, home)}
