"""Stage to ods: what hangs on a code or a key is found once for it."""

import os
import re
from decimal import Decimal

from pyspark.sql import functions as F

from tradelake.functions import clean
from tradelake.plans import layers
from tradelake.schemas import ODS_TRADE, TRADE_KEY
from tradelake.sources import sinks, tables


def test_descriptions_are_found_once_a_code(spark):
    df = spark.createDataFrame([("0101",)] * 3 + [("01011299",), ("",), (None,), ("7",), ("020399",)], "hs_code string")
    table = spark.createDataFrame([("01", "animals"), ("0101", "horses"), ("0203", "pork")], "hscode string, description string")
    out = layers.hs_description(df, table)
    assert sorted((str(r.hs_code), r.hs_description) for r in out.collect()) == [("", ""), ("0101", "horses"), ("0101", "horses"), ("0101", "horses"), ("01011299", "horses"), ("020399", "pork"), ("7", ""), ("None", "")]
    # one join with the stored descriptions, not one for each length of prefix
    assert len(re.findall(r"^.*Join", out._jdf.queryExecution().optimizedPlan().toString(), re.M)) == 1


def scratch(spark, name):
    folder = sinks.scratch_folder(spark).removeprefix("file://")
    return {n for n in os.listdir(folder) if n.startswith(f"tradelake-{name}-")}


UNIFIED = "year int, month int, hs_code string, product_name string, partner_code string, partner_name string, flow_type boolean, value decimal(18,6), quantity decimal(18,6), unit string, source_system string, n int"


def inputs(spark):
    """Rows of one key, of which one has a blank code, and a row of another key."""
    rows = [(2025, 4, "", "zzz", "JPN", "x", True, Decimal(5), None, "kg", "NSO", 1), (2025, 4, "000000", "zzz", "JPN", "x", True, Decimal(3), None, None, "NSO", 2), (2024, 1, "90111", "c", "VNM", "x", False, Decimal(1), Decimal(2), "t", "NSO", 3)]
    iso = spark.createDataFrame([("JPN", "Japan", "East", "Asia"), ("VNM", "Viet Nam", "South", "Asia")], "iso3 string, name string, region string, continent string")
    refs = layers.References(iso, spark.createDataFrame([], "alias string, name string"), spark.createDataFrame([("09", "coffee", 2)], "hscode string, description string, level int"))
    return spark.createDataFrame(rows, UNIFIED), refs, spark.createDataFrame([("NSO", 2024, 6)], "source_system string, last_year int, last_month int")


def test_rows_are_dealt_as_they_are(spark):
    """The last row's parents count, as do its texts that are not null; rows move once and are sorted once."""
    unified, refs, mark = inputs(spark)
    for order, parents in ((F.col("n"), ("00", "0000")), (-F.col("n"), ("", ""))):
        out = layers.stage_rows(unified.withColumn("n", order), refs, mark, spark.createDataFrame([], ODS_TRADE).limit(0), "B1", "n")
        got = {r.hs_code: r for r in out.collect()}
        assert (got["000000"].chapter, got["000000"].heading) == parents and got["000000"].unit == "kg" and got["000000"].value == 8 and got["000000"].quantity == 0
        assert (got["090111"].chapter, got["090111"].heading, got["090111"].product_name, got["090111"].is_late_arriving) == ("09", "0901", "coffee", True)
        assert len(re.findall(r"RepartitionByExpression \[year", out._jdf.queryExecution().optimizedPlan().toString())) == 1


def test_keys_are_stored_only_where_the_row_does_not_give_them(spark):
    unified, refs, mark = inputs(spark)
    rows = layers.stage_rows(unified, refs, mark, spark.createDataFrame([], ODS_TRADE).limit(0), "B1").withColumn("trade_id", clean.surrogate_key(*TRADE_KEY))
    odd = rows.unionByName(rows.withColumn("ods_id", F.lit("foreign"))).unionByName(rows.withColumn("ods_id", F.lit(None).cast("string")))
    out = layers.kept_trade(odd, "odd")
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    held = spark.read.parquet(out.inputFiles()[0].rpartition("/")[0])
    assert held.where("ods_id is not null").count() == 4 and held.where("trade_id is not null").count() == 0
    assert sinks.kept(out, "again") is out and not scratch(spark, "again")


def test_a_first_load_is_stored_once(spark):
    unified, refs, mark = inputs(spark)
    before = {n: scratch(spark, n) for n in ("stage", "ods-batch", "ods-trade")}
    new, marks, late = layers.stage_to_ods(unified, refs, mark, spark.createDataFrame([], ODS_TRADE), "B1")
    assert new.count() == 2 and late.count() == 1 and [tuple(r) for r in marks.collect()] == [("NSO", 2025, 4)]
    assert scratch(spark, "stage") == before["stage"] and scratch(spark, "ods-trade") == before["ods-trade"] and len(scratch(spark, "ods-batch") - before["ods-batch"]) == 1
    again, _, late = layers.stage_to_ods(unified, refs, mark, new, "B1")
    assert {r.hs_code: (r.value, r.ods_id) for r in again.collect()} == {r.hs_code: (2 * r.value, r.ods_id) for r in new.collect()} and late.count() == 0


def test_a_loaded_batch_leaves_no_copies(spark, tmp_path):
    unified, refs, mark = inputs(spark)
    before = {n: scratch(spark, n) for n in ("stage", "ods-batch")}
    for batch in ("B1", "B2"):
        assert layers.load_batch(unified, refs, mark, str(tmp_path), batch)["rows_after"] == 2
    assert {n: scratch(spark, n) for n in before} == before
    held = tables.read(spark, f"{tmp_path}/ods", ODS_TRADE)
    assert held.where("batch_id = 'B2'").count() == 2 == held.where(F.col("ods_id") == clean.surrogate_key(*TRADE_KEY)).count()


def test_a_layered_load_stores_trades_once_a_layer_and_without_hashes(spark):
    unified, refs, mark = inputs(spark)
    empty = lambda s: spark.createDataFrame([], s + ", version int, effective_date date, expiry_date date, is_current boolean")
    dims = {"dim_country": empty("country_key long, country_code string, country_name string, region string, continent string"), "dim_product": empty("product_key long, hs_code string, product_name string, heading string, chapter string"), "dim_fta": empty("fta_key long, fta_id int, fta_name string")}
    fta = spark.createDataFrame([(1, "Pact", ["Japan", "Viet Nam"])], "fta_id int, fta_name string, members array<string>")
    rates = spark.createDataFrame([("2025-04-30", "VND", "USD", "0.00004")], "rate_date string, base_currency string, quote_currency string, rate string")
    before = scratch(spark, "ods-trade")
    out = layers.layered_load(unified, fta, rates, refs, spark.createDataFrame([], ODS_TRADE), mark, dims, "2025-05-01", "VNM", "B1")
    assert scratch(spark, "ods-trade") == before and out["ods"].count() == 2 and out["late"].count() == 1
    trades = {r.trade_id: r.ods_id for r in out["nds_trade_transaction"].collect()}
    assert len(trades) == 2 and all(k == v and len(k) == 32 for k, v in trades.items())
    assert {(r.trade_id, r.fta_id) for r in out["nds_fta_utilization"].collect()} == {(k, 1) for k in trades}
    held = spark.read.parquet(out["nds_trade_transaction"].inputFiles()[0].rpartition("/")[0])
    assert held.where("ods_id is not null or trade_id is not null").count() == 0
