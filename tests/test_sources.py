"""File sources and sinks over generated files."""

import datetime

import pytest
from pyspark.sql import functions as F

from tradelake.plans import layers
from tradelake.schemas import ODS_TRADE
from tradelake.sources import files, sinks
from tradelake.sources.agreement_columns import HEADERS


def test_trade_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(
        "period,cmdCode,cmdDesc,reporterISO,reporterDesc,partnerISO,partnerDesc,flowCode,flowDesc,primaryValue,cifvalue,fobvalue,netWgt,qty,qtyUnitAbbr,motCode,motDesc,extra\n"
        "202504,090111,Café,JPN,Japan,VNM,Viet Nam,M,Import,1500.25,,,10,10,kg,0,TOTAL,1\n"
        "202504,90111,Coffee,KOR,Rep. of Korea,VNM,Viet Nam,X,Export,abc,,,1,1,kg,0,TOTAL,1\n".encode("latin-1")
    )
    df = files.clean_trade_csv(files.read_trade_csv(spark, str(tmp_path)))
    got = layers.csv_to_unified(df).orderBy("partner_code").collect()
    assert [(r.hs_code, r.product_name, r.flow_type, r.value) for r in got] == [("090111", "Café", True, got[0].value), ("90111", "Coffee", False, None)]
    assert float(got[0].value) == 1500.25 and (got[0].year, got[0].month) == (2025, 4)


def test_agreements_csv(spark, tmp_path):
    path = tmp_path / "APTIAD_01.06.2025.csv"
    names = list(HEADERS)
    path.write_text("﻿" + ",".join(f'"{n}"' for n in names) + "\n" + ",".join(["1", "T", '"A; B"'] + ["Yes"] * (len(names) - 3)) + "\n", encoding="utf-8")
    row = files.read_agreements_csv(spark, str(path)).first()
    assert (row.aptiad_no, row.members_raw, row.snapshot_date, row.source_file) == ("1", "A; B", datetime.date(2025, 6, 1), path.name)
    (tmp_path / "bad.csv").write_text("No.,Nonsense\n1,2\n")
    with pytest.raises(ValueError, match="unknown headers"):
        files.read_agreements_csv(spark, str(tmp_path / "bad.csv"))


def test_text_report(spark, tmp_path):
    text = "Exports of goods by country, 2025\n\t2 months\nGoods\tCountry\t\nFishery products\t\t\n\tJapan\t10\t1,200\t12\t1,300\n\tChina\t5\t700\t6\t800\t11\nOf which:\t\t\nRice\t\t\n\tKorea\t1\t2\t\t\n"
    (tmp_path / "r.txt").write_bytes(text.encode("utf-16"))
    report = files.read_monthly_text_report(spark, str(tmp_path / "*.txt"))
    got = {r.country: r for r in report.collect()}
    assert got["Japan"].goods == "Fishery products" and got["Korea"].goods == "Rice" and got["Japan"].flow_type and got["Japan"].year == 2025
    assert got["Japan"].raw_values == ["10", "1200", "12", "1300"] and got["China"].month_count == 2
    cells = {(r.country, r.month): (r.quantity and float(r.quantity), float(r.value)) for r in files.expand_month_cells(report.where("country <> 'Korea'")).collect()}
    assert cells == {("Japan", 1): (10.0, 1200000.0), ("Japan", 2): (12.0, 1300000.0), ("China", 1): (None, 5000.0), ("China", 2): (None, 700000.0)}


def test_too_few_cells_are_an_error(spark):
    df = spark.createDataFrame([("X", "g", True, 2025, 2, ["1"])], "country string, goods string, flow_type boolean, year int, month_count int, raw_values array<string>")
    with pytest.raises(Exception, match="too few values"):
        files.expand_month_cells(df).collect()


def test_wide_table(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text('List of exporters\nsome,preamble\nExporters,Exported value in 2025-M01,Exported value in 2025-M02\nJapan,1,\n"Korea, Rep.",x,4\n')
    got = files.read_wide_monthly_csv(spark, str(path), importer="Viet Nam", product="0901").collect()
    assert sorted((r.exporter_name, r.importer_name, r.product_code, r.year, r.month, r.value_usd_k) for r in got) == [("Japan", "Viet Nam", "0901", 2025, 1, 1.0), ("Korea, Rep.", "Viet Nam", "0901", 2025, 2, 4.0)]


@pytest.mark.parametrize(("flow", "pair", "values"), [("import", ("Japan", "Viet Nam"), [1.0, 2.0]), ("export", ("Viet Nam", "Japan"), [3.0, 4.0])])
def test_bilateral_table(spark, tmp_path, flow, pair, values):
    path = tmp_path / "b.csv"
    path.write_text("Product code,Product label,Japan's exports to Viet Nam,,Viet Nam's exports to Japan,\n,,Value in 2025-M01,Value in 2025-M02,Value in 2025-M01,Value in 2025-M02\n'0901,Coffee,1,2,3,4\n")
    got = files.read_bilateral_csv(spark, str(path), "Japan", "Viet Nam", flow).orderBy("month").collect()
    assert [r.value_usd_k for r in got] == values and {(r.exporter_name, r.importer_name) for r in got} == {pair} and got[0].product_code == "0901"


def test_each_file_has_its_own_header(spark, tmp_path):
    """Data lines that equal a header or preamble line stay, and columns may stand in another order in the next file."""
    (tmp_path / "w1.csv").write_text("Japan,7\nExporters,Value in 2025-M01\nJapan,7\n")
    (tmp_path / "w2.csv").write_text("Exporters,Value in 2025-M02,Value in 2025-M01\nKorea,5,6\n")
    got = files.read_wide_monthly_csv(spark, str(tmp_path / "w*.csv"), importer="Viet Nam", product="x").collect()
    assert sorted((r.exporter_name, r.month, r.value_usd_k) for r in got) == [("Japan", 1, 7.0), ("Korea", 1, 6.0), ("Korea", 2, 5.0)]
    body = "Product code,Japan's imports from Viet Nam\n,Value in 2025-M01\n'0901,3\n"
    (tmp_path / "Bilateral trade between Viet Nam and Japan.csv").write_text(body)
    (tmp_path / "Bilateral x.csv").write_text("Bilateral trade between Korea and Viet Nam,,\n" + body.replace("Japan's", "Korea's"))
    both = files.read_bilateral_csv(spark, str(tmp_path / "Bilateral*.csv"), None, "Viet Nam", "export").collect()
    assert sorted((r.exporter_name, r.importer_name, r.value_usd_k) for r in both) == [("Viet Nam", "Japan", 3.0), ("Viet Nam", "Korea", 3.0)]


def test_nomenclature_and_countries(spark, tmp_path):
    (tmp_path / "n.csv").write_text("hscode,description,level\n1,Live animals,2\n01,Second,2\n0901,Coffee,4\n090111,Coffee not roasted,6\n")
    table = files.read_nomenclature(spark, str(tmp_path / "n.csv"))
    assert {r.hscode: r.description for r in table.collect()} == {"01": "Live animals", "0901": "Coffee", "090111": "Coffee not roasted"}
    df = spark.createDataFrame([("09011199",), ("0999",)], ["hs_code"])
    assert {r.hs_code: r.hs_description for r in layers.hs_description(df, table).collect()} == {"09011199": "Coffee not roasted", "0999": ""}
    (tmp_path / "c.csv").write_text("".join(f"p{i}\n" for i in range(7)) + "Countries and Territories,2025-M11\nJapan,x\n\"Korea, Rep.\",x\nJapan,y\n")
    assert sorted(r.name for r in files.read_country_list(spark, str(tmp_path / "c.csv")).collect()) == ["Japan", "Korea, Rep.", "World"]


def test_incremental_rates(spark, tmp_path):
    (tmp_path / "r.csv").write_text("rate_date,base_currency,quote_currency,rate\n2025-01-01,VND,USD,1\n2025-01-20,VND,USD,1\n")
    known = spark.createDataFrame([(datetime.date(2025, 1, 10),)], ["rate_date"])
    assert [r.rate_date for r in files.read_rates_incremental(spark, str(tmp_path / "r.csv"), known).collect()] == ["2025-01-20"]
    assert files.read_rates_incremental(spark, str(tmp_path / "r.csv"), known.where("false")).count() == 2


def test_sinks(spark, tmp_path):
    a, path = spark.createDataFrame([("m1", 1), ("m2", 2)], ["model", "v"]), str(tmp_path / "t")
    sinks.overwrite_stage(a, path)
    sinks.overwrite_stage(a, path)
    sinks.save_slice(spark, path, a.where("model = 'm1'").withColumn("v", F.lit(9).cast("long")), F.col("model") == "m1")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("m1", 9), ("m2", 2)]
    sinks.append_audit(a, path)
    assert spark.read.parquet(path).count() == 4
    for day in ("2025-01-01", "2025-01-01", "2025-01-02"):
        sinks.write_audit_snapshot(a, str(tmp_path / "s"), day)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4


def test_layered_load(spark):
    ref = spark.createDataFrame([("JPN", "Japan", "East", "Asia"), ("VNM", "Viet Nam", "South", "Asia")], ["iso3", "name", "region", "continent"])
    refs = layers.References(ref, spark.createDataFrame([("NIHON", "Japan")], ["alias", "name"]), spark.createDataFrame([("09", "Coffee, tea", 2), ("090111", "Coffee not roasted", 6)], ["hscode", "description", "level"]))
    unified = spark.createDataFrame([(2025, 4, "90111", "coffee", "JPN", "Japan", True, 10.0, 1.0, "kg", "NSO"), (2025, 4, "", "fresh fish", "", "Nihon", True, 5.0, 1.0, "kg", "NSO"), (2025, 4, "0901", "x", "ZZZ", "Nowhere", True, 5.0, 1.0, "kg", "NSO")], "year int, month int, hs_code string, product_name string, partner_code string, partner_name string, flow_type boolean, value double, quantity double, unit string, source_system string")
    ods = spark.createDataFrame([], ODS_TRADE)
    mark = spark.createDataFrame([], "source_system string, last_year int, last_month int")
    fta = spark.createDataFrame([(1, "Pact", ["Japan", "Viet Nam"])], "fta_id int, fta_name string, members array<string>")
    rates = spark.createDataFrame([("2025-04-30", "VND", "USD", "0.00004")], ["rate_date", "base_currency", "quote_currency", "rate"])
    empty = lambda s: spark.createDataFrame([], s + ", version int, effective_date date, expiry_date date, is_current boolean")
    dims = {"dim_country": empty("country_key long, country_code string, country_name string, region string, continent string"), "dim_product": empty("product_key long, hs_code string, product_name string, heading string, chapter string"), "dim_fta": empty("fta_key long, fta_id int, fta_name string")}
    out = layers.layered_load(unified, fta, rates, refs, ods, mark, dims, "2025-05-01", "VNM", "B1")
    facts = {r.partner_code: r for r in out["fact_trade"].collect()} if "partner_code" in out["fact_trade"].columns else {}
    assert out["ods"].count() == 3 and out["nds_rejects"].count() == 1 and out["fact_trade"].count() == 2
    assert {float(r.value_vnd) for r in out["fact_trade"].collect()} == {250000.0, 125000.0} and facts["JPN"].fta_keys == [1]
    assert {r.hs_code for r in out["nds_trade_transaction"].collect()} == {"090111", "030399"}
    assert [tuple(r) for r in out["watermark"].collect()] == [("NSO", 2025, 4)]


def test_many_files_are_one_plan(spark, tmp_path):
    """Headers anywhere, columns in any order; the plan does not grow with the files."""
    plans = []
    for n in (2, 60):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            months = ["Value in 2025-M01", "Value in 2025-M02"][:: 1 if i % 2 else -1]
            preamble = "".join(f"note {k}\n" for k in range(100 * (i % 3)))
            (folder / f"w{i}.csv").write_text(f"{preamble}Exporters,{','.join(months)},Product code\nLand {i},{','.join(str(i * 10 + (1 if 'M01' in m else 2)) for m in months)},'{i:04d}\n\"A, B\",,7,\n")
        got = files.read_wide_monthly_csv(spark, str(folder / "w*.csv"), importer="Viet Nam")
        rows = [(r.exporter_name, r.product_code, r.month, r.value_usd_k) for r in got.collect() if r.exporter_name != "A, B"]
        assert sorted(rows) == sorted((f"Land {i}", f"{i:04d}", m, i * 10.0 + m) for i in range(n) for m in (1, 2))
        assert got.where("exporter_name = 'A, B'").count() == n
        plans.append(len(got._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert plans[0] == plans[1]
    (tmp_path / "60" / "w_bad.csv").write_text("nothing,here\n1,2\n")
    with pytest.raises(ValueError, match="w_bad"):
        files.read_wide_monthly_csv(spark, str(tmp_path / "60" / "w*.csv"))
    (tmp_path / "x.csv").write_text("Product code,Label,Japan's imports from Viet Nam,,World's imports\n,,2025-M01,2025-M02,2025-M03\n'0901,a,3,4,5\n,b,9,9,9\n")
    with pytest.raises(ValueError, match="no pair"):
        files.read_bilateral_csv(spark, str(tmp_path / "x.csv"), None, "Viet Nam", "export")
    with pytest.raises(ValueError, match="no monthly"):
        files.read_bilateral_csv(spark, str(tmp_path / "x.csv"), "Korea", "Viet Nam", "import")
    assert sorted((r.product_code, r.month, r.value_usd_k) for r in files.read_bilateral_csv(spark, str(tmp_path / "x.csv"), "Japan", "Viet Nam", "export").collect()) == [("0901", 1, 3.0), ("0901", 2, 4.0)]
