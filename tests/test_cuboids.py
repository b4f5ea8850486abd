"""Cuboids against aggregates of the facts: parents, routes, members that stay or go."""

import pytest
from pyspark.sql import functions as F

from tradelake.operators import cuboids

SHAPES = [("year", "month", "flow_type", "region", "country_name"), ("year", "month", "flow_type"), ("year", "flow_type")]


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(2020 + i % 3, 1 + i % 5, None if i % 11 == 0 else i % 2 == 0, f"r{i % 2}", None if i % 7 == 0 else f"c{i % 4}", i, 2 * i, 3) for i in range(200)]
    return spark.createDataFrame(rows, "year int, month int, flow_type boolean, region string, country_name string, value int, value_vnd int, quantity int").withColumns({c: F.col(c).cast("decimal(18,2)") for c in cuboids.SUMS})


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_every_view_comes_from_the_smallest_cuboid(facts):
    held = cuboids.build(facts, SHAPES)
    sizes = {c.columns: c.rows for c in held}
    assert sizes[frozenset(SHAPES[2])] == 9 and sum(c.table.agg(F.sum("trades")).first()[0] == 200 for c in held) == 3
    assert cuboids.covering(held, {"year"}).columns == frozenset(SHAPES[2]) and cuboids.covering(held, {"month"}).columns == frozenset(SHAPES[1])
    assert cuboids.covering(held, {"hs_code"}) is None
    # a coarser cuboid reads its parent and not the facts
    assert "Expand" not in cuboids.view(held, ["year"], ["value"])._jdf.queryExecution().optimizedPlan().toString()
    got = cuboids.view(held, ["year"], ["value_vnd", "trades", "surplus"])
    flow = lambda f: F.coalesce(F.sum(F.when(F.col("flow_type") == f, F.col("value_vnd"))).cast("double"), F.lit(0.0))
    want = facts.groupBy("year").agg(F.sum("value_vnd").cast("double"), F.count("*"), flow(True) - flow(False))
    assert rows(got) == rows(want)
    with pytest.raises(ValueError):
        cuboids.view(held, ["hs_code"], ["value"])


def test_members_stay_or_go(facts):
    held = cuboids.build(facts, SHAPES)
    got = cuboids.view(held, ["region"], ["value"], {"year": [2020, 2021]}, {"country_name": ["c1", None], "flow_type": [None]})
    want = facts.where("year in (2020, 2021) and country_name <> 'c1' and flow_type is not null").groupBy("region").agg(F.sum("value").cast("double"))
    assert rows(got) == rows(want) and got.count() == 2
    got = cuboids.view(held, ["month"], ["trades"], {"country_name": [None]})
    assert rows(got) == rows(facts.where("country_name is null").groupBy("month").count())


def test_cube_of_all_combinations(facts):
    dims = ["flow_type", "region", "year"]
    got = cuboids.cube(facts, dims, ["value", "trades"])
    want = facts.cube(*dims).agg(*[F.grouping(d).cast("int").alias(f"grouped_{d}") for d in dims], F.sum("value").cast("double").alias("value"), F.count("*").alias("trades"))
    assert rows(got) == rows(want.select(*got.columns)) and "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert cuboids.cube(facts.where("false"), dims, ["value"]).count() == 0


def test_cuboids_by_keys_hold_no_texts(spark):
    fact = spark.range(300).selectExpr("cast(202001 + id % 12 as int) time_key", "id % 7 product_key", "id % 5 partner_key", "if(id % 11 = 0, null, id % 2 = 0) flow_type", "concat('s', id % 3) source_system", "cast(id as decimal(18,2)) value", "cast(2 * id as decimal(18,2)) value_vnd", "cast(3 as decimal(18,2)) quantity")
    times = spark.range(12).selectExpr("cast(202001 + id as int) time_key", "2020 year", "cast(id / 3 as int) + 1 quarter", "cast(id + 1 as int) month")
    # products 5 and 6 and partner 4 have no current version; two partners share a name
    products = spark.range(5).selectExpr("id product_key", "concat('0', id % 2) chapter", "concat('0', id % 2, '11') heading", "concat('code', id) hs_code", "concat('name', id) product_name")
    partners = spark.range(4).selectExpr("id partner_key", "'x' continent", "concat('r', id % 2) region", "concat('c', id div 2) country_name")
    held = cuboids.build_by_keys(fact, {"time_key": (times, "time_key"), "product_key": (products, "hs_code"), "partner_key": (partners, "country_name")})
    star = fact.join(products, "product_key").join(partners, "partner_key").join(times, "time_key")
    plain = cuboids.build(star)
    for rows_, wanted, only, without in [(["hs_code"], ["value", "trades"], {"chapter": ["01"]}, {"month": [2]}), (["country_name", "region"], ["surplus"], {}, {"source_system": ["s1"]}), (["chapter"], ["asymmetry"], {"year": [2020]}, {}), (["hs_code", "country_name"], ["quantity", "trades"], {"flow_type": [None]}, {}), (["year"], ["trades"], {}, {})]:
        assert rows(cuboids.view(held, rows_, wanted, only, without)) == rows(cuboids.view(plain, rows_, wanted, only, without))
    # the fact is not stored again, and a product's cuboid has its key for its texts
    by_product = cuboids.covering(held, {"hs_code"})
    stored = max(by_product.table.inputFiles(), key=lambda f: "product_key" in spark.read.parquet(f).columns and "flow_type" in spark.read.parquet(f).columns)
    assert not {"hs_code", "product_name", "chapter", "heading"} & set(spark.read.parquet(stored).columns)
    assert cuboids.covering(held, {"year"}).rows == 3
