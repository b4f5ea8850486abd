"""The trade model over the given tables: which columns stand for what, in DataFrames and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import merge, relational
from .plans import star
from .schemas import TRADE_KEY
from .sources import sinks

HOME, RUN_DATE = "C00", "1998-06-15"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, d: str) -> DataFrame:
    """Trade rows from line items, with seq, a total order."""
    li, orders, part = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "part")
    # one table after the other: each is broadcast while it is small, and the line items are not shuffled for it
    rows = li.join(orders.select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    month = F.month("l_shipdate")
    return rows.select(
        F.year("l_shipdate").alias("year"), month.alias("month"), (F.floor((month - 1) / 3) + 1).cast("int").alias("quarter"), F.date_format("l_shipdate", "yyyyMM").alias("period"),
        hs_code().alias("hs_code"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("heading_name"),
        F.concat(F.lit("C"), pad("n_nationkey", 2)).alias("partner_code"), F.col("n_name").alias("partner_name"), F.col("r_name").alias("region"), F.col("r_name").alias("continent"),
        (F.col("l_linestatus") == "O").alias("flow_type"), F.col("l_extendedprice").cast("decimal(18,2)").alias("value"), F.col("l_quantity").cast("decimal(18,2)").alias("quantity"), F.lit("ton").alias("unit"),
        F.when(F.col("o_orderstatus") == "F", "UN_COMTRADE").when(F.col("o_orderstatus") == "O", "NSO").otherwise("TRADE_MAP").alias("source_system"),
        F.when(F.col("l_orderkey") % 10 < 8, "B1").otherwise("B2").alias("batch_id"), "l_orderkey",
        F.concat(pad("l_orderkey", 12), pad("l_linenumber", 3), pad("l_partkey", 10), pad("l_suppkey", 10), F.date_format("l_shipdate", "yyyyMMdd"), F.lpad(F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), 14, "0")).alias("seq"),
    )


def hs_code() -> F.Column:
    return F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"))


def dirty_trade(spark: SparkSession, d: str) -> DataFrame:
    """Trade rows of which some break a rule."""
    return trade(spark, d).withColumns({
        "hs_code": F.when(F.col("l_orderkey") % 101 == 0, None).when(F.col("l_orderkey") % 97 == 0, "X").otherwise(F.col("hs_code")),
        "value": F.when(F.col("l_orderkey") % 89 == 0, F.lit(0).cast("decimal(18,2)")).otherwise(F.col("value")),
        "partner_code": F.when(F.col("l_orderkey") % 83 == 0, None).otherwise(F.col("partner_code")),
    })


def grain(spark: SparkSession, d: str) -> DataFrame:
    return relational.rollup_to_grain(trade(spark, d).select(*TRADE_KEY, "value", "quantity", "unit", "batch_id", "seq"), TRADE_KEY, ["value", "quantity"], "seq")


def measures(spark: SparkSession, d: str) -> DataFrame:
    """The grain's keys and sums, which are all that a fact shows. Without the last texts a group is a few numbers, so it is summed
    in a hash table; with them every row would be sorted by its key on both sides of the shuffle. Nearly every row is a group of its
    own, so rows are dealt by key first: a table of a whole split's groups before the shuffle would combine little and outgrow a
    task's memory. The number of parts is named, as small parts would else be put together again by their compressed size."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = trade(spark, d).select(*TRADE_KEY, "value", "quantity").repartition(parts, *TRADE_KEY)
    return relational.rollup_to_grain(rows, TRADE_KEY, ["value", "quantity"], "seq")


def rates(spark: SparkSession, d: str) -> DataFrame:
    daily = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("rate_date")).agg(F.max(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(18,6)").alias("vnd_per_usd"))
    return daily.withColumns({"base_currency": F.lit("VND"), "quote_currency": F.lit("USD"), "source_system": F.lit("FX")})


def iso_reference(spark: SparkSession, d: str) -> DataFrame:
    """Real country codes: nation 24 is left out, so that the rule fires."""
    return countries(spark, d).where("country_code <> 'C24'").select(F.col("country_code").alias("iso3"), F.col("country_name").alias("name"), "region", "continent")


def countries(spark: SparkSession, d: str, changed: bool = False) -> DataFrame:
    """The country source; changed: the second snapshot, in which every fourth country has another region."""
    region = F.when(F.col("n_nationkey") % 4 == 0, F.concat("r_name", F.lit(" NEW"))).otherwise(F.col("r_name")) if changed else F.col("r_name")
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.concat(F.lit("C"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("country_code"), F.col("n_name").alias("country_name"), region.alias("region"), F.col("r_name").alias("continent"))


def products(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(hs_code().alias("hs_code"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("heading_name"))
    one = relational.first_of(rows, ["hs_code"], [F.col("product_name").asc_nulls_last(), F.col("heading_name")])
    return one.withColumns({"chapter": F.left("hs_code", F.lit(2)), "heading": F.left("hs_code", F.lit(4))})


def dim_country(spark: SparkSession, d: str) -> DataFrame:
    attrs = ["country_name", "region", "continent"]
    first = merge.first_load(countries(spark, d), "country_code", attrs, "country_key")
    return merge.scd2_apply(first, countries(spark, d, True), "country_code", attrs, RUN_DATE, "country_key")


def dim_product(spark: SparkSession, d: str) -> DataFrame:
    return merge.first_load(products(spark, d), "hs_code", ["product_name", "heading_name", "heading", "chapter"], "product_key")


def dim_time(spark: SparkSession, d: str) -> DataFrame:
    """The months of the line items: one column of one table, and no join."""
    months = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).distinct()
    return months.select((F.col("year") * 100 + F.col("month")).cast("int").alias("time_key"), "year", (F.floor((F.col("month") - 1) / 3) + 1).cast("int").alias("quarter"), "month")


def members(spark: SparkSession, d: str) -> DataFrame:
    """(fta_id, country_code): agreement i has the nations that i + 2 divides, odd ones without the home country."""
    n = table(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("fta_id"))
    own = n.where((F.col("n_nationkey") % (F.col("fta_id") + 2) == 0) & ((F.col("fta_id") % 2 == 0) | (F.col("n_nationkey") != 0)))
    return own.select("fta_id", F.concat(F.lit("C"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("country_code"))


def agreements(spark: SparkSession, d: str, changed: bool = False) -> DataFrame:
    """The agreement source; changed: the second snapshot, in which every third agreement has another name."""
    name = F.concat(F.lit("FTA "), (F.col("fta_id") % 8).cast("string"))
    own = F.when(F.col("fta_id") % 3 == 1, F.concat(name, F.lit(" NEW"))).otherwise(name) if changed else name
    return members(spark, d).select("fta_id").distinct().withColumn("fta_name", own)


def dim_fta(spark: SparkSession, d: str) -> DataFrame:
    first = merge.first_load(agreements(spark, d), "fta_id", ["fta_name"], "fta_key")
    return merge.scd2_apply(first, agreements(spark, d, True), "fta_id", ["fta_name"], RUN_DATE, "fta_key")


def build_fact(spark: SparkSession, d: str) -> DataFrame:
    """The trade fact from the line items and the stored dimensions."""
    dims = [stored(spark, d, n) for n in ("dim_product", "dim_country")]
    return star.build_trade_fact(measures(spark, d), *dims, rates(spark, d), members(spark, d), stored(spark, d, "dim_fta"), HOME)


#: Tables of the star schema, which are stored once and then read.
STAR = {"dim_country": dim_country, "dim_product": dim_product, "dim_fta": dim_fta, "dim_time": dim_time, "fact": build_fact}
_stored: dict[tuple, str] = {}


#: What the stored tables come from.
SOURCES = {"dim_country": ["nation", "region"], "dim_product": ["part"], "dim_fta": ["nation"], "dim_time": ["lineitem"], "fact": ["lineitem", "orders", "part", "supplier", "nation", "region"], "fx_risk": ["orders"]}


def stored(spark: SparkSession, d: str, name: str, build: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame:
    """A table of the star schema, or what build makes: built and stored in the shared scratch folder when it is first asked
    for in a session, and again when the files that it comes from are others."""
    sources = SOURCES[name]
    key = (spark.sparkContext.applicationId, d, name, *[sinks.state_of(spark, f"{d}/{t}.parquet") for t in sources])
    if key not in _stored:
        made = (build or STAR[name])(spark, d)
        # a hash as text does not compress and is twice as long
        _stored[key] = sinks.store(made.withColumn("trade_key", F.unhex("trade_key")) if name == "fact" else made, f"dds-{name}")
    held = spark.read.parquet(_stored[key])
    return held.withColumn("trade_key", F.lower(F.hex("trade_key"))) if name == "fact" else held


#: The same in SQL; each name may use those before it.
SQL = {
    "trade": """select year(l_shipdate)::int as year, month(l_shipdate)::int as month, ((month(l_shipdate) - 1) // 3 + 1)::int as quarter, strftime(l_shipdate, '%Y%m') period,
        lpad(p_size::varchar, 2, '0') || lpad((p_partkey % 10000)::varchar, 4, '0') hs_code, p_name product_name, p_brand heading_name,
        'C' || lpad(n_nationkey::varchar, 2, '0') partner_code, n_name partner_name, r_name region, r_name continent,
        l_linestatus = 'O' flow_type, l_extendedprice::decimal(18,2) as value, l_quantity::decimal(18,2) quantity, 'ton' unit,
        case o_orderstatus when 'F' then 'UN_COMTRADE' when 'O' then 'NSO' else 'TRADE_MAP' end source_system,
        case when l_orderkey % 10 < 8 then 'B1' else 'B2' end batch_id, l_orderkey,
        lpad(l_orderkey::varchar, 12, '0') || lpad(l_linenumber::varchar, 3, '0') || lpad(l_partkey::varchar, 10, '0') || lpad(l_suppkey::varchar, 10, '0') || strftime(l_shipdate, '%Y%m%d') || lpad(round(l_extendedprice * 100)::bigint::varchar, 14, '0') seq
        from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey join part on l_partkey = p_partkey""",
    "dirty": """select * replace (case when l_orderkey % 101 = 0 then null when l_orderkey % 97 = 0 then 'X' else hs_code end as hs_code, case when l_orderkey % 89 = 0 then 0 else value end as value,
        case when l_orderkey % 83 = 0 then null else partner_code end as partner_code) from trade""",
    "grain": """select year, month, hs_code, partner_code, flow_type, source_system, coalesce(sum(value), 0)::decimal(28,2) as value, coalesce(sum(quantity), 0)::decimal(28,2) quantity,
        arg_max(unit, seq) unit, arg_max(batch_id, seq) batch_id from trade group by 1, 2, 3, 4, 5, 6""",
    "rates": """select o_orderdate::date rate_date, max(o_totalprice::decimal(18,2))::decimal(18,6) vnd_per_usd, 'VND' base_currency, 'USD' quote_currency, 'FX' source_system from orders group by 1""",
    "countries": """select 'C' || lpad(n_nationkey::varchar, 2, '0') country_code, n_name country_name, r_name region, r_name continent, n_nationkey from nation join region on n_regionkey = r_regionkey""",
    "iso": """select country_code iso3, country_name as name, region, continent from countries where country_code <> 'C24'""",
    "products": """select hs_code, product_name, heading_name, left(hs_code, 2) chapter, left(hs_code, 4) heading from (
        select lpad(p_size::varchar, 2, '0') || lpad((p_partkey % 10000)::varchar, 4, '0') hs_code, p_name product_name, p_brand heading_name from part)
        qualify row_number() over (partition by hs_code order by product_name nulls last, heading_name) = 1""",
    "country_v1": """select row_number() over (order by country_code) country_key, country_code, country_name, region, continent, 1 as version, n_nationkey from countries""",
    "dim_country": """select country_key, country_code, country_name, region, continent, version, date '0001-01-01' effective_date,
        case when n_nationkey % 4 = 0 then date '1998-06-15' else date '9999-12-31' end expiry_date, n_nationkey % 4 <> 0 is_current from country_v1
        union all select (select max(country_key) from country_v1) + row_number() over (order by country_code), country_code, country_name, region || ' NEW', continent, 2, date '1998-06-15', date '9999-12-31', true from country_v1 where n_nationkey % 4 = 0""",
    "dim_product": """select row_number() over (order by hs_code) product_key, hs_code, product_name, heading_name, heading, chapter, 1 as version, true is_current from products""",
    "dim_time": """select distinct (year * 100 + month)::int time_key, year, quarter, month from trade""",
    "members": """select i::int fta_id, 'C' || lpad(n_nationkey::varchar, 2, '0') country_code from nation, range(10) t(i) where n_nationkey % (i + 2) = 0 and (i % 2 = 0 or n_nationkey <> 0)""",
    "fta_v1": """select row_number() over (order by fta_id) fta_key, fta_id, 'FTA ' || (fta_id % 8) fta_name from (select distinct fta_id from members)""",
    "dim_fta": """select fta_key, fta_id, fta_name, 1 as version, date '0001-01-01' effective_date, case when fta_id % 3 = 1 then date '1998-06-15' else date '9999-12-31' end expiry_date, fta_id % 3 <> 1 is_current from fta_v1
        union all select (select max(fta_key) from fta_v1) + row_number() over (order by fta_id), fta_id, fta_name || ' NEW', 2, date '1998-06-15', date '9999-12-31', true from fta_v1 where fta_id % 3 = 1""",
    "fxm": """select year(rate_date)::int as year, month(rate_date)::int as month, arg_max(vnd_per_usd, rate_date) exchange_rate from rates group by 1, 2""",
    "home_keys": """select g.partner_code, g.year, g.month, list(f.fta_key order by f.fta_key) fta_keys from (select distinct partner_code, year, month from grain) g join members m on m.country_code = g.partner_code
        join dim_fta f on f.fta_id = m.fta_id and f.effective_date <= make_date(g.year, g.month, 1) and make_date(g.year, g.month, 1) < f.expiry_date where m.fta_id in (select fta_id from members where country_code = 'C00') group by 1, 2, 3""",
    "fact": """select md5(concat_ws('|', g.year, g.month, g.hs_code, g.partner_code, g.flow_type, g.source_system)) trade_key, (g.year * 100 + g.month)::int time_key, product_key, country_key partner_key, flow_type, source_system,
        value, quantity, exchange_rate, round(value::decimal(19,2) * exchange_rate::decimal(18,6), 2)::decimal(38,2) value_vnd, fta_keys, g.partner_code
        from grain g join dim_product p on p.hs_code = g.hs_code and p.is_current join dim_country c on c.country_code = g.partner_code and c.effective_date <= make_date(g.year, g.month, 1) and make_date(g.year, g.month, 1) < c.expiry_date
        left join fxm on fxm.year = g.year and fxm.month = g.month left join home_keys h on h.partner_code = g.partner_code and h.year = g.year and h.month = g.month""",
    "star": """select f.*, p.hs_code, p.heading, p.chapter, p.product_name, c.country_name, c.region, c.continent, t.year, t.quarter, t.month from fact f
        join (select * from dim_product where is_current) p using (product_key) join (select * from dim_country where is_current) c on c.country_key = f.partner_key join dim_time t using (time_key)""",
    "bridge": """select trade_key, time_key, unnest(fta_keys) fta_key from fact where fta_keys is not null""",
}
_USES = {
    "dirty": ["trade"], "grain": ["trade"], "iso": ["countries"], "country_v1": ["countries"], "dim_country": ["country_v1"], "dim_product": ["products"], "dim_time": ["trade"], "fta_v1": ["members"], "dim_fta": ["fta_v1"],
    "fxm": ["rates"], "home_keys": ["grain", "members", "dim_fta"], "fact": ["grain", "dim_product", "dim_country", "fxm", "home_keys"], "star": ["fact", "dim_product", "dim_country", "dim_time"], "bridge": ["fact"],
}


def sql(query: str, *names: str) -> str:
    """query with the given names, and what they use, as common table expressions."""
    wanted: set[str] = set()
    todo = list(names)
    while todo:
        n = todo.pop()
        if n not in wanted:
            wanted.add(n)
            todo += _USES.get(n, [])
    parts = [f"{n} as {'materialized ' if n in ('trade', 'grain', 'fact') else ''}({q})" for n, q in SQL.items() if n in wanted]
    extra = query.strip()
    recursive = "recursive " if extra.lower().startswith("with recursive ") else ""
    if extra.lower().startswith("with "):
        extra = extra[5 + len(recursive) :]
        return f"with {recursive}{', '.join(parts + [extra])}" if parts else query
    return f"with {', '.join(parts)} {extra}" if parts else query
