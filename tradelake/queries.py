"""The catalogue: every query over the given tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import binding as B
from .functions import clean as C
from .operators import agreements, cube, cuboids, features, forecast, late, match, merge, rules, scans
from .operators import relational as R
from .plans import layers
from .plans import star as S
from .schemas import DIM_COUNTRY, DIM_PRODUCT, ODS_TRADE, REJECTS, TRADE_KEY
from .sources import files, sinks, tables
from .sources.agreement_columns import HEADERS, PROVISIONS, RENAMED, YES_NO

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *names: str) -> Callable[[Query], Query]:
    """Register a query, with the SQL for its rows over the named tables of the binding."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = B.sql(sql, *names)
        return f

    return add


def dbl(*columns: str) -> list:
    return [F.col(c).cast("double").alias(c) for c in columns]


def r6(c) -> F.Column:
    return F.round(c if not isinstance(c, str) else F.col(c), 6)


def fact(s: SparkSession, d: str) -> DataFrame:
    return B.stored(s, d, "fact")


def star(s: SparkSession, d: str) -> DataFrame:
    return S.star(*[B.stored(s, d, n) for n in ("fact", "dim_product", "dim_country", "dim_time")])


# ---- cleaning ----
@query("""select l_orderkey, l_linenumber, l_partkey, try_cast(case when l_orderkey % 7 = 0 then 'abc' when l_orderkey % 5 = 0 then '' else (l_quantity::decimal(18,2))::varchar end as decimal(18,2))::double as quantity,
    try_cast(nullif(regexp_replace('US$ ' || (l_quantity::bigint)::varchar || ',000', '[^0-9.\\-]', '', 'g'), '') as decimal(18,2))::double parsed from lineitem""")
def clean_numeric(s, d):
    q = F.col("l_quantity").cast("decimal(18,2)").cast("string")
    messy = F.when(F.col("l_orderkey") % 7 == 0, "abc").when(F.col("l_orderkey") % 5 == 0, "").otherwise(q)
    money = F.concat(F.lit("US$ "), F.col("l_quantity").cast("bigint").cast("string"), F.lit(",000"))
    return B.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", C.to_number(messy, "decimal(18,2)").cast("double").alias("quantity"), C.parse_decimal(money, "decimal(18,2)").cast("double").alias("parsed"))


@query("""select p_partkey, translate(trim('  C' || chr(153) || 'te ™ ' || p_name || ' '), chr(153) || '™', 'ôô') as name, regexp_replace(trim(' ''''' || p_brand), '^''+', '') code, upper(trim(' vnd ')) currency,
    case when p_size % 3 = 0 then null else p_name end kept from part""")
def clean_text(s, d):
    blank = F.when(F.col("p_size") % 3 == 0, F.when(F.col("p_size") % 2 == 0, " nan ").otherwise("  ")).otherwise(F.col("p_name"))
    return B.table(s, d, "part").select("p_partkey", C.fix_mojibake(F.concat(F.lit("  C\u0099te ™ "), "p_name", F.lit(" "))).alias("name"), C.clean_product_code(F.concat(F.lit(" ''"), "p_brand")).alias("code"), C.normalize_currency(F.lit(" vnd ")).alias("currency"), C.null_if_blank(blank).alias("kept"))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then null else year(o_orderdate)::int end as signed, case o_orderstatus when 'F' then true when 'O' then false end flag from orders""")
def clean_year_bool(s, d):
    y = F.year("o_orderdate").cast("string")
    yes = F.when(F.col("o_orderstatus") == "F", " Yes ").when(F.col("o_orderstatus") == "O", "NO").otherwise("n/a")
    return B.table(s, d, "orders").select("o_orderkey", C.four_digit_year(F.when(F.col("o_orderkey") % 3 == 0, F.concat(y, F.lit("?"))).otherwise(F.concat(F.lit(" "), y))).alias("signed"), C.yes_no(yes).alias("flag"))


@query("""select c_custkey, case c_mktsegment when 'BUILDING' then 'Entry into Force' when 'MACHINERY' then null else trim(regexp_replace(c_mktsegment || '  X', '\\s+', ' ', 'g')) end status from customer""")
def normalize_label(s, d):
    seg = F.col("c_mktsegment")
    raw = F.when(seg == "BUILDING", " ENTRY  into force").when(seg == "MACHINERY", "   ").otherwise(F.concat(seg, F.lit("  X ")))
    return B.table(s, d, "customer").select("c_custkey", C.normalize_label(raw, agreements.STATUSES).alias("status"))


@query("""select fta_id, string_agg(n, '|' order by n) members, count(*) n from (select distinct fta_id, n_name n from members join nation on country_code = 'C' || lpad(n_nationkey::varchar, 2, '0')) group by 1""", "members")
def parse_members(s, d):
    names = B.members(s, d).join(B.countries(s, d), "country_code").groupBy("fta_id").agg(F.array_join(F.sort_array(F.collect_list("country_name")), " ; ").alias("m"))
    parsed = names.select("fta_id", C.parse_members(F.concat("m", F.lit(";; "), "m")).alias("m"))
    return parsed.select("fta_id", F.array_join("m", "|").alias("members"), F.size("m").cast("bigint").alias("n"))


@query("""select p_partkey, case when c = '' then '000000' when length(c) % 2 = 1 then '0' || c else c end code, case when c = '' then '' else left(case when length(c) % 2 = 1 then '0' || c else c end, 2) end chapter,
    case when c = '' then '' else left(case when length(c) % 2 = 1 then '0' || c else c end, 4) end heading from (select p_partkey, case when p_size % 7 = 0 then '' else p_size::varchar || lpad((p_partkey % 10000)::varchar, 4, '0') end c from part)""")
def hs_hierarchy(s, d):
    raw = F.when(F.col("p_size") % 7 == 0, "").otherwise(F.concat(F.col("p_size").cast("string"), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0")))
    code, chapter, heading = C.hs_hierarchy(raw)
    return B.table(s, d, "part").select("p_partkey", code.alias("code"), chapter.alias("chapter"), heading.alias("heading"))


@query("""select t.hs_code, count(*) n, coalesce(max(d6.heading_name), max(d4.description), max(d2.description), '') hs_description from trade t
    left join (select hs_code c, heading_name from products where right(hs_code, 1) in ('0', '2', '4')) d6 on d6.c = t.hs_code
    left join (select distinct heading c, 'H' || heading description from products where right(heading, 1) in ('0', '1')) d4 on d4.c = left(t.hs_code, 4)
    left join (select distinct chapter c, 'C' || chapter description from products where chapter <> '07') d2 on d2.c = left(t.hs_code, 2) group by 1""", "trade", "products")
def hs_longest_prefix(s, d):
    p = B.products(s, d)
    level6 = p.where(F.right("hs_code", F.lit(1)).isin("0", "2", "4")).select(F.col("hs_code").alias("hscode"), F.col("heading_name").alias("description"))
    level4 = p.where(F.right("heading", F.lit(1)).isin("0", "1")).select(F.col("heading").alias("hscode"), F.concat(F.lit("H"), "heading").alias("description")).distinct()
    level2 = p.where("chapter <> '07'").select(F.col("chapter").alias("hscode"), F.concat(F.lit("C"), "chapter").alias("description")).distinct()
    counts = B.trade(s, d).groupBy("hs_code").agg(F.count("*").alias("n"))
    return layers.hs_description(counts, R.union_sources(level6, level4, level2)).select("hs_code", "n", "hs_description")


@query("select year, month, period, (year * 100 + month)::int time_key, count(*) n from trade group by all", "trade")
def period_roundtrip(s, d):
    y, m = C.split_period("period")
    t = B.trade(s, d).withColumn("period", C.build_period("year", "month")).select(y.alias("year"), m.alias("month"), "period")
    return t.groupBy("year", "month", "period", C.time_key("year", "month").alias("time_key")).agg(F.count("*").alias("n"))


@query("""select flow_type, case when flow_type then 'Export' else 'Import' end flow_label, flow_type = (source_system <> 'UN_COMTRADE') as reversed, count(*) n from trade group by all""", "trade")
def derive_flow(s, d):
    t = B.trade(s, d)
    label = F.when(F.col("flow_type"), "Export").otherwise("Import")
    t = t.withColumn("flow_label", label).withColumn("flow_type", F.when(F.col("flow_label").ilike("export"), True).when(F.col("flow_label").ilike("import"), False))
    mirrored = F.when(F.col("source_system") == "UN_COMTRADE", ~F.col("flow_type")).otherwise(F.col("flow_type"))
    return t.groupBy("flow_type", "flow_label", mirrored.alias("reversed")).agg(F.count("*").alias("n"))


@query("""select country, goods, month, count(*) n, sum(quantity)::double quantity, sum(value)::double as value from (
    select n_name country, o_orderpriority goods, m::int as month, case when o_orderkey % 2 = 0 then v[2 * m - 1] end quantity, (case when o_orderkey % 2 = 0 then v[2 * m] else v[m] end) * 1000 as value
    from (select *, list_transform(range(case when o_orderkey % 2 = 0 then 4 else 5 end), lambda i: (o_custkey % 100 + i)::decimal(18,2)) v from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey), range(1, 3) t(m)) group by all""")
def expand_months(s, d):
    o = B.table(s, d, "orders").join(B.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(B.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n = F.when(F.col("o_orderkey") % 2 == 0, 3).otherwise(4)
    values = F.transform(F.sequence(F.lit(0), n), lambda i: (F.col("o_custkey") % 100 + i).cast("string"))
    rows = o.select(F.col("n_name").alias("country"), F.col("o_orderpriority").alias("goods"), F.lit(True).alias("flow_type"), F.lit(2025).alias("year"), F.lit(2).alias("month_count"), values.alias("raw_values"))
    return files.expand_month_cells(rows).groupBy("country", "goods", "month").agg(F.count("*").alias("n"), F.sum("quantity").cast("double").alias("quantity"), F.sum("value").cast("double").alias("value"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(least(round(case when l_linenumber = 1 or l_linenumber = 2 then 0.0::double when l_linenumber = 3 then 1e15::double when l_linenumber = 4 then -1e15::double else l_extendedprice end, 2), 9e13::double), -9e13::double) as v from lineitem""")
def sanitize_forecast(s, d):
    n = F.col("l_linenumber")
    raw = F.when(n == 1, F.lit(float("nan"))).when(n == 2, F.lit(None).cast("double")).when(n == 3, F.lit(1e15)).when(n == 4, F.lit(-1e15)).otherwise(F.col("l_extendedprice"))
    return B.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.sanitize_forecast(raw).alias("v"))


def monitored(s, d):
    return B.table(s, d, "events").select(F.col("event_type").alias("source_system"), (F.col("value") > 50).alias("is_late"), F.col("ts").alias("created_at"))


MONITOR = "select event_type source_system, (value > 50)::varchar late_flag, strftime(ts, '%Y-%m-%d') created_date, hour(ts)::int created_hour from events"


@query(f"select *, count(*) n from ({MONITOR}) group by all")
def ingest_monitor(s, d):
    return cube.ingest_monitor(monitored(s, d)).groupBy("source_system", "late_flag", "created_date", "created_hour").agg(F.count("*").alias("n"))


@query("select event_type source_system, round((epoch(timestamp '2024-06-01') - epoch(date_trunc('second', max(ts)))) / 3600.0, 1)::double hours_since_update from events group by 1")
def watermark_hours(s, d):
    last = monitored(s, d).groupBy("source_system").agg(F.max("created_at").alias("updated_at"))
    return cube.watermark_monitor(last, "2024-06-01 00:00:00").select("source_system", F.col("hours_since_update").cast("double").alias("hours_since_update"))


# ---- rules ----
def bilateral(s, d):
    """Exporter and importer of each row: the supplier's and the customer's nation; every 50th is a total."""
    n = B.table(s, d, "nation")
    rows = B.table(s, d, "lineitem").join(B.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(B.table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(B.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    code = F.when(F.col("l_partkey") % 50 == 0, " total ").otherwise(F.col("l_partkey").cast("string"))
    rows = rows.select(F.col("l_orderkey").alias("id"), F.col("s_nationkey").alias("exporter_id"), F.col("c_nationkey").alias("importer_id"), code.alias("product_code"), F.round(F.col("l_extendedprice").cast("decimal(18,2)") * F.lit(0.001).cast("decimal(4,3)"), 2).cast("decimal(18,2)").alias("value_k"))
    products = B.table(s, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("label"))
    return rows, n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), products


BILATERAL = """bil as (select l_orderkey id, s_nationkey exporter_id, c_nationkey importer_id, case when l_partkey % 50 = 0 then ' total ' else l_partkey::varchar end product_code, round(l_extendedprice::decimal(18,2) * 0.001::decimal(4,3), 2)::decimal(18,2) value_k, e.n_name exporter_name, i.n_name importer_name, p_name product_label
    from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join customer on o_custkey = c_custkey join nation e on e.n_nationkey = s_nationkey join nation i on i.n_nationkey = c_nationkey
    left join part on p_partkey % 3 = 0 and p_partkey = l_partkey and l_partkey % 50 <> 0)"""


@query(f"with {BILATERAL} select exporter_name, importer_name, count(*) n, count(product_label) labelled, sum(value_k)::double value_k from bil group by all")
def denormalize(s, d):
    rows = R.denormalize_bilateral(*bilateral(s, d))
    return rows.groupBy("exporter_name", "importer_name").agg(F.count("*").alias("n"), F.count("product_label").alias("labelled"), F.sum("value_k").cast("double").alias("value_k"))


TARGET = "upper(trim(product_code)) <> 'TOTAL' and (exporter_name ilike 'NATION_7' or importer_name ilike 'NATION_7') and coalesce(value_k, 0) * 1000 > 20000"


@query(f"with {BILATERAL} select id, product_code, exporter_name, importer_name, value_k::double value_k from bil where {TARGET}")
def filter_target(s, d):
    rows = rules.filter_target_trade(R.denormalize_bilateral(*bilateral(s, d)), "nation_7", 20000)
    return rows.select("id", "product_code", "exporter_name", "importer_name", *dbl("value_k"))


@query(f"with {BILATERAL} select count(*) filter ({TARGET}) kept, count(*) filter (not coalesce({TARGET}, false)) dropped from bil")
def kept_dropped(s, d):
    total = F.upper(F.trim("product_code")) == "TOTAL"
    keep = ~total & (F.col("exporter_name").ilike("nation_7") | F.col("importer_name").ilike("nation_7")) & (F.col("value_k") * 1000 > 20000)
    return rules.kept_dropped_counts(R.denormalize_bilateral(*bilateral(s, d)), keep)


REASON = """case when coalesce(trim(hs_code), '') = '' then 'missing_hs_code' when not regexp_matches(hs_code, '^[0-9]{2,8}$') then 'invalid_hs_code_format' when coalesce(trim(partner_code), '') = '' then 'missing_partner_code'
    when upper(partner_code) not in (select upper(iso3) from iso) then 'invalid_partner_code' when value is null or value <= 0 then 'invalid_value' end"""


@query(f"select seq, hs_code, partner_code, value::double as value from dirty where {REASON} is null", "dirty", "iso")
def valid_trade(s, d):
    return rules.valid_trade(B.dirty_trade(s, d), B.iso_reference(s, d)).select("seq", "hs_code", "partner_code", *dbl("value"))


@query(f"select seq, {REASON} reject_reason from dirty where {REASON} is not null", "dirty", "iso")
def classify_rejects(s, d):
    return rules.classify_rejects(B.dirty_trade(s, d), B.iso_reference(s, d)).select("seq", "reject_reason")


@query(f"select {REASON} reject_reason, count(*) n from dirty where {REASON} is not null group by 1", "dirty", "iso")
def reject_summary(s, d):
    return rules.reject_summary(rules.classify_rejects(B.dirty_trade(s, d), B.iso_reference(s, d)))


@query("select distinct upper(partner_code) partner_code from dirty where coalesce(trim(partner_code), '') <> '' and upper(partner_code) not in (select iso3 from iso)", "dirty", "iso")
def invalid_codes(s, d):
    return rules.invalid_codes(B.dirty_trade(s, d), B.iso_reference(s, d))


@query("select batch_id, count(*) n, count(quantity) with_quantity from dirty where hs_code is not null and partner_code is not null group by 1", "dirty")
def drop_incomplete(s, d):
    return rules.drop_incomplete(B.dirty_trade(s, d), ["hs_code", "partner_code"]).groupBy("batch_id").agg(F.count("*").alias("n"), F.count("quantity").alias("with_quantity"))


@query("select count(*) n, sum(value)::double as value from trade where batch_id = 'B2'", "trade")
def scope_to_batch(s, d):
    return rules.scope_to_batch(B.trade(s, d), "B2").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("value"))


def raw_rates(s, d):
    """Rates as text, of which some are bad."""
    k = F.col("o_orderkey")
    day = F.when(k % 41 == 0, "2025-13-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rate = F.when(k % 31 == 0, "x").when(k % 29 == 0, "0").otherwise(F.concat(F.lit("0.0000"), (k % 89 + 10).cast("string")))
    return B.table(s, d, "orders").select(k.alias("id"), day.alias("rate_date"), F.lit(" vnd ").alias("base_currency"), F.lit("usd").alias("quote_currency"), rate.alias("rate"))


RAW_RATES = """raw as (select o_orderkey id, case when o_orderkey % 41 = 0 then null else o_orderdate::date end rate_date, 'VND' base_currency, 'USD' quote_currency,
    case when o_orderkey % 31 = 0 then null when o_orderkey % 29 = 0 then 0 else ('0.0000' || (o_orderkey % 89 + 10)::varchar)::decimal(18,10) end rate from orders)"""


@query(f"with {RAW_RATES} select id, case when rate_date is null then 'invalid_rate_date' else 'invalid_rate_value' end reject_reason from raw where rate_date is null or rate is null or rate <= 0")
def rate_rejects(s, d):
    return rules.split_rate_rejects(raw_rates(s, d))[1].select("id", "reject_reason")


@query(f"with {RAW_RATES} select rate_date, base_currency, quote_currency, round(1 / arg_max(rate, id)::double, 2) vnd_per_usd from raw where rate_date is not null and rate > 0 group by 1, 2, 3")
def clean_rates(s, d):
    good = R.dedupe_keep_last(rules.split_rate_rejects(raw_rates(s, d))[0], ["rate_date", "base_currency", "quote_currency"], "id")
    return good.select("rate_date", "base_currency", "quote_currency", F.round(C.inverse_rate("rate").cast("double"), 2).alias("vnd_per_usd"))


@query(f"with {RAW_RATES} select count(*) n, min(rate_date) first_date from raw where rate_date >= (select max(rate_date) - 7 from raw where id % 2 = 0)")
def rates_incremental(s, d):
    raw = raw_rates(s, d)
    known = raw.where("id % 2 = 0").select(F.try_to_date("rate_date", "yyyy-MM-dd").alias("rate_date"))
    new = files.since_last_rates(raw, known)
    return new.agg(F.count("*").alias("n"), F.min(F.try_to_date("rate_date", "yyyy-MM-dd")).alias("first_date"))


# ---- joins ----
@query("""select g.partner_code, c.version, c.region, count(*) n, sum(value)::double as value from grain g join dim_country c on c.country_code = g.partner_code and c.effective_date <= make_date(year, month, 1) and make_date(year, month, 1) < c.expiry_date group by all""", "grain", "dim_country")
def asof_dimension(s, d):
    g = B.grain(s, d).withColumn("period_start", F.make_date("year", "month", F.lit(1)))
    dim = B.stored(s, d, "dim_country").withColumnRenamed("country_code", "partner_code").drop("continent")
    return R.as_of_dimension(g, dim, ["partner_code"]).groupBy("partner_code", "version", "region").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("value"))


@query("""select year, month, hs_code, partner_code, flow_type, source_system, case when left(hs_code, 2) = '07' then 'no_product_version' else 'no_country_version' end reject_reason from grain where left(hs_code, 2) = '07' or partner_code = 'C03'""", "grain")
def unresolved_facts(s, d):
    return S.unresolved_facts(B.grain(s, d), B.stored(s, d, "dim_product").where("chapter <> '07'"), B.stored(s, d, "dim_country").where("country_code <> 'C03'"))


@query("select country_code, country_name from countries where country_code not in ('C01', 'C02', 'C03', 'C05', 'C08')", "countries")
def new_keys(s, d):
    known = B.countries(s, d).where(F.col("country_code").isin("C01", "C02", "C03", "C05", "C08"))
    return R.new_keys_only(B.countries(s, d), known, "country_code").select("country_code", "country_name")


@query("select country_code, region || ' NEW' region from countries where n_nationkey % 4 = 0", "countries")
def changed_rows(s, d):
    return R.changed_rows(B.countries(s, d, True), B.countries(s, d), "country_code", ["country_name", "region"]).select("country_code", "region")


@query("""select fta_id, count(*) n from (select distinct md5(concat_ws('|', g.year, g.month, g.hs_code, g.partner_code, g.flow_type, g.source_system)) t, fta_id from grain g join members m on m.country_code = g.partner_code
    where fta_id in (select fta_id from members where country_code = 'C00')) group by 1""", "grain", "members")
def co_membership(s, d):
    t = B.grain(s, d).withColumn("trade_id", C.surrogate_key(*TRADE_KEY))
    return R.co_membership(t, B.members(s, d), B.HOME).groupBy("fta_id").agg(F.count("*").alias("n"))


@query("select distinct fta_key, country_key from members join dim_fta using (fta_id) join dim_country using (country_code) where dim_country.is_current and dim_fta.is_current", "members", "dim_fta", "dim_country")
def agreement_bridge(s, d):
    return R.agreement_bridge(B.members(s, d), B.stored(s, d, "dim_fta"), B.stored(s, d, "dim_country"))


LATE = """l as (select year, month, count(*) late_count from trade where l_orderkey % 11 = 0 and month <> 7 group by 1, 2), m as (select year, month, count(*) total_count from trade group by 1, 2)"""


@query(f"with {LATE} select m.year, m.month, total_count, round(coalesce(late_count, 0) / total_count::double, 6) late_ratio from m left join l using (year, month)", "trade")
def late_ratio(s, d):
    t = B.trade(s, d)
    out = R.late_ratio(t.groupBy("year", "month").agg(F.count("*").alias("total_count")), t.where("l_orderkey % 11 = 0 and month <> 7").groupBy("year", "month").agg(F.count("*").alias("late_count")))
    return out.select("year", "month", "total_count", r6("late_ratio").alias("late_ratio"))


@query("select chapter, min(product_key) proxy_key from dim_product where is_current group by 1", "dim_product")
def chapter_proxy(s, d):
    return R.chapter_proxy(B.stored(s, d, "dim_product"))


@query("select count(*) n, sum(value)::double as value from grain where (year, month) not in (select (1998, 6) union all select (1999, 1))", "grain")
def delete_matching(s, d):
    gone = B.stored(s, d, "dim_time").where("time_key in (199806, 199901)")
    return R.delete_matching(B.grain(s, d), gone, ["year", "month"]).agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("value"))


@query("select base_currency, quote_currency, 2::bigint base_key, 1::bigint quote_key, count(*) n from rates group by all", "rates")
def role_play_currency(s, d):
    r = B.rates(s, d)
    codes = r.select(F.col("base_currency").alias("currency_code")).union(r.select("quote_currency")).distinct()
    dim = codes.withColumn("currency_key", F.row_number().over(Window.orderBy("currency_code")).cast("bigint"))
    return R.role_play_currency(r, dim).groupBy("base_currency", "quote_currency", "base_key", "quote_key").agg(F.count("*").alias("n"))


# ---- sets ----
@query("""select source_system, unit, count(*) n, sum(value)::double as value from (select source_system, 'ton' unit, value from trade where source_system <> 'TRADE_MAP' union all select source_system, '', value * 1000 from trade where source_system = 'TRADE_MAP') group by all""", "trade")
def union_sources(s, d):
    t = B.trade(s, d).select("source_system", "unit", "value")
    scaled = t.where("source_system = 'TRADE_MAP'").withColumns({"unit": F.lit(""), "value": (F.col("value") * 1000).cast("decimal(22,2)")})
    out = R.union_sources(t.where("source_system = 'UN_COMTRADE'"), t.where("source_system = 'NSO'"), scaled)
    return out.groupBy("source_system", "unit").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("value"))


@query("select source_system, year, count(*) n from trade group by all union all select 'ALL', year, count(*) from trade group by 2", "trade")
def with_total_member(s, d):
    t = B.trade(s, d)
    return R.with_total_member(t.groupBy("source_system", "year").agg(F.count("*").alias("n")), t.groupBy("year").agg(F.count("*").alias("n")), "source_system")


@query("select hs_code, product_name, heading_name from products", "products")
def distinct_on(s, d):
    return B.products(s, d).select("hs_code", "product_name", "heading_name")


@query("select hs_code, arg_max(partner_code, seq) partner_code, arg_max(value, seq)::double as value from trade group by 1", "trade")
def dedupe_keep_last(s, d):
    return R.dedupe_keep_last(B.trade(s, d).select("hs_code", "partner_code", "value", "seq"), ["hs_code"], "seq").select("hs_code", "partner_code", *dbl("value"))


@query("select distinct year, quarter, month from trade", "trade")
def distinct_periods(s, d):
    return B.trade(s, d).select("year", "quarter", "month").distinct()


# ---- aggregations ----
@query("select year, month, hs_code, partner_code, flow_type, source_system, value::double as value, quantity::double quantity, unit, batch_id from grain", "grain")
def rollup_to_grain(s, d):
    return B.grain(s, d).select(*TRADE_KEY, *dbl("value", "quantity"), "unit", "batch_id")


@query("""select partner_code, c1 source_system, c2 quantity from
    (select partner_code, source_system c1 from (select partner_code, source_system, count(*) n from trade group by 1, 2) qualify row_number() over (partition by partner_code order by n desc, source_system) = 1) join
    (select partner_code, q c2 from (select partner_code, quantity::double q, count(*) n from trade group by 1, 2) qualify row_number() over (partition by partner_code order by n desc, q) = 1) using (partner_code)""", "trade")
def most_frequent(s, d):
    return R.most_frequent(B.trade(s, d).select("partner_code", "source_system", *dbl("quantity")), "partner_code", ["source_system", "quantity"])


@query("select year, month, exchange_rate::double exchange_rate from fxm", "fxm")
def month_end_rate(s, d):
    return R.month_end_rate(B.rates(s, d), "VND", "USD").select("year", "month", *dbl("exchange_rate"))


@query("select trade_key, array_to_string(fta_keys, ',') fta_keys from fact where fta_keys is not null", "fact")
def agreement_keys(s, d):
    t = B.grain(s, d).withColumns({"trade_id": C.surrogate_key(*TRADE_KEY), "period_start": F.make_date("year", "month", F.lit(1))}).select("trade_id", "partner_code", "period_start")
    pairs = R.co_membership(t, B.members(s, d), B.HOME).join(t.select("trade_id", "period_start"), "trade_id")
    valid = R.as_of_dimension(pairs, B.stored(s, d, "dim_fta").select("fta_id", "fta_key", "effective_date", "expiry_date"), ["fta_id"])
    return R.agreement_keys(valid).select(F.col("trade_id").alias("trade_key"), F.array_join(F.col("fta_keys").cast("array<string>"), ",").alias("fta_keys"))


@query("select year, month, (sum(value) filter (flow_type))::double export_value, (sum(value) filter (not flow_type))::double import_value, count(*) n from grain group by 1, 2", "grain")
def conditional_sums(s, d):
    return R.conditional_sums(B.grain(s, d), ["year", "month"]).select("year", "month", *dbl("export_value", "import_value"), "n")


UTIL = """select fta_name, time_key, count(distinct trade_key) trades from bridge join dim_fta using (fta_key) group by 1, 2 union all select 'ALL', time_key, count(*) from fact group by 2"""


def utilization_counts(s, d):
    return R.utilization_by_agreement(fact(s, d), B.stored(s, d, "dim_fta"))


@query(UTIL, "bridge", "dim_fta", "fact")
def utilization_by_agreement(s, d):
    return utilization_counts(s, d)


@query("select fta_key, count(distinct trade_key) trades, (select count(*) from fact) total, round(count(distinct trade_key)::decimal(18,4) * 100 / nullif((select count(*) from fact), 0), 2)::double rate from bridge group by 1", "bridge", "fact")
def utilization_summary(s, d):
    return R.utilization_summary(fact(s, d))


@query("select product_key, partner_key, flow_type, (max(value_vnd) * 3)::double cap from fact group by 1, 2, 3", "fact")
def series_cap(s, d):
    return forecast.series_cap(fact(s, d), forecast.SERIES)


def watermarks(s, d):
    return s.sql("select * from values ('NSO', 1996, 6), ('UN_COMTRADE', 2030, 1), ('OLD', 1990, 1) as t(source_system, last_year, last_month)")


MARKS = "wm as (select * from (values ('NSO', 1996, 6), ('UN_COMTRADE', 2030, 1), ('OLD', 1990, 1)) t(source_system, last_year, last_month))"


@query(f"with {MARKS} select coalesce(w.source_system, s.source_system) source_system, (greatest(w.last_year * 100 + w.last_month, p) // 100)::int last_year, (greatest(w.last_year * 100 + w.last_month, p) % 100)::int last_month from wm w full join (select source_system, max(year * 100 + month) p from grain group by 1) s on s.source_system = w.source_system", "grain")
def advance_watermark(s, d):
    return R.advance_watermark(B.grain(s, d), watermarks(s, d))


@query("select source_system, greatest(max(year(rate_date)), 1996)::int last_year from rates group by 1", "rates")
def advance_year_watermark(s, d):
    return R.advance_year_watermark(B.rates(s, d), s.sql("select 'FX' as source_system, 1996 as last_year"))


@query("select round(avg(v) + 2 * stddev_samp(v), 4) upper_tail, round(avg(v) - 2 * stddev_samp(v), 4) lower_tail from (select vnd_per_usd::double v from rates)", "rates")
def tail_threshold(s, d):
    r = B.rates(s, d).select(*dbl("vnd_per_usd"))
    up, down = (R.tail_threshold(r, "vnd_per_usd", upper=u) for u in (True, False))
    return up.select(F.round("threshold", 4).alias("upper_tail")).join(down.select(F.round("threshold", 4).alias("lower_tail")))


@query(f"with {BILATERAL} select count(*) n, count(distinct exporter_id) exporters, count(distinct importer_id) importers from bil")
def source_profile(s, d):
    return R.source_profile(bilateral(s, d)[0])


@query("select 'trade' table_name, count(*) n from trade where batch_id = 'B1' union all select 'grain', count(*) from grain where batch_id = 'B1' union all select 'rates', count(*) from rates", "trade", "grain", "rates")
def layer_counts(s, d):
    return R.layer_counts({"trade": B.trade(s, d), "grain": B.grain(s, d), "rates": B.rates(s, d)}, "B1")


def _rollup(levels, by):
    e = ", ".join(levels)
    return f"select {e}, ({len(levels)} - " + " - ".join(f"grouping({x})" for x in levels) + f")::int as level, sum(value)::double as value, sum(value_vnd)::double value_vnd, count(*) trades from {by} group by rollup ({e})"


def measures():
    return {"value": cube.money("value"), "value_vnd": cube.money("value_vnd"), "trades": F.count("*")}


@query(_rollup(cube.TIME, "star"), "star")
def time_rollup(s, d):
    return cube.rollup(star(s, d), cube.TIME, measures())


@query(_rollup(cube.PRODUCT, "star"), "star")
def product_rollup(s, d):
    return cube.rollup(star(s, d), cube.PRODUCT, measures())


@query(_rollup(["continent", "region", "country_name"], "star"), "star")
def country_rollup(s, d):
    return cube.rollup(star(s, d), ["continent", "region", "country_name"], measures())


@query("select flow_type, source_system, grouping(flow_type)::int grouped_flow_type, grouping(source_system)::int grouped_source_system, sum(value)::double as value, sum(value_vnd)::double value_vnd, count(*) trades from fact group by cube (flow_type, source_system)", "fact")
def cube_flow_source(s, d):
    return cube.cube_by(fact(s, d), ["flow_type", "source_system"], measures())


@query("select flow_type, source_system, year, grouping(flow_type)::int grouped_flow_type, grouping(source_system)::int grouped_source_system, grouping(year)::int grouped_year, sum(value)::double as value, sum(value_vnd)::double value_vnd, count(*) trades from star group by cube (flow_type, source_system, year)", "star")
def cuboid_cube(s, d):
    """All combinations of three dimensions, each from its smallest parent."""
    return cuboids.cube(star(s, d), ["flow_type", "source_system", "year"], ["value", "value_vnd", "trades"])


#: Tiles of the dashboard: rows, the measure, and members of other dimensions that they keep or leave out.
VIEWS = {
    "value by year": (["year"], "value_vnd", {}, {}), "exports by year": (["year"], "value_vnd", {"flow_type": [True]}, {}), "surplus by year": (["year"], "surplus", {}, {}), "value by month": (["time_key"], "value_vnd", {}, {}),
    "chapters": (["chapter"], "value_vnd", {}, {}), "regions": (["region"], "quantity", {}, {}), "flows": (["flow_type"], "trades", {}, {}), "products": (["hs_code"], "value_vnd", {}, {"chapter": ["01", "02"]}),
    "countries": (["country_name"], "value_vnd", {}, {"country_name": ["nation_1"]}), "asymmetry by month": (["time_key"], "asymmetry", {}, {}), "sources by month": (["time_key", "source_system"], "value", {}, {"source_system": ["NSO", None]}),
}
_SHOWN = {"value_vnd": "sum(value_vnd)::double", "value": "sum(value)::double", "quantity": "sum(quantity)::double", "trades": "count(*)::double"}
_FLOWS = "coalesce((sum(value_vnd) filter (flow_type))::double, 0) - coalesce((sum(value_vnd) filter (not flow_type))::double, 0)"
_SHOWN |= {"surplus": _FLOWS, "asymmetry": f"abs({_FLOWS}) / nullif(sum(value_vnd)::double, 0)"}


def _view_sql(name: str) -> str:
    rows, measure, only, without = VIEWS[name]
    text = lambda v: {True: "true", False: "false"}.get(v, f"'{v}'")
    kept = [f"{c} in ({', '.join(map(text, v))})" for c, v in only.items()] + [f"not coalesce({c} in ({', '.join(text(x) for x in v if x is not None)}), {str(None in v).lower()})" for c, v in without.items()]
    return f"select '{name}' tile, concat_ws('|', {', '.join(f'{r}::varchar' for r in rows)}) as member, round({_SHOWN[measure]}, {6 if measure == 'asymmetry' else 2}) as value from star where year in (1995, 1996, 1997) and month <> 2{''.join(' and ' + k for k in kept)} group by {', '.join(rows)}"


@query(" union all ".join(map(_view_sql, VIEWS)), "star")
def cuboid_views(s, d):
    """Every tile under the dashboard's filter of years and months, from stored cuboids."""
    products, partners = (B.stored(s, d, n).where("is_current") for n in ("dim_product", "dim_country"))
    dims = {
        "time_key": (B.stored(s, d, "dim_time"), "time_key"), "product_key": (products.select("product_key", "chapter", "heading", "hs_code", "product_name"), "hs_code"),
        "partner_key": (partners.select(F.col("country_key").alias("partner_key"), "continent", "region", "country_name"), "country_name"),
    }
    held = cuboids.build_by_keys(fact(s, d).select(*dims, "flow_type", "source_system", *cuboids.SUMS), dims)
    parts = []
    for name, (rows, measure, only, without) in VIEWS.items():
        v = cuboids.view(held, rows, [measure], {"year": [1995, 1996, 1997], **only}, {"month": [2], **without})
        parts.append(v.select(F.lit(name).alias("tile"), F.concat_ws("|", *[F.col(r).cast("string") for r in rows]).alias("member"), F.round(F.col(measure).cast("double"), 6 if measure == "asymmetry" else 2).alias("value")))
    return R.union_sources(*parts)


# ---- windows ----
@query("""select partner_code exporter_name, year, month, sum(value)::double value_usd_k from trade group by all""", "trade")
def unpivot_months(s, d):
    """A wide table with a column for each month of twenty years. The reports' years are of this century and the tables' are not
    all, so labels are shifted by half a century, and back."""
    label = F.concat(F.lit("Exported value in "), (F.col("year") + 50).cast("string"), F.lit("-M"), F.lpad(F.col("month").cast("string"), 2, "0"))
    months = [f"Exported value in {y}-M{m:02d}" for y in range(2040, 2060) for m in range(1, 13)]
    labelled = B.trade(s, d).select(F.col("partner_code").alias("exporter_name"), label.alias("label"), "value")
    wide = labelled.groupBy("exporter_name").pivot("label", months).agg(F.sum("value").cast("double"))
    return files.unpivot_months(wide, ["exporter_name"]).withColumn("year", F.col("year") - 50)


@query("""select l_orderkey, l_linenumber, seq, last_value(own ignore nulls) over (partition by l_orderkey order by seq rows unbounded preceding) goods from (select l_orderkey, l_linenumber, seq, case when l_linenumber % 3 = 1 then product_name end own
    from (select *, seq[13:15]::int l_linenumber from trade))""", "trade")
def carry_forward(s, d):
    t = B.trade(s, d).withColumn("l_linenumber", F.substring("seq", 13, 3).cast("int"))
    t = t.withColumn("own", F.when(F.col("l_linenumber") % 3 == 1, F.col("product_name")).otherwise(" "))
    t = scans.dealt(t.select("l_orderkey", "l_linenumber", "seq", "own"), ["l_orderkey"], B.table(s, d, "lineitem").count())
    return t.select("l_orderkey", "l_linenumber", "seq", R.carry_forward("own", Window.partitionBy("l_orderkey").orderBy("seq")).alias("goods"))


def monthly_by_partner(s, d):
    return R.conditional_sums(B.grain(s, d), ["partner_code", "year", "month"]).withColumn("total", (F.coalesce("export_value", F.lit(0)) + F.coalesce("import_value", F.lit(0))).cast("double"))


MONTHLY = "mp as (select partner_code, year, month, sum(value)::double total, (sum(value) filter (flow_type)) export_value, (sum(value) filter (not flow_type)) import_value, count(*) n from grain group by 1, 2, 3)"


@query(f"with {MONTHLY} select partner_code, year, month, round(total / nullif(lag(total) over w, 0) - 1, 6) pct, round(total - lag(total) over w, 4) delta, lag(total, 2) over w total_lag2, round(case when count(total) over w7 = 7 then avg(total) over w7 end, 4) mean_7 from mp window w as (partition by partner_code order by year * 100 + month), w7 as (partition by partner_code order by year * 100 + month rows between 6 preceding and current row)", "grain")
def window_features(s, d):
    m = monthly_by_partner(s, d).withColumn("time_key", C.time_key("year", "month"))
    w = R.series_window(["partner_code"], "time_key")
    m = R.lags(m, "total", w, (2,)).withColumns({"pct": R.pct_change("total", w), "delta": R.delta("total", w), "mean_7": R.rolling("total", w, 7, "mean")})
    return m.select("partner_code", "year", "month", r6("pct").alias("pct"), F.round("delta", 4).alias("delta"), "total_lag2", F.round("mean_7", 4).alias("mean_7"))


@query(f"with {MONTHLY} select partner_code, year, month, row_number() over (partition by partner_code order by year * 100 + month) <= floor(count(*) over (partition by partner_code) * 0.8) is_train from mp", "grain")
def time_split(s, d):
    m = monthly_by_partner(s, d).withColumn("time_key", C.time_key("year", "month"))
    return R.time_split(m, ["partner_code"], "time_key").select("partner_code", "year", "month", "is_train")


@query(f"with {MONTHLY} select partner_code, max(year * 100 + month)::int time_key, arg_max(total, year * 100 + month) total from mp group by 1", "grain")
def latest_row(s, d):
    m = monthly_by_partner(s, d).select("partner_code", C.time_key("year", "month").alias("time_key"), "total")
    return R.latest_row(m, ["partner_code"], "time_key")


LINE_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
LINES = f"""lines as (select l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_extendedprice::double v, case when l_orderkey % 13 = 0 then l_returnflag || l_linenumber when l_orderkey % 13 = 1 then ' ' end note from lineitem)"""


@query(f"""with {LINES} select l_orderkey, l_linenumber, n, round(before, 2) before, round(mean_30, 4) mean_30, round(later, 2) later, noted from (select *, row_number() over w n, lag(v, 3) over w before,
    case when count(v) over w30 = 30 then avg(v) over w30 end mean_30, lead(v, 7) over w later, last_value(nullif(trim(note), '') ignore nulls) over (order by {LINE_ORDER} rows between unbounded preceding and current row) noted
    from lines window w as (order by {LINE_ORDER}), w30 as (order by {LINE_ORDER} rows between 29 preceding and current row))""")
def one_long_series(s, d):
    """All line items as one series: their numbers, lags, rolling means, values to come and the last note, by blocks."""
    order = LINE_ORDER.split(", ")
    note = F.when(F.col("l_orderkey") % 13 == 0, F.concat("l_returnflag", "l_linenumber")).when(F.col("l_orderkey") % 13 == 1, " ")
    lines = B.table(s, d, "lineitem").select(*order, F.col("l_extendedprice").cast("double").alias("v"), note.alias("note"))
    noted = scans.carried(scans.numbered(lines, order, "n"), [], ["n"], "note", "noted", 5_000)

    def windows(df, keys):
        w = Window.partitionBy(*keys).orderBy("n")
        return df.withColumns({"before": F.round(F.lag("v", 3).over(w), 2), "mean_30": F.round(R.rolling("v", w, 30, "mean"), 4), "later": F.round(R.horizon_label("v", w, 7), 2)})

    return scans.in_blocks(noted, [], ["n"], 29, 7, windows, 5_000).select("l_orderkey", "l_linenumber", "n", "before", "mean_30", "later", "noted")


# ---- merges ----
def batches(s, d):
    """(target, source): the grain of the two batches, without the rows that only differ in batch."""
    t = B.trade(s, d).select(*TRADE_KEY, "value", "quantity", "unit", "batch_id", "seq")
    one = R.rollup_to_grain(t.where("batch_id = 'B1'"), TRADE_KEY, ["value", "quantity"], "seq")
    two = R.rollup_to_grain(t.where("batch_id = 'B2' or month = 3"), TRADE_KEY, ["value", "quantity"], "seq").withColumn("unit", F.when(F.col("month") == 4, None).otherwise(F.lit("kg")))
    return one, two


MERGE = """t as (select year, month, hs_code, partner_code, flow_type, source_system, sum(value)::decimal(28,2) as value, sum(quantity)::decimal(28,2) quantity, arg_max(unit, seq) unit, arg_max(batch_id, seq) batch_id from trade where batch_id = 'B1' group by 1, 2, 3, 4, 5, 6),
    s as (select year, month, hs_code, partner_code, flow_type, source_system, sum(value)::decimal(28,2) as value, sum(quantity)::decimal(28,2) quantity, case when month = 4 then null else 'kg' end unit, arg_max(batch_id, seq) batch_id from trade where batch_id = 'B2' or month = 3 group by 1, 2, 3, 4, 5, 6)"""
KEYS = "year, month, hs_code, partner_code, flow_type, source_system"
MERGED = f"with {MERGE} select {KEYS}, {{}} from t full join s using ({KEYS})"


def merged(df):
    return df.select(*TRADE_KEY, *dbl("value", "quantity"), "unit", "batch_id")


@query(MERGED.format("case when s.value is not null then s.value else t.value end::double as value, case when s.value is not null then s.quantity else t.quantity end::double quantity, case when s.value is not null then s.unit else t.unit end unit, coalesce(s.batch_id, t.batch_id) batch_id"), "trade")
def merge_overwrite(s, d):
    return merged(merge.merge_overwrite(*batches(s, d), TRADE_KEY))


@query(MERGED.format("case when t.batch_id = s.batch_id then t.value + s.value else coalesce(s.value, t.value) end::double as value, case when t.batch_id = s.batch_id then t.quantity + s.quantity else coalesce(s.quantity, t.quantity) end::double quantity, case when s.value is not null then s.unit else t.unit end unit, coalesce(s.batch_id, t.batch_id) batch_id"), "trade")
def merge_accumulate(s, d):
    return merged(merge.merge_accumulate(*batches(s, d), TRADE_KEY, ["value", "quantity"]))


@query(MERGED.format("coalesce(s.value, t.value)::double as value, coalesce(s.quantity, t.quantity)::double quantity, coalesce(s.unit, t.unit) unit, coalesce(s.batch_id, t.batch_id) batch_id"), "trade")
def merge_coalesce(s, d):
    return merged(merge.merge_coalesce(*batches(s, d), TRADE_KEY))


@query(MERGED.format("coalesce(t.value, s.value)::double as value, coalesce(t.quantity, s.quantity)::double quantity, case when t.value is not null then t.unit else s.unit end unit, coalesce(t.batch_id, s.batch_id) batch_id"), "trade")
def merge_ignore(s, d):
    return merged(merge.merge_ignore(*batches(s, d), TRADE_KEY))


ACCUMULATED = MERGED.format("case when t.batch_id = s.batch_id then t.value + s.value else coalesce(s.value, t.value) end::double as value, case when t.batch_id = s.batch_id then t.quantity + s.quantity else coalesce(s.quantity, t.quantity) end::double quantity, case when s.value is not null then s.unit else t.unit end unit, coalesce(s.batch_id, t.batch_id) batch_id")


@query(ACCUMULATED, "trade")
def merge_periods(s, d):
    """The two batches loaded into a table by period, the second one twice, of which only the first counts."""
    home = sinks.new_folder(s, "merge-periods")
    one, two = batches(s, d)
    for name, rows in (("B1", one), ("B2", two), ("B2", two)):
        tables.merge_batch(s, home, rows, name, layers.PERIOD, lambda old, new: merge.merge_accumulate(old, new, TRADE_KEY, ["value", "quantity"]))
    tables.clean(s, home)
    return merged(tables.read(s, home, one.schema))


@query("select fta_id, country_code from members where fta_id > 3 union all select fta_id, country_code from members where fta_id <= 3 and country_code < 'C10'", "members")
def replace_members(s, d):
    m = B.members(s, d)
    new = m.where("fta_id <= 3 and country_code < 'C10'")
    return merge.replace_members(m, new.union(new), m.where("fta_id <= 3").select("fta_id"), "fta_id").select("fta_id", "country_code")


@query("select source_system, count(*) n, sum(value)::double as value from (select source_system, value from grain where source_system <> 'NSO' union all select source_system, value * 2 from grain where source_system = 'NSO') group by 1", "grain")
def replace_slice(s, d):
    g = B.grain(s, d).select("source_system", F.col("value").cast("decimal(38,2)").alias("value"))
    new = g.where("source_system = 'NSO'").withColumn("value", (F.col("value") * 2).cast("decimal(38,2)"))
    return merge.replace_slice(g, new, F.col("source_system") == "NSO").groupBy("source_system").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("value"))


@query("select country_key, country_code, country_name, region, continent, version, effective_date, expiry_date, is_current from dim_country", "dim_country")
def scd2_apply(s, d):
    return B.dim_country(s, d)


# ---- late data ----
LATE_ROWS = f"""with {MARKS}, loaded as (select distinct {KEYS} from trade where batch_id = 'B1'), src as (select {KEYS} from trade where batch_id = 'B2' or month = 3 group by {KEYS}),
    det as (select src.*, last_year is not null and src.year * 100 + src.month < last_year * 100 + last_month and l.year is null is_late from src left join wm using (source_system) left join loaded l on l.year = src.year and l.month = src.month and l.hs_code = src.hs_code and l.partner_code = src.partner_code and l.flow_type = src.flow_type and l.source_system = src.source_system)"""


def detected(s, d):
    one, two = batches(s, d)
    return late.detect_late(two, watermarks(s, d), one, TRADE_KEY)


@query(LATE_ROWS + " select source_system, is_late is_late_arriving, count(*) n from det group by all", "trade")
def detect_late(s, d):
    return detected(s, d).groupBy("source_system", "is_late_arriving").agg(F.count("*").alias("n"))


@query(LATE_ROWS + " select source_system, (is_late and month > 6) is_late_arriving, case when is_late and month > 6 then 'late_arriving_not_yet_propagated_to_nds' end reject_reason, count(*) n from det group by all", "trade")
def resolve_late(s, d):
    ods = detected(s, d).withColumn("ods_id", C.surrogate_key(*TRADE_KEY))
    cleared, waiting = late.resolve_late(ods, ods.where("month <= 6").select("ods_id"))
    return cleared.join(waiting.select("ods_id", "reject_reason"), "ods_id", "left").groupBy("source_system", "is_late_arriving", "reject_reason").agg(F.count("*").alias("n"))


@query(LATE_ROWS + f" select source_system, month, count(*) n from (select distinct {KEYS} from det where is_late) group by all", "trade")
def audit_late(s, d):
    """The audit after a second detection: the keys of the first quarter were in it already."""
    found = detected(s, d).where("is_late_arriving")
    audit = late.audit_late(found.where("month <= 3").select(*TRADE_KEY).distinct(), found.unionByName(found), TRADE_KEY)
    return audit.groupBy("source_system", "month").agg(F.count("*").alias("n"))


# ---- matching ----
@query("select partner_code, i.name partner_name, i.region, count(*) n from (select upper(trim(partner_code)) partner_code from trade) left join iso i on iso3 = partner_code group by all", "trade", "iso")
def resolve_country(s, d):
    t = B.trade(s, d).select(F.concat(F.lit(" "), F.lower("partner_code")).alias("partner_code"))
    out = match.resolve_country_by_code(t, B.iso_reference(s, d))
    return out.groupBy(F.upper(F.trim("partner_code")).alias("partner_code"), "partner_name", "region").agg(F.count("*").alias("n"))


VARIANTS = [("Land of nation-3 (official)", 3), ("The Kingdom of N.5", 5), ("both", 6), ("both", 7)]
VARIANT_KEY = "trim(regexp_replace(regexp_replace(upper({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), '^ ?THE (.)', '\\1'))"
NAMES = f"""ref as (select iso3, name, region, continent from iso), al as (select * from (values ('NUOC ANH', 'nation_7')) a(alias, name)),
    va as (select {VARIANT_KEY.format("v")} vk, min(iso3) vi from (select name v, iso3 from ref union all select v, iso3 from (values {", ".join(f"('{v}', 'C0{k}')" for v, k in VARIANTS)}) t(v, iso3)) group by 1 having min(iso3) = max(iso3)),
    asked as (select distinct name, upper(name) k from (select n_name as name from nation union all select 'nuoc anh' union all select left(n_name, length(n_name) - 1) || 'X' from nation union all select 'X' || substr(n_name, 2) from nation
        union all select unnest(['land of NATION 3, official', 'kingdom of n 5', 'both', 'The nation 4']))),
    x as (select asked.*, case when a.alias is not null then ra.iso3 end ai, case when a.alias is not null then ra.name end an, re.iso3 ei, re.name en, va.vi, rv.name vn from asked left join al a on a.alias = k left join ref ra on upper(ra.name) = upper(a.name) left join ref re on upper(re.name) = k
        left join va on va.vk = {VARIANT_KEY.format("asked.name")} left join ref rv on rv.iso3 = va.vi),
    fz as (select k, iso3 fi, name fn from (select x.k, r.iso3, r.name, upper(r.name) rk, round((1 - levenshtein(x.k, upper(r.name)) / greatest(length(x.k), length(r.name))::double) * 100, 6) score from x, ref r
        where x.ai is null and x.ei is null and x.vi is null) where score > 70 qualify row_number() over (partition by k order by score desc, rk) = 1)"""


@query(f"""with {NAMES} select x.name, coalesce(ai, ei, vi, fi) iso3, coalesce(an, en, vn, fn, x.name) resolved_name,
    case when ai is not null then 'alias' when ei is not null then 'exact' when vi is not null then 'variant' when fi is not null then 'fuzzy' else 'unresolved' end how from x left join fz using (k)""", "iso")
def resolve_country_name(s, d):
    """The countries' names, worse spellings of them at either end, an alias and variants, one of which stands for two countries."""
    n = B.table(s, d, "nation").select(F.col("n_name").alias("name"))
    last = n.select(F.concat(F.expr("left(name, length(name) - 1)"), F.lit("X")).alias("name"))
    first = n.select(F.concat(F.lit("X"), F.expr("substring(name, 2)")).alias("name"))
    others = s.sql("select explode(array('nuoc anh', 'land of NATION 3, official', 'kingdom of n 5', 'both', 'The nation 4')) as name")
    variants = s.createDataFrame([(v, f"C0{k}") for v, k in VARIANTS], "variant string, iso3 string")
    return match.resolve_country_by_name(n.union(last).union(first).union(others), B.iso_reference(s, d), s.createDataFrame([("NUOC ANH", "nation_7")], "alias string, name string"), variants=variants)


RULES = [("widget", "870390"), ("gear", "120190"), ("red", "030399"), ("blue", "940383"), ("large", "270900"), ("a", "691200")]


@query("select p_partkey, case " + " ".join(f"when contains(t, '{w}') then '{c}'" for w, c in RULES) + " end inferred_code from (select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) t from part)")
def infer_keyword(s, d):
    return match.infer_by_keyword(B.table(s, d, "part"), RULES, "p_name").select("p_partkey", "inferred_code")


TOKENS = "list_filter(string_split(regexp_replace(lower(coalesce(t, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: {})"
STOP = ", ".join(f"'{w}'" for w in match.STOP_WORDS)


#: The best text of c (doc_id, t) for each of q (query_id, t) by the full product.
TFIDF = f"""g as (select 'q' side, query_id id, {TOKENS.format(f"length(w) >= 2 and w not in ({STOP})")} w from q union all select 'c', doc_id, {TOKENS.format(f"length(w) >= 2 and w not in ({STOP})")} from c),
    e as (select side, id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) gram from g), tf as (select side, id, gram, count(*) tf from e group by all),
    idf as (select gram, ln((1.0::double + (select count(*) from c)) / (1.0::double + count(*))) + 1 idf from tf where side = 'c' group by 1),
    w as (select side, id, gram, tf * idf w from tf join idf using (gram)), u as (select side, id, gram, w / sqrt(sum(w * w) over (partition by side, id)) w from w),
    p as (select a.id query_id, b.id doc_id, round(sum(a.w * b.w), 9) score from u a join u b on a.gram = b.gram and a.side = 'q' and b.side = 'c' group by 1, 2),
    best as (select query_id, doc_id, round(score, 6) score from p where score >= 0.2 qualify row_number() over (partition by query_id order by score desc, doc_id) = 1)"""


@query(f"""with q as (select distinct p_name query_id, p_name t from part), c as (select item_id::varchar doc_id, text t from benchmark union all select distinct p_brand || ' ' || p_name || ' ' || p_type, p_brand || ' ' || p_name || ' ' || p_type from part),
    {TFIDF} select query_id, doc_id, score from best""")
def tfidf_match(s, d):
    p = B.table(s, d, "part")
    q = p.select(F.col("p_name").alias("query_id"), F.col("p_name").alias("text")).distinct()
    described = F.concat_ws(" ", "p_brand", "p_name", "p_type")
    own = p.select(described.alias("doc_id"), described.alias("text")).distinct()
    c = B.table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("doc_id"), "text").unionByName(own)
    return match.tfidf_best_match(q, c).withColumn("score", r6("score"))


SORTED = "array_to_string(list_sort(" + TOKENS.format("w <> ''") + "), ' ')"


@query(f"""with n as (select distinct p_name t from part), q as (select t query_id, {SORTED} x from n), c as (select t doc_id, {SORTED.replace("coalesce(t, '')", "replace(t, 'e', '')")} x from n),
    p as (select query_id, doc_id, round((1 - levenshtein(q.x, c.x) / nullif(greatest(length(q.x), length(c.x)), 0)::double) * 100, 6) score from q, c)
    select * from p where score >= 60 qualify row_number() over (partition by query_id order by score desc, doc_id) = 1""")
def token_sort_match(s, d):
    n = B.table(s, d, "part").select("p_name").distinct()
    return match.token_sort_match(n.select(F.col("p_name").alias("query_id"), F.col("p_name").alias("text")), n.select(F.col("p_name").alias("doc_id"), F.replace("p_name", F.lit("e"), F.lit("")).alias("text")))


@query(f"""with pt as (select p_partkey, p_type || ' ' || p_name as text, case when p_size % 3 = 0 then lpad(p_size::varchar, 2, '0') || lpad((p_partkey % 10000)::varchar, 4, '0') end code from part),
    k as (select *, case when contains(x, 'widget') then '870390' when contains(x, 'gear') then '120190' end kw from (select *, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) x from pt)),
    q as (select distinct text query_id, text t from k where code is null and kw is null), c as (select hs_code doc_id, heading_name || ' ' || product_name t from products),
    {TFIDF}, sq as (select query_id, {SORTED} x from q anti join best using (query_id)), sc as (select doc_id, {SORTED} x from c),
    sb as (select query_id, doc_id from (select query_id, doc_id, round((1 - levenshtein(sq.x, sc.x) / nullif(greatest(length(sq.x), length(sc.x)), 0)::double) * 100, 6) score from sq, sc) where score >= 60
        qualify row_number() over (partition by query_id order by score desc, doc_id) = 1)
    select p_partkey, text, coalesce(code, kw, best.doc_id, sb.doc_id) hs_code from k left join best on best.query_id = text left join sb on sb.query_id = text""", "products")
def infer_codes(s, d):
    """Codes for the products without one: by keyword, else by text, else by sorted words."""
    p = B.table(s, d, "part").select("p_partkey", F.concat_ws(" ", "p_type", "p_name").alias("text"), F.when(F.col("p_size") % 3 == 0, B.hs_code()).alias("hs_code"))
    corpus = B.products(s, d).select(F.col("hs_code").alias("doc_id"), F.concat_ws(" ", "heading_name", "product_name").alias("text"))
    return match.infer_codes(p, "p_partkey", "text", "hs_code", [("widget", "870390"), ("gear", "120190")], corpus)


# ---- agreements ----
#: The agreement file's other columns: yes/no columns, years and texts, which are filled by rule from the agreement's number.
_PLAIN = ["aptiad_no", "title", "members_raw", "status", "scope"]
_OTHER = [c for c in HEADERS.values() if c not in _PLAIN]


def _later(c: str) -> str:
    return RENAMED.get(c, f"provision_{c}" if c in PROVISIONS else c)


def _other_sql(k: int, c: str) -> str:
    if c in YES_NO:
        return f"case (fta_id + {k}) % 3 when 0 then true when 1 then false end {_later(c)}"
    if "year" in c.split("_"):
        return f"case when (fta_id + {k}) % 4 <> 0 then 2000 + fta_id end::int {_later(c)}"
    return f"case when (fta_id + {k}) % 5 <> 0 then '{c} ' || fta_id end {_later(c)}"


def _other(k: int, c: str) -> F.Column:
    i = F.col("fta_id") + k
    if c in YES_NO:
        raw = F.when(i % 3 == 0, " Yes").when(i % 3 == 1, "NO ").otherwise("n/a")
    elif "year" in c.split("_"):
        raw = F.when(i % 4 != 0, F.concat(F.lit(" "), (F.col("fta_id") + 2000).cast("string"))).otherwise("2004?")
    else:
        raw = F.when(i % 5 != 0, F.concat(F.lit(f" {c} "), F.col("fta_id").cast("string"))).otherwise(" None")
    return raw.alias(c)


@query(f"""select fta_id::int aptiad_no, 'FTA ' || (fta_id % 8) fta_name, string_agg(n_name, '|' order by n_name) member_countries, case when fta_id % 3 = 0 then 'Entry into Force' else 'Pending' end status, 'Country - Bloc' as scope, 'APTIAD' source_system,
    {", ".join(_other_sql(k, c) for k, c in enumerate(_OTHER))} from members join nation on country_code = 'C' || lpad(n_nationkey::varchar, 2, '0') group by fta_id""", "members")
def agreements_to_ods(s, d):
    i = F.col("fta_id")
    m = B.members(s, d).join(B.countries(s, d), "country_code").groupBy("fta_id").agg(F.array_join(F.sort_array(F.collect_list("country_name")), " ; ").alias("members"))
    raw = m.select(
        i.cast("string").alias("aptiad_no"), F.concat(F.lit(" FTA "), (i % 8).cast("string")).alias("title"), F.concat("members", F.lit(" ;; ")).alias("members_raw"), F.when(i % 3 == 0, "entry  INTO force").otherwise(" Pending ").alias("status"),
        F.lit("COUNTRY -  bloc").alias("scope"), *[_other(k, c) for k, c in enumerate(_OTHER)],
    )
    return agreements.agreements_to_ods(raw).withColumn("member_countries", F.array_join("member_countries", "|"))


@query("select distinct fta_id, case when country_code = 'C24' then 'C14' else country_code end country_code from members", "members")
def explode_members(s, d):
    m = B.members(s, d).join(B.countries(s, d), "country_code").groupBy("fta_id").agg(F.collect_list(F.concat(F.lit(" "), "country_name")).alias("members"))
    return agreements.explode_members(m, B.iso_reference(s, d), s.sql("select 'NUOC ANH' as alias, 'nation_7' as name"))[0]


@query("select trade_key, fta_key from bridge", "bridge")
def fact_agreement_bridge(s, d):
    return agreements.fact_agreement_bridge(fact(s, d))


@query("select distinct fta_name from dim_fta where is_current union all select 'ALL'", "dim_fta")
def agreement_dimension(s, d):
    return agreements.agreement_dimension(B.stored(s, d, "dim_fta"))


# ---- star ----
@query("select rate_date, (year(rate_date) * 100 + month(rate_date))::int time_key, 2::bigint base_key, 1::bigint quote_key, vnd_per_usd::double vnd_per_usd from rates where (year(rate_date) * 100 + month(rate_date)) in (select time_key from dim_time)", "rates", "dim_time")
def fx_fact(s, d):
    dim = s.sql("select * from values (1L, 'USD'), (2L, 'VND') as t(currency_key, currency_code)")
    return S.build_fx_fact(B.rates(s, d), dim, B.stored(s, d, "dim_time")).withColumn("vnd_per_usd", F.col("vnd_per_usd").cast("double"))


@query("select trade_key, time_key, product_key, partner_key, flow_type, source_system, value::double as value, quantity::double quantity, exchange_rate::double exchange_rate, value_vnd::double value_vnd, array_to_string(fta_keys, ',') fta_keys from fact", "fact")
def trade_fact(s, d):
    return B.build_fact(s, d).select("trade_key", "time_key", "product_key", "partner_key", "flow_type", "source_system", *dbl("value", "quantity", "exchange_rate", "value_vnd"), F.array_join(F.col("fta_keys").cast("array<string>"), ",").alias("fta_keys"))


@query(f"""select batch_id, count(*) rows_extracted, count(*) filter ({REASON} is null) rows_loaded, count(*) filter ({REASON} is not null) rows_rejected, 'SUCCESS' status from dirty group by 1""", "dirty", "iso")
def batch_metrics(s, d):
    t, iso = B.dirty_trade(s, d), B.iso_reference(s, d)
    return layers.batch_metrics(t, rules.valid_trade(t, iso), rules.classify_rejects(t, iso))


# ---- tiles ----
def tiled(rows, wanted, **kw):
    return lambda s, d: cube.tile(star(s, d), rows, cube.trade_cube(), wanted, **kw)


VND = "sum(value_vnd)::double value_vnd"
EXPORT, IMPORT = "coalesce((sum(value_vnd) filter (flow_type))::double, 0)", "coalesce((sum(value_vnd) filter (not flow_type))::double, 0)"


@query(f"select year, {VND}, sum(value)::double as value from star group by 1", "star")
def tile_01(s, d):
    return tiled(["year"], ["value_vnd", "value"])(s, d)


@query(f"select year, {VND} from star where flow_type group by 1", "star")
def tile_02(s, d):
    return tiled(["year"], ["value_vnd"], where=F.col("flow_type"))(s, d)


@query(f"select year, {VND} from star where not flow_type group by 1", "star")
def tile_03(s, d):
    return tiled(["year"], ["value_vnd"], where=~F.col("flow_type"))(s, d)


@query(f"select year, {EXPORT} - {IMPORT} surplus from star group by 1", "star")
def tile_04(s, d):
    return tiled(["year"], ["surplus"])(s, d)


@query(f"with m as (select time_key, {VND} from star group by 1) select m.time_key, m.value_vnd, round((m.value_vnd - p.value_vnd) / nullif(p.value_vnd, 0), 6) growth from m left join m p on p.time_key = case when m.time_key % 100 = 1 then m.time_key - 89 else m.time_key - 1 end order by 1 desc limit 1", "star")
def tile_05(s, d):
    g = cube.growth(tiled(["time_key"], ["value_vnd"])(s, d), "value_vnd")
    return cube.tail_member(g).select("time_key", "value_vnd", r6("growth").alias("growth"))


@query("select time_key, (sum(value_vnd) filter (flow_type))::double export, (sum(value_vnd) filter (not flow_type))::double import from star group by 1", "star")
def tile_06(s, d):
    t = star(s, d).withColumn("flow", F.when(F.col("flow_type"), "export").otherwise("import"))
    return cube.tile(t, ["time_key"], cube.trade_cube(), ["value_vnd"], pivot=("flow", ["export", "import"]))


SHARE = f"select chapter, {VND}, round(sum(value_vnd)::double / (select sum(value_vnd)::double from star) * 100, 6) share from star group by 1"


@query(SHARE, "star")
def tile_07(s, d):
    t = cube.share_percent(tiled(["chapter"], ["value_vnd"])(s, d), "value_vnd")
    return t.withColumn("share", r6("share"))


@query("select region, sum(value_vnd)::double value_vnd, sum(quantity)::double quantity from star group by 1", "star")
def tile_08(s, d):
    return tiled(["region"], ["value_vnd", "quantity"])(s, d)


@query(f"select flow_type, {VND} from star group by 1", "star")
def tile_09(s, d):
    return tiled(["flow_type"], ["value_vnd"])(s, d)


@query(f"select hs_code, product_name, {VND} from star group by 1, 2 order by 3 desc, 1 limit 10", "star")
def tile_10(s, d):
    return R.top_count(tiled(["hs_code", "product_name"], ["value_vnd"])(s, d), 10, "value_vnd", "hs_code")


@query(f"select country_name, {VND} from star group by 1 order by 2 desc, 1 limit 10", "star")
def tile_11(s, d):
    return R.top_count(tiled(["country_name"], ["value_vnd"])(s, d), 10, "value_vnd", "country_name")


@query("select country_name, round(sum(value_vnd)::double / (select sum(value_vnd)::double from star) * 100, 6) share from star group by 1", "star")
def tile_12(s, d):
    t = cube.share_percent(tiled(["country_name"], ["value_vnd"])(s, d), "value_vnd")
    return t.select("country_name", r6("share").alias("share"))


@query(f"with c as ({UTIL}) select c.fta_name, c.time_key, c.trades, round(c.trades / a.trades::double * 100, 6) rate from c join c a on a.fta_name = 'ALL' and a.time_key = c.time_key where c.fta_name <> 'ALL'", "bridge", "dim_fta", "fact")
def tile_13(s, d):
    return cube.utilization_rate(utilization_counts(s, d)).select("fta_name", "time_key", "trades", r6("rate").alias("rate"))


ASYM = f"round(abs({EXPORT} - {IMPORT}) / nullif(sum(value_vnd)::double, 0), 6) asymmetry"


@query(f"select year, {ASYM} from star group by 1", "star")
def tile_14(s, d):
    return tiled(["year"], ["asymmetry"])(s, d).withColumn("asymmetry", r6("asymmetry"))


@query(f"select time_key, {ASYM} from star group by 1", "star")
def tile_15(s, d):
    return tiled(["time_key"], ["asymmetry"])(s, d).withColumn("asymmetry", r6("asymmetry"))


@query(f"select time_key, source_system, {VND} from star group by 1, 2", "star")
def tile_16(s, d):
    return tiled(["time_key", "source_system"], ["value_vnd"])(s, d)


@query(f"select time_key, source_system, region, {VND}, {EXPORT} - {IMPORT} surplus from star where year in (1996, 1997) and month in (1, 2, 3) group by 1, 2, 3", "star")
def dashboard_filter(s, d):
    """The dashboard's filter by years and months, over any tile."""
    t = cube.slicer(star(s, d), years=[1996, 1997], months=[1, 2, 3])
    return cube.tile(t, ["time_key", "source_system", "region"], cube.trade_cube(), ["value_vnd", "surplus"])


@query("select (year(rate_date) * 100 + month(rate_date))::int time_key, round(avg(vnd_per_usd::double), 1) avg_rate, max(vnd_per_usd)::double max_rate, min(vnd_per_usd)::double min_rate from rates group by 1", "rates")
def tile_17(s, d):
    t = B.rates(s, d).select(C.time_key(F.year("rate_date"), F.month("rate_date")).alias("time_key"), *dbl("vnd_per_usd"))
    return t.groupBy("time_key").agg(F.round(F.avg("vnd_per_usd"), 1).alias("avg_rate"), F.max("vnd_per_usd").alias("max_rate"), F.min("vnd_per_usd").alias("min_rate"))


def naive_forecast(s, d):
    """Next year's forecast of every series: this year's fact plus a tenth, with a crossed band."""
    f = fact(s, d)
    by = f.groupBy("time_key", *forecast.SERIES).agg(F.sum("value_vnd").cast("double").alias("v"))
    v = F.col("v")
    rows = by.select((F.col("time_key") + 100).alias("time_key"), *forecast.SERIES, F.lit("m1").alias("model_version"), (v * F.when(F.col("product_key") % 5 == 0, 5.0).when(F.col("product_key") % 7 == 0, -1.0).otherwise(1.1)).alias("forecast_value"), (v * 0.5 - 1e9).alias("lower_bound"), (v * 1.05).alias("upper_bound"))
    return f, rows


FORECAST = """fb as (select time_key, product_key, partner_key, flow_type, sum(value_vnd)::double v from fact group by 1, 2, 3, 4),
    fc as (select time_key + 100 time_key, product_key, partner_key, flow_type, v * case when product_key % 5 = 0 then 5.0::double when product_key % 7 = 0 then -1.0::double else 1.1::double end f, v * 0.5::double - 1e9::double lo, v * 1.05::double hi from fb),
    cp as (select product_key, partner_key, flow_type, (max(value_vnd) * 3)::double cap from fact group by 1, 2, 3),
    c1 as (select fc.*, cap, greatest(least(f, cap), 0::double) pt from fc left join cp using (product_key, partner_key, flow_type)),
    cl as (select time_key, product_key, partner_key, flow_type, pt forecast_value, least(greatest(least(lo, cap), 0::double), pt) lower_bound, greatest(least(hi, cap), pt) upper_bound from c1),
    vw as (select * from (select time_key, product_key, partner_key, flow_type, v actual_value from fb) full join cl using (time_key, product_key, partner_key, flow_type))"""


@query(f"with {FORECAST} select time_key, product_key, partner_key, flow_type, round(actual_value, 4) actual_value, round(forecast_value, 4) forecast_value, round(lower_bound, 4) lower_bound, round(upper_bound, 4) upper_bound from vw", "fact")
def clean_forecast_view(s, d):
    v = forecast.clean_forecast_view(*naive_forecast(s, d))
    return v.select("time_key", *forecast.SERIES, *[F.round(c, 4).alias(c) for c in ("actual_value", "forecast_value", "lower_bound", "upper_bound")])


@query()
def tile_18(s, d):
    """Actual against the model's forecast with its band, by month, over the chapters' series."""
    c = chapters(s, d)
    made = forecast.to_forecast_table(forecast.forecast_groups(c.select(*forecast.SERIES, "time_key", "y"), forecast.SERIES), "seasonal-1")
    v = forecast.clean_forecast_view(c.withColumn("value_vnd", F.col("y").cast("decimal(38,2)")), made)
    return v.groupBy("time_key").agg(*[F.sum(F.round(x, 4).cast("decimal(28,4)")).cast("double").alias(x) for x in ("actual_value", "forecast_value", "lower_bound", "upper_bound")])


@query(f"select created_hour, created_date, source_system, count(*) n from ({MONITOR}) group by 1, 2, 3")
def tile_19(s, d):
    """Arrivals by source: members of rows, so that any source shows; by date and by hour of the day."""
    m = cube.ingest_monitor(monitored(s, d))
    return m.groupBy("created_hour", "created_date", "source_system").agg(F.count("*").alias("n"))


@query(f"select created_date, source_system, count(*) n from ({MONITOR}) where late_flag = 'true' group by 1, 2")
def tile_20(s, d):
    return cube.ingest_monitor(monitored(s, d)).where("late_flag = 'true'").groupBy("created_date", "source_system").agg(F.count("*").alias("n"))


@query("select event_type source_system, max(year(ts))::int last_year, round((epoch(timestamp '2024-06-01') - epoch(date_trunc('second', max(ts)))) / 3600.0, 1)::double hours_since_update from events group by 1")
def tile_21(s, d):
    last = monitored(s, d).groupBy("source_system").agg(F.max("created_at").alias("updated_at"), F.max(F.year("created_at")).alias("last_year"))
    return cube.watermark_monitor(last, "2024-06-01 00:00:00").select("source_system", "last_year", F.col("hours_since_update").cast("double").alias("hours_since_update"))


# ---- features and models ----
PAIR = ["base_currency", "quote_currency"]
HORIZONS = list(range(1, 31))


def daily(s, d):
    return B.rates(s, d).select(*PAIR, "rate_date", F.col("vnd_per_usd").cast("double").alias("rate"))


FX = f"""f0 as (select rate_date, vnd_per_usd::double rate, vnd_per_usd::double / nullif(lag(vnd_per_usd::double) over (order by rate_date), 0) - 1 c from rates),
    f1 as (select *, lag(c) over w c1, lag(c, 2) over w c2, lag(c, 3) over w c3, case when count(c) over w7 = 7 then avg(c) over w7 end m7, case when count(c) over w7 = 7 then stddev_samp(c) over w7 end v7, case when count(c) over w30 = 30 then avg(c) over w30 end m30, case when count(c) over w30 = 30 then stddev_samp(c) over w30 end v30,
    {", ".join(f"lead(c, {k}) over w t{k}" for k in HORIZONS)} from f0 window w as (order by rate_date), w7 as (order by rate_date rows between 6 preceding and current row), w30 as (order by rate_date rows between 29 preceding and current row))"""


@query(f"with {FX} select rate_date, round(c, 6) change_pct, round(m7, 6) mean_7, round(v7, 6) vol_7, round(m30, 6) mean_30, round(v30, 6) vol_30, round(c1, 6) change_pct_lag1, round(c2, 6) change_pct_lag2, round(c3, 6) change_pct_lag3, (isodow(rate_date) - 1)::int day_of_week, month(rate_date)::int as month from f1", "rates")
def fx_features(s, d):
    f = features.fx_features(daily(s, d), PAIR)
    names = ["change_pct", "mean_7", "vol_7", "mean_30", "vol_30", "change_pct_lag1", "change_pct_lag2", "change_pct_lag3"]
    return f.select("rate_date", *[r6(n).alias(n) for n in names], "day_of_week", "month")


@query(f"with {FX} select rate_date, {', '.join(f'round(t{k}, 6) target_{k}' for k in HORIZONS)} from f1", "rates")
def fx_labels(s, d):
    f = features.fx_labels(features.fx_features(daily(s, d), PAIR), PAIR, HORIZONS)
    return f.select("rate_date", *[r6(f"target_{k}").alias(f"target_{k}") for k in HORIZONS])


@query(f"with {FX} select round(avg(c) + 2 * stddev_samp(c), 6) threshold from f1", "rates")
def fx_threshold(s, d):
    return R.tail_threshold(features.fx_features(daily(s, d), PAIR), "change_pct").select(r6("threshold").alias("threshold"))


@query(f"with {FX}, lab as (select t7, row_number() over (order by rate_date) r, count(*) over () n from f1 where t7 is not null and c3 is not null and v30 is not null) select round(avg(abs(t7)), 6) mae, round(sqrt(avg(t7 * t7)), 6) rmse, count(*) n from lab where r > floor(n * 0.8)", "rates")
def fx_naive_metrics(s, d):
    """The baseline `no change` over the last fifth of the labelled rows."""
    f = features.fx_labels(features.fx_features(daily(s, d), PAIR), PAIR, [7]).na.drop(subset=[*features.FX_FEATURES, "target_7"])
    test = R.time_split(f, PAIR, "rate_date").where("not is_train")
    return features.naive_metrics(test, "target_7", 0.0).select(r6("mae").alias("mae"), r6("rmse").alias("rmse"), "n")


def balances(s, d):
    """Monthly balances of each partner; late are its distinct keys that the audit would hold."""
    lates = B.trade(s, d).where("l_orderkey % 11 = 0 and month <> 7").select(*TRADE_KEY).distinct().groupBy("partner_code", "year", "month").agg(F.count("*").alias("late_count"))
    monthly = R.conditional_sums(B.grain(s, d), ["partner_code", "year", "month"])
    return features.balance_features(monthly, lates, ["partner_code"])


BALANCE = f"{MONTHLY}, lp as (select partner_code, year, month, count(*) late_count from (select distinct {KEYS} from trade where l_orderkey % 11 = 0 and month <> 7) group by 1, 2, 3), b0 as (select mp.*, coalesce(export_value, 0)::double ex, coalesce(import_value, 0)::double im, coalesce(export_value, 0)::double - coalesce(import_value, 0)::double balance, coalesce(late_count, 0) / n::double late_ratio from mp left join lp using (partner_code, year, month)), b1 as (select *, balance - lag(balance) over w bd, ex / nullif(lag(ex) over w, 0) - 1 eg, im / nullif(lag(im) over w, 0) - 1 ig, lag(balance) over w l1, lag(balance, 3) over w l3, lead(balance, 1) over w y1 from b0 window w as (partition by partner_code order by year, month))"


@query(f"with {BALANCE} select partner_code, year, month, round(balance, 2) balance, round(bd, 2) balance_delta, round(eg, 6) export_growth, round(ig, 6) import_growth, round(l1, 2) balance_lag1, round(l3, 2) balance_lag3, round(late_ratio, 6) late_ratio from b1", "trade", "grain")
def balance_features(s, d):
    b = balances(s, d)
    return b.select("partner_code", "year", "month", *[F.round(c, 2).alias(c) for c in ("balance", "balance_delta", "balance_lag1", "balance_lag3")], *[r6(c).alias(c) for c in ("export_growth", "import_growth", "late_ratio")])


@query(f"with {BALANCE} select partner_code, round(avg(balance) - 2 * stddev_samp(balance), 2) threshold from b1 group by 1", "trade", "grain")
def balance_threshold(s, d):
    return R.tail_threshold(balances(s, d), "balance", upper=False, keys=("partner_code",)).withColumn("threshold", F.round("threshold", 2))


@query(f"with {BALANCE}, lab as (select balance, y1, row_number() over (partition by partner_code order by year, month) r, count(*) over (partition by partner_code) n from b1 where y1 is not null and l3 is not null and eg is not null and ig is not null) select round(avg(abs(y1 - balance)), 2) mae, round(sqrt(avg((y1 - balance) * (y1 - balance))), 2) rmse, count(*) n from lab where r > floor(n * 0.8)", "trade", "grain")
def balance_naive_metrics(s, d):
    """The baseline `as this month` over the last fifth of each partner's labelled rows."""
    b = balances(s, d).withColumn("time_key", C.time_key("year", "month"))
    labelled = b.withColumn("y1", R.horizon_label("balance", R.series_window(["partner_code"], "time_key"), 1)).na.drop(subset=[*features.BALANCE_FEATURES, "y1"])
    m = features.naive_metrics(R.time_split(labelled, ["partner_code"], "time_key").where("not is_train"), "y1", "balance")
    return m.select(F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"), "n")


@query("select partner_code, h::int horizon, case when n - h < 4 then last end prediction from (select partner_code, count(*) n, arg_max(total, year * 100 + month) last from mp group by 1), range(1, 90) t(h)".join(["with " + MONTHLY + " ", ""]), "grain")
def persistence(s, d):
    m = monthly_by_partner(s, d).select("partner_code", C.time_key("year", "month").alias("time_key"), "total")
    last = R.latest_row(m, ["partner_code"], "time_key").withColumnRenamed("total", "last_value").join(m.groupBy("partner_code").agg(F.count("*").alias("n")), "partner_code")
    rows = last.select("partner_code", "last_value", "n", F.explode(F.sequence(F.lit(1), F.lit(89))).alias("horizon")).withColumns({"n_labelled": F.col("n") - F.col("horizon"), "prediction": F.lit(None).cast("double")})
    return features.persistence_fallback(rows).select("partner_code", "horizon", "prediction")


@query("""with a as (select max(rate_date) as_of, date_trunc('month', max(rate_date))::date m from rates) select 'fx' kind, i::int i, i::int k, (as_of + i::int)::date target from a, range(1, 31) t(i) union all
    select 'balance', i::int, (2 + i - 1)::int, (m + to_months((2 + i - 1)::int))::date from a, range(1, 13) t(i)""", "rates")
def horizon_calendar(s, d):
    last = B.rates(s, d).agg(F.max("rate_date").alias("as_of")).withColumn("last_month", F.trunc("as_of", "month"))
    return features.horizon_calendar(last, F.add_months("last_month", 2), 30, 12).select("kind", "i", "k", "target")


SERIES_SQL = """se as (select p.chapter, f.partner_key, flow_type, time_key, sum(value_vnd)::double y, any_value(x.k) product_key from fact f join dim_product p using (product_key) join (select chapter, min(product_key) k from dim_product where is_current group by 1) x on x.chapter = p.chapter group by 1, 2, 3, 4)"""


def chapters(s, d):
    return forecast.chapter_series(fact(s, d), B.stored(s, d, "dim_product")).withColumn("y", F.col("y").cast("double"))


@query(f"with {SERIES_SQL} select chapter, product_key, partner_key, flow_type, time_key, y from se", "fact", "dim_product")
def chapter_series(s, d):
    return chapters(s, d).select("chapter", *forecast.SERIES, "time_key", "y")


@query(f"with {SERIES_SQL} select product_key, partner_key, flow_type, count(*) n_obs, case when count(*) >= 11 then least(count(*) - 9, 3) else 0 end::int n_test from se group by 1, 2, 3 having count(*) >= 6", "fact", "dim_product")
def series_gate(s, d):
    return forecast.series_gate(chapters(s, d), forecast.SERIES)


@query("""select time_key, year, quarter, month from dim_time union all select (year(m) * 100 + month(m))::int, year(m)::int, quarter(m)::int, month(m)::int from (select (last + to_months(i::int))::date m from (select make_date((max(time_key) // 100)::int, (max(time_key) % 100)::int, 1) last from dim_time), range(1, 13) t(i))""", "dim_time")
def future_calendar(s, d):
    return forecast.future_calendar(B.stored(s, d, "dim_time"), 12)


@query(f"with {SERIES_SQL}, p as (select *, row_number() over (partition by product_key, partner_key, flow_type order by time_key desc) r, count(*) over (partition by product_key, partner_key, flow_type) n, avg(y) over (partition by product_key, partner_key, flow_type) yh from se) select product_key, partner_key, flow_type, round(avg(abs((y - yh) / (y + 1e-9::double))) * 100, 4) mape from p where n >= 11 and r <= least(n - 9, 3) group by 1, 2, 3", "fact", "dim_product")
def holdout_mape(s, d):
    c = chapters(s, d)
    c = c.withColumn("yhat", F.avg("y").over(Window.partitionBy(*forecast.SERIES)))
    test = forecast.series_positions(c, forecast.SERIES).where("is_test")
    return forecast.holdout_mape(test, forecast.SERIES).withColumn("mape", F.round("mape", 4))


@query()
def forecast_groups(s, d):
    return forecast.to_forecast_table(forecast.forecast_groups(chapters(s, d).select(*forecast.SERIES, "time_key", "y"), forecast.SERIES), "seasonal-1")


def fx_predictions(s, d):
    """The stored predictions of the last run, which the report reads too."""
    return B.stored(s, d, "fx_risk", predict_fx)


def predict_fx(s, d):
    f = features.fx_features(daily(s, d), PAIR)
    features.require_history(f, features.MIN_DAYS)
    pred = features.train_horizons(f, features.FX_FEATURES, "change_pct", PAIR, "rate_date", HORIZONS, level="rate")
    return features.fx_targets(features.risk_flags(pred, R.tail_threshold(f, "change_pct", keys=tuple(PAIR)), True, PAIR))


METRICS = ["mae", "rmse", "naive_mae", "naive_rmse"]


@query()
def train_horizons(s, d):
    """Changes and rates predicted for each of 30 days, with the models' errors over the held-out fifth."""
    return fx_predictions(s, d).select(*PAIR, "as_of", "target_date", "horizon", "prediction", "predicted_rate", "n_labelled", "high_risk", *METRICS)


@query()
def train_balance_horizons(s, d):
    """Balances of all partners as one panel, months ahead 1 to 12."""
    b = balances(s, d).withColumn("time_key", C.time_key("year", "month"))
    features.require_history(b, features.MIN_MONTHS)
    pred = features.train_horizons(b, features.BALANCE_FEATURES, "balance", ["partner_code"], "time_key", list(range(1, 13)), depth=3)
    low = R.tail_threshold(b, "balance", upper=False, keys=("partner_code",))
    return features.risk_flags(pred, low, False, ["partner_code"]).select("partner_code", "as_of", "horizon", "prediction", "n_labelled", "high_risk", *METRICS)


@query()
def risk_report_data(s, d):
    return features.risk_report_data(fx_predictions(s, d), PAIR)


# ---- layers ----
def references(s, d):
    nomenclature = B.products(s, d).select(F.col("hs_code").alias("hscode"), F.col("heading_name").alias("description"), F.lit(6).alias("level"))
    return layers.References(B.iso_reference(s, d), s.sql("select 'NUOC ANH' as alias, 'nation_7' as name"), nomenclature)


def unified(s, d):
    """Trade rows as they come from the sources: those of one source name the partner only."""
    t = B.trade(s, d)
    return t.select("year", "month", "hs_code", "product_name", F.when(F.col("source_system") == "NSO", "").otherwise(F.col("partner_code")).alias("partner_code"), F.concat(F.lit(" "), F.upper("partner_name")).alias("partner_name"), "flow_type", "value", "quantity", "unit", "source_system")


def staged(s, d):
    """Everything of the first batch is loaded already; the second one comes."""
    ods = s.createDataFrame([], ODS_TRADE)
    return layers.stage_to_ods(unified(s, d), references(s, d), watermarks(s, d), ods, "B9")


RESOLVED = "case when source_system = 'NSO' and partner_code = 'C24' then 'C14' else partner_code end"
STAGED = f"st as (select year, month, hs_code, {RESOLVED} partner_code, flow_type, source_system, sum(value) as value, sum(quantity) quantity from trade group by 1, 2, 3, 4, 5, 6)"


@query(f"with {MARKS}, {STAGED} select year, month, hs_code, left(hs_code, 2) chapter, partner_code, flow_type, source_system, value::double as value, quantity::double quantity, 'B9' batch_id, coalesce(year * 100 + month < last_year * 100 + last_month, false) is_late_arriving from st left join wm using (source_system)", "trade")
def stage_to_ods(s, d):
    return staged(s, d)[0].select("year", "month", "hs_code", "chapter", "partner_code", "flow_type", "source_system", *dbl("value", "quantity"), "batch_id", "is_late_arriving")


@query(f"""with {MARKS}, {STAGED}, j as (select *, {REASON} reason from st)
    select 'rejects' table_name, reason as name, count(*) n, sum(value)::double as value from j where reason is not null group by 2
    union all select 'late_audit', source_system, count(*), null from st join wm using (source_system) where year * 100 + month < last_year * 100 + last_month group by 2
    union all select 'ods', source_system, count(*), sum(value)::double from st group by 2
    union all select 'log ods', 'SUCCESS', count(*), null from st union all select 'log rejects', 'SUCCESS', count(*), null from j where reason is not null""", "trade", "iso")
def load_batches(s, d):
    """All rows loaded as one batch that is run twice: what ods, rejects (by payload), late audit and the logs hold then."""
    home = sinks.new_folder(s, "load-batches")
    for _ in range(2):
        layers.load_batch(unified(s, d), references(s, d), watermarks(s, d), home, "B9")
    held = lambda name, schema: tables.read(s, f"{home}/{name}", schema)
    rejects = held("rejects", REJECTS).groupBy(F.col("reject_reason").alias("name")).agg(F.count("*").alias("n"), F.sum(F.get_json_object("payload", "$.value").cast("decimal(28,6)")).cast("double").alias("value"))
    late_keys = held("late_audit", "year int, month int, hs_code string, partner_code string, flow_type boolean, source_system string, batch_id string").groupBy(F.col("source_system").alias("name")).agg(F.count("*").alias("n"))
    ods = held("ods", ODS_TRADE).groupBy(F.col("source_system").alias("name")).agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("value"))
    logs = [tables.batch_log(s, f"{home}/{t}").select(F.lit(f"log {t}").alias("table_name"), F.col("status").alias("name"), F.col("rows_after").alias("n")) for t in ("ods", "rejects")]
    empty = F.lit(None).cast("double")
    parts = [rejects.withColumn("table_name", F.lit("rejects")), late_keys.withColumns({"table_name": F.lit("late_audit"), "value": empty}), ods.withColumn("table_name", F.lit("ods")), *[x.withColumn("value", empty) for x in logs]]
    return R.union_sources(*[p.select("table_name", "name", "n", "value") for p in parts])


def normalised(s, d):
    ods = B.dirty_trade(s, d).withColumns({"chapter": F.left("hs_code", F.lit(2)), "heading": F.left("hs_code", F.lit(4))})
    grouped = B.members(s, d).join(B.countries(s, d), "country_code").groupBy("fta_id").agg(F.collect_list("country_name").alias("members"))
    fta = grouped.join(B.agreements(s, d), "fta_id")
    return layers.ods_to_nds(ods, fta, raw_rates(s, d), references(s, d), B.HOME)


VALID = f"""val as (select * from dirty where {REASON} is null), mem as (select distinct fta_id, case when country_code = 'C24' then 'C14' else country_code end country_code from members)"""
NDS = f"""select 'country' table_name, count(distinct partner_code) n from val union all select 'product', count(distinct hs_code) from val union all select 'time', count(*) from (select distinct year, month from val)
    union all select 'fta', count(distinct fta_id) from members union all select 'fta_member', count(*) from mem union all select 'fta_member_unresolved', 0
    union all select 'trade_transaction', count(*) from val
    union all select 'fta_utilization', count(*) from (select distinct {KEYS}, fta_id from val join mem on country_code = partner_code where fta_id in (select fta_id from mem where country_code = 'C00'))
    union all select 'currency', 2 union all select 'exchange_rate', count(*) from raw where rate_date is not null and rate > 0 union all select 'rejects', count(*) from dirty where {REASON} is not null
    union all select 'rate_rejects', count(*) from raw where rate_date is null or rate is null or rate <= 0"""


@query(f"with {RAW_RATES}, {VALID} {NDS}", "dirty", "iso", "members")
def ods_to_nds(s, d):
    return R.layer_counts(normalised(s, d))


@query("select 'fact_trade' table_name, count(*) n, sum(value)::double as value from (select * from (select year, month, hs_code, partner_code, value from trade) x join dim_country c on c.country_code = x.partner_code and c.effective_date <= make_date(year, month, 1) and make_date(year, month, 1) < c.expiry_date) union all select 'dim_country', count(*), null from dim_country union all select 'dim_product', count(distinct hs_code), null from trade union all select 'dim_fta', count(*), null from dim_fta", "trade", "dim_country", "dim_fta")
def nds_to_dds(s, d):
    """The star from normalised tables: the second snapshot of countries and agreements over stored first ones, no products yet."""
    t = B.trade(s, d).withColumns({"chapter": F.left("hs_code", F.lit(2)), "heading": F.left("hs_code", F.lit(4))})
    product = R.first_of(t.select("hs_code", "product_name", "heading", "chapter"), ["hs_code"], [F.col("product_name").asc_nulls_last(), "heading", "chapter"])
    nds = {
        "country": B.countries(s, d, True).select(F.col("country_code").alias("partner_code"), F.col("country_name").alias("partner_name"), "region", "continent"), "product": product, "time": t.select("year", "quarter", "month").distinct(),
        "fta": B.agreements(s, d, True), "fta_member": B.members(s, d), "trade_transaction": t, "exchange_rate": B.rates(s, d),
    }
    dims = {
        "dim_country": merge.first_load(B.countries(s, d), "country_code", ["country_name", "region", "continent"], "country_key"), "dim_product": s.createDataFrame([], DIM_PRODUCT),
        "dim_fta": merge.first_load(B.agreements(s, d), "fta_id", ["fta_name"], "fta_key"),
    }
    dds = layers.nds_to_dds(nds, dims, B.RUN_DATE, B.HOME)
    facts = dds["fact_trade"].agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("value")).select(F.lit("fact_trade").alias("table_name"), "n", "value")
    return facts.unionByName(R.layer_counts({n: dds[n] for n in ("dim_country", "dim_product", "dim_fta")}).withColumn("value", F.lit(None).cast("double")))


@query(f"with {RAW_RATES} select rate_date, (year(rate_date) * 100 + month(rate_date))::int time_key, 'VND' base_currency, 'USD' quote_currency, 7::bigint base_key, 4::bigint quote_key, max(round(1 / rate::double, 6)) vnd_per_usd from raw where rate_date is not null and rate > 0 and (year(rate_date) * 100 + month(rate_date)) in (select time_key from dim_time) group by rate_date", "dim_time")
def fx_star(s, d):
    """The currency dimension, of which USD and others are known already, and the exchange-rate fact of the star plan."""
    clean_rates, _ = rules.split_rate_rejects(raw_rates(s, d))
    rates = clean_rates.withColumn("vnd_per_usd", C.inverse_rate("rate"))
    known = s.createDataFrame([(4, "USD"), (6, "EUR")], "currency_key long, currency_code string")
    codes = rates.select(F.explode(F.array("base_currency", "quote_currency")).alias("currency_code")).distinct()
    currency = layers.kept(merge.merge_currencies(known, codes), "dim-currency")
    fact = S.build_fx_fact(S.one_rate_a_day(rates), currency, B.stored(s, d, "dim_time"))
    named = {role: currency.select(F.col("currency_key").alias(f"{role}_key"), F.col("currency_code").alias(f"{role}_currency")) for role in ("base", "quote")}
    out = fact.join(named["base"], "base_key").join(named["quote"], "quote_key")
    return out.select("rate_date", "time_key", "base_currency", "quote_currency", "base_key", "quote_key", F.round(F.col("vnd_per_usd").cast("double"), 6).alias("vnd_per_usd"))


@query(f"with {STAGED}, ok as (select st.* from st where value > 0 and partner_code in (select iso3 from iso)) select 'ods' table_name, count(*) n from st union all select 'nds_trade_transaction', count(*) from ok union all select 'nds_rejects', (select count(*) from st) - (select count(*) from ok) union all select 'fact_trade', count(*) from ok union all select 'dim_country', count(distinct partner_code) from ok union all select 'dim_product', count(distinct hs_code) from ok", "trade", "iso")
def layered_load(s, d):
    """Stage to star, every layer stored, from empty tables."""
    fta = B.members(s, d).join(B.countries(s, d), "country_code").groupBy("fta_id").agg(F.collect_list("country_name").alias("members")).join(B.agreements(s, d), "fta_id")
    dims = {n: s.createDataFrame([], schema) for n, schema in (("dim_country", DIM_COUNTRY), ("dim_product", DIM_PRODUCT))} | {"dim_fta": merge.first_load(B.agreements(s, d), "fta_id", ["fta_name"], "fta_key")}
    out = layers.layered_load(unified(s, d), fta, raw_rates(s, d), references(s, d), s.createDataFrame([], ODS_TRADE), watermarks(s, d), dims, B.RUN_DATE, B.HOME, "B9")
    return R.layer_counts({n: out[n] for n in ("ods", "nds_trade_transaction", "nds_rejects", "fact_trade", "dim_country", "dim_product")})
