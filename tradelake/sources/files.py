"""File and table sources."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clean
from ..operators.relational import carry_forward, first_of
from .agreement_columns import HEADERS

#: Columns of the trade CSV and their names in the stage table.
TRADE_CSV = {
    "period": "period", "cmdCode": "cmd_code", "cmdDesc": "cmd_desc", "reporterISO": "reporter_iso", "reporterDesc": "reporter_desc", "partnerISO": "partner_iso", "partnerDesc": "partner_desc",
    "flowCode": "flow_code", "flowDesc": "flow_desc", "primaryValue": "primary_value", "cifvalue": "cif_value", "fobvalue": "fob_value", "netWgt": "net_wgt", "qty": "qty",
    "qtyUnitAbbr": "qty_unit", "motCode": "mot_code", "motDesc": "mot_desc",
}
TRADE_NUMBERS = ["primary_value", "cif_value", "fob_value", "net_wgt", "qty"]
RATE_COLUMNS = ["rate_date", "base_currency", "quote_currency", "rate"]
_PERIOD = r"(20\d{2})-M(\d{1,2})"


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A layer table that is stored as Parquet under base."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def read_trade_csv(spark: SparkSession, path: str) -> DataFrame:
    """The named columns of latin-1 CSV files, all as text (codes keep their zeros), under their stage names."""
    raw = spark.read.option("header", True).option("encoding", "ISO-8859-1").option("inferSchema", False).csv(path)
    return raw.select(*[F.col(f"`{c}`").cast("string").alias(n) for c, n in TRADE_CSV.items()])


def clean_trade_csv(raw: DataFrame) -> DataFrame:
    return raw.withColumns({c: clean.to_number(c) for c in TRADE_NUMBERS})


def read_agreements_csv(spark: SparkSession, path: str) -> DataFrame:
    """Agreement files as text with source_file and snapshot_date (from `…_DD.MM.YYYY.csv`); a header that is not known
    is an error."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path).select("*", F.col("_metadata.file_name").alias("source_file"))
    names = [re.sub(r"\s+", " ", c.removeprefix("﻿")).strip() for c in raw.columns[:-1]]
    unknown = [n for n in names if n not in HEADERS]
    if unknown:
        raise ValueError(f"unknown headers: {unknown}")
    day = F.try_to_date(F.regexp_extract("source_file", r"(\d{2}\.\d{2}\.\d{4})\.csv$", 1), "dd.MM.yyyy")
    return raw.toDF(*[HEADERS[n] for n in names], "source_file").withColumn("snapshot_date", day)


def read_monthly_text_report(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, year, flow_type, goods, country, raw_values, month_count) of UTF-16 tab-separated reports: flow and
    year stand in the first line, the months in a header, and a goods line holds for the countries below it."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.decode("content", "UTF-16").alias("text"))
    lines = F.split(F.regexp_replace("text", "\r", ""), "\n")
    head = files.select("source_file", lines.alias("lines")).withColumns({
        "flow_type": F.when(F.lower(F.get("lines", F.lit(0))).contains("export"), True).when(F.lower(F.get("lines", F.lit(0))).contains("import"), False),
        "year": F.regexp_extract(F.get("lines", F.lit(0)), r"\b(20\d{2})\b", 1).try_cast("int"),
        "month_count": F.regexp_extract(F.array_join("lines", "\n"), r"(?i)\b(\d+)\s+months?\b", 1).try_cast("int"),
    })
    checked = head.withColumn("year", F.when(F.col("flow_type").isNull() | F.col("year").isNull() | F.col("month_count").isNull(), F.raise_error(F.concat(F.lit("no flow, year or months in "), "source_file"))).otherwise(F.col("year")))
    rows = checked.select("source_file", "year", "flow_type", "month_count", F.posexplode("lines").alias("line_no", "line")).where("line_no > 0")
    skip = (F.trim("line") == "") | F.trim("line").startswith("Goods") | F.lower(F.trim("line")).startswith("of which") | F.col("line").contains("Quantity") | F.col("line").contains("Value")
    fields = rows.where(~skip).withColumn("f", F.transform(F.split("line", "\t"), lambda x: F.trim(x))).where(F.size("f") >= 3)
    labelled = fields.withColumns({"own": F.nullif(clean.collapse(F.get("f", F.lit(0))), F.lit("")), "country": F.nullif(clean.collapse(F.get("f", F.lit(1))), F.lit(""))})
    w = Window.partitionBy("source_file").orderBy("line_no")
    goods = labelled.withColumn("goods", carry_forward("own", w))
    numbers = F.transform(F.filter(F.slice("f", F.lit(3), F.greatest(F.size("f") - 2, F.lit(0))), lambda x: x.rlike(r"\d")), lambda x: F.regexp_replace(x, r"[^0-9.\-]", ""))
    kept = goods.where("own is null and country is not null and goods is not null").withColumn("raw_values", numbers).where(F.size("raw_values") > 0)
    return kept.select("source_file", "year", "flow_type", "goods", "country", "raw_values", "month_count")


def expand_month_cells(df: DataFrame) -> DataFrame:
    """One row per month of raw_values. With N months, 2N+1 numbers start with N values, 2N or 2N+2 are pairs of quantity
    and value, other lengths of at least N start with N values; fewer are an error. Values are in thousands."""
    n, size = F.col("month_count"), F.size("raw_values")
    paired = size.isin(0) | (size == 2 * n) | (size == 2 * n + 2)
    checked = df.withColumn("raw_values", F.when(size < n, F.raise_error(F.concat(F.lit("too few values for "), F.coalesce("country", F.lit("?"))))).otherwise(F.col("raw_values")))
    months = checked.select("*", paired.alias("__paired"), F.explode(F.sequence(F.lit(1), n)).alias("month"))
    at = lambda i: F.try_element_at("raw_values", i.cast("int")).try_cast("decimal(18,6)")
    m = F.col("month")
    return months.select("country", "goods", "flow_type", "year", "month", F.when(F.col("__paired"), at(2 * m - 1)).alias("quantity"), (F.when(F.col("__paired"), at(2 * m)).otherwise(at(m)) * 1000).cast("decimal(18,6)").alias("value"))


def unpivot_months(wide: DataFrame, ids: list[str]) -> DataFrame:
    """Long rows (ids, year, month, value_usd_k) of the columns named `… YYYY-Mmm`; empty cells go."""
    months = [c for c in wide.columns if c not in ids and re.search(_PERIOD, c)]
    long = wide.unpivot([F.col(f"`{i}`") for i in ids], [F.col(f"`{c}`").cast("string").alias(c) for c in months], "label", "cell")
    part = lambda k: F.regexp_extract("label", _PERIOD, k).try_cast("int")
    return long.select(*ids, part(1).alias("year"), part(2).alias("month"), clean.to_number("cell", "double").alias("value_usd_k")).na.drop(subset=["year", "month", "value_usd_k"])


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of every line of the files, line from 0. A file is read by one task, as one stream."""
    content = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\\r\\n?", "\n").alias("value"))
    lines = content.select("file", F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("line", "value"))
    return lines


def _csv_cells(df: DataFrame, column: str, width: int) -> DataFrame:
    """df with the array cells: the column as a CSV line of up to width cells."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    parsed = F.from_csv(column, schema, {"mode": "PERMISSIVE"})
    return df.withColumn("__csv", parsed).withColumn("cells", F.array(*[F.col(f"__csv.c{i}") for i in range(width)])).drop("__csv")


def _width(heads: DataFrame, *columns: str) -> int:
    """Cells of the longest header line, or more."""
    commas = [F.max(F.length(c) - F.length(F.replace(F.col(c), F.lit(","), F.lit("")))) for c in columns]
    return 1 + max([0, *(n for n in heads.agg(*commas).first() if n is not None)])


def _must_have(found: DataFrame, condition: str, what: str) -> None:
    bad = found.where(f"not coalesce({condition}, false)").select("file").first()
    if bad is not None:
        raise ValueError(f"{what} in {bad.file}")


def _headers(lines: DataFrame, marks: Column, what: str) -> DataFrame:
    """(file, at, header) for every file: its first line with a mark, wherever that is."""
    heads = lines.groupBy("file").agg(F.min(F.when(marks, F.struct("line", "value"))).alias("h"))
    heads = heads.select("file", F.col("h.line").alias("at"), F.col("h.value").alias("header")).persist()
    if heads.isEmpty():
        raise ValueError("no lines")
    _must_have(heads, "at is not null", what)
    return heads


def _month_cells(lines: DataFrame, heads: DataFrame, width: int, skip: int) -> DataFrame:
    """The rows of heads (file, at, months and more) with cells and, for each of months (pos, year, month), the number of the cell
    at its position; empty cells go. One plan for all files."""
    body = lines.join(heads, "file").where(F.col("line") >= F.col("at") + skip).where(F.trim("value") != "")
    each = _csv_cells(body, "value", width).withColumn("m", F.explode("months"))
    return each.withColumns({"year": F.col("m.year"), "month": F.col("m.month"), "value_usd_k": clean.to_number(F.get("cells", F.col("m.pos")), "double")}).where("year is not null and month is not null and value_usd_k is not null")


def _months_of(cells: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """(pos, year, month) of the cells that name a month."""
    part = lambda x, k: F.regexp_extract(x, _PERIOD, k).try_cast("int")
    named = F.transform(cells, lambda x, i: F.struct(i.alias("pos"), part(x, 1).alias("year"), part(x, 2).alias("month")))
    return F.filter(named, lambda m: m["year"].isNotNull() & (keep(m["pos"]) if keep else F.lit(True)))


def read_wide_monthly_csv(spark: SparkSession, path: str, markers: tuple[str, ...] = ("Exporters", "Importers", "Product code"), exporter: str | None = None, importer: str | None = None, product: str | None = None) -> DataFrame:
    """(exporter_name, importer_name, product_code, year, month, value_usd_k) of tables with a column for each month.
    The header of each file is its first line with a marker; a side that has no column is the given constant. Headers are a
    small table that is joined by file, so the plan is the same for one file and for thousands."""
    lines = _numbered(spark, path)
    marks = reduce(Column.__or__, [F.contains(F.col("value"), F.lit(m)) for m in markers])
    heads = _headers(lines, marks, f"no header with one of {markers}")
    width = _width(heads, "header")
    heads = _csv_cells(heads, "header", width).withColumn("names", F.transform("cells", lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))))
    position = lambda *wanted: F.coalesce(*[F.nullif(F.array_position("names", w), F.lit(0).cast("long")) for w in wanted])
    heads = heads.select("file", "at", _months_of("cells").alias("months"), position("exporters", "exporter").alias("e"), position("importers", "importer").alias("i"), position("product code").alias("p"))
    rows = _month_cells(lines, heads, width, 1)
    side = lambda at, constant, tidy: F.when(F.col(at).isNotNull(), tidy(F.get("cells", F.col(at).cast("int") - 1))).otherwise(F.lit(constant).cast("string"))
    return rows.select(side("e", exporter, clean.fix_mojibake).alias("exporter_name"), side("i", importer, clean.fix_mojibake).alias("importer_name"), side("p", product, clean.clean_product_code).alias("product_code"), "year", "month", "value_usd_k")


#: The two countries of a title or file name like `Bilateral trade between A and B`.
_PAIR = r"(?i)between[\s_]+(.+?)[\s_]+and[\s_]+(.+?)(?:\.csv|[,;(]|$)"


def _pair_of(text: Column) -> Column:
    """The countries that a title names, empty strings if it names none."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(text, "^.*/", "")), '^"+|"+$', "")
    return F.array(*[_plain(F.replace(F.regexp_extract(plain, _PAIR, k), F.lit("_"), F.lit(" "))) for k in (1, 2)])


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "\u0099|™", "ô"), r"\s+", " "))


def read_bilateral_csv(spark: SparkSession, path: str, partner: str | None, target: str, flow: str) -> DataFrame:
    """The months of one direction of two-country tables: a file's first header line names a group of columns (blank cells
    go on with the last), the second the months. flow `import` keeps the partner's exports to target, `export` the
    target's to the partner. Without a partner it is the other country of the file's title line or name."""
    lines = _numbered(spark, path)
    heads = _headers(lines, F.contains(F.col("value"), F.lit("Product code")), "no two header lines")
    second = lines.join(heads, "file").where("line = at + 1").select("file", F.col("value").alias("second"))
    titles = lines.join(heads, "file").where("line < at").where(F.element_at(_pair_of(F.col("value")), 1) != "")
    titles = titles.groupBy("file").agg(F.min_by("value", "line").alias("title"))
    both = heads.join(second, "file", "left").join(titles, "file", "left").persist()
    _must_have(both, "second is not null", "no two header lines")
    if partner is None:
        pair = _pair_of(F.coalesce("title", F.try_url_decode("file"), "file"))
        others = F.filter(pair, lambda c: (c != "") & (F.lower(c) != target.lower()))
        both = both.withColumn("partner", F.when(F.size(others) == 1, F.try_element_at(others, F.lit(1))))
    else:
        both = both.withColumn("partner", F.lit(partner))
    _must_have(both, "partner is not null", f"no pair of countries with {target}")
    width = _width(both, "header", "second")
    named = _csv_cells(_csv_cells(both, "header", width).withColumnRenamed("cells", "groups"), "second", width)
    # a group goes on over the blank cells behind it
    groups = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.lower(_plain(F.try_element_at(F.filter(F.slice("groups", F.lit(1), i), lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), F.lit(-1)))))
    source, sink = (F.col("partner"), F.lit(target)) if flow == "import" else (F.lit(target), F.col("partner"))
    named = named.withColumns({"source": source, "sink": sink}).withColumn("filled", groups)
    wanted = lambda i: F.contains(F.get("filled", i), F.lower(F.concat(F.lit("exports to "), "sink"))) | F.contains(F.get("filled", i), F.lower(F.concat(F.lit("imports from "), "source")))
    chosen = named.select("file", "at", "source", "sink", _months_of("cells", wanted).alias("months"), F.array_position("filled", "product code").cast("int").alias("p"))
    _must_have(chosen, "size(months) > 0", f"no monthly columns of the {flow}s")
    code = F.nullif(clean.clean_product_code(F.get("cells", F.col("p") - 1)), F.lit(""))
    rows = _month_cells(lines, chosen, width, 2).withColumn("product_code", code).where("product_code is not null")
    return rows.select(F.col("source").alias("exporter_name"), F.col("sink").alias("importer_name"), "product_code", "year", "month", "value_usd_k")


def since_last_rates(new: DataFrame, existing: DataFrame, start: str = "1999-01-04", overlap_days: int = 7) -> DataFrame:
    """Rates from overlap_days before the newest known date on (revisions), or from start if there are none."""
    cut = existing.agg(F.coalesce(F.date_sub(F.max("rate_date"), overlap_days), F.lit(start).cast("date")).alias("__cut"))
    return new.join(cut).where(F.try_to_date(F.col("rate_date").cast("string"), "yyyy-MM-dd") >= F.col("__cut")).drop("__cut")


def read_rates_incremental(spark: SparkSession, path: str, existing: DataFrame, start: str = "1999-01-04") -> DataFrame:
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    missing = [c for c in RATE_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return since_last_rates(raw.select(*RATE_COLUMNS), existing, start)


def nomenclature(raw: DataFrame, seq: str) -> DataFrame:
    """(hscode, description, level): codes of odd length get a zero in front, the first row per code stays."""
    padded = raw.withColumn("hscode", F.when(F.length("hscode") % 2 == 1, F.concat(F.lit("0"), "hscode")).otherwise(F.col("hscode")))
    return first_of(padded, ["hscode"], [F.col(seq)]).select("hscode", "description", "level")


def read_nomenclature(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).schema("hscode string, description string, level int").csv(path)
    return nomenclature(raw.withColumn("__seq", F.monotonically_increasing_id()), "__seq")


def read_country_list(spark: SparkSession, path: str, preamble: int = 7) -> DataFrame:
    """Distinct country names of CSV files with preamble lines before their header, and World."""
    body = _numbered(spark, path).where(F.col("line") > preamble)
    first = F.regexp_extract("value", r'^\s*("([^"]*)"|([^,]*))', 0)
    names = body.select(clean.fix_mojibake(F.regexp_replace(first, '"', "")).alias("name")).where("name <> ''")
    return names.distinct().unionByName(spark.range(1).select(F.lit("World").alias("name"))).distinct()
