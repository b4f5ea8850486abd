"""Cleaning expressions: every function takes a column (or its name) and returns a built-in expression."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def _c(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Col, kind: str = "decimal(18,6)") -> Column:
    """The number, or null where the text is none."""
    return _c(c).try_cast(kind)


def fix_mojibake(c: Col) -> Column:
    """Trimmed, with U+0099 and the trade-mark sign read as the letter they stand for in badly decoded names."""
    return F.translate(F.trim(_c(c)), "\u0099™", "ôô")


def clean_product_code(c: Col) -> Column:
    return F.regexp_replace(F.trim(_c(c)), "^'+", "")


def build_period(year: Col, month: Col) -> Column:
    """YYYYMM."""
    return F.concat(F.lpad(_c(year).cast("string"), 4, "0"), F.lpad(_c(month).cast("string"), 2, "0"))


def split_period(period: Col) -> tuple[Column, Column]:
    return F.substring(_c(period), 1, 4).try_cast("int"), F.substring(_c(period), 5, 2).try_cast("int")


def null_if_blank(c: Col) -> Column:
    t = F.trim(_c(c))
    return F.when(t.isin("", "nan", "None"), None).otherwise(t)


def yes_no(c: Col) -> Column:
    t = F.lower(F.trim(_c(c)))
    return F.when(t == "yes", True).when(t == "no", False)


def four_digit_year(c: Col) -> Column:
    t = F.trim(_c(c))
    return F.when(t.rlike("^[0-9]{4}$"), t.try_cast("int"))


def collapse(c: Col) -> Column:
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def normalize_label(c: Col, labels: Mapping[str, str]) -> Column:
    """The label that the lower-cased text stands for, else the text with its blanks collapsed; blank is null."""
    t = F.nullif(collapse(c), F.lit(""))
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(t)), t)


def parse_members(c: Col) -> Column:
    """Names of a `;` list: trimmed, without blanks, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(F.split(_c(c), ";"), lambda x: F.trim(x)), lambda x: x != ""))


def quarter_of(month: Col) -> Column:
    return (F.floor((_c(month) - 1) / 3) + 1).cast("int")


def pad_code(c: Col) -> Column:
    """Commodity codes of odd length have lost a zero in front; a blank code is all zeros."""
    t = F.coalesce(F.trim(_c(c)), F.lit(""))
    return F.when(t == "", F.lit("000000")).when(F.length(t) % 2 == 1, F.concat(F.lit("0"), t)).otherwise(t)


def hs_hierarchy(c: Col) -> tuple[Column, Column, Column]:
    """(code, chapter, heading); both parents are blank for a blank code."""
    blank, code = F.coalesce(F.trim(_c(c)), F.lit("")) == "", pad_code(c)
    return code, F.when(blank, "").otherwise(F.left(code, F.lit(2))), F.when(blank, "").otherwise(F.left(code, F.lit(4)))


def inverse_rate(c: Col) -> Column:
    return F.round(F.lit(1).cast("decimal(18,10)") / F.nullif(_c(c), F.lit(0).cast("decimal(18,10)")), 6).cast("decimal(18,6)")


def normalize_currency(c: Col) -> Column:
    return F.upper(F.trim(_c(c)))


def parse_decimal(c: Col, kind: str = "decimal(18,6)") -> Column:
    """The number left when all but digits, points and minus signs go."""
    return F.nullif(F.regexp_replace(_c(c), r"[^0-9.\-]", ""), F.lit("")).try_cast(kind)


def time_key(year: Col, month: Col) -> Column:
    return (_c(year) * 100 + _c(month)).cast("int")


def to_local_currency(value: Col, rate: Col) -> Column:
    return F.round(_c(value).cast("decimal(19,2)") * _c(rate).cast("decimal(18,6)"), 2)


def sanitize_forecast(c: Col) -> Column:
    """Null, NaN and infinities are 0; two decimals; within ±9e13."""
    x = _c(c)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.greatest(F.least(F.round(F.when(bad, 0.0).otherwise(x), 2), F.lit(9e13)), F.lit(-9e13))


def surrogate_key(*columns: Col) -> Column:
    """A key that depends on the business key only, so that reruns agree."""
    return F.md5(F.concat_ws("|", *[_c(c).cast("string") for c in columns]))


def reject_payload(*columns: str) -> Column:
    """The row as JSON with its nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
