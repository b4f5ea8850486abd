"""Merge operators: pure functions (target, source) -> new target. A sink then overwrites the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FIRST_DATE, LAST_DATE
from .keys import number_rows
from .relational import changed_rows, matched_null_safe, new_keys_only


def _merge(target: DataFrame, source: DataFrame, keys: list[str], both: Callable[[str], Column]) -> DataFrame:
    """Full outer merge: both(c) gives column c of rows that are on both sides, from t.c and s.c."""
    t = target.withColumn("__t", F.lit(True)).alias("t")
    s = source.withColumn("__s", F.lit(True)).alias("s")
    rest = [c for c in target.columns if c not in keys]
    on_both = F.col("__t") & F.col("__s")
    own = lambda c: F.when(on_both, both(c)).when(F.col("__s"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    joined = t.join(s, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys], "full_outer")
    return joined.select(*[F.coalesce(F.col(f"s.{k}"), F.col(f"t.{k}")).alias(k) for k in keys], *[own(c) for c in rest]).select(*target.columns)


def merge_overwrite(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return _merge(target, source, keys, lambda c: F.col(f"s.{c}"))


def merge_accumulate(target: DataFrame, source: DataFrame, keys: list[str], numbers: list[str], batch: str = "batch_id") -> DataFrame:
    """Numbers add up when both rows are of one batch and are replaced otherwise; the rest is the source's. Loading
    the same batch twice therefore counts it twice."""
    same = F.col(f"s.{batch}") == F.col(f"t.{batch}")

    def both(c: str) -> Column:
        if c not in numbers:
            return F.col(f"s.{c}")
        zero = F.lit(0).cast(target.schema[c].dataType)
        added = (F.coalesce(F.col(f"t.{c}"), zero) + F.coalesce(F.col(f"s.{c}"), zero)).cast(target.schema[c].dataType)
        return F.when(same, added).otherwise(F.col(f"s.{c}"))

    return _merge(target, source, keys, both)


def merge_coalesce(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """A null of the source never replaces a value."""
    return _merge(target, source, keys, lambda c: F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}")))


def merge_ignore(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target's row stays; of source rows with one key the largest by its other columns is added. A null in a key equals
    a null."""
    rest = [c for c in target.columns if c not in keys]
    fresh = matched_null_safe(source, target, keys, "left_anti")
    one = fresh.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__r")).select(*keys, "__r.*") if rest else fresh.select(*keys).distinct()
    return target.unionByName(one.select(*target.columns))


def replace_members(target: DataFrame, source: DataFrame, scope: DataFrame | None, key: str) -> DataFrame:
    """Members of the agreements in scope (all: None) are replaced by the distinct source rows."""
    new = source.select(*target.columns).distinct()
    return new if scope is None else target.join(scope.select(key).distinct(), key, "left_anti").select(*target.columns).unionByName(new)


def replace_slice(target: DataFrame, new: DataFrame, predicate: Column) -> DataFrame:
    """Rows of target for which predicate holds go, the new ones come."""
    return target.where(~F.coalesce(predicate, F.lit(False))).unionByName(new.select(*target.columns))


def scd2_apply(dim: DataFrame, src: DataFrame, key: str, attrs: list[str], run_date: str, surrogate: str) -> DataFrame:
    """A dimension with history: unknown keys come as version 1 without end on either side; of changed ones the
    current version ends at run_date and the next begins there; unchanged ones stay. A second change on one day
    leaves a version that no period falls into. Surrogate keys go on from the largest, in key order."""
    current = dim.where("is_current")
    changed = changed_rows(src.select(key, *attrs), current.select(key, *attrs), key, attrs)
    ended = dim.join(changed.select(key, F.lit(True).alias("__c")), key, "left")
    ends = F.col("is_current") & F.coalesce("__c", F.lit(False))
    kept = ended.select(*[
        F.when(ends, F.lit(run_date).cast("date")).otherwise(F.col(c)).alias(c) if c == "expiry_date" else (F.col(c) & ~ends).alias(c) if c == "is_current" else F.col(c) for c in dim.columns
    ])
    first = new_keys_only(src.select(key, *attrs), dim.select(key), key).select(key, *attrs, F.lit(1).alias("version"), F.lit(FIRST_DATE).cast("date").alias("effective_date"))
    later = changed.join(current.select(key, (F.col("version") + 1).alias("version")), key).select(key, *attrs, F.col("version").cast("int"), F.lit(run_date).cast("date").alias("effective_date"))
    top = dim.agg(F.coalesce(F.max(surrogate), F.lit(0)).cast("long").alias("__top"))
    new = number_rows(first.unionByName(later), key, "__n", "version").join(top)
    numbered = new.withColumn(surrogate, F.col("__top") + F.col("__n")).withColumns({"expiry_date": F.lit(LAST_DATE).cast("date"), "is_current": F.lit(True)})
    return kept.unionByName(numbered.select(*dim.columns))


def first_load(src: DataFrame, key: str, attrs: list[str], surrogate: str) -> DataFrame:
    """The first version of a dimension from its source."""
    return number_rows(src, key, surrogate).select(surrogate, key, *attrs, F.lit(1).alias("version"), F.lit(FIRST_DATE).cast("date").alias("effective_date"), F.lit(LAST_DATE).cast("date").alias("expiry_date"), F.lit(True).alias("is_current"))


def merge_currencies(dim: DataFrame | None, codes: DataFrame) -> DataFrame:
    """(currency_key, currency_code): the dimension so far with the codes that it lacks; keys go on from the largest, by code."""
    new = codes.select("currency_code").where("currency_code is not null").distinct()
    if dim is None:
        return number_rows(new, "currency_code", "currency_key").select("currency_key", "currency_code")
    top = dim.agg(F.coalesce(F.max("currency_key"), F.lit(0)).cast("long")).scalar()
    fresh = number_rows(new_keys_only(new, dim.select("currency_code"), "currency_code"), "currency_code", "__n")
    return dim.select("currency_key", "currency_code").unionByName(fresh.select((F.col("__n") + top).alias("currency_key"), "currency_code"))
