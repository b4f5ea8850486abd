"""Late-arriving data: detection against per-source watermarks, and its resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import matched_null_safe

LATE_REASON = "late_arriving_not_yet_propagated_to_nds"


def detect_late(df: DataFrame, watermark: DataFrame, loaded: DataFrame, keys: list[str]) -> DataFrame:
    """df with is_late_arriving: its source has a watermark, its period is before that, and its key isn't loaded yet."""
    mark = watermark.select("source_system", (F.col("last_year") * 100 + F.col("last_month")).alias("__mark"))
    known = loaded.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct().withColumn("__known", F.lit(True))
    marked = df.join(mark, "source_system", "left")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    late = F.col("__mark").isNotNull() & (F.col("year") * 100 + F.col("month") < F.col("__mark")) & F.col("__known").isNull()
    return marked.join(known, same, "left").withColumn("is_late_arriving", F.coalesce(late, F.lit(False))).select(*df.columns, "is_late_arriving")


def audit_late(audit: DataFrame, late: DataFrame, keys: list[str]) -> DataFrame:
    """audit with the newly detected late keys, each once; what it holds stays as it is. Null equals null."""
    return audit.unionByName(matched_null_safe(late.select(*keys).distinct(), audit, keys, "left_anti").select(*audit.columns))


def split_propagated(late: DataFrame, nds: DataFrame, key: str = "ods_id") -> tuple[DataFrame, DataFrame]:
    """(propagated, not yet) of the late rows."""
    ids = nds.select(key).distinct()
    return late.join(ids, key, "left_semi"), late.join(ids, key, "left_anti")


def clear_late_flag(ods: DataFrame, ids: DataFrame, key: str = "ods_id") -> DataFrame:
    marked = ods.join(ids.select(key).distinct().withColumn("__done", F.lit(True)), key, "left")
    return marked.withColumn("is_late_arriving", F.col("is_late_arriving") & F.col("__done").isNull()).select(*ods.columns)


def resolve_late(ods: DataFrame, nds: DataFrame, key: str = "ods_id") -> tuple[DataFrame, DataFrame]:
    """(ods with the flag cleared where the row reached the next layer, rejects for those that did not)."""
    done, waiting = split_propagated(ods.where("is_late_arriving"), nds, key)
    return clear_late_flag(ods, done, key), waiting.withColumn("reject_reason", F.lit(LATE_REASON))
