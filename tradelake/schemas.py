"""Schemas of the layer tables, and conforming a frame to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE = T.DecimalType(18, 6)
#: Open ends of a validity window (Spark has no infinite dates).
FIRST_DATE, LAST_DATE = "0001-01-01", "9999-12-31"


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


_S, _I, _L, _B, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DateType(), T.TimestampType()

TRADE_KEY = ["year", "month", "hs_code", "partner_code", "flow_type", "source_system"]

STAGE_CSV = _schema(
    period=_S, cmd_code=_S, cmd_desc=_S, reporter_iso=_S, reporter_desc=_S, partner_iso=_S, partner_desc=_S, flow_code=_S, flow_desc=_S,
    primary_value=VALUE, cif_value=VALUE, fob_value=VALUE, net_wgt=VALUE, qty=VALUE, qty_unit=_S, mot_code=_S, mot_desc=_S,
)
UNIFIED_TRADE = _schema(year=_I, month=_I, hs_code=_S, product_name=_S, partner_code=_S, partner_name=_S, flow_type=_B, value=VALUE, quantity=VALUE, unit=_S, source_system=_S)
ODS_TRADE = _schema(
    ods_id=_S, year=_I, quarter=_I, month=_I, hs_code=_S, heading=_S, chapter=_S, product_name=_S, partner_code=_S, partner_name=_S, region=_S, continent=_S,
    flow_type=_B, value=VALUE, quantity=VALUE, unit=_S, source_system=_S, batch_id=_S, is_late_arriving=_B,
)
EXCHANGE_RATE = _schema(rate_date=_D, base_currency=_S, quote_currency=_S, rate=T.DecimalType(18, 10), vnd_per_usd=VALUE)
WATERMARK = _schema(source_system=_S, last_year=_I, last_month=_I, updated_at=_TS)
REJECTS = _schema(batch_id=_S, source_table=_S, reject_reason=_S, payload=_S)
DIM_COUNTRY = _schema(country_key=_L, country_code=_S, country_name=_S, region=_S, continent=_S, version=_I, effective_date=_D, expiry_date=_D, is_current=_B)
DIM_PRODUCT = _schema(product_key=_L, hs_code=_S, product_name=_S, heading=_S, chapter=_S, version=_I, effective_date=_D, expiry_date=_D, is_current=_B)
FACT_TRADE = _schema(trade_key=_S, time_key=_I, product_key=_L, partner_key=_L, flow_type=_B, source_system=_S, value=VALUE, quantity=VALUE, exchange_rate=VALUE, value_vnd=T.DecimalType(20, 2), fta_keys=T.ArrayType(_L))
FORECAST = _schema(time_key=_I, product_key=_L, partner_key=_L, flow_type=_B, model_version=_S, forecast_value=T.DoubleType(), lower_bound=T.DoubleType(), upper_bound=T.DoubleType())


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the schema's columns, in order: missing ones are null, others go, types are cast."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
