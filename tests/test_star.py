"""The star's facts: their grain, and what their plans do not do."""

import datetime

from tradelake import binding, queries
from tradelake.plans import star

DATA = "/root/testdata/sf0.001"
DAY = datetime.date(2025, 1, 2)


def test_rates_are_one_a_day_before_the_dimensions_are_joined(spark):
    rates = spark.createDataFrame([(DAY, "VND", "USD", 2.0), (DAY, "VND", "USD", 3.0), (DAY, "VND", "EUR", None), (None, "VND", "USD", 1.0)], "rate_date date, base_currency string, quote_currency string, vnd_per_usd double")
    assert {tuple(r) for r in star.one_rate_a_day(rates).collect()} == {(DAY, "VND", "USD", 3.0), (DAY, "VND", "EUR", None), (None, "VND", "USD", 1.0)}
    currency = spark.createDataFrame([(1, "USD"), (2, "VND")], "currency_key long, currency_code string")
    time = spark.createDataFrame([(202501, 2025, 1)], "time_key int, year int, month int")
    assert [tuple(r) for r in star.build_fx_fact(star.one_rate_a_day(rates), currency, time).collect()] == [(DAY, 202501, 2, 1, 3.0)]


def test_fact_is_summed_without_sorting_rows_and_keeps_its_keys(spark):
    built = binding.build_fact(spark, DATA)
    assert "SortAggregate" not in built._jdf.queryExecution().executedPlan().toString()
    held = queries.fact(spark, DATA)
    assert held.columns == built.columns
    want = built.select("trade_key", "time_key", "value").collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, held.select("trade_key", "time_key", "value").collect())) and all(len(r.trade_key) == 32 for r in want)


def test_rows_are_dealt_by_key_before_they_are_summed(spark):
    plan = binding.measures(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # both sums lie above the only shuffle by key, so no task holds the groups of a whole split
    assert plan.index("HashAggregate") < plan.rindex("HashAggregate") < plan.index("REPARTITION_BY_NUM")
