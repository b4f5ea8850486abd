"""Operators on small frames: the scenarios that decide their semantics."""

import datetime
import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tradelake.functions import clean as C
from tradelake.operators import agreements, cube, features, forecast, late, match, merge, rules
from tradelake.operators.keys import number_rows
from tradelake.operators import relational as R
from tradelake.plans import layers, star
from tradelake.schemas import conform

D = datetime.date


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


def test_text_cleaning(spark):
    assert one(spark, C.null_if_blank(F.lit(" nan "))) is None
    assert one(spark, C.fix_mojibake(F.lit(" C\u0099te ™"))) == "Côte ô"
    assert one(spark, C.clean_product_code(F.lit(" ''0901"))) == "0901"
    assert one(spark, C.parse_members(F.lit("Japan; Viet Nam ;; Japan"))) == ["Japan", "Viet Nam"]
    assert one(spark, C.normalize_label(F.lit("Entry  into   force"), agreements.STATUSES)) == "Entry into Force"
    assert one(spark, C.normalize_label(F.lit("Something Else"), agreements.SCOPES)) == "Something Else"
    assert [one(spark, C.four_digit_year(F.lit(v))) for v in ("2009", "2009?", " ")] == [2009, None, None]
    assert [one(spark, C.yes_no(F.lit(v))) for v in ("Yes", " no ", "n/a")] == [True, False, None]


def test_codes_and_numbers(spark):
    assert [one(spark, C.hs_hierarchy(F.lit(c))[0]) for c in ("90111", "", "TOTAL")] == ["090111", "000000", "0TOTAL"]
    assert one(spark, C.hs_hierarchy(F.lit("90111"))[2]) == "0901"
    assert one(spark, C.to_number(F.lit("abc"))) is None
    assert float(one(spark, C.parse_decimal(F.lit("US$ 1,200.5")))) == 1200.5
    assert float(one(spark, C.inverse_rate(F.lit("0.00004").cast("decimal(18,10)")))) == 25000.0
    assert [one(spark, C.sanitize_forecast(F.lit(v))) for v in (float("nan"), float("inf"), 1e15, 1.239)] == [0.0, 0.0, 9e13, 1.24]


def test_reject_payload_keeps_nulls(spark):
    df = spark.sql("select 1 as a, cast(null as string) as b")
    assert df.select(C.reject_payload("a", "b")).first()[0] == '{"a":1,"b":null}'


def test_conform(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("z", T.IntegerType())])
    assert conform(spark.sql("select 1 as a, 2 as b"), schema).collect() == [("1", None)]


def test_rejects_are_the_complement(spark):
    iso = spark.createDataFrame([("JPN",)], ["iso3"])
    df = spark.createDataFrame([(None, "JPN", 1.0), ("X", "JPN", 1.0), ("0901", "", 1.0), ("0901", "ZZZ", 1.0), ("0901", "jpn", 0.0), ("0901", "JPN", None), ("0901", "JPN", 2.0)], "hs_code string, partner_code string, value double")
    bad = rules.classify_rejects(df, iso)
    assert sorted(r.reject_reason for r in bad.collect()) == sorted(["missing_hs_code", "invalid_hs_code_format", "missing_partner_code", "invalid_partner_code", "invalid_value", "invalid_value"])
    assert rules.valid_trade(df, iso).unionByName(bad.drop("reject_reason")).exceptAll(df).count() == 0
    assert rules.valid_trade(df, iso).count() + bad.count() == df.count()


def test_rate_rejects(spark):
    df = spark.createDataFrame([("2025-01-01", " vnd ", "usd", "0.00004"), ("2025-13-01", "VND", "USD", "0.00004"), ("2025-01-02", "VND", "USD", "0"), ("2025-01-03", "VND", "USD", "x")], ["rate_date", "base_currency", "quote_currency", "rate"])
    good, bad = rules.split_rate_rejects(df)
    assert rows(good.select("rate_date", "base_currency", "quote_currency")) == [(D(2025, 1, 1), "VND", "USD")]
    assert sorted(r.reject_reason for r in bad.collect()) == ["invalid_rate_date", "invalid_rate_value", "invalid_rate_value"]


def test_grain_rollup_skips_nulls(spark):
    df = spark.createDataFrame([("k", 10.0, "kg", 1), ("k", None, None, 2), (None, None, None, 3)], "key string, value double, unit string, seq int")
    out = R.rollup_to_grain(df, ["key"], ["value"], "seq")
    assert sorted(map(tuple, out.select("key", F.col("value").cast("double"), "unit").collect()), key=str) == [("k", 10.0, "kg"), (None, 0.0, None)]


def test_merges(spark):
    t = spark.createDataFrame([("a", 10, "B1", "x"), ("b", 1, "B1", "y")], "k string, v int, batch_id string, n string")
    s = spark.createDataFrame([("a", 5, "B1", None), ("c", 7, "B2", "z")], "k string, v int, batch_id string, n string")
    assert rows(merge.merge_accumulate(t, s, ["k"], ["v"]), "k") == [("a", 15, "B1", None), ("b", 1, "B1", "y"), ("c", 7, "B2", "z")]
    assert rows(merge.merge_accumulate(t, s.withColumn("batch_id", F.lit("B9")), ["k"], ["v"]), "k")[0] == ("a", 5, "B9", None)
    assert rows(merge.merge_coalesce(t, s, ["k"]), "k")[0] == ("a", 5, "B1", "x")
    assert rows(merge.merge_overwrite(t, s, ["k"]), "k")[0] == ("a", 5, "B1", None)
    assert rows(merge.merge_ignore(t, s, ["k"]), "k") == [("a", 10, "B1", "x"), ("b", 1, "B1", "y"), ("c", 7, "B2", "z")]
    assert rows(merge.replace_slice(t, s, F.col("k") == "a"), "k", "v") == [("a", 5, "B1", None), ("b", 1, "B1", "y"), ("c", 7, "B2", "z")]


def test_history_and_point_in_time(spark):
    src = spark.createDataFrame([("K", "x"), ("L", "x")], ["bk", "attr"])
    dim = merge.first_load(src, "bk", ["attr"], "sk")
    changed = spark.createDataFrame([("K", "y"), ("L", "x"), ("M", None)], "bk string, attr string")
    dim = merge.scd2_apply(dim, changed, "bk", ["attr"], "2025-06-15", "sk")
    got = {(r.bk, r.version): r for r in dim.collect()}
    assert got["K", 1].expiry_date == D(2025, 6, 15) and not got["K", 1].is_current
    assert got["K", 2].effective_date == D(2025, 6, 15) and got["K", 2].is_current
    assert got["L", 1].is_current and got["M", 1].version == 1 and len(got) == 4
    assert len({r.sk for r in got.values()}) == 4
    assert merge.scd2_apply(dim, changed, "bk", ["attr"], "2025-07-01", "sk").exceptAll(dim).count() == 0
    facts = spark.createDataFrame([("K", D(2025, 6, 1)), ("K", D(2025, 7, 1)), ("Q", D(2025, 7, 1))], ["bk", "period_start"])
    assert rows(R.as_of_dimension(facts, dim.select("bk", "attr", "effective_date", "expiry_date"), ["bk"], "left").select("bk", "period_start", "attr"), "bk", "period_start") == [("K", D(2025, 6, 1), "x"), ("K", D(2025, 7, 1), "y"), ("Q", D(2025, 7, 1), None)]


def test_late_rows(spark):
    mark = spark.createDataFrame([("NSO", 2025, 5)], ["source_system", "last_year", "last_month"])
    df = spark.createDataFrame([("new", 2025, 4, "NSO"), ("known", 2025, 4, "NSO"), ("new", 2025, 6, "NSO"), ("new", 2020, 1, "OTHER")], ["k", "year", "month", "source_system"])
    keys = ["k", "year", "month", "source_system"]
    out = late.detect_late(df, mark, df.where("k = 'known'"), keys)
    assert [r.month for r in out.where("is_late_arriving").collect()] == [4] and out.count() == 4
    ods = out.withColumn("ods_id", F.concat_ws("-", *keys))
    ods = ods.withColumn("is_late_arriving", F.col("source_system") == "NSO")
    cleared, waiting = late.resolve_late(ods, ods.where("k = 'known'"))
    assert cleared.where("is_late_arriving").count() == 2 and waiting.count() == 2
    assert {r.reject_reason for r in waiting.collect()} == {late.LATE_REASON}


def test_co_membership(spark):
    members = spark.createDataFrame([(1, "VNM"), (1, "JPN"), (2, "JPN"), (2, "KOR")], ["fta_id", "country_code"])
    trades = spark.createDataFrame([("t1", "JPN"), ("t2", "KOR")], ["trade_id", "partner_code"])
    assert rows(R.co_membership(trades, members, "VNM")) == [("t1", 1)]


def test_utilization_counts_a_name_once(spark):
    fact = spark.createDataFrame([(f"t{i}", 202501, "JPN", [1, 2] if i == 0 else None) for i in range(4)], "trade_key string, time_key int, partner_code string, fta_keys array<long>")
    dim = spark.createDataFrame([(1, "A"), (2, "A")], "fta_key long, fta_name string")
    out = cube.utilization_rate(R.utilization_by_agreement(fact, dim))
    assert rows(out.select("fta_name", "trades", "rate")) == [("A", 1, 25.0)]
    assert sorted(rows(R.utilization_summary(fact))) == [(1, 1, 4, 25.0), (2, 1, 4, 25.0)]


def test_month_end_rate_is_of_one_pair(spark):
    r = spark.createDataFrame([(D(2025, 1, 30), 2.0, "VND", "USD"), (D(2025, 1, 10), 1.0, "VND", "USD"), (D(2025, 1, 31), 9.0, "VND", "EUR")], ["rate_date", "vnd_per_usd", "base_currency", "quote_currency"])
    assert rows(R.month_end_rate(r, "VND", "USD")) == [(2025, 1, 2.0)]


def test_agreements_are_those_of_the_period(spark):
    """Two versions of an agreement, and one that ends: each month has the keys that were valid then."""
    members = spark.createDataFrame([(1, "VNM"), (1, "JPN"), (2, "VNM"), (2, "JPN"), (3, "JPN")], ["fta_id", "country_code"])
    first, cut_, last = D(1, 1, 1), D(2025, 3, 15), D(9999, 12, 31)
    dim = spark.createDataFrame([(10, 1, first, cut_), (11, 1, cut_, last), (20, 2, D(2025, 1, 1), D(2025, 4, 1)), (30, 3, first, last)], "fta_key long, fta_id int, effective_date date, expiry_date date")
    spans = star.home_agreements(members, dim, "VNM")
    fact = spark.createDataFrame([("JPN", D(2024, 12, 1)), ("JPN", D(2025, 3, 1)), ("JPN", D(2025, 4, 1)), ("KOR", D(2025, 3, 1))], ["partner_code", "period_start"])
    got = {(r.partner_code, r.period_start): r.fta_keys for r in R.as_of_dimension(fact, spans, ["partner_code"], "left").collect()}
    assert got == {("JPN", D(2024, 12, 1)): [10], ("JPN", D(2025, 3, 1)): [10, 20], ("JPN", D(2025, 4, 1)): [11], ("KOR", D(2025, 3, 1)): None}


def test_late_share_is_of_the_same_series(spark):
    monthly = spark.createDataFrame([("A", 2025, 1, 10.0, 4.0, 4), ("B", 2025, 1, 5.0, 1.0, 2)], "p string, year int, month int, export_value double, import_value double, n long")
    late_rows = spark.createDataFrame([("A", 2025, 1, 1)], "p string, year int, month int, late_count long")
    got = {r.p: r.late_ratio for r in features.balance_features(monthly, late_rows, ["p"]).collect()}
    assert got == {"A": 0.25, "B": 0.0}


def test_numbers_follow_the_key(spark):
    keys = [f"{i * 7919 % 100000:06d}" for i in range(500)]
    got = number_rows(spark.createDataFrame([(k,) for k in keys], "k string").repartition(7), "k", "n").orderBy("k").collect()
    assert [(r.k, r.n) for r in got] == [(k, i + 1) for i, k in enumerate(sorted(keys))]
    numbers = [-5000, -1, 0, 3, 4095, 4096, 10**12]
    assert [(r.k, r.n) for r in number_rows(spark.createDataFrame([(k,) for k in reversed(numbers)], "k long"), "k", "n").orderBy("k").collect()] == [(k, i + 1) for i, k in enumerate(numbers)]


def test_ignoring_merge_knows_null_keys(spark):
    t = spark.createDataFrame([(None, 1, 5)], "k string, j int, v int")
    s = spark.createDataFrame([(None, 1, 9), (None, 2, 7), (None, 2, 8), ("a", 1, 1)], "k string, j int, v int")
    once = merge.merge_ignore(t, s, ["k", "j"])
    assert sorted(rows(once), key=str) == sorted(rows(merge.merge_ignore(once, s, ["k", "j"])), key=str) == sorted([(None, 1, 5), (None, 2, 8), ("a", 1, 1)], key=str)


def test_facts_are_upserted_by_their_key(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "trade_key string, value int")
    assert sorted(rows(star.upsert_facts(old, spark.createDataFrame([("b", 9), ("c", 3)], "trade_key string, value int")))) == [("a", 1), ("b", 9), ("c", 3)]


def test_audit_has_each_late_key_once(spark):
    audit = spark.createDataFrame([(1, None)], "a int, b string")
    found = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "a int, b string")
    assert sorted(rows(late.audit_late(audit, found, ["a", "b"])), key=str) == [(1, None), (2, "x")]


def test_batch_log_counts_replaced_rows(spark):
    loaded = spark.createDataFrame([("B", 1), ("B", 2)], "batch_id string, k int")
    got = rows(layers.batch_metrics(loaded, loaded, loaded.where("false"), loaded.where("k = 1"), ["k"]))
    assert got == [("B", 2, 2, 0, 1, "SUCCESS")]


def test_rolling_waits_for_full_windows(spark):
    df = spark.createDataFrame([("p", i, float(i + 1)) for i in range(8)], ["k", "t", "v"])
    w = Window.partitionBy("k").orderBy("t")
    df = df.withColumn("c", R.pct_change("v", w)).withColumn("m", R.rolling("c", w, 7, "mean")).orderBy("t")
    assert [r.m is not None for r in df.collect()] == [False] * 7 + [True]


def test_growth_crosses_years_and_sees_gaps(spark):
    df = spark.createDataFrame([(202412, 10.0), (202501, 11.0), (202503, 22.0)], ["time_key", "v"])
    assert [r.growth for r in cube.growth(df, "v").orderBy("time_key").collect()] == [None, pytest.approx(0.1), None]


def plain_forecast(months, y, horizon):
    """One series by itself: ridge on trend and harmonics, and the band of the residuals."""
    def design(m):
        t = m / 12.0
        return np.column_stack([np.ones(len(t)), t, np.sin(2 * np.pi * t), np.cos(2 * np.pi * t), np.sin(4 * np.pi * t), np.cos(4 * np.pi * t)])

    def fit(m, v):
        x = design(m)
        return np.linalg.solve(x.T @ x + np.diag([0.0, 0.1, 1, 1, 1, 1]) + 1e-9 * np.eye(6), x.T @ v)

    m = months - months[0]
    w = fit(m, y)
    low, high = np.quantile(y - design(m) @ w, [0.1, 0.9])
    test = min(len(y) - 9, 3) if len(y) >= 11 else 0
    mape = None
    if test:
        v = fit(m[:-test], y[:-test])
        mape = np.mean(np.abs((y[-test:] - design(m[-test:]) @ v) / (y[-test:] + 1e-9))) * 100
    point = design(m[-1] + np.arange(1, horizon + 1)) @ w
    return point, point + low, point + high, mape


def test_forecasts_are_those_of_each_series_by_itself(spark):
    rnd, rows_, want = np.random.default_rng(5), [], {}
    for k, n in enumerate([5, 6, 10, 11, 30, 47]):
        start = 2020 * 12 + int(rnd.integers(12))
        months = start + np.arange(n)
        y = 100 + 3 * np.arange(n) + 20 * np.sin(months) + rnd.normal(0, 5, n)
        rows_ += [(k, 1, True, int(m // 12 * 100 + m % 12 + 1), float(v)) for m, v in zip(months, y, strict=True)]
        if n >= 6:
            want[k] = plain_forecast(months.astype(float), y, 4)
    df = spark.createDataFrame(rows_, "product_key long, partner_key long, flow_type boolean, time_key int, y double").repartition(5)
    got = {}
    for r in forecast.forecast_groups(df, forecast.SERIES, 4).orderBy("product_key", "time_key").collect():
        got.setdefault(r.product_key, []).append(r)
    assert set(got) == set(want)
    for k, (point, low, high, mape) in want.items():
        for name, values in (("point", point), ("lower", low), ("upper", high)):
            assert [r[name] for r in got[k]] == pytest.approx(list(values), rel=1e-6)
        assert got[k][0].mape == (None if mape is None else pytest.approx(mape, rel=1e-6))


@pytest.mark.parametrize(("n", "want"), [(5, None), (6, 0), (10, 0), (11, 2), (20, 3)])
def test_series_gate(spark, n, want):
    df = spark.range(n).select(F.lit("s").alias("k"))
    assert [r.n_test for r in forecast.series_gate(df, ["k"]).collect()] == ([] if want is None else [want])


def test_forecast_groups_and_band(spark):
    months = [(1, 1, True, 202000 + 100 * (i // 12) + i % 12 + 1, 100.0 + i + 10 * math.sin(i * math.pi / 6)) for i in range(36)]
    df = spark.createDataFrame([*months, (2, 1, True, 202001, 1.0)], "product_key long, partner_key long, flow_type boolean, time_key int, y double")
    out = forecast.forecast_groups(df, forecast.SERIES).orderBy("time_key").collect()
    assert len(out) == 12 and out[0].time_key == 202301 and all(r.lower <= r.upper for r in out)
    assert abs(out[0].point - 136) < 3


def test_clean_forecast_view_orders_the_band(spark):
    keys = "time_key int, product_key long, partner_key long, flow_type boolean"
    fact = spark.createDataFrame([(202501, 1, 1, True, 3.0), (202501, 9, 1, True, 3.0)], keys + ", value_vnd double")
    fc = spark.createDataFrame([(202502, 1, 1, True, -5.0, -9.0, 3.0), (202503, 1, 1, True, 50.0, 40.0, 60.0), (202502, 2, 1, True, 5.0, 6.0, 4.0)], keys + ", forecast_value double, lower_bound double, upper_bound double")
    got = {(r.time_key, r.product_key): (r.actual_value, r.forecast_value, r.lower_bound, r.upper_bound) for r in forecast.clean_forecast_view(fact, fc).collect()}
    assert got == {(202501, 1): (3.0, None, None, None), (202502, 1): (None, 0.0, 0.0, 3.0), (202503, 1): (None, 9.0, 9.0, 9.0), (202502, 2): (None, 5.0, 5.0, 5.0)}


def test_horizon_anchor(spark):
    anchors = spark.createDataFrame([(D(2026, 5, 31), D(2026, 5, 1))], ["as_of", "last_month"])
    c = features.horizon_calendar(anchors, "2026-07-01", 1, 2)
    got = {(r.kind, r.i): (r.k, r.target) for r in c.collect()}
    assert got["balance", 1] == (2, D(2026, 7, 1)) and got["balance", 2] == (3, D(2026, 8, 1)) and got["fx", 1] == (1, D(2026, 6, 1))


def test_persistence_and_skip(spark):
    df = spark.createDataFrame([(3, 1.0, 9.0), (4, 1.0, 9.0)], ["n_labelled", "prediction", "last_value"])
    assert [r.prediction for r in features.persistence_fallback(df).orderBy("n_labelled").collect()] == [9.0, 1.0]
    with pytest.raises(features.SkipJob):
        features.require_history(df, 3)


def test_country_names(spark):
    ref = spark.createDataFrame([("MMR", "Myanmar", "Asia", "Asia"), ("JPN", "Japan", "Asia", "Asia")], ["iso3", "name", "region", "continent"])
    alias = spark.createDataFrame([("MYANMA", "Myanmar")], ["alias", "name"])
    names = spark.createDataFrame([("Myanma",), ("japan",), ("Japam",), ("Atlantis",), (None,), (" ",)], ["name"])
    got = {r.name: (r.iso3, r.how) for r in match.resolve_country_by_name(names, ref, alias).collect()}
    assert got == {"Myanma": ("MMR", "alias"), "japan": ("JPN", "exact"), "Japam": ("JPN", "fuzzy"), "Atlantis": (None, "unresolved")}


def test_codes_are_inferred_in_order(spark):
    corpus = spark.createDataFrame([("090111", "coffee beans not roasted"), ("030617", "frozen shrimps")], ["doc_id", "text"])
    df = spark.createDataFrame([("Fresh FISH", ""), ("roasted coffee beans", None), ("zzz", ""), ("kept", "0101")], "name string, code string")
    out = {r.name: r.code for r in match.infer_codes(df, "code", "name", "code", [("fish", "030399")], corpus).collect()}
    assert out == {"Fresh FISH": "030399", "roasted coffee beans": "090111", "zzz": None, "kept": "0101"}


def test_most_frequent_ties_to_the_smallest(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", None), ("e", None)], "k string, v string")
    assert rows(R.most_frequent(df, "k", ["v"]), "k") == [("e", None), ("k", "a")]


def test_clean_forecast_view_is_what_joins_give_and_joins_nothing(spark):
    """Nulls in keys, several forecasts of a month, months without either; the plan deals the rows by series and has no join."""
    keys = "time_key int, product_key long, partner_key long, flow_type boolean"
    rnd = random.Random(7)
    key = lambda: (rnd.choice([202501, 202502, 202503, None]), rnd.choice([1, 2, 3, None]), rnd.choice([1, 2]), rnd.choice([True, False, None]))
    value = lambda: rnd.choice([None, -5.0, 0.0, 1.0, 7.0, 40.0])
    fact = spark.createDataFrame([(*key(), rnd.choice([None, Decimal("1.50"), Decimal("4.00"), Decimal("-2.25")])) for _ in range(150)], keys + ", value_vnd decimal(38,2)")
    fc = spark.createDataFrame([(*key(), value(), value(), value()) for _ in range(40)], keys + ", forecast_value double, lower_bound double, upper_bound double").where("product_key is null or product_key < 3")
    capped = fc.join(forecast.series_cap(fact, forecast.SERIES), forecast.SERIES, "left").withColumn("p", F.expr("greatest(least(forecast_value, cap), 0.0d)"))
    shown = capped.select("time_key", *forecast.SERIES, F.col("p").alias("forecast_value"), F.expr("least(greatest(least(lower_bound, cap), 0.0d), p)").alias("lower_bound"), F.expr("greatest(least(upper_bound, cap), p)").alias("upper_bound"))
    actual = R.restrict_to_panel(fact, fc, forecast.SERIES).groupBy("time_key", *forecast.SERIES).agg(F.sum("value_vnd").cast("double").alias("actual_value"))
    want = R.actual_vs_forecast(actual, shown, ["time_key", *forecast.SERIES])
    got = forecast.clean_forecast_view(fact, fc)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(rows(got), key=str) == sorted(rows(want), key=str)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
