"""The risk queries fit every horizon with the operator's own number of trees."""

import os
from datetime import date as D

import pytest

from tradelake import queries
from tradelake.operators import features as operator

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


class Asked(Exception):
    pass


@pytest.mark.parametrize(("name", "last"), [("train_horizons", 30), ("risk_report_data", 30), ("train_balance_horizons", 12)])
def test_all_horizons_are_asked_for(spark, monkeypatch, name, last):
    def train(features, columns, source, keys, order, horizons, trees=200, depth=4, rate=0.1, level=None):
        raise Asked(list(horizons), trees)

    monkeypatch.setattr(queries.features, "train_horizons", train)
    with pytest.raises(Asked) as asked:
        queries.QUERIES[name](spark, DATA)
    assert asked.value.args == (list(range(1, last + 1)), 200)


def test_predictions_and_errors_of_a_panel(spark):
    """Two series, one of them too short for its longest horizon, which falls back to its last value."""
    rows = [(k, t, float(t % 5 + 10 * k), float(100 + t)) for k, n in ((1, 60), (2, 8)) for t in range(n)]
    df = spark.createDataFrame(rows, "k int, t int, x double, rate double")
    out = {(r.k, r.horizon): r for r in operator.train_horizons(df, ["x"], "x", ["k"], "t", [1, 6], trees=8, depth=2, level="rate").collect()}
    assert {key: r.n_labelled for key, r in out.items()} == {(1, 1): 59, (1, 6): 54, (2, 1): 7, (2, 6): 2}
    assert out[2, 6].prediction == out[2, 6].last_value == 22.0 and out[1, 1].rate == 159.0 and out[1, 1].as_of == 59
    test = [x for k, n in ((1, 60), (2, 8)) for x in [float((t + 1) % 5 + 10 * k) for t in range(n - 1)][int((n - 1) * 0.8) :]]
    assert out[1, 1].naive_mae == pytest.approx(sum(test) / len(test)) and out[1, 1].mae < 3


def test_report_has_a_row_for_each_target(spark):
    pred = spark.createDataFrame([("VND", D(2025, 1, 10), 1, 0.1, 200.0), ("VND", D(2025, 1, 10), 2, -0.05, 200.0)], "base_currency string, as_of date, horizon int, prediction double, rate double")
    low = spark.createDataFrame([("VND", 0.08)], "base_currency string, threshold double")
    flagged = operator.fx_targets(operator.risk_flags(pred, low, True, ["base_currency"]))
    got = sorted((r.target_date, r.predicted_rate, r.high_risk, r.as_of_rate) for r in operator.risk_report_data(flagged, ["base_currency"]).collect())
    assert got == [(D(2025, 1, 11), pytest.approx(220.0), True, 200.0), (D(2025, 1, 12), pytest.approx(190.0), False, 200.0)]
