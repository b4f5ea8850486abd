"""Boosted trees of many targets against a plain booster that grows one tree after another."""

import numpy as np
import pytest

from tradelake.operators import boosting


def plain(x, edges, y, train, trees, depth, rate, smooth):
    """Predictions of all rows by a booster for one target, node by node."""
    bins = np.array([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)]).T
    own = train & ~np.isnan(y)
    f = np.full(len(y), y[own].mean() if own.any() else 0.0)
    score = lambda s, n: s * s / (n + smooth)

    def grow(rows, level):
        mine = rows[own[rows]]
        g, n = (y - f)[mine].sum(), len(mine)
        best = (boosting.LEAST_GAIN, None)
        if level < depth and n:
            for j in range(bins.shape[1]):
                for b in range(max(map(len, edges)) + 1):
                    left = mine[bins[mine, j] <= b]
                    if 0 < len(left) < n:
                        a = (y - f)[left].sum()
                        gain = score(a, len(left)) + score(g - a, n - len(left)) - score(g, n)
                        if gain > best[0] + 1e-12:
                            best = (gain, (j, b))
        if best[1] is None:
            step[rows] = rate * g / (n + smooth)
            return
        j, b = best[1]
        grow(rows[bins[rows, j] <= b], level + 1)
        grow(rows[bins[rows, j] > b], level + 1)

    for _ in range(trees if own.any() else 0):
        step = np.zeros(len(y))
        grow(np.arange(len(y)), 0)
        f = f + step
    return f


@pytest.mark.parametrize("tasks", [1, 5])
def test_equal_to_a_plain_booster(spark, monkeypatch, tasks):
    monkeypatch.setattr(boosting, "CHECKPOINT_TREES", 3)
    if tasks > 1:
        monkeypatch.setattr(boosting, "TASK_CELLS", 60)
        monkeypatch.setattr(boosting, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    n = 120
    x = np.column_stack([rng.integers(0, 9, n), rng.integers(0, 4, n), rng.normal(size=n).round(3)]).astype(float)
    ys = [x[:, 0] * 2 + (x[:, 1] > 1) * 5 + rng.normal(size=n).round(3), x[:, 2] * x[:, 0], np.full(n, np.nan), rng.normal(size=n)]
    ys[1][::7] = np.nan
    marks = [np.arange(n) < 90, np.arange(n) % 4 > 0, np.ones(n, bool), np.zeros(n, bool)]
    rows = [(i, *map(float, x[i]), *[None if np.isnan(y[i]) else float(y[i]) for y in ys], *[bool(m[i]) for m in marks]) for i in range(n)]
    names = ["i", "a", "b", "c", *[f"y{k}" for k in range(4)], *[f"t{k}" for k in range(4)]]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c == 'i' else 'boolean' if c[0] == 't' else 'double'}" for c in names))
    model, errors = boosting.fit(df, ["a", "b", "c"], names[4:8], names[8:], trees=7, depth=3, rate=0.3, bins=16)
    got = {r.i: r for r in boosting.predict(df.select("i", "a", "b", "c"), ["a", "b", "c"], model, [f"p{k}" for k in range(4)]).collect()}
    for k in range(4):
        want = plain(x, model.edges, ys[k], marks[k], 7, 3, 0.3, 1.0)
        assert np.allclose([got[i][f"p{k}"] for i in range(n)], want)
        e = (ys[k] - want)[~marks[k] & ~np.isnan(ys[k])]
        assert np.allclose(errors[:, k], [np.abs(e).sum(), (e * e).sum(), len(e)])
    assert len(model.edges[0]) >= 7 and np.ptp([got[i].p0 for i in range(n)]) > 5


def test_nothing_to_fit(spark):
    df = spark.createDataFrame([], "a double, y double, t boolean")
    model, errors = boosting.fit(df, ["a"], ["y"], ["t"], trees=3, depth=2)
    assert not errors.any() and (model.feature == -1).all()
