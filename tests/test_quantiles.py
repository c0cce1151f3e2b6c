"""Quantile forecasts refitted at every day."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from farescope.operators import quantiles
from farescope.operators.trees import Forest, Layout

KEYS = ["airline", "origin"]
SCHEMA = "airline string, origin string, report_day date, value double, x double, z double"


def made(days=45, series=12):
    """Values that follow x, with noise that grows with z."""
    out = []
    for s in range(series):
        r = random.Random(s)
        for d in range(days):
            x, z = r.choice([0.0, 5.0, 10.0]), r.choice([1.0, 4.0])
            out.append((f"A{s % 4}", None if s == 3 else f"R{s}", date(2024, 1, 1) + timedelta(days=d), 50 + x * 3 + r.gauss(0, 1) * z,
                        None if r.random() < 0.05 else x, z))
    return out


@pytest.fixture(scope="module")
def forecast(spark):
    df = spark.createDataFrame(made(), SCHEMA)
    return quantiles.quantile_forecast(df, "value", ["x", "z"], keys=KEYS, trees=10).collect()


def test_every_day_is_a_cutoff(forecast):
    assert len(forecast) == 45 * 12
    for r in forecast:
        first = date(2024, 1, 1)
        if r["report_day"] == first:
            assert r["trained_before"] is None and r["pred_gbt_q50"] is None
        else:
            # The model of a row has seen the days before it, and no prediction comes before the third value of a series.
            assert r["trained_before"] == r["report_day"]
            assert (r["pred_gbt_q10"] is None) == ((r["report_day"] - first).days < 3)


def test_coverage_of_held_out_days(forecast):
    late = [r for r in forecast if r["report_day"] >= date(2024, 1, 20)]
    below = {q: np.mean([r["value"] < r[f"pred_gbt_q{q}"] for r in late]) for q in (10, 50, 90)}
    assert 0.05 <= below[10] <= 0.2 and 0.4 <= below[50] <= 0.6 and 0.8 <= below[90] <= 0.95
    # The range follows the noise, the middle follows the feature.
    wide = {z: np.mean([r["pred_gbt_q90"] - r["pred_gbt_q10"] for r in late if r["z"] == z]) for z in (1.0, 4.0)}
    assert wide[4.0] > 2 * wide[1.0]
    assert np.mean([abs(r["pred_gbt_q50"] - 50 - 3 * r["x"]) for r in late if r["x"] is not None]) < 3


def test_rounds_of_cutoffs_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame(made(12, 5), SCHEMA)
    shown = lambda: sorted(map(tuple, quantiles.quantile_forecast(df, "value", ["x", "z"], keys=KEYS, trees=3).collect()), key=str)
    whole = shown()
    monkeypatch.setattr(quantiles, "SUM_BYTES", 3 * 8 * 8 * quantiles.Sketch(1.0).cells * 2)
    parts = shown()
    assert len(whole) == 60 and [r[:6] for r in whole] == [r[:6] for r in parts]
    assert all(a == pytest.approx(b) for a, b in zip([r[7:] for r in whole], [r[7:] for r in parts]) if None not in a)


def test_cutoffs_can_be_given(spark):
    df = spark.createDataFrame(made(12, 5), SCHEMA)
    got = quantiles.quantile_forecast(df, "value", ["x"], [date(2024, 1, 6), date(2024, 1, 10)], keys=KEYS, trees=2, quantiles=[0.5]).collect()
    want = {1: None, 5: None, 6: date(2024, 1, 6), 9: date(2024, 1, 6), 10: date(2024, 1, 10), 12: date(2024, 1, 10)}
    assert {r["report_day"].day: r["trained_before"] for r in got if r["report_day"].day in want} == want
    assert quantiles.quantile_forecast(df.limit(0), "value", ["x"], keys=KEYS).count() == 0


def test_start_is_the_weighted_quantile_and_one_split_is_the_best(spark):
    """One tree of depth one against trying every border, with the weights of a series and exact quantiles."""
    df = spark.createDataFrame([r for r in made(30, 1)], SCHEMA)
    got = quantiles.quantile_forecast(df, "value", ["x"], [date(2024, 1, 25)], keys=KEYS, trees=1, depth=1, rate=1.0, least=2, quantiles=[0.8])
    rows = sorted(made(30, 1), key=lambda r: r[2])
    past = [r for r in rows if r[2] < date(2024, 1, 25)]
    y, w = np.array([r[3] for r in past]), 0.5 + 0.5 * np.arange(len(past)) / (len(past) - 1)
    x = np.array([np.nan if r[4] is None else r[4] for r in past])
    middle = sorted(x[~np.isnan(x)])[(int((~np.isnan(x)).sum()) - 1) // 2]
    x = np.where(np.isnan(x), middle, x)

    def quantile(v, weight):
        order = np.argsort(v)
        return v[order][np.searchsorted(np.cumsum(weight[order]), 0.8 * weight.sum())]

    start = quantile(y, w)
    slope = w * (0.8 - (y < start))
    best = max(((slope[x <= e].sum() ** 2 / w[x <= e].sum() + slope[x > e].sum() ** 2 / w[x > e].sum(), -e) for e in (0.0, 5.0)))
    leaf = {side: start + quantile((y - start)[(x <= -best[1]) == side], w[(x <= -best[1]) == side]) for side in (True, False)}
    for r in got.where("trained_before IS NOT NULL").collect():
        mine = middle if r["x"] is None else r["x"]
        assert r["pred_gbt_q80"] == pytest.approx(leaf[mine <= -best[1]], rel=0.03)


def test_sketch_is_within_its_width():
    r = np.random.default_rng(1)
    values = np.concatenate((r.normal(0, 100, 4000), np.zeros(50), r.normal(0, 0.5, 900)))
    sketch = quantiles.Sketch(500.0)
    counts = np.bincount(sketch.cell(values[:2000]), minlength=sketch.cells) + np.bincount(sketch.cell(values[2000:]), minlength=sketch.cells)
    for q in (0.01, 0.1, 0.5, 0.9, 0.99):
        exact = np.sort(values)[int(np.ceil(q * len(values))) - 1]
        assert sketch.quantile(counts.astype(float), q) == pytest.approx(exact, rel=quantiles.WIDTH, abs=500 * quantiles.SMALL * 2)


def test_medians_before_each_cutoff(spark):
    rows = [(1.0, d, [d % 4, -1 if d < 3 else d % 2]) for d in range(10)] + [(None, 0, [3, 1])]
    df = spark.createDataFrame(rows, "y double, __day int, __cells array<short>")
    got = quantiles.medians(df, Layout(np.array([4, 2]), np.array([True, True])), 9)
    for c in range(9):
        for j in range(2):
            seen = sorted(cells[j] for y, d, cells in rows if y is not None and d <= c and cells[j] >= 0)
            assert got[c, j] == (seen[(len(seen) - 1) // 2] if seen else 0)


def test_forest_numbers():
    forest = Forest.of([3, 5])
    forest.apply([{"model": 5, "node": 0, "column": 1, "cell": 2, "left": [3, 2.0, 4.0], "right": [1, 1.0, 5.0]},
                  {"model": 3, "node": 0, "column": -1, "cell": -1, "left": [4, 4.0, 2.0], "right": [1.0, 1.0]}])
    assert forest.frontier == {5: [1, 2]} and forest.trees[5].value == [0.0, 2.0, 5.0] and forest.trees[3].value == [0.5]
    assert forest.trees[5].walk(np.array([[0, 2], [0, 3]]), np.array([True, True])).tolist() == [1, 2]
