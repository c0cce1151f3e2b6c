"""Fitted models against closed forms and plain optimisation in numpy."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from farescope.operators import models
from farescope.operators.models import FeatureSet

SCHEMA = """flight_key string, probe_join_id string, adt_count int, observed_at_utc timestamp_ntz, a double, b double, kind string,
    y_next_search_lowest_fare_delta double, y_next_search_price_move_class string"""
FEATURES = FeatureSet(numeric=["a", "b"], categorical=["kind"])


def made(n=400):
    r, out = random.Random(4), []
    for i in range(n):
        a, b, kind = (None if r.random() < 0.1 else round(r.gauss(5, 3), 3)), float(r.randint(0, 4)), r.choice(["x", "x", "y", "z", None])
        y = 2 * (a or 5) - 3 * b + {"x": 0, "y": 4, "z": -4, None: 0}[kind] + r.gauss(0, 2)
        move = "up" if y > 6 else "down" if y < 0 else "same"
        out.append((f"f{i}", f"p{i}", 1, datetime(2024, 1, 1) + timedelta(hours=i), a, b, kind, y, move))
    return out


@pytest.fixture(scope="module")
def states(spark):
    return spark.createDataFrame(made(), SCHEMA)


def matrices():
    """Training and test rows as filled, scaled and one-hot columns: median and mode of the training rows, sample spread, known values."""
    rows = made()
    train, test = rows[:320], rows[320:]
    a = sorted(r[4] for r in train if r[4] is not None)
    middle, mode = a[(len(a) - 1) // 2], "x"

    def plain(part):
        numbers = np.array([[middle if r[4] is None else r[4], r[5]] for r in part])
        hot = np.array([[float((r[6] or mode) == v) for v in "xyz"] for r in part])
        return numbers, hot

    numbers, hot = plain(train)
    spread = numbers.std(axis=0, ddof=1)
    other, other_hot = plain(test)
    return np.column_stack((numbers / spread, hot)), np.column_stack((other / spread, other_hot)), train, test


def test_delta_regressor_is_closed_form_ridge(states):
    x, z, train, test = matrices()
    y, want = np.array([r[7] for r in train]), np.array([r[7] for r in test])
    center, goal = x.mean(axis=0), y.mean()
    w = np.linalg.solve((x - center).T @ (x - center) + 2.5 * np.eye(x.shape[1]), (x - center).T @ (y - goal))
    error = want - ((z - center) @ w + goal)
    got = {r["model"]: r for r in models.delta_regressor(states, FEATURES, alpha=2.5)["metrics"].collect()}
    assert got["ridge"]["rows"] == 80
    assert (got["ridge"]["mae"], got["ridge"]["rmse"], got["ridge"]["median_ae"]) == pytest.approx(
        (np.abs(error).mean(), np.sqrt((error**2).mean()), np.median(np.abs(error))), rel=1e-4)
    assert got["ridge"]["r2"] == pytest.approx(1 - (error**2).sum() / ((want - want.mean()) ** 2).sum(), rel=1e-4)
    assert got["median"]["mae"] == pytest.approx(np.abs(want - np.median(y)).mean())


def test_move_classifier_is_plain_softmax_regression(states):
    x, z, train, test = matrices()
    names = ["down", "same", "up"]
    target = np.array([[float(r[8] == c) for c in names] for r in train])
    n, one = len(x), np.column_stack((x, np.ones(len(x))))
    w = np.zeros((one.shape[1], 3))
    penalty = np.full((one.shape[1], 1), 1.0)
    penalty[-1] = 0
    for _ in range(60):  # Newton steps on the summed loss and half the squared weights
        logits = one @ w
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = (one.T @ (p - target) + penalty * w).ravel()
        hessian = np.zeros((one.shape[1] * 3,) * 2)
        for i in range(3):
            for j in range(3):
                part = one.T @ (one * (p[:, i] * ((i == j) - p[:, j]))[:, None]) + (i == j) * np.diag(penalty[:, 0])
                hessian[i::3, j::3] = part
        w = w - np.linalg.lstsq(hessian, grad, rcond=1e-10)[0].reshape(w.shape)
    guess = [names[k] for k in (np.column_stack((z, np.ones(len(z)))) @ w).argmax(axis=1)]
    actual = [r[8] for r in test]
    result = models.move_classifier(states, FEATURES)
    got = {r["model"]: r for r in result["metrics"].collect()}
    recall = {c: np.mean([g == c for g, a in zip(guess, actual) if a == c]) for c in set(actual)}
    f1 = [2 * sum(g == a == c for g, a in zip(guess, actual)) / (guess.count(c) + actual.count(c)) for c in set(actual) | set(guess)]
    assert got["logistic"]["rows"] == n - 240
    assert got["logistic"]["accuracy"] == pytest.approx(np.mean([g == a for g, a in zip(guess, actual)]), abs=1 / 80 + 1e-9)
    assert got["logistic"]["balanced_accuracy"] == pytest.approx(np.mean(list(recall.values())), abs=0.03)
    assert got["logistic"]["macro_f1"] == pytest.approx(np.mean(f1), abs=0.03)
    weights = dict(result["top_features"])
    mean = np.abs(w[:-1]).mean(axis=0)
    assert len(weights) == x.shape[1] and sorted(weights.values(), reverse=True)[0] == pytest.approx(
        np.abs(w[:-1] - w[:-1].mean(axis=1, keepdims=True)).mean(axis=1).max(), rel=0.05) and len(mean) == 3


def test_two_stage_with_isotonic_forest(states):
    params = models.TwoStageParams(min_move_delta=2.0, trees=5, trees_b=5, max_depth=4, calibration="isotonic", stage_b="rf")
    result = models.two_stage(states, FEATURES, params)
    got = {r["model"]: r for r in result["combined"].collect()}
    assert set(got) == {"two_stage", "zero", "median_all", "oracle_stage_a"} and got["two_stage"]["rmse"] < got["zero"]["rmse"]
    assert all(0 <= r["p_move"] <= 1 for r in result["scored"].collect())


def test_feature_matrix_kinds(spark):
    df = spark.createDataFrame([("c1", 1, 0.5, True, "t", None, 3.0), ("c2", 0, 1.5, None, "u", None, 4.0)],
                               "cycle_id string, flag int, x double, yes boolean, word string, gone string, y_target double")
    rows, found = models.feature_matrix(df)
    assert (found.numeric, found.categorical, found.boolean, found.dropped) == (["flag", "x", "yes"], ["word"], ["flag", "yes"], ["gone"])
    assert dict(rows.dtypes) == {"cycle_id": "string", "word": "string", "y_target": "double", "flag": "double", "x": "double", "yes": "double"}
