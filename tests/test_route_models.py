"""Models of all routes and folds in one pass, against plain fits of each of them."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from farescope.functions import scan
from farescope.operators import models, route_models, trees
from farescope.operators.models import FeatureSet
from farescope.operators.route_models import RouteParams

SCHEMA = """route_key string, flight_key string, probe_join_id string, adt_count int, observed_at_utc timestamp_ntz, a double, b double, gone double,
    kind string, code string, y_next_search_lowest_fare_delta double"""
FEATURES = FeatureSet(numeric=["a", "b", "gone"], categorical=["kind", "code"])


def made(route, n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a, b = (None if r.random() < 0.1 else round(r.gauss(3, 2), 2)), r.choice([0.0, 1.0, 5.0, 5.5])
        kind, code = r.choice(["x", "x", "y", None]), r.choice("pqrs")
        move = (a or 2.9) * 2 + (3 if kind == "y" else 0) - b + r.gauss(0, 0.5)
        y = None if r.random() < 0.05 else move if (b < 5) == (r.random() < 0.9) else 0.0
        t = None if r.random() < 0.02 else datetime(2024, 1, 1) + timedelta(hours=i // 3)
        out.append((route, f"f{i % 7}", f"p{i}", 1, t, a, b, None, kind, code, y))
    return out


@pytest.fixture(scope="module")
def states(spark):
    rows = [row for k, (route, n) in enumerate((("R1", 400), ("R2", 230), ("R3", 60), ("R4", 500))) for row in made(route, n, k)]
    return spark.createDataFrame(rows + [(None, *rows[0][1:])], SCHEMA)


def params(**other):
    return RouteParams(**{"folds": 3, "min_move_delta": 1.0, "trees": 4, "trees_b": 3, "max_depth": 4, "min_stage_b_moves": 20, **other})


def segments_of(states, p):
    return [r.asDict() for r in route_models.segments(states, FEATURES, p).collect()]


def plain_segments(rows, p):
    """Segments and sides of the rows of one route, in time order, rows without a time last."""
    order = sorted(rows, key=lambda r: (r[4] is None, r[4] or datetime.max, r[1], r[2]))
    n, size = len(rows), len(rows) // (p.folds + 1)
    start = n - p.folds * size
    seg = [0 if i < start else (i - start) // size + 1 for i in range(n)] if n >= 20 * (p.folds + 1) else [-1] * n
    dated = [i for i, r in enumerate(order) if r[-1] is not None and r[4] is not None]
    train = max(1, len(dated) - max(1, int(len(dated) * p.test_fraction)))
    late = {i: k >= train for k, i in enumerate(dated)}
    return [(r, seg[i], late.get(i)) for i, r in enumerate(order) if r[-1] is not None]


def test_prefix_sums_of_one_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, "hot").when(F.col("id") < 2990, F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), "id",
                                  F.pmod(F.xxhash64("id"), F.lit(1000)).alias("t"))
    got = scan.prefix_sums(df, ["k"], ["t", "id"], {"upto": F.col("id"), "n": F.lit(1)}, {"upto": "all"})
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "id", "t", F.sum("id").over(w).alias("upto"), F.count("*").over(w).alias("n"), F.sum("id").over(Window.partitionBy("k")).alias("all"))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    ranges = scan.ranged(df, ["k"], ["t", "id"]).where("k = 'hot'").groupBy("__part").count().collect()
    assert len(ranges) > 4 and max(r["count"] for r in ranges) < 1000
    placed = scan.places(df, ["k"], ["t", "id"]).where("k = 'hot'")
    assert placed.agg(F.min("place"), F.max("place"), F.max("size"), F.countDistinct("place")).first()[:] == (0, 2499, 2500, 2500)
    assert scan.prefix_sums(df.limit(0), ["k"], ["t"], {"n": F.lit(1)}).count() == 0


def test_segments_follow_time(states):
    p = params()
    got = segments_of(states, p)
    for k, (route, n) in enumerate((("R1", 400), ("R2", 230), ("R3", 60), ("R4", 500))):
        want = plain_segments(made(route, n, k), p)
        mine = [r for r in got if r["route_key"] == route]
        key = lambda y, x, c, seg, late: (y, str(x), str(c), seg, late)
        assert sorted((key(r["y"], r["x"], r["c"], r["seg"], r["late"]) for r in mine), key=str) == sorted(
            (key(r[-1], [r[5], r[6], r[7]], [r[8], r[9]], seg, late) for r, seg, late in want), key=str)
    assert {r["route_key"] for r in got} == {"R1", "R2", "R3", "R4"}


def side(rows, fold, test=False):
    if fold == 0:
        return [r for r, _, late in rows if late is test]
    return [r for r, seg, _ in rows if (seg == fold if test else 0 <= seg < fold)]


def lower_median(values):
    values = sorted(values)
    return values[(len(values) - 1) // 2] if values else None


def plain_ridge(train, test, p):
    """Predictions of ridge over filled, scaled and one-hot rows, by least squares."""
    moved = [r for r in train if abs(r[-1]) >= p.min_move_delta]
    medians = [lower_median([r[c] for r in moved if r[c] is not None]) for c in (5, 6, 7)]
    values = [sorted({r[c] for r in moved if r[c] is not None}) for c in (8, 9)]
    modes = [max(v, key=lambda x: (sum(r[c] == x for r in moved), [-ord(ch) for ch in x])) for c, v in zip((8, 9), values)]

    def matrix(rows):
        numbers = np.array([[r[c] if r[c] is not None else m for c, m in zip((5, 6, 7), medians) if m is not None] for r in rows], float)
        hot = np.array([[float((r[c] if r[c] is not None else mode) == v) for c, mode, vs in zip((8, 9), modes, values) for v in vs] for r in rows])
        return numbers, hot

    numbers, hot = matrix(moved)
    spread = numbers.std(axis=0)
    x, y = np.column_stack((numbers / spread, hot)), np.array([r[-1] for r in moved])
    center, goal = x.mean(axis=0), y.mean()
    wide = np.vstack((x - center, np.sqrt(p.alpha) * np.eye(x.shape[1])))
    w = np.linalg.lstsq(wide, np.append(y - goal, np.zeros(x.shape[1])), rcond=None)[0]
    numbers, hot = matrix(test)
    return (np.column_stack((numbers / spread, hot)) - center) @ w + goal


def test_ridge_of_all_folds_from_one_pass(states):
    p = params()
    gate, scores = route_models.route_scores(states, FEATURES, p)
    got = {}
    for r in scores.collect():
        got.setdefault((r["route_key"], r["fold"]), []).append((r["y"], r["pred_delta"]))
    fitted = {(r["route_key"], r["fold"]) for r in gate.where("reason IS NULL").collect()}
    assert fitted == set(got) and {("R1", f) for f in range(4)} <= fitted and not any(r == "R3" for r, _ in fitted)
    for k, (route, n) in enumerate((("R1", 400), ("R2", 230), ("R4", 500))):
        rows = plain_segments(made(route, n, (0, 1, 3)[k]), p)
        for fold in range(4):
            if (route, fold) in fitted:
                test = side(rows, fold, True)
                want = sorted(zip([r[-1] for r in test], plain_ridge(side(rows, fold), test, p)))
                assert np.array(sorted(got[route, fold])) == pytest.approx(np.array(want), abs=1e-6)


def test_gates_tell_why(states):
    p = params(min_test_moves=3)
    got = {(r["route_key"], r["fold"]): r for r in route_models.gates(route_models.segments(states, FEATURES, p), p).collect()}
    assert got["R3", 0]["reason"] == "Insufficient labeled rows for two-stage regression" and ("R3", 1) not in got
    for k, (route, n) in enumerate((("R1", 400), ("R2", 230), ("R4", 500))):
        rows = plain_segments(made(route, n, (0, 1, 3)[k]), p)
        for fold in range(4):
            train, test = side(rows, fold), side(rows, fold, True)
            moves = lambda rs: sum(abs(r[-1]) >= 1 for r in rs)
            assert [got[route, fold][c] for c in ("train", "test", "train_moves", "test_moves")] == [len(train), len(test), moves(train), moves(test)]


def plain_tree(cells, ordered, drawn, y, depth, least):
    """Leaf value of each row of a regression tree over drawn rows, by trying every split."""
    out = np.empty(len(cells))

    def grow(rows, left):
        n, s = drawn[rows].sum(), (drawn[rows] * y[rows]).sum()
        best = None
        if left:
            for j in range(cells.shape[1]):
                for cell in range(cells[:, j].max() + 1):
                    go = cells[rows, j] <= cell if ordered[j] else cells[rows, j] == cell
                    a, b = rows[go], rows[~go]
                    na, nb = drawn[a].sum(), drawn[b].sum()
                    if na >= least and nb >= least:
                        gain = (drawn[a] @ y[a]) ** 2 / na + (drawn[b] @ y[b]) ** 2 / nb - s * s / n
                        if gain > 1e-9 * max(abs(s), 1e-12) and (best is None or gain > best[0] + 1e-7):
                            best = (gain, a, b)
        if best is None:
            out[rows] = s / n if n else 0.0
        else:
            grow(best[1], left - 1)
            grow(best[2], left - 1)

    grow(np.arange(len(cells)), depth)
    return out


def test_regression_forest_equals_plain_trees(states, spark):
    p = params(stage_b="rf", trees=1, max_depth=3, folds=0)
    rows = route_models.segments(states.where("route_key = 'R1'"), FEATURES, p)
    profile = route_models.profiles(rows, 3, 2, p)
    found = spark.sparkContext.broadcast(profile)
    cells = route_models.encoded(rows, found, 3)
    second = route_models.Models([("R1", 0)], p, "b")
    forest = route_models.grown(cells, found, second, 3)
    got = [r for r in cells.collect() if r["late"] is False and r["moved"]]
    mine = profile["R1"]
    full = mine.filled(np.array([r["cells"] for r in got], np.int16), 0, "b").astype(int)
    y, h = np.array([r["y"] for r in got]), np.array([r["h"] for r in got])
    for m in range(p.trees_b):
        tree = forest.trees[m]
        want = plain_tree(full, mine.layout.ordered, trees.bootstrap(h, second.seed(m)), y, 3, p.min_leaf)
        assert np.array(tree.value)[tree.walk(full, mine.layout.ordered)] == pytest.approx(want, abs=1e-9)


def test_all_routes_at_once_equal_each_alone(states, monkeypatch):
    p = params(calibration="isotonic")
    names = ["route_key", "fold", "y", "p_move", "pred_delta"]
    shown = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(names).collect())
    every = shown(route_models.route_scores(states, FEATURES, p)[1])
    alone = [row for route in ("R1", "R2", "R3", "R4") for row in shown(route_models.route_scores(states.where(F.col("route_key") == route).repartition(3), FEATURES, p)[1])]
    assert every == sorted(alone)
    assert all(0 <= r[3] <= 1 for r in every) and len({r[3] for r in every}) > 10
    monkeypatch.setattr(route_models, "MODEL_BYTES", 1)  # a round for each route
    assert shown(route_models.route_scores(states, FEATURES, p)[1]) == every


def test_jobs_do_not_grow_with_routes(states, spark):
    def jobs(df, group):
        spark.sparkContext.setJobGroup(group, group)
        route_models.route_reports(df, FEATURES, params(trees=2, max_depth=2)).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    one, many = jobs(states.where("route_key = 'R1'"), "one-route"), jobs(states, "all-routes")
    assert 0 < many <= one + 3


def test_forest_tells_moves_and_calibration_helps(states):
    scores = {c: route_models.route_scores(states, FEATURES, params(trees=15, calibration=c))[1].where("fold = 0") for c in ("none", "sigmoid", "isotonic")}
    losses = {c: df.agg(F.avg((F.col("p_move") - F.col("moved").cast("int")) ** 2)).first()[0] for c, df in scores.items()}
    rate = scores["none"].agg(F.avg(F.col("moved").cast("double"))).first()[0]
    assert all(loss < 0.8 * rate * (1 - rate) for loss in losses.values())
    assert min(losses["sigmoid"], losses["isotonic"]) <= losses["none"] * 1.05


def test_sweep_of_many_models_equals_the_sweep_of_one(states):
    scores = route_models.route_scores(states, FEATURES, params())[1]
    keys = ["route_key", "fold"]
    got = {(r["route_key"], r["fold"], r["threshold"]): r for r in route_models.swept(scores, keys).collect()}
    one = scores.where("route_key = 'R4' AND fold = 2").withColumn("moved", F.col("moved").cast("double"))
    for r in models.threshold_sweep(one).collect():
        mine = got["R4", 2, r["threshold"]]
        assert (mine["predicted_move_count"], mine["actual_move_count"]) == (r["predicted_move_count"], r["actual_move_count"])
        assert (mine["rmse"], mine["mae"]) == pytest.approx((r["rmse"], r["mae"]))
    zero = models.regression_metrics(one.select(F.lit("zero").alias("model"), "y", F.lit(0.0).alias("predicted")))
    best = {r["metric"]: r for r in models.best_thresholds(models.threshold_sweep(one), zero).collect()}
    mine = route_models.beaten(route_models.swept(scores, keys), keys).where("route_key = 'R4' AND fold = 2").first()
    for m in ("rmse", "mae"):
        assert (mine[f"best_{m}"], mine[f"zero_{m}"], mine[f"beats_zero_{m}"]) == (
            pytest.approx(best[m]["best_value"]), pytest.approx(best[m]["zero_value"]), best[m]["any_beats_zero"])


def test_reports_have_a_row_per_route(states, spark):
    got = {r["route_key"]: r for r in models.route_priority(route_models.route_reports(states, FEATURES, params())).collect()}
    assert set(got) == {"R1", "R2", "R3", "R4"}
    assert got["R3"]["two_stage_skipped"] and got["R3"]["folds_total"] is None and got["R3"]["route_model_priority_reason"] == "two_stage_skipped"
    assert got["R4"]["folds_total"] == 3 and got["R4"]["beats_zero_rmse"] and got["R4"]["route_model_priority"] in ("high", "candidate")
    assert route_models.route_reports(states.limit(0), FEATURES, params()).count() == 0


def test_best_split_equals_trying_all():
    r = np.random.default_rng(3)
    for _ in range(60):
        layout = trees.Layout(r.integers(1, 6, 4), np.array([True, False, True, False]))
        rows = r.integers(0, 1000, (40, 4)) % layout.sizes
        w, g = r.integers(0, 3, 40).astype(float), r.normal(size=40)
        sums = trees.histogram(rows, layout, np.zeros(40, int), [0], np.column_stack((w, w, w * g)))[0]
        found = trees.best_split(sums, layout, 2, 0)
        best = None
        for j in range(4):
            for cell in range(layout.sizes[j]):
                go = rows[:, j] <= cell if layout.ordered[j] else rows[:, j] == cell
                a, b = w[go].sum(), w[~go].sum()
                if a >= 2 and b >= 2:
                    gain = (w[go] @ g[go]) ** 2 / a + (w[~go] @ g[~go]) ** 2 / b - (w @ g) ** 2 / w.sum()
                    if best is None or gain > best + 1e-9:
                        best, at = gain, (j, cell)
        assert (found is None) == (best is None or best <= 1e-9 * abs(w @ g))
        if found:
            gain = found[2][2] ** 2 / found[2][1] + found[3][2] ** 2 / found[3][1] - (w @ g) ** 2 / w.sum()
            assert gain == pytest.approx(best)
