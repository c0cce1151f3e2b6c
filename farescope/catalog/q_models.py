"""Queries over models. Fitted figures have no SQL twin; the sweep and the priority rules do."""

from pyspark.sql import functions as F

from farescope.catalog.base import query, sql, stored
from farescope.catalog.q_forecast import K, T, ml_frame
from farescope.catalog.q_inventory import states
from farescope.operators import inventory, models, quantiles, route_models


def labelled(ctx):
    """States with labels and features, written once: the fits read them many times over."""
    rows = stored(ctx, "labelled-states", lambda: inventory.engineered(inventory.next_labels(states(ctx)), "R1-R2"))
    return models.feature_matrix(rows, "drop_route_engineered", "R1-R2")


@query("feature_matrix_columns", "kind:s columns:i")
def _matrix(ctx):
    _, features = labelled(ctx)
    rows = [("numeric", len(features.numeric)), ("categorical", len(features.categorical)), ("boolean", len(features.boolean)),
            ("dropped", len(features.dropped))]
    return ctx.spark.createDataFrame(rows, "kind string, columns int")


@query("move_classifier", "model:s rows:i accuracy:d balanced_accuracy:d macro_f1:d")
def _classifier(ctx):
    rows, features = labelled(ctx)
    return models.move_classifier(rows, features)["metrics"]


@query("delta_regressor", "model:s rows:i mae:d2 rmse:d2 median_ae:d2 r2:d")
def _regressor(ctx):
    rows, features = labelled(ctx)
    return models.delta_regressor(rows, features)["metrics"]


@query("two_stage", "model:s rows:i mae:d2 rmse:d2 median_ae:d2 r2:d")
def _two_stage(ctx):
    rows, features = labelled(ctx)
    params = models.TwoStageParams(min_move_delta=5000.0, trees=10, max_depth=4, calibration="sigmoid")
    return models.two_stage(rows, features, params)["combined"]


_SWEEP = """sc AS (SELECT least(1.0::DOUBLE, l_discount * 5 + l_tax * 6) AS p_move, l_quantity - 20 AS pred_delta,
  CASE WHEN l_linenumber % 3 = 0 THEN 0.0 ELSE l_quantity - 25 + l_linenumber END AS y, (l_linenumber % 3 <> 0)::INT AS moved FROM lineitem),
  g AS (SELECT k / 100.0::DOUBLE AS threshold, k FROM range(50, 100) r(k)),
  ev AS (SELECT g.threshold, y, moved, (p_move >= g.threshold)::INT AS pm, CASE WHEN p_move >= g.threshold THEN pred_delta ELSE 0 END AS pr
    FROM sc, g),
  sw AS (SELECT threshold, sum(pm) AS predicted_move_count, sum(moved) AS actual_move_count, avg(abs(y - pr)) AS mae,
    sqrt(avg((y - pr) * (y - pr))) AS rmse, median(abs(y - pr)) AS median_ae, 1 - sum((y - pr) * (y - pr)) / (var_pop(y) * count(*)) AS r2,
    avg((pm = moved)::INT) AS accuracy, sum(pm * moved) / nullif(sum(pm), 0) AS pv, sum(pm * moved) / sum(moved) AS rv,
    sum((1 - pm) * (1 - moved)) / sum(1 - moved) AS sv FROM ev GROUP BY 1)"""


def _scored(ctx):
    return ctx.table("lineitem").selectExpr(
        "least(1.0D, l_discount * 5 + l_tax * 6) AS p_move", "l_quantity - 20 AS pred_delta",
        "CASE WHEN l_linenumber % 3 = 0 THEN 0.0D ELSE l_quantity - 25 + l_linenumber END AS y",
        "CAST(l_linenumber % 3 <> 0 AS DOUBLE) AS moved")


@query("threshold_sweep", "threshold:d2 predicted_move_count:i actual_move_count:i mae:d rmse:d median_ae:d r2:d accuracy:d "
       "balanced_accuracy:d precision_move:d recall_move:d f1_move:d", sql("""SELECT *, (rv + sv) / 2 AS balanced_accuracy,
  coalesce(pv, 0) AS precision_move, rv AS recall_move, coalesce(2 * pv * rv / nullif(pv + rv, 0), 0) AS f1_move FROM sw""",
       needs="", ctes=_SWEEP))
def _sweep(ctx):
    return models.threshold_sweep(_scored(ctx))


@query("best_thresholds", "metric:s best_threshold:d2 best_value:d zero_value:d best_threshold_beating_zero:d2 any_beats_zero:b", sql("""
  SELECT 'rmse' AS metric, arg_min(threshold, (rmse, threshold)) AS best_threshold, min(rmse) AS best_value, z.rmse AS zero_value,
    CASE WHEN min(sw.rmse) < z.rmse THEN arg_min(threshold, (sw.rmse, threshold)) END AS best_threshold_beating_zero,
    min(sw.rmse) < z.rmse AS any_beats_zero FROM sw, z GROUP BY z.rmse
  UNION ALL SELECT 'mae', arg_min(threshold, (sw.mae, threshold)), min(sw.mae), z.mae,
    CASE WHEN min(sw.mae) < z.mae THEN arg_min(threshold, (sw.mae, threshold)) END, min(sw.mae) < z.mae FROM sw, z GROUP BY z.mae""".replace(
    "arg_min(threshold, (rmse, threshold)) AS best_threshold, min(rmse)",
    "arg_min(threshold, (sw.rmse, threshold)) AS best_threshold, min(sw.rmse)"), needs="",
       ctes=_SWEEP + ", z AS (SELECT sqrt(avg(y * y)) AS rmse, avg(abs(y)) AS mae FROM sc)"))
def _best(ctx):
    scored = _scored(ctx)
    zero = models.regression_metrics(scored.select(F.lit("zero").alias("model"), "y", F.lit(0.0).alias("predicted")))
    return models.best_thresholds(models.threshold_sweep(scored), zero)


# Folds of the rolling evaluation, for routes with rows enough.
_FOLDS = 3


@query("route_model_reports", "route_key:s two_stage_skipped:b beats_zero_rmse:b beats_zero_mae:b route_model_priority:s "
       "route_model_priority_reason:s")
def _reports(ctx):
    rows, features = labelled(ctx)
    params = models.TwoStageParams(min_move_delta=5000.0, trees=5, max_depth=3)
    # One row per route.
    routes = sorted(r[0] for r in rows.where("route_key IS NOT NULL").select("route_key").distinct().collect())
    reports = models.route_reports(rows, features, routes, _FOLDS, params)
    return models.route_priority(models.report_frame(ctx.spark, reports))


def _route_models(ctx):
    """Gates and scored test rows of all routes and folds, with forests and ridge, fitted once per session."""
    rows, features = labelled(ctx)
    params = route_models.RouteParams(folds=_FOLDS, min_move_delta=5000.0, trees=20, max_depth=4, calibration="isotonic")
    made = []

    def build(which):
        if not made:
            made.extend(route_models.route_scores(rows, features, params))
        return made[which]

    return stored(ctx, "route-gates", lambda: build(0)), stored(ctx, "route-test-scores", lambda: build(1))


@query("route_rolling_report", "route_key:s fold:i train:i test:i train_moves:i test_moves:i reason:s best_threshold_rmse:d2 best_rmse:d2 zero_rmse:d2 "
       "beats_zero_rmse:b best_threshold_mae:d2 best_mae:d2 zero_mae:d2 beats_zero_mae:b")
def _rolling(ctx):
    gate, scores = _route_models(ctx)
    keys = ["route_key", "fold"]
    return gate.join(route_models.beaten(route_models.swept(scores, keys), keys), keys, "left")


@query("route_threshold_report", "route_key:s threshold:d2 predicted_move_count:i actual_move_count:i rmse:d2 mae:d2 zero_rmse:d2 zero_mae:d2")
def _route_thresholds(ctx):
    return route_models.swept(_route_models(ctx)[1].where("fold = 0"), ["route_key"])


_FLAGS = """rep AS (SELECT o_orderkey AS id, o_orderkey % 11 = 0 AS two_stage_skipped, o_orderkey % 2 = 0 AS sparse_stage_b,
  CASE WHEN o_orderkey % 3 <> 0 THEN 4 END AS folds_total, o_orderkey % 5 AS folds_evaluated, o_orderkey % 7 = 1 AS viable_rmse,
  o_orderkey % 4 = 1 AS viable_mae, o_orderkey % 6 < 2 AS any_fold_rmse, o_orderkey % 9 = 2 AS any_fold_mae,
  CAST(o_orderkey % 8 = 3 AS INT) AS sparse_test_folds, CAST(o_orderkey % 10 = 5 AS INT) AS sparse_stage_b_folds,
  o_orderkey % 5 < 2 AS beats_zero_rmse, o_orderkey % 4 < 2 AS beats_zero_mae FROM orders)"""


@query("route_priority", "id:i route_model_priority:s route_model_priority_reason:s", sql("""SELECT id,
  split_part(x, ':', 1) AS route_model_priority, split_part(x, ':', 2) AS route_model_priority_reason FROM (SELECT id, CASE
  WHEN two_stage_skipped THEN CASE WHEN sparse_stage_b THEN 'hold:sparse_stage_b' ELSE 'hold:two_stage_skipped' END
  WHEN folds_total IS NOT NULL THEN CASE WHEN folds_evaluated = 0 THEN 'hold:no_rolling_eval_folds'
    WHEN viable_rmse AND viable_mae THEN 'high:rolling_viable_rmse_mae' WHEN viable_rmse THEN 'candidate:rolling_viable_rmse_only'
    WHEN any_fold_rmse OR any_fold_mae THEN 'watch:some_rolling_fold_signal_no_viability'
    WHEN sparse_test_folds > 0 OR sparse_stage_b_folds > 0 THEN 'watch:rolling_sparse_folds' ELSE 'hold:rolling_no_signal' END
  WHEN beats_zero_rmse AND beats_zero_mae THEN 'candidate:single_split_beats_zero_rmse_mae'
  WHEN beats_zero_rmse THEN 'candidate:single_split_beats_zero_rmse' WHEN beats_zero_mae THEN 'watch:single_split_beats_zero_mae'
  WHEN sparse_stage_b THEN 'watch:single_split_sparse_stage_b' ELSE 'hold:single_split_no_signal' END AS x FROM rep)""",
       needs="", ctes=_FLAGS))
def _priority(ctx):
    rows = ctx.table("orders").selectExpr(
        "o_orderkey AS id", "o_orderkey % 11 = 0 AS two_stage_skipped", "o_orderkey % 2 = 0 AS sparse_stage_b",
        "CASE WHEN o_orderkey % 3 <> 0 THEN 4 END AS folds_total", "o_orderkey % 5 AS folds_evaluated",
        "o_orderkey % 7 = 1 AS viable_rmse", "o_orderkey % 4 = 1 AS viable_mae", "o_orderkey % 6 < 2 AS any_fold_rmse",
        "o_orderkey % 9 = 2 AS any_fold_mae", "CAST(o_orderkey % 8 = 3 AS INT) AS sparse_test_folds",
        "CAST(o_orderkey % 10 = 5 AS INT) AS sparse_stage_b_folds", "o_orderkey % 5 < 2 AS beats_zero_rmse",
        "o_orderkey % 4 < 2 AS beats_zero_mae")
    return models.route_priority(rows)


_ML_FEATURES = ["lag1", "lag2", "lag7", "roll3", "roll7", "roll7_std", "ewm03", "dow", "dom"]


@query("quantile_forecast", "airline:s origin:s report_day:D trained_before:D pred_gbt_q10:d pred_gbt_q50:d pred_gbt_q90:d")
def _quantile(ctx):
    return quantiles.quantile_forecast(ml_frame(ctx), T, _ML_FEATURES, keys=K)
