"""Queries over baseline forecasts, back-tests, alerts and drift."""

from datetime import datetime

from pyspark.sql import functions as F

from farescope.catalog.base import query, sql
from farescope.catalog.q_market import PRIORS
from farescope.catalog.q_rollups import AVAILABILITY_DAILY, ROUTE_SUMMARY
from farescope.operators import forecast, market, rollups

K = ["airline", "origin"]
T = "total_change_events"
_S = "airline:s origin:s "


@query("offer_event_daily", "report_day:D airline:s origin:s destination:s cabin:s total_change_events:i price_events:i "
       "availability_events:i", sql("""SELECT *, price_events + availability_events AS total_change_events FROM (
  SELECT report_day, airline, origin, destination, cabin,
    CASE WHEN lag(p) OVER w IS NULL THEN 0 WHEN p IS DISTINCT FROM lag(p) OVER w THEN 1 ELSE 0 END AS price_events,
    CASE WHEN lag(s) OVER w IS NULL THEN 0 WHEN s IS DISTINCT FROM lag(s) OVER w THEN 1 ELSE 0 END AS availability_events
  FROM (SELECT CAST(captured_at AS DATE) AS report_day, airline, origin, destination, cabin, min(price_total) AS p,
    avg(seat_available) AS s FROM offers GROUP BY ALL) WINDOW w AS (PARTITION BY airline, origin, destination, cabin
    ORDER BY report_day))"""))
def _offer_daily(ctx):
    return forecast.offer_event_daily(ctx.offers)


@query("event_daily", "report_day:D airline:s origin:s destination:s cabin:s total_change_events:i price_events:i "
       "availability_events:i", sql(f"SELECT * FROM ({ROUTE_SUMMARY})", needs="changes"))
def _event_daily(ctx):
    return forecast.event_daily(rollups.route_airline_summary(ctx.changes), ctx.offers)


@query("search_dynamic", "report_day:D departure_day:D airline:s origin:s destination:s cabin:s min_price_bdt:d2 "
       "avg_seat_available:d4 offers_count:i soldout_offers:i soldout_rate:d4 days_to_departure:i", sql("""
  SELECT *, soldout_offers / offers_count AS soldout_rate, date_diff('day', report_day, departure_day) AS days_to_departure
  FROM (SELECT CAST(captured_at AS DATE) AS report_day, CAST(departure AS DATE) AS departure_day, airline, origin,
    destination, cabin, min(price_total) AS min_price_bdt, avg(seat_available) AS avg_seat_available,
    count(*) AS offers_count, count(*) FILTER (WHERE coalesce(soldout, false)) AS soldout_offers
    FROM offers LEFT JOIN (SELECT offer_id, soldout FROM meta QUALIFY row_number() OVER (PARTITION BY offer_id
    ORDER BY meta_id DESC) = 1) USING (offer_id) GROUP BY ALL)""", needs="offers meta"))
def _dynamic(ctx):
    return forecast.search_dynamic(ctx.offers, ctx.meta_with("soldout"))


PREDS = ["pred_last_value", "pred_rolling_mean_3", "pred_rolling_mean_7", "pred_seasonal_naive_7",
         "pred_ewm_alpha_0_30"]
_P = " ".join(f"{p}:d" for p in PREDS)
_EWM = "list_reduce({x}, lambda a, x: 0.7::DOUBLE * a + 0.3::DOUBLE * x)"
PRED = f"""pred AS (SELECT *, lag(y) OVER w AS prev_actual_value, lag(y) OVER w AS pred_last_value,
  avg(y) OVER (PARTITION BY airline, origin ORDER BY report_day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS pred_rolling_mean_3,
  avg(y) OVER (PARTITION BY airline, origin ORDER BY report_day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS pred_rolling_mean_7,
  lag(y, 7) OVER w AS pred_seasonal_naive_7,
  CASE WHEN len(before) > 0 THEN {_EWM.format(x='before')} END AS pred_ewm_alpha_0_30 FROM (
    SELECT *, CAST({T} AS DOUBLE) AS y, coalesce(list(CAST({T} AS DOUBLE)) OVER (PARTITION BY airline, origin ORDER BY report_day
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS before FROM daily)
  WINDOW w AS (PARTITION BY airline, origin ORDER BY report_day))"""


def predicted(ctx):
    frame = forecast.add_baselines(ctx.daily, T, (3, 7), K)
    return forecast.clip_predictions(forecast.add_extra_baselines(frame, T, 7, 0.3, K), T)


@query("baseline_predictions", _S + "report_day:D total_change_events:i prev_actual_value:d " + _P,
       sql("SELECT * FROM pred", needs="daily", ctes=PRED))
def _baselines(ctx):
    return predicted(ctx)


@query("clipped_predictions", _S + "report_day:D pred_low:d pred_high:d", sql("""SELECT airline, origin, report_day,
  least(1.0, greatest(0.0, y / 10.0 - 1)) AS pred_low, CAST(1.0 AS DOUBLE) AS pred_high FROM pred""", needs="daily",
       ctes=PRED))
def _clip(ctx):
    rows = ctx.daily.select(*K, "report_day", (F.col(T) / 10.0 - 1).alias("pred_low"), F.lit(3.5).alias("pred_high"))
    return forecast.clip_predictions(rows, "soldout_rate")


@query("next_day_forecast", _S + "latest_report_day:D predicted_for_day:D history_days:i latest_actual_value:d " + _P, sql(
    f"""SELECT airline, origin, max(report_day) AS latest_report_day, max(report_day) + 1 AS predicted_for_day,
  count(*) AS history_days, max(y) FILTER (WHERE back = 1) AS latest_actual_value,
  max(y) FILTER (WHERE back = 1) AS pred_last_value, avg(y) FILTER (WHERE back <= 3) AS pred_rolling_mean_3,
  avg(y) FILTER (WHERE back <= 7) AS pred_rolling_mean_7, max(y) FILTER (WHERE back = 7) AS pred_seasonal_naive_7,
  {_EWM.format(x='list(y ORDER BY report_day)')} AS pred_ewm_alpha_0_30 FROM (SELECT *, CAST({T} AS DOUBLE) AS y,
  row_number() OVER (PARTITION BY airline, origin ORDER BY report_day DESC) AS back FROM daily) GROUP BY 1, 2
  HAVING count(*) >= 3""", needs="daily"))
def _next(ctx):
    return forecast.next_day(ctx.daily, T, (3, 7), 3, 7, 0.3, K)


@query("trend_summary", _S + "first_report_day:D last_report_day:D obs_count:i first_value:d last_value:d min_value:d "
       "max_value:d avg_value:d std_value:d delta_value:d delta_pct:d trend_direction:s", sql(f"""SELECT *,
  last_value - first_value AS delta_value, (last_value - first_value) / nullif(first_value, 0) * 100.0 AS delta_pct,
  CASE WHEN last_value > first_value THEN 'UP' WHEN last_value < first_value THEN 'DOWN' ELSE 'FLAT' END AS trend_direction
  FROM (SELECT airline, origin, min(report_day) AS first_report_day, max(report_day) AS last_report_day,
    count({T}) AS obs_count, arg_min({T}::DOUBLE, report_day) AS first_value, arg_max({T}::DOUBLE, report_day) AS last_value,
    min({T}) AS min_value, max({T}) AS max_value, avg({T}) AS avg_value, stddev_samp({T}) AS std_value FROM daily
    GROUP BY 1, 2)""", needs="daily"))
def _trend(ctx):
    return forecast.trend_summary(ctx.daily, T, K)


_METRICS = ("n:i mae:d rmse:d mape_pct:d smape_pct:d n_directional:i directional_accuracy_pct:d f1_up:d f1_down:d "
            "f1_macro:d")
LONG = PRED + ", long AS (" + " UNION ALL ".join(
    f"SELECT airline, origin, report_day, y AS actual, prev_actual_value AS prev, '{p}' AS model, {p} AS pred FROM pred"
    for p in PREDS) + ")"


def _f1(side: str) -> str:
    return (f"CASE WHEN tp_{side} + fp_{side} + fn_{side} = 0 THEN NULL "
            f"WHEN tp_{side} = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp_{side} / (2 * tp_{side} + fp_{side} + fn_{side}) END")


def metrics_sql(by: str, source: str = "long") -> str:
    g = f"{by}, model" if by else "model"
    turned = "pred IS NOT NULL AND actual IS NOT NULL AND prev IS NOT NULL"
    counts = []
    for name, s in (("up", 1), ("down", -1)):
        counts += [f"count(*) FILTER (WHERE {turned} AND sign(actual - prev) = {s} AND sign(pred - prev) = {s}) AS tp_{name}",
                   f"count(*) FILTER (WHERE {turned} AND sign(actual - prev) <> {s} AND sign(pred - prev) = {s}) AS fp_{name}",
                   f"count(*) FILTER (WHERE {turned} AND sign(actual - prev) = {s} AND sign(pred - prev) <> {s}) AS fn_{name}"]
    return f"""SELECT *, CASE WHEN f1_up IS NULL THEN f1_down WHEN f1_down IS NULL THEN f1_up ELSE (f1_up + f1_down) / 2 END
  AS f1_macro FROM (SELECT *, hits / nullif(n_directional, 0) * 100.0 AS directional_accuracy_pct, {_f1('up')} AS f1_up,
  {_f1('down')} AS f1_down FROM (SELECT {g}, count(*) FILTER (WHERE pred IS NOT NULL AND actual IS NOT NULL) AS n,
  avg(abs(pred - actual)) AS mae, sqrt(avg((pred - actual) * (pred - actual))) AS rmse,
  avg(abs(pred - actual) / nullif(actual, 0)) * 100 AS mape_pct,
  avg(abs(pred - actual) / nullif((abs(pred) + abs(actual)) / 2, 0)) * 100 AS smape_pct,
  count(*) FILTER (WHERE {turned}) AS n_directional,
  count(*) FILTER (WHERE {turned} AND sign(actual - prev) = sign(pred - prev)) AS hits, {', '.join(counts)}
  FROM {source} GROUP BY {g}))"""


@query("model_eval", "model:s " + _METRICS, sql(metrics_sql(""), needs="daily", ctes=LONG))
def _eval(ctx):
    return forecast.evaluate(predicted(ctx), T, PREDS, K)[0]


@query("route_eval", _S + "model:s " + _METRICS, sql(metrics_sql("airline, origin"), needs="daily", ctes=LONG))
def _route_eval(ctx):
    return forecast.evaluate(predicted(ctx), T, PREDS, K)[1]


_BEST = """SELECT {scope} model AS selected_model FROM (SELECT *, max(n) OVER ({part}) AS mx FROM ({src}) WHERE n > 0
  AND mae IS NOT NULL) WHERE n >= floor(mx * 0.8) QUALIFY row_number() OVER ({part} ORDER BY mae, rmse, model) = 1"""


@query("best_model", "selected_model:s", sql(_BEST.format(scope="", part="", src=metrics_sql("")), needs="daily", ctes=LONG))
def _best(ctx):
    return forecast.best_model(forecast.evaluate(predicted(ctx), T, PREDS, K)[0])


def _winner_sql(scope: str, src: str, metric: str = "mae") -> str:
    return f"""SELECT {scope}, model AS winner_model, '{metric}' AS winner_metric, n AS winner_n, mae AS winner_mae,
  rmse AS winner_rmse, directional_accuracy_pct AS winner_directional_accuracy_pct, f1_macro AS winner_f1_macro,
  mx AS max_candidate_n, CAST(floor(mx * 0.8) AS BIGINT) AS coverage_threshold_n,
  count(*) OVER (PARTITION BY {scope}) AS candidate_models FROM (SELECT *, max(n) OVER (PARTITION BY {scope}) AS mx
  FROM ({src}) WHERE n > 0 AND {metric} IS NOT NULL) WHERE n >= floor(mx * 0.8)
  QUALIFY row_number() OVER (PARTITION BY {scope} ORDER BY {metric}, rmse, model) = 1"""


_WIN = ("winner_model:s winner_metric:s winner_n:i winner_mae:d winner_rmse:d winner_directional_accuracy_pct:d "
        "winner_f1_macro:d max_candidate_n:i coverage_threshold_n:i candidate_models:i")


@query("route_winners", _S + _WIN, sql(_winner_sql("airline, origin", metrics_sql("airline, origin"), "rmse"),
                                      needs="daily", ctes=LONG))
def _winners(ctx):
    return forecast.winner_table(forecast.evaluate(predicted(ctx), T, PREDS, K)[1], K, "rmse")


# ---------------------------------------------------------------- back-test


def _splits(train, val, test, step):
    return f"""days AS (SELECT min(report_day) AS lo, max(report_day) AS hi FROM daily),
  sp AS (SELECT k + 1 AS split_id, lo + CAST(k * {step} AS INT) AS train_start, lo + CAST(k * {step} + {train} - 1 AS INT) AS train_end,
    lo + CAST(k * {step} + {train} AS INT) AS val_start, lo + CAST(k * {step} + {train + val} - 1 AS INT) AS val_end,
    lo + CAST(k * {step} + {train + val} AS INT) AS test_start, lo + CAST(k * {step} + {train + val + test} - 1 AS INT) AS test_end
    FROM days, range(0, 400) r(k) WHERE lo + CAST(k * {step} + {train + val + test} - 1 AS INT) <= hi)"""


_SPLIT = "split_id:i train_start:D train_end:D val_start:D val_end:D test_start:D test_end:D"


@query("backtest_splits", _SPLIT, sql("SELECT * FROM sp", needs="daily", ctes=_splits(10, 5, 5, 3)))
def _split_query(ctx):
    return forecast.backtest_splits(ctx.daily, 10, 5, 5, 3)


@query("backtest_splits_auto", _SPLIT + " auto_window:b", sql("SELECT *, true AS auto_window FROM sp", needs="daily",
                                                             ctes=_splits(18, 6, 6, 6)))
def _split_auto(ctx):
    return forecast.backtest_splits(ctx.daily, 28, 7, 7, 7)


_BT = LONG + ", " + _splits(10, 5, 5, 3) + """,
  bl AS (SELECT long.*, split_id, 'val' AS dataset FROM long JOIN sp ON report_day BETWEEN val_start AND val_end
    UNION ALL SELECT long.*, split_id, 'test' FROM long JOIN sp ON report_day BETWEEN test_start AND test_end)"""
_SELECTED = _BEST.format(scope="split_id,", part="PARTITION BY split_id",
                         src=metrics_sql("split_id, dataset", "bl") + " WHERE dataset = 'val'")


def _backtest(ctx):
    return forecast.rolling_backtest(predicted(ctx), T, PREDS, 10, 5, 5, 3, K)


@query("backtest_metrics", "dataset:s model:s selected_on_val:b " + _METRICS + " " + _SPLIT, sql(
    f"""SELECT m.*, s.*EXCLUDE (split_id), m.model = b.selected_model AS selected_on_val
  FROM ({metrics_sql('split_id, dataset', 'bl')}) m JOIN sp s USING (split_id) JOIN ({_SELECTED}) b USING (split_id)""",
    needs="daily", ctes=_BT))
def _bt_metrics(ctx):
    return _backtest(ctx)["metrics"]


@query("backtest_split_table", _SPLIT + " train_rows:i val_rows:i test_rows:i selected_model:s", sql(f"""SELECT s.*,
  (SELECT count(*) FROM daily WHERE report_day BETWEEN train_start AND train_end) AS train_rows,
  (SELECT count(*) FROM daily WHERE report_day BETWEEN val_start AND val_end) AS val_rows,
  (SELECT count(*) FROM daily WHERE report_day BETWEEN test_start AND test_end) AS test_rows, b.selected_model
  FROM sp s JOIN ({_SELECTED}) b USING (split_id)""", needs="daily", ctes=_BT))
def _bt_splits(ctx):
    return _backtest(ctx)["splits"]


@query("backtest_route_metrics", "split_id:i dataset:s airline:s origin:s model:s " + _METRICS, sql(
    metrics_sql("split_id, dataset, airline, origin", "bl"), needs="daily", ctes=_BT))
def _bt_routes(ctx):
    return _backtest(ctx)["route_metrics"]


@query("backtest_route_winners", "dataset:s airline:s origin:s " + _WIN, sql(_winner_sql(
    "dataset, airline, origin", metrics_sql("split_id, dataset, airline, origin", "bl")).replace(
    "mae, rmse, model) = 1", "mae, rmse, model, split_id) = 1"), needs="daily", ctes=_BT))
def _bt_winners(ctx):
    rows = _backtest(ctx)["route_metrics"]
    return forecast.winner_table(rows, ["dataset", *K])


# ---------------------------------------------------------------- learning frames

_ML = ("lag1:d lag2:d lag3:d lag7:d lag14:d roll3:d roll7:d roll14:d roll7_std:d diff_1_2:d diff_1_7:d ewm03:d dow:i dom:i "
       "market_is_middle_east:i airline_model_proxy_code:d yield_class_proxy_code:d")
_PART = "PARTITION BY airline, origin ORDER BY report_day"
ML_SQL = f"""SELECT *, lag1 - lag2 AS diff_1_2, lag1 - lag7 AS diff_1_7, isodow(report_day) - 1 AS dow, day(report_day) AS dom,
  pred_ewm_alpha_0_30 AS ewm03, pred_rolling_mean_3 AS roll3, pred_rolling_mean_7 AS roll7,
  CASE WHEN origin = 'R2' THEN 0 ELSE 0 END AS market_is_middle_east, 0.0 AS airline_model_proxy_code,
  CASE origin WHEN 'R2' THEN 3.0 ELSE 0.0 END AS yield_class_proxy_code FROM (SELECT *,
  {', '.join(f'lag(y, {n}) OVER ({_PART}) AS lag{n}' for n in (1, 2, 3, 7, 14))},
  avg(y) OVER ({_PART} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS roll14,
  stddev_samp(y) OVER ({_PART} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS roll7_std FROM pred)"""


def ml_frame(ctx):
    rows = ctx.daily.withColumn("destination", F.lit("R2"))
    priors = market.MarketPriors(yield_tourism=("R2-R2",), labor_origins=PRIORS.labor_origins)
    return forecast.ml_features(market.apply_market_priors(rows, priors, ctx.airports), T, K)


@query("ml_features", _S + "report_day:D " + _ML, sql(ML_SQL, needs="daily", ctes=PRED))
def _ml(ctx):
    return ml_frame(ctx)


_FILLED = ["lag1", "lag7", "lag14", "roll7_std"]


@query("ml_feature_fill", _S + "report_day:D lag1:d lag7:d lag14:d roll7_std:d", sql(f"""SELECT airline, origin, report_day,
  {', '.join(f"coalesce({c}, (SELECT median({c}) FROM f WHERE origin <> 'R0'), 0) AS {c}" for c in _FILLED)} FROM f""",
       needs="daily", ctes=PRED + f", f AS ({ML_SQL})"))
def _fill(ctx):
    frame = ml_frame(ctx)
    return forecast.fill_features(frame.where("origin <> 'R0'"), [frame], _FILLED)[0]


@query("recency_weights", _S + "report_day:D weight:d", sql("""SELECT airline, origin, report_day, CASE WHEN n = 1 THEN 1.0
  ELSE 0.5::DOUBLE + 0.5::DOUBLE * (rn - 1) / (n - 1) END AS weight FROM (SELECT *, row_number() OVER (PARTITION BY airline, origin
  ORDER BY report_day) AS rn, count(*) OVER (PARTITION BY airline, origin) AS n FROM daily)""", needs="daily"))
def _weights(ctx):
    return forecast.recency_weight(ctx.daily, K)


@query("robust_bounds", _S + "lower:d upper:d", sql(f"""SELECT airline, origin,
  quantile_cont({T}::DOUBLE, 0.01) - 2 * (quantile_cont({T}::DOUBLE, 0.75) - quantile_cont({T}::DOUBLE, 0.25)) AS lower,
  quantile_cont({T}::DOUBLE, 0.99) + 2 * (quantile_cont({T}::DOUBLE, 0.75) - quantile_cont({T}::DOUBLE, 0.25)) AS upper
  FROM daily GROUP BY 1, 2""", needs="daily"))
def _bounds(ctx):
    return forecast.robust_bounds(ctx.daily, T, K)


# ---------------------------------------------------------------- alerts and drift

_AF = f"""a2 AS ({AVAILABILITY_DAILY}), a3 AS ({ROUTE_SUMMARY}),
  af AS (SELECT report_day, airline, origin, destination, cabin, total_change_events, price_events, availability_events,
    coalesce(soldout_flag_changes, 0) AS soldout_flag_changes, coalesce(row_removed_events, 0) AS row_removed_events,
    coalesce(row_added_events, 0) AS row_added_events FROM a3 LEFT JOIN (SELECT report_day, airline, origin, destination,
    cabin, soldout_flag_changes, row_removed_events, row_added_events FROM a2) USING (report_day, airline, origin, destination, cabin)),
  ac AS (SELECT *, total_change_events >= 25 AS a_spike, coalesce(spike_score >= 25, false) AS p_spike,
    soldout_flag_changes >= 1 OR row_removed_events > 0 AS a_sell, coalesce(sell_score >= 1, false) AS p_sell FROM (
    SELECT *, avg(total_change_events) OVER w AS spike_score, avg(soldout_flag_changes) OVER w AS sell_score FROM af
    WINDOW w AS (PARTITION BY airline, origin, destination, cabin ORDER BY report_day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)))"""


def classified(ctx):
    frame = forecast.alert_frame(rollups.route_airline_summary(ctx.changes), rollups.availability_changes_daily(ctx.changes))
    return forecast.classify_alerts(frame, spike=25.0)


_DAY = "report_day:D airline:s origin:s destination:s cabin:s "


@query("alert_frame", _DAY + "total_change_events:i price_events:i availability_events:i soldout_flag_changes:i "
       "row_removed_events:i row_added_events:i", sql("SELECT * FROM af", needs="changes", ctes=_AF))
def _alert_frame(ctx):
    return forecast.alert_frame(rollups.route_airline_summary(ctx.changes), rollups.availability_changes_daily(ctx.changes))


@query("alert_classes", _DAY + "pred_spike_score:d pred_sellout_score:d actual_spike_alert:b pred_spike_alert:b "
       "actual_sellout_alert:b pred_sellout_alert:b", sql("""SELECT *, spike_score AS pred_spike_score,
  sell_score AS pred_sellout_score, a_spike AS actual_spike_alert, p_spike AS pred_spike_alert,
  a_sell AS actual_sellout_alert, p_sell AS pred_sellout_alert FROM ac""", needs="changes", ctes=_AF))
def _classes(ctx):
    return classified(ctx)


def _quality_sql(by: str) -> str:
    g = f"{by}, " if by else ""
    return f"""SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall,
  CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
  tp + fn AS support, fp * fa AS false_alarm_cost_total, fn * miss AS missed_event_cost_total,
  fp * fa + fn * miss AS total_cost FROM (SELECT {g}alert_type, fa, miss, count(*) FILTER (WHERE a AND p) AS tp,
  count(*) FILTER (WHERE NOT a AND p) AS fp, count(*) FILTER (WHERE a AND NOT p) AS fn,
  count(*) FILTER (WHERE NOT a AND NOT p) AS tn FROM (
    SELECT *, 'spike' AS alert_type, 1.0 AS fa, 3.0 AS miss, a_spike AS a, p_spike AS p FROM ac
    UNION ALL SELECT *, 'sellout', 2.0, 8.0, a_sell, p_sell FROM ac) GROUP BY ALL)"""


_QUALITY = ("alert_type:s tp:i fp:i fn:i tn:i precision:d recall:d f1:d accuracy:d support:i false_alarm_cost_total:d "
            "missed_event_cost_total:d total_cost:d")


@query("alert_quality", _QUALITY, sql(_quality_sql(""), needs="changes", ctes=_AF))
def _quality(ctx):
    return forecast.alert_quality(classified(ctx))


@query("alert_quality_by_route", "airline:s origin:s destination:s cabin:s " + _QUALITY, sql(
    _quality_sql("airline, origin, destination, cabin"), needs="changes", ctes=_AF))
def _quality_route(ctx):
    return forecast.alert_quality(classified(ctx), ["airline", "origin", "destination", "cabin"])


_DRIFT = """dr AS (SELECT *, CASE WHEN prior > 0 THEN recent / prior WHEN recent > 0 THEN 999.0 ELSE 1.0 END AS r FROM (
  SELECT airline, origin, destination, cabin, count(*) AS points, coalesce(avg(e) FILTER (WHERE back <= 7), 0) AS recent,
    coalesce(avg(e) FILTER (WHERE back > 7 AND back <= 14), 0) AS prior FROM (SELECT *, row_number() OVER (
    PARTITION BY airline, origin, destination, cabin ORDER BY day DESC) AS back FROM (SELECT *, abs(n - lag(n) OVER (
    PARTITION BY airline, origin, destination, cabin ORDER BY day)) AS e FROM (SELECT airline, origin, destination, cabin,
    CAST(detected_at AS DATE) AS day, count(*) AS n FROM changes WHERE detected_at >= DATE '1996-01-01' GROUP BY ALL))
    WHERE e IS NOT NULL) GROUP BY ALL) WHERE points >= 8)"""


def drifts(ctx):
    # 2192 days before 2002-01-01 is 1996-01-01.
    return forecast.drift(ctx.changes, datetime(2002, 1, 1), 2192)


@query("model_drift", "airline:s origin:s destination:s cabin:s points:i recent_mae:d4 prior_mae:d4 drift_ratio:d4 "
       "drift_flag:b", sql("""SELECT *, round(recent, 4) AS recent_mae, round(prior, 4) AS prior_mae, round(r, 4) AS drift_ratio,
  r >= 1.35 AS drift_flag FROM dr""", needs="changes", ctes=_DRIFT))
def _drift(ctx):
    return drifts(ctx)


@query("model_drift_status", "overall_status:s group_count:i drift_group_count:i", sql("""SELECT CASE
  WHEN n > 0 AND b >= greatest(2, floor(n * 0.4)) THEN 'FAIL' WHEN n > 0 AND b >= greatest(1, floor(n * 0.2)) THEN 'WARN'
  ELSE 'PASS' END AS overall_status, n AS group_count, b AS drift_group_count FROM (SELECT count(*) AS n,
  count(*) FILTER (WHERE r >= 1.35) AS b FROM dr)""", needs="changes", ctes=_DRIFT))
def _drift_status(ctx):
    return forecast.drift_status(drifts(ctx))


# ---------------------------------------------------------------- boards


@query("leaderboard_mae", "model:s n:i mae:d directional_accuracy_pct:d", sql(
    f"SELECT * FROM ({metrics_sql('')}) WHERE mae IS NOT NULL ORDER BY mae, model", needs="daily", ctes=LONG))
def _board(ctx):
    return forecast.leaderboard(forecast.evaluate(predicted(ctx), T, PREDS, K)[0])


@query("leaderboard_direction", "model:s directional_accuracy_pct:d", sql(
    f"SELECT * FROM ({metrics_sql('')}) ORDER BY directional_accuracy_pct DESC NULLS LAST, model LIMIT 1", needs="daily",
    ctes=LONG))
def _board_direction(ctx):
    evals = forecast.evaluate(predicted(ctx), T, PREDS, K)[0]
    return forecast.leaderboard(evals, "directional_accuracy_pct", ascending=False, n=1)


@query("leaderboard_hardest_routes", _S + "model:s n:i mae:d", sql(f"""SELECT * FROM ({metrics_sql('airline, origin')})
  WHERE n >= 5""", needs="daily", ctes=LONG))
def _hardest(ctx):
    evals = forecast.evaluate(predicted(ctx), T, PREDS, K)[1]
    return forecast.leaderboard(evals, "mae", False, None, 5, (*K, "model"))


@query("leaderboard_winners", _S + "winner_model:s winner_n:i winner_mae:d", sql(f"""SELECT * FROM ({_winner_sql(
    'airline, origin', metrics_sql('airline, origin'))}) WHERE winner_n >= 5""", needs="daily", ctes=LONG))
def _winner_board(ctx):
    winners = forecast.winner_table(forecast.evaluate(predicted(ctx), T, PREDS, K)[1], K)
    return forecast.winner_board(winners, None, 5, K)


_WATCH = f"""nd AS (SELECT airline, origin, max(y) FILTER (WHERE back = 1) AS latest_actual_value,
  avg(y) FILTER (WHERE back <= 3) AS preferred_value FROM (SELECT *, CAST({T} AS DOUBLE) * 100 AS y, row_number() OVER (
  PARTITION BY airline, origin ORDER BY report_day DESC) AS back FROM daily) GROUP BY 1, 2),
  wl AS (SELECT *, 'pred_rolling_mean_3' AS preferred_key, preferred_value - latest_actual_value AS delta FROM nd)"""


def _watch(ctx):
    rows = forecast.next_day(ctx.daily.withColumn(T, F.col(T) * 100), T, (3, 7), 3, 7, 0.3, K)
    return forecast.watchlist(rows, None, K)


@query("forecast_watchlist", _S + "preferred_key:s preferred_value:d latest_actual_value:d delta:d",
       sql("SELECT * FROM wl", needs="daily", ctes=_WATCH))
def _watchlist(ctx):
    return _watch(ctx)


@query("forecast_labels", _S + "confidence_label:s volatility_label:s action_label:s", sql(f"""SELECT airline, origin,
  CASE WHEN directional_accuracy_pct >= 65 AND mae <= 800 THEN 'High confidence' WHEN directional_accuracy_pct >= 58
    AND mae <= 1500 THEN 'Moderate confidence' ELSE 'Low confidence' END AS confidence_label,
  CASE WHEN mae >= 1500 OR directional_accuracy_pct < 55 THEN 'High-volatility route' WHEN mae <= 600 AND
    directional_accuracy_pct >= 65 THEN 'Stable market' ELSE 'Mixed signal' END AS volatility_label,
  CASE WHEN abs(delta) >= 1500 THEN 'Watch closely' WHEN abs(delta) >= 700 THEN 'Review pricing'
    WHEN NOT (directional_accuracy_pct >= 58) THEN 'Monitor only' ELSE 'Stable market' END AS action_label
  FROM wl JOIN ({metrics_sql('airline, origin')}) m USING (airline, origin) WHERE model = 'pred_rolling_mean_3'""",
       needs="daily", ctes=LONG + ", " + _WATCH))
def _labels(ctx):
    evals = forecast.evaluate(predicted(ctx), T, PREDS, K)[1].where("model = 'pred_rolling_mean_3'")
    return forecast.forecast_labels(evals, _watch(ctx), K)
