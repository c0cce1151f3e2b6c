"""Queries over market intelligence and signals."""

from datetime import datetime

from pyspark.sql import functions as F

from farescope.catalog.base import query, sql
from farescope.catalog.change_source import pairs
from farescope.functions import COMPARE_KEY
from farescope.operators import cycles, diff, market

_LM = ("lm AS (SELECT offer_id, soldout FROM (SELECT *, row_number() OVER (PARTITION BY offer_id "
       "ORDER BY meta_id DESC) AS rn FROM meta) WHERE rn = 1)")
SNAP = _LM + """, snap AS (SELECT *, soldout_offers / offers_count AS soldout_rate FROM (
  SELECT CAST(captured_at AS DATE) AS report_day, airline, origin, destination, cabin, min(price_total) AS min_price_bdt,
    avg(seat_available) AS avg_seat_available, count(*) AS offers_count,
    count(*) FILTER (WHERE coalesce(soldout, false)) AS soldout_offers
  FROM offers LEFT JOIN lm USING (offer_id) {where} GROUP BY ALL))"""
_ALL = SNAP.format(where="")


def snapshot(ctx):
    return market.daily_snapshot(ctx.offers, ctx.meta_with("soldout"))


@query("daily_snapshot", "report_day:D airline:s origin:s destination:s cabin:s min_price_bdt:d2 avg_seat_available:d4 "
       "offers_count:i soldout_offers:i soldout_rate:d4", sql("SELECT * FROM snap", needs="offers meta",
       ctes=SNAP.format(where="WHERE captured_at >= TIMESTAMP '1998-06-01'")))
def _snapshot(ctx):
    return market.daily_snapshot(ctx.offers, ctx.meta_with("soldout"), datetime(1998, 7, 1), 30)


@query("competitive_position", "airline:s origin:s destination:s cabin:s days_observed:i days_leading:i "
       "avg_min_price_bdt:d3 price_volatility_bdt:d3 avg_seat_available:d4 avg_soldout_rate:d avg_offers_count:d4 "
       "avg_gap_vs_competitor_bdt:d3 lowest_fare_share_pct:d4 leadership_rank:i price_rank:i", sql("""
  SELECT *, dense_rank() OVER (PARTITION BY origin, destination, cabin ORDER BY lowest_fare_share_pct DESC)
    AS leadership_rank, dense_rank() OVER (PARTITION BY origin, destination, cabin ORDER BY avg_min_price_bdt) AS price_rank
  FROM (SELECT airline, origin, destination, cabin, count(DISTINCT report_day) AS days_observed,
    sum(leads) AS days_leading, avg(price) AS avg_min_price_bdt, coalesce(stddev_samp(price), 0) AS price_volatility_bdt,
    avg(avg_seat_available) AS avg_seat_available, avg(soldout_rate) AS avg_soldout_rate,
    avg(offers_count) AS avg_offers_count, avg(gap) AS avg_gap_vs_competitor_bdt,
    sum(leads) / count(DISTINCT report_day) * 100.0 AS lowest_fare_share_pct FROM (
      SELECT *, CAST(min_price_bdt AS DOUBLE) AS price,
        CASE WHEN min_price_bdt = min(min_price_bdt) OVER w THEN 1 ELSE 0 END AS leads,
        CASE WHEN count(*) OVER w > 1 THEN CAST(min_price_bdt AS DOUBLE) - (sum(CAST(min_price_bdt AS DOUBLE)) OVER w
          - CAST(min_price_bdt AS DOUBLE)) / (count(*) OVER w - 1) END AS gap
      FROM snap WINDOW w AS (PARTITION BY report_day, origin, destination, cabin)) GROUP BY 1, 2, 3, 4)""",
       needs="offers meta", ctes=_ALL))
def _competitive(ctx):
    return market.competitive(snapshot(ctx))


@query("route_competition", "origin:s destination:s cabin:s observed_days:i airlines_active:i "
       "route_avg_lowest_fare_bdt:d3 route_price_volatility_bdt:d3 route_avg_soldout_rate:d "
       "route_avg_offers_count:d4 competition_index:d", sql("""SELECT *, airlines_active * 10.0 +
  (100.0 - route_avg_soldout_rate * 100.0) * 0.2 AS competition_index FROM (SELECT origin, destination, cabin,
  count(DISTINCT report_day) AS observed_days, count(DISTINCT airline) AS airlines_active,
  avg(CAST(min_price_bdt AS DOUBLE)) AS route_avg_lowest_fare_bdt,
  coalesce(stddev_samp(CAST(min_price_bdt AS DOUBLE)), 0) AS route_price_volatility_bdt,
  avg(soldout_rate) AS route_avg_soldout_rate, avg(offers_count) AS route_avg_offers_count FROM snap GROUP BY 1, 2, 3)""",
       needs="offers meta", ctes=_ALL))
def _route_competition(ctx):
    return market.route_competition(snapshot(ctx))


@query("short_forecast", "airline:s origin:s destination:s cabin:s target_column:s latest_report_day:D "
       "predicted_for_day:D history_days:i latest_actual_value:d2 pred_rolling_mean:d3 pred_ewm:d3 p10_baseline:d3 "
       "p90_baseline:d3 expected_direction:s", sql("""SELECT *, 'min_price_bdt' AS target_column,
  latest_report_day + 1 AS predicted_for_day, CASE WHEN pred_rolling_mean > latest_actual_value THEN 'UP'
  WHEN pred_rolling_mean < latest_actual_value THEN 'DOWN' ELSE 'FLAT' END AS expected_direction FROM (
  SELECT airline, origin, destination, cabin, max(report_day) AS latest_report_day, count(*) AS history_days,
    max(y) FILTER (WHERE back = 1) AS latest_actual_value, avg(y) FILTER (WHERE back <= 3) AS pred_rolling_mean,
    list_reduce(list(y ORDER BY report_day), lambda a, x: 0.7::DOUBLE * a + 0.3::DOUBLE * x) AS pred_ewm,
    quantile_cont(y, 0.1) FILTER (WHERE back <= 7) AS p10_baseline,
    quantile_cont(y, 0.9) FILTER (WHERE back <= 7) AS p90_baseline
  FROM (SELECT *, CAST(min_price_bdt AS DOUBLE) AS y, row_number() OVER (PARTITION BY airline, origin, destination, cabin
    ORDER BY report_day DESC) AS back FROM snap) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3)""", needs="offers meta",
       ctes=_ALL))
def _forecast(ctx):
    return market.short_forecast(snapshot(ctx), "min_price_bdt")


_RANKED = """ids AS (SELECT cycle_id, row_number() OVER (ORDER BY cycle_id DESC) AS scrape_rank FROM
  (SELECT DISTINCT cycle_id FROM offers ORDER BY 1 DESC LIMIT 6)), hist AS (SELECT * FROM offers JOIN ids USING (cycle_id))"""


def history(ctx):
    return market.ranked_history(ctx.offers, cycles.last_n_by_id(ctx.offers, 6))


@query("ranked_history", "scrape_rank:i cycle_id:s airline:s offers:i price:d2", sql("""SELECT scrape_rank, cycle_id,
  airline, count(*) AS offers, sum(price_total) AS price FROM hist GROUP BY ALL""", ctes=_RANKED))
def _history(ctx):
    return history(ctx).groupBy("scrape_rank", "cycle_id", "airline").agg(
        F.count("*").alias("offers"), F.sum("price_total").alias("price"))


_K = ", ".join(COMPARE_KEY)
_TREND = f"""tr AS (SELECT {_K}, arg_max(p, ord) - arg_min(p, ord) AS price_trend,
  arg_max(s, ord) - arg_min(s, ord) AS seat_trend, stddev_samp(p) AS price_volatility,
  stddev_samp(s) AS seat_volatility, arg_max(s, ord) AS last_seats, min(p) AS low FROM (SELECT *,
  CAST(price_total AS DOUBLE) AS p, CAST(seat_available AS DOUBLE) AS s,
  strftime({{order}}, '%Y-%m-%d') || offer_id AS ord FROM hist) GROUP BY {_K})"""
_KEYS = "airline:s origin:s destination:s flight_number:s departure:t cabin:s brand:s"


@query("offer_trend", _KEYS + " price_trend:d3 seat_trend:d3 price_volatility:d3 seat_volatility:d3", sql(
    "SELECT * FROM tr", ctes=_RANKED + ", " + _TREND.format(order="captured_at")))
def _trend(ctx):
    return market.trend(history(ctx))


@query("offer_trend_by_cycle_id", _KEYS + " price_trend:d3 seat_trend:d3", sql(
    "SELECT * FROM tr", ctes=_RANKED + ", " + _TREND.format(order="CAST(cycle_id AS DATE)")))
def _trend_legacy(ctx):
    return market.trend(history(ctx), "cycle_id")


def _pressure(ctx):
    rows = history(ctx)
    trends = market.trend(rows)
    last = rows.groupBy(*COMPARE_KEY).agg(
        F.max_by("seat_available", F.struct("captured_at", "offer_id")).alias("last_seats"),
        F.min("price_total").alias("low"))
    lows = last.groupBy("origin", "destination").agg(F.min("low").alias("route_low"))
    joined = trends.join(last, COMPARE_KEY).join(lows, ["origin", "destination"])
    return joined.withColumns({
        "seat_pressure_index": 1 - F.col("last_seats") / F.lit(50.0),
        "is_price_leader": F.col("low") == F.col("route_low"),
    })


_RI = _RANKED + ", " + _TREND.format(order="captured_at") + """, ri AS (SELECT origin, destination,
  count(DISTINCT flight_number) AS flight_count, count(*) FILTER (WHERE low = route_low) AS leader_count,
  avg(price_trend) AS avg_price_trend, avg(price_volatility) AS avg_price_volatility,
  avg(1 - last_seats / 50.0::DOUBLE) AS avg_seat_pressure FROM (SELECT *, min(low) OVER (PARTITION BY origin, destination)
  AS route_low FROM tr) GROUP BY 1, 2)"""
_RI_COLS = ("origin:s destination:s flight_count:i leader_count:i avg_price_trend:d3 avg_price_volatility:d3 "
            "avg_seat_pressure:d leader_concentration:d route_pressure_score:d2")


@query("route_intelligence", _RI_COLS, sql("""SELECT *, leader_count / flight_count AS leader_concentration,
  abs(avg_seat_pressure) * (1 + avg_price_volatility) AS route_pressure_score FROM ri""", ctes=_RI))
def _intelligence(ctx):
    return market.route_intelligence(_pressure(ctx))


@query("route_regime", "origin:s destination:s route_regime:s", sql("""SELECT origin, destination,
  CASE WHEN leader_count / flight_count > 0.8 AND avg_seat_pressure > 0.7 THEN 'DOMINANT_SUPPLY_CONTROL'
  WHEN avg_price_trend < 0 AND avg_price_volatility > 0.4 THEN 'PRICE_WAR'
  WHEN avg_seat_pressure < 0.4 AND avg_price_trend < 0 THEN 'CAPACITY_EXPANSION' ELSE 'NORMAL' END AS route_regime
  FROM ri""", ctes=_RI))
def _regime(ctx):
    return market.route_regime(market.route_intelligence(_pressure(ctx)))


# ---------------------------------------------------------------- signals

_FLIGHT = "airline || '-' || flight_number || '-' || strftime(departure, '%Y-%m-%dT%H:%M:%S')"
SIGNALS = f"""signals AS (
  SELECT airline, {_FLIGHT} AS flight_key, 'PRICE_ACTION' AS signal_category, 'PRICE_INCREASE' AS signal_type,
    least(1.0, CAST(c_price_total - p_price_total AS DOUBLE) / 0.15) AS confidence,
    CAST(c_price_total - p_price_total AS DOUBLE) AS severity, detected_at FROM matched WHERE c_price_total > p_price_total
  UNION ALL SELECT airline, {_FLIGHT}, 'CAPACITY_ACTION', 'INVENTORY_TIGHTENING', 0.8,
    CAST(p_seat_available - c_seat_available AS DOUBLE), detected_at FROM matched WHERE c_seat_available < p_seat_available)"""


def signals(ctx):
    return market.strategy_signals(diff.summary_events(pairs(ctx), ["price", "seat"]))


@query("strategy_signals", "airline:s flight_key:s signal_category:s signal_type:s confidence:d severity:d2 "
       "detected_at:t", sql("SELECT * FROM signals", needs="changes", ctes=SIGNALS))
def _signals(ctx):
    return signals(ctx)


_AGG = SIGNALS + """, agg AS (SELECT *, CASE WHEN net_price_delta > 0 THEN 'UP' WHEN net_price_delta < 0 THEN 'DOWN'
  ELSE 'FLAT' END AS price_trend, CASE WHEN tightening_score > 0 THEN 'TIGHTENING' ELSE 'STABLE' END AS capacity_trend,
  round_even(mean, 2) AS confidence, CASE WHEN mean > 0.7 THEN 'SURGE' ELSE 'NEUTRAL' END AS demand_signal FROM (
  SELECT airline, flight_key, count(*) FILTER (WHERE signal_category = 'PRICE_ACTION') AS pricing_event_count,
    coalesce(sum(severity) FILTER (WHERE signal_category = 'PRICE_ACTION'), 0) AS net_price_delta,
    count(*) FILTER (WHERE signal_category = 'CAPACITY_ACTION') AS capacity_event_count,
    coalesce(sum(severity) FILTER (WHERE signal_type = 'INVENTORY_TIGHTENING'), 0) AS tightening_score,
    avg(confidence) AS mean FROM signals WHERE detected_at >= TIMESTAMP '1998-03-31 12:00:00'
    AND detected_at <= TIMESTAMP '1998-04-01 12:00:00' GROUP BY 1, 2)),
  reg AS (SELECT *, CASE WHEN price_trend = 'UP' AND tightening_score > 0 AND confidence > 0.7 THEN 'DEMAND_SURGE'
    WHEN price_trend = 'DOWN' AND tightening_score <= 0 AND confidence < 0.4 THEN 'DEMAND_SOFT'
    WHEN price_trend = 'FLAT' AND tightening_score > 0 THEN 'YIELD_PROTECTION'
    WHEN abs(net_price_delta) > 0 AND tightening_score = 0 THEN 'MARKET_TESTING'
    WHEN price_trend = 'FLAT' AND tightening_score = 0 THEN 'STABLE' ELSE 'UNKNOWN' END AS market_regime FROM agg)"""


def aggregated(ctx):
    return market.aggregate_signals(signals(ctx), datetime(1998, 4, 1, 12), 24)


@query("aggregate_signals", "airline:s flight_key:s pricing_event_count:i net_price_delta:d2 price_trend:s "
       "capacity_event_count:i tightening_score:d2 capacity_trend:s confidence:d2 demand_signal:s",
       sql("SELECT * FROM agg", needs="changes", ctes=_AGG))
def _aggregate(ctx):
    return aggregated(ctx)


@query("market_regime", "airline:s flight_key:s market_regime:s", sql("SELECT * FROM reg", needs="changes", ctes=_AGG))
def _market_regime(ctx):
    return market.market_regime(aggregated(ctx))


@query("market_alerts", "airline:s flight_key:s alert_type:s severity:s message:s", sql("""
  SELECT airline, flight_key, 'DEMAND_SURGE' AS alert_type, 'CRITICAL' AS severity,
    'Strong demand surge detected with price increase and seat tightening.' AS message FROM reg
    WHERE market_regime = 'DEMAND_SURGE'
  UNION ALL SELECT airline, flight_key, 'YIELD_PROTECTION', 'HIGH',
    'Yield protection behavior detected (inventory tightening without price change).' FROM reg
    WHERE market_regime = 'YIELD_PROTECTION'
  UNION ALL SELECT airline, flight_key, 'PRICE_DROP', 'MEDIUM', 'Price drop detected under weak demand conditions.' FROM reg
    WHERE net_price_delta < 0 AND confidence < 0.4
  UNION ALL SELECT airline, flight_key, 'MARKET_TESTING', 'LOW', 'Airline appears to be testing price elasticity.' FROM reg
    WHERE market_regime = 'MARKET_TESTING'""", needs="changes", ctes=_AGG))
def _alerts(ctx):
    return market.alerts(market.market_regime(aggregated(ctx)))


PRIORS = market.MarketPriors(labor_origins=("X",), middle_east=("Z",), ksa_airports=("R3",), thailand_airports=("R2",),
                             hub_spoke_airlines=("A0",), lcc_airlines=("A1",), return_oriented_airlines=("A2",),
                             yield_high=("R0-R1",), yield_tourism=("R0-R2",), yield_balanced=("R1-R0",),
                             visa_max_days=10200, short_max_days=10800, mid_max_days=11400, long_max_days=12000)
_C = "coalesce(CASE {x} WHEN 'R0' THEN 'X' WHEN 'R1' THEN 'X' WHEN 'R2' THEN 'Y' WHEN 'R3' THEN 'Z' END, 'UNK')"


@query("market_priors", "airline:s route_key:s dtd:i origin_country:s destination_country:s market_is_middle_east:i "
       "market_is_ksa:i market_is_thailand_tourism:i market_is_labor_outbound:i market_is_labor_return:i "
       "airline_is_hub_spoke:i airline_is_lcc:i airline_is_return_oriented:i airline_model_proxy:s "
       "trip_purpose_proxy:s yield_class_proxy:s horizon_is_visa_window:i horizon_is_long_window:i "
       "horizon_bucket_proxy:s n:i", sql("""SELECT *, f AS origin_country, t AS destination_country,
  (f = 'Z' OR t = 'Z')::INT AS market_is_middle_east, (o = 'R3' OR d = 'R3')::INT AS market_is_ksa,
  (o = 'R2' OR d = 'R2')::INT AS market_is_thailand_tourism, (f = 'X' AND t = 'Z')::INT AS market_is_labor_outbound,
  (f = 'Z' AND t = 'X')::INT AS market_is_labor_return, (airline = 'A0')::INT AS airline_is_hub_spoke,
  (airline = 'A1')::INT AS airline_is_lcc, (airline = 'A2')::INT AS airline_is_return_oriented,
  CASE airline WHEN 'A0' THEN 'hub_spoke' WHEN 'A1' THEN 'lcc' ELSE 'hybrid' END AS airline_model_proxy,
  CASE WHEN f = 'X' AND t = 'Z' THEN 'labor_outbound' WHEN f = 'Z' AND t = 'X' THEN 'labor_return'
    WHEN o = 'R2' OR d = 'R2' THEN 'tourism' ELSE 'general' END AS trip_purpose_proxy,
  CASE WHEN route_key = 'R1-R0' THEN 'balanced' WHEN route_key = 'R0-R2' THEN 'tourism' WHEN route_key = 'R0-R1'
    THEN 'high' WHEN o = 'R3' OR d = 'R3' THEN 'high' WHEN f = 'Z' OR t = 'Z' THEN 'medium_high' ELSE 'unknown' END
    AS yield_class_proxy, (dtd <= 10200)::INT AS horizon_is_visa_window, (dtd >= 11400)::INT AS horizon_is_long_window,
  CASE WHEN dtd <= 10200 THEN 'D0_visa' WHEN dtd <= 10800 THEN 'D8_30' WHEN dtd <= 11400 THEN 'D31_90'
    WHEN dtd <= 12000 THEN 'D91_180' ELSE 'D181p' END AS horizon_bucket_proxy
  FROM (SELECT airline, origin AS o, destination AS d, origin || '-' || destination AS route_key,
    date_diff('day', CAST(captured_at AS DATE), CAST(departure AS DATE)) AS dtd, """ + _C.format(x="origin")
       + " AS f, " + _C.format(x="destination") + " AS t, count(*) AS n FROM offers GROUP BY ALL)"))
def _priors(ctx):
    rows = ctx.offers.groupBy("airline", "origin", "destination", F.datediff(
        F.to_date("departure"), F.to_date("captured_at")).alias("dtd")).agg(F.count("*").alias("n"))
    return market.apply_market_priors(rows, PRIORS, ctx.airports, "dtd")
