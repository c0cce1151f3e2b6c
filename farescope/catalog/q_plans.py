"""Queries over search plans, scans, file sources and sinks."""

from datetime import date, datetime

from pyspark.sql import functions as F

from farescope.catalog.base import query, sql
from farescope.catalog.q_forecast import _BT, _SELECTED, LONG as _LONG, metrics_sql as _metrics_sql
from farescope.catalog.q_quality import _MESSAGE
from farescope.plans import search
from farescope.session import work_dir
from farescope.sources import files, scans

# ---------------------------------------------------------------- search plans

_ORD = "CAST(o_orderdate AS DATE)"


def _orders(ctx):
    return ctx.table("orders").withColumn("day", F.to_date("o_orderdate"))


@query("expand_dates", "key:i date:D", sql(f"""SELECT o_orderkey AS key, CAST(unnest(generate_series({_ORD},
  {_ORD} + CAST(o_orderkey % 5 AS INT), INTERVAL 1 DAY)) AS DATE) AS date FROM orders""", needs=""))
def _expand(ctx):
    rows = _orders(ctx).select(F.col("o_orderkey").alias("key"), F.col("day").alias("end_date"),
                               F.expr("date_add(day, CAST(o_orderkey % 5 AS INT))").alias("start_date"))
    return search.expand_dates(rows)


@query("search_windows", "key:i position:i departure_date:D return_date:D", sql(f"""SELECT key, row_number() OVER (PARTITION BY key
  ORDER BY dep, k, ret) - 1 AS position, dep AS departure_date, ret AS return_date FROM (
  SELECT o_orderkey AS key, {_ORD} + d AS dep, NULL::DATE AS ret, 0 AS k FROM orders, (VALUES (0), (2)) x(d)
    WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey, {_ORD} + d, {_ORD} + r, 0 FROM orders, (VALUES (0), (2)) x(d), (VALUES (1), (4)) y(r)
    WHERE o_orderkey % 2 = 1 AND r >= d
  UNION ALL SELECT o_orderkey, {_ORD} + d, {_ORD} + d + 7, 1 FROM orders, (VALUES (0), (2)) x(d) WHERE o_orderkey % 2 = 1)""",
       needs=""))
def _windows(ctx):
    plans = _orders(ctx).select(
        F.col("o_orderkey").alias("key"), F.expr("array(day, date_add(day, 2), day)").alias("outbound_dates"),
        F.expr("CASE WHEN o_orderkey % 2 = 1 THEN array(date_add(day, 1), date_add(day, 4)) END").alias("return_dates"),
        F.expr("CASE WHEN o_orderkey % 2 = 1 THEN array(7, 7) END").alias("return_offsets"),
        F.expr("CASE WHEN o_orderkey % 2 = 1 THEN 'round-trip' END").alias("trip_type"))
    return search.search_windows(plans)


@query("trip_context", "key:i trip_request_id:s search_trip_type:s requested_return_date:D trip_duration_days:i trip_origin:s "
       "leg_direction:s leg_sequence:i itinerary_leg_count:i", sql(f"""SELECT key, substr(sha256('{{"adt": ' || adt ||
  ', "cabin": "Economy", "chd": 0, "departure_date": "' || strftime(d, '%Y-%m-%d') || '", "destination": "R1", "inf": 0, "origin": "R0", ' ||
  '"return_date": ' || CASE WHEN rt THEN '"' || strftime(d + 3, '%Y-%m-%d') || '"' ELSE 'null' END || ', "trip_type": "' ||
  CASE WHEN rt THEN 'RT' ELSE 'OW' END || '"}}'), 1, 24) AS trip_request_id, CASE WHEN rt THEN 'RT' ELSE 'OW' END AS search_trip_type,
  CASE WHEN rt THEN d + 3 END AS requested_return_date, CASE WHEN rt THEN 3 END AS trip_duration_days, 'R0' AS trip_origin,
  CASE WHEN key % 3 = 0 THEN 'inbound' ELSE 'outbound' END AS leg_direction, CASE WHEN key % 3 = 0 THEN 2 ELSE 1 END AS leg_sequence,
  CASE WHEN rt THEN 2 ELSE 1 END AS itinerary_leg_count FROM (SELECT o_orderkey AS key, {_ORD} AS d, o_orderkey % 2 = 1 AS rt,
  greatest(1, o_orderkey % 4) AS adt FROM orders)""", needs=""))
def _trip(ctx):
    rows = _orders(ctx).select(
        F.col("o_orderkey").alias("key"), F.lit(" r0").alias("origin"), F.lit("R1 ").alias("destination"),
        F.col("day").alias("departure_date"), F.expr("date_add(day, 3)").alias("return_date"), F.lit("Economy").alias("cabin"),
        F.expr("CAST(o_orderkey % 4 AS INT)").alias("adt"), F.lit(None).cast("int").alias("chd"), F.lit(0).alias("inf"),
        F.expr("CASE WHEN o_orderkey % 2 = 1 THEN 'ROUNDTRIP' ELSE 'OW' END").alias("trip_type"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'Return' END").alias("leg_direction"),
        F.lit(None).cast("int").alias("leg_sequence"), F.lit(None).cast("int").alias("itinerary_leg_count"))
    return search.trip_context(rows)


def _routes(ctx):
    """Route configuration from suppliers: a position, carrier, route and cabins."""
    nation = ctx.table("nation")
    return ctx.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
        "s_suppkey AS position", "concat('A', s_suppkey % 7) AS airline", "concat('R', n_regionkey) AS origin",
        "concat('R', s_suppkey % 3) AS destination", "CASE WHEN s_suppkey % 4 = 0 THEN array('F', 'O') WHEN s_suppkey % 4 = 1 "
        "THEN array('O') ELSE CAST(array() AS array<string>) END AS cabins")


_ROUTES = """rts AS (SELECT s_suppkey AS position, concat('A', s_suppkey % 7) AS airline, concat('R', n_regionkey) AS origin,
  concat('R', s_suppkey % 3) AS destination, CASE WHEN s_suppkey % 4 = 0 THEN ['F', 'O'] WHEN s_suppkey % 4 = 1 THEN ['O']
  ELSE [] END AS cabins FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def _overrides(ctx):
    return ctx.table("part").selectExpr(
        "CASE WHEN p_partkey % 3 = 0 THEN concat('A', p_partkey % 7) END AS airline", "concat('R', p_partkey % 5) AS origin",
        "concat('R', p_size % 3) AS destination", "p_partkey AS position", "CASE WHEN p_partkey % 2 = 0 THEN 'RT' END AS trip_type",
        "CASE WHEN p_partkey % 4 = 1 THEN array(DATE'2030-02-01', DATE'2030-02-02') END AS outbound_dates",
        "CAST(NULL AS array<date>) AS return_dates", "CASE WHEN p_partkey % 2 = 0 THEN array(5) END AS return_offsets",
        "concat('rule ', p_partkey) AS source")


_OVER = """ov AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN concat('A', p_partkey % 7) END AS airline,
  concat('R', p_partkey % 5) AS origin, concat('R', p_size % 3) AS destination, p_partkey AS position FROM part),
  rk AS (SELECT DISTINCT airline, origin, destination FROM rts),
  mt AS (SELECT rk.*, ov.position FROM rk JOIN ov USING (airline, origin, destination)
    UNION ALL SELECT rk.*, ov.position FROM rk JOIN ov ON ov.airline IS NULL AND ov.origin = rk.origin
      AND ov.destination = rk.destination WHERE NOT EXISTS (SELECT 1 FROM ov o2 WHERE o2.airline = rk.airline
      AND o2.origin = rk.origin AND o2.destination = rk.destination))"""


def _route_keys(ctx):
    return _routes(ctx).select("airline", "origin", "destination").distinct()


@query("match_overrides", "airline:s origin:s destination:s position:i", sql("SELECT * FROM mt", needs="",
       ctes=_ROUTES + ", " + _OVER))
def _match(ctx):
    return search.match_overrides(_route_keys(ctx), _overrides(ctx))


@query("match_first_override", "airline:s origin:s destination:s position:i", sql("""SELECT airline, origin, destination,
  min(position) AS position FROM mt GROUP BY 1, 2, 3""", needs="", ctes=_ROUTES + ", " + _OVER))
def _match_first(ctx):
    return search.match_overrides(_route_keys(ctx), _overrides(ctx), first_only=True)


@query("resolve_trip_plan", "airline:s origin:s destination:s trip_type:s outbound_dates:a return_offsets:a source:s", sql("""
  SELECT rk.*, CASE WHEN position % 2 = 0 THEN 'RT' ELSE 'OW' END AS trip_type, CASE WHEN position % 4 = 1
  THEN ['2030-02-01', '2030-02-02'] ELSE ['2030-01-01'] END AS outbound_dates, CASE WHEN position % 2 = 0 THEN ['5'] ELSE [] END
  AS return_offsets, CASE WHEN position % 2 = 0 OR position % 4 = 1 THEN 'rule ' || position ELSE 'global' END AS source
  FROM rk LEFT JOIN mt USING (airline, origin, destination)""", needs="", ctes=_ROUTES + ", " + _OVER))
def _resolve(ctx):
    return search.resolve_trip_plan(_route_keys(ctx), _overrides(ctx), [date(2030, 1, 1)])


_SEL, _EN = ["A0", "A1", "A2", "A3"], ["A0", "A1", "A2", "A3", "A4", "A5"]


_AUDIT = """
  SELECT 'duplicate' AS issue, airline, origin, destination, array_to_string(cabins, '|') AS detail FROM rts
    GROUP BY airline, origin, destination, cabins HAVING count(*) > 1
  UNION ALL SELECT 'unknown_airline', airline, origin, destination, CAST(position AS VARCHAR) FROM rts WHERE airline = 'A6'
  UNION ALL SELECT 'not_selected_airline', airline, origin, destination, CAST(position AS VARCHAR) FROM rts WHERE airline IN ('A4', 'A5')
  UNION ALL SELECT 'unknown_airport', airline, origin, destination, 'origin:' || origin FROM rts WHERE origin = 'R4'
  UNION ALL SELECT 'missing_reverse', airline, origin, destination, NULL FROM (SELECT DISTINCT airline, origin, destination FROM rts) r
    WHERE NOT EXISTS (SELECT 1 FROM rts b WHERE b.airline = r.airline AND b.origin = r.destination AND b.destination = r.origin)"""


@query("audit_routes", "issue:s airline:s origin:s destination:s detail:s", sql(_AUDIT, needs="", ctes=_ROUTES))
def _audit(ctx):
    return search.audit_routes(_routes(ctx), _SEL, _EN, ctx.airports)


@query("audit_route_counts", "issue:s rows:i", sql("""SELECT 'routes:' || airline AS issue, count(*) AS rows FROM rts
  WHERE airline IN ('A0', 'A1', 'A2', 'A3') GROUP BY 1 UNION ALL SELECT issue, count(*) FROM (""" + _AUDIT + ") GROUP BY 1",
       needs="", ctes=_ROUTES))
def _audit_counts(ctx):
    return search.audit_counts(_routes(ctx), _SEL, _EN, ctx.airports)


@query("stale_targets", "position:i airline:s origin:s destination:s cabin:s latest_captured_at:t", sql("""SELECT * FROM (
  SELECT position, airline, origin, destination, unnest(CASE WHEN len(cabins) > 0 THEN cabins ELSE ['Economy'] END) AS cabin FROM rts)
  LEFT JOIN (SELECT airline, origin, destination, cabin, max(captured_at) AS latest_captured_at FROM offers GROUP BY 1, 2, 3, 4)
    USING (airline, origin, destination, cabin)
  WHERE latest_captured_at IS NULL OR latest_captured_at < TIMESTAMP '2001-11-01'""", ctes=_ROUTES))
def _stale(ctx):
    return search.stale_targets(_routes(ctx), ctx.offers, datetime(2001, 11, 1))


@query("build_capture_jobs", "carrier:s origin:s destination:s date:D cabin:s n:i", sql("""SELECT airline AS carrier, origin, destination,
  date, 'Economy' AS cabin, count(*) AS n FROM rts, (VALUES (DATE '2030-01-01'), (DATE '2030-01-02')) d(date)
  WHERE airline IN ('A1', 'A2') GROUP BY ALL""", needs="", ctes=_ROUTES))
def _jobs(ctx):
    jobs = search.build_jobs(_routes(ctx), [date(2030, 1, 1), date(2030, 1, 2)], "Economy", ["A1", "A2"])
    return jobs.groupBy(*jobs.columns).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- scans


@query("scan_offers", "offer_id:s captured_at:t airline:s", sql("""SELECT offer_id, captured_at, airline FROM offers WHERE
  CAST(captured_at AS DATE) >= DATE '1996-01-01' AND CAST(captured_at AS DATE) <= DATE '1996-03-31' AND airline IN ('A1', 'A4')
  AND origin = 'R1' AND cabin = 'F'"""))
def _scan(ctx):
    filters = scans.Filters(date(1996, 1, 1), date(1996, 3, 31), ["a1", "A4"], "r1", cabin="F")
    return scans.scan_offers(ctx.offers, filters)


@query("scan_offers_today", "airline:s offers:i", sql("""SELECT airline, count(*) AS offers FROM offers
  WHERE CAST(captured_at AS DATE) = DATE '1996-05-05' GROUP BY 1"""))
def _scan_today(ctx):
    rows = scans.scan_offers(ctx.offers, scans.Filters(), date(1996, 5, 5))
    return rows.groupBy("airline").agg(F.count("*").alias("offers"))


@query("scan_stored_offers", "airline:s capture_date:D offers:i price:d2", sql("""SELECT airline, CAST(captured_at AS DATE) AS capture_date,
  count(*) AS offers, sum(price_total) AS price FROM offers WHERE CAST(captured_at AS DATE) BETWEEN DATE '1997-02-01' AND DATE '1997-02-10'
  AND destination = 'R2' GROUP BY 1, 2"""))
def _scan_stored(ctx):
    path = work_dir(ctx.spark, "offers")
    scans.write_offers(ctx.offers.repartitionByRange("captured_at"), path, by_month=True)
    rows = scans.scan_offers(scans.read_offers(ctx.spark, path), scans.Filters(date(1997, 2, 1), date(1997, 2, 10), destination="R2"))
    return rows.groupBy("airline", "capture_date").agg(F.count("*").alias("offers"), F.sum("price_total").alias("price"))


@query("scan_daily", "airline:s origin:s report_day:D total_change_events:i", sql("""SELECT airline, origin, report_day, total_change_events
  FROM daily WHERE report_day >= DATE '2024-01-10' AND origin = 'R1'""", needs="daily"))
def _scan_daily(ctx):
    return scans.scan_daily(ctx.daily, scans.Filters(date(2024, 1, 10), origin="R1"))


@query("offers_with_meta", "offer_id:s stops:i tax_amount:d2", sql(
    "SELECT offer_id, stops, tax_amount FROM offers LEFT JOIN meta USING (offer_id)", needs="offers meta"))
def _plain(ctx):
    return scans.offers_with_meta(ctx.offers.select("offer_id"), ctx.meta_with("stops tax_amount"))


@query("offers_with_latest_meta", "offer_id:s stops:i tax_amount:d2", sql("""SELECT offer_id, stops, tax_amount FROM offers LEFT JOIN
  (SELECT * FROM meta QUALIFY row_number() OVER (PARTITION BY offer_id ORDER BY meta_id DESC) = 1) USING (offer_id)""",
       needs="offers meta"))
def _latest(ctx):
    return scans.offers_with_latest_meta(ctx.offers.select("offer_id"), ctx.meta_with("stops tax_amount"))


# ---------------------------------------------------------------- files

_LEGACY = """lg AS (SELECT concat('A', l_suppkey % 5) AS airline, 'F' || l_partkey % 3 AS flight_number, 'R' || l_suppkey % 4 AS origin,
  'R' || l_partkey % 4 AS destination, TIMESTAMP '2030-03-01 10:30:00' AS departure, l_linestatus AS cabin, l_returnflag AS brand,
  CAST(l_partkey % 11 AS VARCHAR) AS fare_basis, CAST(l_extendedprice AS DECIMAL(12,2)) AS price_total,
  CASE WHEN l_quantity > 1 THEN CAST(l_quantity AS INT) END AS seat_available, l_linenumber = 1 AS soldout,
  TIMESTAMP '2024-01-02 03:04:05' AS captured_at FROM lineitem WHERE l_partkey % 10 <> 0)"""
_LG_FIRST = """SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY airline, origin, destination, departure, flight_number, cabin,
  fare_basis, brand ORDER BY price_total, seat_available NULLS LAST) = 1"""
_LG_COLS = ("airline:s flight_number:s origin:s destination:s departure:t cabin:s brand:s fare_basis:s price_total:d2 "
            "seat_available:i captured_at:t inventory_confidence:s")


def _archive(ctx, fmt):
    line = ctx.table("lineitem")
    rows = line.selectExpr(
        "concat('a', l_suppkey % 5) AS airlineCode", "concat('F', l_partkey % 3) AS flightNumber",
        "concat('r', l_suppkey % 4) AS origin", "concat('R', l_partkey % 4) AS task_destination",
        "CASE l_linenumber % 3 WHEN 0 THEN '2030-03-01T10:30:00Z' WHEN 1 THEN '3/1/2030 10:30:00' ELSE '2030-03-01 10:30:00' END AS departure",
        "l_linestatus AS cabinClass", "l_returnflag AS brandId", "CAST(l_partkey % 11 AS STRING) AS bookingClass",
        "CASE WHEN l_partkey % 10 = 0 THEN 'None' ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING) END AS total_amount",
        "CASE WHEN l_quantity > 1 THEN CAST(l_quantity AS STRING) ELSE '' END AS seatsRemaining",
        "CASE WHEN l_linenumber = 1 THEN 'Yes' ELSE 'no' END AS soldout", "l_orderkey")
    path = f"{work_dir(ctx.spark, 'archive')}/combined_results_20240102T030405Z.{fmt}"
    if fmt == "csv":
        rows.drop("l_orderkey").write.option("header", True).csv(path)
    else:
        fields = [c for c in rows.columns if c != "l_orderkey"]
        lines = rows.groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.struct(*fields))).alias("value"))
        lines.select("value").write.text(path)
    return files.read_legacy(ctx.spark, path, fmt, multi_line=False)


@query("read_legacy_csv", _LG_COLS, sql(f"""SELECT *, CASE WHEN seat_available IS NULL THEN 'unknown' ELSE 'reported' END
  AS inventory_confidence FROM ({_LG_FIRST})""", needs="", ctes=_LEGACY))
def _legacy_csv(ctx):
    offers, meta = _archive(ctx, "csv")
    return offers.join(meta.select("offer_id", "inventory_confidence"), "offer_id")


@query("read_legacy_json", "airline:s offers:i price:d2 cycles:i", sql(f"""SELECT airline, count(*) AS offers, sum(price_total) AS price,
  1 AS cycles FROM ({_LG_FIRST}) GROUP BY 1""", needs="", ctes=_LEGACY))
def _legacy_json(ctx):
    offers, _ = _archive(ctx, "json")
    return offers.groupBy("airline").agg(F.count("*").alias("offers"), F.sum("price_total").alias("price"),
                                         F.countDistinct("cycle_id").alias("cycles"))


@query("read_results_dump", "airline:s rows:i price:d2", sql("""SELECT concat('A', l_suppkey % 5) AS airline, count(*) AS rows,
  sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS price FROM lineitem GROUP BY 1""", needs=""))
def _results(ctx):
    item = F.expr("named_struct('airline', concat('A', l_suppkey % 5), 'price', CAST(l_extendedprice AS DECIMAL(12,2)))")
    line = ctx.table("lineitem")
    path = work_dir(ctx.spark, "results")
    arrays = line.where("l_orderkey % 2 = 0").groupBy("l_orderkey").agg(F.to_json(F.collect_list(item)).alias("value"))
    single = line.where("l_orderkey % 2 = 1").select(F.to_json(item).alias("value"))
    arrays.select("value").unionByName(single).write.text(path)
    rows = files.read_results(ctx.spark, path, "airline string, price decimal(12,2)")
    return rows.groupBy("airline").agg(F.count("*").alias("rows"), F.sum("price").alias("price"))


_LINE_SQL = f"""SELECT upper(event_type) AS level, ts, {_MESSAGE} AS message FROM events"""


@query("read_logs", "level:s lines:i first_ts:t last_ts:t", sql(f"""SELECT level, count(*) AS lines, min(ts) AS first_ts, max(ts) AS last_ts
  FROM ({_LINE_SQL}) GROUP BY 1""", needs=""))
def _logs(ctx):
    path = work_dir(ctx.spark, "logs")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",123  ["), F.upper("event_type"), F.lit("] core.run: "),
                    F.expr(_MESSAGE))
    lines = ctx.table("events").select(F.explode(F.array(text, F.lit("  trace line"))).alias("value"))
    lines.write.text(path)
    return files.read_logs(ctx.spark, path).groupBy("level").agg(
        F.count("*").alias("lines"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


_EVAL_SCHEMA = "model string, n int, mae double, rmse double"


def bundles(ctx):
    """Forecast bundle files written from the daily series: two targets, two stamps."""
    from farescope.catalog.q_forecast import K, PREDS, T, predicted
    from farescope.operators import forecast

    root = work_dir(ctx.spark, "bundles")
    overall, routes = forecast.evaluate(predicted(ctx), T, PREDS, K)
    small, by_route = overall.select("model", "n", "mae", "rmse"), routes.select(
        *K, F.col("airline").alias("destination"), "model", "n", "mae", "rmse")
    for stamp, target in (("20240101_000000", "total_change_events"), ("20240102_000000", "price_events")):
        base = f"{root}/run_{target}"
        small.write.option("header", True).csv(f"{base}/prediction_eval_{target}_{stamp}.csv")
        by_route.write.option("header", True).csv(f"{base}/prediction_eval_by_route_{target}_{stamp}.csv")
    name = "price_events_20240102_000000.csv"
    small.write.option("header", True).csv(f"{root}/run_price_events/prediction_backtest_eval_{name}")
    by_route.write.option("header", True).csv(f"{root}/run_price_events/prediction_backtest_eval_by_route_{name}")
    ahead = forecast.next_day(ctx.daily, T, (3, 7), 3, 7, 0.3, K).select(
        *K, F.col("airline").alias("destination"), "predicted_for_day", "latest_actual_value", "pred_rolling_mean_3")
    ahead.write.option("header", True).csv(f"{root}/run_price_events/prediction_next_day_{name}")
    return root


@query("scan_bundles", "bundle_id:s bundle_name:s target:s stamp:s has_overall_eval:b has_route_eval:b has_backtest_eval:b "
       "has_next_day:b", sql("""SELECT * FROM (VALUES
  ('run_total_change_events|total_change_events|20240101_000000', 'run_total_change_events', 'total_change_events', '20240101_000000', true, true, false, false),
  ('run_price_events|price_events|20240102_000000', 'run_price_events', 'price_events', '20240102_000000', true, true, true, true))
  v(bundle_id, bundle_name, target, stamp, has_overall_eval, has_route_eval, has_backtest_eval, has_next_day)""", needs=""))
def _bundles(ctx):
    return files.scan_bundles(ctx.spark, bundles(ctx))


@query("load_bundle_fact", "bundle_id:s target:s stamp:s route_key:s model:s n:i mae:d rmse:d mape_pct:d", sql(f"""
  SELECT 'run_' || t.target || '|' || t.target || '|' || t.stamp AS bundle_id, t.target, t.stamp, origin || '-' || airline AS route_key,
  model, n, mae, rmse, NULL AS mape_pct FROM ({_metrics_sql('airline, origin')}), (VALUES ('total_change_events', '20240101_000000'),
  ('price_events', '20240102_000000')) t(target, stamp)""", needs="daily", ctes=_LONG))
def _fact(ctx):
    schema = "airline string, origin string, destination string, model string, n int, mae double, rmse double"
    return files.load_bundle_fact(ctx.spark, bundles(ctx), "eval_by_route", schema, ["mape_pct"])


@query("latest_bundle_eval", "bundle_id:s target:s stamp:s model:s n:i mae:d", sql(f"""SELECT
  'run_price_events|price_events|20240102_000000' AS bundle_id, 'price_events' AS target, '20240102_000000' AS stamp, model, n, mae
  FROM ({_metrics_sql('')})""", needs="daily", ctes=_LONG))
def _latest_bundle(ctx):
    from farescope.operators.forecast import latest_bundle

    root = bundles(ctx)
    facts = files.load_bundle_fact(ctx.spark, root, "eval", _EVAL_SCHEMA)
    return latest_bundle(files.scan_bundles(ctx.spark, root), facts, "has_backtest_eval")


_NEWEST = "'run_price_events|price_events|20240102_000000' AS bundle_id, origin || '-' || airline AS route_key"
_ROUTE_EVAL = "airline string, origin string, destination string, model string, n int, mae double, rmse double"


def _newest(ctx, kind, schema, needs=None, declared=()):
    from farescope.operators.forecast import latest_bundle

    root = bundles(ctx)
    return latest_bundle(files.scan_bundles(ctx.spark, root), files.load_bundle_fact(ctx.spark, root, kind, schema, declared), needs)


@query("latest_bundle_routes", "bundle_id:s route_key:s airline:s model:s n:i mae:d rmse:d", sql(
    f"SELECT {_NEWEST}, * FROM ({_metrics_sql('airline, origin')})", needs="daily", ctes=_LONG))
def _newest_routes(ctx):
    return _newest(ctx, "eval_by_route", _ROUTE_EVAL)


_WINNERS = f"""SELECT {_NEWEST}, model AS winner_model, n AS winner_n, mae AS winner_mae FROM (SELECT *, max(n) OVER (
  PARTITION BY airline, origin) AS mx FROM ({_metrics_sql('airline, origin')}) WHERE n > 0 AND mae IS NOT NULL) WHERE n >= floor(mx * 0.8)
  QUALIFY row_number() OVER (PARTITION BY airline, origin ORDER BY mae, rmse, model) = 1"""


def _winners(ctx, kind, needs=None):
    from farescope.operators.forecast import winner_table

    return winner_table(_newest(ctx, kind, _ROUTE_EVAL, needs, ["directional_accuracy_pct", "f1_macro"]), ["bundle_id", "route_key"])


@query("latest_bundle_route_winners", "bundle_id:s route_key:s winner_model:s winner_n:i winner_mae:d", sql(_WINNERS, needs="daily", ctes=_LONG))
def _newest_winners(ctx):
    return _winners(ctx, "eval_by_route")


@query("latest_backtest_route_winners", "bundle_id:s route_key:s winner_model:s winner_n:i winner_mae:d", sql(_WINNERS, needs="daily", ctes=_LONG))
def _newest_backtest_winners(ctx):
    return _winners(ctx, "backtest_eval_by_route", "has_backtest_route_eval")


@query("latest_backtest_eval", "bundle_id:s model:s n:i mae:d rmse:d", sql(f"""SELECT 'run_price_events|price_events|20240102_000000' AS bundle_id, *
  FROM ({_metrics_sql('')})""", needs="daily", ctes=_LONG))
def _newest_backtest(ctx):
    return _newest(ctx, "backtest_eval", _EVAL_SCHEMA, "has_backtest_eval")


@query("latest_bundle_next_day", "bundle_id:s route_key:s predicted_for_day:D latest_actual_value:d pred_rolling_mean_3:d", sql(f"""SELECT {_NEWEST},
  max(report_day) + 1 AS predicted_for_day, max(y) FILTER (WHERE back = 1) AS latest_actual_value, avg(y) FILTER (WHERE back <= 3) AS pred_rolling_mean_3
  FROM (SELECT *, CAST(total_change_events AS DOUBLE) AS y, row_number() OVER (PARTITION BY airline, origin ORDER BY report_day DESC) AS back
  FROM daily) GROUP BY airline, origin HAVING count(*) >= 3""", needs="daily"))
def _newest_next_day(ctx):
    return _newest(ctx, "next_day", "airline string, origin string, destination string, predicted_for_day date, latest_actual_value double, "
                   "pred_rolling_mean_3 double", "has_next_day")


@query("best_models", "target:s best_model_by_mae:s n:i mae:d", sql(f"""SELECT target, model AS best_model_by_mae, n, mae FROM (
  {_metrics_sql('')} ORDER BY mae, model LIMIT 1), (VALUES ('total_change_events'), ('price_events')) t(target)""", needs="daily",
       ctes=_LONG))
def _best(ctx):
    from farescope.operators.quality import best_models

    facts = files.load_bundle_fact(ctx.spark, bundles(ctx), "eval", _EVAL_SCHEMA, ["smape_pct", "directional_accuracy_pct", "f1_macro"])
    return best_models(facts)


@query("backtest_summary", "target:s rows_used:i mean_mae:d mean_rmse:d", sql(f"""SELECT 'total_change_events' AS target,
  count(*) AS rows_used, avg(mae) AS mean_mae, avg(rmse) AS mean_rmse FROM ({_metrics_sql('split_id, dataset', 'bl')}) m
  JOIN ({_SELECTED}) b USING (split_id) WHERE dataset = 'test' AND model = selected_model""", needs="daily", ctes=_BT))
def _summary(ctx):
    from farescope.catalog.q_forecast import _backtest, T
    from farescope.operators.quality import backtest_summary

    return backtest_summary(_backtest(ctx)["metrics"].withColumn("target", F.lit(T)))


@query("write_stage", "airline:s rows:i first_route:s", sql("""SELECT airline, count(*) AS rows, min('["' || origin || '","' || destination || '"]')
  AS first_route FROM offers GROUP BY 1"""))
def _stage(ctx):
    path = work_dir(ctx.spark, "stage")
    files.write_stage(ctx.offers.select("airline", "cabin", F.array("origin", "destination").alias("route")), path, ["cabin"])
    return ctx.spark.read.parquet(path).groupBy("airline").agg(F.count("*").alias("rows"), F.min("route").alias("first_route"))


@query("load_table", "airline:s rows:i with_cabin:i", sql("""SELECT airline, count(*) * 2 AS rows, count(cabin) AS with_cabin
  FROM offers GROUP BY 1"""))
def _load(ctx):
    path = work_dir(ctx.spark, "table")
    files.load_table(ctx.offers.select("offer_id"), path, "replace")
    files.load_table(ctx.offers.select("offer_id", "airline", "cabin"), path, "replace")
    files.load_table(ctx.offers.select("airline", "offer_id").withColumn("extra", F.lit(1)), path, "append")
    return ctx.spark.read.parquet(path).groupBy("airline").agg(F.count("*").alias("rows"), F.count("cabin").alias("with_cabin"))


@query("write_csv_pair", "airline:s offers:i", sql("SELECT airline, count(*) AS offers FROM offers GROUP BY 1"))
def _csv_pair(ctx):
    report = ctx.offers.groupBy("airline").agg(F.count("*").alias("offers"))
    _, latest = files.write_csv_pair(report, work_dir(ctx.spark, "reports"), "airlines", "20240101_000000")
    return ctx.spark.read.option("header", True).schema("airline string, offers bigint").csv(latest)
