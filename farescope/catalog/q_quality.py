"""Queries over data quality, service levels, log health and risk."""

from datetime import datetime

from pyspark.sql import functions as F

from farescope.catalog.base import query, sql
from farescope.catalog.q_cycles import ROUTES_CTE, expected_routes
from farescope.catalog.q_rollups import AVAILABILITY_DAILY, PRICE_DAILY, ROUTE_SUMMARY
from farescope.operators import quality, rollups
from farescope.operators.quality import CORE_FIELDS, META_FIELDS

_LM = ("lm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY meta_id DESC) AS rn "
       "FROM meta) WHERE rn = 1)")


@query("dq_summary", "total_rows:i cycle_count:i observed_route_count:i min_captured_at:t max_captured_at:t", sql("""
  SELECT count(*) AS total_rows, count(DISTINCT cycle_id) AS cycle_count,
    count(DISTINCT airline || '|' || origin || '|' || destination) AS observed_route_count,
    min(captured_at) AS min_captured_at, max(captured_at) AS max_captured_at FROM offers"""))
def _summary(ctx):
    return quality.dq_summary(ctx.offers)


_DUP = """dup AS (SELECT coalesce(sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END), 0) AS duplicate_rows,
  coalesce(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END), 0) AS duplicate_keys FROM (SELECT count(*) AS n FROM offers
  GROUP BY cycle_id, airline, origin, destination, flight_number, departure, coalesce(cabin, ''),
  coalesce(fare_basis, ''), coalesce(brand, '')))"""


@query("dq_duplicates", "duplicate_rows:i duplicate_keys:i", sql("SELECT * FROM dup", ctes=_DUP))
def _duplicates(ctx):
    return quality.dq_duplicates(ctx.offers)


def _null_sql(fields, scope, table):
    return " UNION ALL ".join(
        f"SELECT '{scope}' AS scope, '{f}' AS field, count(*) FILTER (WHERE {f} IS NULL) AS null_count, "
        f"count(*) AS rows_seen, round(count(*) FILTER (WHERE {f} IS NULL) / count(*) * 100.0, 4) AS null_rate_pct "
        f"FROM {table}" for f in fields)


_NULLS = (_null_sql(CORE_FIELDS, "null_core", "offers") + " UNION ALL "
          + _null_sql(META_FIELDS, "null_raw_meta", "om"))
_OM = _LM + ", om AS (SELECT lm.* FROM offers o LEFT JOIN lm ON lm.offer_id = o.offer_id)"


@query("dq_nulls", "scope:s field:s null_count:i rows_seen:i null_rate_pct:d4", sql(_NULLS, needs="offers meta", ctes=_OM))
def _nulls(ctx):
    return quality.dq_nulls(ctx.offers, ctx.meta)


_COV = """cov AS (SELECT count(*) AS rows_seen, count(meta_id) AS rows_with_raw_meta,
  round(count(meta_id) / count(*) * 100.0, 4) AS raw_meta_coverage_pct,
  count(*) FILTER (WHERE inventory_confidence = 'reported') AS reported_count,
  count(*) FILTER (WHERE inventory_confidence = 'unknown') AS unknown_count,
  round(count(*) FILTER (WHERE inventory_confidence = 'reported') / count(*) * 100.0, 4) AS reported_rate_pct,
  round(count(*) FILTER (WHERE inventory_confidence = 'unknown') / count(*) * 100.0, 4) AS unknown_rate_pct FROM om)"""


@query("dq_meta_coverage", "rows_seen:i rows_with_raw_meta:i raw_meta_coverage_pct:d4 reported_count:i unknown_count:i "
       "reported_rate_pct:d4 unknown_rate_pct:d4", sql("SELECT * FROM cov", needs="offers meta", ctes=_OM + ", " + _COV))
def _coverage(ctx):
    return quality.meta_coverage(ctx.offers, ctx.meta_with("inventory_confidence"))


_RC = ROUTES_CTE + """, obs AS (SELECT DISTINCT airline, origin, destination FROM offers),
  rc AS (SELECT (SELECT count(*) FROM routes) AS expected_route_count, (SELECT count(*) FROM obs) AS observed_route_count,
    round((SELECT count(*) FROM obs) / (SELECT count(*) FROM routes) * 100.0, 4) AS coverage_pct,
    (SELECT coalesce(string_agg(x, '; ' ORDER BY x), '') FROM (SELECT airline || ':' || origin || '-' || destination AS x
     FROM (SELECT * FROM routes EXCEPT SELECT * FROM obs))) AS missing_routes)"""


@query("dq_route_coverage", "expected_route_count:i observed_route_count:i coverage_pct:d4 missing_routes:s",
       sql("SELECT * FROM rc", ctes=_RC))
def _routes(ctx):
    return quality.dq_route_coverage(ctx.offers, expected_routes(ctx))


def _metric(category, metric, value, source, notes=""):
    return (f"SELECT '{category}' AS category, '{metric}' AS metric, CAST({value} AS VARCHAR) AS value, "
            f"'{notes}' AS notes FROM {source}")


_D = "CAST({} AS DOUBLE)"
_REPORT = " UNION ALL ".join([
    _metric("summary", "total_rows", "total_rows", "s"),
    _metric("summary", "cycle_count", "cycle_count", "s"),
    _metric("summary", "observed_route_count", "observed_route_count", "s"),
    _metric("summary", "min_captured_at", "strftime(min_captured_at, '%Y-%m-%d %H:%M:%S')", "s"),
    _metric("summary", "max_captured_at", "strftime(max_captured_at, '%Y-%m-%d %H:%M:%S')", "s"),
    "SELECT 'scope', 'airline_filter', 'ALL', ''",
    _metric("duplicates", "duplicate_rows", "duplicate_rows", "dup"),
    _metric("duplicates", "duplicate_keys", "duplicate_keys", "dup"),
    _metric("duplicates", "duplicate_row_rate_pct",
            "CAST(round(duplicate_rows / (SELECT count(*) FROM offers) * 100.0, 4) AS DOUBLE)", "dup"),
    "SELECT scope, field || '_null_count', CAST(null_count AS VARCHAR), '' FROM nulls",
    "SELECT scope, field || '_null_rate_pct', CAST(CAST(null_rate_pct AS DOUBLE) AS VARCHAR), '' FROM nulls",
    *[_metric("raw_meta", n, n, "cov") for n in ("rows_seen", "rows_with_raw_meta")],
    _metric("raw_meta", "raw_meta_coverage_pct", "CAST(raw_meta_coverage_pct AS DOUBLE)", "cov"),
    *[_metric("inventory", n, n, "cov") for n in ("reported_count", "unknown_count")],
    *[_metric("inventory", n, f"CAST({n} AS DOUBLE)", "cov") for n in ("reported_rate_pct", "unknown_rate_pct")],
    _metric("route_coverage", "expected_route_count", "expected_route_count", "rc",
            "configured routes under the filters"),
    _metric("route_coverage", "observed_route_count", "observed_route_count", "rc"),
    _metric("route_coverage", "coverage_pct", "CAST(coverage_pct AS DOUBLE)", "rc"),
    _metric("route_coverage", "missing_routes", "missing_routes", "rc"),
])
_REPORT_CTES = f"""{_OM}, {_DUP}, {_COV}, {_RC}, nulls AS ({_NULLS}),
  s AS (SELECT count(*) AS total_rows, count(DISTINCT cycle_id) AS cycle_count,
    count(DISTINCT airline || '|' || origin || '|' || destination) AS observed_route_count,
    min(captured_at) AS min_captured_at, max(captured_at) AS max_captured_at FROM offers)"""


def _dq(ctx):
    return quality.dq_report(ctx.offers, ctx.meta, expected_routes(ctx), {"airline_filter": "ALL"})


@query("dq_report", "category:s metric:s value:s notes:s", sql(_REPORT, needs="offers meta", ctes=_REPORT_CTES))
def _report(ctx):
    return _dq(ctx)


@query("dq_pivot", "metric:s value:s", sql(f"""SELECT metric, value FROM ({_REPORT}) WHERE category <> 'route_coverage'
  AND metric IN ('total_rows','cycle_count','observed_route_count','duplicate_row_rate_pct','raw_meta_coverage_pct',
  'seat_capacity_null_rate_pct')""", needs="offers meta", ctes=_REPORT_CTES))
def _pivot(ctx):
    return quality.dq_pivot(_dq(ctx))


# ---------------------------------------------------------------- risk

RISK_CTES = f"""a1 AS ({PRICE_DAILY}), a2 AS ({AVAILABILITY_DAILY}), a3 AS ({ROUTE_SUMMARY}),
  j AS (SELECT a3.*, coalesce(a2.availability_change_events, a3.availability_events) AS availability_change_events,
    coalesce(a1.price_change_events, a3.price_events) AS price_change_events,
    coalesce(a2.soldout_flag_changes, 0) AS soldout_flag_changes,
    coalesce(a2.row_added_events, 0) AS row_added_events, coalesce(a2.row_removed_events, 0) AS row_removed_events,
    a3.airline || ' ' || a3.origin || '-' || a3.destination || ' ' || a3.cabin AS route_label,
    a3.added_events + a3.removed_events AS net_structure_events
    FROM a3 LEFT JOIN a2 USING (report_day, airline, origin, destination, cabin)
    LEFT JOIN a1 USING (report_day, airline, origin, destination, cabin)),
  scored AS (SELECT *, round_even(least(100.0, greatest(0.0, CAST((
      0.0 + total_change_events / max(total_change_events) OVER () * 0.35
      + availability_change_events / max(availability_change_events) OVER () * 0.30
      + price_change_events / max(price_change_events) OVER () * 0.20
      + net_structure_events / max(net_structure_events) OVER () * 0.10
      + flights_affected / max(flights_affected) OVER () * 0.05) * 100.0 AS DOUBLE)
      + CASE WHEN soldout_flag_changes > 0 THEN 15.0 ELSE 0.0 END)), 1) AS risk_score FROM j),
  risk AS (SELECT *, CASE WHEN risk_score >= 70 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END
      AS risk_level, coalesce(nullif(concat_ws(', ', CASE WHEN soldout_flag_changes > 0 THEN 'SOLDOUT' END,
      CASE WHEN availability_change_events > 0 THEN 'AVAIL' END, CASE WHEN price_change_events > 0 THEN 'PRICE' END,
      CASE WHEN net_structure_events > 0 THEN 'STRUCT' END), ''), 'MONITOR') AS risk_flags FROM scored)"""


def parts(ctx):
    """The three daily rollups over one reading of the change events."""
    events = ctx.changes
    return (rollups.route_airline_summary(events), rollups.availability_changes_daily(events),
            rollups.price_changes_daily(events))


def risk(ctx):
    return quality.risk_from_rollups(rollups.daily_rollups(ctx.changes))


_RISK = ("report_day:D route_label:s total_change_events:i availability_change_events:i price_change_events:i "
         "flights_affected:i soldout_flag_changes:i risk_score:d2 risk_level:s risk_flags:s")


@query("risk_features", _RISK + " net_structure_events:i row_added_events:i row_removed_events:i",
       sql("SELECT * FROM risk", needs="changes", ctes=RISK_CTES))
def _risk(ctx):
    return quality.risk_features(*parts(ctx))


@query("risk_action_queue", _RISK + " recommended_action:s", sql("""SELECT *, CASE WHEN soldout_flag_changes > 0
  THEN 'Check inventory controls and soldout transitions immediately.'
  WHEN availability_change_events > price_change_events
  THEN 'Validate seat/inventory updates and route capacity assumptions.' WHEN price_change_events > 0
  THEN 'Review fare ladder, competitor pressure, and pricing rules.'
  ELSE 'Monitor next scrape cycle for persistence.' END AS recommended_action FROM risk ORDER BY risk_score DESC,
  total_change_events DESC, availability_change_events DESC, price_change_events DESC, route_label, report_day
  LIMIT 40""", needs="changes", ctes=RISK_CTES))
def _queue(ctx):
    return quality.action_queue(risk(ctx), 40)


@query("risk_by_airline", "airline:s routes:i cabins:i total_change_events:i availability_change_events:i "
       "price_change_events:i high_risk_routes:i medium_risk_routes:i avg_risk_score:d2 max_risk_score:d2", sql("""
  SELECT airline, count(DISTINCT route_label) AS routes, count(DISTINCT cabin) AS cabins,
    sum(total_change_events) AS total_change_events, sum(availability_change_events) AS availability_change_events,
    sum(price_change_events) AS price_change_events, count(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk_routes,
    count(*) FILTER (WHERE risk_level = 'MEDIUM') AS medium_risk_routes,
    round_even(avg(risk_score), 1) AS avg_risk_score, max(risk_score) AS max_risk_score FROM risk GROUP BY 1""",
       needs="changes", ctes=RISK_CTES))
def _airline(ctx):
    return quality.airline_risk(risk(ctx))


@query("risk_airline_sections", "airline:s rank_in_airline:i report_day:D route_label:s risk_score:d2 risk_level:s",
       sql("""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY airline ORDER BY risk_score DESC,
  total_change_events DESC, route_label, report_day) AS rank_in_airline FROM risk) WHERE rank_in_airline <= 15""",
           needs="changes", ctes=RISK_CTES))
def _sections(ctx):
    return quality.airline_sections(risk(ctx), 15)


@query("risk_route_airline_pivot", "route_label:s A0:i A1:i A2:i A3:i A4:i all_airlines_total:i", sql("""
  SELECT route_label, """ + ", ".join(f"sum(CASE WHEN airline = 'A{i}' THEN total_change_events ELSE 0 END) AS A{i}"
                                      for i in range(5)) + """, sum(total_change_events) AS all_airlines_total
  FROM risk GROUP BY 1""", needs="changes", ctes=RISK_CTES))
def _risk_pivot(ctx):
    return quality.route_airline_pivot(risk(ctx))


@query("risk_top_routes", _RISK, sql("""SELECT * FROM risk ORDER BY risk_score DESC, total_change_events DESC,
  route_label, report_day LIMIT 25""", needs="changes", ctes=RISK_CTES))
def _top(ctx):
    return quality.top_risk(risk(ctx), 25)


@query("risk_top_availability", _RISK, sql("""SELECT * FROM risk ORDER BY availability_change_events DESC,
  risk_score DESC, route_label, report_day LIMIT 25""", needs="changes", ctes=RISK_CTES))
def _top_av(ctx):
    return quality.top_availability(risk(ctx), 25)


@query("executive_kpis", "kpi:s value:s notes:s", sql("""
  SELECT * FROM (VALUES ('generated_at_utc', '2000-01-01', ''), ('filters', 'all', '')) v(kpi, value, notes)
  UNION ALL SELECT 'total_change_events', CAST(sum(total_change_events) AS VARCHAR), 'route_airline_summary aggregate' FROM a3
  UNION ALL SELECT 'total_flights_affected', CAST(sum(flights_affected) AS VARCHAR), 'route_airline_summary aggregate' FROM a3
  UNION ALL SELECT 'total_price_change_events', CAST(sum(price_change_events) AS VARCHAR), 'price_changes_daily aggregate' FROM a1
  UNION ALL SELECT 'total_availability_change_events', CAST(sum(availability_change_events) AS VARCHAR),
    'availability_changes_daily aggregate' FROM a2
  UNION ALL (SELECT 'top_route_by_change_events', route_label, '' FROM risk
    ORDER BY risk_score DESC, total_change_events DESC, route_label, report_day LIMIT 1)
  UNION ALL (SELECT 'top_route_by_availability_changes', route_label, '' FROM risk
    ORDER BY availability_change_events DESC, risk_score DESC, route_label, report_day LIMIT 1)
  UNION ALL SELECT 'high_risk_routes', CAST(count(*) FILTER (WHERE risk_level = 'HIGH') AS VARCHAR), 'risk_score >= 70' FROM risk
  UNION ALL SELECT 'medium_risk_routes', CAST(count(*) FILTER (WHERE risk_level = 'MEDIUM') AS VARCHAR),
    '40 <= risk_score < 70' FROM risk
  UNION ALL SELECT 'action_queue_items', CAST(least(count(*), 40) AS VARCHAR), 'prioritized review list' FROM risk
  UNION ALL SELECT 'raw_meta_coverage_pct', CAST(CAST(raw_meta_coverage_pct AS DOUBLE) AS VARCHAR),
    'from data_quality_report; null means unavailable' FROM cov""", needs="changes",
       ctes=RISK_CTES + ", " + _OM + ", " + _COV))
def _kpis(ctx):
    summary, availability, price = parts(ctx)
    scored = risk(ctx)
    coverage = quality.meta_coverage(ctx.offers, ctx.meta_with("inventory_confidence"))
    return quality.executive_kpis(scored, summary, price, availability, coverage, "2000-01-01", "all")


@query("dashboard_metrics", "metric:s value:s", sql("""
  SELECT * FROM (VALUES ('generated_at_utc', '2000-01-01'), ('filters', 'all')) v(metric, value)
  UNION ALL SELECT 'total_change_events', CAST(sum(total_change_events) AS VARCHAR) FROM a3
  UNION ALL SELECT 'total_flights_affected', CAST(sum(flights_affected) AS VARCHAR) FROM a3
  UNION ALL SELECT 'total_price_change_events', CAST(sum(price_change_events) AS VARCHAR) FROM a1
  UNION ALL SELECT 'total_availability_change_events', CAST(sum(availability_change_events) AS VARCHAR) FROM a2
  UNION ALL SELECT 'rows_price_changes_daily', CAST(count(*) AS VARCHAR) FROM a1
  UNION ALL SELECT 'rows_availability_changes_daily', CAST(count(*) AS VARCHAR) FROM a2
  UNION ALL SELECT 'rows_route_airline_summary', CAST(count(*) AS VARCHAR) FROM a3
  UNION ALL SELECT 'rows_data_quality_report', '70'""", needs="changes", ctes=RISK_CTES))
def _dashboard(ctx):
    summary, availability, price = parts(ctx)
    return quality.dashboard_metrics(summary, price, availability, _dq(ctx), "2000-01-01", "all")


# ---------------------------------------------------------------- logs

_MESSAGE = """CASE WHEN event_id % 50 = 0 THEN concat('Pipeline finished rc=', event_id % 3)
  WHEN event_id % 40 = 1 THEN concat('run finished with rc=', event_id % 2)
  WHEN event_id % 7 = 0 THEN 'Request FAILED' WHEN event_id % 11 = 0 THEN 'no rows for route: error'
  WHEN event_id % 13 = 0 THEN 'Done. Total rows: 5' ELSE 'ok' END"""
_LOGS = f"""logs AS (SELECT concat('log_', user_id % 3) AS file, ts, upper(event_type) AS level, 'core' AS logger,
  {_MESSAGE} AS message FROM events)"""
_SINCE = datetime(2024, 1, 10)


def logs(ctx):
    return ctx.table("events").selectExpr("concat('log_', user_id % 3) AS file", "ts", "upper(event_type) AS level",
                                          "'core' AS logger", f"{_MESSAGE} AS message")


_HIT = """(lower(message) LIKE '%traceback%' OR lower(message) LIKE '%exception%' OR
  lower(message) LIKE '%module not found%' OR lower(message) LIKE '%failed%' OR lower(message) LIKE '%error%')
  AND NOT (lower(message) LIKE '%no rows for%' OR lower(message) LIKE '%no rows to write%')"""


@query("log_health", "status:s events_in_window:i earliest_ts:t latest_ts:t scheduler_runs:i failed_runs:i "
       "row_emit_signals:i failure_hit_count:i", sql(f"""SELECT CASE WHEN failed_runs > 0 THEN 'FAIL'
  WHEN failure_hit_count > 0 THEN 'WARN' ELSE 'PASS' END AS status, * FROM (SELECT count(*) AS events_in_window,
  min(ts) AS earliest_ts, max(ts) AS latest_ts,
  count(*) FILTER (WHERE lower(message) LIKE '%pipeline finished rc=%') AS scheduler_runs,
  count(*) FILTER (WHERE lower(message) LIKE '%pipeline finished rc=%' AND lower(message) NOT LIKE '%rc=0%') AS failed_runs,
  count(*) FILTER (WHERE lower(message) LIKE '%done. total rows:%' OR lower(message) LIKE '%saved csv:%') AS row_emit_signals,
  count(*) FILTER (WHERE {_HIT}) AS failure_hit_count FROM logs WHERE ts >= TIMESTAMP '2024-01-10')""", needs="",
       ctes=_LOGS))
def _health(ctx):
    return quality.log_health(logs(ctx), _SINCE)


@query("log_counts", "kind:s name:s lines:i", sql("""SELECT 'level' AS kind, level AS name, count(*) AS lines FROM logs
  WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 2 UNION ALL SELECT 'file', file, count(*) FROM logs
  WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 2""", needs="", ctes=_LOGS))
def _counts(ctx):
    return quality.log_counts(logs(ctx), _SINCE)


@query("log_failure_hits", "file:s ts:t level:s message:s", sql(f"""SELECT * FROM logs WHERE
  ts >= TIMESTAMP '2024-01-10' AND {_HIT}""", needs="", ctes=_LOGS))
def _hits(ctx):
    return quality.failure_hits(logs(ctx), _SINCE)


@query("log_run_success", "total_runs:i success_runs:i success_pct:d2", sql("""SELECT count(*) AS total_runs,
  count(*) FILTER (WHERE message LIKE '%rc=0') AS success_runs,
  round(count(*) FILTER (WHERE message LIKE '%rc=0') / count(*) * 100.0, 2) AS success_pct
  FROM logs WHERE ts >= TIMESTAMP '2024-01-10' AND message LIKE 'run finished with rc=%'""", needs="", ctes=_LOGS))
def _success(ctx):
    return quality.run_success(logs(ctx), _SINCE)


@query("service_levels", "overall_status:s name:s value:d4 threshold:s ok:b", sql("""
  SELECT CASE count(*) FILTER (WHERE NOT ok) OVER () WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' ELSE 'FAIL' END
    AS overall_status, name, value, threshold, ok FROM (SELECT *, CASE WHEN threshold LIKE '>=%'
      THEN value >= CAST(substr(threshold, 4) AS DOUBLE) ELSE value <= CAST(substr(threshold, 4) AS DOUBLE) END AS ok FROM (
    SELECT 'route_coverage_pct' AS name, round(round((SELECT count(*) FROM (SELECT DISTINCT airline, origin, destination
      FROM recent)) / (SELECT count(*) FROM routes) * 100.0, 4), 2) AS value, '>= 80.0' AS threshold
    UNION ALL SELECT 'mandatory_null_rate_pct', round(count(*) FILTER (WHERE adt_count IS NULL OR chd_count IS NULL
      OR inf_count IS NULL OR inventory_confidence IS NULL OR source_endpoint IS NULL OR departure_utc IS NULL)
      / count(*) * 100.0, 4) AS v, '<= 10.0' FROM recent LEFT JOIN lm USING (offer_id)
    UNION ALL SELECT 'accumulation_success_pct', round(count(*) FILTER (WHERE message LIKE '%rc=0') / count(*) * 100.0, 2)
      AS v, '>= 85.0' FROM logs WHERE message LIKE 'run finished with rc=%'
    UNION ALL SELECT 'freshness_lag_hours', round(date_diff('second', (SELECT max(captured_at) FROM offers),
      TIMESTAMP '2001-12-01') / 3600.0, 2) AS v, '<= 8.0'))""", needs="offers meta",
       ctes=f"{_LM}, {_LOGS}, {ROUTES_CTE}, recent AS (SELECT * FROM offers WHERE captured_at >= TIMESTAMP '2001-01-01')"))
def _sla(ctx):
    meta = ctx.meta_with("adt_count chd_count inf_count inventory_confidence source_endpoint departure_utc")
    return quality.sla(ctx.offers, meta, expected_routes(ctx), logs(ctx), datetime(2001, 12, 1), datetime(2001, 1, 1))


@query("timezone_audit", "airport_role:s airport:s rows_total:i utc_null_rows:i airlines_seen:i has_offset:b", sql("""
  SELECT airport_role, airport, count(*) AS rows_total, count(*) FILTER (WHERE missing) AS utc_null_rows,
    count(DISTINCT airline) AS airlines_seen, airport IN ('R0', 'R1', 'R2', 'R3') AS has_offset FROM (
    SELECT airline, 'origin' AS airport_role, origin AS airport, departure_utc IS NULL AS missing
      FROM offers LEFT JOIN lm USING (offer_id)
    UNION ALL SELECT airline, 'destination', destination, arrival_utc IS NULL FROM offers LEFT JOIN lm USING (offer_id))
  GROUP BY 1, 2""", needs="offers meta", ctes=_LM))
def _timezones(ctx):
    return quality.timezone_audit(ctx.offers, ctx.meta_with("departure_utc arrival_utc"), ctx.offsets)


@query("meta_daily_volume", "day:D row_count:i", sql("""SELECT CAST(captured_at AS DATE) AS day, count(*) AS row_count
  FROM meta WHERE captured_at >= TIMESTAMP '2001-01-01' GROUP BY 1""", needs="meta"))
def _volume(ctx):
    return quality.daily_volume(ctx.meta_with("captured_at"), datetime(2001, 1, 1))


@query("meta_row_sizes", "avg_row_bytes:d p50_row_bytes:d p90_row_bytes:d", sql("""SELECT avg(n) AS avg_row_bytes,
  quantile_cont(n, 0.5) AS p50_row_bytes, quantile_cont(n, 0.9) AS p90_row_bytes FROM (
  SELECT length('{"meta_id":"' || meta_id || '","offer_id":"' || offer_id || '"' ||
    coalesce(',"currency":"' || currency || '"', '') || ',"stops":' || stops || '}') AS n
  FROM meta)""", needs="meta"))
def _sizes(ctx):
    return quality.row_sizes(ctx.meta_with("currency stops"))


_QLOG = """qlog AS (SELECT event_type AS airline, concat('R', user_id % 5) AS origin, concat('R', event_id % 4) AS destination,
  'Economy' AS cabin, abs(value) AS elapsed_sec FROM events)"""


def _query_log(ctx):
    return ctx.table("events").selectExpr("event_type AS airline", "concat('R', user_id % 5) AS origin",
                                          "concat('R', event_id % 4) AS destination", "'Economy' AS cabin",
                                          "abs(value) AS elapsed_sec")


@query("runtime_by_airline", "airline:s count:i avg_sec:d4 max_sec:d4", sql("""SELECT airline, count(*) AS count,
  round(CAST(avg(elapsed_sec) AS DECIMAL(38,10)), 4) AS avg_sec, round(CAST(max(elapsed_sec) AS DECIMAL(38,10)), 4) AS max_sec FROM qlog GROUP BY 1""", needs="",
       ctes=_QLOG))
def _runtime(ctx):
    return quality.runtime_by_airline(_query_log(ctx))


@query("runtime_slowest_routes", "route:s count:i avg_sec:d4 max_sec:d4", sql("""SELECT
  airline || ':' || origin || '-' || destination || ':' || cabin AS route, count(*) AS count,
  round(CAST(avg(elapsed_sec) AS DECIMAL(38,10)), 4) AS avg_sec, round(CAST(max(elapsed_sec) AS DECIMAL(38,10)), 4) AS max_sec FROM qlog GROUP BY 1
  ORDER BY avg_sec DESC, route LIMIT 50""", needs="", ctes=_QLOG))
def _slowest(ctx):
    return quality.slowest_routes(_query_log(ctx), 50)
