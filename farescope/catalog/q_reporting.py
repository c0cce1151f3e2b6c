"""Queries over offer reports."""

from datetime import datetime

from pyspark.sql import functions as F

from farescope.catalog.base import query, sql
from farescope.functions import PENALTY_FEES
from farescope.operators import cycles, reporting

NEWEST = ("(SELECT cycle_id FROM (SELECT cycle_id, max(captured_at) AS m, count(*) AS n FROM offers GROUP BY 1) "
          "ORDER BY m DESC, 1 DESC LIMIT 1)")
COUNTRY = "CASE {x} WHEN 'R0' THEN 'X' WHEN 'R1' THEN 'X' WHEN 'R2' THEN 'Y' WHEN 'R3' THEN 'Z' END"
_FROM, _TO = COUNTRY.format(x="origin"), COUNTRY.format(x="destination")
CLASS = f"""{_FROM} AS origin_country_code, {_TO} AS destination_country_code, {_FROM} || '-' || {_TO} AS country_pair,
  CASE WHEN {_FROM} IS NULL OR {_TO} IS NULL THEN 'UNK' WHEN {_FROM} = {_TO} THEN 'DOM' ELSE 'INT' END AS route_type,
  CASE WHEN {_FROM} = {_TO} THEN {_FROM} END AS domestic_country_code,
  coalesce({_FROM} <> {_TO}, false) AS is_cross_border"""
CLASS_COLS = ("origin_country_code:s destination_country_code:s country_pair:s route_type:s domestic_country_code:s "
              "is_cross_border:b")


def newest(ctx):
    """Id of the newest cycle as a scalar subquery."""
    return ctx.cycle_order.agg(F.max_by("cycle_id", "cycle_no")).scalar()


@query("dim_airline", "airline:s first_seen_at_utc:t last_seen_at_utc:t offer_rows:i latest_cycle_id:s", sql("""
  SELECT airline, min(captured_at) AS first_seen_at_utc, max(captured_at) AS last_seen_at_utc, count(*) AS offer_rows,
    (SELECT x.cycle_id FROM offers x WHERE x.airline = o.airline ORDER BY x.captured_at DESC, x.cycle_id DESC LIMIT 1)
    AS latest_cycle_id FROM offers o GROUP BY airline"""))
def _airline(ctx):
    return reporting.dim_airline(ctx.offers)


@query("dim_route", "route_key:s origin:s destination:s first_seen_at_utc:t last_seen_at_utc:t offer_rows:i "
       "airlines_present:i", sql("""SELECT origin || '-' || destination AS route_key, origin, destination,
  min(captured_at) AS first_seen_at_utc, max(captured_at) AS last_seen_at_utc, count(*) AS offer_rows,
  count(DISTINCT airline) AS airlines_present FROM offers GROUP BY origin, destination"""))
def _route(ctx):
    return reporting.dim_route(ctx.offers)


@query("list_routes_filtered", "route_key:s offer_rows:i airlines_present:i first_seen_at_utc:t " + CLASS_COLS, sql(
    f"""SELECT *, {CLASS} FROM (SELECT origin || '-' || destination AS route_key, origin, destination,
  min(o.captured_at) AS first_seen_at_utc, count(*) AS offer_rows, count(DISTINCT airline) AS airlines_present
  FROM offers o LEFT JOIN meta m USING (offer_id) WHERE cycle_id = {NEWEST} AND airline IN ('A0', 'A1', 'A2')
  AND coalesce(search_trip_type, 'OW') = 'OW' GROUP BY origin, destination)""", needs="offers meta"))
def _list_routes(ctx):
    return reporting.list_routes(ctx.offers, ctx.meta_with("search_trip_type"), ctx.airports, newest(ctx),
                                 ["A0", "A1", "a2"], trip_types=["ow"])


@query("classify_routes", "route_key:s " + CLASS_COLS, sql(f"""SELECT origin || '-' || destination AS route_key, {CLASS}
  FROM (SELECT DISTINCT origin, destination FROM offers)"""))
def _classify(ctx):
    return reporting.annotate_routes(reporting.dim_route(ctx.offers), ctx.airports)


@query("filter_route_types", "route_key:s route_type:s offer_rows:i", sql(f"""SELECT * FROM (
  SELECT origin || '-' || destination AS route_key, {CLASS}, count(*) AS offer_rows FROM offers GROUP BY origin,
  destination) WHERE route_type IN ('DOM', 'UNK')"""))
def _types(ctx):
    rows = reporting.annotate_routes(reporting.dim_route(ctx.offers), ctx.airports)
    return reporting.filter_route_types(rows, ["dom", "UNK", "bad"])


@query("route_scope_home_market", "route_key:s route_scope:s offer_rows:i", sql(f"""SELECT route_key, offer_rows,
  CASE WHEN f IS NULL OR t IS NULL THEN 'unknown' WHEN f = 'X' AND t = 'X' THEN 'domestic' ELSE 'international' END
  AS route_scope FROM (SELECT origin || '-' || destination AS route_key, {_FROM} AS f, {_TO} AS t,
  count(*) AS offer_rows FROM offers GROUP BY origin, destination)"""))
def _scope(ctx):
    return reporting.route_scope(reporting.dim_route(ctx.offers), ctx.airports, "x")


@query("route_scope_filtered", "airline:s offers:i", sql(f"""SELECT airline, count(*) AS offers FROM offers
  WHERE {_FROM} IS NOT NULL AND {_TO} IS NOT NULL AND NOT ({_FROM} = 'X' AND {_TO} = 'X') GROUP BY 1"""))
def _scope_filter(ctx):
    rows = reporting.route_scope(ctx.offers, ctx.airports, "X", "international")
    return rows.groupBy("airline").agg(F.count("*").alias("offers"))


_SNAP = ("cycle_id:s captured_at_utc:t airline:s origin:s destination:s route_key:s flight_number:s departure_utc:t "
         "cabin:s brand:s fare_basis:s total_price_bdt:d2 base_fare_amount:d2 tax_amount:d2 currency:s "
         "seat_available:i seat_capacity:i load_factor_pct:d2 booking_class:s baggage:s aircraft:s duration_min:i "
         "stops:i soldout:b penalty_source:s")


@query("current_snapshot", _SNAP, sql(f"""SELECT cycle_id, o.captured_at AS captured_at_utc, airline, origin,
  destination, origin || '-' || destination AS route_key, flight_number, departure AS departure_utc, cabin, brand,
  fare_basis, price_total AS total_price_bdt, fare_amount AS base_fare_amount, tax_amount, currency, seat_available,
  seat_capacity, load_factor_pct, booking_class, baggage, aircraft, duration_min, stops, soldout, penalty_source
  FROM offers o LEFT JOIN meta m USING (offer_id) WHERE cycle_id = {NEWEST} AND origin IN ('R0', 'R1')
  """,
       needs="offers meta"))
def _snapshot(ctx):
    return reporting.current_snapshot(ctx.offers, ctx.meta, newest(ctx), origins=["R0", "R1"])


@query("date_availability", "kind:s date:D row_count:i", sql(f"""
  WITH_ROWS SELECT 'departure' AS kind, CAST(departure AS DATE) AS date, count(*) AS row_count FROM r GROUP BY 2
  UNION ALL SELECT 'return', requested_return_date, count(*) FROM r WHERE requested_return_date IS NOT NULL GROUP BY 2
  """.replace("WITH_ROWS", ""), needs="offers meta", ctes=f"""r AS (SELECT o.*, m.requested_return_date FROM offers o
  LEFT JOIN meta m USING (offer_id) WHERE cycle_id = {NEWEST})"""))
def _dates(ctx):
    return reporting.date_availability(ctx.offers, ctx.meta_with("search_trip_type requested_return_date"),
                                       newest(ctx))


_FACT = _SNAP.replace("baggage:s ", "baggage:s via_airports:s departure_date:D search_trip_type:s trip_request_id:s "
                      "requested_outbound_date:D requested_return_date:D trip_duration_days:i trip_origin:s "
                      "trip_destination:s trip_pair_key:s leg_direction:s leg_sequence:i itinerary_leg_count:i ")
_TAX = "CAST(coalesce(tax_amount, greatest(price_total - fare_amount, 0)) AS DECIMAL(12,2))"
FACT_SQL = f"""SELECT cycle_id, o.captured_at AS captured_at_utc, airline, origin, destination,
  origin || '-' || destination AS route_key, flight_number, departure AS departure_utc,
  CAST(departure AS DATE) AS departure_date, cabin, brand, fare_basis, price_total AS total_price_bdt,
  fare_amount AS base_fare_amount, {_TAX} AS tax_amount, currency, seat_available, seat_capacity, load_factor_pct,
  booking_class, baggage, aircraft, duration_min, stops, via_airports, soldout, penalty_source,
  coalesce(search_trip_type, 'OW') AS search_trip_type, trip_request_id, requested_outbound_date,
  requested_return_date, trip_duration_days, trip_origin, trip_destination,
  coalesce(trip_origin, origin) || '-' || coalesce(trip_destination, destination) AS trip_pair_key,
  coalesce(leg_direction, 'outbound') AS leg_direction, leg_sequence, itinerary_leg_count
  FROM offers o LEFT JOIN meta m USING (offer_id)"""


@query("fact_offer_snapshot", _FACT, sql(FACT_SQL + """ WHERE o.captured_at >= TIMESTAMP '1997-01-01'
  AND o.captured_at < TIMESTAMP '1998-01-01'""", needs="offers meta"))
def _fact(ctx):
    return reporting.fact_offer_snapshot(ctx.offers, ctx.meta, datetime(1997, 1, 1), datetime(1998, 1, 1))


@query("route_daily_fare", "report_day:D airline:s origin:s destination:s route_key:s cabin:s offer_rows:i "
       "min_total_price_bdt:d2 avg_total_price_bdt:d4 max_total_price_bdt:d2 avg_tax_amount:d4 "
       "avg_load_factor_pct:d4 soldout_rows:i", sql("""SELECT CAST(captured_at_utc AS DATE) AS report_day, airline,
  origin, destination, route_key, cabin, count(*) AS offer_rows, min(total_price_bdt) AS min_total_price_bdt,
  avg(total_price_bdt) AS avg_total_price_bdt, max(total_price_bdt) AS max_total_price_bdt,
  avg(tax_amount) AS avg_tax_amount, avg(load_factor_pct) AS avg_load_factor_pct,
  count(*) FILTER (WHERE soldout) AS soldout_rows FROM fact GROUP BY ALL""", needs="offers meta",
       ctes=f"fact AS ({FACT_SQL})"))
def _daily_fare(ctx):
    return reporting.route_daily_fare(reporting.fact_offer_snapshot(ctx.offers, ctx.meta))


@query("fact_change_event", "cycle_id:s detected_at_utc:t route_key:s flight_number:s field_name:s old_value:s "
       "new_value:s magnitude:d", sql("""SELECT cycle_id, detected_at AS detected_at_utc,
  origin || '-' || destination AS route_key, flight_number, field_name, old_value, new_value, magnitude FROM changes
  WHERE detected_at >= TIMESTAMP '1998-01-01' AND detected_at < TIMESTAMP '1998-04-01'""", needs="changes"))
def _fact_change(ctx):
    return reporting.fact_change_event(ctx.changes, datetime(1998, 1, 1), datetime(1998, 4, 1))


_FEE_COLS = " ".join(f"{f}:d2" for f in PENALTY_FEES)
_PENALTY = ("cycle_id:s captured_at_utc:t report_day:D airline:s route_key:s flight_number:s departure_utc:t cabin:s "
            f"fare_basis:s penalty_source:s penalty_currency:s {_FEE_COLS} fare_changeable:b fare_refundable:b "
            "penalty_rule_text:s")
_PENALTY_SQL = f"""SELECT cycle_id, o.captured_at AS captured_at_utc, CAST(o.captured_at AS DATE) AS report_day, airline,
  origin || '-' || destination AS route_key, flight_number, departure AS departure_utc, cabin, fare_basis,
  penalty_source, penalty_currency, {', '.join(PENALTY_FEES)}, fare_changeable, fare_refundable, penalty_rule_text
  FROM offers o JOIN meta m USING (offer_id) WHERE (penalty_rule_text IS NOT NULL OR {' OR '.join(
      f'{f} IS NOT NULL' for f in PENALTY_FEES)})"""


@query("penalty_snapshot", _PENALTY, sql(_PENALTY_SQL + " AND o.captured_at >= TIMESTAMP '1995-01-01' "
       "AND o.captured_at < TIMESTAMP '1996-01-01'", needs="offers meta"))
def _penalty(ctx):
    return reporting.penalty_snapshot(ctx.offers, ctx.meta, datetime(1995, 1, 1), datetime(1996, 1, 1))


@query("penalty_list", _PENALTY, sql(_PENALTY_SQL + f""" AND cycle_id = {NEWEST} AND airline IN ('A1', 'A2')""",
       needs="offers meta"))
def _penalty_list(ctx):
    return reporting.penalty_snapshot(ctx.offers, ctx.meta, cycle_id=newest(ctx), airlines=["A1", "A2"])


TAX_SQL = f"""SELECT cycle_id, o.captured_at AS captured_at_utc, CAST(o.captured_at AS DATE) AS report_day, airline,
  origin, destination, origin || '-' || destination AS route_key, flight_number, departure AS departure_utc, cabin,
  fare_basis, {_TAX} AS tax_amount, currency FROM offers o JOIN meta m USING (offer_id)"""
_TAX_COLS = ("cycle_id:s captured_at_utc:t airline:s origin:s destination:s route_key:s flight_number:s "
             "departure_utc:t cabin:s fare_basis:s tax_amount:d2 currency:s")
_TAX_META = "fare_amount tax_amount currency"


def tax(ctx, dialect="pg"):
    return reporting.tax_snapshot(ctx.offers, ctx.meta_with(_TAX_META), dialect=dialect)


@query("tax_snapshot", _TAX_COLS + " report_day:D", sql(TAX_SQL, needs="offers meta"))
def _tax(ctx):
    return tax(ctx)


@query("tax_snapshot_strict_fare", "airline:s n:i total:d2", sql("""SELECT airline, count(*) AS n, sum(t) AS total FROM (
  SELECT airline, coalesce(tax_amount, CASE WHEN fare_amount IS NOT NULL THEN greatest(price_total - fare_amount, 0) END)
  AS t FROM offers JOIN meta USING (offer_id)) WHERE t IS NOT NULL GROUP BY 1""", needs="offers meta"))
def _tax_bq(ctx):
    return tax(ctx, "bq").groupBy("airline").agg(F.count("*").alias("n"), F.sum("tax_amount").alias("total"))


_DEDUP = f"""tax AS ({TAX_SQL}), dt AS (SELECT DISTINCT cycle_id, captured_at_utc, airline, origin, destination,
  route_key, flight_number, departure_utc, cabin, fare_basis, tax_amount, currency FROM tax)"""
_LEVEL = """min(tax_amount) AS min_tax_amount, max(tax_amount) AS max_tax_amount, avg(CAST(tax_amount AS DOUBLE))
  AS avg_tax_amount, max(tax_amount) - min(tax_amount) AS spread_amount"""
_LEVEL_COLS = "row_count:i min_tax_amount:d2 max_tax_amount:d2 avg_tax_amount:d4 spread_amount:d2"


@query("tax_monitor_routes", f"route_key:s airline_count:i latest_captured_at_utc:t {_LEVEL_COLS}", sql(
    f"""SELECT route_key, count(*) AS row_count, count(DISTINCT airline) AS airline_count, {_LEVEL},
  max(captured_at_utc) AS latest_captured_at_utc FROM dt WHERE cycle_id = {NEWEST} GROUP BY 1""",
    needs="offers meta", ctes=_DEDUP))
def _tax_routes(ctx):
    return reporting.tax_routes(tax(ctx), newest(ctx))


@query("tax_monitor_airlines", f"route_key:s airline:s latest_captured_at_utc:t {_LEVEL_COLS}", sql(
    f"""SELECT route_key, airline, count(*) AS row_count, {_LEVEL}, max(captured_at_utc) AS latest_captured_at_utc
  FROM dt WHERE cycle_id = {NEWEST} AND airline IN ('A0', 'A4') GROUP BY 1, 2""", needs="offers meta", ctes=_DEDUP))
def _tax_airlines(ctx):
    return reporting.tax_airlines(tax(ctx), newest(ctx), ["A0", "A4"])


@query("tax_monitor_details", _TAX_COLS + " " + CLASS_COLS, sql(f"""SELECT * FROM (SELECT *, {CLASS} FROM dt
  WHERE cycle_id = {NEWEST}) WHERE route_type = 'INT'""",
       needs="offers meta", ctes=_DEDUP))
def _tax_details(ctx):
    return reporting.tax_details(tax(ctx), newest(ctx), ctx.airports, ["INT"])


_RECENT = """recent AS (SELECT cycle_id, max(captured_at) AS cycle_completed_at_utc FROM offers GROUP BY 1
  HAVING count(*) >= 500 ORDER BY 2 DESC, 1 DESC LIMIT 6)"""


def recent(ctx):
    return cycles.recent_cycles(cycles.cycle_runs(ctx.offers), 6)


def _trend_sql(keys: str, airline_count: str) -> str:
    return f"""SELECT *, avg_tax_amount - lag(avg_tax_amount) OVER (PARTITION BY {keys}
  ORDER BY cycle_completed_at_utc, cycle_id) AS avg_tax_change_amount FROM (SELECT cycle_id, cycle_completed_at_utc,
  {keys}, count(*) AS row_count, {airline_count} {_LEVEL} FROM dt JOIN recent USING (cycle_id) GROUP BY ALL)"""


@query("tax_trends_routes", f"cycle_id:s route_key:s airline_count:i avg_tax_change_amount:d4 {_LEVEL_COLS}", sql(
    _trend_sql("route_key", "count(DISTINCT airline) AS airline_count,"), needs="offers meta",
    ctes=_DEDUP + ", " + _RECENT))
def _trends(ctx):
    return reporting.tax_trends(tax(ctx), recent(ctx))


@query("tax_trends_airlines", f"cycle_id:s route_key:s airline:s avg_tax_change_amount:d4 {_LEVEL_COLS}", sql(
    _trend_sql("route_key, airline", ""), needs="offers meta", ctes=_DEDUP + ", " + _RECENT))
def _trends_airline(ctx):
    return reporting.tax_trends(tax(ctx), recent(ctx), by_airline=True)


@query("tax_change_ranking", "route_key:s cycle_id:s avg_tax_amount:d4 spread_amount:d2 avg_tax_change_amount:d4", sql(
    f"""SELECT * FROM ({_trend_sql("route_key", "")}) QUALIFY row_number() OVER (PARTITION BY route_key
  ORDER BY cycle_completed_at_utc DESC, cycle_id DESC) = 1""", needs="offers meta", ctes=_DEDUP + ", " + _RECENT))
def _ranking(ctx):
    return reporting.tax_change_ranking(reporting.tax_trends(tax(ctx), recent(ctx)))
