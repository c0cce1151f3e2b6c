"""Queries over the route monitor and the operations view."""

from pyspark.sql import functions as F

from farescope.catalog.base import query, sql, stored
from farescope.catalog.q_reporting import NEWEST, newest, recent
from farescope.functions import ROUTE, bounded_broadcast, shuffled_once
from farescope.operators import cycles, monitor, operations, reporting

_TOP = f"""toproutes AS (SELECT origin, destination, origin || '-' || destination AS route_key, count(*) AS row_count
  FROM offers LEFT JOIN meta USING (offer_id) WHERE cycle_id = {NEWEST} GROUP BY 1, 2)"""

_SIDE = ("fare_amount tax_amount aircraft booking_class load_factor_pct soldout search_trip_type trip_origin "
         "trip_destination leg_direction trip_request_id requested_outbound_date requested_return_date "
         "trip_duration_days leg_sequence itinerary_leg_count")


@query("monitor_top_routes", "origin:s destination:s route_key:s row_count:i",
       sql("SELECT * FROM toproutes", needs="offers meta", ctes=_TOP))
def _top(ctx):
    return monitor.top_monitor_routes(ctx.offers, ctx.meta_with(""), newest(ctx))


_ASC = "ORDER BY price_total ASC NULLS LAST, seat_available DESC NULLS LAST, {x}"
_DESC = "ORDER BY price_total DESC NULLS LAST, seat_available DESC NULLS LAST, {x}"
_CODE = "coalesce(booking_class, fare_basis)"
_GROUP = "|| '|' ||".join([
    "route_key", "airline", "flight_number", "departure_time", "cabin", "upper(trim(aircraft))", "search_trip_type",
    "coalesce(CAST(requested_return_date AS VARCHAR), '')", "leg_direction"])


def _cells(tax_expr: str, extra: str = "") -> str:
    return f"""cells AS (SELECT *, {_GROUP} AS flight_group_id FROM (SELECT cycle_id, cap.captured_at AS captured_at_utc,
  airline, origin, destination, origin || '-' || destination AS route_key, flight_number, departure AS departure_utc,
  CAST(departure AS DATE) AS departure_date, strftime(departure, '%H:%M') AS departure_time, cabin,
  coalesce(aircraft, '') AS aircraft, coalesce(search_trip_type, 'OW') AS search_trip_type, trip_request_id,
  requested_outbound_date, requested_return_date, trip_duration_days, coalesce(trip_origin, origin) AS trip_origin,
  coalesce(trip_destination, destination) AS trip_destination, coalesce(leg_direction, 'outbound') AS leg_direction,
  leg_sequence, itinerary_leg_count, min(price_total) AS min_total_price_bdt, max(price_total) AS max_total_price_bdt,
  max({tax_expr}) AS tax_amount,
  first({_CODE} {_ASC.format(x=_CODE)}) FILTER (WHERE {_CODE} IS NOT NULL) AS min_booking_class,
  first({_CODE} {_DESC.format(x=_CODE)}) FILTER (WHERE {_CODE} IS NOT NULL) AS max_booking_class,
  first(seat_available {_ASC.format(x='seat_available')}) FILTER (WHERE seat_available IS NOT NULL) AS min_seat_available,
  first(seat_available {_DESC.format(x='seat_available')}) FILTER (WHERE seat_available IS NOT NULL) AS max_seat_available,
  max(seat_capacity) AS seat_capacity, max(load_factor_pct) AS load_factor_pct, bool_or(coalesce(soldout, false)) AS soldout
  FROM offers o LEFT JOIN meta m USING (offer_id) JOIN cap USING (cycle_id) JOIN toproutes USING (origin, destination)
  {extra} GROUP BY ALL))"""


_CAP = "cap AS (SELECT cycle_id, max(captured_at) AS captured_at FROM offers GROUP BY 1)"
_PG = "coalesce(tax_amount, greatest(price_total - fare_amount, 0))"
_CELLS = f"{_TOP}, {_CAP}, {_cells(_PG)}"


def _captured(ctx, offers):
    """Offers with the capture time of their cycle, so a cycle is one column of the matrix."""
    times = cycles.cycle_times(ctx.capture_times).withColumnRenamed("captured_at", "capture")
    return offers.join(bounded_broadcast(times), "cycle_id")


def cells(ctx, offers=None, meta=None, **options):
    # A row per route, stored since its size is checked before it is broadcast. Their counts are not needed here, and without
    # them Spark leaves out the side-car of the whole table.
    top = stored(ctx, "monitor-routes", lambda: monitor.top_monitor_routes(ctx.offers, ctx.meta_with(""), newest(ctx)).select(*ROUTE))
    offers = ctx.sharing.offers if offers is None else offers
    meta = ctx.sharing.meta_with(_SIDE) if meta is None else meta
    return monitor.monitor_cells(_captured(ctx, offers), meta, top, capture="capture", **options)


_CELL_COLS = ("cycle_id:s captured_at_utc:t flight_group_id:s departure_date:D trip_request_id:s trip_origin:s "
              "trip_destination:s leg_sequence:i min_total_price_bdt:d2 max_total_price_bdt:d2 tax_amount:d2 "
              "min_booking_class:s max_booking_class:s min_seat_available:i max_seat_available:i seat_capacity:i "
              "load_factor_pct:d2 soldout:b")


@query("monitor_cells", _CELL_COLS, sql("SELECT * FROM cells", needs="offers meta", ctes=_CELLS))
def _cells_query(ctx):
    return cells(ctx)


_BQ = """coalesce(CASE WHEN tax_amount > 0 THEN tax_amount END, CASE WHEN lk > 0 THEN lk END,
  CASE WHEN price_total > fare_amount THEN price_total - fare_amount END, tax_amount, lk,
  CASE WHEN fare_amount IS NOT NULL THEN greatest(price_total - fare_amount, 0) END)"""


@query("monitor_cells_tax_lookup", "cycle_id:s flight_group_id:s trip_request_id:s departure_date:D leg_sequence:i "
       "trip_origin:s tax_amount:d2", sql("SELECT * FROM cells", needs="offers meta", ctes=f"""{_TOP}, {_CAP},
  lookup AS (SELECT cycle_id, airline, origin, destination, flight_number, departure, cabin,
    max(CAST({_PG} AS DECIMAL(12,2))) AS lk FROM offers JOIN meta USING (offer_id) GROUP BY ALL),
  {_cells(_BQ, "LEFT JOIN lookup USING (cycle_id, airline, origin, destination, flight_number, departure, cabin)")}"""))
def _cells_bq(ctx):
    # The cells and the tax fact join the same offers with the same side-cars: both are dealt by offer once.
    offers = shuffled_once(ctx.sharing.offers, "offer_id")
    meta = shuffled_once(ctx.sharing.meta_with(f"{_SIDE} currency").drop("meta_id"), "offer_id")
    return cells(ctx, offers, meta, dialect="bq", tax=reporting.tax_snapshot(offers, meta))


_MATRIX = _CELLS + f""",
  now_ AS (SELECT * FROM cells WHERE cycle_id = {NEWEST}),
  hist AS (SELECT * FROM cells WHERE (route_key, departure_date) IN (SELECT route_key, departure_date FROM now_)
    AND (route_key, flight_group_id) IN (SELECT route_key, flight_group_id FROM now_)
    QUALIFY row_number() OVER (PARTITION BY route_key, departure_date, flight_group_id, captured_at_utc ORDER BY
      trip_request_id NULLS LAST, leg_sequence NULLS LAST, departure_utc NULLS LAST, min_total_price_bdt NULLS LAST,
      max_total_price_bdt NULLS LAST) = 1),
  prevd AS (SELECT *, lag(min_total_price_bdt) OVER w AS prev_price, lag(captured_at_utc) OVER w AS prev_cap FROM hist
    WINDOW w AS (PARTITION BY route_key, departure_date, flight_group_id ORDER BY captured_at_utc)),
  caps AS (SELECT route_key, departure_date, captured_at_utc, row_number() OVER (PARTITION BY route_key, departure_date
    ORDER BY captured_at_utc DESC) AS capture_rank FROM (SELECT DISTINCT route_key, departure_date, captured_at_utc FROM hist)),
  matrix AS (SELECT *, capture_rank = 1 AS is_latest, dayname(departure_date) AS day_label,
    CASE WHEN soldout THEN 'sold_out' WHEN prev_cap IS NULL THEN 'new'
      WHEN min_total_price_bdt > prev_price THEN 'increase' WHEN min_total_price_bdt < prev_price THEN 'decrease'
      ELSE 'unknown' END AS signal FROM prevd JOIN caps USING (route_key, departure_date, captured_at_utc))"""


def matrix(ctx):
    """Monitor matrix over stored cells."""
    return monitor.monitor_matrix(stored(ctx, "monitor-cells", lambda: cells(ctx)), newest(ctx))


_M = ("route_key:s departure_date:D day_label:s captured_at_utc:t is_latest:b flight_group_id:s signal:s "
      "min_total_price_bdt:d2 max_total_price_bdt:d2 tax_amount:d2 soldout:b")


@query("monitor_matrix", _M, sql("SELECT * FROM matrix", needs="offers meta", ctes=_MATRIX))
def _matrix(ctx):
    return monitor.flatten_matrix(matrix(ctx))


@query("monitor_signal_counts", "signal:s cells:i", sql(
    "SELECT signal, count(*) AS cells FROM matrix WHERE is_latest GROUP BY 1", needs="offers meta", ctes=_MATRIX))
def _counts(ctx):
    return monitor.matrix_signal_counts(matrix(ctx))


@query("monitor_route_leader", "route_key:s amount:d2 airline:s flight_number:s dates:a", sql("""
  SELECT b.*, d.dates FROM (SELECT route_key, min_total_price_bdt AS amount, airline, flight_number FROM matrix
    WHERE is_latest QUALIFY row_number() OVER (PARTITION BY route_key ORDER BY min_total_price_bdt, departure_date,
    departure_time, airline, flight_number, flight_group_id) = 1) b
  JOIN (SELECT route_key, min_total_price_bdt AS amount, list_sort(list_distinct(list(CAST(departure_date AS VARCHAR)))) AS dates
    FROM matrix WHERE is_latest GROUP BY 1, 2) d USING (route_key, amount)""", needs="offers meta", ctes=_MATRIX))
def _leader(ctx):
    return monitor.route_leader(matrix(ctx))


@query("monitor_matrix_filtered", _M, sql("""SELECT * FROM vis WHERE (route_key, departure_date) IN (
  SELECT route_key, departure_date FROM (SELECT *, max(captured_at_utc) OVER (PARTITION BY route_key, departure_date) AS mx
  FROM vis) WHERE captured_at_utc = mx AND signal IN ('sold_out', 'decrease'))""", needs="offers meta",
       ctes=_MATRIX + ", vis AS (SELECT * FROM matrix WHERE airline IN ('A1', 'A3'))"))
def _filtered(ctx):
    return monitor.filter_matrix(matrix(ctx), ["A1", "A3"], ["sold_out", "decrease"])


@query("monitor_matrix_context", "route_key:s airline:s cells:i", sql("""SELECT route_key, airline, count(*) AS cells
  FROM matrix WHERE route_key IN (SELECT route_key FROM matrix WHERE airline = 'A2') GROUP BY 1, 2""",
       needs="offers meta", ctes=_MATRIX))
def _context(ctx):
    kept = monitor.filter_matrix(matrix(ctx), ["A2"], context=True)
    return kept.groupBy("route_key", "airline").agg(F.count("*").alias("cells"))


# ---------------------------------------------------------------- operations

_INST = f"""inst AS (SELECT * FROM (SELECT cycle_id, offer_id, o.captured_at AS captured_at_utc, airline, origin, destination,
  origin || '-' || destination AS route_key, flight_number, CAST(departure AS DATE) AS departure_date,
  strftime(departure, '%H:%M') AS departure_time, via_airports, coalesce(stops, 0) AS stops
  FROM offers o LEFT JOIN meta m USING (offer_id) WHERE cycle_id = {NEWEST})
  QUALIFY row_number() OVER (PARTITION BY route_key, airline, flight_number, departure_date, departure_time,
    coalesce(via_airports, '') ORDER BY captured_at_utc DESC, stops, offer_id DESC) = 1)"""
_LABEL = "CASE WHEN stops <= 0 THEN 'Direct' WHEN stops = 1 THEN '1 stop' ELSE stops || ' stops' END"


def instances(ctx):
    return operations.flight_instances(ctx.offers, ctx.meta_with("via_airports stops"), newest(ctx))


@query("flight_instances", "cycle_id:s captured_at_utc:t airline:s route_key:s flight_number:s departure_date:D "
       "departure_time:s via_airports:s stops:i", sql("SELECT * FROM inst", needs="offers meta", ctes=_INST))
def _instances(ctx):
    return instances(ctx)


_VIA = """coalesce(list_sort(list_distinct(flatten(list(string_split(via_airports, '|')) FILTER
  (WHERE via_airports IS NOT NULL)))), [])"""
_PROFILE = f"""count(*) AS flight_instance_count, count(DISTINCT departure_date) AS active_date_count,
  min(departure_time) AS first_departure_time, max(departure_time) AS last_departure_time,
  list_sort(list_distinct(list(departure_time))) AS departure_times,
  list_transform(list_sort(list_distinct(list(CASE WHEN stops <= 0 THEN '0' ELSE '1' END || {_LABEL}))),
    lambda x: substr(x, 2)) AS service_patterns, {_VIA} AS via_airports"""
_PROFILE_COLS = ("flight_instance_count:i active_date_count:i first_departure_time:s last_departure_time:s "
                 "departure_times:a service_patterns:a via_airports:a")


@query("operations_routes", "route_key:s airline_count:i " + _PROFILE_COLS, sql(f"""SELECT route_key,
  count(DISTINCT airline) AS airline_count, {_PROFILE} FROM inst GROUP BY 1""", needs="offers meta", ctes=_INST))
def _routes(ctx):
    return operations.route_profile(instances(ctx))


@query("operations_airlines", "route_key:s airline:s flight_numbers:a " + _PROFILE_COLS, sql(f"""SELECT route_key, airline,
  list_sort(list_distinct(list(flight_number))) AS flight_numbers, {_PROFILE} FROM inst GROUP BY 1, 2""",
       needs="offers meta", ctes=_INST))
def _airlines(ctx):
    return operations.airline_profile(instances(ctx))


_DAYNO = "(isodow(departure_date) - 1)"


@query("operations_route_weekdays", "route_key:s day_label:s day_order:i flight_instance_count:i active_date_count:i "
       "airline_count:i airlines:a", sql(f"""SELECT route_key, dayname(departure_date) AS day_label, {_DAYNO} AS day_order,
  count(*) AS flight_instance_count, count(DISTINCT departure_date) AS active_date_count,
  count(DISTINCT airline) AS airline_count, list_sort(list_distinct(list(airline))) AS airlines FROM inst
  GROUP BY 1, 2, 3""", needs="offers meta", ctes=_INST))
def _weekdays(ctx):
    return operations.operations_profile(instances(ctx))["route_weekdays"]


@query("operations_airline_weekdays", "route_key:s airline:s day_label:s day_order:i flight_instance_count:i "
       "active_date_count:i", sql(f"""SELECT route_key, airline, dayname(departure_date) AS day_label,
  {_DAYNO} AS day_order, count(*) AS flight_instance_count, count(DISTINCT departure_date) AS active_date_count
  FROM inst GROUP BY ALL""", needs="offers meta", ctes=_INST))
def _airline_weekdays(ctx):
    return operations.weekday_profile(instances(ctx), by_airline=True)


@query("operations_days", "route_key:s departure_date:D day_label:s flight_instance_count:i airline_count:i "
       "first_departure_time:s last_departure_time:s", sql("""SELECT route_key, departure_date,
  dayname(departure_date) AS day_label, count(*) AS flight_instance_count, count(DISTINCT airline) AS airline_count,
  min(departure_time) AS first_departure_time, max(departure_time) AS last_departure_time FROM inst GROUP BY 1, 2""",
       needs="offers meta", ctes=_INST))
def _days(ctx):
    return operations.day_profile(instances(ctx))


_TREND = """rec AS (SELECT cycle_id, max(captured_at) AS cycle_completed_at_utc FROM offers GROUP BY 1
  HAVING count(*) >= 500 ORDER BY 2 DESC, 1 DESC LIMIT 6),
  ops AS (SELECT DISTINCT cycle_id, cycle_completed_at_utc, airline, origin || '-' || destination AS route_key,
    flight_number, CAST(departure AS DATE) AS departure_date, strftime(departure, '%H:%M') AS departure_time, via_airports
    FROM offers LEFT JOIN meta USING (offer_id) JOIN rec USING (cycle_id))"""
_TREND_MEASURES = """count(*) AS flight_instance_count, count(DISTINCT departure_date) AS active_date_count,
  min(departure_time) AS first_departure_time, max(departure_time) AS last_departure_time"""
_TREND_COLS = ("cycle_id:s cycle_completed_at_utc:t route_key:s flight_instance_count:i active_date_count:i "
               "first_departure_time:s last_departure_time:s ")


@query("operations_trend_routes", _TREND_COLS + "airline_count:i", sql(f"""SELECT cycle_id, cycle_completed_at_utc,
  route_key, count(DISTINCT airline) AS airline_count, {_TREND_MEASURES} FROM ops GROUP BY 1, 2, 3""",
       needs="offers meta", ctes=_TREND))
def _trend(ctx):
    return operations.operations_trend(ctx.offers, ctx.meta_with("via_airports stops"), recent(ctx))


@query("operations_trend_airlines_via", _TREND_COLS + "airline:s", sql(f"""SELECT cycle_id, cycle_completed_at_utc,
  route_key, airline, {_TREND_MEASURES} FROM ops WHERE list_has_any(string_split(coalesce(via_airports, ''), '|'), ['BBB'])
  GROUP BY 1, 2, 3, 4""", needs="offers meta", ctes=_TREND))
def _trend_via(ctx):
    return operations.operations_trend(ctx.offers, ctx.meta_with("via_airports stops"), recent(ctx), True, ["bbb"])


@query("network_summary", "route_count:i airline_count:i flight_instance_count:i active_date_count:i "
       "transit_airport_count:i network_window:s", sql("""SELECT count(*) AS route_count,
  (SELECT count(DISTINCT airline) FROM inst) AS airline_count, sum(n) AS flight_instance_count,
  sum(days) AS active_date_count, (SELECT count(DISTINCT a) FROM (SELECT unnest(string_split(via_airports, '|')) AS a
  FROM inst)) AS transit_airport_count, min(f) || ' to ' || max(l) AS network_window FROM (SELECT route_key,
  count(*) AS n, count(DISTINCT departure_date) AS days, min(departure_time) AS f, max(departure_time) AS l
  FROM inst GROUP BY 1)""", needs="offers meta", ctes=_INST))
def _network(ctx):
    return operations.network_summary(instances(ctx))
