"""Queries over cycle comparison and flight/day views."""

from datetime import date

from pyspark.sql import functions as F

from farescope.catalog.base import query, sql, stored
from farescope.catalog.q_reporting import COUNTRY
from farescope.functions import COMPARE_KEY, PENALTY_FEES
from farescope.operators import compare

_K = ", ".join(COMPARE_KEY)
_SIDE = ["penalty_source", "penalty_currency", "penalty_rule_text", *PENALTY_FEES, "fare_refundable", "fare_changeable"]


def _collapsed(name: str, rank: int) -> str:
    return (f"{name} AS MATERIALIZED (SELECT {_K}, min(offer_id) AS id, min(price_total) AS price, max(seat_capacity) AS cap, "
            f"max(seat_available) AS seats FROM offers JOIN two USING (cycle_id) WHERE n = {rank} GROUP BY {_K})")


_SAME = " AND ".join(f"c.{k} = p.{k}" for k in COMPARE_KEY)
CMP = f"""two AS MATERIALIZED (SELECT cycle_id, row_number() OVER (ORDER BY min(captured_at) DESC) AS n FROM offers GROUP BY 1),
  {_collapsed('cur', 1)}, {_collapsed('prev', 2)},
  ranked AS (SELECT *, min(price) OVER (PARTITION BY origin, destination) AS route_min FROM cur),
  cmp AS (SELECT *, origin || '-' || destination AS route, strftime(departure, '%H:%M') AS departure_time,
    CAST(departure AS DATE) AS flight_date, origin || '-' || destination || '|' || airline || '|' || flight_number || '|'
    || strftime(departure, '%H:%M') AS flight_key FROM (
    SELECT {', '.join(f'coalesce(c.{k}, p.{k}) AS {k}' for k in COMPARE_KEY)}, p.price AS previous_fare_bdt,
      c.price AS current_fare_bdt, c.cap AS seat_capacity, p.cap AS previous_seat_capacity, p.seats AS previous_seats,
      c.seats AS current_seats, coalesce(cm.aircraft, cm.equipment_code, pm.aircraft, pm.equipment_code) AS aircraft,
      coalesce(cm.arrival, pm.arrival) AS arrival, cm.tax_amount AS current_tax, pm.tax_amount AS previous_tax,
      coalesce(cm.booking_class, pm.booking_class) AS rbd,
      {', '.join(f'cm.{f} AS current_{f}, pm.{f} AS previous_{f}' for f in _SIDE)},
      CASE WHEN p.id IS NULL THEN 'NEW_FLIGHT' WHEN c.id IS NULL THEN 'REMOVED' WHEN c.price > p.price THEN 'INCREASE'
        WHEN c.price < p.price THEN 'DECREASE' ELSE 'UNCHANGED' END AS signal,
      CASE WHEN c.price = c.route_min THEN 1 ELSE 0 END AS is_price_leader
    FROM ranked c FULL OUTER JOIN prev p ON {_SAME} LEFT JOIN meta cm ON cm.offer_id = c.id
    LEFT JOIN meta pm ON pm.offer_id = p.id))"""

_FILL = ["current_fare_bdt", "current_tax", "current_seats", "seat_capacity", "rbd"]
_ORDER = ("flight_date, current_fare_bdt NULLS LAST, cabin NULLS LAST, brand NULLS LAST, rbd NULLS LAST, "
          "current_tax NULLS LAST, previous_tax NULLS LAST, signal NULLS LAST")
_PRESS = ("CASE WHEN {x} IS NOT NULL AND seat_capacity > 0 THEN "
          "(1 - least(1.0, greatest(0.0, CAST({x} AS DOUBLE) / seat_capacity))) * 100.0 END")
FIN = CMP + f""",
  filled AS (SELECT * REPLACE ({', '.join(f'last_value({c} IGNORE NULLS) OVER w AS {c}' for c in _FILL)}),
    row_number() OVER w AS place FROM cmp WINDOW w AS (PARTITION BY flight_key ORDER BY {_ORDER}
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  cls AS (SELECT flight_key, flight_date, rbd, min(current_fare_bdt) AS fare,
    max(current_seats) FILTER (WHERE current_fare_bdt IS NOT NULL) AS fare_seats, min(previous_fare_bdt) AS prev_fare,
    max(current_seats) AS seats, max(previous_seats) AS prev_seats, count(previous_fare_bdt) AS prev_rows
    FROM filled GROUP BY 1, 2, 3),
  lo AS (SELECT flight_key, flight_date, rbd AS min_rbd, fare_seats AS min_rbd_seats FROM cls WHERE fare IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY flight_key, flight_date ORDER BY fare, coalesce(rbd, '__UNK__')) = 1),
  hi AS (SELECT flight_key, flight_date, rbd AS max_rbd, fare_seats AS max_rbd_seats FROM cls WHERE fare IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY flight_key, flight_date ORDER BY fare DESC, coalesce(rbd, '__UNK__')) = 1),
  lev AS (SELECT flight_key, flight_date, min(fare) AS min_fare, max(fare) AS max_fare,
    min(prev_fare) FILTER (WHERE rbd IS NOT NULL) AS previous_min_fare,
    max(prev_fare) FILTER (WHERE rbd IS NOT NULL) AS previous_max_fare,
    sum(seats) FILTER (WHERE rbd IS NOT NULL) AS min_seats,
    sum(prev_seats) FILTER (WHERE rbd IS NOT NULL) AS previous_min_seats, sum(prev_rows) = 0 AS is_new_flight
    FROM cls GROUP BY 1, 2),
  lab AS (SELECT flight_key, coalesce(array_to_string(list_sort(list_distinct(list(aircraft) FILTER (WHERE aircraft IS NOT NULL))),
    ' / '), '') AS aircraft_label FROM filled GROUP BY 1),
  base AS (SELECT f.*, lev.* EXCLUDE (flight_key, flight_date), min_rbd, min_rbd_seats, max_rbd, max_rbd_seats,
    aircraft_label, seat_capacity AS max_seats,
    CASE WHEN is_new_flight AND min_seats > 0 THEN 'NEW' WHEN min_seats = 0 THEN 'SOLD OUT' ELSE 'NORMAL' END AS status,
    {_PRESS.format(x='min_seats')} AS load_pct, {_PRESS.format(x='previous_min_seats')} AS previous_load_pct
    FROM (SELECT * FROM filled QUALIFY row_number() OVER (PARTITION BY flight_key, flight_date ORDER BY place DESC) = 1) f
    JOIN lev USING (flight_key, flight_date) LEFT JOIN lo USING (flight_key, flight_date)
    LEFT JOIN hi USING (flight_key, flight_date) JOIN lab USING (flight_key)),
  fin AS (SELECT *, min_fare - previous_min_fare AS min_fare_delta, max_fare - previous_max_fare AS max_fare_delta,
    min_seats - previous_min_seats AS seat_delta, current_tax - previous_tax AS tax_delta,
    load_pct - previous_load_pct AS load_delta, {', '.join(f'current_{f} - previous_{f} AS {f}_delta' for f in PENALTY_FEES)},
    coalesce(min_fare = min(min_fare) OVER (PARTITION BY route, flight_date), false) AS leader,
    bool_or(min_fare IS NOT NULL OR current_tax IS NOT NULL) OVER (PARTITION BY flight_key) AS row_visible,
    dayname(flight_date) AS day_name FROM base),
  fl AS (SELECT * EXCLUDE (min_fare_delta, max_fare_delta, tax_delta, seat_delta, load_delta, aircraft, min_rbd, max_rbd),
    coalesce(min_fare_delta, 0) AS min_fare_delta, coalesce(max_fare_delta, 0) AS max_fare_delta,
    coalesce(tax_delta, 0) AS tax_delta, coalesce(seat_delta, 0) AS seat_delta, coalesce(load_delta, 0) AS load_delta,
    coalesce(nullif(trim(aircraft), ''), nullif(aircraft_label, ''), 'Aircraft NA') AS aircraft,
    coalesce(min_rbd, '') AS min_rbd, coalesce(max_rbd, '') AS max_rbd FROM fin WHERE row_visible)"""


def _two(ctx):
    """Newest and second newest cycle ids as scalar subqueries."""
    order = ctx.cycle_order
    newest = order.agg(F.max_by("cycle_id", "started_at")).scalar()
    before = order.where("next_started_at is not null").agg(F.max_by("cycle_id", "started_at")).scalar()
    return newest, before


_META = "tax_amount aircraft equipment_code arrival booking_class source_endpoint " + " ".join(_SIDE)


def compared(ctx):
    return compare.compare_scrapes(ctx.offers, ctx.meta_with(_META), *_two(ctx))


def finalized(ctx):
    return compare.finalize_comparison(compared(ctx))


def flights(ctx):
    """Flight and day rows of the two newest cycles, stored for the views built on them."""
    return stored(ctx, "flights", lambda: compare.prepare_flights(finalized(ctx)))


_KEYS = "airline:s origin:s destination:s flight_number:s departure:t cabin:s brand:s "


@query("compare_scrapes", _KEYS + "previous_fare_bdt:d2 current_fare_bdt:d2 seat_capacity:i previous_seat_capacity:i "
       "previous_seats:i current_seats:i aircraft:s arrival:t current_tax:d2 previous_tax:d2 rbd:s signal:s "
       "is_price_leader:i flight_key:s flight_date:D current_penalty_rule_text:s previous_penalty_rule_text:s "
       "current_fare_change_fee_before_24h:d2 previous_fare_cancel_fee_no_show:d2",
       sql("SELECT * FROM cmp", needs="offers meta", ctes=CMP))
def _compare(ctx):
    return compared(ctx)


@query("compare_signal_counts", "airline:s signal:s offers:i leaders:i", sql("""SELECT airline, signal,
  count(*) AS offers, sum(is_price_leader) AS leaders FROM cmp GROUP BY 1, 2""", needs="offers meta", ctes=CMP))
def _signals(ctx):
    return compared(ctx).groupBy("airline", "signal").agg(
        F.count("*").alias("offers"), F.sum("is_price_leader").alias("leaders"))


@query("finalize_comparison", "flight_key:s flight_date:D day_name:s min_fare:d2 max_fare:d2 min_rbd:s min_rbd_seats:i "
       "max_rbd:s max_rbd_seats:i previous_min_fare:d2 previous_max_fare:d2 min_seats:i previous_min_seats:i "
       "max_seats:i is_new_flight:b status:s load_pct:d4 previous_load_pct:d4 min_fare_delta:d2 max_fare_delta:d2 "
       "seat_delta:i tax_delta:d2 load_delta:d4 fare_change_fee_before_24h_delta:d2 leader:b aircraft_label:s "
       "current_tax:d2 previous_tax:d2 rbd:s", sql("SELECT * FROM fin WHERE row_visible", needs="offers meta", ctes=FIN))
def _finalize(ctx):
    return finalized(ctx)


_SCOPE = "airline, origin, destination, flight_number, flight_date, departure_time"
_HIST = f"""h AS (SELECT cycle_id, airline, origin, destination, flight_number, CAST(departure AS DATE) AS flight_date,
    strftime(departure, '%H:%M') AS departure_time, departure, max(o.captured_at) AS captured_at_utc,
    min(price_total) AS min_fare, max(price_total) AS max_fare, min(tax_amount) AS tax_amount,
    min(seat_available) AS min_seats, max(seat_available) AS max_seats, max(seat_capacity) AS seat_capacity,
    count(*) AS offer_rows FROM offers o LEFT JOIN meta m USING (offer_id) GROUP BY ALL),
  hs AS (SELECT *, round_even(100.0::DOUBLE * (1.0 - min_seats / nullif(seat_capacity, 0)::DOUBLE), 1) AS load_pct,
    strftime(captured_at_utc, '%d %b, %H:%M') AS capture_label, origin || '-' || destination AS route,
    CASE WHEN min_seats = 0 THEN 'SOLD OUT' WHEN min_seats IS NULL AND min_fare IS NULL THEN 'UNKNOWN' ELSE 'AVAILABLE' END
    AS status FROM h WHERE ({_SCOPE}) IN (SELECT {_SCOPE} FROM fl)),
  hd AS (SELECT *, {', '.join(f'{f} - lag({f}) OVER w AS {f}_delta' for f in
    ('min_fare', 'max_fare', 'tax_amount', 'min_seats', 'max_seats', 'load_pct'))},
    coalesce(lag(capture_label) OVER w, '') AS previous_capture_label FROM hs
    WINDOW w AS (PARTITION BY {_SCOPE} ORDER BY captured_at_utc, cycle_id)),
  hist AS (SELECT *, CASE WHEN previous_capture_label = '' OR {' OR '.join(f'coalesce({f}_delta <> 0, true)' for f in
    ('min_fare', 'max_fare', 'tax_amount', 'min_seats', 'max_seats', 'load_pct'))} THEN 'CHANGED/NEW' ELSE 'NO_CHANGE' END
    AS state_changed_flag, dayname(flight_date) AS day_name FROM hd)"""


def history(ctx):
    return compare.capture_history(ctx.offers, ctx.meta_with("tax_amount"), flights(ctx))


@query("capture_history", "route:s airline:s flight_number:s flight_date:D day_name:s departure_time:s cycle_id:s "
       "captured_at_utc:t capture_label:s previous_capture_label:s state_changed_flag:s status:s min_fare:d2 "
       "max_fare:d2 tax_amount:d2 min_seats:i max_seats:i seat_capacity:i load_pct:d2 min_fare_delta:d2 "
       "max_fare_delta:d2 tax_amount_delta:d2 min_seats_delta:i max_seats_delta:i load_pct_delta:d2 offer_rows:i",
       sql("SELECT * FROM hist", needs="offers meta", ctes=FIN + ", " + _HIST))
def _history(ctx):
    return history(ctx)


@query("changed_captures", "route:s flight_date:D captured_at_utc:t capture_label:s", sql("""SELECT DISTINCT route,
  flight_date, captured_at_utc, capture_label, cycle_id FROM hist WHERE state_changed_flag <> 'NO_CHANGE'""",
       needs="offers meta", ctes=FIN + ", " + _HIST))
def _changed(ctx):
    return compare.changed_captures(history(ctx))


_UP = " OR ".join(f"{d} > 0" for d in compare.DELTAS)
_DOWN = " OR ".join(f"{d} < 0" for d in compare.DELTAS)


@query("flight_filter_view", "route:s flight_date:D day_name:s airline:s flight_number:s departure_time:s status:s "
       "signal_primary:s min_fare:d2 max_fare:d2 current_tax:d2 min_seats:i max_seats:i load_pct:d4 min_fare_delta:d2 "
       "max_fare_delta:d2 tax_delta:d2 seat_delta:i load_delta:d4", sql(f"""SELECT *, CASE WHEN status = 'NEW' THEN 'NEW'
  WHEN status = 'SOLD OUT' THEN 'SOLD OUT' WHEN ({_UP}) AND ({_DOWN}) THEN 'MIXED' WHEN {_UP} THEN 'INCREASE'
  WHEN {_DOWN} THEN 'DECREASE' WHEN coalesce(min_fare, max_fare, current_tax, min_seats, max_seats, load_pct) IS NULL
  THEN 'UNKNOWN' ELSE 'STABLE' END AS signal_primary FROM fl""", needs="offers meta", ctes=FIN))
def _view(ctx):
    return compare.filter_view(flights(ctx))


@query("route_signals", "route:s signals:a", sql(f"""SELECT route, coalesce(nullif(list_sort(list_distinct(list(s)
  FILTER (WHERE s IS NOT NULL))), []), ['UNKNOWN']) AS signals FROM (
  SELECT route, CASE WHEN status IN ('NEW', 'SOLD OUT') THEN status END AS s FROM fl
  UNION ALL SELECT route, CASE WHEN {_UP} THEN 'INCREASE' END FROM fl
  UNION ALL SELECT route, CASE WHEN {_DOWN} THEN 'DECREASE' END FROM fl) GROUP BY 1""", needs="offers meta", ctes=FIN))
def _route_signals(ctx):
    return compare.route_signals(flights(ctx))


_FLAG = {
    "new": "status = 'NEW'", "sold_out": "status = 'SOLD OUT'", "fare_up": "min_fare_delta > 0 OR max_fare_delta > 0",
    "fare_down": "min_fare_delta < 0 OR max_fare_delta < 0", "seat_up": "seat_delta > 0", "seat_down": "seat_delta < 0",
    "tax_up": "tax_delta > 0", "tax_down": "tax_delta < 0", "load_up": "load_delta > 0", "load_down": "load_delta < 0",
}


@query("changes_by_airline", "airline:s rows:i " + " ".join(f"{f}:i" for f in _FLAG), sql(
    "SELECT airline, count(*) AS rows, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in _FLAG.items())
    + " FROM fl GROUP BY 1", needs="offers meta", ctes=FIN))
def _by_airline(ctx):
    return compare.changes_by_airline(flights(ctx))


_KEPT = ["new", "sold_out", "fare_up", "fare_down", "seat_down", "load_up"]


@query("changes_by_route", "route:s airline:s rows:i total_events:i " + " ".join(f"{f}:i" for f in _KEPT), sql(
    "SELECT *, " + " + ".join(_KEPT) + " AS total_events FROM (SELECT route, airline, count(*) AS rows, " + ", ".join(
        f"count(*) FILTER (WHERE {_FLAG[n]}) AS {n}" for n in _KEPT)
    + " FROM fl GROUP BY 1, 2)", needs="offers meta",
    ctes=FIN))
def _by_route(ctx):
    return compare.changes_by_route(flights(ctx))


def _penalty_sql() -> str:
    def agg(s):
        first = ", ".join(f"first(nullif(trim({s}_{f}), '') ORDER BY flight_key, trim({s}_{f})) FILTER "
                          f"(WHERE nullif(trim({s}_{f}), '') IS NOT NULL) AS {s}_{f}"
                          for f in ("penalty_currency", "penalty_rule_text"))
        return (", ".join(f"min({s}_{f})::DOUBLE AS {s}_{f}" for f in PENALTY_FEES) + ", "
                + ", ".join(f"bool_or({s}_{f}) AS {s}_{f}" for f in ("fare_refundable", "fare_changeable")) + ", " + first)

    def known(s):
        return "(" + " OR ".join(f"{s}_{f} IS NOT NULL" for f in
                                 [*PENALTY_FEES, "fare_refundable", "fare_changeable", "penalty_rule_text"]) + ")"

    def key(s):
        return ("ROW(" + ", ".join(f"{s}_{f}" for f in [*PENALTY_FEES, "fare_refundable", "fare_changeable"])
                + f", upper(trim(coalesce({s}_penalty_currency, ''))), lower(regexp_replace(trim(coalesce("
                f"{s}_penalty_rule_text, '')), '\\s+', ' ', 'g')))")

    def snap(s):
        def fee(f):
            return f"coalesce(format('{{:,.0f}}', {s}_{f}), '--')"

        def flag(f):
            return f"CASE WHEN {s}_{f} THEN 'Yes' WHEN NOT {s}_{f} THEN 'No' ELSE '--' END"
        return (f"coalesce(nullif(upper({s}_penalty_currency), ''), '--') || ' | Chg:' || "
                + " || '/' || ".join(fee(f) for f in PENALTY_FEES[:3]) + " || ' | Can:' || "
                + " || '/' || ".join(fee(f) for f in PENALTY_FEES[3:])
                + f" || ' | Refundable:' || {flag('fare_refundable')} || ' | Changeable:' || {flag('fare_changeable')}"
                + f" || coalesce(' | Note:' || {s}_penalty_rule_text, '')")
    return f"""SELECT route, airline, flight_date, CASE WHEN {known('current')} AND NOT {known('previous')} THEN 'NEW'
      WHEN {known('previous')} AND NOT {known('current')} THEN 'REMOVED' ELSE 'UPDATED' END AS change_type,
      {snap('previous')} AS previous_snapshot, {snap('current')} AS current_snapshot FROM (
      SELECT route, airline, flight_date, {agg('current')}, {agg('previous')} FROM fl GROUP BY 1, 2, 3)
      WHERE ({known('current')} OR {known('previous')}) AND {key('current')} IS DISTINCT FROM {key('previous')}"""


@query("penalty_changes", "route:s airline:s flight_date:D change_type:s previous_snapshot:s current_snapshot:s",
       sql(_penalty_sql(), needs="offers meta", ctes=FIN))
def _penalty(ctx):
    return compare.penalty_changes(flights(ctx))


_F, _T = COUNTRY.format(x="origin"), COUNTRY.format(x="destination")


@query("tax_changes", "flow_label:s flow_order:i route:s airline:s flight_date:D current_tax_text:s curr_min:d2 "
       "curr_max:d2 curr_count:i change_flag:s", sql(f"""SELECT *, CASE WHEN f = 'X' AND t = 'X' THEN 'X->X'
  WHEN f = 'X' AND t IS NOT NULL THEN 'X->Outside' WHEN t = 'X' AND f IS NOT NULL THEN 'Outside->X'
  WHEN f IS NOT NULL AND t IS NOT NULL THEN 'Outside->Outside' ELSE 'Unknown' END AS flow_label,
  CASE WHEN f = 'X' AND t = 'X' THEN 1 WHEN f = 'X' AND t IS NOT NULL THEN 2 WHEN t = 'X' AND f IS NOT NULL THEN 3
  WHEN f IS NOT NULL AND t IS NOT NULL THEN 4 ELSE 99 END AS flow_order,
  format('{{:,.0f}}', CAST(curr_min AS DOUBLE)) || CASE WHEN curr_min = curr_max THEN '' ELSE ' to ' ||
    format('{{:,.0f}}', CAST(curr_max AS DOUBLE)) END AS current_tax_text,
  CASE WHEN prev_count = 0 THEN 'NEW' WHEN curr_min <> prev_min OR curr_max <> prev_max OR curr_count <> prev_count
    THEN 'CHANGED' ELSE 'NO_CHANGE' END AS change_flag FROM (SELECT route, airline, flight_date, {_F} AS f, {_T} AS t,
  min(current_tax) AS curr_min, max(current_tax) AS curr_max, count(current_tax) AS curr_count,
  min(previous_tax) AS prev_min, max(previous_tax) AS prev_max, count(previous_tax) AS prev_count FROM fl
  GROUP BY ALL) WHERE curr_count > 0""", needs="offers meta", ctes=FIN))
def _tax(ctx):
    return compare.tax_changes(flights(ctx), ctx.airports, "X")


@query("fare_pivot", "route:s airline:s flight_key:s flight_label:s 2030-01-01:d2 2030-01-02:d2", sql("""SELECT route,
  airline, flight_key, airline || flight_number AS flight_label,
  min(min_fare) FILTER (WHERE flight_date = DATE '2030-01-01') AS "2030-01-01",
  min(min_fare) FILTER (WHERE flight_date = DATE '2030-01-02') AS "2030-01-02" FROM fl GROUP BY 1, 2, 3, 4""",
       needs="offers meta", ctes=FIN))
def _pivot(ctx):
    return compare.fare_pivot(flights(ctx), [date(2030, 1, 1), date(2030, 1, 2)])


_PEAK = """pk AS (SELECT airline, max(running) AS peak FROM (SELECT airline, sum(step) OVER (PARTITION BY airline
  ORDER BY moment, step ROWS UNBOUNDED PRECEDING) AS running FROM (
  SELECT airline, departure AS moment, 1 AS step FROM fl WHERE arrival > departure
  UNION ALL SELECT airline, arrival, -1 FROM fl WHERE arrival > departure)) GROUP BY 1)"""


@query("peak_concurrent_flights", "airline:s peak:i", sql("SELECT * FROM pk", needs="offers meta", ctes=FIN + ", " + _PEAK))
def _peak(ctx):
    return compare.peak_concurrent(flights(ctx))


def fleet(ctx):
    """Fleet table derived from suppliers: a few types per carrier."""
    return ctx.table("supplier").selectExpr("concat('A', s_suppkey % 5) AS airline", "s_suppkey % 3 AS k").groupBy(
        "airline", F.expr("concat('Type ', k)").alias("aircraft_type"), (F.col("k") * 50 + 100).alias("seats_per_aircraft")
    ).agg(F.count("*").alias("aircraft_count"))


_FLEET = """fleet AS (SELECT concat('A', s_suppkey % 5) AS airline, concat('Type ', s_suppkey % 3) AS aircraft_type,
  s_suppkey % 3 * 50 + 100 AS seats_per_aircraft, count(*) AS aircraft_count FROM supplier GROUP BY 1, 2, 3)"""


@query("ops_by_airline", "airline:s observed_rows:i observed_routes:i daily_avg:d2 weekly_est:d2 first_departure:s "
       "last_departure:s fleet_count:i fleet_types:a seat_capacities:a search_fleet_lb:i fleet_coverage_pct:d2", sql(
    f"""SELECT *, round_even(observed_rows / days, 2) AS daily_avg, round_even(round_even(observed_rows / days, 2) * 7.0::DOUBLE, 2)
  AS weekly_est, peak AS search_fleet_lb, round_even(peak / fleet_count * 100.0, 2) AS fleet_coverage_pct,
  types AS fleet_types, caps AS seat_capacities FROM (
  SELECT airline, count(*) AS observed_rows, count(DISTINCT flight_date) AS days, count(DISTINCT route) AS observed_routes,
    min(departure_time) AS first_departure, max(departure_time) AS last_departure FROM fl GROUP BY 1)
  LEFT JOIN (SELECT airline, sum(aircraft_count) AS fleet_count, list(aircraft_type ORDER BY aircraft_type) AS types,
    list_sort(list_distinct(list(CAST(seats_per_aircraft AS VARCHAR)))) AS caps FROM fleet GROUP BY 1) USING (airline)
  LEFT JOIN pk USING (airline)""", needs="offers meta", ctes=FIN + ", " + _PEAK + ", " + _FLEET))
def _ops_airline(ctx):
    return compare.ops_by_airline(flights(ctx), fleet(ctx))


@query("ops_by_route", "airline:s route:s operating_days:i observed_flights:i daily_avg:d2 weekly_est:d2 timings:a "
       "aircraft_types:a", sql(f"""SELECT *, round_even(observed_flights / operating_days, 2) AS daily_avg,
  round_even(round_even(observed_flights / operating_days, 2) * 7.0::DOUBLE, 2) AS weekly_est,
  times AS timings FROM (SELECT airline, route, count(DISTINCT flight_date) AS operating_days,
  count(flight_key) AS observed_flights, list_sort(list_distinct(list(departure_time))) AS times,
  list_sort(list_distinct(list(aircraft))) AS aircraft_types FROM fl GROUP BY 1, 2)""", needs="offers meta", ctes=FIN))
def _ops_route(ctx):
    return compare.ops_by_route(flights(ctx))


@query("ops_by_route_day", "route:s day_name:s total:i details:a", sql(f"""SELECT route, day_name, total,
  e AS details FROM (SELECT route, day_name, sum(flights) AS total,
    list(airline || ':' || flights || '[' || array_to_string(times, ', ') || ']' ORDER BY airline) AS e FROM (
    SELECT route, day_name, airline, count(flight_key) AS flights, list_sort(list_distinct(list(departure_time))) AS times
    FROM fl GROUP BY 1, 2, 3) GROUP BY 1, 2)""", needs="offers meta", ctes=FIN))
def _ops_day(ctx):
    return compare.ops_by_route_day(flights(ctx))
