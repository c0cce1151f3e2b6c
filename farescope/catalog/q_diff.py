"""Queries over change detection."""

from pyspark.sql import functions as F

from farescope.catalog.base import query, sql
from farescope.catalog.change_source import STATE_FIELDS, change_events, pairs, state_rows
from farescope.functions import DIFF_KEY
from farescope.operators import cycles, diff
from farescope.session import work_dir
from farescope.sources.tables import LatestState

_EVENT = ("cycle_id:s previous_cycle_id:s detected_at:t airline:s origin:s destination:s flight_number:s "
          "departure_day:D departure_time:s cabin:s fare_basis:s brand:s domain:s change_type:s direction:s "
          "field_name:s old_value:s new_value:s magnitude:d percent_change:d")
_SUMMARY = ("domain:s change_type:s direction:s velocity:s magnitude:d percent_change:d airline:s flight_number:s "
            "origin:s destination:s cabin:s departure:t from_timestamp:t to_timestamp:t metadata:s")
_KEYS = "airline:s origin:s destination:s departure:t flight_number:s cabin:s fare_basis:s brand:s"


@query("diff_columns", _EVENT, sql("SELECT * FROM changes", needs="changes"))
def _columns(ctx):
    return change_events(ctx)


@query("diff_identity_keys", "identity_key:s events:i", sql("""SELECT '["' || concat_ws('","', airline, origin,
  destination, strftime(departure, '%Y-%m-%dT%H:%M:%S'), flight_number, cabin, fare_basis, brand) || '"]' AS identity_key,
  count(*) AS events FROM changes GROUP BY 1""", needs="changes"))
def _identity(ctx):
    return ctx.changes.groupBy("identity_key").agg(F.count("*").alias("events"))


@query("diff_availability", _SUMMARY, sql("""SELECT 'availability' AS domain, 'removed' AS change_type,
  'down' AS direction, 'unknown' AS velocity, NULL AS magnitude, NULL AS percent_change, airline, flight_number, origin,
  destination, cabin, departure, captured_at AS from_timestamp, captured_at AS to_timestamp,
  '{"reason":"disappeared"}' AS metadata FROM gone
  UNION ALL SELECT 'availability', 'added', 'up', 'unknown', NULL, NULL, airline, flight_number, origin, destination,
  cabin, departure, NULL, captured_at, '{"reason":"newly_available"}' FROM arrived""", needs="changes"))
def _availability(ctx):
    return diff.diff_availability(pairs(ctx))


def _numeric_sql(domain: str, field: str, percent: str, metadata: str) -> str:
    return sql(f"""SELECT '{domain}' AS domain, CASE WHEN c_{field} > p_{field} THEN 'increase' ELSE 'decrease' END
  AS change_type, CASE WHEN c_{field} > p_{field} THEN 'up' ELSE 'down' END AS direction, 'unknown' AS velocity,
  abs(CAST(c_{field} AS DOUBLE) - CAST(p_{field} AS DOUBLE)) AS magnitude, {percent} AS percent_change, airline,
  flight_number, origin, destination, cabin, departure, p_captured_at AS from_timestamp,
  c_captured_at AS to_timestamp, {metadata} AS metadata FROM matched WHERE p_{field} <> c_{field}""", needs="changes")


def _before_after(field: str) -> str:
    return (f"'{{\"before\":' || CAST(CAST(p_{field} AS DOUBLE) AS VARCHAR) || ',\"after\":' || "
            f"CAST(CAST(c_{field} AS DOUBLE) AS VARCHAR) || '}}'")


@query("diff_price", _SUMMARY, _numeric_sql(
    "price", "price_total",
    "(CAST(c_price_total AS DOUBLE) - CAST(p_price_total AS DOUBLE)) / CAST(p_price_total AS DOUBLE) * 100.0",
    _before_after("price_total")))
def _price(ctx):
    return diff.diff_price(pairs(ctx))


@query("diff_seats", _SUMMARY, _numeric_sql("seat", "seat_available", "NULL", _before_after("seat_available")))
def _seats(ctx):
    return diff.diff_seats(pairs(ctx))


_CAPACITY_META = ("'{' || array_to_string(list_filter([CASE WHEN p_aircraft IS NOT NULL THEN "
                  "'\"aircraft_before\":\"' || p_aircraft || '\"' END, CASE WHEN c_aircraft IS NOT NULL THEN "
                  "'\"aircraft_after\":\"' || c_aircraft || '\"' END], lambda x: x IS NOT NULL), ',') || '}'")


@query("diff_capacity", _SUMMARY, _numeric_sql("capacity", "seat_capacity", "NULL", _CAPACITY_META)
       .replace("50 AS seat_capacity", "CAST(50 + l_suppkey % 3 AS INT) AS seat_capacity"))
def _capacity(ctx):
    rows = state_rows(ctx)
    varied = rows.withColumn(
        "seat_capacity", F.expr("CAST(50 + CAST(split_part(offer_id, '-', 4) AS BIGINT) % 3 AS INT)"))
    return diff.diff_capacity(diff.pair_consecutive(diff.cycle_states(varied), ctx.cycle_order))


@query("diff_schedule", _SUMMARY, sql("""SELECT 'schedule' AS domain, 'modified' AS change_type, 'none' AS direction,
  'unknown' AS velocity, NULL AS magnitude, NULL AS percent_change, airline, flight_number, origin, destination, cabin,
  departure, p_captured_at AS from_timestamp, c_captured_at AS to_timestamp,
  '{' || array_to_string(list_filter([
    '"departure_before":"' || strftime(departure, '%Y-%m-%dT%H:%M:%S') || '"',
    '"departure_after":"' || strftime(departure, '%Y-%m-%dT%H:%M:%S') || '"',
    '"arrival_before":"' || strftime(p_arrival, '%Y-%m-%dT%H:%M:%S') || '"',
    '"arrival_after":"' || strftime(c_arrival, '%Y-%m-%dT%H:%M:%S') || '"'], lambda x: x IS NOT NULL), ',') || '}' AS metadata
  FROM matched WHERE p_arrival IS DISTINCT FROM c_arrival""", needs="changes"))
def _schedule(ctx):
    return diff.diff_schedule(pairs(ctx))


@query("diff_event_mix", "domain:s change_type:s direction:s events:i departures:i", sql("""
  SELECT domain, change_type, direction, count(*) AS events, count(DISTINCT departure) AS departures FROM (
    SELECT 'availability' AS domain, 'added' AS change_type, 'up' AS direction, departure FROM arrived
    UNION ALL SELECT 'availability', 'removed', 'down', departure FROM gone
    UNION ALL SELECT 'price', CASE WHEN c_price_total > p_price_total THEN 'increase' ELSE 'decrease' END,
      CASE WHEN c_price_total > p_price_total THEN 'up' ELSE 'down' END, departure FROM matched
      WHERE c_price_total <> p_price_total
    UNION ALL SELECT 'seat', CASE WHEN c_seat_available > p_seat_available THEN 'increase' ELSE 'decrease' END,
      CASE WHEN c_seat_available > p_seat_available THEN 'up' ELSE 'down' END, departure FROM matched
      WHERE c_seat_available <> p_seat_available
    UNION ALL SELECT 'schedule', 'modified', 'none', departure FROM matched
      WHERE c_arrival IS DISTINCT FROM p_arrival) GROUP BY ALL""", needs="changes"))
def _mix(ctx):
    return diff.summary_events(pairs(ctx)).groupBy("domain", "change_type", "direction").agg(
        F.count("*").alias("events"), F.countDistinct("departure").alias("departures"))


_STATE_SQL = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys}
  ORDER BY captured_at DESC, offer_id DESC) AS rn FROM offers {where}) WHERE rn = 1"""
_LAST = "(SELECT cycle_id FROM offers GROUP BY 1 ORDER BY max(captured_at) DESC, 1 DESC LIMIT 1)"


@query("current_state", "offer_id:s cycle_id:s " + _KEYS + " price_total:d2 seat_available:i",
       sql(_STATE_SQL.format(keys="cycle_id, " + ", ".join(DIFF_KEY), where="")))
def _current(ctx):
    return diff.cycle_states(ctx.offers)


def _newest(ctx):
    return cycles.latest_two(ctx.offers).where("position = 1").select("cycle_id").scalar()


@query("previous_state", "offer_id:s cycle_id:s captured_at:t " + _KEYS + " price_total:d2",
       sql(_STATE_SQL.format(keys=", ".join(DIFF_KEY), where=f"WHERE cycle_id <> {_LAST}")))
def _previous(ctx):
    return diff.previous_state(ctx.offers, _newest(ctx))


@query("previous_state_in_scope", "offer_id:s cycle_id:s " + _KEYS, sql(
    _STATE_SQL.format(keys=", ".join(DIFF_KEY), where=f"""o WHERE cycle_id <> {_LAST} AND EXISTS (
      SELECT 1 FROM offers s WHERE s.cycle_id = {_LAST} AND s.airline = o.airline AND s.origin = o.origin
      AND s.destination = o.destination AND s.cabin = o.cabin
      AND CAST(s.departure AS DATE) = CAST(o.departure AS DATE))""")))
def _previous_scope(ctx):
    newest = _newest(ctx)
    scope = diff.searched_scope(ctx.offers.where(F.col("cycle_id") == newest))
    return diff.previous_state(ctx.offers, newest, scope)


@query("diff_against_known_state", "domain:s change_type:s field_name:s events:i magnitude:d2", sql(f"""
  SELECT domain, change_type, field_name, count(*) AS events, sum(magnitude) AS magnitude FROM (
    SELECT 'availability' AS domain, CASE WHEN p.offer_id IS NULL THEN 'added' ELSE 'removed' END AS change_type,
      '__row_presence__' AS field_name, NULL AS magnitude FROM p FULL JOIN c USING ({', '.join(DIFF_KEY)})
      WHERE p.offer_id IS NULL OR c.offer_id IS NULL
    UNION ALL SELECT 'price', CASE WHEN c.price_total > p.price_total THEN 'increase' ELSE 'decrease' END,
      'price_total', abs(CAST(c.price_total AS DOUBLE) - CAST(p.price_total AS DOUBLE))
      FROM p JOIN c USING ({', '.join(DIFF_KEY)}) WHERE c.price_total <> p.price_total
    UNION ALL SELECT 'seat', CASE WHEN c.seat_available > p.seat_available THEN 'increase' ELSE 'decrease' END,
      'seat_available', abs(CAST(c.seat_available AS DOUBLE) - p.seat_available)
      FROM p JOIN c USING ({', '.join(DIFF_KEY)}) WHERE c.seat_available <> p.seat_available) GROUP BY ALL""",
    ctes=f"""p AS ({_STATE_SQL.format(keys=', '.join(DIFF_KEY), where=f'WHERE cycle_id <> {_LAST}')}),
    c AS ({_STATE_SQL.format(keys=', '.join(DIFF_KEY), where=f'WHERE cycle_id = {_LAST}')})"""))
def _known(ctx):
    newest = _newest(ctx)
    current = diff.current_state(ctx.offers.where(F.col("cycle_id") == newest))
    events = diff.diff_columns(diff.pair_states(diff.previous_state(ctx.offers, newest), current))
    return events.groupBy("domain", "change_type", "field_name").agg(
        F.count("*").alias("events"), F.sum("magnitude").alias("magnitude"))


def _state_before(ctx):
    """Bucketed state before the newest cycle: all older cycles at once, then the last two one by one."""
    # A few narrow rows, one per cycle.
    order = [r[0] for r in ctx.cycle_order.orderBy("cycle_no").select("cycle_id").collect()]
    path = work_dir(ctx.spark, "cycle-offers")
    ctx.offers.write.partitionBy("cycle_id").parquet(path)
    offers = ctx.spark.read.schema(ctx.offers.schema).parquet(path)
    state = LatestState(ctx.spark, work_dir(ctx.spark, "latest-state"), ctx.offers.schema, 16)
    early = [c for c in order[:-3]]
    for cycles in ([early] if early else []) + [[c] for c in order[-3:-1] if c not in early]:
        state.update(offers.where(F.col("cycle_id").isin(cycles)))
    return state, offers.where(F.col("cycle_id") == order[-1])


@query("latest_state", "offer_id:s cycle_id:s captured_at:t " + _KEYS + " price_total:d2",
       sql(_STATE_SQL.format(keys=", ".join(DIFF_KEY), where=f"WHERE cycle_id <> {_LAST}")))
def _latest_state(ctx):
    return _state_before(ctx)[0].table()


@query("latest_state_diff", "domain:s change_type:s field_name:s events:i magnitude:d2", sql(f"""
  SELECT domain, change_type, field_name, count(*) AS events, sum(magnitude) AS magnitude FROM (
    SELECT 'availability' AS domain, CASE WHEN p.offer_id IS NULL THEN 'added' ELSE 'removed' END AS change_type,
      '__row_presence__' AS field_name, NULL AS magnitude FROM p FULL JOIN c USING ({', '.join(DIFF_KEY)})
      WHERE p.offer_id IS NULL OR c.offer_id IS NULL
    UNION ALL SELECT 'price', CASE WHEN c.price_total > p.price_total THEN 'increase' ELSE 'decrease' END,
      'price_total', abs(CAST(c.price_total AS DOUBLE) - CAST(p.price_total AS DOUBLE))
      FROM p JOIN c USING ({', '.join(DIFF_KEY)}) WHERE c.price_total <> p.price_total
    UNION ALL SELECT 'seat', CASE WHEN c.seat_available > p.seat_available THEN 'increase' ELSE 'decrease' END,
      'seat_available', abs(CAST(c.seat_available AS DOUBLE) - p.seat_available)
      FROM p JOIN c USING ({', '.join(DIFF_KEY)}) WHERE c.seat_available <> p.seat_available) GROUP BY ALL""",
    ctes=f"""p AS ({_STATE_SQL.format(keys=', '.join(DIFF_KEY), where=f'WHERE cycle_id <> {_LAST}')}),
    c AS ({_STATE_SQL.format(keys=', '.join(DIFF_KEY), where=f'WHERE cycle_id = {_LAST}')})"""))
def _state_diff(ctx):
    state, newest = _state_before(ctx)
    events = diff.diff_columns(state.pairs(newest, keep_known=False))
    return events.groupBy("domain", "change_type", "field_name").agg(
        F.count("*").alias("events"), F.sum("magnitude").alias("magnitude"))


@query("diff_columns_legacy_union", "field_name:s change_type:s events:i", sql("""
  SELECT f.field_name, 'added' AS change_type, count(*) AS events FROM matched,
    (VALUES ('booking_class', 1), ('aircraft', 2)) f(field_name, k)
  WHERE (k = 1 AND c_booking_class IS NOT NULL) OR (k = 2 AND c_aircraft IS NOT NULL) GROUP BY 1""", needs="changes"))
def _legacy(ctx):
    full = pairs(ctx)
    kept = [f for f in full.schema["p"].dataType.fieldNames() if f not in STATE_FIELDS]
    short = full.withColumn("p", F.when(F.col("p").isNotNull(), F.struct(*[F.col(f"p.{k}").alias(k) for k in kept])))
    events = diff.diff_columns(short, legacy=True).where("field_name IN ('booking_class', 'aircraft')")
    return events.groupBy("field_name", "change_type").agg(F.count("*").alias("events"))
