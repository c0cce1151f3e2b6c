"""Queries over change rollups."""

from datetime import date

from pyspark.sql import functions as F

from farescope.catalog.base import query, sql
from farescope.operators import rollups

_KEY = "report_day:D airline:s origin:s destination:s cabin:s "
_G = "report_day, airline, origin, destination, cabin"


def _n(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


PRICE_DAILY = f"""SELECT {_G}, count(*) AS price_change_events, {_n("direction = 'up'")} AS price_increase_events,
  {_n("direction = 'down'")} AS price_decrease_events, {_n("change_type = 'added'")} AS added_events,
  {_n("change_type = 'removed'")} AS removed_events, round(CAST(avg(abs(magnitude)) AS DECIMAL(38,10)), 4) AS avg_abs_magnitude,
  round(CAST(avg(abs(percent_change)) AS DECIMAL(38,10)), 4) AS avg_abs_percent_change,
  round(CAST(max(abs(percent_change)) AS DECIMAL(38,10)), 4) AS max_abs_percent_change, min(detected_at) AS first_event_at,
  max(detected_at) AS last_event_at FROM changes WHERE domain = 'price' GROUP BY ALL"""

AVAILABILITY_DAILY = f"""SELECT {_G}, count(*) AS availability_change_events,
  {_n("direction = 'up'")} AS availability_up_events, {_n("direction = 'down'")} AS availability_down_events,
  {_n("field_name = 'soldout'")} AS soldout_flag_changes,
  {_n("field_name = '__row_presence__' AND change_type = 'added'")} AS row_added_events,
  {_n("field_name = '__row_presence__' AND change_type = 'removed'")} AS row_removed_events,
  round(CAST(avg(abs(magnitude)) AS DECIMAL(38,10)), 4) AS avg_abs_magnitude, min(detected_at) AS first_event_at,
  max(detected_at) AS last_event_at FROM changes WHERE domain = 'availability' GROUP BY ALL"""

_AFFECTED = f"""count(*) AS total_change_events, count(DISTINCT flight_number) AS flights_affected,
  count(DISTINCT fare_basis) AS fare_bases_affected, count(DISTINCT field_name) AS unique_fields_changed,
  {_n("domain = 'price'")} AS price_events, {_n("domain = 'availability'")} AS availability_events,
  {_n("domain = 'metadata'")} AS metadata_events"""

ROUTE_SUMMARY = f"""SELECT {_G}, {_AFFECTED}, {_n("change_type = 'added'")} AS added_events,
  {_n("change_type = 'removed'")} AS removed_events, {_n("change_type = 'changed'")} AS changed_events,
  min(detected_at) AS first_event_at, max(detected_at) AS last_event_at FROM changes GROUP BY {_G}"""


@query("price_changes_daily", _KEY + "price_change_events:i price_increase_events:i price_decrease_events:i "
       "added_events:i removed_events:i avg_abs_magnitude:d avg_abs_percent_change:d max_abs_percent_change:d "
       "first_event_at:t last_event_at:t", sql(PRICE_DAILY, needs="changes"))
def _price(ctx):
    return rollups.price_changes_daily(ctx.changes)


@query("availability_changes_daily", _KEY + "availability_change_events:i availability_up_events:i "
       "availability_down_events:i soldout_flag_changes:i row_added_events:i row_removed_events:i "
       "avg_abs_magnitude:d first_event_at:t last_event_at:t", sql(AVAILABILITY_DAILY, needs="changes"))
def _availability(ctx):
    return rollups.availability_changes_daily(ctx.changes)


_SUMMARY_COLS = (_KEY + "total_change_events:i flights_affected:i fare_bases_affected:i unique_fields_changed:i "
                 "price_events:i availability_events:i metadata_events:i ")


@query("route_airline_summary", _SUMMARY_COLS + "added_events:i removed_events:i changed_events:i first_event_at:t "
       "last_event_at:t", sql(ROUTE_SUMMARY, needs="changes"))
def _summary(ctx):
    return rollups.route_airline_summary(ctx.changes)


@query("change_activity_daily", "report_day:D airline:s origin:s destination:s route_key:s domain:s change_type:s "
       "direction:s field_name:s event_count:i avg_magnitude:d avg_percent_change:d", sql("""
  SELECT report_day, airline, origin, destination, origin || '-' || destination AS route_key, domain, change_type,
    direction, field_name, count(*) AS event_count, avg(magnitude) AS avg_magnitude,
    avg(percent_change) AS avg_percent_change FROM changes GROUP BY ALL""", needs="changes"))
def _activity(ctx):
    return rollups.change_activity_daily(ctx.changes)


@query("route_summary", _SUMMARY_COLS + "route_key:s up_events:i down_events:i first_event_at_utc:t "
       "last_event_at_utc:t", sql(f"""SELECT {_G}, origin || '-' || destination AS route_key, {_AFFECTED},
  {_n("direction = 'up'")} AS up_events, {_n("direction = 'down'")} AS down_events,
  min(detected_at) AS first_event_at_utc, max(detected_at) AS last_event_at_utc FROM changes
  WHERE report_day >= DATE '1995-01-01' AND report_day <= DATE '1996-12-31' AND airline IN ('A1', 'A2')
  GROUP BY {_G}""", needs="changes"))
def _route_summary(ctx):
    filters = rollups.change_filters(date(1995, 1, 1), date(1996, 12, 31), airlines=["a1", "A2"])
    return rollups.route_summary(ctx.changes, filters)


_EVENT = ("cycle_id:s previous_cycle_id:s detected_at:t airline:s origin:s destination:s route_key:s "
          "flight_number:s departure_day:D departure_time:s cabin:s fare_basis:s brand:s domain:s change_type:s "
          "direction:s field_name:s old_value:s new_value:s magnitude:d percent_change:d")
_ORDER = ("airline, origin, destination, flight_number, departure_day, departure_time, cabin, fare_basis, brand, "
          "field_name")


@query("change_event_list", _EVENT, sql(f"""SELECT *, origin || '-' || destination AS route_key FROM changes
  WHERE report_day >= DATE '1994-01-01' AND origin IN ('R0', 'R1') AND destination IN ('R2', 'R3')
    AND domain IN ('price', 'seat') AND change_type IN ('increase') AND direction IN ('up')""", needs="changes"))
def _list(ctx):
    filters = rollups.change_filters(date(1994, 1, 1), origins=["r0", "R1"], destinations=["R2", "R3"],
                                     domains=["price", "seat"], change_types=["increase"], directions=["up"])
    return rollups.change_events(ctx.changes, filters)


@query("change_totals", "event_count:i route_count:i airline_count:i latest_event_at_utc:t up_count:i down_count:i "
       "added_count:i removed_count:i price_event_count:i availability_event_count:i schedule_event_count:i "
       "tax_event_count:i penalty_event_count:i", sql(f"""SELECT count(*) AS event_count,
  count(DISTINCT origin || '-' || destination) AS route_count, count(DISTINCT airline) AS airline_count,
  max(detected_at) AS latest_event_at_utc, {_n("direction = 'up'")} AS up_count,
  {_n("direction = 'down'")} AS down_count, {_n("change_type = 'added'")} AS added_count,
  {_n("change_type = 'removed'")} AS removed_count, {_n("domain = 'price'")} AS price_event_count,
  {_n("domain = 'availability'")} AS availability_event_count, {_n("domain = 'schedule'")} AS schedule_event_count,
  {_n("domain = 'tax'")} AS tax_event_count, {_n("domain = 'penalty'")} AS penalty_event_count
  FROM changes""", needs="changes"))
def _totals(ctx):
    return rollups.change_totals(ctx.changes)


@query("change_daily", "report_day:D event_count:i route_count:i airline_count:i up_count:i down_count:i "
       "added_count:i removed_count:i", sql(f"""SELECT report_day, count(*) AS event_count,
  count(DISTINCT origin || '-' || destination) AS route_count, count(DISTINCT airline) AS airline_count,
  {_n("direction = 'up'")} AS up_count, {_n("direction = 'down'")} AS down_count,
  {_n("change_type = 'added'")} AS added_count, {_n("change_type = 'removed'")} AS removed_count
  FROM changes WHERE airline = 'A3' GROUP BY 1""", needs="changes"))
def _daily(ctx):
    return rollups.change_daily(ctx.changes, rollups.change_filters(airlines=["A3"]))


@query("change_top_routes", "origin:s destination:s route_key:s event_count:i airline_count:i latest_event_at_utc:t",
       sql("""SELECT origin, destination, origin || '-' || destination AS route_key, count(*) AS event_count,
  count(DISTINCT airline) AS airline_count, max(detected_at) AS latest_event_at_utc FROM changes
  GROUP BY ALL ORDER BY event_count DESC, route_key LIMIT 10""", needs="changes"))
def _top_routes(ctx):
    return rollups.top_routes(ctx.changes, n=10)


@query("change_top_airlines", "airline:s event_count:i route_count:i latest_event_at_utc:t", sql("""SELECT airline,
  count(*) AS event_count, count(DISTINCT origin || '-' || destination) AS route_count,
  max(detected_at) AS latest_event_at_utc FROM changes GROUP BY ALL ORDER BY event_count DESC, airline LIMIT 3""",
       needs="changes"))
def _top_airlines(ctx):
    return rollups.top_airlines(ctx.changes, n=3)


@query("change_domain_mix", "domain:s event_count:i", sql("""SELECT coalesce(nullif(domain, 'capacity'),
  'unclassified') AS domain, count(*) AS event_count FROM changes GROUP BY 1""",
       needs="changes"))
def _domains(ctx):
    return rollups.domain_mix(ctx.changes.withColumn("domain", F.expr("nullif(domain, 'capacity')")))


@query("change_field_mix", "field_name:s event_count:i display_name:s", sql("""SELECT field_name, event_count,
  CASE field_name WHEN 'tax_amount' THEN 'Tax amount' WHEN 'seat_available' THEN 'Seat available'
    WHEN 'booking_class' THEN 'Booking class' WHEN 'price_total' THEN 'Price Total' WHEN 'arrival' THEN 'Arrival'
    WHEN 'soldout' THEN 'Soldout' WHEN 'aircraft' THEN 'Aircraft' WHEN '__row_presence__' THEN 'Row Presence' END
    AS display_name FROM (SELECT field_name, count(*) AS event_count FROM changes GROUP BY 1)""", needs="changes"))
def _fields(ctx):
    return rollups.field_mix(ctx.changes)


@query("change_largest_moves", "id:i " + _EVENT, sql(f"""SELECT *, origin || '-' || destination AS route_key,
  row_number() OVER (ORDER BY abs(magnitude) DESC NULLS LAST, detected_at DESC, {_ORDER}) AS id FROM changes
  WHERE domain = 'price' ORDER BY id LIMIT 25""", needs="changes"))
def _moves(ctx):
    return rollups.largest_moves(ctx.changes, 25, rollups.change_filters(domains=["price"]))


@query("visible_changes", "field_name:s events:i", sql("""SELECT field_name, count(*) AS events FROM changes
  WHERE field_name NOT IN ('scraped_at','source_endpoint','raw_offer','ota_name','penalty_source',
    'fare_search_signature','fare_search_reference','fare_ref_num') GROUP BY 1""", needs="changes"))
def _visible(ctx):
    technical = ctx.changes.where("field_name = 'price_total'").withColumn("field_name", F.lit("raw_offer"))
    return rollups.visible_changes(ctx.changes.unionByName(technical)).groupBy("field_name").agg(F.count("*").alias("events"))
