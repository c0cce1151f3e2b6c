"""Operations view: distinct flight instances and their profiles per route and carrier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farescope.functions import ROUTE, clock, first_rows, route_key, split_via, stops_label, via_matches, weekday_order


def _instances(offers: DataFrame, meta: DataFrame) -> DataFrame:
    rows = offers.join(meta.select("offer_id", "via_airports", "stops"), "offer_id", "left")
    return rows.select(
        "cycle_id", "offer_id", F.col("captured_at").alias("captured_at_utc"), "airline", *ROUTE,
        route_key().alias("route_key"), "flight_number", F.to_date("departure").alias("departure_date"),
        clock("departure").alias("departure_time"), "via_airports", "stops")


def flight_instances(offers: DataFrame, meta: DataFrame, cycle_id: str | Column) -> DataFrame:
    """One row per route, carrier, flight, day, time and via list of a cycle, the newest capture."""
    cycle = cycle_id if isinstance(cycle_id, Column) else F.lit(cycle_id)
    rows = _instances(offers.where(F.col("cycle_id") == cycle), meta)
    rows = rows.withColumn("stops", F.coalesce("stops", F.lit(0)))
    keys = ["route_key", "airline", "flight_number", "departure_date", "departure_time",
            F.coalesce("via_airports", F.lit(""))]
    return first_rows(rows, keys, [F.col("captured_at_utc").desc(), F.col("stops").asc(), F.col("offer_id").desc()])


def via_filter(instances: DataFrame, codes: Sequence[str]) -> DataFrame:
    return instances.where(via_matches(F.col("via_airports"), codes)) if codes else instances


def _times(name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def _profile(with_airlines: bool) -> list[Column]:
    time = _times("departure_time")
    label = stops_label(F.col("stops"))
    via = F.array_sort(F.array_distinct(F.flatten(F.collect_set(split_via(F.col("via_airports"))))))
    patterns = F.array_sort(F.collect_set(F.struct((label != "Direct").alias("o"), label.alias("l"))))
    out = [
        F.count("*").alias("flight_instance_count"),
        F.countDistinct("departure_date").alias("active_date_count"),
        F.min(time).alias("first_departure_time"), F.max(time).alias("last_departure_time"),
        F.array_sort(F.collect_set(time)).alias("departure_times"),
        F.transform(patterns, lambda p: p["l"]).alias("service_patterns"),
        via.alias("via_airports"),
    ]
    if with_airlines:
        return [F.countDistinct("airline").alias("airline_count"), *out]
    return [*out, F.array_sort(F.collect_set("flight_number")).alias("flight_numbers")]


def route_profile(instances: DataFrame) -> DataFrame:
    return instances.groupBy("route_key", *ROUTE).agg(*_profile(True))


def airline_profile(instances: DataFrame) -> DataFrame:
    return instances.groupBy("route_key", *ROUTE, "airline").agg(*_profile(False))


def weekday_profile(instances: DataFrame, by_airline: bool = False) -> DataFrame:
    """Instances and active days per weekday, of a route or of a carrier on it."""
    keys = ["route_key"] + (["airline"] if by_airline else [])
    measures = [F.count("*").alias("flight_instance_count"), F.countDistinct("departure_date").alias("active_date_count")]
    if not by_airline:
        measures += [F.countDistinct("airline").alias("airline_count"),
                     F.array_sort(F.collect_set("airline")).alias("airlines")]
    out = instances.groupBy(*keys, F.date_format("departure_date", "EEEE").alias("day_label")).agg(*measures)
    return out.withColumn("day_order", weekday_order(F.col("day_label"))).orderBy(*keys, "day_order")


def day_profile(instances: DataFrame) -> DataFrame:
    time = _times("departure_time")
    return instances.groupBy("route_key", "departure_date").agg(
        F.count("*").alias("flight_instance_count"), F.countDistinct("airline").alias("airline_count"),
        F.min(time).alias("first_departure_time"), F.max(time).alias("last_departure_time"),
    ).withColumn("day_label", F.date_format("departure_date", "EEEE")).orderBy("route_key", "departure_date")


def operations_profile(instances: DataFrame) -> dict[str, DataFrame]:
    """All operations views of the instances."""
    return {
        "routes": route_profile(instances),
        "airlines": airline_profile(instances),
        "route_weekdays": weekday_profile(instances),
        "airline_weekdays": weekday_profile(instances, by_airline=True),
        "days": day_profile(instances),
    }


def operations_trend(offers: DataFrame, meta: DataFrame, cycles: DataFrame, by_airline: bool = False,
                     via: Sequence[str] = ()) -> DataFrame:
    """Distinct instances per recent cycle and route (and carrier).

    ``cycles`` has one row per kept cycle.
    """
    kept = cycles.select("cycle_id", "cycle_completed_at_utc")
    rows = _instances(offers.join(cycles.select("cycle_id"), "cycle_id", "left_semi"), meta)
    rows = via_filter(rows, via).select(
        "cycle_id", "airline", *ROUTE, "route_key", "flight_number", "departure_date", "departure_time",
        "via_airports").distinct()
    keys = ["cycle_id", *ROUTE, "route_key"] + (["airline"] if by_airline else [])
    measures = [F.count("*").alias("flight_instance_count"), F.countDistinct("departure_date").alias("active_date_count"),
                F.min("departure_time").alias("first_departure_time"), F.max("departure_time").alias("last_departure_time")]
    if not by_airline:
        measures.append(F.countDistinct("airline").alias("airline_count"))
    return rows.groupBy(*keys).agg(*measures).join(kept, "cycle_id")


def network_summary(instances: DataFrame) -> DataFrame:
    """Figures over all routes shown. One row."""
    routes = route_profile(instances)
    airports = instances.select(F.explode(split_via(F.col("via_airports"))).alias("a"))
    airlines = instances.agg(F.countDistinct("airline")).scalar()
    transit = airports.agg(F.countDistinct("a")).scalar()
    span = F.concat(F.min("first_departure_time"), F.lit(" to "), F.max("last_departure_time"))
    return routes.agg(
        F.count("*").alias("route_count"), airlines.alias("airline_count"),
        F.coalesce(F.sum("flight_instance_count"), F.lit(0)).alias("flight_instance_count"),
        F.coalesce(F.sum("active_date_count"), F.lit(0)).alias("active_date_count"),
        transit.alias("transit_airport_count"), F.coalesce(span, F.lit("-")).alias("network_window"))
