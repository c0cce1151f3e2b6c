"""Rollups of change events and the change dashboard.

All of them are plain grouped aggregates: partial aggregation happens before the shuffle, so a
route or carrier with most of the events costs no more than a small one. Distinct counts are
planned by Spark as two shuffles (value first, group second) for the same reason.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farescope.functions import HIDDEN_CHANGE_FIELDS, field_display_name, numeric_round, route_key, top

DAILY_KEY = ["report_day", "airline", "origin", "destination", "cabin"]


def _is(column: str, value: str) -> Column:
    return F.count_if(F.col(column) == value)


def _event_span(suffix: str = "") -> list[Column]:
    return [
        F.min("detected_at").alias(f"first_event_at{suffix}"),
        F.max("detected_at").alias(f"last_event_at{suffix}"),
    ]


def price_changes_daily(events: DataFrame) -> DataFrame:
    rows = events.where(F.col("domain") == "price")
    return rows.groupBy(*DAILY_KEY).agg(
        F.count("*").alias("price_change_events"),
        _is("direction", "up").alias("price_increase_events"),
        _is("direction", "down").alias("price_decrease_events"),
        _is("change_type", "added").alias("added_events"),
        _is("change_type", "removed").alias("removed_events"),
        numeric_round(F.avg(F.abs("magnitude")), 4).alias("avg_abs_magnitude"),
        numeric_round(F.avg(F.abs("percent_change")), 4).alias("avg_abs_percent_change"),
        numeric_round(F.max(F.abs("percent_change")), 4).alias("max_abs_percent_change"),
        *_event_span(),
    )


def availability_changes_daily(events: DataFrame) -> DataFrame:
    """Availability counts. The sold-out flag is filed under 'field', so its count stays zero."""
    rows = events.where(F.col("domain") == "availability")
    presence = F.col("field_name") == "__row_presence__"
    return rows.groupBy(*DAILY_KEY).agg(
        F.count("*").alias("availability_change_events"),
        _is("direction", "up").alias("availability_up_events"),
        _is("direction", "down").alias("availability_down_events"),
        _is("field_name", "soldout").alias("soldout_flag_changes"),
        F.count_if(presence & (F.col("change_type") == "added")).alias("row_added_events"),
        F.count_if(presence & (F.col("change_type") == "removed")).alias("row_removed_events"),
        numeric_round(F.avg(F.abs("magnitude")), 4).alias("avg_abs_magnitude"),
        *_event_span(),
    )


def distinct_in_set(name: str) -> Column:
    """Exact distinct count as the size of a set, which a stream can keep and merge; for names of which a group has few."""
    return F.size(F.collect_set(name)).cast("bigint")


def _affected(distinct: Callable[[str], Column] = F.countDistinct) -> list[Column]:
    return [
        F.count("*").alias("total_change_events"),
        distinct("flight_number").alias("flights_affected"),
        distinct("fare_basis").alias("fare_bases_affected"),
        distinct("field_name").alias("unique_fields_changed"),
        _is("domain", "price").alias("price_events"),
        _is("domain", "availability").alias("availability_events"),
        _is("domain", "metadata").alias("metadata_events"),
    ]


def route_airline_summary(events: DataFrame) -> DataFrame:
    """Daily summary per carrier, route and cabin.

    'metadata' events and the change type 'changed' are never emitted by the diff; the columns
    are kept for events loaded from elsewhere.
    """
    return events.groupBy(*DAILY_KEY).agg(
        *_affected(),
        _is("change_type", "added").alias("added_events"),
        _is("change_type", "removed").alias("removed_events"),
        _is("change_type", "changed").alias("changed_events"),
        *_event_span(),
    )


def daily_rollups(events: DataFrame) -> DataFrame:
    """The measures of the three daily rollups in one pass over the events.

    Price and availability measures are conditional, so a report that needs all of them scans the
    events once and joins nothing.
    """
    return events.groupBy(*DAILY_KEY).agg(*daily_measures())


def daily_measures(distinct: Callable[[str], Column] = F.countDistinct) -> list[Column]:
    """Aggregates of a day's events, shared by the batch and the streaming form."""
    price, availability = F.col("domain") == "price", F.col("domain") == "availability"
    presence = availability & (F.col("field_name") == "__row_presence__")

    def mean(condition: Column, name: str) -> Column:
        return numeric_round(F.avg(F.when(condition, F.abs(name))), 4)

    return [
        *_affected(distinct),
        _is("change_type", "added").alias("added_events"),
        _is("change_type", "removed").alias("removed_events"),
        _is("change_type", "changed").alias("changed_events"),
        F.count_if(price).alias("price_change_events"),
        mean(price, "magnitude").alias("price_magnitude"),
        mean(price, "percent_change").alias("avg_abs_percent_change"),
        F.count_if(availability).alias("availability_change_events"),
        F.count_if(availability & (F.col("field_name") == "soldout")).alias("soldout_flag_changes"),
        F.count_if(presence & (F.col("change_type") == "added")).alias("row_added_events"),
        F.count_if(presence & (F.col("change_type") == "removed")).alias("row_removed_events"),
        mean(availability, "magnitude").alias("av_magnitude"),
        *_event_span(),
    ]


def change_activity_daily(events: DataFrame) -> DataFrame:
    keys = ["report_day", "airline", "origin", "destination", "domain", "change_type", "direction", "field_name"]
    return (
        events.groupBy(*keys)
        .agg(
            F.count("*").alias("event_count"),
            F.avg("magnitude").alias("avg_magnitude"),
            F.avg("percent_change").alias("avg_percent_change"),
        )
        .withColumn("route_key", route_key())
    )


def change_filters(start_date: date | None = None, end_date: date | None = None,
                   airlines: Sequence[str] | None = None, origins: Sequence[str] | None = None,
                   destinations: Sequence[str] | None = None, cabins: Sequence[str] | None = None,
                   domains: Sequence[str] | None = None, change_types: Sequence[str] | None = None,
                   directions: Sequence[str] | None = None) -> list[Column]:
    """Predicates of the change queries; codes are upper-cased, other names taken as given."""
    out: list[Column] = []
    if start_date:
        out.append(F.col("report_day") >= F.lit(start_date))
    if end_date:
        out.append(F.col("report_day") <= F.lit(end_date))
    for name, values, upper in (
        ("airline", airlines, True), ("origin", origins, True), ("destination", destinations, True),
        ("cabin", cabins, False), ("domain", domains, False), ("change_type", change_types, False),
        ("direction", directions, False),
    ):
        codes = [v.strip() for v in values or [] if v and v.strip()]
        if codes:
            out.append(F.col(name).isin([c.upper() if upper else c for c in codes]))
    return out


def _filtered(events: DataFrame, filters: Sequence[Column]) -> DataFrame:
    for f in filters:
        events = events.where(f)
    return events


def route_summary(events: DataFrame, filters: Sequence[Column] = (), limit: int | None = None) -> DataFrame:
    out = _filtered(events, filters).groupBy(*DAILY_KEY).agg(
        *_affected(),
        _is("direction", "up").alias("up_events"),
        _is("direction", "down").alias("down_events"),
        *_event_span("_utc"),
    )
    order = [F.col("report_day").desc(), "origin", "destination", "airline", "cabin"]
    return top(out.withColumn("route_key", route_key()), limit, *order)


_EVENT_ORDER = ["airline", "origin", "destination", "flight_number", "departure_day", "departure_time", "cabin",
                "fare_basis", "brand", "field_name"]


def change_events(events: DataFrame, filters: Sequence[Column] = (), limit: int | None = None) -> DataFrame:
    """The events; with a limit the newest, equal times ordered by the offer identity and field."""
    rows = _filtered(events, filters).withColumn("route_key", route_key())
    return top(rows, limit, F.col("detected_at").desc(), *_EVENT_ORDER)


def change_totals(events: DataFrame, filters: Sequence[Column] = ()) -> DataFrame:
    return _filtered(events, filters).agg(
        F.count("*").alias("event_count"),
        F.countDistinct("origin", "destination").alias("route_count"),
        F.countDistinct("airline").alias("airline_count"),
        F.max("detected_at").alias("latest_event_at_utc"),
        _is("direction", "up").alias("up_count"),
        _is("direction", "down").alias("down_count"),
        _is("change_type", "added").alias("added_count"),
        _is("change_type", "removed").alias("removed_count"),
        *[_is("domain", d).alias(f"{d}_event_count") for d in ("price", "availability", "schedule", "tax", "penalty")],
    )


def change_daily(events: DataFrame, filters: Sequence[Column] = ()) -> DataFrame:
    return _filtered(events, filters).groupBy("report_day").agg(
        F.count("*").alias("event_count"),
        F.countDistinct("origin", "destination").alias("route_count"),
        F.countDistinct("airline").alias("airline_count"),
        _is("direction", "up").alias("up_count"),
        _is("direction", "down").alias("down_count"),
        _is("change_type", "added").alias("added_count"),
        _is("change_type", "removed").alias("removed_count"),
    ).orderBy("report_day")


def top_routes(events: DataFrame, filters: Sequence[Column] = (), n: int | None = None) -> DataFrame:
    out = _filtered(events, filters).groupBy("origin", "destination").agg(
        F.count("*").alias("event_count"),
        F.countDistinct("airline").alias("airline_count"),
        F.max("detected_at").alias("latest_event_at_utc"),
    )
    return top(out.withColumn("route_key", route_key()), n, F.col("event_count").desc(), "route_key")


def top_airlines(events: DataFrame, filters: Sequence[Column] = (), n: int | None = None) -> DataFrame:
    out = _filtered(events, filters).groupBy("airline").agg(
        F.count("*").alias("event_count"),
        F.countDistinct("origin", "destination").alias("route_count"),
        F.max("detected_at").alias("latest_event_at_utc"),
    )
    return top(out, n, F.col("event_count").desc(), "airline")


def domain_mix(events: DataFrame, filters: Sequence[Column] = (), n: int | None = None) -> DataFrame:
    out = _filtered(events, filters).groupBy(F.coalesce("domain", F.lit("unclassified")).alias("domain"))
    return top(out.agg(F.count("*").alias("event_count")), n, F.col("event_count").desc(), "domain")


def field_mix(events: DataFrame, filters: Sequence[Column] = (), n: int | None = None) -> DataFrame:
    out = _filtered(events, filters).groupBy("field_name").agg(F.count("*").alias("event_count"))
    rows = top(out, n, F.col("event_count").desc(), "field_name")
    return rows.withColumn("display_name", field_display_name(F.col("field_name")))


def largest_moves(events: DataFrame, n: int, filters: Sequence[Column] = ()) -> DataFrame:
    """Events with the largest absolute move, numbered from 1 after the top-n cut."""
    order = [F.abs("magnitude").desc_nulls_last(), F.col("detected_at").desc(), *[F.col(c) for c in _EVENT_ORDER]]
    rows = top(_filtered(events, filters).withColumn("route_key", route_key()), n, *order)
    return rows.withColumn("id", F.row_number().over(Window.orderBy(*order)))


def visible_changes(events: DataFrame) -> DataFrame:
    """Events without the technical fields."""
    return events.where(~F.col("field_name").isin(HIDDEN_CHANGE_FIELDS))
