"""Offer reports: dimensions, snapshots, route classification, tax and penalty monitors."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farescope.functions import PENALTY_FEES, ROUTE, any_of, bounded_broadcast, classify_route, route_key, top
from farescope.sources import offers_with_meta


def _in(name: str, values: Sequence[str] | None, upper: bool = True) -> list[Column]:
    codes = [v.strip().upper() if upper else v.strip() for v in values or [] if v and v.strip()]
    return [F.col(name).isin(codes)] if codes else []


def _cycle(cycle_id: str | Column) -> Column:
    return F.col("cycle_id") == (cycle_id if isinstance(cycle_id, Column) else F.lit(cycle_id))


def _where(df: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    for c in conditions:
        df = df.where(c)
    return df


def dim_airline(offers: DataFrame) -> DataFrame:
    """Carriers with first and last capture, rows and the newest cycle."""
    return offers.groupBy("airline").agg(
        F.min("captured_at").alias("first_seen_at_utc"),
        F.max("captured_at").alias("last_seen_at_utc"),
        F.count("*").alias("offer_rows"),
        F.max(F.struct("captured_at", "cycle_id"))["cycle_id"].alias("latest_cycle_id"),
    )


def dim_route(offers: DataFrame) -> DataFrame:
    return offers.groupBy(*ROUTE).agg(
        F.min("captured_at").alias("first_seen_at_utc"),
        F.max("captured_at").alias("last_seen_at_utc"),
        F.count("*").alias("offer_rows"),
        F.countDistinct("airline").alias("airlines_present"),
    ).withColumn("route_key", route_key())


def list_routes(offers: DataFrame, meta: DataFrame, airports: DataFrame, cycle_id: str | Column | None = None,
                airlines: Sequence[str] | None = None, cabins: Sequence[str] | None = None,
                trip_types: Sequence[str] | None = None) -> DataFrame:
    """Routes of a filtered scope, classified. Rows are offer and side-car pairs."""
    rows = _where(offers, _in("airline", airlines) + _in("cabin", cabins, upper=False))
    if cycle_id is not None:
        rows = rows.where(_cycle(cycle_id))
    rows = offers_with_meta(rows, meta.select("offer_id", "search_trip_type"))
    wanted = [t for t in (v.strip().upper() for v in trip_types or []) if t in ("OW", "RT")]
    if wanted:
        rows = rows.where(F.coalesce("search_trip_type", F.lit("OW")).isin(wanted))
    return annotate_routes(dim_route(rows), airports).orderBy(F.col("offer_rows").desc(), "route_key")


def with_countries(df: DataFrame, airports: DataFrame) -> DataFrame:
    """Add ``__from`` and ``__to`` country codes of the route; unknown airports give NULL."""
    lookup = airports.select(F.upper(F.trim("airport")).alias("airport"), F.upper(F.trim("country")).alias("country"))
    small = bounded_broadcast(lookup)
    names = {"origin": "__from", "destination": "__to"}
    for side, out in names.items():
        df = df.join(
            small.select(F.col("airport").alias(f"__{side}"), F.col("country").alias(out)),
            F.upper(F.trim(F.col(side))) == F.col(f"__{side}"), "left",
        ).drop(f"__{side}")
    return df


def annotate_routes(df: DataFrame, airports: DataFrame) -> DataFrame:
    """Add country codes and the DOM / INT / UNK class of the route."""
    joined = with_countries(df, airports)
    parts = classify_route(F.col("__from"), F.col("__to"))
    return joined.select(*df.columns, *[c.alias(n) for n, c in parts.items()])


def filter_route_types(df: DataFrame, route_types: Sequence[str] | None) -> DataFrame:
    wanted = [t for t in (v.strip().upper() for v in route_types or []) if t in ("DOM", "INT", "UNK")]
    return df.where(F.coalesce("route_type", F.lit("UNK")).isin(wanted)) if wanted else df


def route_scope(df: DataFrame, airports: DataFrame, market: str, scope: str = "all") -> DataFrame:
    """Add ``route_scope`` against a home market; a scope other than all drops unknown routes."""
    joined = with_countries(df, airports)
    home = F.lit(market.strip().upper() or None)
    value = (
        F.when(F.col("__from").isNull() | F.col("__to").isNull() | home.isNull(), "unknown")
        .when((F.col("__from") == home) & (F.col("__to") == home), "domestic")
        .otherwise("international")
    )
    out = joined.select(*df.columns, value.alias("route_scope"))
    wanted = scope.strip().lower()
    return out if wanted == "all" else out.where(F.col("route_scope") == wanted)


def current_snapshot(offers: DataFrame, meta: DataFrame, cycle_id: str | Column, airlines: Sequence[str] | None = None,
                     origins: Sequence[str] | None = None, destinations: Sequence[str] | None = None,
                     cabins: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Offers of one cycle with their side-car; with a limit the first by route and departure."""
    filters = (_in("airline", airlines) + _in("origin", origins) + _in("destination", destinations)
               + _in("cabin", cabins, upper=False))
    rows = offers_with_meta(_where(offers.where(_cycle(cycle_id)), filters), meta)
    money, load = "decimal(12,2)", "decimal(6,2)"
    return top(rows, limit, "origin", "destination", "departure", "airline", "flight_number", "offer_id", "meta_id").select(
        "cycle_id", F.col("captured_at").alias("captured_at_utc"), "airline", "origin", "destination",
        route_key().alias("route_key"), "flight_number", F.col("departure").alias("departure_utc"), "cabin", "brand",
        "fare_basis", F.col("price_total").cast(money).alias("total_price_bdt"),
        F.col("fare_amount").cast(money).alias("base_fare_amount"), F.col("tax_amount").cast(money), "currency",
        "seat_available", "seat_capacity", F.col("load_factor_pct").cast(load), "booking_class", "baggage",
        "aircraft", "duration_min", "stops", "soldout", "penalty_source",
    )


def date_availability(offers: DataFrame, meta: DataFrame, cycle_id: str | Column,
                      trip_types: Sequence[str] | None = None, airlines: Sequence[str] | None = None,
                      origins: Sequence[str] | None = None, destinations: Sequence[str] | None = None,
                      cabins: Sequence[str] | None = None) -> DataFrame:
    """Row counts per departure date and per requested return date (``kind``)."""
    filters = (_in("airline", airlines) + _in("origin", origins) + _in("destination", destinations)
               + _in("cabin", cabins, upper=False))
    rows = _where(offers.where(_cycle(cycle_id)), filters)
    rows = offers_with_meta(rows, meta.select("offer_id", "search_trip_type", "requested_return_date"))
    wanted = [t for t in (v.strip().upper() for v in trip_types or []) if t in ("OW", "RT")]
    if wanted:
        rows = rows.where(F.coalesce("search_trip_type", F.lit("OW")).isin(wanted))
    # Both counts come from one pass: every row contributes its two dates.
    dates = rows.select(F.inline(F.array(
        F.struct(F.lit("departure").alias("kind"), F.to_date("departure").alias("date")),
        F.struct(F.lit("return").alias("kind"), F.col("requested_return_date").alias("date")),
    ))).where("date is not null")
    return dates.groupBy("kind", "date").agg(F.count("*").alias("row_count")).orderBy("kind", "date")


def effective_tax(dialect: str = "pg") -> Column:
    """Tax, or what the price exceeds the fare by.

    The default follows a GREATEST that skips NULL: an unknown fare gives 0. With ``bq`` an
    unknown fare leaves the tax unknown.
    """
    gap = F.col("price_total") - F.col("fare_amount")
    if dialect == "bq":
        fallback = F.when(gap.isNotNull(), F.greatest(gap, F.lit(0)))
    else:
        fallback = F.greatest(gap, F.lit(0))
    return F.coalesce("tax_amount", fallback).cast("decimal(12,2)")


def _window(offers: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    if start is not None:
        offers = offers.where(F.col("captured_at") >= F.lit(start))
    if end is not None:
        offers = offers.where(F.col("captured_at") < F.lit(end))
    return offers


def fact_offer_snapshot(offers: DataFrame, meta: DataFrame, start: datetime | None = None,
                        end: datetime | None = None, dialect: str = "pg") -> DataFrame:
    rows = offers_with_meta(_window(offers, start, end), meta)
    trip_origin = F.coalesce("trip_origin", "origin")
    trip_destination = F.coalesce("trip_destination", "destination")
    return rows.select(
        "cycle_id", F.col("captured_at").alias("captured_at_utc"), "airline", "origin", "destination",
        route_key().alias("route_key"), "flight_number", F.col("departure").alias("departure_utc"),
        F.to_date("departure").alias("departure_date"), "cabin", "brand", "fare_basis",
        F.col("price_total").cast("decimal(12,2)").alias("total_price_bdt"),
        F.col("fare_amount").cast("decimal(12,2)").alias("base_fare_amount"),
        effective_tax(dialect).alias("tax_amount"), "currency", "seat_available", "seat_capacity",
        F.col("load_factor_pct").cast("decimal(6,2)").alias("load_factor_pct"), "booking_class", "baggage",
        "aircraft", "duration_min", "stops", "via_airports", "soldout", "penalty_source",
        F.coalesce("search_trip_type", F.lit("OW")).alias("search_trip_type"), "trip_request_id",
        "requested_outbound_date", "requested_return_date", "trip_duration_days", "trip_origin", "trip_destination",
        F.concat(trip_origin, F.lit("-"), trip_destination).alias("trip_pair_key"),
        F.coalesce("leg_direction", F.lit("outbound")).alias("leg_direction"), "leg_sequence", "itinerary_leg_count",
    )


def route_daily_fare(snapshot: DataFrame) -> DataFrame:
    """Daily fare levels per carrier, route and cabin of the snapshot fact."""
    keys = [F.to_date("captured_at_utc").alias("report_day"), "airline", "origin", "destination", "route_key", "cabin"]
    return snapshot.groupBy(*keys).agg(
        F.count("*").alias("offer_rows"),
        F.min("total_price_bdt").alias("min_total_price_bdt"),
        F.avg("total_price_bdt").alias("avg_total_price_bdt"),
        F.max("total_price_bdt").alias("max_total_price_bdt"),
        F.avg("tax_amount").alias("avg_tax_amount"),
        F.avg("load_factor_pct").alias("avg_load_factor_pct"),
        F.count_if("soldout").alias("soldout_rows"),
    )


def fact_change_event(events: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    if start is not None:
        events = events.where(F.col("detected_at") >= F.lit(start))
    if end is not None:
        events = events.where(F.col("detected_at") < F.lit(end))
    return events.select(
        "cycle_id", "previous_cycle_id", F.col("detected_at").alias("detected_at_utc"), "report_day", "airline",
        "origin", "destination", route_key().alias("route_key"), "flight_number", "departure_day", "departure_time",
        "cabin", "fare_basis", "brand", "domain", "change_type", "direction", "field_name", "old_value", "new_value",
        "magnitude", "percent_change", "identity_key",
    )


def penalty_snapshot(offers: DataFrame, meta: DataFrame, start: datetime | None = None, end: datetime | None = None,
                     cycle_id: str | Column | None = None, airlines: Sequence[str] | None = None,
                     origins: Sequence[str] | None = None, destinations: Sequence[str] | None = None,
                     limit: int | None = None) -> DataFrame:
    """Offers that carry any penalty fee or rule text."""
    rows = _where(_window(offers, start, end),
                  _in("airline", airlines) + _in("origin", origins) + _in("destination", destinations))
    if cycle_id is not None:
        rows = rows.where(_cycle(cycle_id))
    side = ["offer_id", "meta_id", "penalty_source", "penalty_currency", *PENALTY_FEES, "fare_changeable",
            "fare_refundable", "penalty_rule_text"]
    known = meta.select(*side).where(any_of([F.col(c).isNotNull() for c in ["penalty_rule_text", *PENALTY_FEES]]))
    rows = rows.join(known, "offer_id")
    rows = top(rows, limit, "origin", "destination", "departure", "airline", "flight_number", "offer_id", "meta_id")
    return rows.select(
        "cycle_id", F.col("captured_at").alias("captured_at_utc"), F.to_date("captured_at").alias("report_day"),
        "airline", "origin", "destination", route_key().alias("route_key"), "flight_number",
        F.col("departure").alias("departure_utc"), "cabin", "fare_basis", "penalty_source", "penalty_currency",
        *[F.col(c).cast("decimal(12,2)").alias(c) for c in PENALTY_FEES], "fare_changeable", "fare_refundable",
        "penalty_rule_text",
    )


def tax_snapshot(offers: DataFrame, meta: DataFrame, start: datetime | None = None, end: datetime | None = None,
                 dialect: str = "pg") -> DataFrame:
    rows = _window(offers, start, end).join(meta.select("offer_id", "fare_amount", "tax_amount", "currency"),
                                            "offer_id")
    return rows.select(
        "cycle_id", F.col("captured_at").alias("captured_at_utc"), F.to_date("captured_at").alias("report_day"),
        "airline", "origin", "destination", route_key().alias("route_key"), "flight_number",
        F.col("departure").alias("departure_utc"), "cabin", "fare_basis",
        effective_tax(dialect).alias("tax_amount"), "currency",
    ).where("tax_amount is not null")


_TAX_ROW = ["cycle_id", "captured_at_utc", "airline", "origin", "destination", "route_key", "flight_number",
            "departure_utc", "cabin", "fare_basis", "tax_amount", "currency"]


def deduped_tax(tax: DataFrame) -> DataFrame:
    return tax.where("tax_amount is not null").select(*_TAX_ROW).distinct()


def _tax_levels(with_airlines: bool) -> list[Column]:
    out = [F.count("*").alias("row_count")]
    if with_airlines:
        out.append(F.countDistinct("airline").alias("airline_count"))
    return out + [
        F.min("tax_amount").alias("min_tax_amount"),
        F.max("tax_amount").alias("max_tax_amount"),
        F.avg(F.col("tax_amount").cast("double")).alias("avg_tax_amount"),
        (F.max("tax_amount") - F.min("tax_amount")).alias("spread_amount"),
    ]


def tax_routes(tax: DataFrame, cycle_id: str | Column, airlines: Sequence[str] | None = None) -> DataFrame:
    """Tax level per route of a cycle."""
    rows = _where(tax.where(_cycle(cycle_id)), _in("airline", airlines))
    return deduped_tax(rows).groupBy("origin", "destination", "route_key").agg(
        *_tax_levels(True), F.max("captured_at_utc").alias("latest_captured_at_utc"))


def tax_airlines(tax: DataFrame, cycle_id: str | Column, airlines: Sequence[str] | None = None) -> DataFrame:
    """Tax level per route and carrier of a cycle."""
    rows = _where(tax.where(_cycle(cycle_id)), _in("airline", airlines))
    return deduped_tax(rows).groupBy("origin", "destination", "route_key", "airline").agg(
        *_tax_levels(False), F.max("captured_at_utc").alias("latest_captured_at_utc"))


def tax_details(tax: DataFrame, cycle_id: str | Column, airports: DataFrame, route_types: Sequence[str] | None = None,
                limit: int | None = None) -> DataFrame:
    """Deduplicated tax rows of a cycle, classified; with a limit the first by route and departure."""
    rows = filter_route_types(annotate_routes(deduped_tax(tax.where(_cycle(cycle_id))), airports), route_types)
    return top(rows, limit, "origin", "destination", "departure_utc", "airline", "flight_number", "cabin", "fare_basis",
               "captured_at_utc", "tax_amount", "currency")


def tax_trends(tax: DataFrame, cycles: DataFrame, by_airline: bool = False) -> DataFrame:
    """Tax level per recent cycle with the change against the route's cycle before.

    ``cycles`` has cycle_id and cycle_completed_at_utc, one row per kept cycle. A limited list is known to
    be small, so Spark broadcasts it by itself.
    """
    keys = ["origin", "destination", "route_key"] + (["airline"] if by_airline else [])
    rows = tax.join(cycles.select("cycle_id", "cycle_completed_at_utc"), "cycle_id")
    rows = rows.where("tax_amount is not null").select(*_TAX_ROW, "cycle_completed_at_utc").distinct()
    levels = rows.groupBy("cycle_id", "cycle_completed_at_utc", *keys).agg(*_tax_levels(not by_airline))
    w = Window.partitionBy(*keys).orderBy("cycle_completed_at_utc", "cycle_id")
    return levels.withColumn("avg_tax_change_amount", F.col("avg_tax_amount") - F.lag("avg_tax_amount").over(w))


def tax_change_ranking(trends: DataFrame, by_airline: bool = False) -> DataFrame:
    """Newest level and change per route (or route and carrier), the strongest first."""
    keys = ["route_key"] + (["airline"] if by_airline else [])
    newest = trends.groupBy(*keys).agg(F.max(F.struct(
        "cycle_completed_at_utc", "cycle_id", "avg_tax_amount", "spread_amount", "avg_tax_change_amount", "row_count",
    )).alias("n")).select(*keys, "n.*")
    spread = F.coalesce("spread_amount", F.lit(0)).desc()
    change = F.abs(F.coalesce("avg_tax_change_amount", F.lit(0.0))).desc()
    return newest.orderBy(*([change, spread] if by_airline else [spread, change]), *keys)


