"""Route monitor: fare cells per flight and capture, and the matrix of their signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farescope.functions import ROUTE, any_of, bounded_broadcast, clock, first_rows, route_key, top

_GROUP_PARTS = ["route_key", "airline", "flight_number", "departure_time", "cabin", "aircraft", "search_trip_type",
                "requested_return_date", "leg_direction"]
_TRIP = ["trip_request_id", "requested_outbound_date", "requested_return_date", "trip_duration_days", "leg_sequence",
         "itinerary_leg_count"]


def top_monitor_routes(offers: DataFrame, meta: DataFrame, cycle_id: str | Column, n: int | None = None) -> DataFrame:
    """Routes with their offer and side-car rows in a cycle; with ``n`` the busiest."""
    cycle = cycle_id if isinstance(cycle_id, Column) else F.lit(cycle_id)
    rows = offers.where(F.col("cycle_id") == cycle).select("offer_id", *ROUTE)
    rows = rows.join(meta.select("offer_id"), "offer_id", "left")
    counts = rows.groupBy(*ROUTE).agg(F.count("*").alias("row_count")).withColumn("route_key", route_key())
    return top(counts, n, F.col("row_count").desc(), "route_key")


def monitor_cells(offers: DataFrame, meta: DataFrame, routes: DataFrame | None = None,
                  capture: str = "captured_at", dialect: str = "pg", tax: DataFrame | None = None) -> DataFrame:
    """Fare cell per flight, trip and capture: price range, tax, class and seats at both ends.

    The class and seats at the lowest and highest price are aggregates over an ordering struct, so a
    cell with many offers is reduced before the shuffle. ``routes`` keeps a top-n list of routes.
    ``dialect`` bq prefers a positive tax and may look it up in the tax fact.
    """
    side = meta.select(
        "offer_id", "fare_amount", "tax_amount", "aircraft", "booking_class", "load_factor_pct", "soldout",
        "search_trip_type", "trip_origin", "trip_destination", "leg_direction", *_TRIP)
    rows = offers
    if routes is not None:
        rows = rows.join(bounded_broadcast(routes.select(*ROUTE)), ROUTE, "left_semi")
    rows = rows.join(side, "offer_id", "left")
    gap = F.col("price_total") - F.col("fare_amount")
    if dialect == "bq":
        look = F.lit(None).cast("decimal(12,2)")
        if tax is not None:
            keys = ["cycle_id", "airline", "origin", "destination", "flight_number", "cabin"]
            fact = tax.groupBy(*keys, F.col("departure_utc").alias("departure")).agg(F.max("tax_amount").alias("__tax"))
            rows = rows.join(fact, [*keys, "departure"], "left")
            look = F.col("__tax")
        amount = F.coalesce(
            F.when(F.col("tax_amount") > 0, F.col("tax_amount")), F.when(look > 0, look), F.when(gap > 0, gap),
            F.col("tax_amount"), look, F.when(gap.isNotNull(), F.greatest(gap, F.lit(0))))
    else:
        amount = F.coalesce("tax_amount", F.greatest(gap, F.lit(0)))
    code = F.coalesce("booking_class", "fare_basis")
    price, seats = F.col("price_total"), F.col("seat_available")

    # Rows with class and seats settle both at once; those without one of them need a struct of their own. It is mostly NULL,
    # so an end of a cell is shuffled as one struct and not as one for each value.
    none = price.isNull().alias("none")
    ends = {}
    for end, first in (("low", price), ("high", -price)):
        first = first.alias("price")
        ends[f"__{end}_both"] = F.when(code.isNotNull() & seats.isNotNull(), F.struct(none, first, (-seats).alias("seats"), code.alias("code")))
        ends[f"__{end}_code"] = F.when(code.isNotNull() & seats.isNull(), F.struct(none, first, code.alias("code")))
        ends[f"__{end}_seats"] = F.when(code.isNull() & seats.isNotNull(), F.struct(none, first, (-seats).alias("seats")))

    def candidate(name: str, no_seats: bool, value: str) -> Column:
        found = F.col(name)
        parts = {"none": found["none"], "price": found["price"], "no_seats": F.lit(no_seats),
                 "seats": F.lit(None) if no_seats else found["seats"], "value": found[value]}
        return F.when(found.isNotNull(), F.struct(*[c.alias(n) for n, c in parts.items()]))

    def code_at(end: str) -> Column:
        return F.least(candidate(f"__{end}_both", False, "code"), candidate(f"__{end}_code", True, "code"))["value"]

    def seats_at(end: str) -> Column:
        return -F.least(candidate(f"__{end}_both", False, "seats"), candidate(f"__{end}_seats", False, "seats"))["value"]

    keys = {
        "cycle_id": F.col("cycle_id"), "captured_at_utc": F.col(capture), "airline": F.col("airline"),
        "origin": F.col("origin"), "destination": F.col("destination"),
        "flight_number": F.col("flight_number"), "departure_utc": F.col("departure"), "cabin": F.col("cabin"),
        "aircraft": F.coalesce("aircraft", F.lit("")),
        "search_trip_type": F.coalesce("search_trip_type", F.lit("OW")),
        "trip_origin": F.coalesce("trip_origin", "origin"),
        "trip_destination": F.coalesce("trip_destination", "destination"),
        "leg_direction": F.coalesce("leg_direction", F.lit("outbound")),
        **{c: F.col(c) for c in _TRIP},
    }
    cells = rows.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(
        F.min(price).cast("decimal(12,2)").alias("min_total_price_bdt"),
        F.max(price).cast("decimal(12,2)").alias("max_total_price_bdt"),
        F.max(amount).cast("decimal(12,2)").alias("tax_amount"),
        *[F.min(c).alias(n) for n, c in ends.items()],
        F.max("seat_capacity").alias("seat_capacity"),
        F.max("load_factor_pct").cast("decimal(6,2)").alias("load_factor_pct"),
        F.max(F.coalesce("soldout", F.lit(False))).alias("soldout"),
    )
    cells = cells.withColumns({
        "min_booking_class": code_at("low"), "max_booking_class": code_at("high"),
        "min_seat_available": seats_at("low"), "max_seat_available": seats_at("high"),
    }).drop(*ends)
    # What follows from the keys is spelled out per cell, not shuffled with the rows.
    cells = cells.withColumns({
        "route_key": route_key(), "departure_date": F.to_date("departure_utc"), "departure_time": clock("departure_utc")})
    return cells.withColumns({
        "booking_class": F.col("min_booking_class"), "seat_available": F.col("min_seat_available"),
        "trip_pair_key": F.concat("trip_origin", F.lit("-"), "trip_destination"),
        "flight_group_id": flight_group_id(),
    })


def flight_group_id() -> Column:
    """Nine trimmed parts joined by a bar; aircraft and trip type upper case, direction lower case."""
    def text(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))

    parts = {n: text(n) for n in _GROUP_PARTS}
    parts["aircraft"] = F.upper(parts["aircraft"])
    parts["search_trip_type"] = F.upper(F.coalesce(F.nullif(parts["search_trip_type"], F.lit("")), F.lit("OW")))
    parts["leg_direction"] = F.lower(parts["leg_direction"])
    return F.concat_ws("|", *[parts[n] for n in _GROUP_PARTS])


def cell_signal(previous_price: Column, has_previous: Column) -> Column:
    """Sold out, new, or the direction of the lowest price; an equal price is 'unknown'."""
    price = F.col("min_total_price_bdt")
    return (
        F.when(F.col("soldout"), "sold_out").when(~has_previous, "new")
        .when(price > previous_price, "increase").when(price < previous_price, "decrease").otherwise("unknown")
    )


def monitor_matrix(cells: DataFrame, cycle_id: str | Column, history_limit: int | None = None) -> DataFrame:
    """Signals of the flights in a cycle over their latest captures.

    A cell is compared with the same flight's capture before. Which captures are shown is decided on
    the distinct captures of a route and day, not on the cells, so a busy route stays cheap.
    """
    cycle = cycle_id if isinstance(cycle_id, Column) else F.lit(cycle_id)
    now = cells.where((F.col("cycle_id") == cycle) & F.col("departure_date").isNotNull())
    days = now.select("route_key", "departure_date").distinct()
    groups = now.select("route_key", "flight_group_id").distinct()
    history = cells.join(days, ["route_key", "departure_date"], "left_semi").join(
        groups, ["route_key", "flight_group_id"], "left_semi")
    cell = ["route_key", "departure_date", "flight_group_id"]
    order = [F.col(c).asc_nulls_last() for c in ("trip_request_id", "leg_sequence", "departure_utc",
                                                 "min_total_price_bdt", "max_total_price_bdt")]
    history = first_rows(history, [*cell, "captured_at_utc"], order)
    w = Window.partitionBy(*cell).orderBy("captured_at_utc")
    history = history.withColumns({
        "__price": F.lag("min_total_price_bdt").over(w), "__seen": F.lag(F.lit(True)).over(w).isNotNull(),
    })
    recent = Window.partitionBy("route_key", "departure_date").orderBy(F.col("captured_at_utc").desc())
    captures = history.select("route_key", "departure_date", "captured_at_utc").distinct()
    captures = captures.withColumn("capture_rank", F.row_number().over(recent))
    if history_limit is not None:
        captures = captures.where(F.col("capture_rank") <= history_limit)
    shown = history.join(captures, ["route_key", "departure_date", "captured_at_utc"])
    return shown.withColumns({
        "signal": cell_signal(F.col("__price"), F.col("__seen")),
        "is_latest": F.col("capture_rank") == 1,
        "day_label": F.date_format("departure_date", "EEEE"),
    }).drop("__price", "__seen")


def matrix_signal_counts(matrix: DataFrame) -> DataFrame:
    """Signals on the latest captures."""
    return matrix.where("is_latest").groupBy("signal").agg(F.count("*").alias("cells"))


def flatten_matrix(matrix: DataFrame) -> DataFrame:
    """Matrix rows in export order, newest capture first."""
    return matrix.orderBy("route_key", "departure_date", F.col("captured_at_utc").desc(), "departure_time", "airline",
                          "flight_number")


def route_leader(matrix: DataFrame) -> DataFrame:
    """Lowest fare on the latest captures of a route, who offers it and on which days."""
    rows = matrix.where("is_latest and min_total_price_bdt is not null")
    order = F.struct("min_total_price_bdt", "departure_date", "departure_time", "airline", "flight_number",
                     "flight_group_id")
    best = rows.groupBy("route_key").agg(F.min(order).alias("b")).select(
        "route_key", F.col("b.min_total_price_bdt").alias("amount"), F.col("b.airline").alias("airline"),
        F.col("b.flight_number").alias("flight_number"))
    days = rows.groupBy("route_key", F.col("min_total_price_bdt").alias("amount")).agg(
        F.array_sort(F.collect_set(F.col("departure_date").cast("string"))).alias("dates"))
    return best.join(days, ["route_key", "amount"])


def filter_matrix(matrix: DataFrame, airlines: Sequence[str] = (), signals: Sequence[str] = (),
                  context: bool = False) -> DataFrame:
    """Matrix limited to routes of some carriers and to days whose latest capture shows a signal.

    With ``context`` the other carriers of a kept route stay visible.
    """
    shown = any_of([F.col(c).isNotNull() for c in (
        "min_total_price_bdt", "max_total_price_bdt", "tax_amount", "booking_class", "seat_available", "seat_capacity",
        "load_factor_pct")]) | F.coalesce("soldout", F.lit(False))
    rows = matrix
    if airlines:
        wanted = F.col("airline").isin(list(airlines))
        if context:
            rows = rows.join(matrix.where(wanted).select("route_key").distinct(), "route_key", "left_semi")
        else:
            rows = rows.where(wanted)
    rows = rows.where(shown)
    if signals:
        day = ["route_key", "departure_date"]
        newest = rows.groupBy(*day).agg(F.max("captured_at_utc").alias("captured_at_utc"))
        hit = rows.where(F.col("signal").isin(list(signals))).select(*day, "captured_at_utc").distinct()
        rows = rows.join(newest.join(hit, [*day, "captured_at_utc"], "left_semi").select(*day), day, "left_semi")
    return rows
