"""Comparison of two capture cycles and the flight/day views built on it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farescope.functions import (
    COMPARE_KEY, PENALTY_FEES, ROUTE, any_of, bounded_broadcast, clip, clock,
    half_even, ratio, route_key, top,
)
from farescope.operators.reporting import with_countries

DELTAS = ["min_fare_delta", "max_fare_delta", "tax_delta", "seat_delta", "load_delta"]
MEASURES = ["min_fare", "max_fare", "current_tax", "min_seats", "max_seats", "load_pct"]


def _collapse(offers: DataFrame, current: Column, previous: Column) -> DataFrame:
    """Both cycles side by side, one row per compare identity: lowest id and price, most seats.

    One conditional aggregate replaces a full outer join of two aggregates. An identity with a
    missing part never matches the other cycle, so its rows are kept apart by cycle.
    """
    is_current = F.col("cycle_id") == current
    rows = offers.where(is_current | (F.col("cycle_id") == previous)).withColumn("__now", is_current)
    incomplete = any_of([F.col(k).isNull() for k in COMPARE_KEY])

    def both(name: str, fold, column: str) -> list[Column]:
        now = F.col("__now")
        return [fold(F.when(now, F.col(column))).alias(name), fold(F.when(~now, F.col(column))).alias(f"p_{name}")]

    return rows.groupBy(*COMPARE_KEY, F.when(incomplete, F.col("__now")).alias("__apart")).agg(
        *both("id", F.min, "offer_id"), *both("price", F.min, "price_total"),
        *both("capacity", F.max, "seat_capacity"), *both("seats", F.max, "seat_available")).drop("__apart")


_SIDE_FIELDS = ["tax_amount", "penalty_source", "source_endpoint", "penalty_currency", "penalty_rule_text",
                *PENALTY_FEES, "fare_refundable", "fare_changeable"]


def compare_scrapes(offers: DataFrame, meta: DataFrame, current: str | Column, previous: str | Column) -> DataFrame:
    """Comparison of two cycles: every identity of either, with both prices and a signal.

    The match is not null-safe: an offer without cabin or brand is both new and removed. The route
    minimum is an aggregate joined back, so a busy route is never gathered in one window.
    """
    now = current if isinstance(current, Column) else F.lit(current)
    before = previous if isinstance(previous, Column) else F.lit(previous)
    joined = _collapse(offers, now, before)
    floor = joined.groupBy(*ROUTE).agg(F.min("price").alias("route_min"))
    joined = joined.join(floor, ROUTE, "left")
    side = ["offer_id", "aircraft", "equipment_code", "arrival", "booking_class", *_SIDE_FIELDS]
    for prefix, key in (("cm_", "id"), ("pm_", "p_id")):
        rows = meta.select(*[F.col(c).alias(prefix + c) for c in side])
        joined = joined.join(rows, F.col(key) == F.col(f"{prefix}offer_id"), "left")
    signal = (
        F.when(F.col("p_id").isNull(), "NEW_FLIGHT").when(F.col("id").isNull(), "REMOVED")
        .when(F.col("price") > F.col("p_price"), "INCREASE").when(F.col("price") < F.col("p_price"), "DECREASE")
        .otherwise("UNCHANGED")
    )
    out = joined.select(
        *COMPARE_KEY,
        F.col("p_price").alias("previous_fare_bdt"), F.col("price").alias("current_fare_bdt"),
        F.col("capacity").alias("seat_capacity"), F.col("p_capacity").alias("previous_seat_capacity"),
        F.col("p_seats").alias("previous_seats"), F.col("seats").alias("current_seats"),
        F.coalesce("cm_aircraft", "cm_equipment_code", "pm_aircraft", "pm_equipment_code").alias("aircraft"),
        F.coalesce("cm_arrival", "pm_arrival").alias("arrival"),
        F.col("cm_tax_amount").alias("current_tax"), F.col("pm_tax_amount").alias("previous_tax"),
        F.coalesce("cm_booking_class", "pm_booking_class").alias("rbd"),
        *[F.col(f"{prefix}{f}").alias(f"{name}_{f}") for f in _SIDE_FIELDS if f != "tax_amount"
          for prefix, name in (("cm_", "current"), ("pm_", "previous"))],
        signal.alias("signal"),
        F.when(F.col("price") == F.col("route_min"), 1).otherwise(0).alias("is_price_leader"),
    )
    out = out.withColumns({
        "route": route_key(), "departure_time": clock("departure"), "flight_date": F.to_date("departure"),
    })
    return out.withColumn("flight_key", F.concat_ws("|", "route", "airline", "flight_number", "departure_time"))


def finalize_comparison(rows: DataFrame) -> DataFrame:
    """One row per flight and day with fare range, seats, pressure, status, deltas and leader.

    Gaps in fare, tax, seats, capacity and class are filled forward along the flight, ordered by day
    and fare. A flight holds the offers of two cycles only, so its window stays small.
    """
    ties = [F.col(c).asc_nulls_last() for c in ("cabin", "brand", "rbd", "current_tax", "previous_tax", "signal")]
    forward = (
        Window.partitionBy("flight_key")
        .orderBy("flight_date", F.col("current_fare_bdt").asc_nulls_last(), *ties)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    filled = ["current_fare_bdt", "current_tax", "current_seats", "seat_capacity", "rbd"]
    work = rows.where("flight_key is not null and flight_date is not null").withColumns({
        "__place": F.row_number().over(forward.rowsBetween(Window.unboundedPreceding, 0)),
        **{f"__{c}": F.last(c, ignorenulls=True).over(forward) for c in filled},
    })
    work = work.select(*[F.col(f"__{c}").alias(c) if c in filled else F.col(c) for c in rows.columns], "__place")

    flight = ["flight_key", "flight_date"]
    fare = F.col("current_fare_bdt")
    by_class = work.groupBy(*flight, "rbd").agg(
        F.min(fare).alias("fare"),
        F.max(F.when(fare.isNotNull(), F.col("current_seats"))).alias("fare_seats"),
        F.min("previous_fare_bdt").alias("prev_fare"),
        F.max("current_seats").alias("seats"),
        F.max("previous_seats").alias("prev_seats"),
        F.count("previous_fare_bdt").alias("prev_rows"),
        F.collect_set("aircraft").alias("aircraft_seen"),
        F.max(F.struct("__place", *[c for c in rows.columns if c not in flight])).alias("last"),
    )
    named = F.col("rbd").isNotNull()
    code = F.coalesce("rbd", F.lit("__UNK__"))
    pick = F.struct("rbd", "fare_seats")
    priced = F.col("fare").isNotNull()
    levels = by_class.groupBy(*flight).agg(
        F.min("fare").alias("min_fare"), F.max("fare").alias("max_fare"),
        F.min_by(pick, F.when(priced, F.struct(F.col("fare"), code))).alias("low"),
        F.min_by(pick, F.when(priced, F.struct(-F.col("fare"), code))).alias("high"),
        F.min(F.when(named, F.col("prev_fare"))).alias("previous_min_fare"),
        F.max(F.when(named, F.col("prev_fare"))).alias("previous_max_fare"),
        F.sum(F.when(named, F.col("seats"))).alias("min_seats"),
        F.sum(F.when(named, F.col("prev_seats"))).alias("previous_min_seats"),
        (F.sum("prev_rows") == 0).alias("is_new_flight"),
        F.array_distinct(F.flatten(F.collect_list("aircraft_seen"))).alias("aircraft_seen"),
        F.max("last").alias("last"),
    ).select(
        *flight, "last.*", "aircraft_seen", "min_fare", "max_fare", F.col("low.rbd").alias("min_rbd"), F.col("low.fare_seats").alias("min_rbd_seats"),
        F.col("high.rbd").alias("max_rbd"), F.col("high.fare_seats").alias("max_rbd_seats"), "previous_min_fare",
        "previous_max_fare", "min_seats", "previous_min_seats", "is_new_flight",
    )
    whole_flight = Window.partitionBy("flight_key")
    types = F.array_distinct(F.flatten(F.collect_list("aircraft_seen").over(whole_flight)))
    out = levels.withColumn("aircraft_label", F.array_join(F.array_sort(types), " / ")).drop("__place", "aircraft_seen")

    cap = F.nullif(F.col("seat_capacity").cast("double"), F.lit(0.0))

    def pressure(seats: str) -> Column:
        return (1 - clip(F.col(seats).cast("double") / cap, 0, 1)) * 100.0

    seen = F.col("min_fare").isNotNull() | F.col("current_tax").isNotNull()
    out = out.withColumns({
        "row_visible": F.max(seen).over(whole_flight),
        "max_seats": F.col("seat_capacity"),
        "status": F.when(F.col("is_new_flight") & (F.col("min_seats") > 0), "NEW")
        .when(F.col("min_seats") == 0, "SOLD OUT").otherwise("NORMAL"),
        "load_pct": pressure("min_seats"),
        "previous_load_pct": pressure("previous_min_seats"),
    })
    route_day = Window.partitionBy("route", "flight_date")
    out = out.withColumns({
        "inventory_pressure_pct": F.col("load_pct"),
        "previous_inventory_pressure_pct": F.col("previous_load_pct"),
        "min_fare_delta": F.col("min_fare") - F.col("previous_min_fare"),
        "max_fare_delta": F.col("max_fare") - F.col("previous_max_fare"),
        "seat_delta": F.col("min_seats") - F.col("previous_min_seats"),
        "tax_delta": F.col("current_tax") - F.col("previous_tax"),
        "load_delta": F.col("load_pct") - F.col("previous_load_pct"),
        **{f"{f}_delta": F.col(f"current_{f}") - F.col(f"previous_{f}") for f in PENALTY_FEES},
        "leader": F.coalesce(F.col("min_fare") == F.min("min_fare").over(route_day), F.lit(False)),
        "day_name": F.date_format("flight_date", "EEEE"),
    })
    return out.where("row_visible")


def prepare_flights(flights: DataFrame) -> DataFrame:
    """Defaults used by the views: missing deltas are 0, a missing aircraft takes the flight's label."""
    aircraft = F.coalesce(F.nullif(F.trim("aircraft"), F.lit("")), F.nullif(F.col("aircraft_label"), F.lit("")),
                          F.lit("Aircraft NA"))
    return flights.withColumns({
        **{d: F.coalesce(F.col(d), F.lit(0)) for d in DELTAS},
        "aircraft": aircraft,
        "min_rbd": F.coalesce("min_rbd", F.lit("")),
        "max_rbd": F.coalesce("max_rbd", F.lit("")),
    })


def capture_history(offers: DataFrame, meta: DataFrame, scope: DataFrame, cabin: str | None = None) -> DataFrame:
    """Every capture of the flights in scope with the change against the capture before.

    ``scope`` names flights by airline, origin, destination, flight_number, flight_date and
    departure_time. The lag runs over rows that are already one per flight and cycle.
    """
    key = ["airline", "origin", "destination", "flight_number", "flight_date", "departure_time"]
    rows = offers.withColumns({"flight_date": F.to_date("departure"), "departure_time": clock("departure")})
    if cabin:
        rows = rows.where(F.col("cabin") == cabin)
    rows = rows.join(scope.select(*key).distinct(), key, "left_semi")
    rows = rows.join(meta.select("offer_id", "tax_amount"), "offer_id", "left")
    agg = rows.groupBy("cycle_id", *key, "departure").agg(
        F.max("captured_at").alias("captured_at_utc"),
        F.min("price_total").alias("min_fare"), F.max("price_total").alias("max_fare"),
        F.min("tax_amount").alias("tax_amount"), F.min("seat_available").alias("min_seats"),
        F.max("seat_available").alias("max_seats"), F.max("seat_capacity").alias("seat_capacity"),
        F.count("*").alias("offer_rows"),
    )
    load = 100.0 * (1.0 - F.col("min_seats") / F.nullif(F.col("seat_capacity").cast("double"), F.lit(0.0)))
    agg = agg.withColumns({
        "route": route_key(),
        "day_name": F.date_format("flight_date", "EEEE"),
        "capture_label": F.date_format("captured_at_utc", "dd MMM, HH:mm"),
        "load_pct": half_even(F.when(F.col("seat_capacity") > 0, load), 1),
        "status": F.when(F.col("min_seats") == 0, "SOLD OUT")
        .when(F.col("min_seats").isNull() & F.col("min_fare").isNull(), "UNKNOWN").otherwise("AVAILABLE"),
    })
    w = Window.partitionBy(*key).orderBy("captured_at_utc", "cycle_id")
    fields = ["min_fare", "max_fare", "tax_amount", "min_seats", "max_seats", "load_pct"]
    agg = agg.withColumns({
        **{f"{f}_delta": F.col(f) - F.lag(f).over(w) for f in fields},
        "previous_capture_label": F.coalesce(F.lag("capture_label").over(w), F.lit("")),
    })
    # A delta that cannot be computed counts as a change.
    changed = any_of([F.coalesce(F.col(f"{f}_delta") != 0, F.lit(True)) for f in fields])
    return agg.withColumn(
        "state_changed_flag",
        F.when(changed | (F.col("previous_capture_label") == ""), "CHANGED/NEW").otherwise("NO_CHANGE"))


def signal_primary() -> Column:
    """Label of a flight row: its status, or which way its deltas point."""
    present = F.filter(F.array(*[F.col(d).cast("double") for d in DELTAS]), lambda v: v.isNotNull())
    up, down = F.exists(present, lambda v: v > 0), F.exists(present, lambda v: v < 0)
    missing = F.coalesce(*[F.col(m).cast("double") for m in MEASURES]).isNull()
    return (
        F.when(F.upper("status") == "NEW", "NEW").when(F.upper("status") == "SOLD OUT", "SOLD OUT")
        .when(up & down, "MIXED").when(up, "INCREASE").when(down, "DECREASE")
        .when(missing, "UNKNOWN").otherwise("STABLE")
    )


def route_signals(flights: DataFrame) -> DataFrame:
    """Sorted distinct signals of every route."""
    status = F.upper(F.trim("status"))
    any_up, any_down = any_of([F.col(d) > 0 for d in DELTAS]), any_of([F.col(d) < 0 for d in DELTAS])
    marks = F.array_compact(F.array(
        F.when(status.isin("NEW", "SOLD OUT"), status),
        F.when(any_up, "INCREASE"), F.when(any_down, "DECREASE")))
    return flights.select("route", F.explode_outer(marks).alias("signal")).groupBy("route").agg(
        F.array_sort(F.collect_set("signal")).alias("found")
    ).select("route", F.when(F.size("found") > 0, F.col("found")).otherwise(F.array(F.lit("UNKNOWN"))).alias("signals"))


def _flags() -> dict[str, Column]:
    status = F.upper("status")
    fares = [F.col("min_fare_delta"), F.col("max_fare_delta")]
    out = {
        "new": status == "NEW", "sold_out": status == "SOLD OUT",
        "fare_up": any_of([f > 0 for f in fares]), "fare_down": any_of([f < 0 for f in fares]),
    }
    for name, column in (("seat", "seat_delta"), ("tax", "tax_delta"), ("load", "load_delta")):
        out[f"{name}_up"] = F.col(column) > 0
        out[f"{name}_down"] = F.col(column) < 0
    return out


def changes_by_airline(flights: DataFrame) -> DataFrame:
    return flights.groupBy(F.upper("airline").alias("airline")).agg(
        F.count("*").alias("rows"), *[F.count_if(c).alias(n) for n, c in _flags().items()]
    ).orderBy(F.col("rows").desc(), F.col("fare_up").desc(), F.col("fare_down").desc(), "airline")


def changes_by_route(flights: DataFrame, n: int | None = None) -> DataFrame:
    flags = _flags()
    kept = ["new", "sold_out", "fare_up", "fare_down", "seat_down", "load_up"]
    out = flights.groupBy("route", F.upper("airline").alias("airline")).agg(
        F.count("*").alias("rows"), *[F.count_if(flags[k]).alias(k) for k in kept])
    total = sum((F.col(k) for k in kept), F.lit(0))
    return top(out.withColumn("total_events", total), n, F.col("total_events").desc(), F.col("rows").desc(), "route", "airline")


def _first_text(name: str) -> Column:
    text = F.nullif(F.trim(F.col(name)), F.lit(""))
    return F.min_by(text, F.when(text.isNotNull(), F.struct("flight_key", text)))


def penalty_changes(flights: DataFrame) -> DataFrame:
    """Routes, carriers and days whose penalty state changed between the two cycles."""
    sides = ("current", "previous")
    measures = []
    for s in sides:
        measures += [F.min(F.col(f"{s}_{f}").cast("double")).alias(f"{s}_{f}") for f in PENALTY_FEES]
        measures += [F.max(f"{s}_{f}").alias(f"{s}_{f}") for f in ("fare_refundable", "fare_changeable")]
        measures += [_first_text(f"{s}_{f}").alias(f"{s}_{f}") for f in ("penalty_currency", "penalty_rule_text")]
    state = flights.dropna(subset=["route", "airline", "flight_date"]).groupBy(
        "route", F.upper("airline").alias("airline"), "flight_date").agg(*measures)

    def known(s: str) -> Column:
        return any_of([F.col(f"{s}_{f}").isNotNull() for f in
                       [*PENALTY_FEES, "fare_refundable", "fare_changeable", "penalty_rule_text"]])

    def key(s: str) -> Column:
        rule = F.lower(F.regexp_replace(F.trim(F.coalesce(f"{s}_penalty_rule_text", F.lit(""))), r"\s+", " "))
        currency = F.upper(F.trim(F.coalesce(f"{s}_penalty_currency", F.lit(""))))
        parts = [F.col(f"{s}_{f}") for f in [*PENALTY_FEES, "fare_refundable", "fare_changeable"]] + [currency, rule]
        return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])

    def snapshot(s: str) -> Column:
        def fee(f: str) -> Column:
            return F.coalesce(F.format_number(f"{s}_{f}", 0), F.lit("--"))

        def flag(f: str) -> Column:
            return F.when(F.col(f"{s}_{f}"), "Yes").when(~F.col(f"{s}_{f}"), "No").otherwise("--")

        note = F.col(f"{s}_penalty_rule_text")
        currency = F.coalesce(F.nullif(F.upper(F.trim(F.col(f"{s}_penalty_currency"))), F.lit("")), F.lit("--"))
        return F.concat(
            currency, F.lit(" | Chg:"), F.concat_ws("/", *[fee(f) for f in PENALTY_FEES[:3]]),
            F.lit(" | Can:"), F.concat_ws("/", *[fee(f) for f in PENALTY_FEES[3:]]),
            F.lit(" | Refundable:"), flag("fare_refundable"), F.lit(" | Changeable:"), flag("fare_changeable"),
            F.coalesce(F.concat(F.lit(" | Note:"), note), F.lit("")))

    change = (
        F.when(known("current") & ~known("previous"), "NEW").when(~known("current") & known("previous"), "REMOVED")
        .when(known("current") & ~key("current").eqNullSafe(key("previous")), "UPDATED")
    )
    return state.select(
        "route", "airline", "flight_date", change.alias("change_type"),
        snapshot("previous").alias("previous_snapshot"), snapshot("current").alias("current_snapshot"),
    ).where("change_type is not null").orderBy("route", "airline", "flight_date")


def tax_changes(flights: DataFrame, airports: DataFrame, home: str) -> DataFrame:
    """Tax range per route, carrier and day with a change flag and the country flow."""
    keyed = flights.dropna(subset=["route", "airline", "flight_date"])
    levels = keyed.groupBy("route", *ROUTE, F.upper("airline").alias("airline"), "flight_date").agg(
        *[f(c).alias(f"{p}_{n}") for p, c in (("curr", "current_tax"), ("prev", "previous_tax"))
          for n, f in (("min", F.min), ("max", F.max), ("count", F.count))])
    rows = with_countries(levels.where("curr_count > 0"), airports)
    differs = any_of([F.col(f"curr_{n}") != F.col(f"prev_{n}") for n in ("min", "max", "count")])
    here, there = F.col("__from") == home, F.col("__to") == home
    both = F.col("__from").isNotNull() & F.col("__to").isNotNull()
    flow = (
        F.when(both & here & there, f"{home}->{home}").when(both & here, f"{home}->Outside")
        .when(both & there, f"Outside->{home}").when(both, "Outside->Outside").otherwise("Unknown")
    )
    order = F.when(both & here & there, 1).when(both & here, 2).when(both & there, 3).when(both, 4).otherwise(99)
    low, high = F.format_number("curr_min", 0), F.format_number("curr_max", 0)
    return rows.select(
        flow.alias("flow_label"), order.alias("flow_order"), "route", "airline", "flight_date",
        F.when(F.col("curr_min") == F.col("curr_max"), low).otherwise(F.concat(low, F.lit(" to "), high))
        .alias("current_tax_text"),
        "curr_min", "curr_max", "curr_count",
        F.when(F.col("prev_count") == 0, "NEW").when(differs, "CHANGED").otherwise("NO_CHANGE").alias("change_flag"),
    ).orderBy("flow_order", "route", "airline", "flight_date")


def changed_captures(history: DataFrame) -> DataFrame:
    """Distinct captures with any change per route and day, in time order."""
    return history.where(F.upper("state_changed_flag") != "NO_CHANGE").select(
        "route", "flight_date", "captured_at_utc", "capture_label", "cycle_id"
    ).distinct().orderBy("route", "flight_date", "captured_at_utc", "cycle_id")


def fare_pivot(flights: DataFrame, dates: Sequence[date]) -> DataFrame:
    """Lowest fare per flight with one column per given date."""
    number = F.trim("flight_number")
    label = F.when(F.upper(number).startswith(F.upper("airline")), number).otherwise(
        F.concat(F.upper("airline"), number))
    keyed = flights.withColumn("flight_label", label).groupBy("route", "airline", "flight_key", "flight_label")
    names = [d.isoformat() for d in dates]
    return keyed.agg(*[F.min(F.when(F.col("flight_date") == F.lit(d), F.col("min_fare"))).alias(n)
                       for d, n in zip(dates, names)])


_VIEW = ["route", "flight_date", "day_name", "airline", "flight_number", "departure_time", "status", "signal_primary",
         "min_fare", "max_fare", "current_tax", "min_seats", "max_seats", "load_pct", *DELTAS]


def filter_view(flights: DataFrame) -> DataFrame:
    """Flat flight rows with the primary signal."""
    rows = flights.withColumns({"signal_primary": signal_primary(), "airline": F.upper("airline"),
                                "status": F.upper("status")})
    return rows.select(*_VIEW).orderBy("route", "flight_date", "airline", "departure_time")


def peak_concurrent(flights: DataFrame) -> DataFrame:
    """Highest number of flights in the air at once per carrier.

    Departures and arrivals are netted per carrier and minute before the running sum, which also
    lets an arrival free an aircraft for a departure at the same time. The window then holds one
    row per distinct time.
    """
    valid = flights.where("departure is not null and arrival is not null and arrival > departure")
    steps = valid.select("airline", F.inline(F.array(
        F.struct(F.col("departure").alias("at"), F.lit(1).alias("step")),
        F.struct(F.col("arrival").alias("at"), F.lit(-1).alias("step")))))
    net = steps.groupBy("airline", "at").agg(F.sum("step").alias("step"))
    running = F.sum("step").over(Window.partitionBy("airline").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return net.withColumn("running", running).groupBy("airline").agg(F.max("running").alias("peak"))


def _frequency(rows: Column, days: Column) -> dict[str, Column]:
    daily = F.coalesce(half_even(ratio(rows, days), 2), F.lit(0.0))
    return {"daily_avg": daily, "weekly_est": half_even(daily * 7.0, 2)}


def ops_by_airline(flights: DataFrame, fleet: DataFrame) -> DataFrame:
    """Fleet and frequency figures per carrier.

    ``fleet`` has airline, aircraft_type, aircraft_count and seats_per_aircraft.
    """
    seen = flights.groupBy(F.upper("airline").alias("airline")).agg(
        F.count("*").alias("observed_rows"), F.countDistinct("flight_date").alias("days"),
        F.countDistinct("route").alias("observed_routes"), F.min("departure_time").alias("first_departure"),
        F.max("departure_time").alias("last_departure"))
    known = fleet.groupBy(F.upper("airline").alias("airline")).agg(
        F.sum("aircraft_count").alias("fleet_count"),
        F.array_sort(F.collect_list("aircraft_type")).alias("fleet_types"),
        F.array_sort(F.collect_set(F.col("seats_per_aircraft").cast("string"))).alias("seat_capacities"))
    out = seen.join(bounded_broadcast(known), "airline", "left").join(peak_concurrent(flights), "airline", "left")
    return out.select(
        "airline", "observed_rows", "observed_routes",
        *[c.alias(n) for n, c in _frequency(F.col("observed_rows"), F.col("days")).items()],
        "first_departure", "last_departure", "fleet_count", "fleet_types", "seat_capacities",
        F.col("peak").alias("search_fleet_lb"),
        half_even(ratio(F.col("peak"), F.nullif(F.col("fleet_count"), F.lit(0))) * 100.0, 2).alias("fleet_coverage_pct"),
    )


def ops_by_route(flights: DataFrame) -> DataFrame:
    out = flights.groupBy(F.upper("airline").alias("airline"), "route").agg(
        F.countDistinct("flight_date").alias("operating_days"), F.count("flight_key").alias("observed_flights"),
        F.array_sort(F.collect_set("departure_time")).alias("times"),
        F.array_sort(F.collect_set("aircraft")).alias("aircraft_types"))
    return out.select("airline", "route", "operating_days", "observed_flights",
                      *[c.alias(n) for n, c in _frequency(F.col("observed_flights"), F.col("operating_days")).items()],
                      F.col("times").alias("timings"), "aircraft_types")


def ops_by_route_day(flights: DataFrame) -> DataFrame:
    """Flights per route and weekday with each carrier's share and times."""
    per = flights.groupBy("route", F.date_format("flight_date", "EEEE").alias("day_name"),
                          F.upper("airline").alias("airline")).agg(
        F.count("flight_key").alias("flights"), F.array_sort(F.collect_set("departure_time")).alias("times"))
    entry = F.concat("airline", F.lit(":"), F.col("flights").cast("string"), F.lit("["), F.array_join("times", ", "),
                     F.lit("]"))
    return per.groupBy("route", "day_name").agg(
        F.sum("flights").alias("total"),
        F.transform(F.array_sort(F.collect_list(F.struct("airline", entry.alias("e")))), lambda s: s["e"]).alias("details"))
