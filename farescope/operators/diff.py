"""Change detection between offer states.

A *state* has one row per diff identity (airline, route, departure, flight, cabin, fare basis,
brand) and cycle. Two states are paired once; every kind of event is then built from the pair in
the same pass, as an array that is unfolded, so the offers are shuffled once and not per domain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farescope.functions import DIFF_KEY, all_of, bounded_broadcast, first_rows, json_sql, number_sql
from farescope.operators.cycles import cycle_order

# Columns that identify a stored row and are never reported as a change.
BOOKKEEPING = ("offer_id", "meta_id", "cycle_id", "captured_at", "cycle_no", "capture_date")

_DOMAIN_OF_FIELD = {
    "price_total": "price",
    "seat_available": "seat",
    "seat_capacity": "capacity",
    "departure": "schedule",
    "arrival": "schedule",
}


def current_state(rows: DataFrame, keys: Sequence[str] = DIFF_KEY) -> DataFrame:
    """Last row per identity (NULL parts equal each other), newest capture first."""
    return first_rows(rows, list(keys), [F.col("captured_at").desc(), F.col("offer_id").desc()])


def cycle_states(offers: DataFrame) -> DataFrame:
    """One state row per identity and cycle."""
    return current_state(offers, ["cycle_id", *DIFF_KEY])


def previous_state(offers: DataFrame, cycle_id: str | Column, scope: DataFrame | None = None) -> DataFrame:
    """Latest known row per identity over all other cycles.

    ``scope`` limits it to the searched (airline, origin, destination, cabin, departure_day), since
    an offer outside the search cannot be called removed.
    """
    cycle = cycle_id if isinstance(cycle_id, Column) else F.lit(cycle_id)
    rows = offers.where(F.col("cycle_id") != cycle)
    if scope is not None:
        day = F.to_date("departure")
        rows = rows.withColumn("departure_day", day).join(
            scope.select("airline", "origin", "destination", "cabin", "departure_day").distinct(),
            ["airline", "origin", "destination", "cabin", "departure_day"], "left_semi",
        ).drop("departure_day")
    fare_basis, brand = F.coalesce("fare_basis", F.lit("")), F.coalesce("brand", F.lit(""))
    keys = ["airline", "origin", "destination", "departure", "flight_number", "cabin", fare_basis, brand]
    return first_rows(rows, keys, [F.col("captured_at").desc(), F.col("offer_id").desc()])


def searched_scope(offers: DataFrame) -> DataFrame:
    """What a set of offers covered: airline, route, cabin and departure days."""
    return offers.select(
        "airline", "origin", "destination", "cabin", F.to_date("departure").alias("departure_day")
    ).distinct()


def pair_states(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Full outer pairing on the null-safe identity; columns ``p`` and ``c`` hold both rows."""
    p = previous.select(F.struct(*previous.columns).alias("p"))
    c = current.select(F.struct(*current.columns).alias("c"))
    same = all_of([F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}")) for k in DIFF_KEY])
    return p.join(c, same, "full").withColumn("detected_at", F.coalesce("c.captured_at", "p.captured_at"))


def pair_consecutive(states: DataFrame, order: DataFrame | None = None, first_as_added: bool = True) -> DataFrame:
    """Pair the states of every cycle with those of the cycle before it.

    Neighbours are found by one window over the identity, which holds one row per cycle, so no
    self join is needed. ``detected_at`` is the start of the newer cycle. A row whose identity
    is missing in the next cycle gives a pair without ``c``. ``order`` is the output of
    ``cycle_order``; pass one made from a narrow table, or it is made from ``states``.
    """
    if order is None:
        order = cycle_order(states)
    # One row per cycle, checked before it is broadcast.
    numbered = states.join(bounded_broadcast(order), "cycle_id")
    payload = F.struct(*states.columns)
    w = Window.partitionBy(*DIFF_KEY).orderBy("cycle_no")
    seen = numbered.select(
        "cycle_no",
        "started_at",
        "next_started_at",
        payload.alias("row"),
        F.lag("cycle_no").over(w).alias("before_no"),
        F.lag(payload).over(w).alias("before"),
        F.lead("cycle_no").over(w).alias("after_no"),
    )
    row_type = seen.schema["row"].dataType
    linked = F.col("before_no") == F.col("cycle_no") - 1
    arrival = F.struct(
        F.when(linked, F.col("before")).alias("p"), F.col("row").alias("c"), F.col("started_at").alias("detected_at")
    )
    departure = F.struct(
        F.col("row").alias("p"), F.lit(None).cast(row_type).alias("c"), F.col("next_started_at").alias("detected_at")
    )
    stays = F.coalesce(F.col("after_no") == F.col("cycle_no") + 1, F.lit(False))
    leaves = F.col("next_started_at").isNotNull() & ~stays
    if not first_as_added:
        arrival = F.when(F.col("cycle_no") > 1, arrival)
    return seen.select(F.inline(F.array_compact(F.array(arrival, F.when(leaves, departure)))))


# ---------------------------------------------------------------- summary events


def summary_events(pairs: DataFrame, domains: Sequence[str] | None = None) -> DataFrame:
    """Availability, price, seat, capacity and schedule events of paired states."""
    has = set(pairs.schema["c"].dataType.fieldNames())
    wanted = domains or ("availability", "price", "seat", "capacity", "schedule")
    builders = {
        "availability": _availability_events,
        "price": lambda: [_numeric_event("price", "price_total", with_percent=True)],
        "seat": lambda: [_numeric_event("seat", "seat_available")],
        "capacity": lambda: [_capacity_event("aircraft" in has)],
        "schedule": lambda: [_schedule_event("arrival" in has)],
    }
    events = [e for d in wanted for e in builders[d]()]
    return pairs.select("detected_at", F.inline(F.array_compact(F.array(*events))))


def diff_availability(pairs: DataFrame) -> DataFrame:
    return summary_events(pairs, ["availability"])


def diff_price(pairs: DataFrame) -> DataFrame:
    return summary_events(pairs, ["price"])


def diff_seats(pairs: DataFrame) -> DataFrame:
    return summary_events(pairs, ["seat"])


def diff_capacity(pairs: DataFrame) -> DataFrame:
    return summary_events(pairs, ["capacity"])


def diff_schedule(pairs: DataFrame) -> DataFrame:
    return summary_events(pairs, ["schedule"])


def event_row(domain: str, change_type: Column, direction: Column, side: str, from_ts: Column,
              magnitude: Column | None = None, percent: Column | None = None,
              metadata: Column | None = None) -> Column:
    """Event envelope. ``side`` is the row (p or c) that describes the offer."""
    null_double = F.lit(None).cast("double")
    return F.struct(
        F.lit(domain).alias("domain"),
        change_type.alias("change_type"),
        direction.alias("direction"),
        F.lit("unknown").alias("velocity"),
        (null_double if magnitude is None else magnitude).alias("magnitude"),
        (null_double if percent is None else percent).alias("percent_change"),
        *[F.col(f"{side}.{n}").alias(n) for n in ("airline", "flight_number", "origin", "destination", "cabin")],
        F.coalesce(F.col(f"{side}.departure"), F.col(f"{side}.captured_at")).alias("departure"),
        from_ts.alias("from_timestamp"),
        F.coalesce(F.col(f"{side}.captured_at"), F.col("detected_at")).alias("to_timestamp"),
        (F.lit("{}") if metadata is None else metadata).alias("metadata"),
    )


def _availability_events() -> list[Column]:
    no_time = F.lit(None).cast("timestamp_ntz")
    removed = event_row("availability", F.lit("removed"), F.lit("down"), "p", F.col("p.captured_at"),
                        metadata=F.lit('{"reason":"disappeared"}'))
    added = event_row("availability", F.lit("added"), F.lit("up"), "c", no_time,
                      metadata=F.lit('{"reason":"newly_available"}'))
    return [F.when(F.col("c").isNull(), removed), F.when(F.col("p").isNull(), added)]


def _both() -> Column:
    return F.col("p").isNotNull() & F.col("c").isNotNull()


def _numeric_event(domain: str, field: str, with_percent: bool = False, metadata: Column | None = None) -> Column:
    before, after = F.col(f"p.{field}").cast("double"), F.col(f"c.{field}").cast("double")
    delta = after - before
    event = event_row(
        domain,
        F.when(delta > 0, "increase").otherwise("decrease"),
        F.when(delta > 0, "up").otherwise("down"),
        "c",
        F.col("p.captured_at"),
        magnitude=F.abs(delta),
        percent=F.try_divide(delta, before) * 100.0 if with_percent else None,
        metadata=metadata if metadata is not None else F.to_json(
            F.struct(before.alias("before"), after.alias("after"))),
    )
    return F.when(_both() & (before != after), event)


def _capacity_event(has_aircraft: bool) -> Column:
    text = F.lit(None).cast("string")
    before = F.col("p.aircraft") if has_aircraft else text
    after = F.col("c.aircraft") if has_aircraft else text
    meta = F.to_json(F.struct(before.alias("aircraft_before"), after.alias("aircraft_after")))
    return _numeric_event("capacity", "seat_capacity", metadata=meta)


def _schedule_event(has_arrival: bool) -> Column:
    moved = ~F.col("p.departure").eqNullSafe(F.col("c.departure"))
    fields = [F.col(f"{s}.departure").alias(f"departure_{n}") for s, n in (("p", "before"), ("c", "after"))]
    if has_arrival:
        moved = moved | ~F.col("p.arrival").eqNullSafe(F.col("c.arrival"))
        fields += [F.col(f"{s}.arrival").alias(f"arrival_{n}") for s, n in (("p", "before"), ("c", "after"))]
    meta = F.to_json(F.struct(*fields), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"})
    event = event_row("schedule", F.lit("modified"), F.lit("none"), "c", F.col("p.captured_at"), metadata=meta)
    return F.when(_both() & moved, event)


# ---------------------------------------------------------------- field-level changes


def diff_columns(pairs: DataFrame, compare_fields: Sequence[str] | None = None, legacy: bool = False) -> DataFrame:
    """One row per changed field of a matched pair, and one presence row per added or removed offer.

    By default the fields both sides have are compared. ``legacy`` compares the union, so a field
    only one side carries shows up as added or removed.
    """
    p_fields = pairs.schema["p"].dataType
    c_fields = pairs.schema["c"].dataType
    p_names, c_names = set(p_fields.fieldNames()), set(c_fields.fieldNames())
    if compare_fields is None:
        chosen = (p_names | c_names) if legacy else (p_names & c_names)
        compare_fields = sorted(chosen - set(BOOKKEEPING) - set(DIFF_KEY))
    entries = [
        _field_entry(f, p_fields[f].dataType.simpleString() if f in p_names else None,
                     c_fields[f].dataType.simpleString() if f in c_names else None)
        for f in compare_fields
    ]
    removed = _presence("removed", "down", "true", "false")
    added = _presence("added", "up", "false", "true")
    entries = [F.when(F.col("c").isNull(), removed), F.when(F.col("p").isNull(), added), *entries]
    side = {n: F.coalesce(F.col(f"c.{n}"), F.col(f"p.{n}")) for n in DIFF_KEY}
    # Unfold first, then spell out the event: the offer columns are not repeated in the array.
    unfolded = pairs.select("p", "c", "detected_at", F.inline(F.array_compact(F.array(*entries))))
    return unfolded.select(
        F.col("c.cycle_id").alias("cycle_id"),
        F.col("p.cycle_id").alias("previous_cycle_id"),
        "detected_at",
        F.to_date("detected_at").alias("report_day"),
        *[side[n].alias(n) for n in ("airline", "origin", "destination", "flight_number")],
        F.to_date(side["departure"]).alias("departure_day"),
        F.date_format(side["departure"], "HH:mm:ss").alias("departure_time"),
        *[side[n].alias(n) for n in ("cabin", "fare_basis", "brand")],
        "domain", "change_type", "direction", "field_name", "old_value", "new_value", "magnitude",
        "percent_change",
        F.to_json(F.array(*[
            F.date_format(side[n], "yyyy-MM-dd'T'HH:mm:ss") if n == "departure" else side[n].cast("string")
            for n in DIFF_KEY
        ])).alias("identity_key"),
    )


def _presence(change_type: str, direction: str, before: str, after: str) -> Column:
    return F.struct(
        F.lit("availability").alias("domain"),
        F.lit(change_type).alias("change_type"),
        F.lit(direction).alias("direction"),
        F.lit("__row_presence__").alias("field_name"),
        F.lit(f'{{"present":{before}}}').alias("old_value"),
        F.lit(f'{{"present":{after}}}').alias("new_value"),
        F.lit(None).cast("double").alias("magnitude"),
        F.lit(None).cast("double").alias("percent_change"),
    )


def _field_entry(name: str, p_type: str | None, c_type: str | None) -> Column:
    """Change of one field as a struct, NULL when nothing changed. SQL text keeps plan building quick."""
    old = f"p.`{name}`" if p_type else f"CAST(NULL AS {c_type})"
    new = f"c.`{name}`" if c_type else f"CAST(NULL AS {p_type})"
    p_type, c_type = p_type or c_type, c_type or p_type
    x, y = number_sql(old, p_type), number_sql(new, c_type)
    return F.expr(f"""
        CASE WHEN p IS NOT NULL AND c IS NOT NULL AND NOT ({old} <=> {new}) THEN named_struct(
          'domain', '{_DOMAIN_OF_FIELD.get(name, "field")}',
          'change_type', CASE
            WHEN {old} IS NULL THEN 'added'
            WHEN {new} IS NULL THEN 'removed'
            WHEN {y} > {x} THEN 'increase'
            WHEN {y} < {x} THEN 'decrease'
            WHEN {y} = {x} THEN 'stable'
            ELSE 'modified' END,
          'direction', CASE WHEN {y} > {x} THEN 'up' WHEN {y} < {x} THEN 'down' ELSE 'none' END,
          'field_name', '{name}',
          'old_value', {json_sql(old, p_type)},
          'new_value', {json_sql(new, c_type)},
          'magnitude', abs({y} - {x}),
          'percent_change', try_divide({y} - {x}, {x}) * 100.0D) END""")
