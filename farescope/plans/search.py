"""Search plans as relations: dates, trip windows, route overrides, audits and capture jobs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farescope.functions import first_rows


def normalize_trip_type(value: Column) -> Column:
    text = F.replace(F.upper(F.trim(F.coalesce(F.nullif(value, F.lit("")), F.lit("OW")))), F.lit("-"), F.lit("_"))
    return F.when(text.isin("RT", "ROUNDTRIP", "ROUND_TRIP"), "RT").otherwise("OW")


def date_range(start: Column, end: Column) -> Column:
    """Every day between two dates, in either order; NULL bounds give no days."""
    days = F.sequence(F.least(start, end), F.greatest(start, end))
    return F.when(start.isNotNull() & end.isNotNull(), days).otherwise(F.array().cast("array<date>"))


def expand_dates(df: DataFrame, start: str = "start_date", end: str = "end_date", name: str = "date") -> DataFrame:
    return df.withColumn(name, F.explode(date_range(F.col(start), F.col(end))))


def search_windows(plans: DataFrame) -> DataFrame:
    """Outbound and return dates to search, in order.

    ``plans`` has outbound_dates, return_dates, return_offsets and trip_type. One way pairs each day
    with no return. Round trip takes the given returns on or after the outbound day, then the offsets.
    The windows of a plan come from its own arrays, so no join is involved. A round trip without
    returns, a negative offset or a plan without any window raises an error.
    """
    outbound = F.array_distinct(F.coalesce("outbound_dates", F.array().cast("array<date>")))
    returns = F.array_distinct(F.coalesce("return_dates", F.array().cast("array<date>")))
    offsets = F.array_distinct(F.coalesce("return_offsets", F.array().cast("array<int>")))
    round_trip = normalize_trip_type(F.col("trip_type")) == "RT"
    no_error = F.lit(None).cast("string")
    problem = F.when(round_trip, F.when(F.exists(offsets, lambda n: n < 0), "return_date offsets cannot be negative").when(
        (F.size(returns) == 0) & (F.size(offsets) == 0), "return_date is required for round-trip searches").otherwise(no_error))

    def later(day: Column) -> Column:
        found = F.concat(F.filter(returns, lambda r: r >= day), F.transform(offsets, lambda n: F.date_add(day, n)))
        return F.transform(F.array_distinct(found), lambda r: F.struct(day.alias("departure_date"), r.alias("return_date")))

    single = F.transform(outbound, lambda d: F.struct(
        d.alias("departure_date"), F.lit(None).cast("date").alias("return_date")))
    windows = F.when(round_trip, F.flatten(F.transform(outbound, later))).otherwise(single)
    empty = F.when(round_trip & (F.size("windows") == 0), "No valid round-trip search windows resolved")
    rows = plans.withColumns({"problem": problem}).withColumn("windows", F.when(F.col("problem").isNull(), windows))
    rows = rows.withColumn("problem", F.coalesce("problem", empty))
    checked = F.when(F.col("problem").isNotNull(), F.raise_error("problem")).otherwise(F.col("windows"))
    out = rows.select(*plans.columns, F.posexplode(checked).alias("position", "window"))
    return out.select(*plans.columns, "position", F.col("window.col1").alias("departure_date"),
                      F.col("window.col2").alias("return_date")) if "col1" in out.schema["window"].dataType.names else out.select(
        *plans.columns, "position", "window.departure_date", "window.return_date")


def _json_text(value: Column) -> Column:
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(value.isNotNull(), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.lit("null"))


def trip_context(df: DataFrame) -> DataFrame:
    """Add the trip request id, the trip columns and the defaults of the leg.

    The id is the start of the SHA-256 of the request as JSON with sorted keys.
    """
    trip = normalize_trip_type(F.col("trip_type"))
    out_day, back_day = F.col("departure_date").cast("date"), F.when(trip == "RT", F.col("return_date").cast("date"))
    origin, destination = F.upper(F.trim("origin")), F.upper(F.trim("destination"))
    adt = F.greatest(F.lit(1), F.coalesce(F.nullif(F.col("adt"), F.lit(0)), F.lit(1)))
    chd, inf = (F.greatest(F.lit(0), F.coalesce(c, F.lit(0))) for c in ("chd", "inf"))

    def day(value: Column) -> Column:
        return _json_text(F.date_format(value, "yyyy-MM-dd"))

    payload = F.format_string(
        '{"adt": %d, "cabin": %s, "chd": %d, "departure_date": %s, "destination": %s, "inf": %d, "origin": %s, '
        '"return_date": %s, "trip_type": "%s"}',
        adt, _json_text(F.trim(F.coalesce("cabin", F.lit("")))), chd, day(out_day), _json_text(destination), inf,
        _json_text(origin), day(back_day), trip)
    duration = F.datediff(back_day, out_day)
    direction = F.lower(F.trim(F.coalesce("leg_direction", F.lit(""))))
    direction = F.when(direction == "return", "inbound").when(direction == "", "outbound").otherwise(direction)
    return df.withColumns({
        "trip_request_id": F.substring(F.sha2(payload, 256), 1, 24),
        "search_trip_type": trip,
        "requested_outbound_date": out_day,
        "requested_return_date": back_day,
        "trip_duration_days": F.when(duration < 0, F.raise_error(F.lit("return_date cannot be earlier than departure_date")))
        .otherwise(duration),
        "trip_origin": origin,
        "trip_destination": destination,
        "leg_direction": direction,
        "leg_sequence": F.coalesce("leg_sequence", F.when(direction == "outbound", 1).when(direction == "inbound", 2)),
        "itinerary_leg_count": F.coalesce("itinerary_leg_count", F.when(trip == "RT", 2).otherwise(1)),
    })


def match_overrides(routes: DataFrame, overrides: DataFrame, first_only: bool = False) -> DataFrame:
    """Overrides of every route: those naming its carrier, or else those naming no carrier.

    ``overrides`` has airline (NULL for any), origin, destination and position, besides its settings.
    """
    key = ["airline", "origin", "destination"]
    pair = ["origin", "destination"]
    settings = [c for c in overrides.columns if c not in key]
    named = overrides.where("airline is not null and airline <> ''").select(*key, *settings)
    general = overrides.where("airline is null or airline = ''").select(*pair, *settings)
    specific = routes.join(named, key)
    wildcard = routes.join(named.select(*key).distinct(), key, "left_anti").join(general, pair)
    out = specific.unionByName(wildcard.select(*specific.columns))
    return first_rows(out, key, [F.col("position").asc()]) if first_only else out


def resolve_trip_plan(routes: DataFrame, overrides: DataFrame, outbound: Sequence[date], trip_type: str = "OW",
                      returns: Sequence[date] = (), offsets: Sequence[int] = (), limit_dates: int | None = None) -> DataFrame:
    """Search plan per route and matching override: the override's settings replace the global ones."""
    key = ["airline", "origin", "destination"]
    matched = routes.join(match_overrides(routes.select(*key), overrides).withColumnRenamed("trip_type", "o_trip"), key, "left")
    days = F.array(*[F.lit(d) for d in outbound]).cast("array<date>")
    base_returns = F.array(*[F.lit(d) for d in returns]).cast("array<date>")
    base_offsets = F.array(*[F.lit(n) for n in offsets]).cast("array<int>")

    def given(name: str) -> Column:
        return F.coalesce(F.size(F.col(name)) > 0, F.lit(False))

    own_trip = F.col("o_trip").isNotNull() & (F.col("o_trip") != "")
    own_return = given("return_dates") | given("return_offsets")
    own = own_trip | given("outbound_dates") | own_return
    trip = F.when(own_trip, normalize_trip_type(F.col("o_trip"))).otherwise(F.lit(trip_type))
    out_days = F.when(given("outbound_dates"), F.col("outbound_dates")).otherwise(days)
    if limit_dates and limit_dates > 0:
        out_days = F.slice(out_days, 1, limit_dates)
    round_trip = trip == "RT"

    def side(own_name: str, base: Column, kind: str) -> Column:
        value = F.when(own_return, F.coalesce(F.col(own_name), F.array().cast(kind))).otherwise(base)
        return F.when(round_trip, value).otherwise(F.array().cast(kind))

    return matched.select(
        *key, trip.alias("trip_type"), out_days.alias("outbound_dates"),
        side("return_dates", base_returns, "array<date>").alias("return_dates"),
        side("return_offsets", base_offsets, "array<int>").alias("return_offsets"),
        F.when(own, F.coalesce("source", F.lit("route_override"))).otherwise("global").alias("source"))


def audit_routes(routes: DataFrame, selected: Sequence[str], enabled: Sequence[str], airports: DataFrame) -> DataFrame:
    """Findings in the route configuration as (issue, airline, origin, destination, detail).

    ``routes`` has position, airline, origin, destination and cabins (array).
    """
    def code(name: str) -> Column:
        return F.upper(F.trim(F.coalesce(name, F.lit("")))).alias(name)

    rows = routes.select("position", code("airline"), code("origin"), code("destination"),
                         F.coalesce("cabins", F.array().cast("array<string>")).alias("cabins"))
    incomplete = (F.col("airline") == "") | (F.col("origin") == "") | (F.col("destination") == "")
    good = rows.where(~incomplete)
    key = ["airline", "origin", "destination"]

    def finding(df: DataFrame, issue: str, detail: Column) -> DataFrame:
        return df.select(F.lit(issue).alias("issue"), *key, detail.cast("string").alias("detail"))

    known = airports.select(F.upper("airport").alias("code")).distinct()
    ends = good.select(*key, F.inline(F.array(
        F.struct(F.lit("origin").alias("role"), F.col("origin").alias("code")),
        F.struct(F.lit("destination").alias("role"), F.col("destination").alias("code")))))
    pairs = good.select(*key).distinct()
    back = pairs.select("airline", F.col("origin").alias("destination"), F.col("destination").alias("origin"))
    repeated = good.groupBy(*key, "cabins").agg(F.count("*").alias("n")).where("n > 1")
    allowed = F.col("airline").isin(list(enabled))
    parts = [
        finding(repeated, "duplicate", F.array_join("cabins", "|")),
        finding(rows.where(incomplete), "malformed", F.col("position")),
        finding(good.where(~allowed), "unknown_airline", F.col("position")),
        finding(good.where(allowed & ~F.col("airline").isin(list(selected))), "not_selected_airline", F.col("position")),
        finding(ends.join(known, "code", "left_anti"), "unknown_airport", F.concat_ws(":", "role", "code")),
        finding(pairs.join(back, key, "left_anti"), "missing_reverse", F.lit(None)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit_counts(routes: DataFrame, selected: Sequence[str], enabled: Sequence[str], airports: DataFrame) -> DataFrame:
    """Findings per kind, and configured routes per selected carrier."""
    found = audit_routes(routes, selected, enabled, airports).groupBy("issue").agg(F.count("*").alias("rows"))
    per = routes.where(F.upper(F.trim("airline")).isin(list(selected))).groupBy(
        F.concat(F.lit("routes:"), F.upper(F.trim("airline"))).alias("issue")).agg(F.count("*").alias("rows"))
    return found.unionByName(per)


def stale_targets(routes: DataFrame, offers: DataFrame, cutoff: datetime, limit: int | None = None) -> DataFrame:
    """Configured route and cabin without a capture since the cutoff, in configuration order."""
    cabins = F.when(F.size("cabins") > 0, F.col("cabins")).otherwise(F.array(F.lit("Economy")))
    targets = routes.select("position", F.upper("airline").alias("airline"), F.upper("origin").alias("origin"),
                            F.upper("destination").alias("destination"), F.posexplode(cabins).alias("n", "cabin"))
    key = ["airline", "origin", "destination", "cabin"]
    latest = offers.groupBy(*key).agg(F.max("captured_at").alias("latest_captured_at"))
    out = targets.join(latest, key, "left").where(
        F.col("latest_captured_at").isNull() | (F.col("latest_captured_at") < F.lit(cutoff)))
    out = out.orderBy("position", "n").select("position", *key, "latest_captured_at")
    return out.limit(limit) if limit is not None else out


def build_jobs(routes: DataFrame, dates: Sequence[date], cabin: str, airlines: Sequence[str]) -> DataFrame:
    """Capture job per route of the given carriers and date. The dates travel as an array column."""
    days = F.array(*[F.lit(d) for d in dates])
    wanted = routes.where(F.col("airline").isin(list(airlines)))
    return wanted.select(F.col("airline").alias("carrier"), "origin", "destination", F.explode(days).alias("date"),
                         F.lit(cabin).alias("cabin"))


