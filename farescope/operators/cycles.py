"""Capture cycles: run facts, comparable cycles, full cycles, freshness and coverage.

Everything starts from one aggregate over the offers. What remains afterwards has one row
per cycle (or cycle and airline), so ordering and ranking it is cheap at any input size.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farescope.functions import ROUTE, all_of, first_rows, pct, route_key

# Fixed limits for a cycle that may be compared with others.
MIN_OFFER_ROWS = 500
MIN_AIRLINES = 5
MIN_ROUTES = 10


def cycle_runs(offers: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """One row per cycle: first and last capture, rows, airlines, routes."""
    if start is not None:
        offers = offers.where(F.col("captured_at") >= F.lit(start))
    if end is not None:
        offers = offers.where(F.col("captured_at") < F.lit(end))
    return offers.groupBy("cycle_id").agg(
        F.min("captured_at").alias("cycle_started_at_utc"),
        F.max("captured_at").alias("cycle_completed_at_utc"),
        F.count("*").alias("offer_rows"),
        F.countDistinct("airline").alias("airline_count"),
        F.countDistinct(*ROUTE).alias("route_count"),
    )


def is_comparable(min_rows: int = MIN_OFFER_ROWS, min_airlines: int = MIN_AIRLINES,
                  min_routes: int = MIN_ROUTES) -> Column:
    return all_of([
        F.col("offer_rows") >= min_rows,
        F.col("airline_count") >= min_airlines,
        F.col("route_count") >= min_routes,
    ])


def dedup_cycle_loads(runs: DataFrame) -> DataFrame:
    """Keep the newest load of a cycle that was loaded more than once."""
    order = [F.col("cycle_completed_at_utc").desc(), F.col("cycle_started_at_utc").desc(), F.col("offer_rows").desc()]
    return first_rows(runs, ["cycle_id"], order)


def recent_cycles(runs: DataFrame, n: int = 10, comparable_only: bool = True) -> DataFrame:
    """Newest ``n`` cycles, by default only comparable ones."""
    kept = runs.where(is_comparable()) if comparable_only else runs
    ordered = dedup_cycle_loads(kept).orderBy(F.col("cycle_completed_at_utc").desc(), F.col("cycle_id").desc())
    return ordered.limit(n)


def latest_cycle(runs: DataFrame, comparable_only: bool = True) -> DataFrame:
    return recent_cycles(runs, 1, comparable_only)


def latest_two(offers: DataFrame, airlines: Sequence[str] | None = None) -> DataFrame:
    """The two newest cycles, ranked 1 (newest) and 2."""
    if airlines:
        offers = offers.where(F.col("airline").isin([a.upper() for a in airlines]))
    return _rank(_by_capture(cycle_times(offers)).limit(2))


def cycle_times(offers: DataFrame) -> DataFrame:
    """Capture time of every cycle."""
    return offers.groupBy("cycle_id").agg(F.max("captured_at").alias("captured_at"))


def last_n_by_id(offers: DataFrame, n: int) -> DataFrame:
    """Last ``n`` cycle ids in text order, oldest first."""
    ids = offers.select("cycle_id").distinct().orderBy(F.col("cycle_id").desc()).limit(n)
    return ids.withColumn("position", F.row_number().over(Window.orderBy("cycle_id"))).orderBy("position")


def latest_two_full(offers: DataFrame, lookback: int | None = None, min_rows_floor: int = 100, min_full_ratio: float = 0.30,
                    airlines: Sequence[str] | None = None) -> DataFrame:
    """The two newest complete cycles.

    A cycle is complete when every target airline reaches its own row threshold. When fewer
    than two cycles pass, the threshold on whole-cycle rows decides, and after that recency.
    """
    counts = offers.groupBy("cycle_id", F.upper("airline").alias("airline")).agg(
        F.count("*").alias("rows"), F.max("captured_at").alias("captured_at")
    )
    per_cycle = counts.groupBy("cycle_id").agg(
        F.max("captured_at").alias("captured_at"), F.sum("rows").alias("total"),
        F.collect_list(F.struct("airline", "rows")).alias("per_airline"),
    )
    recent = per_cycle if lookback is None else _by_capture(per_cycle).limit(max(lookback, 2))
    wanted = [a.strip().upper() for a in airlines or []]
    used = F.array_contains(F.array(*[F.lit(a) for a in wanted]), F.col("airline")) if wanted else F.trim("airline") != ""
    flat = recent.select("cycle_id", "captured_at", "total", F.inline("per_airline")).where(F.col("airline").isNotNull())
    largest = F.max("rows").over(Window.partitionBy("airline"))
    threshold = F.least(largest, F.greatest(F.lit(min_rows_floor), F.floor(largest * min_full_ratio)))
    flat = flat.withColumns({"used": used, "reached": used & (F.col("rows") >= threshold)})
    everything = Window.partitionBy(F.lit(0))
    targets = F.lit(len(set(wanted))) if wanted else F.size(F.collect_set(F.when(F.col("used"), F.col("airline"))).over(everything))
    cycles = flat.withColumn("targets", targets).groupBy("cycle_id", "captured_at", "total", "targets").agg(
        F.count_if("reached").alias("reached"))
    floor = F.greatest(F.lit(min_rows_floor), F.floor(F.max("total").over(everything) * min_full_ratio))
    marked = cycles.withColumns({
        "full": (F.col("targets") > 0) & (F.col("reached") == F.col("targets")), "large": F.col("total") >= floor,
    })
    enough = {n: F.count_if(F.col(n)).over(everything) >= 2 for n in ("full", "large")}
    chosen = marked.withColumn("tier", F.when(enough["full"], 1).when(enough["large"], 2).otherwise(3))
    kept = F.when(F.col("tier") == 1, F.col("full")).when(F.col("tier") == 2, F.col("large")).otherwise(True)
    return _rank(_by_capture(chosen.where(kept).select("cycle_id", "captured_at", "tier")).limit(2))


def dominant_mix(offers: DataFrame, meta: DataFrame, cycle_id: str | Column) -> DataFrame:
    """Most frequent passenger mix of a cycle; ties go to the smaller counts."""
    cycle = cycle_id if isinstance(cycle_id, Column) else F.lit(cycle_id)
    rows = offers.where(F.col("cycle_id") == cycle).select("offer_id").join(
        meta.select("offer_id", "adt_count", "chd_count", "inf_count"), "offer_id"
    )
    mix = rows.groupBy(
        F.coalesce("adt_count", F.lit(1)).alias("adt"),
        F.coalesce("chd_count", F.lit(0)).alias("chd"),
        F.coalesce("inf_count", F.lit(0)).alias("inf"),
    ).agg(F.count("*").alias("rows"))
    return mix.orderBy(F.col("rows").desc(), "adt", "chd", "inf").limit(1)


def airline_stats(offers: DataFrame) -> DataFrame:
    """Rows and distinct routes per cycle and airline."""
    return offers.groupBy("cycle_id", F.upper("airline").alias("airline")).agg(
        F.count("*").alias("row_count"), F.countDistinct(*ROUTE).alias("route_count")
    )


def partial_cycles(offers: DataFrame, selected: DataFrame, lookback: int | None = None, min_rows_floor: int = 100,
                   min_full_ratio: float = 0.30, airlines: Sequence[str] | None = None) -> DataFrame:
    """Selected cycles that look incomplete for an airline against its recent best.

    ``selected`` has ``label`` (such as current, previous) and ``cycle_id``.
    """
    if airlines:
        offers = offers.where(F.upper("airline").isin([a.upper() for a in airlines]))
    stats = airline_stats(offers)
    known = stats
    if lookback is not None:
        recent = _by_capture(cycle_times(offers)).limit(max(2, lookback)).select("cycle_id")
        known = stats.join(recent, "cycle_id", "left_semi")
    best = known.groupBy("airline").agg(
        F.max("row_count").alias("max_rows"), F.max("route_count").alias("max_routes")
    )
    best = best.withColumn(
        "row_threshold",
        F.least("max_rows", F.greatest(F.lit(min_rows_floor), F.floor(F.col("max_rows") * min_full_ratio))),
    ).withColumn(
        "route_threshold",
        F.least("max_routes", F.greatest(F.lit(1), F.ceil(F.col("max_routes") * min_full_ratio))),
    )
    # One row per selected cycle and airline: a handful of labels times the airlines.
    labels = selected.agg(F.collect_list(F.struct("label", "cycle_id"))).scalar()
    grid = best.select("*", F.inline(labels))
    found = grid.join(stats, ["cycle_id", "airline"], "left")
    rows_now = F.coalesce("row_count", F.lit(0))
    routes_now = F.coalesce("route_count", F.lit(0))
    return found.select(
        "label", "cycle_id", "airline", rows_now.alias("rows_now"), "row_threshold", "max_rows",
        routes_now.alias("routes_now"), "route_threshold", "max_routes",
    ).where((F.col("rows_now") < F.col("row_threshold")) | (F.col("routes_now") < F.col("route_threshold")))


def cycle_health(offers: DataFrame, routes: DataFrame, as_of: datetime, stale_minutes: int = 180) -> DataFrame:
    """Freshness of the newest comparable cycle and its coverage of the configured route pairs."""
    latest = latest_cycle(cycle_runs(offers))
    pair = F.concat(F.col("airline"), F.lit(":"), route_key())
    configured = routes.select(pair.alias("pair")).where("pair is not null").distinct()
    in_cycle = offers.where(F.col("cycle_id") == latest.select("cycle_id").scalar())
    observed = in_cycle.select(pair.alias("pair")).where("pair is not null").distinct()
    gaps = configured.join(observed, "pair", "left_anti")
    all_gaps = gaps.agg(F.array_sort(F.collect_list("pair")))
    age = (F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp("cycle_completed_at_utc")) / 60.0
    n_configured = configured.agg(F.count("*")).scalar()
    n_observed = observed.agg(F.count("*")).scalar()
    return latest.select(
        "cycle_id", "cycle_started_at_utc", "cycle_completed_at_utc",
        F.round(age, 2).alias("cycle_age_minutes"),
        (F.round(age, 2) > stale_minutes).alias("stale"),
        "offer_rows", "airline_count", "route_count",
        n_configured.alias("configured_route_pair_count"),
        n_observed.alias("observed_route_pair_count"),
        F.coalesce(pct(n_observed, n_configured, 2), F.lit(0.0)).alias("route_pair_coverage_pct"),
        all_gaps.scalar().alias("missing_route_pairs"),
    )


def coverage_gate(offers: DataFrame, expected: DataFrame, cycle_id: str | Column, min_rows: int = 1) -> DataFrame:
    """Does every expected airline have enough rows in the cycle? One row."""
    cycle = cycle_id if isinstance(cycle_id, Column) else F.lit(cycle_id)
    code = F.upper(F.trim("airline")).alias("airline")
    wanted = expected.select(code).where("airline <> ''").distinct()
    counts = offers.where(F.col("cycle_id") == cycle).groupBy(code).agg(F.count("*").alias("rows"))
    found = wanted.join(counts, "airline", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    enough = F.col("rows") >= max(1, min_rows)
    n, covered = F.count("*"), F.count_if(enough)
    return found.agg(
        n.alias("expected_airlines"),
        covered.alias("covered_airlines"),
        F.array_sort(F.collect_set(F.when(~enough, F.col("airline")))).alias("missing_airlines"),
        F.coalesce(pct(covered, n, 2), F.lit(0.0)).alias("coverage_pct"),
        ((n > 0) & (covered == n)).alias("coverage_gate_passed"),
    )


def cycle_order(offers: DataFrame) -> DataFrame:
    """Cycles numbered by start time, with the start of the next one; one row per cycle."""
    times = offers.groupBy("cycle_id").agg(F.min("captured_at").alias("started_at"))
    w = Window.orderBy("started_at", "cycle_id")
    return times.select(
        "cycle_id", "started_at", F.row_number().over(w).alias("cycle_no"),
        F.lead("started_at").over(w).alias("next_started_at"),
    )


def _by_capture(cycles: DataFrame) -> DataFrame:
    return cycles.orderBy(F.col("captured_at").desc(), F.col("cycle_id").desc())


def _rank(cycles: DataFrame) -> DataFrame:
    order = Window.orderBy(F.col("captured_at").desc(), F.col("cycle_id").desc())
    return cycles.withColumn("position", F.row_number().over(order))
