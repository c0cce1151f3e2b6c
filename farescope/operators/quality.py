"""Data quality, service levels, log health and route risk."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farescope.functions import any_of, clip, first_rows, half_even, numeric_round, pct, ratio, route_key, top
from farescope.operators.rollups import DAILY_KEY
from farescope.sources import latest_meta

CORE_FIELDS = ["airline", "flight_number", "origin", "destination", "departure", "cabin", "brand", "fare_basis",
               "price_total", "seat_available", "seat_capacity"]
META_FIELDS = ["currency", "fare_amount", "tax_amount", "baggage", "aircraft", "booking_class", "soldout", "adt_count",
               "chd_count", "inf_count", "inventory_confidence", "departure_utc", "arrival_utc", "source_endpoint"]


def dq_summary(offers: DataFrame) -> DataFrame:
    return offers.agg(
        F.count("*").alias("total_rows"),
        F.countDistinct("cycle_id").alias("cycle_count"),
        F.countDistinct("airline", "origin", "destination").alias("observed_route_count"),
        F.min("captured_at").alias("min_captured_at"),
        F.max("captured_at").alias("max_captured_at"),
    )


def dq_duplicates(offers: DataFrame) -> DataFrame:
    """Rows beyond the first and keys with more than one row, over the nine key columns."""
    keys = ["cycle_id", "airline", "origin", "destination", "flight_number", "departure"]
    filled = [F.coalesce(c, F.lit("")).alias(c) for c in ("cabin", "fare_basis", "brand")]
    counts = offers.groupBy(*keys, *filled).agg(F.count("*").alias("n"))
    return counts.agg(
        F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).alias("duplicate_rows"),
        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
    )


def _core_totals(offers: DataFrame) -> DataFrame:
    """One row with the figures of ``dq_summary``, ``dq_duplicates`` and ``core_nulls``, from one reading of the offers.

    Offers are counted by the nine key columns first. Missing values of six of them are seen in the keys, the others are counted.
    """
    keys = ["cycle_id", "airline", "origin", "destination", "flight_number", "departure"]
    filled = ["cabin", "fare_basis", "brand"]
    counted = [f for f in CORE_FIELDS if f not in keys]
    groups = offers.groupBy(*keys, *[F.coalesce(c, F.lit("")).alias(f"filled_{c}") for c in filled]).agg(
        F.count("*").alias("n"), F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"),
        *[F.count_if(F.col(f).isNull()).alias(f"n_{f}") for f in counted])
    n, zero = F.col("n"), F.lit(0)
    missing = {f: F.col(f"n_{f}") if f in counted else F.when(F.col(f).isNull(), n).otherwise(zero) for f in CORE_FIELDS}
    return groups.agg(
        F.coalesce(F.sum(n), zero).alias("total_rows"), F.countDistinct("cycle_id").alias("cycle_count"),
        F.countDistinct("airline", "origin", "destination").alias("observed_route_count"),
        F.min("first_at").alias("min_captured_at"), F.max("last_at").alias("max_captured_at"),
        F.coalesce(F.sum(F.greatest(n - 1, zero)), zero).alias("duplicate_rows"), F.count_if(n > 1).alias("duplicate_keys"),
        *[F.coalesce(F.sum(c), zero).alias(f"null_{f}") for f, c in missing.items()])


def _meta_totals(offers: DataFrame, meta: DataFrame) -> DataFrame:
    """One row with the figures of ``meta_nulls`` and ``meta_coverage``, from one join. Only flags of the fields are shuffled."""
    flags = {f"null_{f}": F.col(f).isNull() for f in META_FIELDS}
    flags |= {s: F.coalesce(F.col("inventory_confidence") == s, F.lit(False)) for s in ("reported", "unknown")}
    side = latest_meta(meta.select("offer_id", "meta_id", *[c.alias(n) for n, c in flags.items()]))
    rows = offers.select("offer_id").join(side, "offer_id", "left")
    # An offer without a side-car lacks every field.
    return rows.agg(
        F.count("*").alias("rows_seen"), F.count("meta_id").alias("rows_with_raw_meta"),
        *[F.count_if(F.coalesce(f"null_{f}", F.lit(True))).alias(f"null_{f}") for f in META_FIELDS],
        F.count_if("reported").alias("reported_count"), F.count_if("unknown").alias("unknown_count"))


def _null_counts(df: DataFrame, fields: Sequence[str], scope: str, extra: Sequence[Column] = ()) -> DataFrame:
    """One aggregate over all fields, then one row per field."""
    wide = df.agg(F.count("*").alias("rows_seen"), *extra,
                  *[F.count_if(F.col(f).isNull()).alias(f"n_{f}") for f in fields])
    items = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n_{f}").alias("null_count")) for f in fields])
    rows = wide.select("rows_seen", F.inline(items))
    return rows.select(F.lit(scope).alias("scope"), "field", "null_count", "rows_seen",
                       pct(F.col("null_count"), F.col("rows_seen"), 4).alias("null_rate_pct"))


def core_nulls(offers: DataFrame) -> DataFrame:
    return _null_counts(offers, CORE_FIELDS, "null_core")


def _with_newest_meta(offers: DataFrame, meta: DataFrame, fields: Sequence[str]) -> DataFrame:
    side = latest_meta(meta.select("offer_id", "meta_id", *fields))
    return offers.select("offer_id").join(side, "offer_id", "left")


def meta_nulls(offers: DataFrame, meta: DataFrame) -> DataFrame:
    return _null_counts(_with_newest_meta(offers, meta, META_FIELDS), META_FIELDS, "null_raw_meta")


def dq_nulls(offers: DataFrame, meta: DataFrame) -> DataFrame:
    """NULL counts and rates of the core fields and of the newest side-car row."""
    return core_nulls(offers).unionByName(meta_nulls(offers, meta))


def meta_coverage(offers: DataFrame, meta: DataFrame) -> DataFrame:
    """How many offers have a side-car, and how many of those report their inventory."""
    rows = _with_newest_meta(offers, meta, ["inventory_confidence"])
    seen = F.count("*")
    with_meta = F.count("meta_id")
    reported = F.count_if(F.col("inventory_confidence") == "reported")
    unknown = F.count_if(F.col("inventory_confidence") == "unknown")
    return rows.agg(
        seen.alias("rows_seen"), with_meta.alias("rows_with_raw_meta"),
        pct(with_meta, seen, 4).alias("raw_meta_coverage_pct"),
        reported.alias("reported_count"), unknown.alias("unknown_count"),
        pct(reported, seen, 4).alias("reported_rate_pct"), pct(unknown, seen, 4).alias("unknown_rate_pct"),
    )


def _route_codes(df: DataFrame) -> DataFrame:
    return df.select(F.upper("airline").alias("airline"), F.upper("origin").alias("origin"),
                     F.upper("destination").alias("destination")).distinct()


def dq_route_coverage(offers: DataFrame, routes: DataFrame) -> DataFrame:
    """Expected against observed carrier routes, with the missing ones as text. One row."""
    expected, observed = _route_codes(routes), _route_codes(offers)
    label = F.concat("airline", F.lit(":"), route_key())
    missing = expected.join(observed, ["airline", "origin", "destination"], "left_anti")
    n_expected, n_observed = expected.agg(F.count("*")).scalar(), observed.agg(F.count("*")).scalar()
    return missing.agg(F.array_join(F.array_sort(F.collect_list(label)), "; ").alias("missing_routes")).select(
        n_expected.alias("expected_route_count"), n_observed.alias("observed_route_count"),
        pct(n_observed, n_expected, 4).alias("coverage_pct"), "missing_routes",
    )


def _metric_rows(df: DataFrame, rows: Sequence[tuple[str, str, Column, str]]) -> DataFrame:
    items = [F.struct(F.lit(c).alias("category"), F.lit(m).alias("metric"), v.cast("string").alias("value"),
                      F.lit(n).alias("notes")) for c, m, v, n in rows]
    return df.select(F.inline(F.array(*items)))


def dq_report(offers: DataFrame, meta: DataFrame, routes: DataFrame,
              scope: dict[str, str] | None = None) -> DataFrame:
    """The whole quality report as (category, metric, value, notes), values as text."""
    c = F.col
    summary_time = "yyyy-MM-dd HH:mm:ss"

    def nulls(category: str, fields: Sequence[str], seen: str) -> list[tuple[str, str, Column, str]]:
        return [(category, f"{f}{suffix}", value, "") for f in fields for suffix, value in (
            ("_null_count", c(f"null_{f}")), ("_null_rate_pct", pct(c(f"null_{f}"), c(seen), 4)))]

    core = _metric_rows(_core_totals(offers), [
        ("summary", "total_rows", c("total_rows"), ""),
        ("summary", "cycle_count", c("cycle_count"), ""),
        ("summary", "observed_route_count", c("observed_route_count"), ""),
        ("summary", "min_captured_at", F.date_format("min_captured_at", summary_time), ""),
        ("summary", "max_captured_at", F.date_format("max_captured_at", summary_time), ""),
        *[("scope", name, F.lit(value), "") for name, value in (scope or {}).items()],
        ("duplicates", "duplicate_rows", c("duplicate_rows"), ""),
        ("duplicates", "duplicate_keys", c("duplicate_keys"), ""),
        ("duplicates", "duplicate_row_rate_pct", pct(c("duplicate_rows"), c("total_rows"), 4), ""),
        *nulls("null_core", CORE_FIELDS, "total_rows"),
    ])
    side = _metric_rows(_meta_totals(offers, meta), [
        *nulls("null_raw_meta", META_FIELDS, "rows_seen"),
        ("raw_meta", "rows_seen", c("rows_seen"), ""),
        ("raw_meta", "rows_with_raw_meta", c("rows_with_raw_meta"), ""),
        ("raw_meta", "raw_meta_coverage_pct", pct(c("rows_with_raw_meta"), c("rows_seen"), 4), ""),
        ("inventory", "reported_count", c("reported_count"), ""),
        ("inventory", "unknown_count", c("unknown_count"), ""),
        ("inventory", "reported_rate_pct", pct(c("reported_count"), c("rows_seen"), 4), ""),
        ("inventory", "unknown_rate_pct", pct(c("unknown_count"), c("rows_seen"), 4), ""),
    ])
    route = _metric_rows(dq_route_coverage(offers, routes), [
        ("route_coverage", "expected_route_count", c("expected_route_count"), "configured routes under the filters"),
        ("route_coverage", "observed_route_count", c("observed_route_count"), ""),
        ("route_coverage", "coverage_pct", c("coverage_pct"), ""),
        ("route_coverage", "missing_routes", c("missing_routes"), ""),
    ])
    return core.unionByName(side).unionByName(route)


_PIVOT_METRICS = ["total_rows", "cycle_count", "observed_route_count", "duplicate_row_rate_pct",
                  "raw_meta_coverage_pct", "seat_capacity_null_rate_pct"]


def dq_pivot(report: DataFrame) -> DataFrame:
    """Selected metrics of a quality report; the last value of a metric counts."""
    return report.where((F.col("metric").isin(_PIVOT_METRICS)) & (F.col("category") != "route_coverage")).select(
        "metric", "value")


# ---------------------------------------------------------------- risk


def risk_features(summary: DataFrame, availability: DataFrame, price: DataFrame) -> DataFrame:
    """Score every daily route summary from 0 to 100.

    Each event series is divided by its overall maximum. The maxima come from one aggregate read
    back as a scalar subquery, so no row set is gathered into one partition.
    """
    av = availability.select(*DAILY_KEY, "availability_change_events", "soldout_flag_changes", "row_added_events",
                             "row_removed_events", F.col("avg_abs_magnitude").alias("av_magnitude"))
    pr = price.select(*DAILY_KEY, "price_change_events", F.col("avg_abs_magnitude").alias("price_magnitude"),
                      "avg_abs_percent_change")
    return risk_from_rollups(summary.join(av, DAILY_KEY, "left").join(pr, DAILY_KEY, "left"))


def risk_from_rollups(rows: DataFrame) -> DataFrame:
    """Risk scores from the combined daily rollup, which needs no joins."""
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("soldout_flag_changes", "row_added_events",
                                                       "row_removed_events")]
    zero += [F.coalesce(c, F.lit(0.0)).alias(n) for c, n in (
        ("av_magnitude", "avg_abs_magnitude"), ("price_magnitude", "avg_abs_magnitude_price"),
        ("avg_abs_percent_change", "avg_abs_percent_change"))]
    rows = rows.select(
        *DAILY_KEY, "total_change_events", "flights_affected", "price_events", "availability_events",
        "added_events", "removed_events", "changed_events",
        F.coalesce("availability_change_events", "availability_events").alias("availability_change_events"),
        F.coalesce("price_change_events", "price_events").alias("price_change_events"),
        *zero,
        F.trim(F.concat_ws(" ", "airline", route_key(), "cabin")).alias("route_label"),
        (F.col("added_events") + F.col("removed_events")).alias("net_structure_events"),
    )
    weights = {"total_change_events": 0.35, "availability_change_events": 0.30, "price_change_events": 0.20,
               "net_structure_events": 0.10, "flights_affected": 0.05}
    tops = rows.agg(F.struct(*[F.max(c).alias(c) for c in weights])).scalar()
    scored = F.lit(0.0)
    for name, weight in weights.items():
        scored = scored + F.coalesce(ratio(F.col(name), F.nullif(tops[name], F.lit(0))), F.lit(0.0)) * weight
    boost = F.when(F.col("soldout_flag_changes") > 0, 15.0).otherwise(0.0)
    flag = {"SOLDOUT": "soldout_flag_changes", "AVAIL": "availability_change_events",
            "PRICE": "price_change_events", "STRUCT": "net_structure_events"}
    flags = F.concat_ws(", ", *[F.when(F.col(c) > 0, n) for n, c in flag.items()])
    return rows.withColumn("risk_score", half_even(clip(scored * 100.0 + boost, 0, 100), 1)).withColumns({
        "risk_level": F.when(F.col("risk_score") >= 70, "HIGH").when(F.col("risk_score") >= 40, "MEDIUM")
        .otherwise("LOW"),
        "risk_flags": F.when(flags == "", "MONITOR").otherwise(flags),
    })


_TIES = ["route_label", "report_day"]


def action_queue(risk: DataFrame, n: int | None = None) -> DataFrame:
    """The routes to look at first, with what to do."""
    order = [F.col(c).desc() for c in ("risk_score", "total_change_events", "availability_change_events",
                                       "price_change_events")]
    # Fixed texts.
    action = (
        F.when(F.col("soldout_flag_changes") > 0, "Check inventory controls and soldout transitions immediately.")
        .when(F.col("availability_change_events") > F.col("price_change_events"),
              "Validate seat/inventory updates and route capacity assumptions.")
        .when(F.col("price_change_events") > 0, "Review fare ladder, competitor pressure, and pricing rules.")
        .otherwise("Monitor next scrape cycle for persistence.")
    )
    return top(risk, n, *order, *_TIES).select(
        "report_day", "risk_level", "risk_score", "risk_flags", "route_label", "total_change_events",
        "availability_change_events", "price_change_events", "flights_affected", "soldout_flag_changes",
        action.alias("recommended_action"),
    )


def airline_risk(risk: DataFrame) -> DataFrame:
    return risk.groupBy("airline").agg(
        F.countDistinct("route_label").alias("routes"),
        F.countDistinct("cabin").alias("cabins"),
        F.sum("total_change_events").alias("total_change_events"),
        F.sum("availability_change_events").alias("availability_change_events"),
        F.sum("price_change_events").alias("price_change_events"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high_risk_routes"),
        F.count_if(F.col("risk_level") == "MEDIUM").alias("medium_risk_routes"),
        half_even(F.avg("risk_score"), 1).alias("avg_risk_score"),
        half_even(F.max("risk_score"), 1).alias("max_risk_score"),
    ).orderBy(F.col("total_change_events").desc(), F.col("max_risk_score").desc(), "airline")


def airline_sections(risk: DataFrame, n: int) -> DataFrame:
    """Top rows per carrier; the group limit is applied before the shuffle."""
    order = [F.col("risk_score").desc(), F.col("total_change_events").desc(), *[F.col(c) for c in _TIES]]
    return first_rows(risk, ["airline"], order, n, rank_name="rank_in_airline").select(
        "airline", "rank_in_airline", "report_day", "risk_level", "risk_score", "route_label", "total_change_events",
        "availability_change_events", "price_change_events", "flights_affected", "risk_flags")


def route_airline_pivot(risk: DataFrame, airlines: Sequence[str] | None = None, n: int | None = None) -> DataFrame:
    """Events per route label and carrier, and the total over all carriers; without a list, a column for every carrier in the data."""
    events = F.col("total_change_events")
    if airlines is None:
        # One narrow row per carrier.
        airlines = sorted(r[0] for r in risk.where("airline IS NOT NULL").select("airline").distinct().collect())
    pivoted = risk.groupBy("route_label").agg(
        *[F.coalesce(F.sum(F.when(F.col("airline") == a, events)), F.lit(0)).alias(a) for a in airlines],
        F.coalesce(F.sum(events), F.lit(0)).alias("all_airlines_total"))
    return top(pivoted, n, F.col("all_airlines_total").desc(), "route_label")


def top_risk(risk: DataFrame, n: int) -> DataFrame:
    order = [F.col("risk_score").desc(), F.col("total_change_events").desc(), *[F.col(c) for c in _TIES]]
    return top(risk, n, *order)


def top_availability(risk: DataFrame, n: int) -> DataFrame:
    order = [F.col("availability_change_events").desc(), F.col("risk_score").desc(), *[F.col(c) for c in _TIES]]
    return top(risk, n, *order)


def executive_kpis(risk: DataFrame, summary: DataFrame, price: DataFrame, availability: DataFrame,
                   coverage: DataFrame, generated_at: str, filters: str, queue_size: int = 40) -> DataFrame:
    """Twelve rows of (kpi, value, notes), values as text."""
    label = F.concat_ws(" ", "airline", route_key(), "cabin")
    totals = summary.agg(F.sum("total_change_events"), F.sum("flights_affected")).toDF("events", "flights")
    best = top_risk(risk, 1).agg(F.max(label)).scalar()
    best_av = top_availability(risk, 1).agg(F.max(label)).scalar()
    levels = risk.agg(F.struct(
        F.count_if(F.col("risk_level") == "HIGH").alias("high"),
        F.count_if(F.col("risk_level") == "MEDIUM").alias("medium"),
        F.least(F.count("*"), F.lit(queue_size)).alias("queue"),
    )).scalar()

    def count_of(df: DataFrame, name: str) -> Column:
        return df.agg(F.coalesce(F.sum(name), F.lit(0))).scalar()

    rows = [
        ("generated_at_utc", F.lit(generated_at), ""),
        ("filters", F.lit(filters), ""),
        ("total_change_events", F.coalesce("events", F.lit(0)), "route_airline_summary aggregate"),
        ("total_flights_affected", F.coalesce("flights", F.lit(0)), "route_airline_summary aggregate"),
        ("total_price_change_events", count_of(price, "price_change_events"), "price_changes_daily aggregate"),
        ("total_availability_change_events", count_of(availability, "availability_change_events"),
         "availability_changes_daily aggregate"),
        ("top_route_by_change_events", F.coalesce(best, F.lit("")), ""),
        ("top_route_by_availability_changes", F.coalesce(best_av, F.lit("")), ""),
        ("high_risk_routes", levels["high"], "risk_score >= 70"),
        ("medium_risk_routes", levels["medium"], "40 <= risk_score < 70"),
        ("action_queue_items", levels["queue"], "prioritized review list"),
        ("raw_meta_coverage_pct", coverage.select("raw_meta_coverage_pct").scalar(),
         "from data_quality_report; null means unavailable"),
    ]
    items = [F.struct(F.lit(k).alias("kpi"), v.cast("string").alias("value"), F.lit(n).alias("notes"))
             for k, v, n in rows]
    return totals.select(F.inline(F.array(*items)))


def dashboard_metrics(summary: DataFrame, price: DataFrame, availability: DataFrame, report: DataFrame,
                      generated_at: str, filters: str) -> DataFrame:
    """Ten rows of (metric, value), values as text."""
    totals = summary.agg(
        F.coalesce(F.sum("total_change_events"), F.lit(0)).alias("events"),
        F.coalesce(F.sum("flights_affected"), F.lit(0)).alias("flights"), F.count("*").alias("rows"))
    price_row = price.agg(F.struct(F.coalesce(F.sum("price_change_events"), F.lit(0)).alias("events"),
                                   F.count("*").alias("rows"))).scalar()
    av_row = availability.agg(F.struct(F.coalesce(F.sum("availability_change_events"), F.lit(0)).alias("events"),
                                       F.count("*").alias("rows"))).scalar()
    rows = [
        ("generated_at_utc", F.lit(generated_at)), ("filters", F.lit(filters)),
        ("total_change_events", F.col("events")), ("total_flights_affected", F.col("flights")),
        ("total_price_change_events", price_row["events"]),
        ("total_availability_change_events", av_row["events"]),
        ("rows_price_changes_daily", price_row["rows"]),
        ("rows_availability_changes_daily", av_row["rows"]),
        ("rows_route_airline_summary", F.col("rows")),
        ("rows_data_quality_report", report.agg(F.count("*")).scalar()),
    ]
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("metric"), v.cast("string").alias("value")) for k, v in rows])))


# ---------------------------------------------------------------- service levels and logs

# Fixed log texts: words that mark a failure and phrases that are only noise.
FAIL_KEYWORDS = ["traceback", "exception", "module not found", "failed", "error"]
NOISE_PHRASES = ["no rows for", "no rows to write"]


def run_success(logs: DataFrame, since: datetime) -> DataFrame:
    """Finished runs and successful ones from the log lines since a time. One row."""
    code = F.regexp_extract("message", r"finished with rc=(\d+)", 1)
    runs = logs.where((F.col("ts") >= F.lit(since)) & (code != ""))
    total, good = F.count("*"), F.count_if(code == "0")
    return runs.agg(total.alias("total_runs"), good.alias("success_runs"),
                    F.coalesce(pct(good, total, 2), F.lit(100.0)).alias("success_pct"))


def sla(offers: DataFrame, meta: DataFrame, routes: DataFrame, logs: DataFrame, as_of: datetime, since: datetime,
        min_coverage: float = 80.0, max_null_rate: float = 10.0, min_success: float = 85.0,
        max_lag_hours: float = 8.0) -> DataFrame:
    """Four service-level checks with the overall status: one failed is WARN, more are FAIL."""
    recent = offers.where(F.col("captured_at") >= F.lit(since))
    required = ["adt_count", "chd_count", "inf_count", "inventory_confidence", "source_endpoint", "departure_utc"]
    rows = _with_newest_meta(recent, meta, required)
    coverage = dq_route_coverage(recent, routes).select(
        F.coalesce(F.round("coverage_pct", 2), F.lit(100.0))).scalar()
    incomplete = any_of([F.col(c).isNull() for c in required])
    null_rate = rows.agg(F.coalesce(pct(F.count_if(incomplete), F.count("*"), 4), F.lit(0.0))).scalar()
    lag_seconds = F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp(F.max("captured_at"))
    base = offers.agg(F.coalesce(F.round(lag_seconds / 3600.0, 2), F.lit(9999.0)).alias("lag"))
    success = run_success(logs, since).select("success_pct").scalar()
    checks = base.select(F.array(*[
        F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), F.lit(f"{sign} {limit}").alias("threshold"),
                 (value >= limit if sign == ">=" else value <= limit).alias("ok"))
        for name, value, sign, limit in (
            ("route_coverage_pct", coverage, ">=", min_coverage),
            ("mandatory_null_rate_pct", null_rate, "<=", max_null_rate),
            ("accumulation_success_pct", success, ">=", min_success),
            ("freshness_lag_hours", F.col("lag"), "<=", max_lag_hours),
        )
    ]).alias("checks"))
    failed = F.size(F.filter("checks", lambda c: ~c["ok"]))
    status = F.when(failed == 0, "PASS").when(failed == 1, "WARN").otherwise("FAIL")
    return checks.select(status.alias("overall_status"), F.inline("checks"))


def _failure_hit() -> Column:
    text = F.lower("message")
    return any_of([text.contains(k) for k in FAIL_KEYWORDS]) & ~any_of([text.contains(p) for p in NOISE_PHRASES])


def log_health(logs: DataFrame, since: datetime) -> DataFrame:
    """Status of a log window: a failed run is FAIL, failure words are WARN. One row."""
    text = F.lower("message")
    finished = text.contains("pipeline finished rc=")
    bad_run = finished & ~text.contains("rc=0")
    hits, bad = F.count_if(_failure_hit()), F.count_if(bad_run)
    return logs.where(F.col("ts") >= F.lit(since)).agg(
        F.when(bad > 0, "FAIL").when(hits > 0, "WARN").otherwise("PASS").alias("status"),
        F.count("*").alias("events_in_window"),
        F.min("ts").alias("earliest_ts"),
        F.max("ts").alias("latest_ts"),
        F.count_if(finished).alias("scheduler_runs"),
        bad.alias("failed_runs"),
        F.count_if(text.contains("done. total rows:") | text.contains("saved csv:")).alias("row_emit_signals"),
        hits.alias("failure_hit_count"),
    )


def log_counts(logs: DataFrame, since: datetime) -> DataFrame:
    """Lines per level and per file."""
    rows = logs.where(F.col("ts") >= F.lit(since)).select(F.inline(F.array(
        F.struct(F.lit("level").alias("kind"), F.col("level").alias("name")),
        F.struct(F.lit("file").alias("kind"), F.col("file").alias("name")),
    )))
    return rows.groupBy("kind", "name").agg(F.count("*").alias("lines"))


def failure_hits(logs: DataFrame, since: datetime, n: int | None = None) -> DataFrame:
    """Failure lines; with ``n`` the first in file and time order."""
    rows = logs.where((F.col("ts") >= F.lit(since)) & _failure_hit())
    return top(rows, n, "file", "ts", "logger", "message")


def timezone_audit(offers: DataFrame, meta: DataFrame, offsets: DataFrame) -> DataFrame:
    """Rows per airport and role with missing UTC times, and whether its offset is configured."""
    side = latest_meta(meta.select("offer_id", "meta_id", "departure_utc", "arrival_utc"))
    rows = offers.select("offer_id", "airline", "origin", "destination").join(side, "offer_id", "left")
    roles = rows.select("airline", F.inline(F.array(
        F.struct(F.lit("origin").alias("airport_role"), F.upper("origin").alias("airport"),
                 F.col("departure_utc").isNull().alias("utc_missing")),
        F.struct(F.lit("destination").alias("airport_role"), F.upper("destination").alias("airport"),
                 F.col("arrival_utc").isNull().alias("utc_missing")),
    )))
    counts = roles.groupBy("airport_role", "airport").agg(
        F.count("*").alias("rows_total"), F.count_if("utc_missing").alias("utc_null_rows"),
        F.countDistinct("airline").alias("airlines_seen"))
    known = offsets.select(F.upper("airport").alias("airport"), F.lit(True).alias("has_offset")).distinct()
    return counts.join(known, "airport", "left").withColumn("has_offset", F.coalesce("has_offset", F.lit(False)))


def daily_volume(meta: DataFrame, since: datetime) -> DataFrame:
    return meta.where(F.col("captured_at") >= F.lit(since)).groupBy(F.to_date("captured_at").alias("day")).agg(
        F.count("*").alias("row_count")).orderBy(F.col("day").desc())


def row_sizes(meta: DataFrame, newest: int | None = None) -> DataFrame:
    """Mean and percentile row size over all rows, or the newest. Spark counts equal sizes, so percentiles stay small."""
    size = F.length(F.to_json(F.struct(*meta.columns))).alias("bytes")
    return top(meta, newest, F.col("meta_id").desc()).select(size).agg(
        F.avg("bytes").alias("avg_row_bytes"), F.percentile("bytes", 0.5).alias("p50_row_bytes"),
        F.percentile("bytes", 0.9).alias("p90_row_bytes"))


def store_reuse(store: DataFrame) -> DataFrame:
    """How often stored payloads repeat. One row."""
    n, seen = F.count("*"), F.coalesce(F.sum("seen_count"), F.lit(0))
    return store.agg(n.alias("row_count"), seen.alias("seen_total"), ratio(seen, n).alias("seen_per_payload"))


def runtime_by_airline(query_log: DataFrame) -> DataFrame:
    return query_log.groupBy("airline").agg(
        F.count("*").alias("count"), numeric_round(F.avg("elapsed_sec"), 4).alias("avg_sec"),
        numeric_round(F.max("elapsed_sec"), 4).alias("max_sec"))


def slowest_routes(query_log: DataFrame, n: int) -> DataFrame:
    route = F.concat("airline", F.lit(":"), route_key(), F.lit(":"), "cabin")
    return query_log.groupBy(route.alias("route")).agg(
        F.count("*").alias("count"), numeric_round(F.avg("elapsed_sec"), 4).alias("avg_sec"),
        numeric_round(F.max("elapsed_sec"), 4).alias("max_sec"),
    ).orderBy(F.col("avg_sec").desc(), "route").limit(n)


def best_models(evals: DataFrame) -> DataFrame:
    """Model with the lowest MAE per target."""
    best = first_rows(evals.where("mae is not null"), ["target"], [F.col("mae").asc(), F.col("model").asc()])
    return best.select("target", F.col("model").alias("best_model_by_mae"), "n", "mae", "rmse", "smape_pct",
                       "directional_accuracy_pct", "f1_macro")


def backtest_summary(backtests: DataFrame) -> DataFrame:
    """Mean test metrics per target, of the selected model where there is one."""
    test = backtests.where(F.lower("dataset") == "test")
    metrics = ["mae", "rmse", "smape_pct", "directional_accuracy_pct", "f1_macro"]
    chosen = F.col("selected_on_val")
    any_chosen = F.count_if(chosen) > 0

    def mean(name: str) -> Column:
        return F.when(any_chosen, F.avg(F.when(chosen, F.col(name)))).otherwise(F.avg(name)).alias(f"mean_{name}")

    rows = F.when(any_chosen, F.count_if(chosen)).otherwise(F.count("*")).alias("rows_used")
    return test.groupBy("target").agg(rows, *[mean(m) for m in metrics])


