"""Market intelligence: daily snapshots, competition, trends, regimes, signals and priors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farescope.functions import COMPARE_KEY, SERIES_KEY, ewm_last, half_even, ratio, route_key
from farescope.operators.reporting import with_countries
from farescope.sources import latest_meta

_MARKET = ["origin", "destination", "cabin"]


def daily_snapshot(offers: DataFrame, meta: DataFrame, as_of: datetime | None = None, days: int = 30) -> DataFrame:
    """Lowest price, seats and sold-out share per series and capture day."""
    if as_of is not None:
        offers = offers.where(F.col("captured_at") >= F.lit(as_of - timedelta(days=max(1, days))))
    rows = offers.join(latest_meta(meta.select("offer_id", "meta_id", "soldout")), "offer_id", "left")
    out = rows.groupBy(F.to_date("captured_at").alias("report_day"), *SERIES_KEY).agg(
        F.min("price_total").alias("min_price_bdt"),
        F.avg("seat_available").alias("avg_seat_available"),
        F.count("*").alias("offers_count"),
        F.count_if(F.coalesce("soldout", F.lit(False))).alias("soldout_offers"),
    )
    return out.withColumn("soldout_rate", ratio(F.col("soldout_offers"), F.col("offers_count")))


def competitive(daily: DataFrame) -> DataFrame:
    """Position of every carrier on its routes: days leading, gap to the others, dense ranks.

    The windows run over rows that are already one per carrier, route, cabin and day.
    """
    price = F.col("min_price_bdt").cast("double")
    day = Window.partitionBy("report_day", *_MARKET)
    others = F.try_divide(F.sum(price).over(day) - price, F.nullif(F.count(price).over(day) - 1, F.lit(0)))
    rows = daily.withColumns({
        "price": price,
        "leads": (price == F.min(price).over(day)).cast("int"),
        "gap": price - others,
    })
    out = rows.groupBy(*SERIES_KEY).agg(
        F.countDistinct("report_day").alias("days_observed"),
        F.sum(F.coalesce("leads", F.lit(0))).alias("days_leading"),
        F.avg("price").alias("avg_min_price_bdt"),
        F.coalesce(F.stddev_samp("price"), F.lit(0.0)).alias("price_volatility_bdt"),
        F.avg("avg_seat_available").alias("avg_seat_available"),
        F.avg("soldout_rate").alias("avg_soldout_rate"),
        F.avg("offers_count").alias("avg_offers_count"),
        F.avg("gap").alias("avg_gap_vs_competitor_bdt"),
    )
    share = ratio(F.col("days_leading"), F.col("days_observed")) * 100.0
    market = Window.partitionBy(*_MARKET)

    def rank(value: Column, order: Column) -> Column:
        return F.when(value.isNotNull(), F.dense_rank().over(market.orderBy(order)))

    out = out.withColumn("lowest_fare_share_pct", share)
    return out.withColumns({
        "leadership_rank": rank(F.col("lowest_fare_share_pct"), F.col("lowest_fare_share_pct").desc_nulls_last()),
        "price_rank": rank(F.col("avg_min_price_bdt"), F.col("avg_min_price_bdt").asc_nulls_last()),
    })


def route_competition(daily: DataFrame) -> DataFrame:
    price = F.col("min_price_bdt").cast("double")
    out = daily.groupBy(*_MARKET).agg(
        F.countDistinct("report_day").alias("observed_days"),
        F.countDistinct("airline").alias("airlines_active"),
        F.avg(price).alias("route_avg_lowest_fare_bdt"),
        F.coalesce(F.stddev_samp(price), F.lit(0.0)).alias("route_price_volatility_bdt"),
        F.avg("soldout_rate").alias("route_avg_soldout_rate"),
        F.avg("offers_count").alias("route_avg_offers_count"),
    )
    soldout = F.coalesce("route_avg_soldout_rate", F.lit(0.0))
    return out.withColumn("competition_index", F.col("airlines_active") * 10.0 + (100.0 - soldout * 100.0) * 0.2)


def short_forecast(daily: DataFrame, target: str, min_history: int = 3, window: int = 3, alpha: float = 0.3) -> DataFrame:
    """Simple next-day levels per series with a 10 to 90 % band of recent days.

    A series has one value per day, so its ordered array stays small.
    """
    alpha, window = max(0.0001, min(alpha, 1.0)), max(window, 1)
    value = F.col(target).cast("double")
    recency = F.row_number().over(Window.partitionBy(*SERIES_KEY).orderBy(F.col("report_day").desc()))
    present = daily.select("report_day", *SERIES_KEY, value.alias("y"))
    last_day = present.groupBy(*SERIES_KEY).agg(F.max("report_day").alias("latest_report_day"))
    ranked = present.where("y is not null").withColumn("back", recency)
    recent = F.when(F.col("back") <= max(7, window), F.col("y"))
    out = ranked.groupBy(*SERIES_KEY).agg(
        F.count("*").alias("history_days"),
        F.max(F.when(F.col("back") == 1, F.col("y"))).alias("pred_last_value"),
        F.avg(F.when(F.col("back") <= window, F.col("y"))).alias("pred_rolling_mean"),
        F.transform(F.array_sort(F.collect_list(F.struct("report_day", "y"))), lambda s: s["y"]).alias("series"),
        F.percentile(recent, F.lit(0.1)).alias("p10_baseline"),
        F.percentile(recent, F.lit(0.9)).alias("p90_baseline"),
    ).where(F.col("history_days") >= max(min_history, 2))
    move = F.col("pred_rolling_mean") - F.col("pred_last_value")
    return out.join(last_day, SERIES_KEY).select(
        *SERIES_KEY, F.lit(target).alias("target_column"), "latest_report_day",
        F.date_add("latest_report_day", 1).alias("predicted_for_day"), "history_days",
        F.col("pred_last_value").alias("latest_actual_value"), "pred_last_value", "pred_rolling_mean",
        ewm_last(F.col("series"), alpha).alias("pred_ewm"), "p10_baseline", "p90_baseline",
        F.when(move > 0, "UP").when(move < 0, "DOWN").otherwise("FLAT").alias("expected_direction"),
    )


def ranked_history(offers: DataFrame, cycles: DataFrame) -> DataFrame:
    """Offers of the listed cycles with ``scrape_rank`` 1 for the newest.

    ``cycles`` has cycle_id and position (oldest first), one row per listed cycle.
    """
    last = cycles.agg(F.max("position")).scalar()
    ranks = cycles.select("cycle_id", (last - F.col("position") + 1).alias("scrape_rank"))
    return offers.join(ranks, "cycle_id")


def trend(history: DataFrame, order_col: str = "captured_at") -> DataFrame:
    """First-to-last move and volatility of price and seats per offer identity."""
    keyed = history.dropna(subset=COMPARE_KEY)
    order = F.struct(order_col, "offer_id")
    price, seats = F.col("price_total").cast("double"), F.col("seat_available").cast("double")

    def move(value: Column) -> Column:
        return F.max_by(value, order) - F.min_by(value, order)

    return keyed.groupBy(*COMPARE_KEY).agg(
        move(price).alias("price_trend"), move(seats).alias("seat_trend"),
        F.stddev_samp(price).alias("price_volatility"), F.stddev_samp(seats).alias("seat_volatility"),
    )


def route_intelligence(rows: DataFrame) -> DataFrame:
    """Route view over per-offer trends with ``seat_pressure_index`` and ``is_price_leader``."""
    out = rows.groupBy("origin", "destination").agg(
        F.countDistinct("flight_number").alias("flight_count"),
        F.sum(F.col("is_price_leader").cast("int")).alias("leader_count"),
        F.avg("price_trend").alias("avg_price_trend"),
        F.avg("price_volatility").alias("avg_price_volatility"),
        F.avg("seat_pressure_index").alias("avg_seat_pressure"),
    )
    return out.withColumns({
        "leader_concentration": ratio(F.col("leader_count"), F.col("flight_count")),
        "route_pressure_score": F.abs("avg_seat_pressure") * (1 + F.col("avg_price_volatility")),
    })


def route_regime(routes: DataFrame) -> DataFrame:
    c = F.col
    regime = (
        F.when((c("leader_concentration") > 0.8) & (c("avg_seat_pressure") > 0.7), "DOMINANT_SUPPLY_CONTROL")
        .when((c("avg_price_trend") < 0) & (c("avg_price_volatility") > 0.4), "PRICE_WAR")
        .when((c("avg_seat_pressure") < 0.4) & (c("avg_price_trend") < 0), "CAPACITY_EXPANSION")
        .otherwise("NORMAL")
    )
    return routes.withColumn("route_regime", regime)


# ---------------------------------------------------------------- signals


def strategy_signals(events: DataFrame, confidence_scale: float = 0.15) -> DataFrame:
    """Signals of price increases and seat decreases.

    The confidence divides an absolute amount by a small scale, so it is almost always 1.
    """
    size = F.abs(F.coalesce("magnitude", F.lit(0.0)))
    price_up = (F.col("domain") == "price") & (F.col("change_type") == "increase")
    seats_down = (F.col("domain") == "seat") & (F.col("change_type") == "decrease")
    key = F.concat_ws("-", "airline", "flight_number", F.date_format("departure", "yyyy-MM-dd'T'HH:mm:ss"))
    return events.where(price_up | seats_down).select(
        "airline",
        key.alias("flight_key"),
        F.when(price_up, "PRICE_ACTION").otherwise("CAPACITY_ACTION").alias("signal_category"),
        F.when(price_up, "PRICE_INCREASE").otherwise("INVENTORY_TIGHTENING").alias("signal_type"),
        F.when(price_up, F.least(F.lit(1.0), size / confidence_scale)).otherwise(F.lit(0.8)).alias("confidence"),
        size.alias("severity"),
        F.array().cast("array<bigint>").alias("supporting_change_ids"),
        F.struct("from_timestamp", "to_timestamp").alias("context"),
        F.col("detected_at"),
    )


def signal_measures() -> list[Column]:
    """Aggregates of one flight's signals, shared by the batch and the streaming form."""
    price = F.col("signal_category") == "PRICE_ACTION"
    capacity = F.col("signal_category") == "CAPACITY_ACTION"
    tight = capacity & (F.col("signal_type") == "INVENTORY_TIGHTENING")
    return [
        F.count_if(price).alias("pricing_event_count"),
        F.coalesce(F.sum(F.when(price, F.col("severity"))), F.lit(0.0)).alias("net_price_delta"),
        F.count_if(capacity).alias("capacity_event_count"),
        F.coalesce(F.sum(F.when(tight, F.col("severity"))), F.lit(0.0)).alias("tightening_score"),
        F.avg("confidence").alias("mean_confidence"),
    ]


def signal_labels(measures: DataFrame) -> DataFrame:
    delta, tight, mean = F.col("net_price_delta"), F.col("tightening_score"), F.col("mean_confidence")
    return measures.withColumns({
        "price_trend": F.when(delta > 0, "UP").when(delta < 0, "DOWN").otherwise("FLAT"),
        "capacity_trend": F.when(tight > 0, "TIGHTENING").otherwise("STABLE"),
        "confidence": half_even(mean, 2),
        "demand_signal": F.when(mean > 0.7, "SURGE").otherwise("NEUTRAL"),
    })


def aggregate_signals(signals: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Signals per flight over the trailing window."""
    since = as_of - timedelta(hours=hours)
    rows = signals.where((F.col("detected_at") >= F.lit(since)) & (F.col("detected_at") <= F.lit(as_of)))
    return signal_labels(rows.groupBy("airline", "flight_key").agg(*signal_measures()))


def market_regime(snapshots: DataFrame) -> DataFrame:
    trend_, delta = F.col("price_trend"), F.col("net_price_delta")
    tight, confidence = F.col("tightening_score"), F.col("confidence")
    regime = (
        F.when((trend_ == "UP") & (tight > 0) & (confidence > 0.7), "DEMAND_SURGE")
        .when((trend_ == "DOWN") & (tight <= 0) & (confidence < 0.4), "DEMAND_SOFT")
        .when((trend_ == "FLAT") & (tight > 0), "YIELD_PROTECTION")
        .when((F.abs(delta) > 0) & (tight == 0), "MARKET_TESTING")
        .when((trend_ == "FLAT") & (tight == 0), "STABLE")
        .otherwise("UNKNOWN")
    )
    return snapshots.withColumn("market_regime", regime)


# Fixed alert texts.
_ALERTS = [
    ("DEMAND_SURGE", "CRITICAL", "Strong demand surge detected with price increase and seat tightening."),
    ("YIELD_PROTECTION", "HIGH", "Yield protection behavior detected (inventory tightening without price change)."),
    ("PRICE_DROP", "MEDIUM", "Price drop detected under weak demand conditions."),
    ("MARKET_TESTING", "LOW", "Airline appears to be testing price elasticity."),
]


def alerts(regimes: DataFrame) -> DataFrame:
    """One row per alert that applies to a flight."""
    when = {name: F.col("market_regime") == name for name, _, _ in _ALERTS}
    when["PRICE_DROP"] = (F.col("net_price_delta") < 0) & (F.col("confidence") < 0.4)
    items = [F.when(when[t], F.struct(F.lit(t).alias("alert_type"), F.lit(s).alias("severity"),
                                      F.lit(m).alias("message"))) for t, s, m in _ALERTS]
    return regimes.select("airline", "flight_key", "market_regime", F.inline(F.array_compact(F.array(*items))))


# ---------------------------------------------------------------- priors


@dataclass
class MarketPriors:
    """Code lists that describe a market. The defaults are fixed values."""

    labor_origins: Sequence[str] = ("BD", "IN", "PK", "NP")
    middle_east: Sequence[str] = ("SA", "AE", "QA", "OM", "KW", "BH")
    ksa_airports: Sequence[str] = ("JED", "RUH", "MED", "DMM")
    thailand_airports: Sequence[str] = ("BKK", "DMK", "HKT", "CNX", "KBV")
    hub_spoke_airlines: Sequence[str] = ("SQ", "EK", "QR", "MH", "TG", "WY", "SV", "UL", "CZ")
    lcc_airlines: Sequence[str] = ("6E", "G9", "3L", "8D", "FZ", "AK", "OD", "BS", "2A", "VQ", "F8")
    return_oriented_airlines: Sequence[str] = ("BG", "BS")
    yield_high: Sequence[str] = ()
    yield_tourism: Sequence[str] = ()
    yield_balanced: Sequence[str] = ()
    visa_max_days: int = 7
    short_max_days: int = 30
    mid_max_days: int = 90
    long_max_days: int = 180



def apply_market_priors(df: DataFrame, priors: MarketPriors, airports: DataFrame,
                        days_col: str = "days_to_departure") -> DataFrame:
    """Add country codes, eight market flags and the proxy classes of a route."""
    joined = with_countries(df, airports)
    origin_country, to_country = F.coalesce("__from", F.lit("UNK")), F.coalesce("__to", F.lit("UNK"))
    origin, destination = F.upper(F.trim("origin")), F.upper(F.trim("destination"))
    airline = F.upper(F.trim("airline"))
    route = F.upper(F.trim("route_key")) if "route_key" in df.columns else route_key(origin, destination)

    def member(value: Column, codes: Sequence[str]) -> Column:
        return F.coalesce(value.isin([c.strip().upper() for c in codes]), F.lit(False)) if codes else F.lit(False)

    east_from, east_to = member(origin_country, priors.middle_east), member(to_country, priors.middle_east)
    east = east_from | east_to
    ksa = member(origin, priors.ksa_airports) | member(destination, priors.ksa_airports)
    thai = member(origin, priors.thailand_airports) | member(destination, priors.thailand_airports)
    out_labor = member(origin_country, priors.labor_origins) & east_to
    back_labor = east_from & member(to_country, priors.labor_origins)
    hub, lcc = member(airline, priors.hub_spoke_airlines), member(airline, priors.lcc_airlines)
    dtd = F.col(days_col).cast("double") if days_col in df.columns else F.lit(None).cast("double")
    keep = [F.col(c) for c in df.columns if c != "route_key"]
    return joined.select(
        *keep,
        route.alias("route_key"),
        origin_country.alias("origin_country"),
        to_country.alias("destination_country"),
        *[c.cast("int").alias(n) for n, c in (
            ("market_is_middle_east", east), ("market_is_ksa", ksa), ("market_is_thailand_tourism", thai),
            ("market_is_labor_outbound", out_labor), ("market_is_labor_return", back_labor),
            ("airline_is_hub_spoke", hub), ("airline_is_lcc", lcc),
            ("airline_is_return_oriented", member(airline, priors.return_oriented_airlines)))],
        F.when(lcc, "lcc").when(hub, "hub_spoke").otherwise("hybrid").alias("airline_model_proxy"),
        F.when(back_labor, "labor_return").when(out_labor, "labor_outbound").when(thai, "tourism")
        .otherwise("general").alias("trip_purpose_proxy"),
        F.when(member(route, priors.yield_balanced), "balanced")
        .when(member(route, priors.yield_tourism), "tourism")
        .when(member(route, priors.yield_high), "high")
        .when(ksa, "high").when(east, "medium_high").otherwise("unknown").alias("yield_class_proxy"),
        F.coalesce(dtd <= priors.visa_max_days, F.lit(False)).cast("int").alias("horizon_is_visa_window"),
        F.coalesce(dtd >= priors.mid_max_days, F.lit(False)).cast("int").alias("horizon_is_long_window"),
        F.when(dtd.isNull(), "unknown").when(dtd <= priors.visa_max_days, "D0_visa")
        .when(dtd <= priors.short_max_days, "D8_30").when(dtd <= priors.mid_max_days, "D31_90")
        .when(dtd <= priors.long_max_days, "D91_180").otherwise("D181p").alias("horizon_bucket_proxy"),
    )


