"""Inventory states of flights: fare buckets, next-search labels, party-size probes and features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farescope.functions import blank_to_null, clip, exact_medians, first_rows, half_even, near_share, ratio, route_key

STATE_KEY = ["cycle_id", "probe_group_id", "captured_at", "airline", "origin", "destination", "route_key", "flight_number",
             "departure", "departure_date", "cabin", "adt_count", "chd_count", "inf_count"]
FLIGHT_KEY = ["airline", "origin", "destination", "flight_number", "departure", "cabin", "adt_count", "chd_count",
              "inf_count"]
PROBE_KEY = ["probe_join_id", "airline", "origin", "destination", "flight_number", "departure", "cabin", "chd_count",
             "inf_count"]
MARKET_KEY = ["airline", "origin", "destination", "cabin"]

# Fixed meaning of seat counts per carrier: mode and the highest count a bucket shows.
SEAT_SEMANTICS: Mapping[str, tuple[str, int | None]] = {
    "VQ": ("non_additive", 9),
    "BG": ("unknown", None),
    "BS": ("unknown", None),
    "2A": ("unknown", None),
}


def prepare_rows(joined: DataFrame) -> DataFrame:
    """Clean joined offer and side-car rows and add the bucket code and calendar columns."""
    bucket = F.coalesce(*[blank_to_null(F.col(c)) for c in ("fare_basis", "booking_class", "brand")], F.lit("UNK"))
    casts = {c: F.col(c).cast("double") for c in ("price_total", "tax_amount")}
    casts.update({c: F.col(c).try_cast("int") for c in ("seat_capacity", "seat_available", "duration_min", "adt_count",
                                                         "chd_count", "inf_count")})
    return joined.withColumns({
        **casts,
        "airline": F.upper("airline"), "origin": F.upper("origin"), "destination": F.upper("destination"),
        "soldout": F.coalesce(F.col("soldout"), F.lit(False)),
    }).withColumns({"bucket_code": bucket, **_derived(), **_calendar()})


def _derived() -> dict[str, Column]:
    """Parts of the state key that follow from others."""
    return {"route_key": route_key(), "departure_date": F.to_date("departure")}


def _calendar() -> dict[str, Column]:
    hours = (F.unix_timestamp("departure") - F.unix_timestamp("captured_at")) / 3600.0
    return {"dep_weekday": F.weekday("departure"), "dep_month": F.month("departure"),
            "dep_time_min": F.hour("departure") * 60 + F.minute("departure"), "search_hour": F.hour("captured_at"),
            "days_to_departure": F.floor(hours / 24.0).cast("int"), "hours_to_departure": hours}


def _semantics(table: Mapping[str, tuple[str, int | None]]) -> tuple[Column, Column]:
    mode = F.create_map(*[F.lit(x) for k, (m, _) in table.items() for x in (k, m)])
    caps = {k: c for k, (_, c) in table.items() if c}
    cap = F.try_element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("airline")) if caps else F.lit(
        None).cast("int")
    return F.coalesce(F.try_element_at(mode, F.col("airline")), F.lit("unknown")), cap


def inventory_states(prepared: DataFrame, semantics: Mapping[str, tuple[str, int | None]] = SEAT_SEMANTICS) -> DataFrame:
    """One row per flight, capture and party: its fare ladder, seats, censoring and pressure.

    Prepared offers are shuffled once, to their states, as they are: half-made aggregates of a bucket are wider than the few
    rows they stand for. What follows from the key is left out and added again there. Then they are reduced to one row per
    bucket, so a state holds only its handful of fare buckets, which the array expressions read. Open buckets count; where
    none is open, priced ones do.
    """
    derived, calendar = _derived(), _calendar()
    rows = prepared.drop(*derived, *calendar).repartition(*[k for k in STATE_KEY if k not in derived]).withColumns(derived)
    price, seats = F.col("price_total"), F.col("seat_available")
    priced = price.isNotNull()
    is_open = priced & ~F.col("soldout")
    pick = F.struct(price.alias("price"), seats.isNull().alias("no_seats"), (-seats).alias("neg"), seats.alias("seats"),
                    F.col("tax_amount").alias("tax"))

    def leading(name: str) -> Column:
        value = F.col(name)
        return F.min(F.when(value.isNotNull(), F.struct(price.isNull().alias("a"), price.alias("b"),
                                                        F.col("bucket_code").alias("c"), value.alias("v")))).alias(f"f_{name}")

    led = ["aircraft", "duration_min", "arrival", "inventory_confidence"]
    confidence = F.nullif(F.lower(F.trim("inventory_confidence")), F.lit(""))
    buckets = rows.groupBy(*STATE_KEY, "bucket_code").agg(
        F.min(F.when(is_open, pick)).alias("open_pick"), F.min(F.when(priced, pick)).alias("priced_pick"),
        F.max("soldout").alias("any_soldout"), F.max("seat_capacity").alias("cap"),
        F.collect_set(confidence).alias("confidences"), *[leading(c) for c in led])
    state = buckets.groupBy(*STATE_KEY).agg(
        F.collect_list(F.struct("bucket_code", "open_pick", "priced_pick")).alias("b"),
        F.max(F.col("open_pick").isNotNull()).alias("is_available"),
        F.count("priced_pick").alias("priced_bucket_count"), F.count_if("any_soldout").alias("soldout_bucket_count"),
        F.max("cap").alias("capacity_physical"), F.array_distinct(F.flatten(F.collect_list("confidences"))).alias("confidences"),
        *[F.min(f"f_{c}").alias(f"f_{c}") for c in led]).withColumns(calendar)
    chosen = F.transform("b", lambda x: F.struct(
        F.when(F.col("is_available"), x["open_pick"]).otherwise(x["priced_pick"]).alias("p"), x["bucket_code"].alias("code")))
    ladder = F.array_sort(F.transform(F.filter(chosen, lambda x: x["p"].isNotNull()), lambda x: F.struct(
        x["p"]["price"].alias("price"), x["p"]["no_seats"].alias("no_seats"), x["p"]["neg"].alias("neg"), x["code"].alias("code"),
        x["p"]["seats"].alias("seats"), x["p"]["tax"].alias("tax"))))
    state = state.withColumn("ladder", ladder)
    low, high = F.try_element_at("ladder", F.lit(1)), F.try_element_at("ladder", F.lit(-1))
    state = state.withColumns({
        "low": low, "high": high,
        "seat_list": F.filter(F.transform("ladder", lambda x: x["seats"]), lambda v: v.isNotNull()),
        "any_missing": F.exists("ladder", lambda x: x["seats"].isNull()),
        "any_tax": F.exists("ladder", lambda x: x["tax"].isNotNull()),
    })
    mode, cap = _semantics(semantics)
    positive = F.filter("seat_list", lambda v: v > 0)
    open_sum = F.when(F.size(positive) > 0, F.aggregate(positive, F.lit(0).cast("bigint"), lambda a, v: a + v))
    state = state.withColumns({"seat_semantics_mode": mode, "bucket_seat_cap": cap, "open_seat_sum": open_sum,
                               "max_bucket_seat_proxy": F.array_max("seat_list"), "lowest_bucket_seat_proxy": F.col("low.seats")})
    capped = F.col("bucket_seat_cap").isNotNull()
    quality = (
        F.when(F.size("seat_list") == 0, "missing").when(F.col("any_missing"), "mixed")
        .when(capped & (F.col("max_bucket_seat_proxy") >= F.col("bucket_seat_cap")), "censored").otherwise("good"))
    share = F.when(F.col("capacity_physical") > 0, ratio(F.col("open_seat_sum"), F.col("capacity_physical")))
    spread = F.col("high.price") - F.col("low.price")
    out = state.select(
        *STATE_KEY, F.col("f_aircraft.v").alias("aircraft_type"), F.col("f_duration_min.v").alias("duration_min"),
        F.col("f_arrival.v").alias("arrival"), "capacity_physical", "seat_semantics_mode", "bucket_seat_cap", "is_available",
        "priced_bucket_count", F.size("ladder").alias("open_bucket_count"), "soldout_bucket_count",
        F.col("low.code").alias("lowest_open_bucket_code"), F.col("high.code").alias("highest_open_bucket_code"),
        F.col("low.price").alias("lowest_open_fare"), F.col("high.price").alias("highest_open_fare"),
        F.col("low.tax").alias("lowest_open_tax_amount"), spread.alias("fare_spread_abs"),
        F.when(F.col("low.price") > 0, spread / F.col("low.price") * 100.0).alias("fare_spread_pct"),
        "lowest_bucket_seat_proxy",
        (capped & F.coalesce(F.col("lowest_bucket_seat_proxy") >= F.col("bucket_seat_cap"), F.lit(False))).alias("lowest_bucket_seat_censored"),
        "max_bucket_seat_proxy",
        (capped & F.coalesce(F.col("max_bucket_seat_proxy") >= F.col("bucket_seat_cap"), F.lit(False))).alias("max_bucket_seat_censored"),
        "open_seat_sum", share.alias("open_cap_ratio"), clip(share, 0, 1).alias("open_cap_clamped_ratio"),
        ((1.0 - clip(share, 0, 1)) * 100.0).alias("inv_press_pct"), F.col("any_tax").alias("has_tax_info"),
        (F.size("seat_list") > 0).alias("has_bucket_seat_info"), quality.alias("inventory_proxy_quality"),
        F.when(F.size("confidences") > 1, "mixed").otherwise(F.col("f_inventory_confidence.v")).alias("inventory_confidence_summary"),
        *calendar, F.col("captured_at").alias("observed_at_utc"),
        F.coalesce("probe_group_id", F.concat(F.lit("SCRAPE:"), "cycle_id")).alias("probe_join_id"),
        F.concat_ws("|", "airline", "flight_number", "origin", "destination",
                    F.date_format("departure", "yyyy-MM-dd HH:mm:ss")).alias("flight_key"),
        F.col("dep_weekday").isin(5, 6).alias("is_weekend"))
    return out


def next_labels(states: DataFrame) -> DataFrame:
    """What the next search of the same flight and party showed."""
    w = Window.partitionBy(*FLIGHT_KEY).orderBy("observed_at_utc", "cycle_id", "probe_join_id")

    def nxt(name: str, n: int = 1) -> Column:
        return F.lead(name, n).over(w)

    out = states.withColumns({
        "y_next_search_exists": nxt("cycle_id").isNotNull(), "y_next_search_scrape_id": nxt("cycle_id"),
        "y_next_search_observed_at_utc": nxt("observed_at_utc"), "y_next_search_lowest_fare": nxt("lowest_open_fare"),
        "y_next_search_open_bucket_count": nxt("open_bucket_count"), "y_next_search_inv_press_pct": nxt("inv_press_pct"),
        "y_next_search_is_available": nxt("is_available"), "y_next_search_lowest_bucket_code": nxt("lowest_open_bucket_code"),
        "__best": F.greatest(*[nxt("lowest_open_fare", n) for n in (1, 2, 3)]),
    })
    fare, delta = F.col("lowest_open_fare"), F.col("y_next_search_lowest_fare") - F.col("lowest_open_fare")
    seconds = F.unix_timestamp("y_next_search_observed_at_utc") - F.unix_timestamp("observed_at_utc")
    return out.withColumns({
        "y_next_search_lowest_fare_delta": delta,
        "y_next_search_lowest_fare_pct_delta": F.when(fare > 0, delta / fare * 100.0),
        "y_next_search_gap_hours": seconds / 3600.0,
        "y_next_search_price_move_class": F.when(delta > 1e-9, "up").when(delta < -1e-9, "down").when(delta.isNotNull(), "same"),
        "y_fare_increase_within_3_searches": F.coalesce(F.col("__best") > fare, F.lit(False)),
    }).drop("__best")


_PARTIES = (1, 2, 3, 4)


def probe_features(states: DataFrame) -> DataFrame:
    """Fares, availability and buckets by party size of the same probe, their gaps and the breakpoint."""
    order = F.struct("observed_at_utc", "cycle_id", "probe_join_id", "lowest_open_fare")
    measures = []
    for n in _PARTIES:
        mine = F.col("adt_count") == n
        for name, source in (("fare", "lowest_open_fare"), ("availability", "is_available"),
                             ("lowest_bucket_code", "lowest_open_bucket_code")):
            measures.append(F.min_by(source, F.when(mine & F.col(source).isNotNull(), order)).alias(f"{name}_adt{n}"))
    known = states.where(F.col("adt_count").isin(*_PARTIES)).dropna(subset=PROBE_KEY)
    out = states.join(known.groupBy(*PROBE_KEY).agg(*measures), PROBE_KEY, "left")
    fare = {n: F.col(f"fare_adt{n}") for n in _PARTIES}
    free = {n: F.col(f"availability_adt{n}") for n in _PARTIES}
    point = F.lit(None).cast("int")
    for n in (4, 3, 2):
        hit = F.coalesce(free[1] & ~free[n], F.lit(False)) | F.coalesce(fare[n] > fare[1], F.lit(False))
        point = F.when(hit, n).otherwise(point)
    pairs = [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (1, 4)]
    return out.withColumns({
        **{f"probe_has_adt{n}": fare[n].isNotNull() for n in (2, 3, 4)},
        **{f"fare_gap_{a}_to_{b}": fare[b] - fare[a] for a, b in pairs},
        "party_breakpoint_est": point,
    })


def gap_profile(states: DataFrame) -> DataFrame:
    """Add how a market reacts to party size, over one flight per probe session."""
    single = F.col("adt_count") == 1
    any_single = states.agg(F.coalesce(F.max(F.coalesce(single, F.lit(False))), F.lit(False))).scalar()
    reps = states.where(F.coalesce(single, F.lit(False)) | ~any_single)
    order = [F.col(c).asc_nulls_last() for c in ("observed_at_utc", "departure", "flight_number", "adt_count", "chd_count",
                                                 "cycle_id", "lowest_open_fare")]
    reps = first_rows(reps, [*MARKET_KEY, "probe_join_id"], order)
    gap = {k: F.col(f"fare_gap_{k}") for k in ("1_to_2", "1_to_3", "2_to_3")}
    pair = gap["1_to_2"].isNotNull()
    drop = F.coalesce(F.col("availability_adt1") & ~F.col("availability_adt2"), F.lit(False))
    point = F.col("party_breakpoint_est")

    def rate(num: Column, den: Column) -> Column:
        return ratio(F.count_if(num), F.nullif(F.count_if(den), F.lit(0)))

    p = "party_gap_profile_"
    profile = reps.groupBy(*MARKET_KEY).agg(
        F.count("*").alias(p + "obs_count"), F.countDistinct("probe_join_id").alias(p + "probe_session_count"),
        *[F.count(g).alias(f"{p}paired_{k.replace('_to', '')}_count") for k, g in gap.items()],
        *[F.avg(g).alias(f"{p}mean_gap_{k.replace('_to', '')}") for k, g in gap.items()],
        rate(gap["1_to_2"] > 1e-9, pair).alias(p + "jump_1_2_rate"), rate(drop, pair).alias(p + "avail_drop_1_2_rate"),
        *[rate(point == n, point.isNotNull()).alias(f"{p}breakpoint{n}_rate") for n in (2, 3, 4)])

    middle = exact_medians(reps, MARKET_KEY, {f"{p}median_gap_{k.replace('_to', '')}": g for k, g in gap.items()})
    profile = profile.join(middle, MARKET_KEY, "left")

    def two(name: str) -> Column:
        return F.coalesce(F.format_string("%.2f", half_even(F.col(p + name), 2)), F.lit("NA"))

    def whole(name: str) -> Column:
        return F.coalesce(half_even(F.col(p + name), 0).cast("bigint").cast("string"), F.lit("NA"))

    def text(label: str, name: str, show) -> Column:
        return F.when(F.col(p + name).isNull(), F.lit(f"{label}=NA")).otherwise(F.concat(F.lit(f"{label}="), show(name)))

    summary = F.concat_ws("|", text("bp2r", "breakpoint2_rate", two), text("j12", "jump_1_2_rate", two),
                          text("a12", "avail_drop_1_2_rate", two), text("g12", "median_gap_1_2", whole),
                          text("g13", "median_gap_1_3", whole), F.concat(F.lit("n="), F.col(p + "obs_count").cast("string")))
    none = F.col(p + "median_gap_1_2").isNull() & F.col(p + "median_gap_1_3").isNull()
    profile = profile.withColumn("party_gap_profile", F.when(none, "insufficient_probe_data").otherwise(summary))
    return states.join(profile, MARKET_KEY, "left")


def _bins(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the first edge the value does not exceed; outside the edges it is unknown."""
    out = F.lit("unknown")
    for edge, label in reversed(list(zip(edges, labels))):
        out = F.when(value <= edge, label).otherwise(out)
    return F.when(value.isNull() | (value < -1), "unknown").otherwise(out)


# Fixed edges of the bins.
_TIME_EDGES = [299, 419, 599, 719, 899, 1079, 1439, 10_000]
_TIME_LABELS = ["late_night", "early_morning", "morning_peak", "late_morning", "afternoon", "evening", "night", "unknown"]
_DTD_EDGES = [0, 1, 2, 3, 7, 14, 30, 10_000]
_DTD_LABELS = ["D0", "D1", "D2", "D3", "D4_7", "D8_14", "D15_30", "D31p"]


def engineered(states: DataFrame, route: str) -> DataFrame:
    """Time and ladder features, and variants that are set only on one route."""
    tag = route.lower().replace("-", "_")
    other = f"non_{tag}"
    on = F.coalesce(F.upper("route_key") == route.upper(), F.lit(False))
    flag = on.cast("int")
    dtd = clip(F.col("days_to_departure").cast("double"), 0)
    dow, weekend = F.col("dep_weekday").cast("double"), F.col("is_weekend").cast("double")
    bucket = _bins(dtd, _DTD_EDGES, _DTD_LABELS)
    dep_bin, search_bin = (_bins(c, _TIME_EDGES, _TIME_LABELS) for c in (F.col("dep_time_min").cast("double"),
                                                                         F.col("search_hour").cast("double") * 60.0))
    dow_key = F.when(dow.isNotNull(), F.concat(F.lit("dow"), dow.cast("int").cast("string"))).otherwise("dowNA")

    def masked(value: Column) -> Column:
        return F.when(on, value).otherwise(other)

    low, high, spread = F.col("lowest_open_fare"), F.col("highest_open_fare"), F.col("fare_spread_abs")
    n_open, n_priced = F.col("open_bucket_count").cast("double"), F.col("priced_bucket_count").cast("double")
    out = states.withColumns({
        f"route_is_{tag}": on,
        "dep_tod_bin": dep_bin, f"dep_tod_bin_{tag}": masked(dep_bin),
        "search_tod_bin": search_bin, f"search_tod_bin_{tag}": masked(search_bin),
        "dtd_bucket": bucket, f"{tag}_dtd_bucket": masked(bucket),
        "dtd_x_dep_weekday": dtd * dow, "dtd_x_is_weekend": dtd * weekend,
        f"{tag}_dtd_x_dep_weekday": dtd * dow * flag, f"{tag}_dtd_x_is_weekend": dtd * weekend * flag,
        f"{tag}_days_to_departure": dtd * flag, f"{tag}_dep_weekday": dow * flag,
        f"{tag}_dow_dtd_key": masked(F.concat(dow_key, F.lit("|"), bucket)),
        "fare_ladder_high_low_ratio": F.when((low > 0) & (high > 0), high / low),
        "fare_ladder_spread_to_low_ratio": F.when(low > 0, spread / low),
        "fare_ladder_tax_share_lowest": F.when(low > 0, F.col("lowest_open_tax_amount") / low),
        "fare_ladder_open_bucket_density": F.when(n_priced > 0, n_open / n_priced),
        "fare_ladder_spread_per_open_bucket": F.when(n_open > 0, spread / n_open),
        "fare_ladder_spread_per_step": F.when(n_open > 1, spread / (n_open - 1.0)),
    })
    sources = {
        "inv_press_pct": "inv_press_pct", "open_cap_ratio": "open_cap_ratio", "lowest_open_fare": "lowest_open_fare",
        "fare_spread_abs": "fare_spread_abs", "fare_spread_pct": "fare_spread_pct",
        "fare_ladder_high_low_ratio": "fare_ladder_high_low_ratio",
        "fare_ladder_spread_to_low_ratio": "fare_ladder_spread_to_low_ratio",
        "fare_ladder_open_bucket_density": "fare_ladder_open_bucket_density",
        "party_gap_profile_median_gap_1_2": "party_gap_prior_g12",
        "party_gap_profile_jump_1_2_rate": "party_gap_prior_jump12",
        "party_gap_profile_breakpoint2_rate": "party_gap_prior_bp2",
    }
    out = out.withColumns({f"{tag}_{name}": F.when(on, F.col(source).cast("double")).otherwise(F.lit(0.0))
                           for source, name in sources.items() if source in out.columns})
    days = F.coalesce(dtd, F.lit(0.0))
    return out.withColumns({f"{tag}_{name}_x_dtd": F.col(f"{tag}_{source}") * days for source, name in (
        ("inv_press_pct", "inv_press"), ("open_cap_ratio", "open_cap"), ("fare_spread_pct", "spread_pct"))})


def probe_sensitivity(states: DataFrame, probe_group: str | None = None) -> DataFrame:
    """One row per flight of a probe with its reaction to a second passenger."""
    rows = states.where(F.col("probe_group_id") == probe_group) if probe_group else states
    keys = ["probe_group_id", "probe_join_id", "airline", "origin", "destination", "route_key", "flight_number", "departure",
            "cabin", "chd_count", "inf_count"]
    order = [F.col(c).asc_nulls_last() for c in ("adt_count", "captured_at", "cycle_id")]
    flights = first_rows(rows, keys, order)
    fare, gap = F.col("fare_adt1"), F.col("fare_gap_1_to_2")
    drop = F.coalesce(F.col("availability_adt1") & ~F.col("availability_adt2"), F.lit(False))
    return flights.withColumns({
        "fare_gap_1_to_2_pct": F.when(fare > 0, gap / fare * 100.0),
        "availability_drop_1_to_2": drop,
        "sensitivity_class": F.when(drop, "availability_drop").when(gap > 0, "price_jump").when(gap == 0, "stable")
        .when(gap < 0, "price_drop").otherwise("insufficient_pair"),
    })


def probe_summary(flights: DataFrame, raw_rows: DataFrame | None = None, by: Sequence[str] = ("probe_group_id",)) -> DataFrame:
    """Pair counts, shares and gaps of a probe. One row per ``by`` group."""
    fare = {n: F.col(f"fare_adt{n}") for n in _PARTIES}
    pair = {(a, b): fare[a].isNotNull() & fare[b].isNotNull() for a, b in ((1, 2), (1, 3), (2, 3))}
    gap = F.col("fare_gap_1_to_2")
    both = F.col("availability_adt1").isNotNull() & F.col("availability_adt2").isNotNull()
    n = F.count("*")
    shares = []
    for (a, b), c in pair.items():
        shares += [F.count_if(c).alias(f"paired_adt{a}_adt{b}_flights"),
                   (ratio(F.count_if(c), n) * 100.0).alias(f"paired_adt{a}_adt{b}_pct")]
    jump, drop = pair[(1, 2)] & (gap > 0), both & F.col("availability_drop_1_to_2")
    out = flights.groupBy(*by).agg(
        n.alias("flight_rows_unique"), *shares, F.count_if(jump).alias("price_jump_1_to_2_count"),
        (ratio(F.count_if(jump), F.count_if(pair[(1, 2)])) * 100.0).alias("price_jump_1_to_2_pct_of_pairs"),
        F.count_if(pair[(1, 2)] & (gap == 0)).alias("stable_price_1_to_2_count"),
        F.count_if(drop).alias("availability_drop_1_to_2_count"),
        (ratio(F.count_if(drop), F.count_if(both)) * 100.0).alias("availability_drop_1_to_2_pct_of_pairs"),
        *[F.avg(f"fare_gap_{k}").alias(f"mean_fare_gap_{k}") for k in ("1_to_2", "1_to_3", "2_to_3")],
        *[F.count_if(F.col("party_breakpoint_est") == k).alias(f"breakpoint_{k}_count") for k in (2, 3, 4)])
    middle = {f"median_fare_gap_{k}": F.col(f"fare_gap_{k}") for k in ("1_to_2", "1_to_3", "2_to_3", "1_to_2_pct")}
    out = out.join(exact_medians(flights, by, middle), list(by), "left")
    if raw_rows is None:
        return out
    return out.join(raw_rows.groupBy(*by).agg(F.count("*").alias("dataset_rows_raw")), list(by), "left")


def time_split(df: DataFrame, test_fraction: float = 0.2, time_col: str = "observed_at_utc",
               tie: Sequence[str] | None = None) -> DataFrame:
    """Add ``is_test`` for the newest share of the rows, exactly as many as the share asks for.

    Rows are counted per time, so only the time at the border has to be divided. There whole ranges of
    a hash of the tie columns are counted, and the rows of a single range are ranked. The border comes
    back as two one-row subqueries.
    """
    rows = df.where(F.col(time_col).isNotNull()).withColumn("__h", F.xxhash64(*(tie or df.columns)))
    rows = rows.withColumn("__slot", F.shiftright(F.col("__h"), 54))
    slots = rows.groupBy(time_col, "__slot").agg(F.count("*").alias("c"))
    total = slots.agg(F.sum("c")).scalar()
    train = F.greatest(F.lit(1), total - F.greatest(F.lit(1), F.floor(total * test_fraction)))

    def border(counts: DataFrame, key: str, want: Column, passed: Column) -> Column:
        """The first key at which the running count passes ``want``, and how many rows it still gives."""
        before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        running = counts.withColumns({"want": want, "start": passed + F.coalesce(F.sum("c").over(before), F.lit(0))})
        hit = running.where("start <= want AND want < start + c")
        return hit.agg(F.max(F.struct(F.col(key).alias("at"), (F.col("want") - F.col("start")).alias("left")))).scalar()

    # Times outside a bracket of the border, found by a sketch, are only counted.
    at = F.unix_micros(F.col(time_col).cast("timestamp"))
    edge = near_share(rows.select(at.alias("v")), "v", 1.0 - test_fraction).select(F.struct("lo", "hi")).scalar()
    passed = F.coalesce(slots.where(at < edge["lo"]).agg(F.sum("c")).scalar(), F.lit(0))
    near = slots.where((at >= edge["lo"]) & (at <= edge["hi"]))
    cut = border(near.groupBy(time_col).agg(F.sum("c").alias("c")), time_col, train, passed)
    slot = border(slots.where(F.col(time_col) == cut["at"]).groupBy("__slot").agg(F.sum("c").alias("c")), "__slot", cut["left"], F.lit(0))
    divided = F.coalesce((F.col(time_col) == cut["at"]) & (F.col("__slot") == slot["at"]), F.lit(False))
    place = F.row_number().over(Window.partitionBy(time_col, "__slot").orderBy("__h"))
    ranked = rows.where(divided).withColumn("is_test", place > slot["left"])
    later = (F.col(time_col) > cut["at"]) | ((F.col(time_col) == cut["at"]) & (F.col("__slot") > slot["at"]))
    simple = rows.where(~divided).withColumn("is_test", F.coalesce(later, F.lit(False)))
    return ranked.unionByName(simple).select(*df.columns, "is_test")
