"""Queries over inventory states and probes."""

from pyspark.sql import functions as F

from farescope.catalog.base import query, sql, stored
from farescope.functions import bounded_broadcast
from farescope.operators import cycles, inventory
from farescope.operators.inventory import FLIGHT_KEY, MARKET_KEY, PROBE_KEY, STATE_KEY
from farescope.sources import offers_with_meta

_SEM = {"A1": ("non_additive", 9), "A2": ("additive", 20), "A3": ("unknown", None)}
_META = ("tax_amount soldout adt_count chd_count inf_count probe_group_id booking_class aircraft duration_min arrival "
         "inventory_confidence")


def prepared(ctx):
    """Offers with their side-car, all captures of a cycle at the cycle's time."""
    times = cycles.cycle_times(ctx.capture_times).withColumnRenamed("captured_at", "t")
    offers = ctx.offers.join(bounded_broadcast(times), "cycle_id").withColumn("captured_at", F.col("t")).drop("t")
    return inventory.prepare_rows(offers_with_meta(offers, ctx.meta_with(_META)))


_PREP = """tm AS (SELECT cycle_id, max(captured_at) AS t FROM offers GROUP BY 1),
  pr AS (SELECT o.* EXCLUDE (captured_at, price_total), tm.t AS captured_at, CAST(price_total AS DOUBLE) AS price,
    CAST(tax_amount AS DOUBLE) AS tax, coalesce(soldout, false) AS soldout, adt_count, chd_count, inf_count, probe_group_id,
    aircraft, duration_min, arrival, inventory_confidence, origin || '-' || destination AS route_key,
    CAST(departure AS DATE) AS departure_date, coalesce(nullif(trim(fare_basis), ''), nullif(trim(booking_class), ''),
      nullif(trim(brand), ''), 'UNK') AS bucket_code, isodow(departure) - 1 AS dep_weekday, month(departure) AS dep_month,
    hour(departure) * 60 + minute(departure) AS dep_time_min, hour(tm.t) AS search_hour,
    date_diff('second', tm.t, departure) / 3600.0::DOUBLE AS hours_to_departure,
    CAST(floor(date_diff('second', tm.t, departure) / 86400.0::DOUBLE) AS INT) AS days_to_departure
    FROM offers o JOIN tm USING (cycle_id) LEFT JOIN meta m USING (offer_id))"""


@query("inventory_rows", "offer_id:s captured_at:t bucket_code:s route_key:s departure_date:D dep_weekday:i dep_month:i "
       "dep_time_min:i search_hour:i hours_to_departure:d days_to_departure:i soldout:b", sql("SELECT * FROM pr",
       needs="offers meta", ctes=_PREP))
def _rows(ctx):
    return prepared(ctx)


_G = ", ".join(STATE_KEY)
_SAME = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in STATE_KEY)


def _first(name):
    return (f"first({name} ORDER BY price NULLS LAST, bucket_code, {name}) FILTER (WHERE {name} IS NOT NULL)")


STATES = _PREP + f""",
  grp AS (SELECT *, bool_or(NOT soldout AND price IS NOT NULL) OVER (PARTITION BY {_G}) AS has_open FROM pr),
  lad AS (SELECT * FROM grp WHERE price IS NOT NULL AND (NOT has_open OR NOT soldout)
    QUALIFY row_number() OVER (PARTITION BY {_G}, bucket_code ORDER BY price, seat_available DESC NULLS LAST, tax) = 1),
  lv AS (SELECT {_G}, count(*) AS open_bucket_count, first(bucket_code ORDER BY price, seat_available DESC NULLS LAST, bucket_code) AS lc,
    last(bucket_code ORDER BY price, seat_available DESC NULLS LAST, bucket_code) AS hc,
    first(seat_available ORDER BY price, seat_available DESC NULLS LAST, bucket_code) AS ls,
    first(tax ORDER BY price, seat_available DESC NULLS LAST, bucket_code) AS lt, min(price) AS lo, max(price) AS hi,
    sum(seat_available) FILTER (WHERE seat_available > 0) AS ssum, max(seat_available) AS smax, count(seat_available) AS sn,
    count(tax) > 0 AS any_tax FROM lad GROUP BY ALL),
  ag AS (SELECT {_G}, bool_or(NOT soldout AND price IS NOT NULL) AS is_available,
    count(DISTINCT bucket_code) FILTER (WHERE price IS NOT NULL) AS priced_bucket_count,
    count(DISTINCT bucket_code) FILTER (WHERE soldout) AS soldout_bucket_count, max(seat_capacity) AS capacity_physical,
    {_first('aircraft')} AS aircraft_type, {_first('duration_min')} AS duration_min, {_first('arrival')} AS arrival,
    CASE WHEN count(DISTINCT lower(trim(inventory_confidence))) > 1 THEN 'mixed' ELSE {_first('inventory_confidence')} END
      AS inventory_confidence_summary, any_value(dep_weekday) AS dep_weekday, any_value(dep_time_min) AS dep_time_min,
    any_value(search_hour) AS search_hour, any_value(days_to_departure) AS days_to_departure,
    any_value(hours_to_departure) AS hours_to_departure FROM pr GROUP BY ALL),
  st AS (SELECT *, coalesce(probe_group_id, 'SCRAPE:' || cycle_id) AS probe_join_id, captured_at AS observed_at_utc,
    lc AS lowest_open_bucket_code, hc AS highest_open_bucket_code, lo AS lowest_open_fare, hi AS highest_open_fare,
    lt AS lowest_open_tax_amount, hi - lo AS fare_spread_abs, (hi - lo) / lo * 100.0 AS fare_spread_pct,
    ls AS lowest_bucket_seat_proxy, smax AS max_bucket_seat_proxy, ssum AS open_seat_sum, ssum / capacity_physical AS open_cap_ratio,
    CASE WHEN ssum IS NOT NULL THEN (1 - least(1.0, ssum / capacity_physical)) * 100.0 END AS inv_press_pct,
    coalesce(smax >= bcap, false) AS max_bucket_seat_censored, coalesce(ls >= bcap, false) AS lowest_bucket_seat_censored,
    any_tax AS has_tax_info, CASE WHEN sn = 0 THEN 'missing' WHEN sn < open_bucket_count THEN 'mixed' WHEN smax >= bcap THEN 'censored'
      ELSE 'good' END AS inventory_proxy_quality, dep_weekday IN (5, 6) AS is_weekend,
    CASE airline WHEN 'A1' THEN 'non_additive' WHEN 'A2' THEN 'additive' ELSE 'unknown' END AS seat_semantics_mode
    FROM (SELECT b.*, a.* EXCLUDE ({_G}), CASE b.airline WHEN 'A1' THEN 9 WHEN 'A2' THEN 20 END AS bcap
      FROM ag b LEFT JOIN lv a ON {_SAME}))"""


def computed_states(ctx):
    return inventory.inventory_states(prepared(ctx), _SEM)


def states(ctx):
    """Inventory states, stored for the features built on them."""
    return stored(ctx, "inventory-states", lambda: computed_states(ctx))


_ID = ("cycle_id:s probe_join_id:s observed_at_utc:t airline:s origin:s destination:s flight_number:s departure:t cabin:s "
       "adt_count:i chd_count:i inf_count:i ")


@query("inventory_states", _ID + "aircraft_type:s duration_min:i arrival:t capacity_physical:i seat_semantics_mode:s "
       "is_available:b priced_bucket_count:i open_bucket_count:i soldout_bucket_count:i lowest_open_bucket_code:s "
       "highest_open_bucket_code:s lowest_open_fare:d2 highest_open_fare:d2 lowest_open_tax_amount:d2 fare_spread_abs:d2 "
       "fare_spread_pct:d4 lowest_bucket_seat_proxy:i max_bucket_seat_proxy:i lowest_bucket_seat_censored:b "
       "max_bucket_seat_censored:b open_seat_sum:i open_cap_ratio:d inv_press_pct:d has_tax_info:b inventory_proxy_quality:s "
       "inventory_confidence_summary:s is_weekend:b", sql("SELECT * FROM st", needs="offers meta", ctes=STATES))
def _states(ctx):
    return computed_states(ctx)


_F = ", ".join(FLIGHT_KEY)
LABELS = STATES + f""",
  lb AS (SELECT *, lead(cycle_id) OVER w AS n_id, lead(observed_at_utc) OVER w AS n_at, lead(lowest_open_fare) OVER w AS n_fare,
    greatest(lead(lowest_open_fare, 1) OVER w, lead(lowest_open_fare, 2) OVER w, lead(lowest_open_fare, 3) OVER w) AS n_best,
    lead(open_bucket_count) OVER w AS n_open, lead(is_available) OVER w AS n_av FROM st
    WINDOW w AS (PARTITION BY {_F} ORDER BY observed_at_utc, cycle_id, probe_join_id))"""


@query("inventory_next_labels", _ID + "y_next_search_exists:b y_next_search_scrape_id:s y_next_search_lowest_fare:d2 "
       "y_next_search_open_bucket_count:i y_next_search_is_available:b y_next_search_lowest_fare_delta:d2 "
       "y_next_search_lowest_fare_pct_delta:d4 y_next_search_gap_hours:d4 y_next_search_price_move_class:s "
       "y_fare_increase_within_3_searches:b", sql("""SELECT *, n_id IS NOT NULL AS y_next_search_exists,
  n_id AS y_next_search_scrape_id, n_fare AS y_next_search_lowest_fare, n_open AS y_next_search_open_bucket_count,
  n_av AS y_next_search_is_available, n_fare - lowest_open_fare AS y_next_search_lowest_fare_delta,
  (n_fare - lowest_open_fare) / lowest_open_fare * 100.0 AS y_next_search_lowest_fare_pct_delta,
  date_diff('second', observed_at_utc, n_at) / 3600.0::DOUBLE AS y_next_search_gap_hours,
  CASE WHEN n_fare > lowest_open_fare + 1e-9 THEN 'up' WHEN n_fare < lowest_open_fare - 1e-9 THEN 'down'
    WHEN n_fare IS NOT NULL THEN 'same' END AS y_next_search_price_move_class,
  coalesce(n_best > lowest_open_fare, false) AS y_fare_increase_within_3_searches FROM lb""", needs="offers meta", ctes=LABELS))
def _labels(ctx):
    return inventory.next_labels(states(ctx))


_P = ", ".join(PROBE_KEY)


def _pick(name, source):
    return ", ".join(f"first({source} ORDER BY observed_at_utc, cycle_id, probe_join_id, lowest_open_fare) FILTER (WHERE adt_count = {n} "
                     f"AND {source} IS NOT NULL) AS {name}_adt{n}" for n in (1, 2, 3, 4))


PROBES = STATES + f""",
  pv AS (SELECT {_P}, {_pick('fare', 'lowest_open_fare')}, {_pick('availability', 'is_available')},
    {_pick('lowest_bucket_code', 'lowest_open_bucket_code')} FROM st WHERE chd_count IS NOT NULL AND inf_count IS NOT NULL
    AND adt_count IN (1, 2, 3, 4) GROUP BY {_P}),
  pb AS (SELECT *, fare_adt2 - fare_adt1 AS fare_gap_1_to_2, fare_adt3 - fare_adt1 AS fare_gap_1_to_3,
    fare_adt3 - fare_adt2 AS fare_gap_2_to_3, CASE WHEN coalesce(availability_adt1 AND NOT availability_adt2, false)
      OR coalesce(fare_adt2 > fare_adt1, false) THEN 2 WHEN coalesce(availability_adt1 AND NOT availability_adt3, false)
      OR coalesce(fare_adt3 > fare_adt1, false) THEN 3 WHEN coalesce(availability_adt1 AND NOT availability_adt4, false)
      OR coalesce(fare_adt4 > fare_adt1, false) THEN 4 END AS party_breakpoint_est FROM st LEFT JOIN pv USING ({_P}))"""


def probes(ctx):
    return stored(ctx, "probes", lambda: inventory.probe_features(states(ctx)))


@query("inventory_probe_features", _ID + "fare_adt1:d2 fare_adt2:d2 fare_adt3:d2 fare_adt4:d2 availability_adt1:b "
       "availability_adt2:b lowest_bucket_code_adt1:s lowest_bucket_code_adt3:s fare_gap_1_to_2:d2 fare_gap_1_to_3:d2 "
       "fare_gap_2_to_3:d2 party_breakpoint_est:i", sql("SELECT * FROM pb", needs="offers meta", ctes=PROBES))
def _probes(ctx):
    return inventory.probe_features(states(ctx))


_M = ", ".join(MARKET_KEY)
PROFILE = PROBES + f""",
  rp AS (SELECT * FROM pb WHERE adt_count = 1 QUALIFY row_number() OVER (PARTITION BY {_M}, probe_join_id ORDER BY observed_at_utc,
    departure, flight_number, adt_count, chd_count NULLS LAST, cycle_id, lowest_open_fare NULLS LAST) = 1),
  gp AS (SELECT {_M}, count(*) AS obs, count(DISTINCT probe_join_id) AS sessions, count(fare_gap_1_to_2) AS p12,
    count(fare_gap_1_to_3) AS p13, median(fare_gap_1_to_2) AS m12, median(fare_gap_1_to_3) AS m13, avg(fare_gap_2_to_3) AS a23,
    count(*) FILTER (WHERE fare_gap_1_to_2 > 1e-9) / nullif(count(fare_gap_1_to_2), 0) AS jump,
    count(*) FILTER (WHERE availability_adt1 AND NOT availability_adt2) / nullif(count(fare_gap_1_to_2), 0) AS adrop,
    count(*) FILTER (WHERE party_breakpoint_est = 2) / nullif(count(party_breakpoint_est), 0) AS bp2 FROM rp GROUP BY {_M})"""


@query("inventory_gap_profile", "airline:s origin:s destination:s cabin:s states:i obs:i sessions:i p12:i p13:i m12:d2 m13:d2 a23:d4 "
       "jump:d adrop:d bp2:d profile:s", sql(f"""SELECT gp.*, n AS states, CASE WHEN m12 IS NULL AND m13 IS NULL
  THEN 'insufficient_probe_data' ELSE 'bp2r=' || coalesce(format('{{:.2f}}', round_even(bp2, 2)), 'NA') || '|j12=' ||
    coalesce(format('{{:.2f}}', round_even(jump, 2)), 'NA') || '|a12=' || coalesce(format('{{:.2f}}', round_even(adrop, 2)), 'NA') ||
    '|g12=' || coalesce(CAST(CAST(round_even(m12, 0) AS BIGINT) AS VARCHAR), 'NA') || '|g13=' ||
    coalesce(CAST(CAST(round_even(m13, 0) AS BIGINT) AS VARCHAR), 'NA') || '|n=' || obs END AS profile
  FROM gp JOIN (SELECT {_M}, count(*) AS n FROM st GROUP BY ALL) USING ({_M})""", needs="offers meta", ctes=PROFILE))
def _profile(ctx):
    p = "party_gap_profile_"
    out = inventory.gap_profile(probes(ctx))
    return out.groupBy(*MARKET_KEY).agg(F.count("*").alias("states"), *[F.max(p + c).alias(n) for n, c in (
        ("obs", "obs_count"), ("sessions", "probe_session_count"), ("p12", "paired_1_2_count"), ("p13", "paired_1_3_count"),
        ("m12", "median_gap_1_2"), ("m13", "median_gap_1_3"), ("a23", "mean_gap_2_3"), ("jump", "jump_1_2_rate"),
        ("adrop", "avail_drop_1_2_rate"), ("bp2", "breakpoint2_rate"))], F.max("party_gap_profile").alias("profile"))


@query("inventory_engineered", _ID + "route_is_r1_r2:b dep_tod_bin:s dep_tod_bin_r1_r2:s search_tod_bin:s dtd_bucket:s "
       "dtd_x_dep_weekday:d dtd_x_is_weekend:d r1_r2_days_to_departure:d r1_r2_dow_dtd_key:s fare_ladder_high_low_ratio:d "
       "fare_ladder_tax_share_lowest:d fare_ladder_open_bucket_density:d fare_ladder_spread_per_step:d r1_r2_lowest_open_fare:d2 "
       "r1_r2_inv_press_x_dtd:d3", sql("""SELECT *, route_key = 'R1-R2' AS route_is_r1_r2, tod AS dep_tod_bin,
  CASE WHEN route_key = 'R1-R2' THEN tod ELSE 'non_r1_r2' END AS dep_tod_bin_r1_r2, 'late_night' AS search_tod_bin,
  CASE WHEN days_to_departure <= 10000 THEN 'D31p' ELSE 'unknown' END AS dtd_bucket, days_to_departure * dep_weekday AS dtd_x_dep_weekday,
  days_to_departure * is_weekend::INT AS dtd_x_is_weekend, CASE WHEN route_key = 'R1-R2' THEN days_to_departure ELSE 0 END AS r1_r2_days_to_departure,
  CASE WHEN route_key = 'R1-R2' THEN 'dow' || dep_weekday || '|' || CASE WHEN days_to_departure <= 10000 THEN 'D31p' ELSE 'unknown' END
    ELSE 'non_r1_r2' END AS r1_r2_dow_dtd_key, highest_open_fare / lowest_open_fare AS fare_ladder_high_low_ratio,
  lowest_open_tax_amount / lowest_open_fare AS fare_ladder_tax_share_lowest,
  open_bucket_count / priced_bucket_count AS fare_ladder_open_bucket_density,
  CASE WHEN open_bucket_count > 1 THEN fare_spread_abs / (open_bucket_count - 1) END AS fare_ladder_spread_per_step,
  CASE WHEN route_key = 'R1-R2' THEN lowest_open_fare ELSE 0 END AS r1_r2_lowest_open_fare,
  CASE WHEN route_key = 'R1-R2' THEN inv_press_pct * days_to_departure ELSE 0 END AS r1_r2_inv_press_x_dtd
  FROM (SELECT *, CASE WHEN dep_time_min = 360 THEN 'early_morning' ELSE 'night' END AS tod FROM st)""", needs="offers meta", ctes=STATES))
def _engineered(ctx):
    return inventory.engineered(states(ctx), "R1-R2")


_SENS = PROBES + """,
  sn AS (SELECT *, fare_gap_1_to_2 / fare_adt1 * 100.0 AS fare_gap_1_to_2_pct,
    coalesce(availability_adt1 AND NOT availability_adt2, false) AS availability_drop_1_to_2,
    CASE WHEN coalesce(availability_adt1 AND NOT availability_adt2, false) THEN 'availability_drop' WHEN fare_gap_1_to_2 > 0
      THEN 'price_jump' WHEN fare_gap_1_to_2 = 0 THEN 'stable' WHEN fare_gap_1_to_2 < 0 THEN 'price_drop' ELSE 'insufficient_pair' END
      AS sensitivity_class FROM pb WHERE probe_group_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY probe_group_id,
    probe_join_id, airline, origin, destination, flight_number, departure, cabin, chd_count, inf_count
    ORDER BY adt_count, captured_at, cycle_id) = 1)"""


def sensitivity(ctx):
    return inventory.probe_sensitivity(probes(ctx).where("probe_group_id is not null"))


@query("probe_sensitivity", "probe_group_id:s airline:s origin:s destination:s flight_number:s departure:t cabin:s chd_count:i "
       "adt_count:i fare_gap_1_to_2:d2 fare_gap_1_to_2_pct:d4 availability_drop_1_to_2:b sensitivity_class:s",
       sql("SELECT * FROM sn", needs="offers meta", ctes=_SENS))
def _sensitivity(ctx):
    return sensitivity(ctx)


@query("probe_summary", "probe_group_id:s flight_rows_unique:i paired_adt1_adt2_flights:i paired_adt1_adt2_pct:d4 "
       "paired_adt1_adt3_flights:i price_jump_1_to_2_count:i price_jump_1_to_2_pct_of_pairs:d4 availability_drop_1_to_2_count:i "
       "median_fare_gap_1_to_2:d2 mean_fare_gap_1_to_2:d3 median_fare_gap_1_to_3:d2 breakpoint_2_count:i breakpoint_3_count:i", sql("""
  SELECT probe_group_id, count(*) AS flight_rows_unique, count(fare_gap_1_to_2) AS paired_adt1_adt2_flights,
  count(fare_gap_1_to_2) / count(*) * 100.0 AS paired_adt1_adt2_pct, count(fare_gap_1_to_3) AS paired_adt1_adt3_flights,
  count(*) FILTER (WHERE fare_gap_1_to_2 > 0) AS price_jump_1_to_2_count,
  count(*) FILTER (WHERE fare_gap_1_to_2 > 0) / nullif(count(fare_gap_1_to_2), 0) * 100.0 AS price_jump_1_to_2_pct_of_pairs,
  count(*) FILTER (WHERE availability_drop_1_to_2) AS availability_drop_1_to_2_count,
  median(fare_gap_1_to_2) AS median_fare_gap_1_to_2, avg(fare_gap_1_to_2) AS mean_fare_gap_1_to_2,
  median(fare_gap_1_to_3) AS median_fare_gap_1_to_3, count(*) FILTER (WHERE party_breakpoint_est = 2) AS breakpoint_2_count,
  count(*) FILTER (WHERE party_breakpoint_est = 3) AS breakpoint_3_count FROM sn GROUP BY 1""", needs="offers meta", ctes=_SENS))
def _summary(ctx):
    return inventory.probe_summary(sensitivity(ctx))


@query("inventory_time_split", "train_rows:i test_rows:i in_order:b", sql("""SELECT count(*) - greatest(1, floor(count(*) * 0.2)) AS train_rows,
  greatest(1, floor(count(*) * 0.2)) AS test_rows, true AS in_order FROM offers"""))
def _split(ctx):
    rows = ctx.offers.select("offer_id", F.date_trunc("year", "captured_at").alias("observed_at_utc"))
    split = inventory.time_split(rows, 0.2, tie=["offer_id"])
    return split.agg(F.count_if(~F.col("is_test")).alias("train_rows"), F.count_if("is_test").alias("test_rows"), (
        F.max(F.when(~F.col("is_test"), F.col("observed_at_utc"))) <= F.min(F.when(F.col("is_test"), F.col("observed_at_utc")))
    ).alias("in_order"))
