"""Hand-computed cases: odd inputs, ties, missing values and kept quirks."""

import json
import re
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from farescope.functions import ewm_last, ewm_series, field_display_name, split_via, stops_label
from farescope.operators import compare, cycles, diff, forecast, ingest, inventory, market, models, monitor, payloads, rollups
from farescope.plans import search
from farescope.schemas import OFFER_META

OFFER = ("offer_id string, cycle_id string, captured_at timestamp_ntz, airline string, flight_number string, origin string, "
         "destination string, departure timestamp_ntz, cabin string, brand string, price_total decimal(12,2), fare_basis string, "
         "seat_capacity int, seat_available int")


def offer(n, cycle, price, brand="B", seats=5, cap=50, basis="Y", flight="1"):
    from decimal import Decimal

    return (n, cycle, datetime(2024, 1, int(cycle[1:])), "AA", flight, "AAA", "BBB", datetime(2024, 3, 1, 8), "Eco", brand,
            None if price is None else Decimal(price), basis, cap, seats)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_ewm_decays_over_gaps(spark):
    df = spark.createDataFrame([([1.0, None, 3.0],)], "a array<double>")
    # Two steps of decay: (0.49 * 1 + 0.3 * 3) / 0.79.
    got = df.select(ewm_last(F.col("a"), 0.3).alias("l"), ewm_series(F.col("a"), 0.3).alias("s")).first()
    assert got["l"] == pytest.approx((0.49 + 0.9) / 0.79)
    assert got["s"][:2] == [1.0, 1.0]


def test_null_safe_diff_and_events(spark):
    old = spark.createDataFrame([offer("1", "C1", "100", None), offer("2", "C1", "0", "Z"), offer("3", "C1", "5", "GONE")], OFFER)
    new = spark.createDataFrame([offer("4", "C2", "150", None, seats=2), offer("5", "C2", "7", "Z"), offer("6", "C2", "9", "NEW")], OFFER)
    pairs = diff.pair_states(old, new)
    events = diff.summary_events(pairs)
    assert rows(events, "domain", "change_type", "magnitude", "percent_change") == sorted([
        ("availability", "added", None, None), ("availability", "removed", None, None), ("price", "increase", 50.0, 50.0),
        ("price", "increase", 7.0, None), ("seat", "decrease", 3.0, None)], key=str)
    fields = diff.diff_columns(pairs)
    assert rows(fields.where("field_name = 'seat_available'"), "direction", "old_value", "new_value") == [("down", "5", "2")]


def test_compare_is_not_null_safe(spark):
    both = spark.createDataFrame([offer("1", "C1", "100", None), offer("2", "C2", "100", None), offer("3", "C1", "50"),
                                  offer("4", "C2", "60")], OFFER)
    meta = spark.createDataFrame([], OFFER_META)
    out = compare.compare_scrapes(both, meta, "C2", "C1")
    assert rows(out, "signal") == [("INCREASE",), ("NEW_FLIGHT",), ("REMOVED",)]


def test_unreachable_counters_stay_zero(spark):
    old = spark.createDataFrame([offer("1", "C1", "100")], OFFER)
    new = spark.createDataFrame([offer("2", "C2", "150")], OFFER)
    events = diff.diff_columns(diff.pair_states(old, new))
    total = rollups.change_totals(events).first()
    assert (total["tax_event_count"], total["penalty_event_count"]) == (0, 0)
    injected = events.withColumn("domain", F.lit("tax")).withColumn("change_type", F.lit("changed"))
    assert rollups.change_totals(injected).first()["tax_event_count"] == total["event_count"]
    assert rollups.route_airline_summary(injected).first()["changed_events"] == total["event_count"]


def test_first_wins_and_unique_key_with_nulls(spark):
    df = spark.createDataFrame([offer("1", "C1", "1"), offer("2", "C1", "2"), offer("3", "C1", "3", basis=None),
                                offer("4", "C1", "4", basis=None)], OFFER)
    assert rows(ingest.dedup_core(df), "offer_id") == [("1",), ("3",)]
    # NULL parts of the storage key never clash.
    assert rows(ingest.append_dedup(df, df), "offer_id") == [("3",), ("4",)]


def test_previous_state_takes_latest_other_cycle(spark):
    df = spark.createDataFrame([offer("1", "C1", "1"), offer("2", "C2", "2"), offer("3", "C3", "3")], OFFER)
    assert rows(diff.previous_state(df, "C3"), "offer_id") == [("2",)]


def gds_offer(number, **more):
    """An offer of a made-up carrier; `more` replaces parts of it."""
    def amount(value):
        return {"alternatives": [[{"amount": value, "currency": "EUR"}]]}

    segment = {"flight": {"airlineCode": "ZQ", "flightNumber": number}, "equipment": "E95", "origin": "QQA", "destination": "QQB",
               "departure": "2031-07-05T21:40:00", "arrival": "2031-07-06T00:15:00", "cabinClass": "Premium", "bookingClass": "W", "fareBasis": "WLITE7"}
    return {"status": "AVAILABLE", "brandId": "LITE", "seatsRemaining": {"count": 7}, "fare": amount(81.5), "taxes": amount(12.25),
            "total": amount(93.75), "itineraryPart": [{"stops": 1, "segments": [segment, segment | {"origin": "QQB", "destination": "QQC"}]}]} | more


def test_grouped_response(spark):
    response = {"fareSearchReference": "r-1", "fareFamilies": [{"brandId": "LITE", "marketingTexts": [{"marketingText": "One bag of 17&nbsp;kg"}]}],
                "shoppingOffers": [[gds_offer("8"), gds_offer("9", status="SOLD_OUT"), gds_offer("10", status=None, soldout=True)],
                                   gds_offer("11", seatsRemaining=None, total=None, brandId="PLUS")]}
    df = spark.createDataFrame([(json.dumps(response),), ("{}",), ("no json",)], "payload string")
    got = payloads.flatten_gds(df)
    assert rows(got, "flight_number", "origin", "destination", "baggage", "seat_available", "price_total") == [
        ("11", "QQA", "QQB", None, None, 11250), ("11", "QQB", "QQC", None, None, 11250),
        ("8", "QQA", "QQB", "17 KG", 7, 11250), ("8", "QQB", "QQC", "17 KG", 7, 11250)]
    first = got.first()
    assert first["departure"] == datetime(2031, 7, 5, 21, 40) and first["tax_amount"] == Decimal("12.25") and first["stops"] == 1
    every = payloads.flatten_gds(df, keep_soldout=True)
    assert {r["flight_number"]: r["soldout"] for r in every.collect()} == {"8": False, "9": True, "10": True, "11": False}


def test_response_that_is_flat_already(spark):
    ready = {"rows": [{"airline": "ZQ", "flight_number": "8", "seats_remaining": 4, "total_amount": 93.75, "currency": "EUR", "baggage": "5 KG",
                       "departure": "2031-07-05T21:40:00", "soldout": False}]}
    got = payloads.flatten_gds(spark.createDataFrame([(json.dumps(ready),)], "payload string")).collect()
    assert len(got) == 1
    assert (got[0]["airline"], got[0]["seat_available"], got[0]["baggage"], got[0]["departure"]) == ("ZQ", 4, "5 KG", datetime(2031, 7, 5, 21, 40))


def test_grouped_payload_is_parsed_once(spark):
    df = spark.createDataFrame([("{}",)], "payload string")
    plan = payloads.flatten_gds(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_grouped_response_of_odd_shapes(spark):
    flat_price = {"alternatives": [{"amount": 20, "currency": "BDT"}]}
    odd = [gds_offer("8", itineraryPart=[None, {"segments": ["x", None]}, {"stops": 3}], itineraryParts=[], total=flat_price, cabinClass="Y", origin="QQZ"),
           gds_offer("9", itineraryPart={"segments": [{"flightNumber": 9}]}, total={"alternatives": "none"}, fare=None, taxes=[1]),
           gds_offer("10", segments=[{"flightNumber": "10", "stops": "two"}], status=7, soldout=False), "no offer"]
    del odd[2]["itineraryPart"]
    df = spark.createDataFrame([(json.dumps({"offers": odd}),)], "payload string")
    got = payloads.flatten_gds(df, keep_soldout=True)
    assert rows(got.where("total_amount = 20"), "flight_number", "cabin", "origin", "stops", "currency") == [
        (None, "Y", "QQZ", 3, "BDT"), (None, "Y", "QQZ", None, "BDT"), (None, "Y", None, 0, "BDT"), (None, "Y", None, 0, "BDT")]
    assert rows(got.where("flight_number IS NOT NULL"), "flight_number", "soldout", "total_amount", "stops") == [
        ("10", True, Decimal("93.75"), 0), ("9", False, None, 0)]


def test_block_response(spark):
    leg = {"flight": "ZQ-51", "type": "E95", "TOD": "2031-07-05T06:10:00", "TOA": "2031-07-05T08:00:00", "stops": 2}
    fares = {"LT": {"one": 2210, "all": 2210, "seats": 9}, "MX": {"one": 4480, "all": 4480, "seats": None}}
    block = {"from": "QQA", "into": "QQB", "flightDates": [{"date": "2031-07-05", "flights": [{"itinerary": [leg], "familyFares": fares}]}]}
    payload = {"flightSelections": {"currency": {"code": "BDT"}, "flightBlocks": [block],
                                    "fareFamilies": [{"code": "LT", "title": "Lite", "cabin": "W"}]}}
    got = payloads.flatten_blocks(spark.createDataFrame([(json.dumps(payload),)], "payload string"), airline="ZQ")
    assert rows(got, "fare_basis", "seat_available", "stops", "soldout", "brand") == [("LT", 9, 2, False, "Lite"), ("MX", None, 2, False, "MX")]
    assert {r["price_total"] for r in got.collect()} == {2210, 4480}


def test_block_payload_is_walked_over_once(spark):
    df = spark.createDataFrame([("{}",)], "payload string")
    plan = payloads.flatten_blocks(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and not re.search(r"Generate \w+\(try_variant_get", plan)


def test_block_response_of_odd_shapes(spark):
    flight = {"itinerary": [None, {"flight": "not this"}], "familyFares": {"A": {"one": 5, "hold": "so"}, "B": None, "C": 7, "D": {"all": "x", "inventory": {"seatsLeft": 3}}}}
    listed = {"itinerary": [{"flight": 8, "stops": ["Q", None]}], "familyFares": {"E": {"one": "12.5", "seats": 0, "id": "e"}}}
    flights = [flight, listed, listed, "x", None, {"itinerary": [], "familyFares": {"F": {}}}, {"itinerary": {"flight": "f"}, "familyFares": {"G": {}}},
               {"itinerary": ["text"], "familyFares": {"H": {"one": {"a": 1}}}}, {"itinerary": [{"stops": "3"}]}]
    response = {"flightSelections": {"currency": "BDT", "fareFamilies": [[{"code": "E", "name": "Eco", "cabin": "C"}], {"title": "no code"}], "flightBlocks": [
        {"from": "QQA", "into": {"k": 1}, "flightDates": [None, {"date": 5, "flights": flights}, {"date": "d", "flights": "none"}]}, "block", {"flightDates": {}}]},
        "flightSearchModel": {"flightSearchData": {"adultCount": "two", "childCount": 1}}}
    df = spark.createDataFrame([(json.dumps(response),), ("no json",), (None,), ('{"flightSelections": []}',)], "payload string")
    got = payloads.flatten_blocks(df)
    assert rows(got, "fare_basis", "fare_id", "flight_number", "search_date", "destination", "stops", "price_total", "seat_available", "soldout", "brand", "cabin", "adt_count", "chd_count") == sorted([
        ("A", "", None, "5", '{"k":1}', 0, 5, 0, True, "A", "Economy", None, 1), ("B", "", None, "5", '{"k":1}', 0, None, None, False, "B", "Economy", None, 1),
        ("C", "", None, "5", '{"k":1}', 0, None, None, False, "C", "Economy", None, 1), ("D", "", None, "5", '{"k":1}', 0, None, 3, False, "D", "Economy", None, 1),
        ("E", "e", "8", "5", '{"k":1}', 2, Decimal("12.5"), 0, True, "Eco", "Business", None, 1),
        ("H", "", None, "5", '{"k":1}', 0, None, None, False, "H", "Economy", None, 1)], key=str)


def test_via_texts_and_labels(spark):
    df = spark.createDataFrame([("aaa, BBB|x|AAA", "2", "total_price_bdt"), (None, "x", "my_field"), ("", "0", " ")],
                               "v string, s string, f string")
    got = df.select(split_via(F.col("v")), stops_label(F.col("s")), field_display_name(F.col("f"))).collect()
    assert [tuple(r) for r in got] == [(["AAA", "BBB"], "2 stops", "Total price"), ([], "Unknown", "My Field"), ([], "Direct", "-")]


def test_round_trip_windows_and_errors(spark):
    schema = ("outbound_dates array<date>, return_dates array<date>, return_offsets array<int>, trip_type string")
    d = [date(2026, 3, n) for n in (10, 12, 14)]
    plan = spark.createDataFrame([([d[0], d[2]], [d[1]], [2], "RT")], schema)
    assert rows(search.search_windows(plan), "departure_date", "return_date") == [(d[0], d[1]), (d[2], date(2026, 3, 16))]
    for bad in (([d[0]], None, [-1], "RT"), ([d[0]], None, None, "RT"), ([d[2]], [d[0]], None, "RT")):
        with pytest.raises(Exception):
            search.search_windows(spark.createDataFrame([bad], schema)).collect()


def test_equal_price_is_unknown_and_sold_out_wins(spark):
    df = spark.createDataFrame([(100.0, 100.0, True, False), (90.0, 100.0, True, False), (None, 100.0, True, False),
                                (1.0, None, False, False), (1.0, None, False, True)],
                               "min_total_price_bdt double, p double, seen boolean, soldout boolean")
    got = [r[0] for r in df.select(monitor.cell_signal(F.col("p"), F.col("seen"))).collect()]
    assert got == ["unknown", "decrease", "unknown", "new", "sold_out"]


def test_price_signal_confidence_and_regime(spark):
    event = "detected_at timestamp_ntz, domain string, change_type string, magnitude double, airline string, flight_number string, departure timestamp_ntz, from_timestamp timestamp_ntz, to_timestamp timestamp_ntz"
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, "price", "increase", 0.03, "A", "1", t, t, t), (t, "price", "decrease", 9.0, "A", "1", t, t, t),
                                (t, "seat", "decrease", 2.0, "B", "1", t, t, t)], event)
    signals = market.strategy_signals(df)
    assert rows(signals, "signal_type", "confidence") == [("INVENTORY_TIGHTENING", 0.8), ("PRICE_INCREASE", pytest.approx(0.2))]
    regimes = market.market_regime(market.aggregate_signals(signals, t))
    assert rows(regimes, "airline", "market_regime") == [("A", "MARKET_TESTING"), ("B", "YIELD_PROTECTION")]


def test_metrics_with_zero_actuals_and_no_turns(spark):
    df = spark.createDataFrame([("m", 0.0, 0.0, None), ("m", 2.0, 1.0, 2.0), ("m", None, 1.0, 1.0)],
                               "model string, actual double, pred double, prev double")
    got = forecast.error_metrics(df).first()
    assert (got["n"], got["mae"], got["mape_pct"], got["n_directional"]) == (2, 0.5, 50.0, 1)
    assert got["f1_up"] is None and got["f1_down"] == 0.0 and got["f1_macro"] == 0.0


def test_backtest_needs_room(spark):
    df = spark.createDataFrame([(date(2024, 1, n),) for n in range(1, 8)], "report_day date")
    assert forecast.backtest_splits(df).count() == 0


def test_time_split_is_exact_within_one_time(spark):
    df = spark.range(1000).select(F.lit(datetime(2024, 1, 1)).alias("observed_at_utc"), "id")
    split = inventory.time_split(df, 0.2)
    assert split.count() == 1000 and split.where("is_test").count() == 200


def test_censored_seats_and_sold_out_fallback(spark):
    base = dict(cycle_id="C1", probe_group_id=None, captured_at=datetime(2024, 1, 1), airline="VQ", origin="A", destination="B",
                flight_number="1", departure=datetime(2024, 1, 3), cabin="E", adt_count=1, chd_count=0, inf_count=0, booking_class=None,
                brand=None, aircraft=None, duration_min=None, arrival=None, inventory_confidence=None, seat_capacity=72, tax_amount=None)
    schema = ("cycle_id string, probe_group_id string, captured_at timestamp_ntz, airline string, origin string, destination string, "
              "flight_number string, departure timestamp_ntz, cabin string, adt_count int, chd_count int, inf_count int, booking_class string, "
              "brand string, aircraft string, duration_min int, arrival timestamp_ntz, inventory_confidence string, seat_capacity int, "
              "tax_amount double, fare_basis string, price_total double, seat_available int, soldout boolean")
    names = [p.strip().split()[0] for p in schema.split(",")]
    made = [dict(base, fare_basis="X", price_total=10.0, seat_available=9, soldout=False),
            dict(base, fare_basis="Y", price_total=5.0, seat_available=1, soldout=True)]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in made], schema)
    got = inventory.inventory_states(inventory.prepare_rows(df)).first()
    assert (got["lowest_open_fare"], got["open_bucket_count"], got["soldout_bucket_count"], got["inventory_proxy_quality"]) == (
        10.0, 1, 1, "censored")
    closed = inventory.inventory_states(inventory.prepare_rows(df.where("soldout"))).first()
    assert closed["lowest_open_fare"] == 5.0 and not closed["is_available"]


def test_two_stage_skips_with_reasons(spark):
    schema = "route_key string, flight_key string, probe_join_id string, adt_count int, observed_at_utc timestamp_ntz, x double, y_next_search_lowest_fare_delta double"
    t = datetime(2024, 1, 1)
    few = spark.createDataFrame([("R", str(i), "p", 1, t, float(i), 0.0) for i in range(20)], schema)
    features = models.FeatureSet(numeric=["x"])
    report = models.route_reports(few, features, ["R"])[0]
    assert report["two_stage_skipped"] and "Insufficient" in report["reason"]


def test_route_reports_roll_where_rows_suffice(spark):
    schema = "route_key string, flight_key string, probe_join_id string, adt_count int, observed_at_utc timestamp_ntz, x double, y_next_search_lowest_fare_delta double"
    made = [(route, str(i), "p", 1, datetime(2024, 1, 1 + i // 24, i % 24), float(i), 0.0) for route, n in (("A", 79), ("B", 80)) for i in range(n)]
    few = spark.createDataFrame(made, schema)
    features = models.FeatureSet(numeric=["x"])
    assert [r["folds_total"] for r in models.route_reports(few, features, ["A", "B"], 3)] == [None, 3]
    assert models.route_reports(few, features, ["B"], 1)[0]["folds_total"] is None


def test_two_stage_leaves_out_numbers_without_values(spark):
    schema = """flight_key string, probe_join_id string, adt_count int, observed_at_utc timestamp_ntz, x double, z double,
        y_next_search_lowest_fare_delta double"""
    made = [(str(i), "p", 1, datetime(2024, 1, 1 + i // 24, i % 24), float(i % 7), None if i < 100 else 1.0, float(i % 2)) for i in range(120)]
    result = models.two_stage(spark.createDataFrame(made, schema), models.FeatureSet(numeric=["x", "z"]), models.TwoStageParams(trees=2, max_depth=2))
    assert not result["skipped"] and result["scored"].count() == 24


@pytest.mark.parametrize("calibration", ["none", "isotonic", "sigmoid"])
def test_two_stage_after_a_table_was_observed(spark, calibration):
    # The session then holds something that can't go to a task.
    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 3}
    schema = """flight_key string, probe_join_id string, adt_count int, observed_at_utc timestamp_ntz, x double,
        y_next_search_lowest_fare_delta double"""
    made = [(str(i), "p", 1, datetime(2024, 1, 1 + i // 24, i % 24), float(i % 7), float(i % 7 > 2 and i % 5 > 0)) for i in range(120)]
    params = models.TwoStageParams(trees=2, max_depth=2, calibration=calibration)
    scored = models.two_stage(spark.createDataFrame(made, schema), models.FeatureSet(numeric=["x"]), params)["scored"].collect()
    assert len(scored) == 24 and all(0 <= r["p_move"] <= 1 for r in scored)


def test_move_classifier_of_two_classes_after_a_table_was_observed(spark):
    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 3}
    schema = """flight_key string, probe_join_id string, adt_count int, observed_at_utc timestamp_ntz, x double,
        y_next_search_price_move_class string"""
    made = [(str(i), "p", 1, datetime(2024, 1, 1 + i // 24, i % 24), float(i % 7), "up" if i % 7 > 2 else "down") for i in range(120)]
    got = models.move_classifier(spark.createDataFrame(made, schema), models.FeatureSet(numeric=["x"]))["metrics"].collect()
    assert {r["model"]: r["rows"] for r in got} == {"logistic": 24, "majority": 24}


def test_route_reports_query_covers_all_routes(spark, monkeypatch):
    from types import SimpleNamespace

    from farescope.catalog import q_models

    states = spark.createDataFrame([("R1-R2",), ("R3-R4",), ("R3-R4",), (None,), ("R0-R9",)], "route_key string")
    monkeypatch.setattr(q_models, "labelled", lambda ctx: (states, None))
    asked = []
    monkeypatch.setattr(models, "route_reports", lambda rows, features, routes, folds, params: asked.append((routes, folds)) or [])
    assert q_models._reports(SimpleNamespace(spark=spark)).count() == 0
    assert asked == [(["R0-R9", "R1-R2", "R3-R4"], 3)]


def test_unknown_airport_gives_no_utc(spark):
    df = spark.createDataFrame([("AAA", datetime(2024, 1, 1, 12)), ("ZZZ", datetime(2024, 1, 1, 12))], "origin string, departure timestamp_ntz")
    offsets = spark.createDataFrame([("AAA", -90)], "airport string, offset_minutes int")
    got = rows(ingest.to_utc(df, offsets), "departure_utc", "departure_tz_offset")
    assert got == sorted([(datetime(2024, 1, 1, 13, 30), "-01:30"), (None, None)], key=str)


def test_comparable_cycles_only(spark):
    schema = "cycle_id string, cycle_started_at_utc timestamp_ntz, cycle_completed_at_utc timestamp_ntz, offer_rows long, airline_count long, route_count long"
    t = datetime(2024, 1, 1)
    runs = spark.createDataFrame([("a", t, t, 500, 5, 10), ("b", t, datetime(2024, 1, 2), 499, 9, 99)], schema)
    assert rows(cycles.recent_cycles(runs), "cycle_id") == [("a",)]
    assert cycles.latest_cycle(runs, comparable_only=False).first()["cycle_id"] == "b"


def test_event_daily_falls_back_to_offers(spark):
    df = spark.createDataFrame([offer("1", "C1", "1"), offer("2", "C2", "2"), offer("3", "C3", "2", seats=4)], OFFER)
    empty = rollups.route_airline_summary(diff.diff_columns(diff.pair_states(df.limit(0), df.limit(0))))
    got = rows(forecast.event_daily(empty, df), "report_day", "price_events", "availability_events")
    assert got == [(date(2024, 1, 1), 0, 0), (date(2024, 1, 2), 1, 0), (date(2024, 1, 3), 0, 1)]


def test_expanding_folds_grow(spark):
    df = spark.range(40).select(F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(CAST(id AS INT))").alias("observed_at_utc"), "id")
    sizes = [(f.where("not is_test").count(), f.where("is_test").count()) for f in models.expanding_folds(df, 3)]
    assert sizes == [(10, 10), (20, 10), (30, 10)]


def test_stream_waits_for_whole_cycles_and_keeps_known_state(spark, tmp_path):
    from farescope.streaming import live

    feed, markers = str(tmp_path / "feed"), str(tmp_path / "markers")
    schema = spark.createDataFrame([], OFFER).schema
    days = [[offer("1", "C1", "1"), offer("4", "C1", "1", brand="NEXT")], [offer("2", "C2", "9", brand="OTHER")],
            [offer("3", "C3", "3"), offer("5", "C3", "1", brand="NEXT")]]
    state = live.DiffState(str(tmp_path / "state"))
    for made in days:
        for part in made:  # a file for each offer
            spark.createDataFrame([part], OFFER).coalesce(1).write.mode("append").partitionBy("cycle_id").parquet(feed)
        live.mark_complete(spark.createDataFrame(made, OFFER), markers)
        live.stream_diff(live.stream_files(spark, markers, live.MARKER),
                         lambda s, cycle: s.read.schema(schema).parquet(feed).where(F.col("cycle_id") == cycle),
                         state, str(tmp_path / "checkpoint"), keep_known=True)
    price = state.events(spark).where("field_name = 'price_total'")
    # The offers are compared with their last known rows, two cycles back; one has not changed.
    assert rows(price, "old_value", "new_value", "magnitude") == [("1.0", "3.0", 2.0)]
