"""What is shuffled, and how often state is asked: plans and counts that must not grow faster than the input."""

import random
import re
from contextlib import contextmanager, redirect_stdout
from io import StringIO

import pandas as pd
import pytest

from farescope import fixtures
from farescope.catalog import base, change_source, q_inventory, q_monitor  # noqa: F401
from farescope.catalog.base import Context
from pyspark.sql import functions as F
from farescope.operators import ingest, monitor, quality

NAMES = {
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N", 0), (1, "M", 1)]),
    "customer": ("c_custkey long, c_nationkey int", [(1, 0), (2, 1)]),
    "supplier": ("s_suppkey long, s_nationkey int", [(1, 0), (2, 1), (2, 1)]),
    "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string",
               [(1, 1, "F", "P1"), (2, 2, "O", None), (3, None, "O", "P2"), (4, 9, "P", "P1")]),
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                 "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz", None),
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    for name, (schema, made) in NAMES.items():
        if made is None:
            parts = [(o, p, s, n, 4.0, 10.0 * p + n, 0.05, 0.02, "A", "O") for o in (1, 2, 3, 4, None) for p in (1, 2) for s in (1, 2, 7) for n in (1, 2)]
            df = spark.createDataFrame(parts, schema.rsplit(",", 1)[0]).selectExpr(
                "*", "timestamp_ntz'1998-01-02' + make_dt_interval(CAST(120 * (l_linenumber - 1) AS INT)) AS l_shipdate")
        else:
            df = spark.createDataFrame(made, schema)
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@contextmanager
def no_broadcast_by_size(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    out = StringIO()
    with redirect_stdout(out):
        df.explain(True)
    return out.getvalue().split("== Physical Plan ==")


def test_line_items_are_shuffled_to_their_orders_only(spark, tables):
    with no_broadcast_by_size(spark):
        offers = Context(spark, tables).offers
        assert "hashpartitioning(l_suppkey" not in plan(offers)[1]
        got = sorted(tuple(r) for r in offers.selectExpr("offer_id", "origin", "destination", "fare_basis").collect())
    # Supplier 2 is there twice; suppliers 7 and orders 3 and 4 lead nowhere.
    want = [(f"{o}-{n}-{p}-{s}", f"R{s - 1}", f"R{o - 1}", "P1" if o == 1 else None)
            for o in (1, 2) for p in (1, 2) for s in (1, 2, 2) for n in (1, 2)]
    assert got == sorted(want)


def test_only_states_take_a_side_car(spark, tables):
    text = plan(change_source.pairs(Context(spark, tables)))[0].split("== Optimized Logical Plan ==")[1]
    assert text.index("Join LeftOuter") < text.index("windowspecdefinition(cycle_id")


def test_top_routes_do_not_shuffle_the_offers(spark, tables):
    ctx = Context(spark, tables)
    with no_broadcast_by_size(spark):
        cells = monitor.monitor_cells(ctx.offers, ctx.meta_with(q_monitor._SIDE), spark.createDataFrame([("R0", "R1")], "origin string, destination string"))
        assert "hashpartitioning(origin" not in plan(cells)[1].replace("hashpartitioning(cycle_id", "")
        assert {(r["origin"], r["destination"], r["route_key"]) for r in cells.collect()} == {("R0", "R1", "R0-R1")}


def test_repeats_ask_the_state_once_a_cycle():
    pytest.importorskip("google.protobuf")
    from farescope.streaming import keyed

    class Waiting(dict):
        asked = 0

        def containsKey(self, key):
            self.asked += 1
            return key in self

        getValue = dict.__getitem__
        updateValue = dict.__setitem__

    class Handle:
        timers = []

        def registerTimer(self, at):
            self.timers.append(at)

    pairs = keyed.Pairs()
    pairs.handle, pairs.waiting = Handle(), Waiting()
    batch = pd.DataFrame({"cycle_no": [1] * 50 + [2, 2, 2], "newer": [f"{i:02d}" for i in range(50)] + ["5", "5", None],
                          "row": [f"r{i}" for i in range(50)] + ["first", "second", None]})
    list(pairs.handleInputRows(("x",), iter([batch]), None))
    assert pairs.waiting == {(1,): ("49", "r49"), (2,): ("5", "first")} and pairs.waiting.asked == 2
    list(pairs.handleInputRows(("x",), iter([batch.head(10)]), None))
    assert pairs.waiting[(1,)] == ("49", "r49")


def test_partitions_follow_the_line_items(spark, tables, monkeypatch):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        base.run(spark, tables, "dq_duplicates")
        assert [spark.conf.get(n) for n in names] == before
        monkeypatch.setattr(base, "ROWS_A_TASK", 4)
        base.run(spark, tables, "dq_duplicates")
        # 60 line items.
        assert [spark.conf.get(n) for n in names] == ["15", "16m"]
        spark.conf.set(names[0], "40")
        base.run(spark, tables, "dq_duplicates")
        assert spark.conf.get(names[0]) == "40"
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def test_offers_are_shuffled_to_their_states_once(spark, tables):
    with no_broadcast_by_size(spark):
        states = q_inventory.computed_states(Context(spark, tables))
        text = plan(states)[1]
    assert len(re.findall(r"Exchange hashpartitioning\(cycle_id#\d+, probe_group_id", text)) == 1
    row = states.where("adt_count IS NOT NULL").first()
    assert (row["route_key"], row["dep_time_min"]) == (f"{row['origin']}-{row['destination']}", row["departure"].hour * 60 + row["departure"].minute)


def test_quality_report_reads_offers_with_side_cars_once(spark, tables):
    ctx = Context(spark, tables)
    # Repeats, and rows of which every field is missing.
    offers = ctx.offers.unionByName(ctx.offers.limit(7)).unionByName(ctx.offers.limit(3).selectExpr("offer_id", *[f"CAST(NULL AS {t}) AS {n}" for n, t in ctx.offers.dtypes[1:]]))
    offers = offers.localCheckpoint()
    routes = spark.createDataFrame([("A1", "R0", "R1"), ("A9", "R0", "R1")], "airline string, origin string, destination string")
    report = quality.dq_report(offers, ctx.meta, routes)
    assert plan(report)[0].split("== Optimized Logical Plan ==")[1].count("Join LeftOuter") == 1
    got = {(r["category"], r["metric"]): r["value"] for r in report.collect()}
    for r in quality.dq_nulls(offers, ctx.meta).collect():
        assert got[r["scope"], f"{r['field']}_null_count"] == str(r["null_count"])
        assert got[r["scope"], f"{r['field']}_null_rate_pct"] == str(r["null_rate_pct"])
    for one in (quality.dq_summary(offers), quality.dq_duplicates(offers), quality.meta_coverage(offers, ctx.meta)):
        row = one.first().asDict()
        for (category, metric), value in got.items():
            if metric in row and category != "route_coverage":
                assert value == str(row[metric])
    # No rows give figures as well.
    none = {(r["category"], r["metric"]): r["value"] for r in quality.dq_report(offers.limit(0), ctx.meta, routes).collect()}
    assert none["summary", "total_rows"] == none["duplicates", "duplicate_rows"] == none["null_core", "brand_null_count"] == "0"
    assert none["null_core", "brand_null_rate_pct"] is None and none["null_raw_meta", "soldout_null_count"] == "0" and set(none) == set(got)


@contextmanager
def not_adaptive(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with no_broadcast_by_size(spark):
            yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_offers_and_side_cars_share_a_shuffle_of_the_line_items(spark, tables):
    ctx = Context(spark, tables)
    with not_adaptive(spark):
        text = plan(q_monitor.cells(ctx))[1]
        assert len(re.findall(r"- Exchange hashpartitioning\(l_orderkey", text)) == 1 and "ReusedExchange" in text
        both = plan(q_monitor._cells_bq(ctx))[1]
        # Offers and side-cars: an exchange each, for the cells and for the tax lookup.
        assert len(re.findall(r"- Exchange hashpartitioning\(offer_id", both)) == 2
    plain = lambda df, c: sorted(tuple(map(str, r)) for r in df.select(*sorted(c)).collect())
    assert plain(ctx.sharing.offers, ctx.offers.columns) == plain(ctx.offers, ctx.offers.columns)
    assert plain(ctx.sharing.meta, ctx.meta.columns) == plain(ctx.meta, ctx.meta.columns)


def test_monitor_routes_take_no_side_car(spark, tables):
    ctx = Context(spark, tables)
    base._STORED.pop((fixtures.session_key(spark), tables, "monitor-routes"), None)
    q_monitor.cells(ctx)
    path, schema = base._STORED[fixtures.session_key(spark), tables, "monitor-routes"]
    assert schema.fieldNames() == ["origin", "destination"]
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == sorted(
        {(r[0], r[1]) for r in ctx.offers.where("cycle_id = '1998-04-01'").select("origin", "destination").collect()})


def test_stored_tables_leave_no_shuffle(spark, tables):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen = spark.conf.get(name), []
    with base.shuffles_removed(spark):
        seen.append(spark.conf.get(name))
    assert seen == ["true"] and spark.conf.get(name) == before


def test_ends_of_a_cell_with_missing_classes_and_seats(spark, tables):
    """Against the definition: rows in order of price, seats and value, those without the value left out."""
    ctx, chosen = Context(spark, tables), random.Random(7)
    n = 400
    made = [(f"x{i}", f"C{i % 60}", chosen.choice([None, 10, 20, 30]), chosen.choice([None, 1, 2, 3]), chosen.choice([None, "Y", "M"])) for i in range(n)]
    rows = spark.createDataFrame(made, "offer_id string, cycle_id string, price_total int, seat_available int, fare_basis string")
    offers = ctx.offers.limit(1).drop("offer_id", "cycle_id", "price_total", "seat_available", "fare_basis").crossJoin(
        rows.withColumn("price_total", F.col("price_total").cast("decimal(12,2)"))).localCheckpoint()
    got = {r["cycle_id"]: r for r in monitor.monitor_cells(offers, ctx.meta.limit(0)).collect()}
    for cycle in {m[1] for m in made}:
        mine = [m[2:] for m in made if m[1] == cycle]
        for sign, end in ((1, "min"), (-1, "max")):
            def first(value):
                found = [((p is None, sign * (p or 0)), (s is None, -(s or 0)), v) for p, s, c in mine for v in [s if value else c] if v is not None]
                return min(found)[2] if found else None
            assert (got[cycle][f"{end}_booking_class"], got[cycle][f"{end}_seat_available"]) == (first(False), first(True))


def test_backfill_joins_offers_and_side_cars_once(spark, tables, monkeypatch):
    ctx = Context(spark, tables)
    store = spark.createDataFrame([("p1", '{"fare_ref_num":"S1","source":"x"}'), ("p2", None)], "fingerprint string, payload_json string")
    names = ("meta_id string, offer_id string, fare_ref_num string, fare_search_reference string, raw_offer string, payload_fingerprint string, arrival timestamp_ntz, "
             + ", ".join(f"{n} string" for n in ("inventory_confidence", "source_endpoint", "departure_tz_offset", "arrival_tz_offset")) + ", "
             + ", ".join(f"{n} timestamp_ntz" for n in ("departure_local", "departure_utc", "arrival_utc")) + ", adt_count int, chd_count int, inf_count int")
    # Two rows of one offer, a row of an offer that is not there, and one of none; other offers have no row.
    made = [("m1", "1-1-1-1", None, None, None, "p1"), ("m2", "1-1-1-1", "F", None, '{"fare_ref_num":"own","fare_search_reference":"s"}', "p1"),
            ("m3", "nowhere", None, None, None, "p2"), ("m4", None, None, None, "no json", None)]
    meta = spark.createDataFrame([(*r, *[None] * 11) for r in made], names)
    offers = ctx.offers.where("offer_id IN ('1-1-1-1', '1-2-1-1')").localCheckpoint()
    show = lambda df: sorted(tuple(map(str, r)) for r in df.select("meta_id", "offer_id", "fare_ref_num", "fare_search_reference", "source_endpoint", "adt_count").collect())
    filled, counts = ingest.backfill_meta(offers, meta, store, ctx.offsets)
    want = [("1-2-1-1#0", "1-2-1-1", "None", "None", "legacy/unknown", "1"), ("m1", "1-1-1-1", "S1", "None", "legacy/unknown", "1"),
            ("m2", "1-1-1-1", "F", "s", "legacy/unknown", "1"), ("m3", "nowhere", "None", "None", "None", "1"), ("m4", "None", "None", "None", "None", "1")]
    assert show(filled) == want
    assert {r["step"]: r["rows"] for r in counts.collect()} == {
        "insert_missing_raw_meta": 1, "inventory_confidence": 2, "source_endpoint": 2, "pax_defaults": 4, "departure_timestamps": 2, "arrival_timestamps": 2, "fare_references": 2}
    text = plan(filled)[0].split("== Optimized Logical Plan ==")[1]
    assert "LeftAnti" not in text and text.count("Join FullOuter") == 1 and "__salt" not in text
    # A store of many payloads is joined by salted keys.
    monkeypatch.setattr(ingest, "bounded_broadcast", lambda df: df)
    many = ingest.backfill_meta(offers, meta, store, ctx.offsets)[0]
    assert show(many) == want and "__salt" in plan(many)[0]
