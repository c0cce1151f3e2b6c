"""Streams with state per key: restarts, repeats, rows in any order, gaps."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from farescope.operators import diff, rollups
from farescope.streaming import keyed, live
from test_units import OFFER, offer, rows

DAYS = {
    1: [offer("1", "C1", "100"), offer("2", "C1", "50", brand=None), offer("3", "C1", "70", brand="GONE")],
    2: [offer("4", "C2", "90"), offer("5", "C2", "50", brand=None), offer("6", "C2", "10", brand="NEW")],
    3: [offer("8", "C3", "50", brand=""), offer("9", "C3", "12", brand="NEW")],
    4: [offer("10", "C4", "95"), offer("11", "C4", "75", brand="GONE"), offer("12", "C4", "12", brand="NEW", seats=4)],
}
KEPT = ("cycle_id", "previous_cycle_id", "detected_at", "brand", "field_name", "change_type", "old_value", "new_value", "magnitude")


def fed(spark, tmp, days, files=2):
    for no in days:
        keyed.feed_cycle(spark.createDataFrame(DAYS[no], OFFER), f"{tmp}/feed", f"{tmp}/markers", no, f"C{no}", files)


def read(spark, tmp, **options):
    stream = live.stream_files(spark, f"{tmp}/feed", keyed.FEED, 1)
    keyed.keyed_diff(stream, f"{tmp}/markers", spark.createDataFrame([], OFFER).schema, f"{tmp}/events", f"{tmp}/checkpoint", **options)
    return spark.read.option("recursiveFileLookup", True).parquet(f"{tmp}/events")


def batch(spark, upto):
    every = spark.createDataFrame([r for no in range(1, upto + 1) for r in DAYS[no]], OFFER)
    return diff.diff_columns(diff.pair_consecutive(diff.cycle_states(every)))


def test_keyed_diff_goes_on_after_a_restart(spark, tmp_path):
    fed(spark, tmp_path, [1, 2])
    assert rows(read(spark, tmp_path), *KEPT) == rows(batch(spark, 2), *KEPT)
    fed(spark, tmp_path, [3, 4], 1)
    got = read(spark, tmp_path)
    assert rows(got, *KEPT) == rows(batch(spark, 4), *KEPT)
    assert rows(got, *KEPT) == rows(read(spark, tmp_path), *KEPT)  # nothing new, nothing twice
    back = got.where("brand = 'GONE'").select("cycle_id", "previous_cycle_id", "change_type")
    assert rows(back, "cycle_id", "previous_cycle_id", "change_type") == sorted([("C1", None, "added"), (None, "C1", "removed"), ("C4", None, "added")], key=str)


def test_a_batch_that_failed_is_repeated_whole(spark, tmp_path, monkeypatch):
    fed(spark, tmp_path, [1, 2, 3])
    plain, calls = keyed.diff_columns, []

    def fails_once(pairs, fields=None):
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("lost")
        return plain(pairs, fields)

    monkeypatch.setattr(keyed, "diff_columns", fails_once)
    with pytest.raises(Exception, match="lost"):
        read(spark, tmp_path)
    assert rows(read(spark, tmp_path), *KEPT) == rows(batch(spark, 3), *KEPT)


def test_of_repeats_in_other_files_the_newest_counts(spark, tmp_path):
    fed(spark, tmp_path, [1])
    later = spark.createDataFrame([offer("7", "C2", "91"), offer("70", "C2", "92")], OFFER).withColumn("captured_at", F.expr("timestamp_ntz'2024-01-02 05:00:00'"))
    first = spark.createDataFrame(DAYS[2], OFFER)
    # The marker comes after all files of a cycle; here the repeats lie in files of their own before it.
    keyed.feed_cycle(later, f"{tmp_path}/other", f"{tmp_path}/unused", 2, "C2")
    spark.read.schema(keyed.FEED).parquet(f"{tmp_path}/other").where("row IS NOT NULL").withColumn(
        "started_at", F.expr("timestamp_ntz'2024-01-02'")).write.mode("append").parquet(f"{tmp_path}/feed")
    keyed.feed_cycle(first, f"{tmp_path}/feed", f"{tmp_path}/markers", 2, "C2")
    got = read(spark, tmp_path).where("field_name = 'price_total' AND brand = 'B'")
    assert [r[0] for r in rows(got, "old_value", "new_value")] == ["100.0"]
    every = spark.createDataFrame(DAYS[1], OFFER).unionByName(first).unionByName(later)
    want = diff.diff_columns(diff.pair_consecutive(diff.cycle_states(every)))
    assert rows(read(spark, tmp_path), *KEPT) == rows(want, *KEPT)


def test_known_rows_stay_known(spark, tmp_path):
    fed(spark, tmp_path, [1, 2, 3, 4])
    got = read(spark, tmp_path, keep_known=True)
    assert got.where("change_type = 'removed' AND field_name = '__row_presence__'").count() == 0
    price = rows(got.where("field_name = 'price_total' AND brand = 'GONE'"), "previous_cycle_id", "cycle_id", "old_value", "new_value")
    assert price == [("C1", "C4", "70.0", "75.0")]


SIGNALS = "airline string, flight_key string, detected_at timestamp_ntz, signal_category string, signal_type string, severity double, confidence double"


def signal(hours, flight="f", severity=1.0, kind="PRICE_ACTION", confidence=0.5):
    return ("A", flight, datetime(2024, 1, 1) + timedelta(hours=hours), kind, "INVENTORY_TIGHTENING" if kind == "CAPACITY_ACTION" else "X", severity, confidence)


def test_panes_equal_sliding_windows(spark, tmp_path):
    made = [signal(0.2), signal(0.9, severity=-2.0), signal(1.0), signal(23.99, kind="CAPACITY_ACTION"), signal(24.0), signal(90.5, "g", None),
            signal(91, "g", confidence=None), signal(300, "f"), signal(2.5, None)]
    feed = str(tmp_path / "feed")
    for row in made:  # a batch for each signal, times going up and down within the watermark
        spark.createDataFrame([row], SIGNALS).coalesce(1).write.mode("append").parquet(feed)
    spark.createDataFrame([(None, None, datetime(2024, 3, 1), None, None, None, None)], SIGNALS).coalesce(1).write.mode("append").parquet(feed)
    stream = live.stream_files(spark, feed, spark.createDataFrame([], SIGNALS).schema, 2)
    keyed.write_append(keyed.trailing_panes(stream, watermark="20 days"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    names = ("airline", "flight_key", "pricing_event_count", "net_price_delta", "capacity_event_count", "tightening_score", "mean_confidence", "price_trend")
    got = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/out").withColumn("start", F.col("window_start").cast("string"))
    table = spark.createDataFrame(made, SIGNALS).withColumn("event_time", F.col("detected_at").cast("timestamp"))
    from farescope.operators.market import signal_labels, signal_measures

    want = signal_labels(table.groupBy(F.window("event_time", "24 hours", "1 hour"), "airline", "flight_key").agg(*signal_measures())).withColumn(
        "start", F.col("window.start").cast("timestamp_ntz").cast("string"))
    assert rows(got, "start", *names) == rows(want, "start", *names)
    with pytest.raises(ValueError, match="multiple"):
        keyed.Panes(10, 3)


def test_days_close_once_with_exact_counts(spark, tmp_path):
    events = batch(spark, 4).withColumn("flight_number", F.concat("flight_number", F.coalesce("brand", F.lit("-"))))
    feed = str(tmp_path / "feed")
    for day in ("2024-01-02", "2024-01-01", "2024-01-04", "2024-01-03"):
        events.where(F.to_date("detected_at") == day).coalesce(1).write.mode("append").parquet(feed)
    stream = live.stream_files(spark, feed, events.schema, 1)
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    keyed.write_append(live.day_rollups(stream, "36 hours"), out, checkpoint)
    got = spark.read.option("recursiveFileLookup", True).parquet(out)
    # Days that the watermark has not passed stay open.
    assert [str(r[0]) for r in got.select("report_day").distinct().orderBy("report_day").collect()] == ["2024-01-01"]
    last = events.limit(1).withColumn("detected_at", F.expr("timestamp_ntz'2024-02-01'"))
    last.coalesce(1).write.mode("append").parquet(feed)
    keyed.write_append(live.day_rollups(live.stream_files(spark, feed, events.schema, 1), "36 hours"), out, checkpoint)
    got, want = spark.read.option("recursiveFileLookup", True).parquet(out), rollups.daily_rollups(events)
    assert rows(got, *want.columns) == rows(want, *want.columns)


def test_repeats_of_a_file_are_settled_before_the_shuffle(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    names = pa.schema([("cycle_no", pa.int64()), ("identity", pa.string()), ("newer", pa.string()), ("row", pa.string())])
    made = [(1 + i % 2, "ab"[i // 2 % 2], f"{i:03d}", f"r{i}") for i in range(40)] + [(1, None, None, None), (2, "a", None, "x")]
    parts = [pa.RecordBatch.from_pylist([dict(zip(names.names, r)) for r in made[i:i + 6]], names) for i in range(0, len(made), 6)]
    found = [tuple(r.values()) for b in keyed.settle_repeats(iter(parts)) for r in b.to_pylist()]
    assert sorted(found, key=str) == sorted([(1, "a", "036", "r36"), (2, "a", "037", "r37"), (1, "b", "038", "r38"), (2, "b", "039", "r39"), *made[40:]], key=str)
    # In pieces, more rows stay, and the newest are among them.
    monkeypatch.setattr(keyed, "SETTLED", 6)
    pieces = [tuple(r.values()) for b in keyed.settle_repeats(iter(parts)) for r in b.to_pylist()]
    assert len(found) < len(pieces) < len(made) and set(found) <= set(pieces)


def test_a_cycle_is_fed_without_a_shuffle(spark, tmp_path):
    table = spark.createDataFrame(DAYS[1] * 3, OFFER).repartition(6)
    table.write.parquet(f"{tmp_path}/rows")
    keyed.feed_cycle(spark.read.parquet(f"{tmp_path}/rows"), f"{tmp_path}/feed", f"{tmp_path}/markers", 1, "C1", 2)
    names = [p.name for p in (tmp_path / "feed").glob("part-*.parquet")]
    assert len(names) <= 3 and sum(".zstd." in n for n in names) >= 1
    assert spark.read.parquet(f"{tmp_path}/feed").where("row IS NOT NULL").count() == 9
