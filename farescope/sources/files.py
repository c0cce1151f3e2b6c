"""File sources and sinks: archives, result dumps, forecast bundles, logs, stage tables, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farescope.functions import DIFF_KEY, first_rows
from farescope.operators.ingest import inventory_confidence

# Field names under which archived rows may carry a value, best first.
_CORE_ALIASES = {
    "airline": ["airline", "airlineCode"],
    "flight_number": ["flight_number", "flightNumber", "operatingFlightNumber"],
    "origin": ["origin", "task_origin"],
    "destination": ["destination", "task_destination"],
    "departure": ["departure"],
    "cabin": ["cabin", "cabinClass", "task_cabin"],
    "brand": ["brand", "brandId"],
    "fare_basis": ["fare_basis", "fareBasis", "bookingClass"],
    "price_total": ["price_total_bdt", "total_amount", "total", "price"],
    "seat_available": ["seat_available", "seatsRemaining", "seats_remaining_count", "seatsRemaining_count"],
    "seat_capacity": ["seat_capacity"],
}
_META_ALIASES = {
    "currency": ["currency"], "fare_amount": ["fare_amount", "fare"], "tax_amount": ["tax_amount", "taxes", "taxes_amount"],
    "baggage": ["baggage"], "aircraft": ["aircraft", "equipment", "aircraft_type"], "equipment_code": ["equipment_code"],
    "duration_min": ["duration_min", "duration"], "stops": ["stops"], "arrival": ["arrival"],
    "load_factor_pct": ["estimated_load_factor_pct"], "booking_class": ["booking_class", "bookingClass"],
    "soldout": ["soldout"], "adt_count": ["adt_count"], "chd_count": ["chd_count"], "inf_count": ["inf_count"],
    "fare_ref_num": ["fare_ref_num"], "fare_search_reference": ["fare_search_reference"], "raw_offer": ["raw_offer"],
}
_ALL_NAMES = list(dict.fromkeys(n for names in [*_CORE_ALIASES.values(), *_META_ALIASES.values()] for n in names))


def _text_schema() -> T.StructType:
    # Names that differ only in case cannot share a schema; the archives use each spelling once.
    return T.StructType([T.StructField(n, T.StringType()) for n in _ALL_NAMES])


def read_legacy(spark: SparkSession, path: str, fmt: str = "json", multi_line: bool = True,
                label: str = "legacy") -> tuple[DataFrame, DataFrame]:
    """Offers and side-car of an archive of JSON arrays or CSV files.

    Aliased fields are coalesced (blank counts as missing), values cast leniently, and the capture time
    comes from the file name, its folder, or the file time. The first row per identity is kept.
    """
    reader = spark.read
    if fmt == "csv":
        names = spark.read.option("header", True).csv(path).columns
        raw = reader.option("header", True).schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    else:
        raw = reader.option("multiLine", multi_line).schema(_text_schema()).json(path)
    present = set(raw.columns)
    file = F.col("_metadata.file_path")
    named = F.try_to_timestamp(F.nullif(F.regexp_extract(file, r"combined_results_(\d{8}T\d{6})Z", 1), F.lit("")),
                               F.lit("yyyyMMdd'T'HHmmss"))
    folder = F.try_to_timestamp(F.nullif(F.regexp_extract(file, r"batch_(\d{8}_\d{6})", 1), F.lit("")),
                                F.lit("yyyyMMdd_HHmmss"))
    captured = F.coalesce(named, folder, F.col("_metadata.file_modification_time")).cast("timestamp_ntz")

    def first(names: Sequence[str]) -> Column:
        found = [F.nullif(F.nullif(F.col(f"`{n}`"), F.lit("")), F.lit("None")) for n in names if n in present]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    def moment(value: Column) -> Column:
        iso = F.regexp_replace(value, r"(Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")
        other = [F.try_to_timestamp(value, F.lit(f)).cast("timestamp_ntz") for f in ("M/d/yyyy H:mm:ss", "M/d/yyyy")]
        return F.coalesce(iso, *other)

    def flag(value: Column) -> Column:
        text = F.lower(F.trim(value))
        return F.when(text.isin("true", "1", "y", "yes"), True).when(text.isin("false", "0", "n", "no"), False)

    def whole(value: Column) -> Column:
        return value.try_cast("double").try_cast("int")

    rows = raw.select("*", captured.alias("captured_at"), F.lit(label).alias("source_endpoint"))
    core = {n: first(a) for n, a in _CORE_ALIASES.items()}
    casts = {"departure": moment, "price_total": lambda v: v.try_cast("decimal(12,2)"), "seat_available": whole,
             "seat_capacity": whole, "airline": F.upper, "origin": F.upper, "destination": F.upper}
    core = {n: casts.get(n, lambda v: v)(c) for n, c in core.items()}
    meta = {n: first(a) for n, a in _META_ALIASES.items()}
    meta_casts = {"fare_amount": lambda v: v.try_cast("decimal(12,2)"), "tax_amount": lambda v: v.try_cast("decimal(12,2)"),
                  "load_factor_pct": lambda v: v.try_cast("decimal(6,2)"), "arrival": moment, "soldout": flag,
                  **{n: whole for n in ("duration_min", "stops", "adt_count", "chd_count", "inf_count")}}
    meta = {n: meta_casts.get(n, lambda v: v)(c) for n, c in meta.items()}
    iso = F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss")
    cycle = F.sha1(F.concat(F.lit(f"legacy:{label}:"), iso))
    flat = rows.select(
        "captured_at", "source_endpoint", cycle.alias("cycle_id"), *[c.alias(n) for n, c in core.items()],
        *[c.alias(f"m_{n}") for n, c in meta.items()])
    needed = ["airline", "flight_number", "origin", "destination", "departure", "price_total"]
    flat = flat.dropna(subset=needed)
    order = [F.col(c).asc_nulls_last() for c in ("price_total", "seat_available", "m_tax_amount", "m_fare_amount")]
    kept = first_rows(flat, ["cycle_id", *DIFF_KEY], order)
    ident = F.sha1(F.concat_ws("|", "cycle_id", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in DIFF_KEY]))
    kept = kept.withColumn("offer_id", ident)
    offers = kept.select("offer_id", "cycle_id", "captured_at", *core)
    side = kept.select(F.concat("offer_id", F.lit("#1")).alias("meta_id"), "offer_id", "captured_at", "source_endpoint",
                       inventory_confidence(F.col("seat_available")).alias("inventory_confidence"),
                       *[F.col(f"m_{n}").alias(n) for n in meta])
    return offers, side


def read_results(spark: SparkSession, path: str, schema: T.StructType | str, whole_file: bool = False) -> DataFrame:
    """Result dumps with one object per line, one array per line, or one array per file."""
    return spark.read.option("multiLine", whole_file).schema(schema).json(path)


# ---------------------------------------------------------------- forecast bundles

# File kinds of a forecast bundle, longest prefix first.
BUNDLE_KINDS = {
    "backtest_eval_by_route": "has_backtest_route_eval",
    "backtest_route_winners": "has_backtest_route_winner",
    "backtest_splits": "has_backtest_splits",
    "backtest_eval": "has_backtest_eval",
    "backtest_meta": "has_backtest_meta",
    "eval_by_route": "has_route_eval",
    "route_winners": "has_route_winner",
    "next_day": "has_next_day",
    "eval": "has_overall_eval",
}
_NAME = rf"([^/]*)/prediction_({'|'.join(BUNDLE_KINDS)})_(.+)_(\d{{8}}_\d{{6}})\.(csv|json)"


def _bundle_columns(path: Column) -> dict[str, Column]:
    part = {n: F.regexp_extract(path, _NAME, i) for i, n in ((1, "bundle_name"), (2, "kind"), (3, "target"), (4, "stamp"))}
    return {**part, "bundle_id": F.concat_ws("|", part["bundle_name"], part["target"], part["stamp"])}


def scan_bundles(spark: SparkSession, root: str) -> DataFrame:
    """Forecast bundles under a folder: newest file time and which kinds of file each has.

    Only the file listing is read. A file may be a single CSV or a folder of parts written by Spark.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime")
    rows = files.select("modificationTime", *[c.alias(n) for n, c in _bundle_columns(F.col("path")).items()]).where("kind <> ''")
    return rows.groupBy("bundle_id", "bundle_name", "target", "stamp").agg(
        F.max("modificationTime").alias("bundle_created_at_utc"),
        *[F.max(F.col("kind") == k).alias(flag) for k, flag in BUNDLE_KINDS.items()])


def load_bundle_fact(spark: SparkSession, root: str, kind: str, schema: T.StructType | str,
                     declared: Sequence[str] = ()) -> DataFrame:
    """Typed rows of one kind of bundle file with the bundle columns.

    Adds ``route_key`` where the rows name a route, and declared columns the files lack as NULL.
    """
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.csv").schema(schema).csv(f"{root}/*/prediction_{kind}_*")
    parts = _bundle_columns(F.col("_metadata.file_path"))
    out = raw.select("*", *[c.alias(n) for n, c in parts.items()]).where(F.col("kind") == kind).drop("kind")
    if {"origin", "destination"} <= set(raw.columns):
        out = out.withColumn("route_key", F.concat("origin", F.lit("-"), "destination"))
    for name in declared:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("double"))
    return out


# ---------------------------------------------------------------- logs

_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),\d+\s+\[([A-Z]+)\]\s+([^:]+):\s*(.*)$"


def read_logs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Log lines as (file, ts, level, logger, message); other lines are skipped."""
    lines = spark.read.text(list(paths) if not isinstance(paths, str) else paths)
    parts = [F.regexp_extract("value", _LINE, i) for i in (1, 2, 3, 4)]
    return lines.where(F.col("value").rlike(_LINE)).select(
        F.col("_metadata.file_path").alias("file"), parts[0].cast("timestamp_ntz").alias("ts"), parts[1].alias("level"),
        parts[2].alias("logger"), parts[3].alias("message"))


# ---------------------------------------------------------------- sinks


def stage_types(df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Columns in stage types: nested values as JSON text, declared columns cast leniently."""
    declared = {f.name: f.dataType for f in schema.fields} if schema else {}
    out = []
    for f in df.schema.fields:
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            value = F.to_json(value)
        elif f.name in declared:
            value = value.try_cast(declared[f.name])
        out.append(value.alias(f.name))
    return df.select(*out)


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = (), schema: T.StructType | None = None) -> None:
    """Write a stage table as Parquet."""
    writer = stage_types(df, schema).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def load_table(df: DataFrame, path: str, mode: str = "append", partition_by: Sequence[str] = ()) -> None:
    """Append to or replace a warehouse table under its existing columns."""
    spark = df.sparkSession
    target = df
    try:
        existing = spark.read.parquet(path).schema
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        existing = None
    if existing is not None and mode == "append":
        target = df.select(*[
            (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in existing.fields])
    writer = target.write.mode("append" if mode == "append" else "overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv_pair(df: DataFrame, folder: str, name: str, stamp: str) -> tuple[str, str]:
    """Write a report as ``name_stamp`` and its copy ``name_latest``; the copy reads the first."""
    run, latest = f"{folder}/{name}_{stamp}", f"{folder}/{name}_latest"
    df.write.mode("overwrite").option("header", True).csv(run)
    written = df.sparkSession.read.option("header", True).schema(
        T.StructType([T.StructField(f.name, T.StringType()) for f in df.schema.fields])).csv(run)
    written.write.mode("overwrite").option("header", True).csv(latest)
    return run, latest
