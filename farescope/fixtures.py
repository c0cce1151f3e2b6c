"""Offer and side-car tables derived from the given test tables, for Spark and for DuckDB.

Both engines get the same derivation. Most expressions are plain SQL that the two share; the
few that differ (cycle text, minute arithmetic) are listed per dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farescope.functions import bounded_broadcast, shuffled_once

# {cycle} and {plus_minutes} differ per dialect.
_DIALECT = {
    "spark": {
        "cycle": "date_format(date_trunc('quarter', l_shipdate), 'yyyy-MM-dd')",
        "plus": "({ts} + make_dt_interval(0, 0, {minutes}, 0))",
    },
    "duckdb": {
        "cycle": "strftime(date_trunc('quarter', l_shipdate), '%Y-%m-%d')",
        "plus": "({ts} + to_minutes({minutes}))",
    },
}

_DEPARTURE = ("(CASE WHEN l_partkey % 2 = 0 THEN CAST('2030-01-01 06:00:00' AS {ntz}) "
              "ELSE CAST('2030-01-02 18:30:00' AS {ntz}) END)")

_FEES = {
    "fare_change_fee_before_24h": 1000,
    "fare_change_fee_within_24h": 1500,
    "fare_change_fee_no_show": 2000,
    "fare_cancel_fee_before_24h": 1500,
    "fare_cancel_fee_within_24h": 2500,
    "fare_cancel_fee_no_show": 3000,
}

# Offset minutes and country per airport code of the derived routes.
AIRPORT_OFFSETS = {"R0": 360, "R1": 330, "R2": -300, "R3": 0}
AIRPORT_COUNTRIES = {"R0": "X", "R1": "X", "R2": "Y", "R3": "Z"}

OFFER_COLUMNS = [
    "offer_id", "cycle_id", "captured_at", "airline", "flight_number", "origin", "destination", "departure",
    "cabin", "brand", "price_total", "fare_basis", "seat_capacity", "seat_available",
]

META_COLUMNS = [
    "meta_id", "offer_id", "currency", "fare_amount", "tax_amount", "baggage", "aircraft", "equipment_code",
    "duration_min", "stops", "via_airports", "arrival", "load_factor_pct", "inventory_confidence",
    "booking_class", "soldout", "adt_count", "chd_count", "inf_count", "probe_group_id", "search_trip_type",
    "trip_request_id", "requested_outbound_date", "requested_return_date", "trip_duration_days", "trip_origin",
    "trip_destination", "leg_direction", "leg_sequence", "itinerary_leg_count", "departure_local",
    "departure_utc", "departure_tz_offset", "arrival_utc", "arrival_tz_offset", "fare_ref_num",
    "fare_search_reference", "source_endpoint", "payload_fingerprint", "payload_storage", "penalty_source",
    "penalty_currency", "penalty_rule_text", *_FEES, "fare_changeable", "fare_refundable", "raw_offer",
    "captured_at",
]


def _expressions(dialect: str) -> dict[str, str]:
    ntz = "TIMESTAMP_NTZ" if dialect == "spark" else "TIMESTAMP"
    d = _DIALECT[dialect]
    dep = _DEPARTURE.format(ntz=ntz)
    minutes = "CAST(45 + l_partkey % 200 AS INT)"
    arrival = d["plus"].format(ts=dep, minutes=minutes)
    price = "CAST(l_extendedprice AS DECIMAL(12,2))"
    origin, destination = "concat('R', o_regionkey)", "concat('R', d_regionkey)"
    trip = "(CASE WHEN o_orderstatus = 'F' THEN 'RT' WHEN o_orderstatus = 'P' THEN NULL ELSE 'OW' END)"
    out = {
        "offer_id": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)",
        "cycle_id": d["cycle"],
        "captured_at": f"CAST(l_shipdate AS {ntz})",
        "airline": "concat('A', l_suppkey % 5)",
        "flight_number": "concat('F', l_partkey % 3)",
        "origin": origin,
        "destination": destination,
        "departure": dep,
        "cabin": "l_linestatus",
        "brand": "CASE WHEN l_discount >= 0.05 THEN 'FLEX' ELSE 'SAVER' END",
        "price_total": price,
        "fare_basis": "o_orderpriority",
        "seat_capacity": "50",
        "seat_available": "CAST(l_quantity AS INT) - 1",
        "currency": "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE 'BDT' END",
        "fare_amount": f"CAST({price} * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(12,2))",
        "tax_amount": f"CASE WHEN l_tax > 0 THEN CAST({price} * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(12,2)) END",
        "baggage": "CASE WHEN l_discount > 0.02 THEN '20KG' END",
        "aircraft": "CASE l_suppkey % 4 WHEN 0 THEN 'Boeing 737-800' WHEN 1 THEN 'ATR 72-600' "
                    "WHEN 2 THEN 'Airbus A320' END",
        "equipment_code": "CASE l_suppkey % 4 WHEN 0 THEN '738' WHEN 2 THEN '320' END",
        "duration_min": minutes,
        "stops": "CAST(l_linenumber % 3 AS INT)",
        "via_airports": "CASE l_linenumber % 3 WHEN 1 THEN 'AAA' WHEN 2 THEN 'AAA|BBB' END",
        "arrival": arrival,
        "load_factor_pct": "CAST((51 - CAST(l_quantity AS INT)) * 2 AS DECIMAL(6,2))",
        "inventory_confidence": "CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 7 = 0 THEN 'unknown' "
                                "ELSE 'reported' END",
        "booking_class": "CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_returnflag END",
        "soldout": "l_quantity = 1",
        "adt_count": "CAST(1 + l_linenumber % 3 AS INT)",
        "chd_count": "CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE 0 END",
        "inf_count": "0",
        "probe_group_id": f"CASE WHEN l_orderkey % 3 = 0 THEN concat('P', {d['cycle']}) END",
        "search_trip_type": trip,
        "trip_request_id": "concat('T', l_orderkey % 4)",
        "requested_outbound_date": f"CAST({dep} AS DATE)",
        "requested_return_date": f"CASE WHEN {trip} = 'RT' THEN CAST('2030-01-10' AS DATE) END",
        "trip_duration_days": f"CASE WHEN {trip} = 'RT' THEN 8 END",
        "trip_origin": f"CASE WHEN {trip} = 'RT' THEN {origin} END",
        "trip_destination": f"CASE WHEN {trip} = 'RT' THEN {destination} END",
        "leg_direction": f"CASE WHEN {trip} = 'RT' THEN 'inbound' END",
        "leg_sequence": f"CASE WHEN {trip} = 'RT' THEN 2 ELSE 1 END",
        "itinerary_leg_count": f"CASE WHEN {trip} = 'RT' THEN 2 ELSE 1 END",
        "departure_local": f"CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE {dep} END",
        "departure_utc": f"CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE {dep} END",
        "departure_tz_offset": "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE '+00:00' END",
        "arrival_utc": f"CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE {arrival} END",
        "arrival_tz_offset": "CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE '+00:00' END",
        "fare_ref_num": "CASE WHEN l_orderkey % 2 = 0 THEN concat('R', l_orderkey % 100) END",
        "fare_search_reference": "CASE WHEN l_orderkey % 4 = 0 THEN concat('S', l_orderkey % 100) END",
        "source_endpoint": "CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE 'api/search' END",
        "payload_fingerprint": "CAST(NULL AS VARCHAR(64))",
        "payload_storage": "CAST(NULL AS VARCHAR(16))",
        "penalty_source": "CASE WHEN l_returnflag = 'A' THEN 'TABLE' END",
        "penalty_currency": "CASE WHEN l_returnflag = 'A' THEN 'BDT' END",
        "penalty_rule_text": "CASE WHEN l_returnflag = 'N' THEN concat('Rule  for ', o_orderpriority) END",
        "fare_changeable": "CASE WHEN l_returnflag = 'A' THEN l_linenumber % 2 = 0 END",
        "fare_refundable": "CASE WHEN l_returnflag = 'A' THEN l_linenumber % 3 = 0 END",
        "raw_offer": "CASE WHEN l_partkey % 8 <> 0 THEN concat('{\"source\":\"', l_returnflag, "
                     "'\",\"fare_ref_num\":\"Q', l_partkey % 40, '\"}') END",
    }
    for name, base in _FEES.items():
        out[name] = (f"CASE WHEN l_returnflag = 'A' THEN CAST({base} + (l_partkey % 5) * 100 AS DECIMAL(12,2)) END")
    return out


_SELECTORS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"]


_PLANS: dict[tuple, DataFrame] = {}


def session_key(spark: SparkSession) -> str:
    """Names a session for good; its object's id would be used again after it is gone."""
    return f"{spark.sparkContext.applicationId}/{spark._jsparkSession.sessionUUID()}"


def _plan(spark: SparkSession, key: tuple, build) -> DataFrame:
    """Analysed (not computed) input tables, kept per session to save repeated analysis."""
    full = (session_key(spark), *key)
    if full not in _PLANS:
        _PLANS[full] = build()
    return _PLANS[full]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _plan(spark, (sf_dir, name), lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet"))


_ROWS: dict[tuple, int] = {}


def line_items(spark: SparkSession, sf_dir: str) -> int:
    """Number of line items, read from the files' footers once per session."""
    key = (session_key(spark), sf_dir)
    if key not in _ROWS:
        _ROWS[key] = read_table(spark, sf_dir, "lineitem").count()
    return _ROWS[key]


def _joined(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    return _plan(spark, (sf_dir, "joined", once), lambda: _join_tables(spark, sf_dir, once))


#: Suppliers up to which their regions (two numbers a row) are sent to every task.
_SMALL = 2_000_000


def _join_tables(spark: SparkSession, sf_dir: str, once: bool) -> DataFrame:
    """Line items with status and priority of their order and the regions at both ends.

    Orders take their customer's region first, so the line items are shuffled once, to their orders. With ``once`` all uses in
    a query share that exchange, which then has all columns.
    """
    lineitem = read_table(spark, sf_dir, "lineitem")
    if once:
        lineitem = shuffled_once(lineitem, "l_orderkey")
    nation = read_table(spark, sf_dir, "nation")
    customer = (
        read_table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", F.col("n_regionkey").alias("d_regionkey"))
    )
    orders = (
        read_table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
    )
    supplier = (
        read_table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", F.col("n_regionkey").alias("o_regionkey"))
    )
    return (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(bounded_broadcast(supplier, _SMALL), F.col("l_suppkey") == F.col("s_suppkey"))
    )


def capture_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycle and capture time of every offer, without the joins that the other columns need."""
    exprs = _expressions("spark")
    return read_table(spark, sf_dir, "lineitem").selectExpr(*[f"{exprs[n]} AS {n}" for n in ("cycle_id", "captured_at")])


def offers(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """One offer per line item."""
    exprs = _expressions("spark")
    return _plan(spark, (sf_dir, "offers", once), lambda: _joined(spark, sf_dir, once).selectExpr(
        *[f"{exprs[n]} AS {n}" for n in OFFER_COLUMNS]))


def offers_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item, with every offer and side-car column."""
    exprs = _expressions("spark")
    return _joined(spark, sf_dir).selectExpr(*[f"{e} AS {n}" for n, e in exprs.items()], *_SELECTORS)


def offer_meta(spark: SparkSession, sf_dir: str, columns: list[str] | None = None, once: bool = False) -> DataFrame:
    """Side-car rows: most offers have one, some none, some a second and newer one."""
    names = tuple(columns or META_COLUMNS)
    return _plan(spark, (sf_dir, "meta", names, once), lambda: _build_meta(spark, sf_dir, list(names), once))


def _build_meta(spark: SparkSession, sf_dir: str, names: list[str], once: bool) -> DataFrame:
    exprs = _expressions("spark")
    second = {
        "tax_amount": f"CASE WHEN meta_no = 2 THEN CAST({{x}} + 10 AS DECIMAL(12,2)) ELSE {{x}} END",
        "soldout": "CASE WHEN meta_no = 2 THEN l_quantity <= 3 ELSE {x} END",
    }
    rows = _joined(spark, sf_dir, once).where("l_partkey % 17 <> 0").selectExpr(
        "*", "explode(CASE WHEN l_partkey % 5 = 1 THEN array(1, 2) ELSE array(1) END) AS meta_no")
    out = []
    for n in names:
        if n == "meta_id":
            out.append(f"concat({exprs['offer_id']}, '#', meta_no) AS meta_id")
        else:
            out.append(f"{second.get(n, '{x}').format(x='(' + exprs[n] + ')') if n in second else exprs[n]} AS {n}")
    return rows.selectExpr(*out)


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event counts per series and day, shaped like the daily change rollup."""
    events = read_table(spark, sf_dir, "events")
    return events.groupBy(
        F.col("event_type").alias("airline"),
        F.concat(F.lit("R"), F.expr("user_id % 3").cast("string")).alias("origin"),
        F.col("ts").cast("date").alias("report_day"),
    ).agg(
        F.count("*").alias("total_change_events"),
        F.count_if(F.col("value") > 100).alias("price_events"),
    )


def _duck_wide() -> str:
    cols = ",\n  ".join(f"{e} AS {n}" for n, e in _expressions("duckdb").items())
    selectors = ", ".join(_SELECTORS)
    return f"""wide AS (SELECT {cols}, {selectors}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN (SELECT c_custkey, n_regionkey AS d_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
    ON o_custkey = c_custkey
  JOIN (SELECT s_suppkey, n_regionkey AS o_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    ON l_suppkey = s_suppkey)"""


def duckdb_ctes() -> dict[str, str]:
    """CTE texts by name, in dependency order."""
    second = {
        "meta_id": "concat(offer_id, '#2')",
        "tax_amount": "CAST(tax_amount + 10 AS DECIMAL(12,2))",
        "soldout": "l_quantity <= 3",
    }
    first_cols = ", ".join("concat(offer_id, '#1') AS meta_id" if c == "meta_id" else c for c in META_COLUMNS)
    second_cols = ", ".join(f"{second[c]} AS {c}" if c in second else c for c in META_COLUMNS)
    return {
        "wide": _duck_wide(),
        "offers": f"offers AS (SELECT {', '.join(OFFER_COLUMNS)} FROM wide)",
        "meta": f"meta AS (SELECT {first_cols} FROM wide WHERE l_partkey % 17 <> 0 "
                f"UNION ALL SELECT {second_cols} FROM wide WHERE l_partkey % 17 <> 0 AND l_partkey % 5 = 1)",
        "daily": "daily AS (SELECT event_type AS airline, concat('R', user_id % 3) AS origin, "
                 "CAST(ts AS DATE) AS report_day, count(*) AS total_change_events, "
                 "count(CASE WHEN value > 100 THEN 1 END) AS price_events FROM events GROUP BY 1, 2, 3)",
    }
