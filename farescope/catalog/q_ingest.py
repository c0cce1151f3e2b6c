"""Queries over ingest, side-car matching, payload storage and penalties."""

from datetime import datetime

from pyspark.sql import functions as F

from farescope import fixtures
from farescope.catalog.base import query, sql, stored
from farescope.functions import DIFF_KEY, PENALTY_FEES, STORAGE_KEY, split_via
from farescope.operators import ingest, payloads
from farescope.session import work_dir
from farescope.sources.tables import BucketTable

_DK = ", ".join(DIFF_KEY)
_FIRST = f"QUALIFY row_number() OVER (PARTITION BY cycle_id, {_DK} ORDER BY offer_id) = 1"
_KEYS = "airline:s origin:s destination:s departure:t flight_number:s cabin:s fare_basis:s brand:s"
_AT = datetime(2024, 1, 1)


@query("normalize_core", "offer_id:s cycle_id:s captured_at:t price_total:d2 seat_available:i brand:s fare_basis:s", sql("""
  SELECT offer_id, 'C1' AS cycle_id, TIMESTAMP '2024-01-01' AS captured_at, price_total, seat_available, brand,
    NULL AS fare_basis FROM offers"""))
def _core(ctx):
    parsed = ctx.offers.drop("fare_basis", "cycle_id", "captured_at").withColumns({
        "price_total": F.col("price_total").cast("string"), "unknown_field": F.lit("x")})
    return ingest.normalize_core(parsed, "C1", _AT)


@query("normalize_meta", "offer_id:s stops:i tax_amount:d2 soldout:b penalty_source:s columns:i", sql("""SELECT offer_id,
  stops, tax_amount, soldout, NULL AS penalty_source, 53 AS columns FROM meta""", needs="meta"))
def _meta(ctx):
    parsed = ctx.meta_with("stops tax_amount soldout").withColumn("junk", F.lit(1))
    out = ingest.normalize_meta(parsed)
    return out.withColumn("columns", F.lit(len(out.columns)))


_SPLIT = "CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE brand END AS brand"


def _with_gaps(ctx):
    part = F.expr("CAST(split_part(offer_id, '-', 3) AS BIGINT) % 10")
    return ctx.offers.withColumn("brand", F.when(part != 0, F.col("brand")))


@query("split_valid", "airline:s valid:i rejected:i", sql("""SELECT airline, count(*) FILTER (WHERE l_partkey % 10 <> 0)
  AS valid, count(*) FILTER (WHERE l_partkey % 10 = 0) AS rejected FROM wide GROUP BY 1"""))
def _valid(ctx):
    ok, bad = ingest.split_valid(_with_gaps(ctx))
    marked = ok.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False)))
    return marked.groupBy("airline").agg(F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("rejected"))


@query("dedup_core", "offer_id:s cycle_id:s price_total:d2 " + _KEYS, sql(f"SELECT * FROM offers {_FIRST}"))
def _dedup(ctx):
    return ingest.dedup_core(ctx.offers)


@query("dedup_core_with_amount", "airline:s offers:i", sql(f"""SELECT airline, count(*) AS offers FROM (SELECT * FROM offers
  QUALIFY row_number() OVER (PARTITION BY cycle_id, {_DK}, price_total ORDER BY offer_id) = 1) GROUP BY 1"""))
def _dedup_amount(ctx):
    return ingest.dedup_core(ctx.offers, extra=["price_total"]).groupBy("airline").agg(F.count("*").alias("offers"))


_SK = ", ".join(STORAGE_KEY)


@query("append_dedup", "offer_id:s cycle_id:s brand:s", sql(f"""SELECT * FROM (SELECT * FROM offers WHERE
  captured_at >= TIMESTAMP '1998-01-01' QUALIFY row_number() OVER (PARTITION BY {_SK} ORDER BY offer_id) = 1) n
  WHERE NOT EXISTS (SELECT 1 FROM offers e WHERE e.captured_at < TIMESTAMP '1998-02-15' AND {' AND '.join(
      f'e.{k} = n.{k}' for k in STORAGE_KEY)})"""))
def _append(ctx):
    new = ctx.offers.where("captured_at >= timestamp_ntz'1998-01-01'")
    return ingest.append_dedup(new, ctx.offers.where("captured_at < timestamp_ntz'1998-02-15'"))


@query("identity_key", "offer_id:s k_airline:s k_origin:s k_departure:s k_flight_number:s k_brand:s", sql("""SELECT offer_id,
  airline AS k_airline, origin AS k_origin, strftime(CASE WHEN l_partkey % 4 = 0 THEN departure - INTERVAL 6 HOUR
  ELSE departure END, '%Y-%m-%dT%H:%M:%S') AS k_departure, flight_number AS k_flight_number,
  CASE WHEN l_partkey % 10 = 0 THEN '' ELSE brand END AS k_brand FROM wide"""))
def _identity(ctx):
    part = F.expr("CAST(split_part(offer_id, '-', 3) AS BIGINT) % 4")
    text = F.date_format("departure", "yyyy-MM-dd'T'HH:mm:ss")
    rows = _with_gaps(ctx).withColumns({
        "airline": F.lower("airline"), "departure": F.when(part == 0, F.concat(text, F.lit("+06:00"))).otherwise(text)})
    return ingest.identity_key(rows)


@query("attach_offer_id", "row_id:s offer_id:s", sql(f"""SELECT w.offer_id AS row_id, coalesce(e.offer_id, l.offer_id) AS offer_id
  FROM (SELECT *, CASE WHEN l_partkey % 10 = 0 THEN 'OTHER' ELSE brand END AS b FROM wide) w
  LEFT JOIN ins e ON {' AND '.join(f'e.{k} = w.{k}' for k in ['cycle_id', *DIFF_KEY[:-1]])} AND e.brand = w.b
  LEFT JOIN (SELECT cycle_id, {', '.join(DIFF_KEY[:-1])}, min(offer_id) AS offer_id FROM ins GROUP BY ALL) l
    ON {' AND '.join(f'l.{k} = w.{k}' for k in ['cycle_id', *DIFF_KEY[:-1]])}""",
       ctes=f"ins AS (SELECT * FROM offers {_FIRST})"))
def _attach(ctx):
    parsed = _with_gaps(ctx).withColumn("brand", F.coalesce("brand", F.lit("OTHER"))).withColumnRenamed("offer_id", "row_id")
    return ingest.attach_offer_id(parsed, ingest.dedup_core(ctx.offers))


_HASHED = "currency stops soldout booking_class tax_amount"


@query("dedup_meta", "stops:i rows:i", sql("""SELECT stops, count(*) AS rows FROM (SELECT DISTINCT offer_id, currency, stops,
  soldout, booking_class, tax_amount FROM meta) GROUP BY 1""", needs="meta"))
def _dedup_meta(ctx):
    rows = ctx.meta_with(_HASHED)
    doubled = rows.unionByName(rows.withColumn("meta_id", F.concat("meta_id", F.lit("x"))))
    return ingest.dedup_meta(doubled).groupBy("stops").agg(F.count("*").alias("rows"))


def _store(ctx):
    """Store filled from the payloads of the side-car rows of even carriers."""
    empty = ctx.spark.createDataFrame([], "fingerprint string, payload_json string, payload_size_bytes bigint, "
                                          "seen_count bigint, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz")
    old = ctx.meta_with("raw_offer").where("meta_id LIKE '%#2'")
    return ingest.externalize_payloads(old, empty, datetime(2023, 1, 1), "inline")[1]


_CANON = """'{"fare_ref_num":"Q' || json_extract_string(raw_offer, '$.fare_ref_num') [2:] || '","source":"' ||
  json_extract_string(raw_offer, '$.source') || '"}'"""
_PAY = f"""pay AS (SELECT meta_id, raw_offer, CASE WHEN raw_offer IS NOT NULL THEN {_CANON} END AS canon FROM meta),
  cnt AS (SELECT canon, count(*) AS n FROM pay WHERE canon IS NOT NULL GROUP BY 1),
  old AS (SELECT canon, count(*) AS n FROM pay WHERE canon IS NOT NULL AND meta_id LIKE '%#2' GROUP BY 1)"""


@query("externalize_duplicates", "payload_storage:s rows:i inline_rows:i fingerprints:i", sql("""SELECT CASE WHEN canon IS NULL
  THEN NULL WHEN o.n IS NOT NULL OR c.n > 1 THEN 'external_ref' ELSE 'inline+ref' END AS payload_storage,
  count(*) AS rows, count(*) FILTER (WHERE o.n IS NULL AND c.n = 1) AS inline_rows, count(DISTINCT canon) AS fingerprints
  FROM pay LEFT JOIN cnt c USING (canon) LEFT JOIN old o USING (canon) GROUP BY 1""", needs="meta", ctes=_PAY))
def _external(ctx):
    rows, _ = ingest.externalize_payloads(ctx.meta_with("raw_offer"), _store(ctx), _AT)
    return rows.groupBy("payload_storage").agg(F.count("*").alias("rows"), F.count("raw_offer").alias("inline_rows"),
                                               F.countDistinct("payload_fingerprint").alias("fingerprints"))


_STORE_COLS = "fingerprint:s payload_json:s payload_size_bytes:i seen_count:i first_seen_at:t last_seen_at:t"


@query("payload_store_merge", _STORE_COLS, sql("""SELECT sha256(canon) AS fingerprint, canon AS payload_json,
  length(canon) AS payload_size_bytes, c.n + coalesce(o.n, 0) AS seen_count, CASE WHEN o.n IS NOT NULL
  THEN TIMESTAMP '2023-01-01' ELSE TIMESTAMP '2024-01-01' END AS first_seen_at, TIMESTAMP '2024-01-01' AS last_seen_at
  FROM cnt c LEFT JOIN old o USING (canon)""", needs="meta", ctes=_PAY))
def _merge(ctx):
    return ingest.externalize_payloads(ctx.meta_with("raw_offer"), _store(ctx), _AT, "externalize_all")[1]


def _stored_table(ctx):
    """The payload table with the repeats of the side-car, which were seen first."""
    old = _store(ctx)
    table = BucketTable(ctx.spark, work_dir(ctx.spark, "payload-table"), old.schema, ["fingerprint"], 16)
    table.upsert(old, ingest.merge_payloads)
    return table


@query("payload_table_upsert", _STORE_COLS, sql("""SELECT sha256(canon) AS fingerprint, canon AS payload_json,
  length(canon) AS payload_size_bytes, c.n + coalesce(o.n, 0) AS seen_count, CASE WHEN o.n IS NOT NULL
  THEN TIMESTAMP '2023-01-01' ELSE TIMESTAMP '2024-01-01' END AS first_seen_at, TIMESTAMP '2024-01-01' AS last_seen_at
  FROM cnt c LEFT JOIN old o USING (canon)""", needs="meta", ctes=_PAY))
def _table_upsert(ctx):
    table = _stored_table(ctx)
    ingest.store_payloads(ctx.meta_with("raw_offer"), table, _AT, "externalize_all")
    return table.read()


@query("payload_table_rows", "payload_storage:s rows:i inline_rows:i fingerprints:i", sql("""SELECT CASE WHEN canon IS NULL
  THEN NULL WHEN o.n IS NOT NULL OR c.n > 1 THEN 'external_ref' ELSE 'inline+ref' END AS payload_storage,
  count(*) AS rows, count(*) FILTER (WHERE o.n IS NULL AND c.n = 1) AS inline_rows, count(DISTINCT canon) AS fingerprints
  FROM pay LEFT JOIN cnt c USING (canon) LEFT JOIN old o USING (canon) GROUP BY 1""", needs="meta", ctes=_PAY))
def _table_rows(ctx):
    rows = ingest.store_payloads(ctx.meta_with("raw_offer"), _stored_table(ctx), _AT)
    return rows.groupBy("payload_storage").agg(F.count("*").alias("rows"), F.count("raw_offer").alias("inline_rows"),
                                               F.countDistinct("payload_fingerprint").alias("fingerprints"))


@query("resolve_payload", "meta_id:s payload:s", sql("SELECT meta_id, canon AS payload FROM pay", needs="meta", ctes=_PAY))
def _resolve(ctx):
    rows, store = ingest.externalize_payloads(ctx.meta_with("raw_offer"), _store(ctx), _AT, "externalize_all")
    return ingest.resolve_payload(rows, store)


@query("payload_store_reuse", "row_count:i seen_total:i seen_per_payload:d4", sql("""SELECT count(*) AS row_count,
  sum(n) AS seen_total, sum(n) / count(*) AS seen_per_payload FROM old""", needs="meta", ctes=_PAY))
def _reuse(ctx):
    from farescope.operators.quality import store_reuse

    return store_reuse(_store(ctx))


_OFF = "CASE {x} WHEN 'R0' THEN 360 WHEN 'R1' THEN 330 WHEN 'R2' THEN -300 WHEN 'R3' THEN 0 END"
_OFFT = "CASE {x} WHEN 'R0' THEN '+06:00' WHEN 'R1' THEN '+05:30' WHEN 'R2' THEN '-05:00' WHEN 'R3' THEN '+00:00' END"
_OO, _DO = _OFF.format(x="origin"), _OFF.format(x="destination")


@query("to_utc", "offer_id:s departure_utc:t departure_tz_offset:s", sql(f"""SELECT offer_id,
  departure - to_minutes({_OO}) AS departure_utc, {_OFFT.format(x='origin')} AS departure_tz_offset FROM offers"""))
def _utc(ctx):
    return ingest.to_utc(ctx.offers, ctx.offsets)


@query("load_factor_and_confidence", "offer_id:s load_factor:d2 confidence:s", sql("""SELECT offer_id, CASE WHEN seats IS NOT NULL
  THEN round_even(greatest(37 - seats, 0) / 37.0::DOUBLE * 100.0, 1) END AS load_factor, CASE WHEN seats IS NULL THEN 'unknown'
  ELSE 'reported' END AS confidence FROM (SELECT offer_id, nullif(seat_available, 0) AS seats FROM offers)"""))
def _load(ctx):
    seats = F.nullif(F.col("seat_available"), F.lit(0))
    return ctx.offers.select("offer_id", ingest.load_factor(seats, F.lit(37)).alias("load_factor"),
                             ingest.inventory_confidence(seats).alias("confidence"))


_BF_META = ("currency fare_amount tax_amount stops arrival inventory_confidence soldout adt_count chd_count inf_count "
            "departure_local departure_utc departure_tz_offset arrival_utc arrival_tz_offset fare_ref_num "
            "fare_search_reference source_endpoint payload_fingerprint raw_offer captured_at")


def _backfill(ctx):
    rows, store = ingest.externalize_payloads(ctx.meta_with(_BF_META), _store(ctx), _AT, "externalize_all")
    # Stored since its size is checked before it is broadcast.
    return ingest.backfill_meta(ctx.offers, rows, stored(ctx, "backfill-payloads", lambda: store), ctx.offsets)


_BF = f"""m AS (SELECT meta.*, o.airline, o.origin, o.destination, o.departure, o.seat_available, {_OO} AS oo, {_DO} AS dd,
    CASE WHEN raw_offer IS NOT NULL THEN json_extract_string(raw_offer, '$.fare_ref_num') END AS prn
    FROM meta JOIN offers o USING (offer_id)),
  ins AS (SELECT *, {_OO} AS oo, {_DO} AS dd FROM offers WHERE offer_id NOT IN (SELECT offer_id FROM meta))"""


@query("backfill_meta_rows", "meta_id:s inventory_confidence:s source_endpoint:s adt_count:i chd_count:i departure_local:t "
       "departure_utc:t departure_tz_offset:s arrival_utc:t arrival_tz_offset:s fare_ref_num:s fare_search_reference:s "
       "fare_amount:d2 soldout:b", sql(f"""SELECT meta_id, coalesce(inventory_confidence, 'reported') AS inventory_confidence,
  coalesce(source_endpoint, 'legacy/unknown') AS source_endpoint, coalesce(adt_count, 1) AS adt_count,
  coalesce(chd_count, 0) AS chd_count, coalesce(departure_local, departure) AS departure_local,
  coalesce(departure_utc, departure - to_minutes(oo)) AS departure_utc,
  coalesce(departure_tz_offset, {_OFFT.format(x='origin')}) AS departure_tz_offset,
  coalesce(arrival_utc, arrival - to_minutes(dd)) AS arrival_utc,
  coalesce(arrival_tz_offset, {_OFFT.format(x='destination')}) AS arrival_tz_offset, coalesce(fare_ref_num, prn) AS fare_ref_num,
  fare_search_reference, fare_amount, soldout FROM m
  UNION ALL SELECT offer_id || '#0', 'reported', 'legacy/unknown', 1, 0, departure, departure - to_minutes(oo),
    {_OFFT.format(x='origin')}, NULL, {_OFFT.format(x='destination')}, NULL, NULL, price_total, seat_available = 0 FROM ins""",
       needs="offers meta", ctes=_BF))
def _backfill_rows(ctx):
    return _backfill(ctx)[0]


@query("backfill_meta_counts", "step:s rows:i", sql("""SELECT 'insert_missing_raw_meta' AS step, count(*) AS rows FROM ins
  UNION ALL SELECT 'inventory_confidence', count(*) FROM m WHERE inventory_confidence IS NULL
  UNION ALL SELECT 'source_endpoint', count(*) FROM m WHERE source_endpoint IS NULL
  UNION ALL SELECT 'pax_defaults', count(*) FROM m WHERE adt_count IS NULL OR chd_count IS NULL OR inf_count IS NULL
  UNION ALL SELECT 'departure_timestamps', count(*) FROM m WHERE departure_local IS NULL
    OR (departure_tz_offset IS NULL AND oo IS NOT NULL) OR (departure_utc IS NULL AND oo IS NOT NULL)
  UNION ALL SELECT 'arrival_timestamps', count(*) FROM m WHERE (arrival_tz_offset IS NULL AND dd IS NOT NULL)
    OR (arrival_utc IS NULL AND arrival IS NOT NULL AND dd IS NOT NULL)
  UNION ALL SELECT 'fare_references', count(*) FROM m WHERE fare_ref_num IS NULL AND prn IS NOT NULL""",
       needs="offers meta", ctes=_BF))
def _backfill_counts(ctx):
    return _backfill(ctx)[1]


def _line(ctx):
    return fixtures.read_table(ctx.spark, ctx.sf_dir, "lineitem").withColumn("id", F.expr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"))


_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


@query("infer_via", "id:s via_airports:s", sql(f"""SELECT {_ID} AS id, CASE WHEN l_partkey % 4 = 0 THEN 'AAA|BBB'
  WHEN l_partkey % 4 = 1 THEN 'CCC|DDD' WHEN l_partkey % 4 = 2 THEN 'EEE|FFF' END AS via_airports FROM lineitem""", needs=""))
def _via(ctx):
    rows = _line(ctx).select("id", F.lit("ORG").alias("origin"), F.lit("dst").alias("destination"), F.expr("""
      CASE WHEN l_partkey % 4 = 0 THEN ' aaa,BBB|x1|AAA' END""").alias("via_airports"), F.expr("""CASE l_partkey % 4
      WHEN 1 THEN '{"legs":[{"from":"ORG","to":{"iata":"ccc"}},{"from":"CCC","to":"DDD"},{"origin":"DDD","destination":"DST"}]}'
      WHEN 2 THEN '{"trip":{"viaAirports":["EEE",{"code":"FFF"},"bad1","ORG"]}}' WHEN 3 THEN 'not json' END""").alias("raw_offer"))
    return payloads.infer_via(rows)


@query("split_via", "via:s codes:a n:i", sql("""SELECT via, CASE WHEN via IS NULL THEN [] ELSE list_distinct_ordered END AS codes,
  n FROM (SELECT via, CASE via WHEN 'AAA' THEN ['AAA'] WHEN 'AAA|BBB' THEN ['AAA','BBB'] END AS list_distinct_ordered,
  count(*) AS n FROM (SELECT via_airports AS via FROM meta) GROUP BY 1)""", needs="meta"))
def _split_via(ctx):
    counts = ctx.meta_with("via_airports").groupBy(F.col("via_airports").alias("via")).agg(F.count("*").alias("n"))
    return counts.withColumn("codes", split_via(F.concat(F.lower("via"), F.lit(", ,x|"), "via")))


# ---------------------------------------------------------------- nested responses


@query("flatten_gds_offers", "order_key:i airline:s flight_number:s origin:s destination:s departure:t cabin:s brand:s "
       "fare_basis:s equipment_code:s stops:i seat_available:i fare_amount:d2 tax_amount:d2 total_amount:d2 currency:s "
       "price_total:d2 soldout:b inventory_confidence:s fare_search_reference:s baggage:s", sql("""SELECT *,
  CASE cur WHEN 'USD' THEN round(total_amount * 110, 2) WHEN 'BDT' THEN total_amount END AS price_total, cur AS currency FROM (
  SELECT *, coalesce(total0, fare_amount + coalesce(tax0, 0)) AS total_amount,
    coalesce(tax0, greatest(coalesce(total0, fare_amount) - fare_amount, 0)) AS tax_amount FROM (
  SELECT l_orderkey AS order_key, concat('A', l_suppkey % 5) AS airline, concat('F', l_partkey % 3) AS flight_number,
    'ORG' AS origin, 'DST' AS destination, TIMESTAMP '2030-01-01 06:00:00' AS departure, l_linestatus AS cabin,
    l_returnflag AS brand, 'Y' AS fare_basis, 'DH8' AS equipment_code, l_linenumber % 3 AS stops,
    CASE WHEN l_quantity > 5 THEN CAST(l_quantity AS INT) END AS seat_available,
    CAST(l_extendedprice AS DECIMAL(12,2)) AS fare_amount,
    CASE WHEN l_partkey % 3 <> 0 THEN CAST(l_linenumber * 10.50 AS DECIMAL(12,2)) END AS tax0,
    CASE WHEN l_partkey % 4 <> 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) + 500 AS DECIMAL(12,2)) END AS total0,
    CASE l_partkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'XXX' ELSE 'BDT' END AS cur, false AS soldout,
    CASE WHEN l_quantity > 5 THEN 'reported' ELSE 'unknown' END AS inventory_confidence, 'ref' AS fare_search_reference,
    CASE l_returnflag WHEN 'A' THEN '30 KG' WHEN 'N' THEN '0 KG' END AS baggage FROM lineitem WHERE l_partkey % 9 <> 0))""", needs=""))
def _gds(ctx):
    offer = F.expr("""named_struct('status', CASE WHEN l_partkey % 9 = 0 THEN 'UNAVAILABLE' ELSE 'available' END,
      'brandId', l_returnflag, 'seatsRemaining', named_struct('count', CASE WHEN l_quantity > 5 THEN CAST(l_quantity AS INT) END),
      'fare', named_struct('alternatives', array(array(named_struct('amount', CAST(l_extendedprice AS DECIMAL(12,2)),
        'currency', cur)))),
      'taxes', CASE WHEN l_partkey % 3 <> 0 THEN named_struct('alternatives', array(array(named_struct('amount',
        CAST(l_linenumber * 10.50 AS DECIMAL(12,2)), 'currency', cur)))) END,
      'total', CASE WHEN l_partkey % 4 <> 0 THEN named_struct('alternatives', array(array(named_struct('amount',
        CAST(CAST(l_extendedprice AS DECIMAL(12,2)) + 500 AS DECIMAL(12,2)), 'currency', cur)))) END,
      'itineraryPart', array(named_struct('stops', l_linenumber % 3, 'segments', array(named_struct('flight',
        named_struct('airlineCode', concat('A', l_suppkey % 5), 'flightNumber', concat('F', l_partkey % 3)),
        'equipment', 'DH8', 'origin', 'ORG', 'destination', 'DST', 'departure', '2030-01-01T06:00:00',
        'arrival', '2030-01-01T07:00:00', 'cabinClass', l_linestatus, 'bookingClass', 'Y', 'fareBasis', 'Y')))))""")
    line = _line(ctx).withColumn("cur", F.expr("CASE l_partkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'XXX' ELSE 'BDT' END"))
    grouped = line.groupBy(F.col("l_orderkey").alias("order_key")).agg(F.collect_list(offer).alias("o"))
    families = """'fareFamilies', from_json('[{"brandId":"A","marketingTexts":[{"marketingText":"Bags &amp; more:"},{"marketingText":"30 kg"}]},
      {"brandLabel":[{"brandId":"N","marketingText":"No checked baggage"}]},{"brandId":"R","marketingTexts":["Meal"]}]', 'array<variant>')"""
    bare = F.to_json(F.expr(f"named_struct('fareSearchReference', 'ref', {families}, 'unbundledOffers', array(o))"))
    flat = F.to_json(F.expr(f"named_struct('originalResponse', named_struct('fareSearchReference', 'ref', {families}, 'bundledOffers', o))"))
    payload = F.when(F.col("order_key") % 2 == 0, bare).otherwise(flat)
    return payloads.flatten_gds(grouped.select("order_key", payload.alias("payload")))


@query("flatten_block_offers", "order_key:i origin:s destination:s search_date:s flight_number:s aircraft:s departure:t "
       "arrival:t stops:i fare_basis:s brand:s cabin:s currency:s fare_amount:d2 tax_amount:d2 price_total:d2 "
       "seat_available:i soldout:b adt_count:i fare_ref_num:s fare_search_reference:s", sql("""SELECT *,
  greatest(price_total - fare_amount, 0) AS tax_amount FROM (SELECT l_orderkey AS order_key, 'ORG' AS origin,
  'DST' AS destination, '2030-01-01' AS search_date, concat('VQ-', l_partkey) AS flight_number, 'ATR725' AS aircraft,
  TIMESTAMP '2030-01-01 13:00:00' AS departure, TIMESTAMP '2030-01-01 14:05:00' AS arrival, l_linenumber % 2 AS stops,
  f.code AS fare_basis, f.title AS brand, 'Economy' AS cabin, 'BDT' AS currency,
  CAST(5000 + l_partkey % 1000 + f.extra AS DECIMAL(12,2)) AS fare_amount,
  CAST(5000 + l_partkey % 1000 + f.extra + CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE 25 END AS DECIMAL(12,2)) AS price_total,
  CASE WHEN f.code = 'FL' THEN CASE WHEN l_partkey % 6 = 0 THEN 0 END ELSE l_partkey % 4 END AS seat_available,
  CASE WHEN f.code = 'FL' THEN l_partkey % 6 = 0 ELSE l_partkey % 4 = 0 END AS soldout, 2 AS adt_count, 'frn' AS fare_ref_num,
  'ref' AS fare_search_reference FROM lineitem, (VALUES ('PP', 'Special Promo', 0), ('FL', 'FL', 4000)) f(code, title, extra)
  WHERE l_partkey % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey, f.code ORDER BY l_linenumber) = 1)""",
       needs=""))
def _blocks(ctx):
    flight = F.expr("""named_struct('itinerary', CASE WHEN l_partkey % 7 = 0 THEN array() ELSE array(named_struct(
      'flight', concat('VQ-', l_partkey), 'type', 'ATR725', 'TOD', '2030-01-01T13:00:00', 'TOA', '2030-01-01T14:05:00',
      'stops', CASE WHEN l_linenumber % 2 = 1 THEN array('AAA') END)) END,
      'familyFares', map('PP', named_struct('one', 5000 + l_partkey % 1000, 'all', 5000 + l_partkey % 1000 + x,
        'seats', l_partkey % 4, 'hold', false), 'FL', named_struct('one', 9000 + l_partkey % 1000,
        'all', 9000 + l_partkey % 1000 + x, 'seats', CAST(NULL AS BIGINT), 'hold', l_partkey % 6 = 0)))""")
    rows = _line(ctx).withColumn("x", F.expr("CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE 25 END"))
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", F.to_json(flight).alias("f"))))
    # Flights are JSON already; they are put into the text of the response as they are.
    around = F.to_json(F.expr("""named_struct('flightSearchModel', named_struct('flightSearchData', named_struct('adultCount', 2)),
      'flightResultsModel', named_struct('fareSearchReference', 'ref'), 'flightSelections', named_struct('fareRefNum', 'frn',
      'currency', named_struct('code', 'BDT'), 'fareFamilies', array(named_struct('code', 'PP', 'title', 'Special Promo',
      'cabin', 'Y')), 'flightBlocks', array(named_struct('from', 'ORG', 'into', 'DST', 'flightDates',
      array(named_struct('date', '2030-01-01', 'flights', array('@')))))))"""))
    grouped = rows.groupBy(F.col("l_orderkey").alias("order_key")).agg(F.array_join(F.transform(ordered, lambda x: x["f"]), ",").alias("f"))
    payload = F.replace(around, F.lit('"@"'), F.col("f"))
    return payloads.flatten_blocks(grouped.select("order_key", payload.alias("payload")))


# ---------------------------------------------------------------- penalties

_FEE = " ".join(f"{f}:d2" for f in PENALTY_FEES)
_RULE = """concat('PENALTIES  ', 'VOLUNTARY CHANGES 24 hrs prior charge BDT ', 1000 + l_partkey % 9, ' PER TICKET. WITHIN 24 HRS ',
  1500 + l_partkey % 9, ' per ticket. No Show - BDT 1,', 100 + l_partkey % 9, ' ', 'VOLUNTARY CANCEL/REFUND BEFORE 24HRS BDT ',
  2000 + l_partkey % 9, ' PER PAX WITHIN 24 HRS ', 2500 + l_partkey % 9, ' PER PAX')"""
_FEE_SQL = """1000 + l_partkey % 9 AS fare_change_fee_before_24h, 1500 + l_partkey % 9 AS fare_change_fee_within_24h,
  1100 + l_partkey % 9 AS fare_change_fee_no_show, 2000 + l_partkey % 9 AS fare_cancel_fee_before_24h,
  2500 + l_partkey % 9 AS fare_cancel_fee_within_24h, NULL AS fare_cancel_fee_no_show"""


@query("parse_penalty_text", f"id:s {_FEE} penalty_source:s penalty_currency:s", sql(f"""SELECT {_ID} AS id, {_FEE_SQL},
  'BG_CATEGORY16' AS penalty_source, 'BDT' AS penalty_currency FROM lineitem WHERE l_linenumber > 1
  UNION ALL SELECT {_ID}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM lineitem WHERE l_linenumber = 1""", needs=""))
def _penalty_text(ctx):
    text = F.expr(f"CASE WHEN l_linenumber = 1 THEN '  ' ELSE {_RULE} END")
    return payloads.parse_penalty_text(_line(ctx).select("id", text.alias("penalty_rule_text")))


@query("penalty_rule_texts", "order_key:i fare_basis:s length:i", sql("""SELECT l_orderkey AS order_key,
  'F' || l_partkey AS fare_basis, length('text ' || l_partkey) * 2 + 2 AS length FROM lineitem WHERE l_partkey % 3 <> 0""",
       needs=""))
def _rule_texts(ctx):
    rule = F.expr("""named_struct('fareBasisRules', named_struct('fareBasis', concat(' f', l_partkey), 'fareRules', array(
      named_struct('category', '5', 'ruleText', 'no'), named_struct('category', CASE WHEN l_partkey % 3 = 0 THEN '7' ELSE '16' END,
      'ruleText', concat('text ', l_partkey)), named_struct('category', CASE WHEN l_partkey % 3 = 0 THEN '7' ELSE '16' END,
      'ruleText', concat('text ', l_partkey)))))""")
    grouped = _line(ctx).groupBy(F.col("l_orderkey").alias("order_key")).agg(F.collect_list(rule).alias("r"))
    payload = F.to_json(F.expr("named_struct('originalResponse', named_struct('segmentFareRules', r))"))
    out = payloads.penalty_rule_texts(grouped.select("order_key", payload.alias("payload")))
    return out.withColumn("length", F.length("penalty_rule_text"))


_POLICY = """concat('[{"time_frame":"Before 24 hours","change_fee":1,"cancellation_fee":"2","changeable":true},',
  '{"time_frame":"Prior 24h","change_fee":"1,', 100 + l_partkey % 9, '","cancellation_fee":', 200 + l_partkey % 9,
  ',"currency":"BDT","changeable":', CASE WHEN l_partkey % 2 = 0 THEN 'true' ELSE 'false' END, ',"refundable":true},',
  '{"time_frame":"Within 24 hours","change_fee":', 300 + l_partkey % 9, '},{"time_frame":"No Show","cancellation_fee":9}]')"""


@query("parse_policies", f"id:s {_FEE} penalty_currency:s fare_changeable:b fare_refundable:b", sql(f"""SELECT {_ID} AS id,
  1100 + l_partkey % 9 AS fare_change_fee_before_24h, 300 + l_partkey % 9 AS fare_change_fee_within_24h,
  NULL AS fare_change_fee_no_show, 200 + l_partkey % 9 AS fare_cancel_fee_before_24h, NULL AS fare_cancel_fee_within_24h,
  9 AS fare_cancel_fee_no_show, 'BDT' AS penalty_currency, l_partkey % 2 = 0 AS fare_changeable, true AS fare_refundable
  FROM lineitem""", needs=""))
def _policies(ctx):
    return payloads.parse_policies(_line(ctx).select("id", F.expr(_POLICY).alias("policies")))


_BARE = "CASE WHEN l_returnflag = 'A' THEN 'SET' END AS penalty_source"


@query("infer_penalty", f"id:s penalty_source:s penalty_currency:s penalty_rule_text:s {_FEE} fare_changeable:b "
       "fare_refundable:b", sql(f"""SELECT {_ID} AS id, CASE WHEN l_returnflag = 'A' THEN 'SET' WHEN bg THEN 'POLICY_BASELINE_BG_DOMESTIC'
  WHEN vq THEN 'BRAND_PROFILE_VQ' END AS penalty_source, CASE WHEN bg AND l_returnflag <> 'A' THEN 'BDT' END AS penalty_currency,
  CASE WHEN l_returnflag = 'A' THEN NULL WHEN bg THEN 'BG domestic baseline policy applied (change: 1000/1500/1500, cancel: 1500/2000/2000 BDT).'
    WHEN vq AND flex THEN 'VQ brand profile inferred from fare family ''Flexi'' (fees not published in source payload).'
    WHEN vq THEN 'VQ brand profile captured from ''Promo'' (explicit penalty fee values unavailable in source payload).' END AS penalty_rule_text,
  {', '.join(f"CASE WHEN bg AND l_returnflag <> 'A' THEN {v} END AS {f}" for f, v in zip(PENALTY_FEES, (1000, 1500, 1500, 1500, 2000, 2000)))},
  CASE WHEN l_returnflag <> 'A' AND (bg OR vq AND flex) THEN true END AS fare_changeable,
  CASE WHEN l_returnflag <> 'A' AND (bg OR vq AND flex) THEN true END AS fare_refundable
  FROM (SELECT *, l_suppkey % 3 = 0 AND l_partkey % 4 < 2 AS bg, l_suppkey % 3 = 1 AS vq, l_linenumber % 2 = 0 AS flex FROM lineitem)""",
       needs=""))
def _infer(ctx):
    nulls = {f: F.lit(None).cast("decimal(12,2)") for f in PENALTY_FEES}
    rows = _line(ctx).select(
        "id", F.expr("CASE l_suppkey % 3 WHEN 0 THEN 'BG' WHEN 1 THEN 'vq' ELSE 'ZZ' END").alias("airline"),
        F.lit("R0").alias("origin"), F.expr("concat('R', CASE l_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END)").alias("destination"),
        F.expr("CASE WHEN l_linenumber % 2 = 0 THEN 'Flexi' ELSE 'Promo' END").alias("brand"), F.lit(None).cast("string").alias("fare_basis"),
        F.expr(_BARE), F.lit(None).cast("string").alias("penalty_currency"), F.lit("").alias("penalty_rule_text"),
        F.lit(None).cast("boolean").alias("fare_changeable"), F.lit(None).cast("boolean").alias("fare_refundable"))
    out = payloads.infer_penalty(rows.withColumns(nulls), ctx.airports, "X")
    return out.withColumn("penalty_rule_text", F.nullif(F.col("penalty_rule_text"), F.lit("")))


@query("backfill_penalties", f"meta_id:s penalty_source:s penalty_currency:s other_text:s {_FEE} fare_changeable:b fare_refundable:b", sql(f"""
  SELECT concat({_ID}, '#1') AS meta_id, CASE l_partkey % 4 WHEN 0 THEN 'BG_CATEGORY16' WHEN 1 THEN 'GOZAYAAN_POLICIES'
    WHEN 2 THEN 'AMYBD_REFUND_FLAG' ELSE CASE WHEN l_partkey % 8 = 7 THEN 'AMYBD_TRIP_HINT' END END AS penalty_source,
  CASE WHEN l_partkey % 4 < 2 THEN 'BDT' WHEN l_partkey % 8 = 3 THEN 'EUR' END AS penalty_currency,
  CASE l_partkey % 4 WHEN 2 THEN 'Partially Refundable' WHEN 3 THEN CASE WHEN l_partkey % 8 = 7
    THEN '{{"notes": ["No-show fee ' || l_partkey || '"]}}' END END AS other_text,
  {', '.join(f"CASE l_partkey % 4 WHEN 0 THEN {t} WHEN 1 THEN {p} END AS {f}" for f, t, p in zip(PENALTY_FEES, (
      "1000 + l_partkey % 9", "1500 + l_partkey % 9", "1100 + l_partkey % 9", "2000 + l_partkey % 9", "2500 + l_partkey % 9",
      "NULL"), ("1100 + l_partkey % 9", "300 + l_partkey % 9", "NULL", "200 + l_partkey % 9", "NULL", "9")))},
  CASE WHEN l_partkey % 4 = 1 THEN l_partkey % 2 = 0 WHEN l_partkey % 8 = 3 THEN true END AS fare_changeable,
  CASE WHEN l_partkey % 4 IN (1, 2) THEN true WHEN l_partkey % 8 = 3 THEN false END AS fare_refundable FROM lineitem""", needs=""))
def _backfill_penalty(ctx):
    line = _line(ctx)
    payload = F.expr(f"""CASE l_partkey % 4
      WHEN 0 THEN to_json(named_struct('data', named_struct('getBookingFareRules', named_struct('originalResponse',
        named_struct('segmentFareRules', array(
          named_struct('fareBasisRules', named_struct('fareBasis', 'OTHER', 'fareRules', array(named_struct('category', '16', 'ruleText', 'WITHIN 24 HRS 7 PER')))),
          named_struct('fareBasisRules', named_struct('fareBasis', 'y1', 'fareRules', array(named_struct('category', '16', 'ruleText', {_RULE}))))))))))
      WHEN 1 THEN concat('{{"a":{{"b":[{{"policies":', {_POLICY}, '}}]}}}}')
      WHEN 2 THEN '{{"trip":{{"fRefund":"Partially Refundable"}}}}'
      ELSE CASE WHEN l_partkey % 8 = 3 THEN '{{"x":[{{"leg_wise_fare_rules":{{"L1":{{"ADT":{{"changeable":1,"refundable":false,"currency":"EUR"}}}}}}}}]}}'
        ELSE concat('{{"trip":{{"notes":["No-show fee ', l_partkey, '"]}}}}') END END""")
    from farescope.schemas import OFFER_META

    bare = line.select(F.concat("id", F.lit("#1")).alias("meta_id"), F.col("id").alias("offer_id"), payload.alias("raw_offer"))
    meta = ingest.normalize_meta(bare)
    stored, store = ingest.externalize_payloads(meta, _store(ctx), _AT, "externalize_all")
    # A line may occur twice; an offer is one row.
    offers = line.select(F.col("id").alias("offer_id"), F.lit("BG").alias("airline"), F.lit("Y1").alias("fare_basis")).distinct()
    filled = payloads.backfill_penalties(stored.select(*OFFER_META.fieldNames()), store, offers)
    return filled.withColumn("other_text", F.when(F.col("penalty_source").startswith("AMYBD"), F.col("penalty_rule_text")))


# ---------------------------------------------------------------- lookups

_FLEET_ROWS = [("A0", "BOEING 737-800", 160, 1), ("A0", "787", 271, 2), ("A1", "ATR72-600", 70, 1), ("A1", "DH8", 74, 2),
               ("A2", "A320", 180, 1), ("A3", "738", 162, 1)]


@query("resolve_capacity", "airline:s equipment_code:s aircraft:s fleet_capacity:i n:i", sql("""SELECT airline, equipment_code, aircraft,
  CASE airline WHEN 'A0' THEN CASE WHEN aircraft = 'Boeing 737-800' THEN 160 END
    WHEN 'A1' THEN CASE WHEN aircraft = 'ATR 72-600' THEN 70 END WHEN 'A2' THEN CASE WHEN aircraft = 'Airbus A320' THEN 180 END
    WHEN 'A3' THEN CASE WHEN equipment_code = '738' THEN 162 END END AS fleet_capacity, count(*) AS n
  FROM offers JOIN meta USING (offer_id) GROUP BY ALL""", needs="offers meta"))
def _capacity(ctx):
    fleet = ctx.spark.createDataFrame(_FLEET_ROWS, "airline string, aircraft_key string, seats int, position int")
    rows = ctx.offers.select("offer_id", "airline").join(ctx.meta_with("equipment_code aircraft"), "offer_id")
    combos = rows.groupBy("airline", "equipment_code", "aircraft").agg(F.count("*").alias("n"))
    return ingest.resolve_capacity(combos, fleet)


@query("capture_mismatch", "capture_id:i expected_route:s expected_date:s parsed_routes:a parsed_dates:a route_match:b "
       "date_match:b", sql("""SELECT * FROM (SELECT l_orderkey AS capture_id, 'R0-R1' AS expected_route, '2030-01-01' AS expected_date,
  list_sort(list_distinct(list('R' || l_suppkey % 3 || '-R' || l_partkey % 2))) AS parsed_routes,
  list_sort(list_distinct(list('2030-01-0' || 1 + l_linenumber % 2))) AS parsed_dates,
  bool_or(l_suppkey % 3 = 0 AND l_partkey % 2 = 1) AS route_match, bool_or(l_linenumber % 2 = 0) AS date_match
  FROM lineitem GROUP BY 1) WHERE NOT (route_match AND date_match)""", needs=""))
def _mismatch(ctx):
    rows = _line(ctx).selectExpr("l_orderkey AS capture_id", "concat('r', l_suppkey % 3) AS origin",
                                 "concat('R', l_partkey % 2) AS destination", "'' AS search_date",
                                 "concat('2030-01-0', 1 + l_linenumber % 2, 'T05:00:00') AS departure")
    asked = ctx.table("orders").selectExpr("o_orderkey AS capture_id", "'R0' AS origin", "'r1' AS destination",
                                           "'2030-01-01' AS date")
    return ingest.capture_mismatch(rows, asked)


@query("pretty_equipment", "equipment_code:s name:s n:i", sql("""SELECT equipment_code, CASE equipment_code WHEN '738'
  THEN 'Boeing 737-800' WHEN '320' THEN 'Airbus A320' ELSE 'Unknown (' || coalesce(equipment_code, 'None') || ')' END AS name,
  count(*) AS n FROM meta GROUP BY 1""", needs="meta"))
def _equipment(ctx):
    counts = ctx.meta_with("equipment_code").groupBy("equipment_code").agg(F.count("*").alias("n"))
    return counts.withColumn("name", ingest.pretty_equipment(F.col("equipment_code")))


@query("redact_public", "offer_id:s stops:i columns:i", sql("SELECT offer_id, stops, 3 AS columns FROM meta", needs="meta"))
def _redact(ctx):
    out = ingest.redact_public(ctx.meta_with("stops source_endpoint penalty_source raw_offer"))
    return out.withColumn("columns", F.lit(len(out.columns)))
