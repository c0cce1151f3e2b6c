"""Declared schemas of the core tables. Readers use these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_MONEY = T.DecimalType(12, 2)
_TS = T.TimestampNTZType()


def _schema(text: str) -> T.StructType:
    out = T.StructType()
    for line in text.strip().splitlines():
        name, kind = line.split()
        out = out.add(name, _TYPES[kind])
    return out


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "bool": T.BooleanType(),
    "date": T.DateType(),
    "ts": _TS,
    "money": _MONEY,
    "pct": T.DecimalType(6, 2),
}

OFFERS = _schema("""
offer_id string
cycle_id string
captured_at ts
airline string
flight_number string
origin string
destination string
departure ts
cabin string
brand string
price_total money
fare_basis string
seat_capacity int
seat_available int
""")

OFFER_META = _schema("""
meta_id string
offer_id string
currency string
fare_amount money
tax_amount money
baggage string
aircraft string
equipment_code string
duration_min int
stops int
via_airports string
arrival ts
load_factor_pct pct
inventory_confidence string
booking_class string
soldout bool
adt_count int
chd_count int
inf_count int
probe_group_id string
search_trip_type string
trip_request_id string
requested_outbound_date date
requested_return_date date
trip_duration_days int
trip_origin string
trip_destination string
leg_direction string
leg_sequence int
itinerary_leg_count int
departure_local ts
departure_utc ts
departure_tz_offset string
arrival_utc ts
arrival_tz_offset string
fare_ref_num string
fare_search_reference string
source_endpoint string
payload_fingerprint string
payload_storage string
penalty_source string
penalty_currency string
penalty_rule_text string
fare_change_fee_before_24h money
fare_change_fee_within_24h money
fare_change_fee_no_show money
fare_cancel_fee_before_24h money
fare_cancel_fee_within_24h money
fare_cancel_fee_no_show money
fare_changeable bool
fare_refundable bool
raw_offer string
captured_at ts
""")

CHANGE_EVENTS = _schema("""
cycle_id string
previous_cycle_id string
detected_at ts
report_day date
airline string
origin string
destination string
flight_number string
departure_day date
departure_time string
cabin string
fare_basis string
brand string
domain string
change_type string
direction string
field_name string
old_value string
new_value string
magnitude double
percent_change double
identity_key string
""")

PAYLOAD_STORE = _schema("""
fingerprint string
payload_json string
payload_size_bytes long
seen_count long
first_seen_at ts
last_seen_at ts
""")
