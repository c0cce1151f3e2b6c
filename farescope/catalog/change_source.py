"""Change events between consecutive cycles, for Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from farescope.functions import DIFF_KEY

STATE_FIELDS = ["price_total", "seat_available", "seat_capacity", "arrival", "tax_amount", "soldout", "aircraft",
                "booking_class"]


def state_rows(ctx, offers: DataFrame | None = None) -> DataFrame:
    """Offers (all by default) with the side-car fields whose changes are tracked."""
    from farescope.sources import offers_with_latest_meta

    meta = ctx.meta_with("arrival tax_amount soldout aircraft booking_class")
    return offers_with_latest_meta(ctx.offers if offers is None else offers, meta).drop("meta_id")


def pairs(ctx) -> DataFrame:
    """State rows of consecutive cycles. The offer alone decides which row is the state, so only states take a side-car."""
    from farescope.operators.diff import cycle_states, pair_consecutive

    return pair_consecutive(state_rows(ctx, cycle_states(ctx.offers)), ctx.cycle_order)


def change_events(ctx) -> DataFrame:
    """Change events computed from the offers."""
    from farescope.operators.diff import diff_columns

    return diff_columns(pairs(ctx), STATE_FIELDS)


def _number(field: str) -> str | None:
    if field == "arrival":
        return None
    if field in ("aircraft", "booking_class"):
        return "TRY_CAST({x} AS DOUBLE)"
    if field == "soldout":
        return "CAST(CAST({x} AS INT) AS DOUBLE)"
    return "CAST({x} AS DOUBLE)"


def _json(field: str) -> str:
    return {
        "price_total": "CAST(CAST({x} AS DOUBLE) AS VARCHAR)",
        "tax_amount": "CAST(CAST({x} AS DOUBLE) AS VARCHAR)",
        "arrival": "'\"' || strftime({x}, '%Y-%m-%dT%H:%M:%S') || '\"'",
        "aircraft": "'\"' || {x} || '\"'",
        "booking_class": "'\"' || {x} || '\"'",
    }.get(field, "CAST({x} AS VARCHAR)")


def _field_sql(field: str) -> str:
    domain = {"price_total": "price", "seat_available": "seat", "seat_capacity": "capacity",
              "arrival": "schedule"}.get(field, "field")
    number = _number(field)
    x = number.format(x=f"p_{field}") if number else "CAST(NULL AS DOUBLE)"
    y = number.format(x=f"c_{field}") if number else "CAST(NULL AS DOUBLE)"
    return f"""SELECT cycle_id, previous_cycle_id, detected_at, {', '.join(DIFF_KEY)}, '{domain}' AS domain,
  CASE WHEN p_{field} IS NULL THEN 'added' WHEN c_{field} IS NULL THEN 'removed'
       WHEN {y} > {x} THEN 'increase' WHEN {y} < {x} THEN 'decrease' ELSE 'modified' END AS change_type,
  CASE WHEN {y} > {x} THEN 'up' WHEN {y} < {x} THEN 'down' ELSE 'none' END AS direction,
  '{field}' AS field_name, {_json(field).format(x='p_' + field)} AS old_value,
  {_json(field).format(x='c_' + field)} AS new_value, abs({y} - {x}) AS magnitude,
  CASE WHEN {x} <> 0 THEN ({y} - {x}) / {x} * 100.0 END AS percent_change
  FROM matched WHERE p_{field} IS DISTINCT FROM c_{field}"""


def _ctes() -> list[str]:
    same = " AND ".join(f"p.{k} IS NOT DISTINCT FROM c.{k}" for k in DIFF_KEY)
    keys = ", ".join(DIFF_KEY)
    both = ", ".join(f"p.{f} AS p_{f}, c.{f} AS c_{f}" for f in STATE_FIELDS)
    presence = ("SELECT {c} AS cycle_id, {p} AS previous_cycle_id, detected_at, {k}, 'availability' AS domain, "
                "'{t}' AS change_type, '{d}' AS direction, '__row_presence__' AS field_name, "
                "'{{\"present\":{a}}}' AS old_value, '{{\"present\":{b}}}' AS new_value, "
                "CAST(NULL AS DOUBLE) AS magnitude, CAST(NULL AS DOUBLE) AS percent_change FROM {f}")
    added = presence.format(c="cycle_id", p="NULL", k=keys, t="added", d="up", a="false", b="true", f="arrived")
    removed = presence.format(c="NULL", p="previous_cycle_id", k=keys, t="removed", d="down", a="true", b="false",
                              f="gone")
    fields = "\n UNION ALL ".join(_field_sql(f) for f in STATE_FIELDS)
    return [
        "newest_meta AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY meta_id DESC) "
        "AS rn FROM meta) WHERE rn = 1)",
        "cyc AS (SELECT cycle_id, min(captured_at) AS started_at, "
        "row_number() OVER (ORDER BY min(captured_at), cycle_id) AS cycle_no FROM offers GROUP BY cycle_id)",
        "st AS (SELECT * FROM (SELECT o.*, m.arrival, m.tax_amount, m.soldout, m.aircraft, m.booking_class, "
        f"cyc.cycle_no, row_number() OVER (PARTITION BY o.cycle_id, {', '.join('o.' + k for k in DIFF_KEY)} "
        "ORDER BY o.captured_at DESC, o.offer_id DESC) AS rn FROM offers o LEFT JOIN newest_meta m "
        "ON m.offer_id = o.offer_id JOIN cyc ON cyc.cycle_id = o.cycle_id) WHERE rn = 1)",
        f"matched AS (SELECT c.cycle_id, p.cycle_id AS previous_cycle_id, cyc.started_at AS detected_at, "
        f"{', '.join('c.' + k for k in DIFF_KEY)}, p.captured_at AS p_captured_at, c.captured_at AS c_captured_at, "
        f"{both} FROM st c JOIN st p ON c.cycle_no = p.cycle_no + 1 "
        f"AND {same} JOIN cyc ON cyc.cycle_id = c.cycle_id)",
        f"arrived AS (SELECT c.*, cyc.started_at AS detected_at FROM st c JOIN cyc ON cyc.cycle_id = c.cycle_id "
        f"WHERE NOT EXISTS (SELECT 1 FROM st p WHERE c.cycle_no = p.cycle_no + 1 AND {same}))",
        f"gone AS (SELECT p.*, p.cycle_id AS previous_cycle_id, n.started_at AS detected_at FROM st p JOIN cyc n "
        f"ON n.cycle_no = p.cycle_no + 1 WHERE NOT EXISTS (SELECT 1 FROM st c WHERE c.cycle_no = p.cycle_no + 1 "
        f"AND {same}))",
        f"events_raw AS ({added}\n UNION ALL {removed}\n UNION ALL {fields})",
        "changes AS (SELECT *, CAST(detected_at AS DATE) AS report_day, CAST(departure AS DATE) AS departure_day, "
        "strftime(departure, '%H:%M:%S') AS departure_time FROM events_raw)",
    ]


CHANGE_CTES: list[str] = _ctes()
