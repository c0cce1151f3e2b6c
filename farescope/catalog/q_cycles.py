"""Queries over capture cycles."""

from datetime import datetime

from pyspark.sql import functions as F

from farescope.catalog.base import query, sql
from farescope.operators import cycles

_RUNS = """runs AS (SELECT cycle_id, min(captured_at) AS cycle_started_at_utc, max(captured_at) AS cycle_completed_at_utc,
  count(*) AS offer_rows, count(DISTINCT airline) AS airline_count,
  count(DISTINCT origin || '-' || destination) AS route_count FROM offers GROUP BY cycle_id)"""
_RUN_COLS = "cycle_id:s cycle_started_at_utc:t cycle_completed_at_utc:t offer_rows:i airline_count:i route_count:i"
_LATEST = "latest AS (SELECT cycle_id FROM offers GROUP BY 1 ORDER BY max(captured_at) DESC, cycle_id DESC LIMIT 1)"


@query("cycle_runs", _RUN_COLS, sql("SELECT * FROM runs", ctes=_RUNS))
def _cycle_runs(ctx):
    return cycles.cycle_runs(ctx.offers)


@query("cycle_runs_between", _RUN_COLS, sql("""SELECT cycle_id, min(captured_at) AS cycle_started_at_utc,
  max(captured_at) AS cycle_completed_at_utc, count(*) AS offer_rows, count(DISTINCT airline) AS airline_count,
  count(DISTINCT origin || '-' || destination) AS route_count FROM offers
  WHERE captured_at >= TIMESTAMP '1995-01-01' AND captured_at < TIMESTAMP '1996-01-01' GROUP BY cycle_id"""))
def _cycle_runs_between(ctx):
    return cycles.cycle_runs(ctx.offers, datetime(1995, 1, 1), datetime(1996, 1, 1))


@query("recent_comparable_cycles", _RUN_COLS, sql("""SELECT * FROM runs
  WHERE offer_rows >= 500 AND airline_count >= 5 AND route_count >= 10
  ORDER BY cycle_completed_at_utc DESC, cycle_id DESC LIMIT 10""", ctes=_RUNS))
def _recent(ctx):
    return cycles.recent_cycles(cycles.cycle_runs(ctx.offers), 10)


@query("cycle_loads_deduped", _RUN_COLS, sql("SELECT * FROM runs", ctes=_RUNS))
def _dedup_loads(ctx):
    runs = cycles.cycle_runs(ctx.offers)
    earlier = runs.withColumn("offer_rows", F.col("offer_rows") - 1)
    return cycles.dedup_cycle_loads(runs.unionByName(earlier))


@query("latest_two_cycles", "cycle_id:s captured_at:t position:i", sql("""SELECT cycle_id, captured_at,
  row_number() OVER (ORDER BY captured_at DESC, cycle_id DESC) AS position FROM (
  SELECT cycle_id, max(captured_at) AS captured_at FROM offers WHERE airline IN ('A1','A2') GROUP BY 1
  ORDER BY 2 DESC, 1 DESC LIMIT 2)"""))
def _two(ctx):
    return cycles.latest_two(ctx.offers, ["A1", "A2"])


@query("latest_two_full_cycles", "cycle_id:s tier:i position:i", sql("""
  SELECT cycle_id, tier, row_number() OVER (ORDER BY captured_at DESC, cycle_id DESC) AS position FROM (
    SELECT r.cycle_id, r.tier, c.captured_at FROM ranked r JOIN cyc c USING (cycle_id)
    WHERE r.tier = (SELECT min(tier) FROM (SELECT tier FROM ranked GROUP BY tier HAVING count(*) >= 2))
    ORDER BY c.captured_at DESC, r.cycle_id DESC LIMIT 2)""", ctes="""
  per AS (SELECT cycle_id, upper(airline) AS airline, count(*) AS n FROM offers GROUP BY 1, 2),
  cyc AS (SELECT cycle_id, max(captured_at) AS captured_at, count(*) AS n FROM offers GROUP BY 1),
  lim AS (SELECT airline, least(max(n), greatest(100, CAST(floor(max(n) * 0.9) AS BIGINT))) AS threshold
          FROM per WHERE cycle_id IN (SELECT cycle_id FROM cyc) GROUP BY 1),
  ranked AS (
    SELECT per.cycle_id, 1 AS tier FROM per JOIN lim USING (airline) JOIN cyc USING (cycle_id)
    GROUP BY per.cycle_id HAVING bool_and(per.n >= threshold) AND count(*) = (SELECT count(*) FROM lim)
    UNION ALL SELECT cycle_id, 2 FROM cyc
      WHERE n >= (SELECT greatest(100, CAST(floor(max(n) * 0.9) AS BIGINT)) FROM cyc)
    UNION ALL SELECT cycle_id, 3 FROM cyc)"""))
def _two_full(ctx):
    return cycles.latest_two_full(ctx.offers, min_full_ratio=0.9)


@query("last_cycles_by_id", "cycle_id:s position:i", sql("""SELECT cycle_id,
  row_number() OVER (ORDER BY cycle_id) AS position FROM
  (SELECT DISTINCT cycle_id FROM offers ORDER BY 1 DESC LIMIT 6)"""))
def _last_n(ctx):
    return cycles.last_n_by_id(ctx.offers, 6)


@query("cycle_times", "cycle_id:s captured_at:t",
       sql("SELECT cycle_id, max(captured_at) AS captured_at FROM offers GROUP BY 1"))
def _times(ctx):
    return cycles.cycle_times(ctx.offers)


@query("dominant_passenger_mix", "adt:i chd:i inf:i rows:i", sql("""SELECT coalesce(adt_count, 1) AS adt,
  coalesce(chd_count, 0) AS chd, coalesce(inf_count, 0) AS inf, count(*) AS rows
  FROM offers JOIN meta USING (offer_id) WHERE cycle_id = (SELECT cycle_id FROM latest)
  GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 1""", needs="offers meta", ctes=_LATEST))
def _mix(ctx):
    newest = cycles.latest_two(ctx.offers).where("position = 1").select("cycle_id").scalar()
    return cycles.dominant_mix(ctx.offers, ctx.meta, newest)


@query("partial_cycles", "label:s cycle_id:s airline:s rows_now:i row_threshold:i max_rows:i routes_now:i "
       "route_threshold:i max_routes:i", sql("""
  SELECT s.label, s.cycle_id, b.airline, coalesce(st.n, 0) AS rows_now, b.row_threshold, b.max_rows,
    coalesce(st.routes, 0) AS routes_now, b.route_threshold, b.max_routes
  FROM sel s CROSS JOIN best b LEFT JOIN stats st ON st.cycle_id = s.cycle_id AND st.airline = b.airline
  WHERE coalesce(st.n, 0) < b.row_threshold OR coalesce(st.routes, 0) < b.route_threshold""", ctes="""
  stats AS (SELECT cycle_id, airline, count(*) AS n, count(DISTINCT origin || '->' || destination) AS routes
            FROM offers GROUP BY 1, 2),
  best AS (SELECT airline, max(n) AS max_rows, max(routes) AS max_routes,
           least(max(n), greatest(100, CAST(floor(max(n) * 0.95) AS BIGINT))) AS row_threshold,
           least(max(routes), greatest(1, CAST(ceil(max(routes) * 0.95) AS BIGINT))) AS route_threshold
           FROM stats GROUP BY 1),
  sel AS (SELECT CASE position WHEN 1 THEN 'current' ELSE 'previous' END AS label, cycle_id FROM (
    SELECT cycle_id, row_number() OVER (ORDER BY max(captured_at) DESC, cycle_id DESC) AS position
    FROM offers GROUP BY 1) WHERE position <= 2)"""))
def _partial(ctx):
    two = cycles.latest_two(ctx.offers)
    selected = two.select(F.when(F.col("position") == 1, "current").otherwise("previous").alias("label"), "cycle_id")
    return cycles.partial_cycles(ctx.offers, selected, min_full_ratio=0.95)


_ROUTES = """routes AS (SELECT DISTINCT concat('A', s_suppkey % 7) AS airline, concat('R', n_regionkey) AS origin,
  'R1' AS destination FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def expected_routes(ctx):
    """Configured routes derived from suppliers: some flown, some not."""
    nation = ctx.table("nation")
    rows = ctx.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.expr("concat('A', s_suppkey % 7)").alias("airline"),
        F.expr("concat('R', n_regionkey)").alias("origin"),
        F.lit("R1").alias("destination"),
    ).distinct()


ROUTES_CTE = _ROUTES


@query("cycle_health", "cycle_id:s cycle_started_at_utc:t cycle_completed_at_utc:t cycle_age_minutes:d2 stale:b "
       "offer_rows:i airline_count:i route_count:i configured_route_pair_count:i observed_route_pair_count:i "
       "route_pair_coverage_pct:d2 missing_route_pairs:a", sql("""
  SELECT l.*, round(date_diff('second', cycle_completed_at_utc, TIMESTAMP '2000-01-01') / 60.0, 2) AS cycle_age_minutes,
    round(date_diff('second', cycle_completed_at_utc, TIMESTAMP '2000-01-01') / 60.0, 2) > 180 AS stale,
    (SELECT count(*) FROM conf) AS configured_route_pair_count, (SELECT count(*) FROM obs) AS observed_route_pair_count,
    round((SELECT count(*) FROM obs) / (SELECT count(*) FROM conf) * 100.0, 2) AS route_pair_coverage_pct,
    (SELECT list(pair ORDER BY pair) FROM conf WHERE pair NOT IN (SELECT pair FROM obs)) AS missing_route_pairs
  FROM lat l""", ctes=_RUNS + ", " + _ROUTES + """,
  lat AS (SELECT * FROM runs WHERE offer_rows >= 500 AND airline_count >= 5 AND route_count >= 10
          ORDER BY cycle_completed_at_utc DESC, cycle_id DESC LIMIT 1),
  conf AS (SELECT DISTINCT airline || ':' || origin || '-' || destination AS pair FROM routes),
  obs AS (SELECT DISTINCT airline || ':' || origin || '-' || destination AS pair FROM offers
          WHERE cycle_id = (SELECT cycle_id FROM lat))"""))
def _health(ctx):
    return cycles.cycle_health(ctx.offers, expected_routes(ctx), datetime(2000, 1, 1))


@query("airline_coverage_gate", "expected_airlines:i covered_airlines:i missing_airlines:a coverage_pct:d2 "
       "coverage_gate_passed:b", sql("""
  SELECT count(*) AS expected_airlines, count(*) FILTER (WHERE n >= 5) AS covered_airlines,
    coalesce(list(airline ORDER BY airline) FILTER (WHERE n < 5), []) AS missing_airlines,
    round(100.0 * count(*) FILTER (WHERE n >= 5) / count(*), 2) AS coverage_pct,
    count(*) > 0 AND count(*) FILTER (WHERE n >= 5) = count(*) AS coverage_gate_passed
  FROM (SELECT e.airline, coalesce(o.n, 0) AS n FROM (SELECT DISTINCT airline FROM routes) e
        LEFT JOIN (SELECT airline, count(*) AS n FROM offers WHERE cycle_id = (SELECT cycle_id FROM latest)
                   GROUP BY 1) o USING (airline))""", ctes=_ROUTES + ", " + _LATEST))
def _gate(ctx):
    newest = cycles.latest_two(ctx.offers).where("position = 1").select("cycle_id").scalar()
    return cycles.coverage_gate(ctx.offers, expected_routes(ctx), newest, 5)
