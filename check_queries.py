"""Compare registered queries with their SQL twins in DuckDB: python check_queries.py [-s SF] [name-prefix ...]"""

from __future__ import annotations

import argparse
import math
import time

import duckdb

from farescope.catalog.base import load_all, oracle_text, run
from farescope.session import build_session, use_local_work_dir

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        # Nothing in a text equals this, so a missing value differs from an empty one.
        return "\0null" if v is None else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("-s", "--sf", default="0.01")
    parser.add_argument("-t", "--times", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false",
    })
    use_local_work_dir(spark)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name, q in load_all().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        began = time.time()
        try:
            df = run(spark, sf_dir, name)
            got = [tuple(r) for r in df.collect()]
            names = df.columns
            spent = time.time() - began
            text = oracle_text(q)
            if text is None:
                print(f"rows  {name}: {len(got)} rows {spent:.1f}s", flush=True)
                continue
            cur = con.execute(text)
            want_names = [d[0] for d in cur.description]
            want = cur.fetchall()
            a, b = normal(got, names), normal(want, want_names)
            ok = sorted(names) == sorted(want_names) and a == b
            print(f"{'ok   ' if ok else 'DIFF '} {name}: {len(got)} / {len(want)} rows {spent:.1f}s "
                  f"duck {time.time() - began - spent:.1f}s", flush=True)
            if not ok:
                bad += 1
                print("  columns", sorted(names))
                sa, sb = set(a), set(b)
                for row in sorted(sa - sb)[:3]:
                    print("  spark ", row)
                for row in sorted(sb - sa)[:3]:
                    print("  duckdb", row)
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {type(exc).__name__}: {str(exc)[:1500]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
