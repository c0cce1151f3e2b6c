"""Running sums and places along a key of which one may hold all rows: a prefix scan over ranges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farescope.functions.exprs import bounded_broadcast
from farescope.session import work_dir


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Rows cut into ranges of (key, order) of about equal size, numbered by ``__part``, stored sorted.

    A key with many rows lies in many ranges. Rows that are equal in key and order share one.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = work_dir(spark, "ranges")
    cut = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("__part", F.spark_partition_id())
    cut.write.parquet(path)
    return spark.read.schema(cut.schema).parquet(path)


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], sums: dict[str, Column],
                totals: dict[str, str] | None = None) -> DataFrame:
    """Running sums along each key in an order, the row itself included; ``totals`` maps more names to sums of the whole key.

    Every range sums for itself. One row per key and range then carries what came before it, so the longest window is
    that of a range. The order should be total: of rows equal in it any may come first.
    """
    rows = ranged(df, keys, order)
    local = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumns({name: F.coalesce(F.sum(c).over(local), F.lit(0)) for name, c in sums.items()})
    each = rows.groupBy("__part", *keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"__s_{name}") for name, c in sums.items()])
    by_key = Window.partitionBy(*[f"__k_{k}" for k in keys])
    before = by_key.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k_{k}") for k in keys], *[f"__s_{name}" for name in sums])
    carried = each.select("__p", *[f"__k_{k}" for k in keys], *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums],
                          *[F.sum(f"__s_{n}").over(by_key).alias(f"__t_{n}") for n in sums])
    # As many rows as there are keys and ranges.
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], F.col("__part") == F.col("__p"))
    out = running.join(bounded_broadcast(carried), same)
    found = [(F.col(n) + F.col(f"__b_{n}")).alias(n) for n in sums] + [F.col(f"__t_{n}").alias(t) for n, t in (totals or {}).items()]
    return out.select(*[c for c in df.columns if c not in sums], *found)


def places(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], place: str = "place", size: str = "size") -> DataFrame:
    """Place of each row within its key, from 0, and the number of rows of the key."""
    out = prefix_sums(df, keys, order, {place: F.lit(1).cast("bigint")}, {place: size})
    return out.withColumn(place, F.col(place) - 1)
