"""Registry of named queries with their SQL twins.

A query names its output columns once, with a kind per column. The same list shapes the
Spark result and the outer select of the SQL text, so both sides have equal names and types.

Kinds: s text, i integer, d / d2..d5 rounded double, b boolean, t timestamp text, D date text,
a text array joined by '|'.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from farescope import fixtures
from farescope.session import work_dir


class Context:
    """Lazily built input tables of one run."""

    def __init__(self, spark: SparkSession, sf_dir: str, once: bool = False):
        self.spark = spark
        self.sf_dir = sf_dir
        self.once = once

    @cached_property
    def sharing(self) -> Context:
        """The same tables for a query that reads offers and side-cars together: their line items are shuffled once for all."""
        return Context(self.spark, self.sf_dir, True)

    def table(self, name: str) -> DataFrame:
        return fixtures.read_table(self.spark, self.sf_dir, name)

    @cached_property
    def wide(self) -> DataFrame:
        return fixtures.offers_wide(self.spark, self.sf_dir)

    @cached_property
    def offers(self) -> DataFrame:
        return fixtures.offers(self.spark, self.sf_dir, self.once)

    @cached_property
    def meta(self) -> DataFrame:
        return fixtures.offer_meta(self.spark, self.sf_dir, once=self.once)

    def meta_with(self, names: str) -> DataFrame:
        """Side-car limited to some columns."""
        return fixtures.offer_meta(self.spark, self.sf_dir, ["meta_id", "offer_id", *names.split()], self.once)

    @cached_property
    def daily(self) -> DataFrame:
        return fixtures.daily_series(self.spark, self.sf_dir)

    @cached_property
    def changes(self) -> DataFrame:
        """Stored field-level change events between consecutive cycles."""
        from farescope.catalog.change_source import change_events

        return stored(self, "change-events", lambda: change_events(self))

    @cached_property
    def cycle_order(self) -> DataFrame:
        """Cycles in order, read from the capture dates alone."""
        from farescope.operators.cycles import cycle_order

        return cycle_order(self.capture_times)

    @cached_property
    def capture_times(self) -> DataFrame:
        """Cycle and capture time of every offer, read from the line items alone."""
        return fixtures.capture_times(self.spark, self.sf_dir)

    @cached_property
    def airports(self) -> DataFrame:
        rows = list(fixtures.AIRPORT_COUNTRIES.items())
        return self.spark.createDataFrame(rows, "airport string, country string")

    @cached_property
    def offsets(self) -> DataFrame:
        rows = list(fixtures.AIRPORT_OFFSETS.items())
        return self.spark.createDataFrame(rows, "airport string, offset_minutes int")


_STORED: dict[tuple, tuple[str, StructType]] = {}


def stored(ctx: Context, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """An intermediate table that several queries read: computed and written once per session.

    It lies in the shared work folder, so it survives the loss of executors and is not derived again
    for each use.
    """
    key = (fixtures.session_key(ctx.spark), ctx.sf_dir, name)
    if key not in _STORED:
        df, path = build(), work_dir(ctx.spark, name)
        with shuffles_removed(ctx.spark):
            df.write.parquet(path)
        _STORED[key] = (path, df.schema)
    path, schema = _STORED[key]
    return ctx.spark.read.schema(schema).parquet(path)


#: Spark removes the shuffle files of a query when it ends; otherwise they stay until the driver collects its garbage.
_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within this, what a finished query has shuffled does not take up disk any longer."""
    before = spark.conf.get(_REMOVED, None)
    spark.conf.set(_REMOVED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_REMOVED) if before is None else spark.conf.set(_REMOVED, before)


@dataclass
class Query:
    name: str
    columns: list[tuple[str, str]]
    build: Callable[[Context], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register a query. ``columns`` is like ``"airline:s n:i price:d"``."""
    spec = [tuple(part.split(":")) for part in columns.split()]

    def add(build: Callable[[Context], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, spec, build, sql)
        return build

    return add


def shape(df: DataFrame, spec: list[tuple[str, str]]) -> DataFrame:
    return df.select(*[_spark_value(F.col(f"`{n}`"), k).alias(n) for n, k in spec])


def _digits(kind: str) -> int:
    return int(kind[1:]) if len(kind) > 1 else 6


def _tie(kind: str) -> float:
    """A millionth of the last digit, so that both engines round an exact tie the same way. Other values keep theirs."""
    return 1e-6 / 10 ** _digits(kind)


def _spark_value(value: Column, kind: str) -> Column:
    if kind == "s":
        return value.cast("string")
    if kind == "i":
        return value.cast("bigint")
    if kind == "b":
        return value.cast("boolean")
    if kind == "t":
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    if kind == "D":
        return F.date_format(value, "yyyy-MM-dd")
    if kind == "a":
        return F.array_join(value, "|")
    return F.round(value.cast("double") + F.lit(_tie(kind)), _digits(kind)) + F.lit(0.0)


def _duck_value(name: str, kind: str) -> str:
    if kind == "s":
        return f"CAST({name} AS VARCHAR)"
    if kind == "i":
        return f"CAST({name} AS BIGINT)"
    if kind == "b":
        return f"CAST({name} AS BOOLEAN)"
    if kind == "t":
        return f"strftime({name}, '%Y-%m-%d %H:%M:%S')"
    if kind == "D":
        return f"strftime({name}, '%Y-%m-%d')"
    if kind == "a":
        return f"array_to_string({name}, '|')"
    return f"round(CAST({name} AS DOUBLE) + {_tie(kind):.15f}, {_digits(kind)}) + 0.0"


def sql(body: str, needs: str = "offers", ctes: str = "") -> str:
    """Put the input CTEs a query needs in front of its text.

    ``needs`` lists offers, meta, daily, changes; ``ctes`` adds the query's own.
    """
    from farescope.catalog.change_source import CHANGE_CTES

    names = needs.split()
    table = fixtures.duckdb_ctes()
    parts: list[str] = []
    if {"offers", "meta", "changes"} & set(names):
        parts.append(table["wide"])
        parts.append(table["offers"])
    if {"meta", "changes"} & set(names):
        parts.append(table["meta"])
    if "daily" in names:
        parts.append(table["daily"])
    if "changes" in names:
        parts.extend(CHANGE_CTES)
    if ctes:
        parts.append(ctes.strip().rstrip(","))
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body


def oracle_text(q: Query) -> str | None:
    if q.sql is None:
        return None
    cols = ", ".join(f"{_duck_value(chr(34) + n + chr(34), k)} AS {chr(34)}{n}{chr(34)}" for n, k in q.columns)
    return f"SELECT {cols} FROM (\n{q.sql}\n) AS result"


def load_all() -> dict[str, Query]:
    """Import every catalog module and return the registry."""
    from farescope.catalog import modules  # noqa: F401

    return REGISTRY


#: Line items that a task of a shuffle gets at most, on average: wide rows of several sorts fit into its share of the memory.
ROWS_A_TASK = 200_000
#: Size to which Spark joins small partitions where a session does not say otherwise.
SPARKS_JOINED = "67108864b"


def spread(spark: SparkSession, sf_dir: str) -> int:
    """Raise the number of shuffle partitions to what the line items need; a larger number of the session's stays.

    Adaptive execution may join small partitions, but not to more than a few hundred thousand rows either.
    """
    rows = fixtures.line_items(spark, sf_dir)
    now = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if now * ROWS_A_TASK < rows:
        now = -(-rows // ROWS_A_TASK)
        spark.conf.set("spark.sql.shuffle.partitions", str(now))
    joined = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if rows > ROWS_A_TASK and spark.conf.get(joined) == SPARKS_JOINED:
        spark.conf.set(joined, "16m")
    return now


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    q = load_all()[name]
    spread(spark, sf_dir)
    return shape(q.build(Context(spark, sf_dir)), q.columns)
