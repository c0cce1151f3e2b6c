"""Scans of the offer, side-car and rollup tables with the common filter grammar."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farescope.functions import first_rows


@dataclass
class Filters:
    """Optional filters of a report. With no date given, a scan covers only ``today``."""

    start_date: date | None = None
    end_date: date | None = None
    airlines: Sequence[str] | None = None
    origin: str | None = None
    destination: str | None = None
    cabin: str | None = None

    def conditions(self, day: str, today: date | None = None) -> list[Column]:
        out: list[Column] = []
        if self.start_date:
            out.append(F.col(day) >= F.lit(self.start_date))
        if self.end_date:
            out.append(F.col(day) <= F.lit(self.end_date))
        if not out and today is not None:
            out.append(F.col(day) == F.lit(today))
        if self.airlines:
            out.append(F.col("airline").isin([a.strip().upper() for a in self.airlines]))
        if self.origin:
            out.append(F.col("origin") == self.origin.upper())
        if self.destination:
            out.append(F.col("destination") == self.destination.upper())
        if self.cabin:
            out.append(F.col("cabin") == self.cabin)
        return out


def apply_filters(df: DataFrame, filters: Filters, day: str, today: date | None = None) -> DataFrame:
    for condition in filters.conditions(day, today):
        df = df.where(condition)
    return df


def read_offers(spark: SparkSession, path: str) -> DataFrame:
    """Offer table written by ``write_offers``: the folder layout carries ``capture_date``."""
    return spark.read.parquet(path)


def write_offers(offers: DataFrame, path: str, mode: str = "append", by_month: bool = False) -> None:
    """Store offers by capture date (or month), sorted by route so that file statistics prune scans.

    Months suit long histories with few offers per day; the date stays a column either way.
    """
    day = F.to_date("captured_at")
    rows = offers.withColumn("capture_date", day)
    folder = "capture_date"
    if by_month:
        rows, folder = rows.withColumn("capture_month", F.date_format(day, "yyyy-MM")), "capture_month"
    rows.sortWithinPartitions(folder, "airline", "origin", "destination").write.mode(mode).partitionBy(folder).parquet(path)


def scan_offers(offers: DataFrame, filters: Filters, today: date | None = None) -> DataFrame:
    """Offers under the report filters; date filters hit the partition column where there is one."""
    day = "capture_date"
    if "capture_month" in offers.columns:
        start, end = filters.start_date, filters.end_date
        if not start and not end:
            start = end = today
        if start:
            offers = offers.where(F.col("capture_month") >= f"{start:%Y-%m}")
        if end:
            offers = offers.where(F.col("capture_month") <= f"{end:%Y-%m}")
    if day in offers.columns:
        return apply_filters(offers, filters, day, today)
    return apply_filters(offers.withColumn(day, F.to_date("captured_at")), filters, day, today).drop(day)


def scan_daily(rollup: DataFrame, filters: Filters, today: date | None = None) -> DataFrame:
    """A daily rollup under the same filters, by ``report_day``."""
    return apply_filters(rollup, filters, "report_day", today)


def _meta_only(meta: DataFrame, offers: DataFrame) -> DataFrame:
    """Side-car without the columns the offer already has."""
    return meta.drop(*[c for c in meta.columns if c in offers.columns and c != "offer_id"])


def offers_with_meta(offers: DataFrame, meta: DataFrame) -> DataFrame:
    """Offer with every side-car row it has; offers without one stay."""
    return offers.join(_meta_only(meta, offers), "offer_id", "left")


def latest_meta(meta: DataFrame) -> DataFrame:
    """Newest side-car row per offer. The result stays partitioned by ``offer_id``."""
    return first_rows(meta, ["offer_id"], [F.col("meta_id").desc()])


def offers_with_latest_meta(offers: DataFrame, meta: DataFrame) -> DataFrame:
    """Offer with its newest side-car row; offers without one stay."""
    return offers.join(_meta_only(latest_meta(meta), offers), "offer_id", "left")
