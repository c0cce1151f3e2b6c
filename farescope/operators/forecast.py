"""Baseline forecasts, their evaluation, rolling back-tests, alert quality and drift.

A series has one value per key and day. Windows and ordered arrays over a series are therefore as
long as the history in days, whatever the size of the offers behind it.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farescope.functions import SERIES_KEY, clip, ewm_last, ewm_series, ratio, split_medians, top
from farescope.operators.rollups import DAILY_KEY
from farescope.session import work_dir
from farescope.sources import latest_meta

# Fixed targets and code values.
UNIT_TARGETS = {"soldout_rate"}
NON_NEGATIVE_TARGETS = {"total_change_events", "price_events", "availability_events", "min_price_bdt",
                        "avg_seat_available", "offers_count", "soldout_rate"}
AIRLINE_MODEL_CODE = {"hybrid": 0.0, "hub_spoke": 1.0, "lcc": 2.0}
TRIP_PURPOSE_CODE = {"general": 0.0, "labor_outbound": 1.0, "labor_return": 2.0, "tourism": 3.0}
YIELD_CLASS_CODE = {"unknown": 0.0, "balanced": 1.0, "medium_high": 2.0, "tourism": 3.0, "high": 4.0}
HORIZON_BUCKET_CODE = {"unknown": 0.0, "D0_visa": 1.0, "D8_30": 2.0, "D31_90": 3.0, "D91_180": 4.0, "D181p": 5.0}
PRIOR_FLAGS = ["market_is_middle_east", "market_is_ksa", "market_is_thailand_tourism", "market_is_labor_outbound",
               "market_is_labor_return", "airline_is_hub_spoke", "airline_is_lcc", "airline_is_return_oriented",
               "horizon_is_visa_window", "horizon_is_long_window"]


# ---------------------------------------------------------------- frames


def offer_event_daily(offers: DataFrame) -> DataFrame:
    """Daily 0/1 events per series from the offers: did price or seats differ from the day before?"""
    daily = offers.groupBy(F.to_date("captured_at").alias("report_day"), *SERIES_KEY).agg(
        F.min("price_total").alias("price"), F.avg("seat_available").alias("seats"))
    w = Window.partitionBy(*SERIES_KEY).orderBy("report_day")

    def moved(name: str) -> Column:
        before = F.lag(name).over(w)
        return (before.isNotNull() & ~F.col(name).eqNullSafe(before)).cast("int")

    out = daily.withColumns({"price_events": moved("price"), "availability_events": moved("seats")})
    return out.select("report_day", *SERIES_KEY,
                      (F.col("price_events") + F.col("availability_events")).alias("total_change_events"),
                      "price_events", "availability_events")


def event_daily(summary: DataFrame, offers: DataFrame) -> DataFrame:
    """Daily events from the change summary, or from the offers when it covers fewer than two days."""
    cols = ["report_day", *SERIES_KEY, "total_change_events", "price_events", "availability_events"]
    fallback = offer_event_daily(offers)
    days = summary.agg(F.countDistinct("report_day")).scalar()
    other = fallback.agg(F.countDistinct("report_day")).scalar()
    use_other = (days < 2) & (other >= 2)
    return summary.select(*cols).where(~use_other).unionByName(fallback.select(*cols).where(use_other))


def search_dynamic(offers: DataFrame, meta: DataFrame) -> DataFrame:
    """Price, seats and sold-out rate per series, capture day and departure day."""
    rows = offers.join(latest_meta(meta.select("offer_id", "meta_id", "soldout")), "offer_id", "left")
    out = rows.groupBy(
        F.to_date("captured_at").alias("report_day"), F.to_date("departure").alias("departure_day"), *SERIES_KEY
    ).agg(
        F.min("price_total").alias("min_price_bdt"), F.avg("seat_available").alias("avg_seat_available"),
        F.count("*").alias("offers_count"),
        F.count_if(F.coalesce("soldout", F.lit(False))).alias("soldout_offers"))
    return out.withColumns({
        "soldout_rate": ratio(F.col("soldout_offers"), F.col("offers_count")),
        "days_to_departure": F.datediff("departure_day", "report_day"),
    })


# ---------------------------------------------------------------- predictions


def _series(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("report_day")


def add_baselines(df: DataFrame, target: str, windows: Sequence[int] = (3, 7),
                  keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Last value and rolling means of the rows before."""
    w = _series(keys)
    y = F.col(target).cast("double")
    before = F.lag(y).over(w)
    return df.withColumns({
        "prev_actual_value": before,
        "pred_last_value": before,
        **{f"pred_rolling_mean_{n}": F.avg(y).over(w.rowsBetween(-n, -1)) for n in windows},
    })


def _with_ewm(df: DataFrame, target: str, alpha: float, keys: Sequence[str], name: str) -> DataFrame:
    """Add the exponentially weighted mean of all earlier rows of the series."""
    others = [c for c in df.columns if c not in keys and c != "report_day"]
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("report_day", *others))).alias("rows"))
    running = ewm_series(F.transform("rows", lambda r: r[target].cast("double")), alpha)
    shifted = F.concat(F.array(F.lit(None).cast("double")), running)
    paired = rows.select(*keys, F.arrays_zip("rows", F.slice(shifted, F.lit(1), F.size("rows")).alias("ewm")).alias("z"))
    flat = paired.select(*keys, F.inline("z"))
    return flat.select(*[F.col(c) if c in keys else F.col(f"rows.{c}").alias(c) for c in df.columns],
                       F.col("ewm").alias(name))


def alpha_name(alpha: float) -> str:
    return f"pred_ewm_alpha_{alpha:.2f}".replace(".", "_")


def add_extra_baselines(df: DataFrame, target: str, seasonal_lag: int = 7, alpha: float = 0.3,
                        keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Seasonal naive value and the exponentially weighted mean of the rows before."""
    alpha, lag = max(0.0001, min(alpha, 1.0)), max(seasonal_lag, 1)
    out = df.withColumn(f"pred_seasonal_naive_{lag}", F.lag(F.col(target).cast("double"), lag).over(_series(keys)))
    return _with_ewm(out, target, alpha, keys, alpha_name(alpha))


def prediction_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("pred_")]


def clip_predictions(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep predictions of counts and prices at 0 or more, and of rates within 0 and 1."""
    if target not in NON_NEGATIVE_TARGETS:
        return df
    high = 1.0 if target in UNIT_TARGETS else None
    return df.withColumns({c: clip(F.col(c), 0.0, high) for c in columns or prediction_columns(df)})


def next_day(df: DataFrame, target: str, windows: Sequence[int] = (3, 7), min_history: int = 3, seasonal_lag: int = 7,
             alpha: float = 0.3, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Prediction for the day after the last one of every series with enough history."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("report_day").desc()))
    y = F.col(target).cast("double")
    rows = df.select("*", y.alias("__y"), back.alias("__back"))
    measures = [
        F.max("report_day").alias("latest_report_day"), F.count("*").alias("history_days"),
        F.max(F.when(F.col("__back") == 1, F.col("__y"))).alias("latest_actual_value"),
        *[F.avg(F.when(F.col("__back") <= n, F.col("__y"))).alias(f"pred_rolling_mean_{n}") for n in windows],
        F.max(F.when(F.col("__back") == seasonal_lag, F.col("__y"))).alias(f"pred_seasonal_naive_{seasonal_lag}"),
        ewm_last(F.transform(F.array_sort(F.collect_list(F.struct("report_day", "__y"))), lambda s: s["__y"]), alpha)
        .alias(alpha_name(alpha)),
    ]
    if "departure_day" in df.columns:
        measures.append(F.max(F.when(F.col("__back") == 1, F.col("departure_day"))).alias("__departure"))
    out = rows.groupBy(*keys).agg(*measures).where(F.col("history_days") >= min_history)
    out = out.withColumns({
        "predicted_for_day": F.date_add("latest_report_day", 1), "pred_last_value": F.col("latest_actual_value"),
    })
    if "departure_day" in df.columns:
        out = out.withColumns({
            "days_to_departure_latest": F.datediff("__departure", "latest_report_day"),
            "days_to_departure_next_search": F.datediff("__departure", "latest_report_day") - 1,
        }).drop("__departure")
    return out


def trend_summary(df: DataFrame, target: str, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Level, spread and direction of every series."""
    y = F.col(target).cast("double")
    day = F.when(y.isNotNull(), F.col("report_day"))
    out = df.groupBy(*keys).agg(
        F.min("report_day").alias("first_report_day"), F.max("report_day").alias("last_report_day"),
        F.count(y).alias("obs_count"), F.min_by(y, day).alias("first_value"), F.max_by(y, day).alias("last_value"),
        F.min(y).alias("min_value"), F.max(y).alias("max_value"), F.avg(y).alias("avg_value"),
        F.stddev_samp(y).alias("std_value"))
    delta = F.col("last_value") - F.col("first_value")
    out = out.withColumns({
        "delta_value": delta,
        "delta_pct": F.try_divide(delta, F.nullif(F.col("first_value"), F.lit(0.0))) * 100.0,
        "trend_direction": F.when(delta > 0, "UP").when(delta < 0, "DOWN").otherwise("FLAT"),
    })
    if "departure_day" in keys:
        out = out.withColumn("days_to_departure_latest", F.datediff("departure_day", "last_report_day"))
    return out


# ---------------------------------------------------------------- metrics


def long_predictions(df: DataFrame, target: str, columns: Sequence[str] | None = None,
                     keep: Sequence[str] = ()) -> DataFrame:
    """One row per observation and model: actual, previous actual and prediction."""
    items = F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).cast("double").alias("pred"))
                      for c in columns or prediction_columns(df)])
    return df.select(*keep, F.col(target).cast("double").alias("actual"),
                     F.col("prev_actual_value").cast("double").alias("prev"), F.inline(items))


def _metrics() -> list[Column]:
    p, a, prev = F.col("pred"), F.col("actual"), F.col("prev")
    valid = p.isNotNull() & a.isNotNull()
    err = F.when(valid, F.abs(p - a))
    size = (F.abs(p) + F.abs(a)) / 2
    turned = valid & prev.isNotNull()
    up, pred_up = F.signum(a - prev), F.signum(p - prev)
    counts = []
    for name, side in (("up", 1), ("down", -1)):
        counts += [F.count_if(turned & (up == side) & (pred_up == side)).alias(f"tp_{name}"),
                   F.count_if(turned & (up != side) & (pred_up == side)).alias(f"fp_{name}"),
                   F.count_if(turned & (up == side) & (pred_up != side)).alias(f"fn_{name}")]
    return [
        F.count_if(valid).alias("n"), F.avg(err).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.try_divide(err, F.nullif(a, F.lit(0.0)))) * 100).alias("mape_pct"),
        (F.avg(F.try_divide(err, F.nullif(size, F.lit(0.0)))) * 100).alias("smape_pct"),
        F.count_if(turned).alias("n_directional"), F.count_if(turned & (up == pred_up)).alias("hits"), *counts,
    ]


def _f1(side: str) -> Column:
    tp, fp, fn = F.col(f"tp_{side}"), F.col(f"fp_{side}"), F.col(f"fn_{side}")
    precision = F.coalesce(ratio(tp, F.nullif(tp + fp, F.lit(0))), F.lit(0.0))
    recall = F.coalesce(ratio(tp, F.nullif(tp + fn, F.lit(0))), F.lit(0.0))
    both = precision + recall
    score = F.when(both == 0, F.lit(0.0)).otherwise(F.try_divide(2 * precision * recall, both))
    return F.when((tp + fp + fn) > 0, score)


def _figures(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rates of the summed counts."""
    out = sums.withColumns({"f1_up": _f1("up"), "f1_down": _f1("down"),
                            "directional_accuracy_pct": ratio(F.col("hits"), F.col("n_directional")) * 100.0})
    macro = F.coalesce((F.col("f1_up") + F.col("f1_down")) / 2, "f1_up", "f1_down")
    return out.withColumn("f1_macro", macro).select(
        *by, "model", "n", "mae", "rmse", "mape_pct", "smape_pct", "n_directional", "directional_accuracy_pct", "f1_up",
        "f1_down", "f1_macro")


def error_metrics(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Error and direction metrics per model, and per ``by`` group."""
    return _figures(long.groupBy(*by, "model").agg(*_metrics()), by)


def error_metrics_sets(long: DataFrame, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Metrics per model overall and per series in one read; ``overall`` tells the rows of all series, whose keys are null."""
    sums = long.groupingSets([["model"], [*keys, "model"]], *keys, "model").agg((F.grouping_id() > 0).alias("overall"), *_metrics())
    return _figures(sums, ["overall", *keys])


def evaluate(df: DataFrame, target: str, columns: Sequence[str] | None = None,
             keys: Sequence[str] = SERIES_KEY) -> tuple[DataFrame, DataFrame]:
    """Metrics per model overall, and per series: two views of one stored aggregate."""
    both = error_metrics_sets(long_predictions(df, target, columns, keys), keys)
    path = work_dir(df.sparkSession, "evaluation")
    both.write.parquet(path)
    stored = df.sparkSession.read.schema(both.schema).parquet(path)
    return stored.where("overall").drop("overall", *keys), stored.where("NOT overall").drop("overall")


def _ranked(evals: DataFrame, scope: Sequence[str], metric: str, coverage: float) -> DataFrame:
    """Candidates with enough coverage, ranked 1 for the best. One row per scope and model."""
    metric = "rmse" if metric.lower() == "rmse" else "mae"
    ratio_ = max(0.0, min(1.0, coverage))
    group = Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(1))
    rows = evals.where((F.col("n") > 0) & F.col(metric).isNotNull())
    rows = rows.withColumn("max_candidate_n", F.max("n").over(group))
    rows = rows.withColumn("coverage_threshold_n", F.floor(F.col("max_candidate_n") * ratio_))
    rows = rows.where(F.col("n") >= F.col("coverage_threshold_n"))
    other = "rmse" if metric == "mae" else "mae"
    return rows.withColumns({
        "candidate_models": F.count("*").over(group),
        "__best": F.row_number().over(group.orderBy(metric, other, "model")),
        "__win": F.row_number().over(group.orderBy(metric, "rmse", "model")),
    })


def best_model(evals: DataFrame, scope: Sequence[str] = (), metric: str = "mae", coverage: float = 0.8) -> DataFrame:
    """Name of the best model overall or per scope."""
    return _ranked(evals, scope, metric, coverage).where("__best = 1").select(*scope, F.col("model").alias("selected_model"))


def winner_table(evals: DataFrame, scope: Sequence[str], metric: str = "mae", coverage: float = 0.8) -> DataFrame:
    """Best model per scope with its figures. Ties on the metric are broken by RMSE and name."""
    metric = "rmse" if metric.lower() == "rmse" else "mae"
    best = _ranked(evals, scope, metric, coverage).where("__win = 1")
    return best.select(
        *scope, F.col("model").alias("winner_model"), F.lit(metric).alias("winner_metric"),
        F.col("n").alias("winner_n"), F.col("mae").alias("winner_mae"), F.col("rmse").alias("winner_rmse"),
        F.col("directional_accuracy_pct").alias("winner_directional_accuracy_pct"),
        F.col("f1_macro").alias("winner_f1_macro"), "max_candidate_n", "coverage_threshold_n", "candidate_models")


# ---------------------------------------------------------------- back-test


def _plan(df: DataFrame, train: int, val: int, test: int, step: int) -> DataFrame:
    """One row with the window lengths in use and the number of splits.

    Where the fixed windows do not fit, they follow from the length of the history: 60, 20 and 20 %
    of the days, at least 5, 2 and 2.
    """
    days = df.where("report_day is not null").agg(F.min("report_day").alias("lo"), F.max("report_day").alias("hi"))
    total = (F.datediff("hi", "lo") + 1).alias("total")
    train, val, test, step = (max(int(v), 1) for v in (train, val, test, step))

    def splits(length: Column) -> Column:
        room = F.col("total") - length
        return F.when(room >= 0, F.floor(room / F.col("step")) + 1).otherwise(0).cast("int")

    fixed = days.select("lo", "hi", total).withColumns({
        "train": F.lit(train), "val": F.lit(val), "test": F.lit(test), "step": F.lit(step)})
    fixed = fixed.withColumn("n", splits(F.col("train") + F.col("val") + F.col("test")))
    auto = F.expr("""named_struct(
        'train', greatest(5, CAST(floor(total * 0.6D) AS int)),
        'val', greatest(2, CAST(floor(total * 0.2D) AS int)),
        'test', greatest(2, CAST(floor(total * 0.2D) AS int)))""")
    use_auto = (F.col("n") == 0) & (F.col("total") >= 10)
    plan = fixed.withColumn("auto", auto).select(
        "lo", "total", use_auto.alias("auto_window"),
        *[F.when(use_auto, F.col(f"auto.{c}")).otherwise(F.col(c)).alias(c) for c in ("train", "val", "test")],
        F.when(use_auto, F.greatest(F.lit(1), F.col("auto.test"))).otherwise(F.col("step")).alias("step"))
    return plan.withColumn("n", splits(F.col("train") + F.col("val") + F.col("test")))


def backtest_splits(df: DataFrame, train: int = 28, val: int = 7, test: int = 7, step: int = 7) -> DataFrame:
    """Train, validation and test days of every split."""
    plan = _plan(df, train, val, test, step).where("n > 0")
    return plan.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).selectExpr(
        "k + 1 AS split_id", "auto_window",
        "date_add(lo, k * step) AS train_start", "date_add(lo, k * step + train - 1) AS train_end",
        "date_add(lo, k * step + train) AS val_start", "date_add(lo, k * step + train + val - 1) AS val_end",
        "date_add(lo, k * step + train + val) AS test_start",
        "date_add(lo, k * step + train + val + test - 1) AS test_end")


def assign_splits(df: DataFrame, train: int = 28, val: int = 7, test: int = 7, step: int = 7) -> DataFrame:
    """Repeat every row for the splits it belongs to, with ``split_id`` and ``dataset``.

    The splits are evenly spaced, so the ones a day falls into follow by arithmetic and no range
    join with the split table is needed.
    """
    plan = _plan(df, train, val, test, step).agg(F.first(F.struct("lo", "train", "val", "test", "step", "n"))).scalar()
    rows = df.where("report_day is not null").withColumn("__p", plan)
    parts = []
    for name, start, length in (("train", "0", "__p.train"), ("val", "__p.train", "__p.val"),
                                ("test", "__p.train + __p.val", "__p.test")):
        offset = f"(datediff(report_day, __p.lo) - ({start}))"
        first = f"greatest(0, CAST(ceil(({offset} - ({length}) + 1) / __p.step) AS int))"
        last = f"least(__p.n - 1, CAST(floor({offset} / __p.step) AS int))"
        parts.append(f"CASE WHEN {last} >= {first} THEN transform(sequence({first}, {last}), "
                     f"k -> named_struct('split_id', k + 1, 'dataset', '{name}')) END")
    arrays = ", ".join(f"coalesce({p}, array())" for p in parts)
    return rows.select(*df.columns, F.expr(f"inline(concat({arrays}))"))


def rolling_backtest(df: DataFrame, target: str, columns: Sequence[str] | None = None, train: int = 28, val: int = 7,
                     test: int = 7, step: int = 7, keys: Sequence[str] = SERIES_KEY, metric: str = "mae",
                     coverage: float = 0.8) -> dict[str, DataFrame]:
    """Metrics per split, the selected model of every split, and metrics per series."""
    columns = list(columns or prediction_columns(df))
    assigned = assign_splits(df, train, val, test, step)
    splits = backtest_splits(df, train, val, test, step)
    scored = long_predictions(assigned.where("dataset <> 'train'"), target, columns, [*keys, "split_id", "dataset"])
    overall = error_metrics(scored, ["split_id", "dataset"])
    routes = error_metrics(scored, ["split_id", "dataset", *keys])
    chosen = best_model(overall.where("dataset = 'val'"), ["split_id"], metric, coverage)
    sizes = assigned.groupBy("split_id").agg(*[
        F.count_if(F.col("dataset") == d).alias(f"{d}_rows") for d in ("train", "val", "test")])
    table = splits.join(sizes, "split_id", "left").join(chosen, "split_id", "left").fillna(
        0, ["train_rows", "val_rows", "test_rows"])
    days = splits.drop("auto_window")
    metrics = overall.join(chosen, "split_id", "left").join(days, "split_id").withColumn(
        "selected_on_val", F.coalesce(F.col("model") == F.col("selected_model"), F.lit(False))).drop("selected_model")
    return {"metrics": metrics, "splits": table, "route_metrics": routes.join(days, "split_id")}


# ---------------------------------------------------------------- learning frames


def ml_features(df: DataFrame, target: str, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Lag, rolling and calendar features of a series, with market priors where the frame has them."""
    w = _series(keys)
    y = F.col(target).cast("double")
    out = df.withColumns({f"lag{n}": F.lag(y, n).over(w) for n in (1, 2, 3, 7, 14)})
    rolling7 = w.rowsBetween(-7, -1)
    out = out.withColumns({
        **{f"roll{n}": F.avg(y).over(w.rowsBetween(-n, -1)) for n in (3, 7, 14)},
        "roll7_std": F.when(F.count(y).over(rolling7) >= 2, F.stddev_samp(y).over(rolling7)),
        "diff_1_2": F.col("lag1") - F.col("lag2"),
        "diff_1_7": F.col("lag1") - F.col("lag7"),
        "dow": F.weekday("report_day"),
        "dom": F.dayofmonth("report_day"),
    })
    if "departure_day" in df.columns:
        out = out.withColumn("days_to_departure", F.datediff("departure_day", "report_day"))
    for name, codes in (("airline_model_proxy", AIRLINE_MODEL_CODE), ("trip_purpose_proxy", TRIP_PURPOSE_CODE),
                        ("yield_class_proxy", YIELD_CLASS_CODE), ("horizon_bucket_proxy", HORIZON_BUCKET_CODE)):
        if name in df.columns:
            value = F.trim(name) if name.startswith("horizon") else F.lower(F.trim(name))
            table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
            out = out.withColumn(f"{name}_code", F.try_element_at(table, value))
    return _with_ewm(out, target, 0.3, keys, "ewm03")


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact median per column. One row."""
    values = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    return split_medians(df, [], values)


def fill_features(train: DataFrame, frames: Sequence[DataFrame], columns: Sequence[str]) -> list[DataFrame]:
    """Fill gaps with the training median, then 0. All given frames get the same fill."""
    fills = medians(train, columns).agg(F.struct(*[F.max(c).alias(c) for c in columns])).scalar()
    return [f.withColumns({c: F.coalesce(F.col(c).cast("double"), fills[c], F.lit(0.0)) for c in columns})
            for f in frames]


def recency_weight(df: DataFrame, keys: Sequence[str] = SERIES_KEY, low: float = 0.5, high: float = 1.0) -> DataFrame:
    """Weight rising evenly from ``low`` to ``high`` along a series; a single row gets ``high``."""
    place = F.row_number().over(_series(keys))
    size = F.count("*").over(Window.partitionBy(*keys))
    step = F.try_divide((place - 1).cast("double"), F.nullif(size - 1, F.lit(0)))
    return df.withColumn("weight", F.coalesce(F.lit(low) + (high - low) * step, F.lit(high)))


def robust_bounds(df: DataFrame, target: str, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Range a prediction may take per series: the 1 and 99 % quantiles widened by two quartile ranges."""
    y = F.col(target).cast("double")
    finite = F.when(y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")), y)
    q = df.groupBy(*keys).agg(F.percentile(finite, F.array(*[F.lit(p) for p in (0.01, 0.25, 0.75, 0.99)])).alias("q"),
                              F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    iqr = F.greatest(F.lit(0.0), F.col("q")[2] - F.col("q")[1])
    lower, upper = F.col("q")[0] - 2.0 * iqr, F.col("q")[3] + 2.0 * iqr
    return q.select(*keys, F.when(upper < lower, F.col("lo")).otherwise(lower).alias("lower"),
                    F.when(upper < lower, F.col("hi")).otherwise(upper).alias("upper"))


# ---------------------------------------------------------------- alerts and drift


def alert_frame(summary: DataFrame, availability: DataFrame) -> DataFrame:
    zero = ["total_change_events", "price_events", "availability_events"]
    side = ["soldout_flag_changes", "row_removed_events", "row_added_events"]
    return summary.select(*DAILY_KEY, *zero).join(
        availability.select(*DAILY_KEY, *side), DAILY_KEY, "left").fillna(0, zero + side)


def classify_alerts(df: DataFrame, spike: float = 250.0, sellout: float = 1.0, lookback: int = 7) -> DataFrame:
    """Actual spikes and sell-outs, and those expected from the rolling mean of the days before."""
    before = _series(SERIES_KEY).rowsBetween(-max(lookback, 1), -1)
    return df.withColumns({
        "pred_spike_score": F.avg("total_change_events").over(before),
        "pred_sellout_score": F.avg("soldout_flag_changes").over(before),
    }).withColumns({
        "actual_spike_alert": F.col("total_change_events") >= spike,
        "pred_spike_alert": F.coalesce(F.col("pred_spike_score") >= spike, F.lit(False)),
        "actual_sellout_alert": (F.col("soldout_flag_changes") >= sellout) | (F.col("row_removed_events") > 0),
        "pred_sellout_alert": F.coalesce(F.col("pred_sellout_score") >= sellout, F.lit(False)),
    })


def alert_quality(classified: DataFrame, by: Sequence[str] = (), costs: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Confusion counts, rates and costs per alert type, overall or per group."""
    costs = costs or {"spike": (1.0, 3.0), "sellout": (2.0, 8.0)}
    items = F.array(*[F.struct(
        F.lit(n).alias("alert_type"), F.col(f"actual_{n}_alert").alias("actual"), F.col(f"pred_{n}_alert").alias("pred"),
        F.lit(fa).alias("false_alarm_unit_cost"), F.lit(miss).alias("missed_event_unit_cost"))
        for n, (fa, miss) in costs.items()])
    long = classified.select(*by, F.inline(items))
    a, p = F.coalesce("actual", F.lit(False)), F.coalesce("pred", F.lit(False))
    out = long.groupBy(*by, "alert_type", "false_alarm_unit_cost", "missed_event_unit_cost").agg(
        F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"),
        F.count_if(~a & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    both = F.col("precision") + F.col("recall")
    return out.withColumns({
        "f1": F.try_divide(2 * F.col("precision") * F.col("recall"), F.nullif(both, F.lit(0.0))),
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "support": tp + fn,
        "false_alarm_cost_total": fp * F.col("false_alarm_unit_cost"),
        "missed_event_cost_total": fn * F.col("missed_event_unit_cost"),
        "total_cost": fp * F.col("false_alarm_unit_cost") + fn * F.col("missed_event_unit_cost"),
    })


def drift(events: DataFrame, as_of: datetime, lookback_days: int = 60, window: int = 7, min_points: int = 8,
          threshold: float = 1.35) -> DataFrame:
    """Error of a last-value forecast in the newest days against the days before, per series."""
    day = F.to_date("detected_at")
    since = F.date_sub(F.to_date(F.lit(as_of)), lookback_days)
    daily = events.where(F.col("detected_at") >= since).groupBy(*SERIES_KEY, day.alias("day")).agg(
        F.count("*").alias("events"))
    w = Window.partitionBy(*SERIES_KEY)
    error = F.abs(F.col("events") - F.lag("events").over(w.orderBy("day")))
    rows = daily.withColumn("error", error).where("error is not null").withColumn(
        "back", F.row_number().over(w.orderBy(F.col("day").desc())))
    out = rows.groupBy(*SERIES_KEY).agg(
        F.count("*").alias("points"),
        F.coalesce(F.avg(F.when(F.col("back") <= window, F.col("error"))), F.lit(0.0)).alias("recent"),
        F.coalesce(F.avg(F.when((F.col("back") > window) & (F.col("back") <= 2 * window), F.col("error"))), F.lit(0.0))
        .alias("prior"),
    ).where(F.col("points") >= min_points)
    value = F.when(F.col("prior") > 0, F.try_divide("recent", "prior")).when(F.col("recent") > 0, 999.0).otherwise(1.0)
    return out.select(*SERIES_KEY, "points", F.round("recent", 4).alias("recent_mae"), F.round("prior", 4).alias("prior_mae"),
                      F.round(value, 4).alias("drift_ratio"), (value >= threshold).alias("drift_flag"))


def drift_status(drifts: DataFrame) -> DataFrame:
    """Overall status: WARN from 20 % drifting series, FAIL from 40 % (at least one, two). One row."""
    n, bad = F.count("*"), F.count_if("drift_flag")
    fail = (n > 0) & (bad >= F.greatest(F.lit(2), F.floor(n * 0.4)))
    warn = (n > 0) & (bad >= F.greatest(F.lit(1), F.floor(n * 0.2)))
    return drifts.agg(F.when(fail, "FAIL").when(warn, "WARN").otherwise("PASS").alias("overall_status"),
                      n.alias("group_count"), bad.alias("drift_group_count"))


# ---------------------------------------------------------------- bundles and leaderboards


def latest_bundle(bundles: DataFrame, facts: DataFrame, needs: str | None = None) -> DataFrame:
    """Rows of a fact that belong to the newest bundle, optionally the newest having a flag set."""
    rows = bundles.where(F.col(needs)) if needs else bundles
    newest = rows.orderBy(F.col("bundle_created_at_utc").desc(), F.col("stamp").desc(), F.col("bundle_name").desc())
    head = newest.limit(1).select("bundle_id", *[F.col(c) for c in bundles.columns if c != "bundle_id" and c not in facts.columns])
    return facts.join(head, "bundle_id")


def leaderboard(evals: DataFrame, metric: str = "mae", ascending: bool = True, n: int | None = None, min_n: int = 0,
                ties: Sequence[str] = ("model",)) -> DataFrame:
    """Rows with the metric, best or worst first."""
    rows = evals.where(F.col(metric).isNotNull() & (F.coalesce("n", F.lit(0)) >= min_n))
    order = F.col(metric).asc() if ascending else F.col(metric).desc()
    return top(rows, n, order, *ties)


def winner_board(winners: DataFrame, n: int | None = None, min_n: int = 5, ties: Sequence[str] = ("winner_model",)) -> DataFrame:
    """Winners with enough rows, lowest MAE first, unknown MAE last."""
    rows = winners.where(F.coalesce("winner_n", F.lit(0)) >= min_n)
    return top(rows, n, F.col("winner_mae").asc_nulls_last(), *ties)


#: First the median of the quantile model, where there is one; names of other models' medians are accepted too.
PREFERRED = ["pred_dl_mlp_q50", "pred_ml_catboost_q50", "pred_ml_lightgbm_q50", "pred_gbt_q50", "pred_rolling_mean_3", "pred_last_value"]


def watchlist(next_days: DataFrame, n: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Series whose preferred forecast is furthest from the last actual value."""
    have = [c for c in PREFERRED if c in next_days.columns]
    value = F.coalesce(*[F.col(c) for c in have])
    key = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in have])
    rows = next_days.withColumns({"preferred_key": key, "preferred_value": value,
                                  "delta": value - F.col("latest_actual_value")})
    return top(rows.where("preferred_value is not null"), n, F.coalesce(F.abs("delta"), F.lit(-1.0)).desc(), *ties)


def confidence_label(mae: Column, accuracy: Column) -> Column:
    def within(limit: float) -> Column:
        return mae.isNull() | (mae <= limit)

    return (F.when((accuracy >= 65) & within(800), "High confidence")
            .when((accuracy >= 58) & within(1500), "Moderate confidence").otherwise("Low confidence"))


def volatility_label(mae: Column, accuracy: Column) -> Column:
    return (F.when((mae >= 1500) | (accuracy < 55), "High-volatility route")
            .when((mae <= 600) & (accuracy >= 65), "Stable market").otherwise("Mixed signal"))


def action_label(delta: Column, confidence: Column) -> Column:
    size = F.abs(F.coalesce(delta, F.lit(0.0)))
    return (F.when(size >= 1500, "Watch closely").when(size >= 700, "Review pricing")
            .when(confidence == "Low confidence", "Monitor only").otherwise("Stable market"))


def forecast_labels(evals: DataFrame, watch: DataFrame, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Confidence, volatility and action text for the rows of a watch list."""
    rows = watch.join(evals.select(*keys, "mae", "directional_accuracy_pct"), list(keys), "left")
    mae, accuracy = F.col("mae"), F.col("directional_accuracy_pct")
    confidence = confidence_label(mae, accuracy)
    return rows.withColumns({"confidence_label": confidence, "volatility_label": volatility_label(mae, accuracy),
                             "action_label": action_label(F.col("delta"), confidence)})
