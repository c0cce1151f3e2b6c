"""Models on inventory states, fitted with MLlib on the executors; those of single routes are in ``route_models``.

The driver runs the list of fits and reads back one row of figures per model; rows stay in Spark.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farescope.functions import ratio, split_medians
from farescope.operators import route_models
from farescope.operators.inventory import time_split
from farescope.session import work_dir

# Identifiers, labels and texts that are no features.
_EXCLUDED = {"cycle_id", "probe_group_id", "probe_join_id", "flight_key", "captured_at", "departure_date", "observed_at_utc",
             "departure", "arrival", "inventory_confidence_summary", "party_gap_profile", "is_test"}
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
TARGET = "y_next_search_lowest_fare_delta"


@dataclass
class FeatureSet:
    """Names of the usable feature columns by kind."""

    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    boolean: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)


def feature_matrix(states: DataFrame, ablation: str = "none", route: str | None = None) -> tuple[DataFrame, FeatureSet]:
    """States with numeric features as double and the rest as text, and the lists of both.

    One aggregate finds all-null columns and numbers that only take 0 and 1.
    """
    names = [c for c in states.columns if c not in _EXCLUDED and not c.startswith("y_")]
    if ablation == "drop_route_engineered":
        if not route:
            raise ValueError("name the route whose features are left out")
        names = [c for c in names if route.lower().replace("-", "_") not in c]
    types = dict(states.dtypes)
    figures = states.agg(*[F.count(c).alias(f"n_{c}") for c in names], *[
        F.count_if(~F.col(c).isin(0, 1)).alias(f"o_{c}") for c in names if types[c].startswith(_NUMERIC)]).first()
    out = FeatureSet(dropped=[c for c in names if figures[f"n_{c}"] == 0])
    for c in names:
        if c in out.dropped:
            continue
        if types[c] == "boolean" or (types[c].startswith(_NUMERIC) and figures[f"o_{c}"] == 0):
            out.boolean.append(c)
        if types[c] == "boolean" or types[c].startswith(_NUMERIC):
            out.numeric.append(c)
        elif types[c] == "string":
            out.categorical.append(c)
    kept = [c for c in states.columns if c not in out.numeric and c not in out.dropped]
    return states.select(*kept, *[F.col(c).cast("double").alias(c) for c in out.numeric]), out


def preprocessor(features: FeatureSet) -> Pipeline:
    """Median fill, scaling without centring, and one-hot codes that ignore unseen values."""
    numbers, codes = [f"{c}__f" for c in features.numeric], [f"{c}__i" for c in features.categorical]
    hot = [f"{c}__h" for c in features.categorical]
    stages: list = []
    if numbers:
        stages += [Imputer(strategy="median", inputCols=features.numeric, outputCols=numbers),
                   VectorAssembler(inputCols=numbers, outputCol="__numbers"),
                   StandardScaler(withMean=False, inputCol="__numbers", outputCol="__scaled")]
    if codes:
        stages += [StringIndexer(inputCols=features.categorical, outputCols=codes, handleInvalid="keep"),
                   OneHotEncoder(inputCols=codes, outputCols=hot, dropLast=True)]
    stages.append(VectorAssembler(inputCols=(["__scaled"] if numbers else []) + hot, outputCol="features"))
    return Pipeline(stages=stages)


def _fill_modes(train: DataFrame, df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fill missing categories with the most frequent one of the training rows."""
    if not names:
        return df
    modes = train.agg(F.struct(*[F.mode(c, True).alias(c) for c in names])).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), modes[c], F.lit("missing")) for c in names})


def _confusion(scored: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy and macro F1 of (model, label, predicted) counts."""
    counts = scored.groupBy("model", "label", "predicted").agg(F.count("*").alias("n"))
    sides = counts.select("model", F.inline(F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("guessed"),
                 F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("predicted").alias("cls"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("guessed"),
                 F.lit(0).cast("bigint").alias("hit")))))
    per = sides.groupBy("model", "cls").agg(*[F.sum(c).alias(c) for c in ("actual", "guessed", "hit")])
    recall = ratio(F.col("hit"), F.nullif(F.col("actual"), F.lit(0)))
    f1 = F.coalesce(ratio(2 * F.col("hit"), F.nullif(F.col("actual") + F.col("guessed"), F.lit(0))), F.lit(0.0))
    return per.groupBy("model").agg(F.sum("actual").alias("rows"), ratio(F.sum("hit"), F.sum("actual")).alias("accuracy"),
                                    F.avg(recall).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"))


def regression_metrics(scored: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """MAE, RMSE, median error and R2 of (y, predicted) per model."""
    err = F.col("y") - F.col("predicted")
    base = scored.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        (1 - F.try_divide(F.sum(err * err), F.nullif(F.var_pop("y") * F.count("*"), F.lit(0.0)))).alias("r2"))
    return base.join(split_medians(scored, keys, {"median_ae": F.abs(err)}), list(keys))


def _split(states: DataFrame, fraction: float, keep: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Training and test rows. They are stored first, since every fit reads them many times over."""
    marked = states if "is_test" in states.columns else time_split(states, fraction, tie=["flight_key", "probe_join_id", "adt_count"])
    path = work_dir(states.sparkSession, "split")
    marked.select(*keep, "is_test").write.parquet(path)
    stored = states.sparkSession.read.parquet(path)
    return stored.where(~F.col("is_test")), stored.where("is_test")


def top_features(model: PipelineModel, weights: Sequence[float], frame: DataFrame, n: int | None = None) -> list[tuple[str, float]]:
    """Names of the largest weights by size."""
    attrs = frame.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a["name"] for group in attrs.values() for a in group}
    ranked = sorted(enumerate(weights), key=lambda w: -abs(w[1]))[:n]
    return [(names.get(i, f"feature_{i}"), float(v)) for i, v in ranked]


def move_classifier(states: DataFrame, features: FeatureSet, test_fraction: float = 0.2, min_rows: int = 100) -> dict:
    """Classifier of the next price move (up, down, same) against the most frequent class."""
    rows = states.where(F.col("y_next_search_price_move_class").isin("up", "down", "same")).withColumn(
        "label_text", F.col("y_next_search_price_move_class"))
    n = rows.count()
    if n < min_rows:
        return {"skipped": True, "reason": f"Insufficient labeled rows for classification ({n})"}
    train, test = _split(rows, test_fraction, [*features.numeric, *features.categorical, "label_text"])
    classes = sorted(r[0] for r in train.groupBy("label_text").count().collect())
    code = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))])
    train = _fill_modes(train, train, features.categorical).withColumn("label", F.try_element_at(code, F.col("label_text")))
    test = _fill_modes(train, test, features.categorical)
    prep = preprocessor(features).fit(train)
    ready = prep.transform(train)
    # A penalty of one on the sum over rows; the objective here is their mean.
    model = LogisticRegression(family="multinomial", maxIter=1000, regParam=1.0 / max(ready.count(), 1), standardization=False).fit(ready)
    text = F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("prediction").cast("int") + 1)
    scored = _bare(model, states).transform(prep.transform(test)).select(F.col("label_text").alias("label"), text.alias("predicted"))
    majority = train.agg(F.mode("label_text", True)).scalar()
    both = scored.withColumn("model", F.lit("logistic")).unionByName(
        test.select(F.lit("majority").alias("model"), F.col("label_text").alias("label"), majority.alias("predicted")))
    weights = abs(model.coefficientMatrix.toArray()).mean(axis=0)
    return {"skipped": False, "metrics": _confusion(both), "top_features": top_features(prep, weights, ready)}


def _bare(model: LogisticRegressionModel, frame: DataFrame) -> LogisticRegressionModel:
    """A logistic model without its training summary: that of two classes holds the session, which can't go to a task once a
    table was observed in it. A copy keeps the summary, a stored model does not."""
    path = work_dir(frame.sparkSession, "logistic")
    model.write().save(path)
    return LogisticRegressionModel.load(path)


def delta_regressor(states: DataFrame, features: FeatureSet, test_fraction: float = 0.2, min_rows: int = 100,
                    alpha: float = 1.0) -> dict:
    """Ridge regression of the next price change against the training median."""
    rows = states.where(F.col(TARGET).isNotNull()).withColumn("y", F.col(TARGET).cast("double"))
    n = rows.count()
    if n < min_rows:
        return {"skipped": True, "reason": f"Insufficient labeled rows for regression ({n})"}
    train, test = _split(rows, test_fraction, [*features.numeric, *features.categorical, "y"])
    filled = _fill_modes(train, train, features.categorical)
    prep = preprocessor(features).fit(filled)
    ready = prep.transform(filled)
    model = _ridge(ready, "y", alpha)
    scored = model.transform(prep.transform(_fill_modes(train, test, features.categorical))).select(
        F.lit("ridge").alias("model"), "y", F.col("prediction").alias("predicted"))
    middle = split_medians(train, [], {"y": F.col("y")}).select("y").scalar()
    base = test.select(F.lit("median").alias("model"), "y", middle.alias("predicted"))
    return {"skipped": False, "metrics": regression_metrics(scored.unionByName(base)),
            "top_features": top_features(prep, model.coefficients.toArray(), ready)}


def _ridge(ready: DataFrame, label: str, alpha: float):
    """Ridge with the penalty on the sum of squares. MLlib divides that by the rows, and the penalty by the label's spread."""
    seen = ready.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("spread")).first()
    weight = alpha * (seen["spread"] or 1.0) / max(seen["n"], 1)
    return LinearRegression(labelCol=label, regParam=weight, elasticNetParam=0.0, standardization=False).fit(ready)


@dataclass
class TwoStageParams:
    test_fraction: float = 0.2
    min_move_delta: float = 0.0
    min_test_moves: int = 1
    min_stage_b_moves: int = 20
    stage_b: str = "ridge"
    calibration: str = "none"
    trees: int = 300
    trees_b: int = 400
    max_depth: int = 10
    seed: int = 42


def two_stage(states: DataFrame, features: FeatureSet, params: TwoStageParams | None = None) -> dict:
    """Move or no move first, then the size of the move on moved rows only.

    The classes are balanced by weights. With ``calibration`` sigmoid or isotonic the score of the
    forest is mapped on the training rows. The result has the scored test rows, stage figures and the
    combined figures with their baselines; too few rows or moves end with a reason.
    """
    params = params or TwoStageParams()
    rows = states.where(F.col(TARGET).isNotNull()).withColumn("y", F.col(TARGET).cast("double"))
    moved = F.abs("y") >= params.min_move_delta if params.min_move_delta > 0 else F.col("y") != 0
    train, test = _split(rows.withColumn("moved", moved.cast("double")), params.test_fraction,
                         [*features.numeric, *features.categorical, "y", "moved"])
    sizes = train.unionByName(test).agg(*[
        F.count_if(c).alias(n) for n, c in (
            ("train", ~F.col("is_test")), ("test", F.col("is_test")), ("train_moves", ~F.col("is_test") & (F.col("moved") == 1)),
            ("test_moves", F.col("is_test") & (F.col("moved") == 1)))]).first()
    if sizes["train"] + sizes["test"] < 100:
        return {"skipped": True, "reason": "Insufficient labeled rows for two-stage regression"}
    if sizes["train"] < 50 or sizes["test"] < 20:
        return {"skipped": True, "reason": "Insufficient rows after time split"}
    if sizes["test_moves"] < params.min_test_moves:
        return {"skipped": True, "reason": "Insufficient move rows in Stage A test split", "sparse_test_moves": True}
    if sizes["train_moves"] in (0, sizes["train"]):
        return {"skipped": True, "reason": "Stage A train split has only one class (move/no-move)"}
    if sizes["train_moves"] < params.min_stage_b_moves:
        return {"skipped": True, "reason": "Insufficient moved rows for Stage B training", "sparse_stage_b": True}

    # A number that no training row has, as in a short fold of one route, has no median and tells nothing.
    given = train.agg(F.lit(0), *[F.count(c).alias(c) for c in features.numeric]).first()
    features = replace(features, numeric=[c for c in features.numeric if given[c]])
    filled, tested = (_fill_modes(train, d, features.categorical) for d in (train, test))
    share = sizes["train"] / 2.0
    weight = F.when(F.col("moved") == 1, share / sizes["train_moves"]).otherwise(share / (sizes["train"] - sizes["train_moves"]))
    prep = preprocessor(features).fit(filled)
    ready, test_ready = prep.transform(filled).withColumn("weight", weight), prep.transform(tested)
    forest = RandomForestClassifier(labelCol="moved", weightCol="weight", numTrees=params.trees, maxDepth=params.max_depth,
                                    minInstancesPerNode=2, seed=params.seed).fit(ready)
    forest = forest.copy()  # without the summary, see _bare; trees need not be stored for that

    def score(df: DataFrame) -> DataFrame:
        return forest.transform(df).withColumn("p_move", vector_to_array("probability")[1]).drop(
            "rawPrediction", "probability", "prediction")

    scored = score(test_ready)
    if params.calibration == "isotonic":
        fitted = IsotonicRegression(featuresCol="p_move", labelCol="moved").fit(score(ready))
        scored = fitted.transform(scored).drop("p_move").withColumnRenamed("prediction", "p_move")
    elif params.calibration == "sigmoid":
        as_vector = VectorAssembler(inputCols=["p_move"], outputCol="p_vector")
        fitted = _bare(LogisticRegression(featuresCol="p_vector", labelCol="moved").fit(as_vector.transform(score(ready))), states)
        scored = fitted.transform(as_vector.transform(scored)).withColumn("p_move", vector_to_array("probability")[1]).drop(
            "rawPrediction", "probability", "prediction", "p_vector")
    moves = ready.where("moved = 1")
    if params.stage_b == "rf":
        size_model = RandomForestRegressor(labelCol="y", numTrees=params.trees_b, minInstancesPerNode=2, seed=params.seed,
                                           maxDepth=params.max_depth).fit(moves)
    else:
        size_model = _ridge(moves, "y", 1.0)
    path = work_dir(states.sparkSession, "scored")
    size_model.transform(scored).withColumnRenamed("prediction", "pred_delta").select(
        "p_move", "pred_delta", "y", "moved").write.parquet(path)
    scored = states.sparkSession.read.parquet(path)
    medians = {n: split_medians(d, [], {"y": F.col("y")}).select("y").scalar()
               for n, d in (("all", train), ("moved", train.where("moved = 1")))}
    guess = F.when(F.col("p_move") >= 0.5, F.col("pred_delta")).otherwise(0.0)
    variants = {"two_stage": guess, "zero": F.lit(0.0), "median_all": medians["all"],
                "oracle_stage_a": F.when(F.col("moved") == 1, F.col("pred_delta")).otherwise(0.0)}
    combined = scored.select("y", F.inline(F.array(*[
        F.struct(F.lit(n).alias("model"), c.cast("double").alias("predicted")) for n, c in variants.items()])))
    moved_only = scored.where("moved = 1").select("y", F.inline(F.array(
        F.struct(F.lit("stage_b").alias("model"), F.col("pred_delta").alias("predicted")),
        F.struct(F.lit("moved_median").alias("model"), medians["moved"].alias("predicted")))))
    stage_a = scored.select(F.lit("forest").alias("model"), F.col("moved").cast("int").alias("label"),
                            (F.col("p_move") >= 0.5).cast("int").alias("predicted"))
    return {"skipped": False, "sizes": sizes.asDict(), "scored": scored, "stage_a": _confusion(stage_a),
            "stage_b": regression_metrics(moved_only), "combined": regression_metrics(combined)}


def threshold_sweep(scored: DataFrame, low: int = 50, high: int = 99) -> DataFrame:
    """Combined figures for every gate from 0.50 to 0.99.

    Raising the gate by one step moves one slice of rows from predicted to zero, so sums per slice of
    the score are enough for all gates: the rows are read once and not once per gate. Only the median
    needs the errors themselves.
    """
    p, pred, y = F.col("p_move"), F.col("pred_delta"), F.col("y")
    base = F.floor(p * 100)
    slot = F.when(p >= (base + 1) / 100.0, base + 1).otherwise(F.when(p >= base / 100.0, base).otherwise(base - 1))
    rows = scored.withColumn("slot", F.least(F.greatest(slot, F.lit(low - 1)), F.lit(high)).cast("int"))
    hit = F.col("moved") == 1
    sums = rows.groupBy("slot").agg(
        F.count("*").alias("n"), F.count_if(hit).alias("moves"), F.sum(F.abs(y - pred)).alias("a1"), F.sum(F.abs(y)).alias("a0"),
        F.sum((y - pred) * (y - pred)).alias("s1"), F.sum(y * y).alias("s0"))
    total = rows.agg(F.struct(F.count("*").alias("n"), F.count_if(hit).alias("moves"),
                              (F.var_pop("y") * F.count("*")).alias("spread"))).scalar()
    gates = F.sequence(F.lit(low), F.lit(high))
    wide = sums.select("*", F.explode(gates).alias("gate"))
    on = F.col("slot") >= F.col("gate")

    def part(one: str, zero: str) -> Column:
        return F.sum(F.when(on, F.col(one)).otherwise(F.col(zero)))

    agg = wide.groupBy("gate").agg(
        F.sum(F.when(on, F.col("n")).otherwise(0)).alias("predicted_move_count"),
        F.sum(F.when(on, F.col("moves")).otherwise(0)).alias("tp"), part("a1", "a0").alias("abs"), part("s1", "s0").alias("sq"))
    spans = rows.select(F.inline(F.array(
        F.struct(F.lit(low).alias("a"), F.col("slot").alias("b"), F.abs(y - pred).alias("e")),
        F.struct((F.col("slot") + 1).alias("a"), F.lit(high).alias("b"), F.abs(y).alias("e"))))).where("a <= b")
    spans = spans.groupBy("a", "b", "e").agg(F.count("*").alias("n"))
    # A histogram first, one row per gate and cell; then only the errors of the cells that hold the middle ranks.
    spans = spans.withColumn("cell", F.floor(F.log1p("e") * 512))
    opened = spans.groupBy("a", "b", "cell").agg(F.sum("n").alias("n")).select("cell", "n", F.explode(F.sequence("a", "b")).alias("gate"))
    w = Window.partitionBy("gate")
    upto = {"upto": F.sum("n").over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(w)}
    cells = opened.groupBy("gate", "cell").agg(F.sum("n").alias("n")).withColumns(upto).withColumn(
        "rank", F.explode(F.array_distinct(F.array(F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)))))
    wanted = cells.where("upto - n <= rank AND rank < upto").select("gate", "rank", "cell", (F.col("rank") - F.col("upto") + F.col("n")).alias("left"))
    # At most two rows per gate.
    inside = spans.join(F.broadcast(wanted), (spans["cell"] == wanted["cell"]) & wanted["gate"].between(F.col("a"), F.col("b")))
    inside = inside.groupBy("gate", "rank", "left", "e").agg(F.sum("n").alias("n"))
    place = F.sum("n").over(Window.partitionBy("gate", "rank").orderBy("e").rowsBetween(Window.unboundedPreceding, 0))
    hits = inside.withColumn("upto", place).where("upto - n <= left AND left < upto")
    middle = hits.groupBy("gate").agg(F.avg("e").alias("median_ae"))
    n, moves, spread = total["n"], total["moves"], total["spread"]
    fp, fn = F.col("predicted_move_count") - F.col("tp"), moves - F.col("tp")
    tn = n - F.col("tp") - fp - fn
    zero = F.lit(0)
    precision = F.coalesce(ratio(F.col("tp"), F.nullif(F.col("predicted_move_count"), zero)), F.lit(0.0))
    recall = F.coalesce(ratio(F.col("tp"), F.nullif(moves, zero)), F.lit(0.0))
    return agg.join(middle, "gate").select(
        (F.col("gate") / 100.0).alias("threshold"), "predicted_move_count", moves.alias("actual_move_count"),
        (F.col("abs") / n).alias("mae"), F.sqrt(F.col("sq") / n).alias("rmse"), "median_ae",
        (1 - F.try_divide(F.col("sq"), F.nullif(spread, F.lit(0.0)))).alias("r2"), ratio(F.col("tp") + tn, n).alias("accuracy"),
        ((recall + F.coalesce(ratio(tn, F.nullif(tn + fp, zero)), F.lit(0.0))) / 2).alias("balanced_accuracy"),
        precision.alias("precision_move"), recall.alias("recall_move"),
        F.coalesce(F.try_divide(2 * precision * recall, F.nullif(precision + recall, F.lit(0.0))), F.lit(0.0)).alias("f1_move"))


def best_thresholds(sweep: DataFrame, zero: DataFrame) -> DataFrame:
    """Best gate by RMSE and by MAE, and the best one that beats predicting no change. ``zero`` has one row."""
    base = zero.agg(F.max(F.struct("rmse", "mae"))).scalar()
    items = []
    for m in ("rmse", "mae"):
        best = F.min(F.struct(m, "threshold"))
        beats = F.min(F.when(F.col(m) < base[m], F.struct(m, "threshold")))
        items.append(F.struct(F.lit(m).alias("metric"), best["threshold"].alias("best_threshold"), best[m].alias("best_value"),
                              base[m].alias("zero_value"), beats["threshold"].alias("best_threshold_beating_zero"),
                              beats.isNotNull().alias("any_beats_zero")))
    return sweep.agg(F.array(*items).alias("i")).select(F.inline("i"))


def expanding_folds(states: DataFrame, folds: int, time_col: str = "observed_at_utc") -> list[DataFrame]:
    """Expanding time folds: equal test parts at the end, everything before is training.

    The rows up to a fold's end are stored before they are split again.
    """
    out = []
    for k in range(folds):
        upto = states
        if k < folds - 1:
            path = work_dir(states.sparkSession, "fold")
            time_split(states, (folds - 1 - k) / (folds + 1), time_col).where(~F.col("is_test")).drop("is_test").write.parquet(path)
            upto = states.sparkSession.read.schema(states.schema).parquet(path)
        out.append(time_split(upto, 1.0 / (k + 2), time_col))
    return out


def route_reports(states: DataFrame, features: FeatureSet, routes: Sequence[str], folds: int = 0,
                  params: TwoStageParams | None = None, rule: str = "beats_zero_folds", min_beat: int = 2) -> list[dict]:
    """Two-stage figures per route, on one time split and on expanding folds, with what ``route_priority`` needs.

    All routes and folds are fitted together (``route_models``). Fewer than two folds, or fewer than 20 rows for each part of
    a route's folds, give no rolling figures.
    """
    params = params or TwoStageParams()
    sizes = route_models.RouteParams(
        folds=folds if folds >= 2 else 0, test_fraction=params.test_fraction, min_move_delta=params.min_move_delta, min_test_moves=params.min_test_moves,
        min_stage_b_moves=params.min_stage_b_moves, trees=params.trees, trees_b=params.trees_b, max_depth=params.max_depth, stage_b=params.stage_b,
        calibration=params.calibration, seed=params.seed)
    found = route_models.route_reports(states.where(F.col("route_key").isin(list(routes))), features, sizes, rule, min_beat)
    # One row per route.
    by_route = {r["route_key"]: r.asDict() for r in found.collect()}
    return [by_route[r] for r in routes if r in by_route]


_REPORT = """route_key string, two_stage_skipped boolean, reason string, sparse_stage_b boolean, folds_total int,
    best_rmse double, zero_rmse double, beats_zero_rmse boolean, best_mae double, zero_mae double, beats_zero_mae boolean,
    folds_evaluated int, sparse_test_folds int, sparse_stage_b_folds int, viable_rmse boolean, viable_mae boolean,
    any_fold_rmse boolean, any_fold_mae boolean"""


def report_frame(spark: SparkSession, reports: list[dict]) -> DataFrame:
    """Route reports as rows, for ``route_priority``."""
    names = [part.split()[0] for part in _REPORT.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in reports], _REPORT)


def route_priority(reports: DataFrame) -> DataFrame:
    """Readiness label and reason per route from its report columns."""
    def yes(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    rolling = F.col("folds_total").isNotNull()
    none_done = F.coalesce("folds_evaluated", F.lit(0)) == 0
    sparse = (F.coalesce("sparse_test_folds", F.lit(0)) > 0) | (F.coalesce("sparse_stage_b_folds", F.lit(0)) > 0)
    rules = [
        (yes("two_stage_skipped") & yes("sparse_stage_b"), "hold", "sparse_stage_b"),
        (yes("two_stage_skipped"), "hold", "two_stage_skipped"),
        (rolling & none_done, "hold", "no_rolling_eval_folds"),
        (rolling & yes("viable_rmse") & yes("viable_mae"), "high", "rolling_viable_rmse_mae"),
        (rolling & yes("viable_rmse"), "candidate", "rolling_viable_rmse_only"),
        (rolling & (yes("any_fold_rmse") | yes("any_fold_mae")), "watch", "some_rolling_fold_signal_no_viability"),
        (rolling & sparse, "watch", "rolling_sparse_folds"),
        (rolling, "hold", "rolling_no_signal"),
        (yes("beats_zero_rmse") & yes("beats_zero_mae"), "candidate", "single_split_beats_zero_rmse_mae"),
        (yes("beats_zero_rmse"), "candidate", "single_split_beats_zero_rmse"),
        (yes("beats_zero_mae"), "watch", "single_split_beats_zero_mae"),
        (yes("sparse_stage_b"), "watch", "single_split_sparse_stage_b"),
    ]
    label, reason = F.lit("hold"), F.lit("single_split_no_signal")
    for condition, name, why in reversed(rules):
        label, reason = F.when(condition, name).otherwise(label), F.when(condition, why).otherwise(reason)
    return reports.withColumns({"route_model_priority": label, "route_model_priority_reason": reason})
