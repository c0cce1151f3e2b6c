"""Quantile forecasts by boosted trees on pinball loss, refitted at every day.

The models of all cut-off days and quantiles are boosted side by side on ``trees``: a row trains every model whose cut-off
lies after its day. A tree is grown on the gradients of the pinball loss (quantile minus whether the value lies below the
model so far); then each leaf moves by ``rate`` times the quantile of its residuals, read from a sketch: counts over cells
whose width is a fixed share of their size, for both signs, which are added over tasks like the histograms.

What depends on the day alone comes from sums over days: missing features take the median cell of the rows before a
cut-off, a running sum over the days' histograms; recency weights follow from a row's place and the length of its series.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farescope.functions import SERIES_KEY
from farescope.operators.forecast import clip_predictions
from farescope.operators.trees import SPLIT, Forest, Layout, best_split, histogram, summed
from farescope.session import work_dir

CELLS = 32
#: Relative width of a residual's cell, and the smallest residual told from zero, as a share of the largest value.
WIDTH, SMALL = 0.02, 1e-6
#: Bytes of sums that a task holds at most.
SUM_BYTES = 128 << 20
#: Rows of a batch whose gradients are held at once.
CHUNK = 16_384


@dataclass
class Sketch:
    """Cells of residuals: 0 in the middle, on both sides cells that grow by a fixed share."""

    scale: float

    def __post_init__(self) -> None:
        self.step = np.log1p(WIDTH)
        self.side = int(np.ceil(np.log(4 / SMALL) / self.step)) + 1
        self.cells = 2 * self.side + 1

    def cell(self, r: np.ndarray) -> np.ndarray:
        size = np.abs(r) / (self.scale * SMALL)
        at = np.where(size > 1, np.ceil(np.log(np.maximum(size, 1)) / self.step), 0)
        return (np.sign(r) * np.minimum(at, self.side) + self.side).astype(np.int64)

    def values(self) -> np.ndarray:
        """A value for each cell, within half its width of all in it."""
        at = np.arange(1, self.side + 1)
        up = self.scale * SMALL * np.exp((at - 0.5) * self.step)
        return np.concatenate((-up[::-1], [0.0], up))

    def quantile(self, weight: np.ndarray, q: float) -> float:
        """The smallest cell's value that has `q` of the weight at or below it."""
        upto = np.cumsum(weight)
        return float(self.values()[min(int(np.searchsorted(upto, q * upto[-1] * (1 - 1e-12))), self.cells - 1)]) if upto[-1] > 0 else 0.0


@dataclass
class Plan:
    """What all passes share: models are numbered cut-off by cut-off, quantile by quantile."""

    layout: Layout
    edges: list[np.ndarray]
    fills: np.ndarray
    quantiles: list[float]
    cutoffs: list[int]
    sketch: Sketch
    rate: float
    start: dict[int, float]
    trees: dict[int, list]

    def models(self) -> range:
        return range(len(self.cutoffs) * len(self.quantiles))

    def filled(self, cells: np.ndarray, cutoff: int) -> np.ndarray:
        return np.where(cells < 0, self.fills[cutoff], cells)

    def predicted(self, cells: np.ndarray, model: int) -> np.ndarray:
        out = np.full(len(cells), self.start.get(model, 0.0))
        for tree in self.trees[model]:
            out += np.array(tree.value)[tree.walk(cells, self.layout.ordered)]
        return out


def _store(df: DataFrame, name: str) -> DataFrame:
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def instances(frame: DataFrame, target: str, features: Sequence[str], cutoffs: Sequence[date], keys: Sequence[str]) -> DataFrame:
    """Rows with a number: day (number of cut-offs up to it), y, place in the series, rows of the series before each cut-off, x.

    A series has a row a day at most, so its list of days is short.
    """
    rows = frame.withColumn("y", F.col(target).cast("double")).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    known = rows.where("y IS NOT NULL").groupBy(*keys).agg(F.array_sort(F.collect_list("report_day")).alias("__days"))
    days = F.array(*[F.lit(c) for c in cutoffs])
    before = lambda day: F.size(F.filter("__days", lambda d: d < day))
    same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys])
    joined = rows.alias("r").join(known.alias("k"), same, "left").select("r.*", F.coalesce("__days", F.array().cast("array<date>")).alias("__days"))
    return joined.select(
        *frame.columns, "y", F.size(F.filter(days, lambda c: c <= F.col("report_day"))).alias("__day"), before(F.col("report_day")).alias("__place"),
        F.transform(days, before).alias("__before"), F.array(*[F.col(c).cast("double") for c in features]).alias("__x"))


def _arrays(batch: pa.RecordBatch, plan: Plan) -> Iterator[tuple[np.ndarray, ...]]:
    """cells, y, day, place, rows before each cut-off, in chunks of the rows of a batch."""
    for at in range(0, batch.num_rows, CHUNK):
        part = batch.slice(at, CHUNK)
        wide = lambda c, kind: part.column(c).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(part.num_rows, -1)
        yield (wide("__cells", np.int64), part.column("y").to_numpy(zero_copy_only=False).astype(float), part.column("__day").to_numpy(),
               part.column("__place").to_numpy(), wide("__before", np.int64))


def _training(arrays: tuple[np.ndarray, ...], cutoff: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that train the models of a cut-off, and their weights from a half for the oldest of a series to one for the newest."""
    _, y, day, place, before = arrays
    use = np.flatnonzero((day <= cutoff) & ~np.isnan(y))
    long = before[use, cutoff] - 1
    return use, np.where(long > 0, 0.5 + 0.5 * place[use] / np.maximum(long, 1), 1.0)


def encoded(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """Cells of the features of rows, -1 where one is missing."""
    names = ["y", "__day", "__place", "__before"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("__x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            cells = np.stack([np.where(np.isnan(x[:, j]), -1, np.searchsorted(e, x[:, j])) for j, e in enumerate(edges)], axis=1)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(list(cells), pa.list_(pa.int16()))], [*names, "__cells"])

    return rows.select(*names, "__x").mapInArrow(work, "y double, __day int, __place int, __before array<int>, __cells array<short>")


def medians(rows: DataFrame, layout: Layout, cutoffs: int) -> np.ndarray:
    """Median cell of each feature over the rows before each cut-off: running sums over the days' histograms."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        total = np.zeros((cutoffs + 1, layout.total))
        for batch in batches:
            cells = batch.column("__cells").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
            day = batch.column("__day").to_numpy()
            for j, start in enumerate(layout.starts):
                seen = cells[:, j] >= 0
                np.add.at(total, (day[seen], start + cells[seen, j]), 1)
        for d in np.flatnonzero(total.any(axis=1)):
            yield int(d), 0, total[d]

    total = np.zeros((cutoffs + 1, layout.total))
    for r in summed(rows.where("y IS NOT NULL"), work, lambda d, _, flat: [(d, flat.tolist())], "day int, counts array<double>").collect():
        total[r["day"]] = r["counts"]
    upto = np.cumsum(total, axis=0)[:cutoffs]
    out = np.zeros((cutoffs, len(layout.sizes)), np.int64)
    for j, (start, size) in enumerate(zip(layout.starts, layout.sizes)):
        running = np.cumsum(upto[:, start : start + size], axis=1)
        out[:, j] = (running < (running[:, -1:] + 1) // 2).sum(axis=1).clip(0, size - 1)
    return out


def boosted(rows: DataFrame, plan: Plan, trees: int, depth: int, least: float) -> None:
    """Fit all models of a plan, a pass per depth of each tree and one for its leaves."""
    spark, layout, many = rows.sparkSession, plan.layout, len(plan.quantiles)

    def leaves(forest: Forest) -> dict[int, float]:
        shared = spark.sparkContext.broadcast((plan, forest))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
            mine, now = shared.value
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for arrays in _arrays(batch, mine):
                    for c in range(len(mine.cutoffs)):
                        use, weight = _training(arrays, mine.cutoffs[c])
                        cells = mine.filled(arrays[0][use], c)
                        for m in range(c * many, c * many + many):
                            leaf = now.trees[m].walk(cells, mine.layout.ordered)
                            cell = mine.sketch.cell(arrays[1][use] - mine.predicted(cells, m))
                            for node in np.unique(leaf):
                                at = leaf == node
                                part = np.bincount(cell[at], weight[at], mine.sketch.cells)
                                total[m, int(node)] = total.get((m, int(node)), 0) + part
            for (m, node), part in total.items():
                yield m, node, part

        finish = lambda m, node, flat: [(m, node, shared.value[0].sketch.quantile(flat, shared.value[0].quantiles[m % many]))]
        found = {(r["model"], r["node"]): r["value"] for r in summed(rows, work, finish, "model int, node int, value double").collect()}
        shared.destroy()
        return found

    for (m, _), value in leaves(Forest.of(plan.models())).items():
        plan.start[m] = value
    for _ in range(trees):
        forest = Forest.of([m for m in plan.models() if m in plan.start])
        for m in plan.models():
            forest.trees.setdefault(m, Forest.of([m]).trees[m])
        for _ in range(depth):
            shared = spark.sparkContext.broadcast((plan, forest))

            def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
                mine, now = shared.value
                total: dict[int, np.ndarray] = {}
                for batch in batches:
                    for arrays in _arrays(batch, mine):
                        for c in range(len(mine.cutoffs)):
                            use, weight = _training(arrays, mine.cutoffs[c])
                            cells = mine.filled(arrays[0][use], c)
                            for m in range(c * many, c * many + many):
                                frontier = now.frontier.get(m)
                                if frontier and len(use):
                                    below = arrays[1][use] < mine.predicted(cells, m)
                                    slope = mine.quantiles[m % many] - below
                                    node = now.trees[m].walk(cells, mine.layout.ordered)
                                    part = histogram(cells, mine.layout, node, frontier, np.column_stack((np.ones(len(use)), weight, weight * slope)))
                                    total[m] = total.get(m, 0) + part
                for m, parts in total.items():
                    for node, part in zip(now.frontier[m], parts):
                        yield m, node, part

            def finish(m: int, node: int, flat: np.ndarray) -> list[tuple]:
                split = best_split(flat.reshape(-1, 3), layout, least, 0)
                return [(m, node, split[0], split[1], split[2].tolist(), split[3].tolist())] if split else []

            forest.apply(summed(rows, work, finish, SPLIT).collect())
            shared.destroy()
            if not forest.frontier:
                break
        found = leaves(forest)
        for m, tree in forest.trees.items():
            tree.value = [plan.rate * found.get((m, node), 0.0) if tree.column[node] < 0 else 0.0 for node in range(len(tree.value))]
            plan.trees[m].append(tree)


def past_bounds(rows: DataFrame, cutoffs: Sequence[date], keys: Sequence[str]) -> DataFrame:
    """Per series and cut-off the range a prediction may take, from the days before: the 1 and 99 % quantiles widened by two quartile ranges."""
    days = F.array(*[F.lit(c) for c in cutoffs])
    wide = rows.where("y IS NOT NULL").select(*keys, "y", F.explode(F.filter(days, lambda c: c > F.col("report_day"))).alias("trained_before"))
    q = wide.groupBy(*keys, "trained_before").agg(F.percentile("y", [0.01, 0.25, 0.75, 0.99]).alias("q"))
    iqr = F.greatest(F.lit(0.0), F.col("q")[2] - F.col("q")[1])
    return q.select(*keys, "trained_before", (F.col("q")[0] - 2.0 * iqr).alias("__lower"), (F.col("q")[3] + 2.0 * iqr).alias("__upper"))


def quantile_forecast(frame: DataFrame, target: str, features: Sequence[str], cutoffs: Sequence[date] | None = None,
                      quantiles: Sequence[float] = (0.1, 0.5, 0.9), keys: Sequence[str] = SERIES_KEY, trees: int = 12, depth: int = 3, rate: float = 0.3,
                      least: float = 5, min_history: int = 3, prefix: str = "pred_gbt_q") -> DataFrame:
    """All rows with ``trained_before``, the newest cut-off up to their day, and a prediction per quantile by its model.

    Without ``cutoffs`` every day of the table is one, so every row is predicted by a model of all rows of earlier days. A
    row whose series has fewer than ``min_history`` earlier values (three at least) has no prediction. Models pool all series.
    """
    spark, min_history, quantiles = frame.sparkSession, max(min_history, 3), [float(q) for q in quantiles]
    names = [f"{prefix}{round(q * 100)}" for q in quantiles]
    # One row per day of the calendar.
    days = sorted(r[0] for r in frame.where("report_day IS NOT NULL").select("report_day").distinct().collect())
    cutoffs = days[1:] if cutoffs is None else sorted(set(cutoffs))
    nothing = [F.lit(None).cast("double").alias(n) for n in names]
    if not cutoffs:
        return frame.select("*", F.lit(None).cast("date").alias("trained_before"), *nothing)
    rows = _store(instances(frame, target, features, cutoffs, keys), "quantile-rows")
    shares = [i / CELLS for i in range(1, CELLS)]
    melted = rows.where("y IS NOT NULL").select(F.posexplode("__x").alias("j", "v")).where("v IS NOT NULL AND NOT isnan(v)")
    found = {r["j"]: np.unique(r["edges"]) for r in melted.groupBy("j").agg(F.percentile_approx("v", shares, 1000).alias("edges")).collect()}
    edges = [found.get(j, np.zeros(0)) for j in range(len(features))]
    layout = Layout(np.array([len(e) + 1 for e in edges], np.int64), np.ones(len(edges), bool))
    cells = _store(encoded(rows, edges), "quantile-cells")
    largest = cells.agg(F.coalesce(F.max(F.abs("y")), F.lit(0.0))).first()[0] or 1.0
    sketch = Sketch(largest)
    fills = medians(cells, layout, len(cutoffs))
    per_cutoff = len(quantiles) * (1 << depth) * max(sketch.cells, 3 * layout.total) * 8
    at_once = max(1, SUM_BYTES // per_cutoff)
    parts = []
    for begin in range(0, len(cutoffs), at_once):
        chosen = list(range(begin, min(begin + at_once, len(cutoffs))))
        plan = Plan(layout, edges, fills[chosen], quantiles, chosen, sketch, rate, {}, {m: [] for m in range(len(chosen) * len(quantiles))})
        boosted(cells.where(F.col("__day") <= chosen[-1]), plan, trees, depth, least)
        parts.append(predicted(rows.where(F.col("__day").between(chosen[0] + 1, chosen[-1] + 1)), plan, names, list(frame.columns)))
    early = rows.where("__day = 0").select(*frame.columns, "__place", "__day", *nothing)
    out = reduce(DataFrame.unionByName, parts, early).withColumn(
        "trained_before", F.get(F.array(*[F.lit(c) for c in cutoffs]), F.col("__day") - 1))
    bounds = past_bounds(rows, cutoffs, keys)
    same = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "trained_before"]])
    joined = out.alias("o").join(bounds.alias("b"), same, "left").select("o.*", "b.__lower", "b.__upper")
    enough = F.col("__place") >= min_history
    held = {n: F.when(enough, F.least(F.greatest(F.col(n), F.coalesce("__lower", n)), F.coalesce("__upper", n))) for n in names}
    return clip_predictions(joined.withColumns(held).select(*frame.columns, "trained_before", *names), target, names)


def predicted(rows: DataFrame, plan: Plan, names: list[str], columns: list[str]) -> DataFrame:
    """Rows with the predictions of the models of their newest cut-off."""
    shared = rows.sparkSession.sparkContext.broadcast(plan)
    many = len(plan.quantiles)
    kept = rows.select(*columns, "__place", "__day", "__x")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        for batch in batches:
            x = batch.column("__x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            cells = np.stack([np.where(np.isnan(x[:, j]), -1, np.searchsorted(e, x[:, j])) for j, e in enumerate(mine.edges)], axis=1)
            number = {c: i for i, c in enumerate(mine.cutoffs)}
            cutoff = np.array([number[d - 1] for d in batch.column("__day").to_pylist()], np.int64)
            out = np.full((many, batch.num_rows), np.nan)
            for c in np.unique(cutoff):
                at = cutoff == c
                for k in range(many):
                    if c * many + k in mine.start:
                        out[k, at] = mine.predicted(mine.filled(cells[at], c), c * many + k)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(row, pa.float64(), mask=np.isnan(row)) for row in out]],
                                             [*batch.schema.names[:-1], *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(work, schema + "".join(f", `{n}` double" for n in names))
