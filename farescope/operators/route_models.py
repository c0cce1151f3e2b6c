"""Two-stage models of every route, on one time split and on expanding folds, all fitted together.

A route's rows are cut into segments at the borders of its folds, and everything a fit needs is a sum over segments: a
fold trains on the segments before its border.

* Stage A, move or no move, is a forest per (route, fold), grown by ``trees``: class counts per node and cell. Its scores are
  calibrated, if asked, on the rows of a fold by the trees that did not draw them, from counts over a grid of scores.
* Stage B, the size of the move, is a forest over moved rows, or ridge regression per (route, fold). Per segment one Gram matrix is summed over the raw
  numbers (missing ones as zero), their missing flags and the category values. Median fill, modes and scaling of each fold
  are linear maps of these, so its normal equations follow from the sums without another pass over rows.
* Gates are swept for all models in one aggregate.

So rows are read a fixed number of times, whatever the number of routes and folds. Routes go in rounds whose models fit in
``MODEL_BYTES`` on a worker; a round reads only its own range of routes. What a round sends through the driver are
quantiles, splits and coefficients, whose size depends on columns, routes of the round and nodes, not on rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farescope.functions.scan import prefix_sums
from farescope.operators.trees import SPLIT, Forest, Layout, Tree, best_split, bootstrap, histogram, seed_of, summed
from farescope.session import work_dir

TARGET = "y_next_search_lowest_fare_delta"
#: Cells of a number, and bytes of models that a worker holds at once.
CELLS, MODEL_BYTES = 32, 64 << 20
#: Gates of the sweep, in hundredths.
GATES = (50, 99)


@dataclass
class RouteParams:
    """Sizes and guards. ``folds`` below two means the single split alone."""

    folds: int = 0
    test_fraction: float = 0.2
    min_move_delta: float = 0.0
    min_test_moves: int = 1
    min_stage_b_moves: int = 20
    trees: int = 300
    trees_b: int = 400
    max_depth: int = 10
    min_leaf: int = 2
    #: ridge or rf.
    stage_b: str = "ridge"
    #: none, sigmoid or isotonic.
    calibration: str = "none"
    alpha: float = 1.0
    seed: int = 42


def _store(df: DataFrame, name: str) -> DataFrame:
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def segments(states: DataFrame, features, params: RouteParams, key: str = "route_key") -> DataFrame:
    """Labelled rows of each route with their segment, side of the single split, target and features.

    Places are counted over all rows of a route, in time order with rows without a time last; the single split counts the
    labelled rows that have a time. Columns: key, seg, late, y, moved, h, x (numbers), c (categories).
    """
    time, y = F.col("observed_at_utc"), F.col(TARGET).cast("double")
    tie = [c for c in ("flight_key", "probe_join_id", "adt_count") if c in states.columns]
    labelled = y.isNotNull() & ~F.isnan(y)
    rows = states.where(F.col(key).isNotNull()).select(
        key, time.alias("t"), *[F.col(c).alias(f"tie_{c}") for c in tie], y.alias("y"), labelled.alias("labelled"),
        F.xxhash64(*[F.col(c) for c, kind in states.dtypes if not kind.startswith(("map", "variant"))]).alias("h"),
        F.array(*[F.col(c).cast("double") for c in features.numeric]).cast("array<double>").alias("x"),
        F.array(*[F.col(c).cast("string") for c in features.categorical]).cast("array<string>").alias("c"))
    order = [F.col("t").asc_nulls_last(), *[F.col(f"tie_{c}") for c in tie], F.col("h")]
    timed = F.col("labelled") & F.col("t").isNotNull()
    rows = prefix_sums(rows, [key], order, {"upto": F.lit(1).cast("bigint"), "dated": timed.cast("bigint")}, {"upto": "n", "dated": "n_dated"})
    size = F.floor(F.col("n") / (params.folds + 1))
    # Places from 0; fold k tests on the k-th of the equal parts at the end.
    start = F.col("n") - params.folds * size
    seg = F.when(F.col("upto") - 1 < start, F.lit(0)).otherwise(F.floor((F.col("upto") - 1 - start) / F.greatest(size, F.lit(1))) + 1)
    enough = (F.lit(params.folds) >= 2) & (F.col("n") >= (params.folds + 1) * 20)
    train = F.greatest(F.lit(1), F.col("n_dated") - F.greatest(F.lit(1), F.floor(F.col("n_dated") * params.test_fraction)))
    late = F.when(F.col("t").isNotNull(), F.col("dated") > train)
    move = F.abs("y") >= params.min_move_delta if params.min_move_delta > 0 else F.col("y") != 0
    return rows.where("labelled").select(key, F.when(enough, seg).otherwise(F.lit(-1)).cast("int").alias("seg"), late.alias("late"), "y",
                                         move.alias("moved"), "h", "x", "c")


def training(fold: int) -> Column:
    """Whether a row trains the model of a fold; fold 0 is the single split, fold k > 0 the k-th expanding one."""
    return ~F.col("late") if fold == 0 else (F.col("seg") >= 0) & (F.col("seg") < fold)


def testing(fold: int) -> Column:
    return F.col("late") if fold == 0 else F.col("seg") == fold


def _folds(params: RouteParams) -> range:
    return range(params.folds + 1 if params.folds >= 2 else 1)


def gates(rows: DataFrame, params: RouteParams, key: str = "route_key") -> DataFrame:
    """Sizes of the model of each route and fold, and why it is left out. Routes without enough rows have fold 0 only."""
    when = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    items = [F.struct(F.lit(k).alias("fold"), when(training(k)).alias("train"), when(testing(k)).alias("test"),
                      when(training(k) & F.col("moved")).alias("train_moves"), when(testing(k) & F.col("moved")).alias("test_moves"))
             for k in _folds(params)]
    out = rows.groupBy(key).agg(F.count("*").alias("labelled"), (F.max("seg") >= 0).alias("rolling"), F.array(*items).alias("i")).select(
        key, "labelled", "rolling", F.inline("i")).where("fold = 0 OR rolling")
    reason = (F.when(F.col("labelled") < 100, "Insufficient labeled rows for two-stage regression")
              .when((F.col("train") < 50) | (F.col("test") < 20), "Insufficient rows after time split")
              .when(F.col("test_moves") < params.min_test_moves, "Insufficient move rows in Stage A test split")
              .when(F.col("train_moves").isin(0) | (F.col("train_moves") == F.col("train")), "Stage A train split has only one class (move/no-move)")
              .when(F.col("train_moves") < params.min_stage_b_moves, "Insufficient moved rows for Stage B training"))
    return out.withColumn("reason", reason)


# ---------------------------------------------------------------- profiles of routes


@dataclass
class Profile:
    """What a route's rows are encoded by: quantiles, category values, and fills per stage and fold (None: none seen)."""

    edges: list[np.ndarray]
    values: list[dict[str, int]]
    medians: dict[tuple[str, int], list[float | None]]
    modes: dict[tuple[str, int], list[int]]

    def __post_init__(self) -> None:
        self.layout = Layout(np.array([len(e) + 1 for e in self.edges] + [len(v) + 1 for v in self.values], np.int64),
                             np.array([True] * len(self.edges) + [False] * len(self.values), bool))

    def encoded(self, x: np.ndarray, c: list[list[str | None]]) -> np.ndarray:
        """Cells of rows; -1 for a missing number, 0 for a missing category."""
        cells = np.empty((len(x), len(self.edges) + len(self.values)), np.int16)
        for j, edges in enumerate(self.edges):
            cells[:, j] = np.where(np.isnan(x[:, j]), -1, np.searchsorted(edges, x[:, j]))
        for j, known in enumerate(self.values):
            cells[:, len(self.edges) + j] = [known.get(row[j], 0) for row in c]
        return cells

    def filled(self, cells: np.ndarray, fold: int, stage: str) -> np.ndarray:
        """Cells with the medians and modes of a stage of a fold where something is missing."""
        out, n = cells.copy(), len(self.edges)
        for j, m in enumerate(self.medians[stage, fold]):
            out[cells[:, j] < 0, j] = 0 if m is None else np.searchsorted(self.edges[j], m)
        for j, m in enumerate(self.modes[stage, fold]):
            out[cells[:, n + j] == 0, n + j] = m
        return out


def profiles(rows: DataFrame, numbers: int, categories: int, params: RouteParams, key: str = "route_key") -> dict[str, Profile]:
    """Profiles of all routes in a table, from two aggregates over its melted numbers and categories."""
    sides = [(stage, k, F.coalesce(training(k) & (F.col("moved") | F.lit(stage == "a")), F.lit(False))) for stage in "ab" for k in _folds(params)]
    flags = [c.alias(f"{stage}{k}") for stage, k, c in sides]
    names = [f"{stage}{k}" for stage, k, _ in sides]
    shares = [i / CELLS for i in range(1, CELLS)]
    melted = rows.select(key, *flags, F.posexplode("x").alias("j", "v")).where("v IS NOT NULL AND NOT isnan(v)")
    found = melted.groupBy(key, "j").agg(F.percentile_approx("v", shares, 1000).alias("edges"),
                                         *[F.percentile_approx(F.when(F.col(n), F.col("v")), 0.5, 1000).alias(n) for n in names]).collect()
    seen = rows.select(key, *flags, F.posexplode("c").alias("j", "v")).where("v IS NOT NULL").groupBy(key, "j", "v").agg(
        *[F.count_if(F.col(n)).alias(n) for n in names]).collect()
    out = {r[key]: Profile([np.zeros(0)] * numbers, [{} for _ in range(categories)], {(s, k): [None] * numbers for s, k, _ in sides},
                           {(s, k): [0] * categories for s, k, _ in sides}) for r in rows.select(key).distinct().collect()}
    for r in found:
        mine = out[r[key]]
        mine.edges[r["j"]] = np.unique(r["edges"])
        for s, k, _ in sides:
            mine.medians[s, k][r["j"]] = r[f"{s}{k}"]
    best: dict[tuple, int] = {}
    for r in sorted(seen, key=lambda r: (r[key], r["j"], r["v"])):
        mine = out[r[key]]
        code = mine.values[r["j"]].setdefault(r["v"], len(mine.values[r["j"]]) + 1)
        for s, k, _ in sides:
            # The first of the most frequent ones.
            if r[f"{s}{k}"] > best.get((r[key], r["j"], s, k), 0):
                best[r[key], r["j"], s, k] = r[f"{s}{k}"]
                mine.modes[s, k][r["j"]] = code
    for mine in out.values():
        mine.__post_init__()
    return out


# ---------------------------------------------------------------- passes over encoded rows


def _runs(names: Sequence) -> Iterator[tuple[str, slice]]:
    """Stretches of equal names."""
    begin = 0
    for i in range(1, len(names) + 1):
        if i == len(names) or names[i] != names[begin]:
            yield names[begin], slice(begin, i)
            begin = i


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width) if width else np.zeros((len(column), 0), kind)


def encoded(rows: DataFrame, found, numbers: int, key: str = "route_key") -> DataFrame:
    """Rows with cells in place of categories; categories are the last cells of a row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = found.value
        for batch in batches:
            x, c = _matrix(batch.column("x"), numbers, float), batch.column("c").to_pylist()
            cells = [row for name, at in _runs(batch.column(key).to_pylist()) for row in mine[name].encoded(x[at], c[at])]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in (key, "seg", "late", "y", "moved", "h", "x")],
                                              pa.array(cells, pa.list_(pa.int16()))], [key, "seg", "late", "y", "moved", "h", "x", "cells"])

    return rows.mapInArrow(work, f"{key} string, seg int, late boolean, y double, moved boolean, h long, x array<double>, cells array<short>")


@dataclass
class Block:
    """Rows of one route from a batch."""

    route: str
    seg: np.ndarray
    late: np.ndarray
    y: np.ndarray
    moved: np.ndarray
    h: np.ndarray
    x: np.ndarray
    cells: np.ndarray

    def trains(self, fold: int) -> np.ndarray:
        return self.late == 0 if fold == 0 else (self.seg >= 0) & (self.seg < fold)

    def tests(self, fold: int) -> np.ndarray:
        return self.late == 1 if fold == 0 else self.seg == fold


def _blocks(batches: Iterator[pa.RecordBatch], found: dict[str, Profile], numbers: int, key: str) -> Iterator[Block]:
    for batch in batches:
        plain = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("seg", "y", "moved", "h")}
        # 1 late, 0 early, -1 without a time.
        late = batch.column("late").cast(pa.int8()).fill_null(-1).to_numpy()
        x = _matrix(batch.column("x"), numbers, float)
        names = batch.column(key).to_pylist()
        width = len(next(iter(found.values())).layout.sizes) if found else 0
        cells = _matrix(batch.column("cells"), width, np.int16)
        for name, at in _runs(names):
            yield Block(name, plain["seg"][at], late[at], plain["y"][at], plain["moved"][at].astype(bool), plain["h"][at], x[at], cells[at])


def _per_route(blocks: Iterator[Block], add, many: int = 8):
    """Sums keyed by (route, ...) from ``add(block, sums)``, sent on when a few routes are held: rows lie sorted by route."""
    held: dict = {}
    routes: set[str] = set()
    for block in blocks:
        if block.route not in routes and len(routes) >= many:
            yield from held.items()
            held, routes = {}, set()
        routes.add(block.route)
        add(block, held)
    yield from held.items()


class Models:
    """Numbers of the models of a round: (route, fold), and (route, fold, tree) for a forest of a stage."""

    def __init__(self, wanted: Sequence[tuple[str, int]], params: RouteParams, stage: str = "a"):
        self.pairs = sorted(wanted)
        self.params = params
        self.stage = stage
        self.many = params.trees if stage == "a" else params.trees_b
        self.number = {p: i for i, p in enumerate(self.pairs)}
        self.folds: dict[str, list[int]] = {}
        for route, fold in self.pairs:
            self.folds.setdefault(route, []).append(fold)

    def trees(self, route: str, fold: int) -> range:
        first = self.number[route, fold] * self.many
        return range(first, first + self.many)

    def pair(self, tree: int) -> tuple[str, int]:
        return self.pairs[tree // self.many]

    def seed(self, tree: int) -> int:
        return seed_of(self.stage, *self.pair(tree), tree % self.many, self.params.seed)


def grown(rows: DataFrame, found, models: Models, numbers: int, key: str = "route_key") -> Forest:
    """The forests of a stage of all models of a round: one pass per depth.

    Stage A sums drawn rows of both classes, balanced by weights within what a tree drew, and tries the root of the number of
    columns at a node. Stage B sums drawn moved rows and their target, and tries all columns.
    """
    params, spark, classes = models.params, rows.sparkSession, models.stage == "a"
    forest = Forest.of(range(len(models.pairs) * models.many))
    weights: dict[int, tuple[float, float]] = {}
    for _ in range(params.max_depth):
        shared = spark.sparkContext.broadcast((forest, weights, models))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
            now, _, mine_too = shared.value

            def add(block: Block, sums: dict) -> None:
                mine = found.value[block.route]
                for fold in mine_too.folds.get(block.route, ()):
                    train = block.trains(fold) if classes else block.trains(fold) & block.moved
                    if not train.any():
                        continue
                    cells, h, moved, y = mine.filled(block.cells[train], fold, mine_too.stage), block.h[train], block.moved[train], block.y[train]
                    for m in mine_too.trees(block.route, fold):
                        frontier = now.frontier.get(m)
                        if frontier:
                            drawn = bootstrap(h, mine_too.seed(m))
                            part = histogram(cells, mine.layout, now.trees[m].walk(cells, mine.layout.ordered), frontier,
                                             np.column_stack((drawn * ~moved, drawn * moved) if classes else (drawn, drawn * y)))
                            sums[m] = sums.get(m, 0) + part

            for m, part in _per_route(_blocks(batches, found.value, numbers, key), add):
                for node, array in zip(now.frontier[m], part):
                    yield m, node, array

        def finish(m: int, node: int, flat: np.ndarray) -> list[tuple]:
            _, weight, mine_too = shared.value
            layout = found.value[mine_too.pair(m)[0]].layout
            sums = flat.reshape(layout.total, 2)
            total = sums[: layout.sizes[0]].sum(axis=0)
            w0, w1 = weight.get(m) or tuple(total.sum() / (2 * t) if t else 0.0 for t in total)
            if classes:
                three = np.column_stack((sums.sum(axis=1), w0 * sums[:, 0] + w1 * sums[:, 1], w1 * sums[:, 1]))
            else:
                three = sums[:, [0, 0, 1]]
            tried = max(1, int(np.sqrt(layout.units))) if classes else None
            split = best_split(three, layout, params.min_leaf, mine_too.seed(m) ^ (node * 0x9E3779B97F4A7C15 & (1 << 64) - 1), tried)
            out = []
            if node == 0:
                out.append((m, 0, -1, -1, three[: layout.sizes[0]].sum(axis=0).tolist(), [w0, w1]))
            if split:
                out.append((m, node, split[0], split[1], split[2].tolist(), split[3].tolist()))
            return out

        got = summed(rows, work, finish, SPLIT).collect()
        for r in got:
            if r["column"] < 0:
                weights[r["model"]] = tuple(r["right"])
        forest.apply(got)
        shared.destroy()
        if not forest.frontier:
            break
    return forest


def _mean(forest: Forest, trees: Sequence[int], cells: np.ndarray, ordered: np.ndarray, use: np.ndarray | None = None) -> np.ndarray:
    """Mean leaf value of rows over trees, or over those that `use` (tree, row) names; NaN without any."""
    values = np.stack([np.array(forest.trees[m].value)[forest.trees[m].walk(cells, ordered)] for m in trees])
    if use is None:
        return values.mean(axis=0)
    count = use.sum(axis=0)
    return np.where(count > 0, (values * use).sum(axis=0) / np.maximum(count, 1), np.nan)


#: Cells of a score from 0 to 1.
GRID = 1000


def isotonic_steps(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Nondecreasing shares of cells in order, by pooling neighbours that fall."""
    blocks: list[list[float]] = []
    for count, hit in zip(n.tolist(), ones.tolist()):
        blocks.append([count, hit, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.repeat([b[1] / b[0] for b in blocks], [int(b[2]) for b in blocks])


def sigmoid_of(score: np.ndarray, n: np.ndarray, ones: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and constant of a logistic curve through weighted cells, targets drawn in from 0 and 1, by Newton steps."""
    hits, misses = ones.sum(), (n - ones).sum()
    high, low = (hits + 1) / (hits + 2), 1 / (misses + 2)
    target = (ones * high + (n - ones) * low) / n
    w, z = np.zeros(2), np.column_stack((score, np.ones(len(score))))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (n * (p - target))
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + 1e-9 * np.eye(2), grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def curves(rows: DataFrame, found, forest: Forest, models: Models, numbers: int, key: str = "route_key") -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """Calibration of Stage A per model: scores, and the chances there, between which is interpolated. One pass."""
    method = models.params.calibration
    shared = rows.sparkSession.sparkContext.broadcast((forest, models))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        trees, mine_too = shared.value

        def add(block: Block, sums: dict) -> None:
            mine = found.value[block.route]
            for fold in mine_too.folds.get(block.route, ()):
                train = block.trains(fold)
                if train.any():
                    chosen = mine_too.trees(block.route, fold)
                    left_out = np.stack([bootstrap(block.h[train], mine_too.seed(m)) == 0 for m in chosen])
                    score = _mean(trees, chosen, mine.filled(block.cells[train], fold, "a"), mine.layout.ordered, left_out)
                    seen = ~np.isnan(score)
                    cell = np.minimum((score[seen] * GRID).astype(int), GRID)
                    part = np.zeros((GRID + 1, 2))
                    np.add.at(part, (cell, block.moved[train][seen].astype(int)), 1)
                    m = mine_too.number[block.route, fold]
                    sums[m] = sums.get(m, 0) + part

        for m, part in _per_route(_blocks(batches, found.value, numbers, key), add):
            yield m, 0, part

    def finish(m: int, _: int, flat: np.ndarray) -> list[tuple]:
        counts = flat.reshape(-1, 2)
        cells = np.flatnonzero(counts.sum(axis=1))
        n, ones, score = counts[cells].sum(axis=1), counts[cells, 1], (cells + 0.5) / GRID
        if method == "isotonic":
            return [(m, score.tolist(), isotonic_steps(n, ones).tolist())]
        slope, constant = sigmoid_of(score, n, ones)
        grid = np.linspace(0, 1, GRID + 1)
        return [(m, grid.tolist(), (1 / (1 + np.exp(-np.clip(slope * grid + constant, -30, 30)))).tolist())]

    got = summed(rows, work, finish, "model int, at array<double>, chance array<double>").collect()
    shared.destroy()
    return {models.pairs[r["model"]]: (np.array(r["at"]), np.array(r["chance"])) for r in got}


@dataclass
class Linear:
    """Ridge weights for raw rows: per number (0 if left out), per category value, and the constant; and the fills."""

    numbers: np.ndarray
    fills: np.ndarray
    categories: np.ndarray
    constant: float

    def predict(self, x: np.ndarray, codes: np.ndarray, starts: np.ndarray, modes: Sequence[int]) -> np.ndarray:
        out = np.where(np.isnan(x), self.fills, x) @ self.numbers + self.constant
        for j, start in enumerate(starts):
            out = out + self.categories[start + np.where(codes[:, j] == 0, modes[j], codes[:, j])]
        return out


def design(x: np.ndarray, codes: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Raw numbers with 0 for missing ones, missing flags, one column per category value (the first for missing), 1, and y."""
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(int) if len(sizes) else np.zeros(0, int)
    hot = np.zeros((len(x), int(sizes.sum())))
    for j, start in enumerate(starts):
        hot[np.arange(len(x)), start + codes[:, j]] = 1
    gone = np.isnan(x)
    return np.column_stack((np.where(gone, 0.0, x), gone, hot, np.ones(len(x)), y))


def ridge_from_gram(gram: np.ndarray, medians: Sequence[float | None], modes: Sequence[int], sizes: np.ndarray, alpha: float) -> Linear:
    """Ridge with median and mode fill, numbers scaled by their spread, and a free constant, from a Gram matrix of ``design``."""
    k, hot = len(medians), int(sizes.sum())
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(int) if len(sizes) else np.zeros(0, int)
    kept = np.array([m is not None for m in medians], bool)
    fills = np.array([m if m is not None else 0.0 for m in medians], float)
    # Raw columns to filled ones: a number takes its median times its flag, a mode takes the column of the missing.
    change = np.zeros((len(gram), k + hot + 2))
    change[np.arange(k)[kept], np.arange(k)[kept]] = 1
    change[k + np.arange(k)[kept], np.arange(k)[kept]] = fills[kept]
    change[2 * k : 2 * k + hot, k : k + hot] = np.eye(hot)
    for start, mode in zip(starts, modes):
        change[2 * k + start, k + start] = 0
        if mode:
            change[2 * k + start, k + start + mode] = 1
    change[-2, -2] = change[-1, -1] = 1
    full = change.T @ gram @ change
    n = full[-2, -2]
    mean = full[:-2, -2] / n
    spread = np.ones(k + hot)
    variance = np.diag(full)[:k] / n - mean[:k] ** 2
    spread[:k] = np.where(variance > 1e-12 * np.maximum(mean[:k] ** 2, 1e-12), np.sqrt(np.maximum(variance, 0)), 1.0)
    inner = (full[:-2, :-2] - n * np.outer(mean, mean)) / np.outer(spread, spread) + alpha * np.eye(k + hot)
    goal = full[-1, -2] / n
    weight = np.linalg.solve(inner, (full[:-2, -1] - n * mean * goal) / spread) / spread
    return Linear(np.where(kept, weight[:k], 0.0), fills, weight[k:], float(goal - mean @ weight))


_LINEAR = "route int, fold int, numbers array<double>, fills array<double>, categories array<double>, constant double"


def ridges(rows: DataFrame, found, models: Models, numbers: int, key: str = "route_key") -> dict[tuple[str, int], Linear]:
    """Stage B of all models of a round: one pass. Segments are summed, folds are sums of segments."""
    params = models.params
    routes = sorted(models.folds)
    number = {r: i for i, r in enumerate(routes)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        def add(block: Block, sums: dict) -> None:
            if block.route not in number:
                return
            sizes = found.value[block.route].layout.sizes[numbers:]
            # Segments from -1, and within each the rows without a time, early ones, late ones.
            combo = 3 * (block.seg + 1) + block.late + 1
            for k in np.unique(combo[block.moved]):
                mask = block.moved & (combo == k)
                z = design(block.x[mask], block.cells[mask, numbers:], sizes, block.y[mask])
                if number[block.route] not in sums:
                    sums[number[block.route]] = np.zeros((3 * (params.folds + 2), z.shape[1], z.shape[1]))
                sums[number[block.route]][k] += z.T @ z

        for route, grams in _per_route(_blocks(batches, found.value, numbers, key), add):
            yield route, 0, grams

    def finish(route: int, _: int, flat: np.ndarray) -> list[tuple]:
        name = routes[route]
        mine = found.value[name]
        sums = flat.reshape(params.folds + 2, 3, -1)
        p = int(np.sqrt(sums.shape[2]))
        out = []
        for fold in models.folds[name]:
            gram = (sums[:, 1].sum(axis=0) if fold == 0 else sums[1 : fold + 1].sum(axis=(0, 1))).reshape(p, p)
            if gram[-2, -2] > 0:
                fit = ridge_from_gram(gram, mine.medians["b", fold], mine.modes["b", fold], mine.layout.sizes[numbers:], params.alpha)
                out.append((route, fold, fit.numbers.tolist(), fit.fills.tolist(), fit.categories.tolist(), fit.constant))
        return out

    got = summed(rows, work, finish, _LINEAR).collect()
    return {(routes[r["route"]], r["fold"]): Linear(*[np.array(r[n]) for n in ("numbers", "fills", "categories")], r["constant"]) for r in got}


@dataclass
class Fits:
    """The models of a round; Stage B is in `linear` or in `sizes`."""

    models: Models
    forest: Forest
    curves: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]
    linear: dict[tuple[str, int], Linear]
    models_b: Models | None = None
    sizes: Forest | None = None


def fitted(cells: DataFrame, found, wanted: Sequence[tuple[str, int]], params: RouteParams, numbers: int, key: str = "route_key") -> Fits:
    models = Models(wanted, params)
    forest = grown(cells, found, models, numbers, key)
    maps = curves(cells, found, forest, models, numbers, key) if params.calibration != "none" else {}
    if params.stage_b == "rf":
        second = Models(wanted, params, "b")
        return Fits(models, forest, maps, {}, second, grown(cells, found, second, numbers, key))
    return Fits(models, forest, maps, ridges(cells, found, models, numbers, key))


def scored(rows: DataFrame, found, fits: Fits, numbers: int, key: str = "route_key") -> DataFrame:
    """Test rows of all models: key, fold, y, moved, p_move, pred_delta."""
    shared = rows.sparkSession.sparkContext.broadcast(fits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_fits = shared.value
        for block in _blocks(batches, found.value, numbers, key):
            mine = found.value[block.route]
            sizes = mine.layout.sizes[numbers:]
            starts = mine.layout.starts[numbers:] - (mine.layout.starts[numbers] if len(sizes) else 0)
            for fold in all_fits.models.folds.get(block.route, ()):
                test, pair = block.tests(fold), (block.route, fold)
                if not test.any():
                    continue
                chance = _mean(all_fits.forest, all_fits.models.trees(*pair), mine.filled(block.cells[test], fold, "a"), mine.layout.ordered)
                if pair in all_fits.curves:
                    chance = np.interp(chance, *all_fits.curves[pair])
                if all_fits.sizes:
                    size = _mean(all_fits.sizes, all_fits.models_b.trees(*pair), mine.filled(block.cells[test], fold, "b"), mine.layout.ordered)
                else:
                    size = all_fits.linear[pair].predict(block.x[test], block.cells[test, numbers:], starts, mine.modes["b", fold])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.route] * int(test.sum()), pa.string()), pa.array([fold] * int(test.sum()), pa.int32()), pa.array(block.y[test]),
                     pa.array(block.moved[test]), pa.array(chance), pa.array(size)], [key, "fold", "y", "moved", "p_move", "pred_delta"])

    return rows.mapInArrow(work, f"{key} string, fold int, y double, moved boolean, p_move double, pred_delta double")


def route_scores(states: DataFrame, features, params: RouteParams, key: str = "route_key") -> tuple[DataFrame, DataFrame]:
    """Gates of all (route, fold) models, and the scored test rows of those that were fitted."""
    spark = states.sparkSession
    rows = _store(segments(states, features, params, key), "segments")
    gate = _store(gates(rows, params, key), "gates")
    # One narrow row per route and fold; routes are dealt out to rounds by name.
    wanted = [(r[key], r["fold"]) for r in gate.where("reason IS NULL").select(key, "fold").collect()]
    routes = sorted({r for r, _ in wanted})
    largest = params.trees + (params.trees_b if params.stage_b == "rf" else 0)
    per_route = len(_folds(params)) * largest * min(2 << params.max_depth, 4096) * 64
    at_once = max(1, MODEL_BYTES // per_route)
    numbers, categories, parts = len(features.numeric), len(features.categorical), []
    for begin in range(0, len(routes), at_once):
        chosen = routes[begin : begin + at_once]
        mine = rows.where(F.col(key).between(chosen[0], chosen[-1]))
        profile = profiles(mine, numbers, categories, params, key)
        found = spark.sparkContext.broadcast(profile)
        cells = _store(encoded(mine, found, numbers, key), "cells")
        fits = fitted(cells, found, [w for w in wanted if w[0] in set(chosen)], params, numbers, key)
        parts.append(_store(scored(cells, found, fits, numbers, key), "route-scores"))
    empty = spark.createDataFrame([], f"{key} string, fold int, y double, moved boolean, p_move double, pred_delta double")
    return gate, reduce(DataFrame.unionByName, parts, empty)


# ---------------------------------------------------------------- figures


def swept(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combined figures of every gate for each model: rows are sums per slice of the score, gates are running sums over slices.

    Columns: keys, threshold, predicted_move_count, actual_move_count, rmse, mae, zero_rmse, zero_mae.
    """
    low, high = GATES
    p, gap = F.col("p_move"), F.col("y") - F.col("pred_delta")
    base = F.floor(p * 100)
    slot = F.when(p >= (base + 1) / 100.0, base + 1).otherwise(F.when(p >= base / 100.0, base).otherwise(base - 1))
    slices = scores.withColumn("slot", F.least(F.greatest(slot, F.lit(low - 1)), F.lit(high)).cast("int")).groupBy(*keys, "slot").agg(
        F.count("*").alias("n"), F.count_if("moved").alias("moves"), F.sum(F.abs(gap)).alias("a1"), F.sum(F.abs("y")).alias("a0"),
        F.sum(gap * gap).alias("s1"), F.sum(F.col("y") * F.col("y")).alias("s0"))
    # At most one row per slice for a model.
    spread = slices.groupBy(*keys).agg(F.collect_list(F.struct("slot", "n", "moves", "a1", "a0", "s1", "s0")).alias("s")).withColumn(
        "gate", F.explode(F.sequence(F.lit(low), F.lit(high))))

    def total(name: str, off: str | None = None) -> Column:
        def one(acc: Column, s: Column) -> Column:
            return acc + F.when(s["slot"] >= F.col("gate"), s[name].cast("double")).otherwise(s[off].cast("double") if off else F.lit(0.0))

        return F.aggregate("s", F.lit(0.0), one)

    every = lambda name: F.aggregate("s", F.lit(0.0), lambda acc, s: acc + s[name].cast("double"))
    return spread.select(*keys, (F.col("gate") / 100.0).alias("threshold"), total("n").cast("bigint").alias("predicted_move_count"),
                         every("moves").cast("bigint").alias("actual_move_count"), F.sqrt(total("s1", "s0") / every("n")).alias("rmse"),
                         (total("a1", "a0") / every("n")).alias("mae"), F.sqrt(every("s0") / every("n")).alias("zero_rmse"),
                         (every("a0") / every("n")).alias("zero_mae"))


def beaten(sweep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best figures of each model over all gates, and whether any gate beats predicting no change."""
    items = []
    for m in ("rmse", "mae"):
        best = F.min(F.struct(m, "threshold"))
        items += [best["threshold"].alias(f"best_threshold_{m}"), best[m].alias(f"best_{m}"), F.max(f"zero_{m}").alias(f"zero_{m}"),
                  (F.min(m) < F.max(f"zero_{m}")).alias(f"beats_zero_{m}")]
    return sweep.groupBy(*keys).agg(*items)


def route_reports(states: DataFrame, features, params: RouteParams, rule: str = "beats_zero_folds", min_beat: int = 2,
                  key: str = "route_key") -> DataFrame:
    """One row per route: the single split's figures, and those of the rolling folds where there are any; ready for ``route_priority``."""
    gate, scores = route_scores(states, features, params, key)
    models = gate.join(beaten(swept(scores, [key, "fold"]), [key, "fold"]), [key, "fold"], "left")
    single, rolled = F.col("fold") == 0, F.col("fold") > 0
    done = rolled & F.col("reason").isNull()
    sparse_b = F.coalesce(F.col("reason").startswith("Insufficient moved rows"), F.lit(False))
    sparse_test = F.coalesce(F.col("reason").startswith("Insufficient move rows"), F.lit(False))
    one = lambda c: F.max(F.when(single, F.col(c)))
    items = [one("reason").alias("reason"), (F.max(F.when(single & F.col("reason").isNull(), 1)).isNull()).alias("two_stage_skipped"),
             F.coalesce(F.max(F.when(single, sparse_b)), F.lit(False)).alias("sparse_stage_b"),
             F.nullif(F.count_if(rolled), F.lit(0)).alias("folds_total"), F.count_if(done).alias("folds_evaluated"),
             F.count_if(rolled & sparse_b).alias("sparse_stage_b_folds"), F.count_if(rolled & sparse_test).alias("sparse_test_folds")]
    for m in ("rmse", "mae"):
        wins = F.count_if(done & F.col(f"beats_zero_{m}"))
        viable = F.avg(F.when(done, F.col(f"best_{m}"))) < F.avg(F.when(done, F.col(f"zero_{m}"))) if rule == "mean_rmse" else wins >= min_beat
        items += [one(f"best_{m}").alias(f"best_{m}"), one(f"zero_{m}").alias(f"zero_{m}"), one(f"best_threshold_{m}").alias(f"best_threshold_{m}"),
                  one(f"beats_zero_{m}").alias(f"beats_zero_{m}"), (wins > 0).alias(f"any_fold_{m}"), viable.alias(f"viable_{m}"),
                  F.avg(F.when(done, F.col(f"best_{m}"))).alias(f"rolling_{m}_mean"), F.avg(F.when(done, F.col(f"zero_{m}"))).alias(f"rolling_zero_{m}_mean")]
    return models.groupBy(key).agg(*items)
