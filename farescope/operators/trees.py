"""Trees of many models grown at once on histograms.

A row is a list of cells, one per column: numbers fall into ordered cells between quantiles, a category has one cell per
value. All models go down a level together: one pass over the rows sums, per model, node, column and cell, a few numbers
(``channels``); the sums of all tasks are added per node on the executors, which also pick the split there. The driver sees
one narrow row per new node. Numbers of rows and models do not change the number of passes, only depths do.

Random choices come from hashes of names, so a model is the same whatever other models are grown with it and however rows
are dealt out.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Chance that a Poisson draw with mean 1 is at most 0, 1, 2, ...
_POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


def scrambled(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit values of 64-bit values."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seed_of(*names: object) -> int:
    """A seed from the names of a model."""
    text = "|".join(map(str, names)).encode()
    return zlib.crc32(text) << 32 | zlib.crc32(text[::-1])


def bootstrap(rows: np.ndarray, seed: int) -> np.ndarray:
    """How often each row, given by a hash of its content, is drawn with replacement for a tree."""
    u = scrambled(rows.astype(np.uint64) ^ np.uint64(seed)) >> np.uint64(11)
    return np.searchsorted(_POISSON, u.astype(float) / float(1 << 53)).astype(np.int64)


@dataclass
class Layout:
    """Columns of cells: how many cells each has, and whether they are ordered."""

    sizes: np.ndarray
    ordered: np.ndarray

    def __post_init__(self) -> None:
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.int64) if len(self.sizes) else np.zeros(0, np.int64)
        self.total = int(self.sizes.sum())
        self.column = np.repeat(np.arange(len(self.sizes)), self.sizes)
        #: What random choice takes or leaves: a column of numbers, or one value of a category.
        cells_ordered = self.ordered[self.column]
        first = np.zeros(self.total, bool)
        first[self.starts[self.sizes > 0]] = True
        self.unit = np.cumsum(~cells_ordered | first) - 1
        self.units = int(self.unit[-1]) + 1 if self.total else 0


@dataclass
class Tree:
    """Nodes in the order they came up; a leaf has column -1. Rows with `cell` or below, or with `cell` of a category, go left."""

    column: list[int] = field(default_factory=lambda: [-1])
    cell: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def walk(self, cells: np.ndarray, ordered: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        column, cell, left, right = (np.array(v) for v in (self.column, self.cell, self.left, self.right))
        node, rows = np.zeros(len(cells), np.int64), np.arange(len(cells))
        while len(rows):
            at = node[rows]
            rows = rows[column[at] >= 0]
            at = node[rows]
            seen, wanted = cells[rows, column[at]], cell[at]
            node[rows] = np.where(np.where(ordered[column[at]], seen <= wanted, seen == wanted), left[at], right[at])
        return node

    def grow(self, node: int, column: int, cell: int, left: float, right: float) -> tuple[int, int]:
        """Split a leaf; returns its new leaves."""
        a = len(self.column)
        self.column[node], self.cell[node], self.left[node], self.right[node] = column, cell, a, a + 1
        for name, new in (("column", -1), ("cell", 0), ("left", 0), ("right", 0)):
            getattr(self, name).extend([new, new])
        self.value.extend([left, right])
        return a, a + 1


def histogram(cells: np.ndarray, layout: Layout, node: np.ndarray, frontier: Sequence[int], channels: np.ndarray) -> np.ndarray:
    """Sums of the channels per frontier node and cell: an array (node, cell, channel)."""
    out = np.zeros((len(frontier), layout.total, channels.shape[1]))
    number = np.full(max(int(node.max(initial=0)), *frontier) + 1, -1)
    number[list(frontier)] = np.arange(len(frontier))
    at = number[node]
    rows = np.flatnonzero((at >= 0) & channels.any(axis=1))
    if len(rows):
        index = (at[rows, None] * layout.total + layout.starts + cells[rows]).ravel()
        for k in range(channels.shape[1]):
            out[:, :, k] = np.bincount(index, np.repeat(channels[rows, k], cells.shape[1]), out.shape[0] * out.shape[1]).reshape(out.shape[:2])
    return out


def best_split(sums: np.ndarray, layout: Layout, least: float, seed: int, tried: int | None = None) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """Column, cell and the two sides' sums of the best split of a node, from sums (cell, (rows, weight, weighted target)).

    The gain is the drop of the weighted squared error. Each side keeps `least` rows. Of the units that can be split, the
    `tried` ones that come first in a random order are compared; of equal gains the first column and cell wins.
    """
    if not layout.total:
        return None
    whole = sums[layout.starts[0] : layout.starts[0] + layout.sizes[0]].sum(axis=0)
    upto = np.cumsum(sums, axis=0)
    base = np.concatenate((np.zeros((1, 3)), upto))[layout.starts][layout.column]
    left = np.where(layout.ordered[layout.column][:, None], upto - base, sums)
    right = whole - left
    fits = (left[:, 0] >= least) & (right[:, 0] >= least) & (left[:, 1] > 0) & (right[:, 1] > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[:, 2] ** 2 / left[:, 1] + right[:, 2] ** 2 / right[:, 1] - whole[2] ** 2 / whole[1]
    gain = np.where(fits, gain, -np.inf)
    good = gain > 1e-9 * max(abs(whole[2]), 1e-12)
    if tried is not None and good.any():
        units = np.unique(layout.unit[good])
        order = units[np.argsort(scrambled(units.astype(np.uint64) + np.uint64(1) ^ scrambled(np.array([seed], np.uint64))), kind="stable")]
        good &= np.isin(layout.unit, order[:tried])
    if not good.any():
        return None
    at = int(np.where(good, gain, -np.inf).argmax())
    return int(layout.column[at]), int(at - layout.starts[layout.column[at]]), left[at], right[at]


def summed(rows: DataFrame, work: Callable, finish: Callable, result: str) -> DataFrame:
    """Sums of all tasks per key, handed to ``finish``.

    ``work`` turns record batches into triples (model, node, array). Arrays of equal keys have equal shapes; they travel as
    bytes and are added as they come in sorted order. ``finish(model, node, flat array)`` lists the result rows of a key.
    """
    schema = to_arrow_schema(StructType.fromDDL(result))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for model, node, array in work(batches):
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), pa.array([node], pa.int32()),
                                              pa.array([array.astype(np.float64).tobytes()], pa.binary())], ["model", "node", "sums"])

    def done(key: tuple[int, int], total: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = finish(*key, total)
        if found:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in found], schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for model, node, blob in zip(batch.column("model").to_pylist(), batch.column("node").to_pylist(), batch.column("sums")):
                values = np.frombuffer(blob.as_buffer(), np.float64)
                if (model, node) == key:
                    total = total + values
                    continue
                if key:
                    yield from done(key, total)
                key, total = (model, node), values
        if key:
            yield from done(key, total)

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = rows.mapInArrow(send, "model int, node int, sums binary")
    return sent.repartition(parts, "model", "node").sortWithinPartitions("model", "node").mapInArrow(add, result)


SPLIT = "model int, node int, column int, cell int, left array<double>, right array<double>"


@dataclass
class Forest:
    """Trees by model number, with the leaves that may still be split."""

    trees: dict[int, Tree]
    frontier: dict[int, list[int]]

    @classmethod
    def of(cls, models: Sequence[int]) -> Forest:
        return cls({m: Tree() for m in models}, {m: [0] for m in models})

    def apply(self, splits: Sequence) -> None:
        """Split leaves by rows of SPLIT, whose sums are (rows, weight, weighted target); a row without a column gives a root its value."""
        after: dict[int, list[int]] = {}
        for s in sorted(splits, key=lambda s: (s["model"], s["node"])):
            tree = self.trees[s["model"]]
            if s["column"] < 0:
                tree.value[s["node"]] = s["left"][2] / s["left"][1] if s["left"][1] else 0.0
                continue
            sides = [x[2] / x[1] for x in (s["left"], s["right"])]
            after.setdefault(s["model"], []).extend(tree.grow(s["node"], s["column"], s["cell"], *sides))
        self.frontier = after
