"""Quality classifier: random Fourier features over document statistics, ridge by normal equations, isotonic calibration.

1. One pass over whole texts gives every document a few statistics: shares of kinds of characters, lengths of words and
   lines, repeated words, runs and lines, words with signs at their ends. They are stored, and texts are not read again.
2. Statistics are scaled by mean and spread of the training rows and mapped by cos(W x + b), W drawn from a normal
   distribution with a fixed seed: inner products of these features approximate a Gaussian kernel.
3. Every task sums the normal equations (Z'Z, Z'y) of its training rows, per fold; the sums over tasks are added row by row
   of the matrix on the executors. The driver solves one ridge system, and one per fold with that fold's sums taken off.
4. Scores of training rows by the system without their own fold are counted on a fixed grid, and isotonic regression
   (pool adjacent violators) over the grid maps ridge scores to chances of label 1.

All labelled rows outside the held-out part train; nothing is sampled. What reaches the driver has fixed size: the sums
for FEATURES features and FOLDS folds, and the grid.

Rules for odd input: a null text is the empty text, all statistics of which are zero, and is scored like any other.
Label rows with a null id or label are ignored; of repeated labels the larger counts. Rows that repeat are scored each on
their own, and train each on its own. Without both labels among the training rows the score is their smoothed share everywhere.
Only `doc_id` and `text` are read, other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farescope.llm.common import by_key, id_crc, saved, text_bytes

THRESHOLD = 0.3
HELD_OUT = (5, 0)
#: Random features, folds for calibration, ridge penalty per training row, width of the kernel in standard
#: deviations times the root of the number of statistics.
FEATURES, FOLDS, RIDGE, WIDTH = 256, 5, 1e-4, 2.0
SEED = 12
#: Cells of the grid of ridge scores between -0.5 and 1.5.
CELLS = 2000
#: Training rows whose features are held at once.
CHUNK = 2048

_KINDS = ("lower", "upper", "digit", "space", "line", "stop", "comma", "mark", "bar", "sign", "quote", "bracket", "slash", "high", "other")
STATISTICS = (*_KINDS, "bytes", "words", "word_length", "word_spread", "distinct", "most", "again", "pairs", "capital", "loud", "bare", "ends_sign",
              "ends_mark", "lines", "line_length", "same_lines", "short_lines")


def _classes() -> np.ndarray:
    """Kind of each byte."""
    out = np.full(256, _KINDS.index("other"))
    for kind, chars in (("lower", bytes(range(97, 123))), ("upper", bytes(range(65, 91))), ("digit", b"0123456789"), ("space", b" \t\x0b\x0c"),
                        ("line", b"\r\n"), ("stop", b"."), ("comma", b",;:"), ("mark", b"!?"), ("bar", b"|"), ("sign", b"#$%&*+=@^_~<>"),
                        ("quote", b"\"'`"), ("bracket", b"()[]{}"), ("slash", b"/\\-"), ("high", bytes(range(128, 256)))):
        out[list(chars)] = _KINDS.index(kind)
    return out


_CLASS = _classes()
_SIGNS, _MARKS = tuple(bytes([c]) for c in b"#$%&*+=@^_~<>|"), (b"!", b"?")


def statistics(text: bytes) -> np.ndarray:
    """The statistics of a text. Shares are per byte, word or line; counts and lengths are logarithms."""
    out = np.zeros(len(STATISTICS))
    if not text:
        return out
    raw = np.frombuffer(text, np.uint8)
    by_byte = np.bincount(raw, minlength=256)
    n = len(_KINDS)
    out[:n] = np.sqrt(np.bincount(_CLASS, by_byte, n) / len(raw))
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    out[n] = np.log1p(len(raw))
    if words:
        k = len(words)
        lengths = np.fromiter(map(len, words), np.int64, k)
        counts = Counter(words)
        initial = np.fromiter((w[0] for w in words), np.uint8, k)
        out[n + 1 : n + 13] = (
            np.log1p(k), np.log(lengths.mean()), np.log1p(lengths.std()), len(counts) / k ** 0.9, max(counts.values()) / k,
            sum(a == b for a, b in zip(words, words[1:])) / k, 1 - len(set(zip(words, words[1:]))) / max(k - 1, 1) if k > 1 else 0,
            ((initial >= 65) & (initial <= 90)).mean(), sum(map(bytes.isupper, words)) / k, sum(not w.isalpha() and len(w) == 1 for w in words) / k,
            sum(w.endswith(_SIGNS) for w in words) / k, sum(w.endswith(_MARKS) for w in words) / k)
    if lines:
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        out[n + 13 :] = np.log1p(len(lines)), np.log1p(sizes.mean()), 1 - len(set(lines)) / len(lines), (sizes < 20).mean()
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t) for t in text_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float32()))], ["doc_id", "x"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics x of each document."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_measured, "doc_id long, x array<float>")


def held_out():
    return id_crc("doc_id") % HELD_OUT[0] == HELD_OUT[1]


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    turn: np.ndarray
    ridge: np.ndarray
    #: Ridge scores and chances between which is interpolated.
    knots: np.ndarray
    chances: np.ndarray

    @classmethod
    def empty(cls, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, seed: int = SEED) -> Model:
        r = np.random.default_rng(seed)
        d = len(mean)
        return cls(mean, spread, r.standard_normal((d, features)) / (WIDTH * np.sqrt(d)), r.uniform(0, 2 * np.pi, features),
                   np.zeros(features + 1), np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, and a constant."""
        z = np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights + self.turn
        return np.column_stack((np.cos(z) * np.sqrt(2 / z.shape[1]), np.ones(len(x))))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.ridge, self.knots, self.chances)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def _normal(shared, folds: int):
    """Sums of a task: a row of Z'Z, Z'y and the row count for each fold and row of the matrix."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = shared.value, {}
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                z, y, fold = model.features(_rows(part)), part.column("y").to_numpy().astype(float), part.column("fold").to_numpy()
                for f in np.unique(fold):
                    mine = z[fold == f]
                    total[f] = total.get(f, 0) + mine.T @ np.column_stack((mine, y[fold == f]))
        for f, sums in total.items():
            yield pa.RecordBatch.from_pydict({"fold": pa.array([f] * len(sums), pa.int32()), "row": pa.array(range(len(sums)), pa.int32()),
                                              "sums": pa.array(list(sums), pa.list_(pa.float64()))})

    return work


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (fold, row) of a sorted stream, sums added."""
    key, total = None, None
    for batch in batches:
        for fold, row, sums in zip(batch.column("fold").to_pylist(), batch.column("row").to_pylist(), batch.column("sums")):
            values = sums.values.to_numpy()
            if (fold, row) == key:
                total = total + values
                continue
            if key:
                yield _line(key, total)
            key, total = (fold, row), values
    if key:
        yield _line(key, total)


def _line(key: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"fold": pa.array([key[0]], pa.int32()), "row": pa.array([key[1]], pa.int32()),
                                       "sums": pa.array([total], pa.list_(pa.float64()))})


def solved(sums: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Ridge weights of summed normal equations; the constant, last, has no penalty and counts the rows."""
    gram, right = sums[:, :-1], sums[:, -1]
    penalty = np.full(len(gram), max(ridge * gram[-1, -1], 1e-9))
    penalty[-1] = 1e-9
    return np.linalg.solve(gram + np.diag(penalty), right)


def isotonic(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Nondecreasing chances of cells in order, least squares with the counts as weights (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for count, hit in zip(n.tolist(), ones.tolist()):
        blocks.append([count, hit, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.repeat([b[1] / b[0] for b in blocks], [int(b[2]) for b in blocks])


def _cells(shared, leave: np.ndarray):
    """Counts of (cell of the grid, label) by the scores of the system without a row's own fold."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = shared.value, np.zeros((CELLS, 2), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                raw = np.einsum("nf,nf->n", model.features(_rows(part)), leave[part.column("fold").to_numpy()])
                cell = np.clip((raw + 0.5) * (CELLS / 2), 0, CELLS - 1).astype(int)
                np.add.at(total, (cell, part.column("y").to_numpy().astype(int)), 1)
        cell, y = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int32()), "y": pa.array(y, pa.int32()), "n": pa.array(total[cell, y], pa.int64())})

    return work


def training_rows(stored: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, label y and fold of all labelled rows that are not held out."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") > 0).cast("int")).alias("y")).where(~held_out())
    return stored.join(marks, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(FOLDS)).cast("int").alias("fold"))


def train(stored: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE) -> Model:
    """A model from the stored statistics of documents and the table of labels."""
    rows = saved(training_rows(stored, labels), "quality-training")
    d = range(len(STATISTICS))
    item = [F.get("x", F.lit(i)).cast("double") for i in d]
    seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("ones"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(item)],
                    *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(item)]).first()
    n, ones = seen["n"], seen["ones"]
    base = Model.empty(np.array([seen[f"m{i}"] or 0.0 for i in d]), np.array([max(seen[f"s{i}"] or 0.0, 1e-3) for i in d]), features)
    if not ones or ones == n:
        base.chances = np.array([(ones + 0.5) / (n + 1)])
        return base
    context = stored.sparkSession.sparkContext
    shared = context.broadcast(base)
    part = rows.mapInArrow(_normal(shared, FOLDS), "fold int, row int, sums array<double>")
    sums = np.zeros((FOLDS, features + 1, features + 2))
    for r in by_key(part, ["fold", "row"]).mapInArrow(_added, "fold int, row int, sums array<double>").toArrow().to_batches():
        for fold, row, values in zip(r.column("fold").to_pylist(), r.column("row").to_pylist(), r.column("sums")):
            sums[fold, row] = values.values.to_numpy()
    total = sums.sum(axis=0)
    base.ridge = solved(total, ridge)
    # With too few rows a fold may hold them all; then its rows are scored by the whole system.
    leave = np.stack([solved(total - s, ridge) if (total - s)[-1, -2] > 1 else base.ridge for s in sums])
    counts = np.zeros((CELLS, 2))
    for r in rows.mapInArrow(_cells(shared, leave), "cell int, y int, n long").groupBy("cell", "y").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"], r["y"]] = r["n"]
    cells = np.flatnonzero(counts.sum(axis=1))
    found = isotonic(counts[cells].sum(axis=1), counts[cells, 1])
    # A chance of its own for every step, in the middle of its cells; never quite 0 or 1.
    steps = [np.flatnonzero(found == v) for v in np.unique(found)]
    size = np.array([counts[cells[s]].sum() for s in steps])
    base.knots = np.array([np.average(cells[s] + 0.5, weights=counts[cells[s]].sum(axis=1)) for s in steps]) * (2 / CELLS) - 0.5
    base.chances = (np.unique(found) * size + 0.5) / (size + 1)
    base.chances = np.maximum.accumulate(base.chances)
    return base


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    stored = saved(measured(docs), "statistics")
    shared = docs.sparkSession.sparkContext.broadcast(train(stored, labels))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.score(_rows(batch.slice(at, CHUNK))) for at in range(0, batch.num_rows, CHUNK)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(found) if found else [], pa.float64())], ["doc_id", "score"])

    return stored.mapInArrow(work, "doc_id long, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
