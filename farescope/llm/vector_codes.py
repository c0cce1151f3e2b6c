"""Product codes of vectors: Lloyd rounds over cover trees that lie in the partitions.

A component x becomes the integer floor(256 * x). A vector is cut into equal parts, and each part position has a codebook
that starts as that part of the vectors with the smallest ids.

1. Each block of BLOCK vectors gets, for every part position, a cover tree over its distinct parts: the children of a node
   lie within its radius of it, further than half of it from each other, and the first child is the node itself. Points
   are stored in the order of the leaves, so a subtree is one stretch, and cumulative sums of points and counts give the
   sum of any subtree as a difference. Trees are built once and stored in the shared folder.
2. A round sends all nodes of a level against the codebook. With d1, d2 the distances of a node's point to the nearest and
   second entry and r the largest distance of its subtree, d1 + r < d2 - r gives the whole subtree to the first entry.
   Only nodes where this fails go down to their children, and points of such leaves are compared exactly.
3. Tasks yield one sum and count per part and entry. Codebooks, `parts` times `entries` rows, are the only thing that goes
   through the driver.

Sums, distances and floors are those of integers, so the result does not depend on how rows are dealt out.

Rules for odd input: vectors that are null or hold a null, a NaN or an infinity are dropped. Integers are held within
plus and minus 2^24, so that no sum of squares over 4096 components leaves a long. Vectors shorter than the longest, and all vectors if that is
no multiple of the parts, count as filled up with zeros. Of equal ids the smaller vector comes first in the codebook, a
missing id comes last. Fewer rows than `entries` give shorter codebooks. Rows that repeat are coded each on their own.
Only `vec_id`, `embedding` and `label` are read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farescope.llm.common import join_groups, saved

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors of one block, and distinct points of a node that is not split further.
BLOCK, LEAF = 16_384, 12
BOUND = 1 << 24
#: Integers in a chunk of exact comparisons.
CHUNK = 1 << 22


def whole(embedding: str = "embedding") -> Column:
    """Components as integers, null where the vector is not whole."""
    x = F.col(embedding).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    held = F.transform(x, lambda v: F.least(F.greatest(F.floor(F.least(F.greatest(v, F.lit(-1e9)), F.lit(1e9)) * 256), F.lit(-BOUND)), F.lit(BOUND)).cast("int"))
    return F.when(~bad, held)


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lower one of equals), its squared distance and that of the next, for integer points."""
    n, k = len(points), len(book)
    best, first, second = np.empty(n, np.int32), np.empty(n, np.int64), np.empty(n, np.int64)
    step = max(1, CHUNK // (k * max(1, points.shape[1])))
    for at in range(0, n, step):
        gap = points[at : at + step, None, :].astype(np.int64) - book[None]
        far = np.einsum("nkd,nkd->nk", gap, gap)
        won = far.argmin(axis=1)
        rows = np.arange(len(won))
        best[at : at + step], first[at : at + step] = won, far[rows, won]
        far[rows, won] = np.iinfo(np.int64).max
        second[at : at + step] = far.min(axis=1)
    return best, first, second


class CoverTree:
    """Cover tree over the distinct rows of an integer matrix.

    `order` lists the distinct points by leaf, `place` has the place of each row's point in that list. A node is a row of
    `center` (place of its point), `radius2` (largest squared distance of its points), `low`, `high` (its stretch of the list)
    and `child` (first child and the end of the children, equal for leaves). Levels follow each other.
    """

    FIELDS = ("points", "counts", "place", "center", "radius2", "low", "high", "child", "child_end")

    def __init__(self, **fields: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, fields[name])
        self.sums = np.concatenate((np.zeros((1, self.points.shape[1]), np.int64), np.cumsum(self.points.astype(np.int64) * self.counts[:, None], axis=0)))
        self.upto = np.concatenate(([0], np.cumsum(self.counts, dtype=np.int64)))

    @classmethod
    def build(cls, rows: np.ndarray, leaf: int = LEAF) -> CoverTree:
        points, back, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        wide = points.astype(np.int64)
        order = np.arange(len(points))
        nodes: list[tuple[int, int, int, int]] = []
        children: list[tuple[int, int]] = []
        # A level: nodes as (point, low, high), and squared distances of the points of each stretch to the node's point.
        level = [(0, 0, len(points), _far(wide, order, 0, 0, len(points)))] if len(points) else []
        while level:
            below, begin = [], len(nodes) + len(level)
            for point, low, high, far in level:
                radius2 = int(far.max())
                nodes.append((point, radius2, low, high))
                first = begin + len(below)
                if high - low > leaf and radius2 > 0:
                    below += _split(wide, order, point, low, high, far, radius2)
                children.append((first, begin + len(below)))
            level = below
        rank = np.empty(len(points), np.int64)
        rank[order] = np.arange(len(points))
        table = np.array(nodes, np.int64).reshape(-1, 4)
        spans = np.array(children, np.int64).reshape(-1, 2)
        return cls(points=points[order], counts=counts[order], place=rank[back.reshape(-1)].astype(np.int32), center=rank[table[:, 0]], radius2=table[:, 1],
                   low=table[:, 2], high=table[:, 3], child=spans[:, 0], child_end=spans[:, 1])

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Entry of each distinct point, squared distance to it is left to the caller; sums per entry, and exact comparisons made.

        The sums have a column more than the points: the count.
        """
        chosen = np.zeros(len(self.points), np.int32)
        sums = np.zeros((len(book), self.points.shape[1] + 1), np.int64)
        now, compared = (np.zeros(1, np.int64) if len(self.points) else np.zeros(0, np.int64)), 0
        while len(now):
            best, first, second = nearest(self.points[self.center[now]], book)
            compared += len(now)
            # Roots are rounded; the margin is far above their error, so a subtree is taken only where all its points agree.
            gap = np.sqrt(second.astype(np.float64)) - np.sqrt(first.astype(np.float64))
            sure = (gap > 2 * np.sqrt(self.radius2[now].astype(np.float64)) * (1 + 1e-9) + 1e-3) | (self.radius2[now] == 0)
            low, high = self.low[now], self.high[now]
            np.add.at(sums, best[sure], np.column_stack((self.sums[high[sure]] - self.sums[low[sure]], self.upto[high[sure]] - self.upto[low[sure]])))
            places = _stretches(low[sure], high[sure])
            chosen[places] = np.repeat(best[sure], (high - low)[sure])
            end = ~sure & (self.child[now] == self.child_end[now])
            open_ = _stretches(low[end], high[end])
            if len(open_):
                found, _, _ = nearest(self.points[open_], book)
                compared += len(open_)
                chosen[open_] = found
                weight = self.counts[open_, None]
                np.add.at(sums, found, np.column_stack((self.points[open_].astype(np.int64) * weight, weight)))
            down = ~sure & ~end
            now = _stretches(self.child[now[down]], self.child_end[now[down]])
        return chosen, sums, compared

    def packed(self) -> dict[str, np.ndarray]:
        return {name: getattr(self, name) for name in self.FIELDS}


def _far(points: np.ndarray, order: np.ndarray, point: int, low: int, high: int) -> np.ndarray:
    gap = points[order[low:high]] - points[point]
    return np.einsum("nd,nd->n", gap, gap)


def _split(points: np.ndarray, order: np.ndarray, point: int, low: int, high: int, far: np.ndarray, radius2: int) -> list[tuple]:
    """Children of a node: centers more than half its radius apart, each with the points near it that no earlier one has.

    The stretch of `order` is put in the order of the children.
    """
    left, out, at = order[low:high].copy(), [], low
    center = point
    while len(left):
        near = far * 4 <= radius2
        mine = left[near]
        order[at : at + len(mine)] = mine
        out.append((center, at, at + len(mine), far[near]))
        at += len(mine)
        left = left[~near]
        if len(left):
            center = left[0]
            gap = points[left] - points[center]
            far = np.einsum("nd,nd->n", gap, gap)
    return out


def _stretches(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the stretches from low to high, one after the other."""
    size = high - low
    return np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors of a batch, shorter ones filled up with zeros."""
    out = np.zeros((len(column), width), np.int32)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy()
    return out


def _blocks(width: int, count: int):
    """Blocks of rows with the trees of all their parts."""
    def block(table: pa.Table) -> pa.RecordBatch:
        rows = _matrix(table.column("v").combine_chunks(), width).reshape(len(table), count, -1)
        bag = io.BytesIO()
        trees = [CoverTree.build(np.ascontiguousarray(rows[:, p])) for p in range(count)]
        np.savez_compressed(bag, **{f"{p}_{name}": v for p, tree in enumerate(trees) for name, v in tree.packed().items()})
        lists = [pa.array([table.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("vec_id", "label")]
        return pa.RecordBatch.from_arrays([*lists, pa.array([bag.getvalue()], pa.binary())], ["vec_ids", "labels", "trees"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK - size)
                batch = batch.slice(part.num_rows)
                held.append(part)
                size += part.num_rows
                if size == BLOCK:
                    yield block(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield block(pa.Table.from_batches(held))

    return work


def _trees(blob: bytes, count: int) -> list[CoverTree]:
    found = np.load(io.BytesIO(blob))
    return [CoverTree(**{name: found[f"{p}_{name}"] for name in CoverTree.FIELDS}) for p in range(count)]


def _summed(books, count: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = books.value
        total = np.zeros((count, mine.shape[1], mine.shape[2] + 1), np.int64)
        for batch in batches:
            for blob in batch.column("trees"):
                for p, tree in enumerate(_trees(blob.as_py(), count)):
                    total[p] += tree.assign(mine[p])[1]
        part, entry = np.nonzero(total[:, :, -1])
        yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()),
                                          "sums": pa.array(list(total[part, entry]), pa.list_(pa.int64()))})

    return work


def _coded(books, count: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = books.value
        for batch in batches:
            for ids, labels, blob in zip(batch.column("vec_ids"), batch.column("labels"), batch.column("trees")):
                codes = np.empty((len(ids), count), np.uint8 if mine.shape[1] <= 256 else np.uint16)
                error = np.zeros(len(ids), np.int64)
                for p, tree in enumerate(_trees(blob.as_py(), count)):
                    chosen, _, _ = tree.assign(mine[p])
                    gap = tree.points.astype(np.int64) - mine[p][chosen]
                    codes[:, p] = chosen[tree.place]
                    error += np.einsum("nd,nd->n", gap, gap)[tree.place]
                text = codes.astype(codes.dtype.newbyteorder(">")).tobytes().hex()
                step = 2 * count * codes.itemsize
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), pa.array(error, pa.int64()), labels.values],
                    ["vec_id", "code", "error", "label"])

    return work


def trained(vectors: DataFrame, count: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """A stored table of blocks with their trees, and the codebooks as an array (part, entry, position)."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), whole().alias("v")).where("v IS NOT NULL")
    longest = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    width = count * max(1, -(-longest // count))
    # As many rows as a codebook has entries.
    first = [r["v"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    books = np.zeros((count, len(first), width // count), np.int64)
    for k, v in enumerate(first):
        books[:, k] = np.array([*v, *[0] * (width - len(v))], np.int64).reshape(count, -1)
    blocks = saved(rows.mapInArrow(_blocks(width, count), "vec_ids array<long>, labels array<long>, trees binary"), "cover-trees")
    context = vectors.sparkSession.sparkContext
    for _ in range(rounds if first else 0):
        shared = context.broadcast(books)
        sums = blocks.mapInArrow(_summed(shared, count), "part int, entry int, sums array<long>")
        # Exact sums of any size.
        total = sums.groupBy("part", "entry").agg(*[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width // count + 1)]).collect()
        shared.destroy()
        books = books.copy()
        for r in total:
            *parts, n = (int(v) for v in r[2:])
            books[r["part"], r["entry"]] = [x // n for x in parts]
    return blocks, books


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def codes(vectors: DataFrame, count: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per whole vector: vec_id, code, error, label_error, codebooks_sha256.

    A code has two hex digits a part, four if there are more than 256 entries.
    """
    blocks, books = trained(vectors, count, entries, rounds)
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    rows = saved(blocks.mapInArrow(_coded(shared, count), "vec_id long, code string, error long, label long"), "codes")
    keyed = rows.withColumns({"none": F.col("label").isNull(), "label": F.coalesce("label", F.lit(0))})
    groups = keyed.groupBy("none", "label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint").alias("label_error"), F.count("*").alias("n"))
    groups = saved(groups, "label-errors")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_groups(keyed, groups, ["none", "label"], "n", total).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _oracle(count: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in SQL, every part against every entry."""
    text = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT vec_id, label, p, list_slice(v, p * len(v) // {count} + 1, (p + 1) * len(v) // {count}) AS x FROM kept, range({count}) r(p)),
b0 AS (
  SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1) AS e, x FROM cut
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))"""
    best = """
SELECT vec_id, label, p, x, d[1] AS d, d[2] AS e FROM (
  SELECT c.vec_id, c.label, c.p, c.x, min([list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, b.e]) AS d
  FROM cut c JOIN {book} b USING (p) GROUP BY c.vec_id, c.label, c.p, c.x)"""
    for k in range(rounds):
        text += f""",
a{k} AS ({best.format(book=f'b{k}')}),
m{k} AS (
  SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS x FROM (
    SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM a{k}, range(1, (SELECT max(len(x)) FROM cut) + 1) r(i) GROUP BY p, e, i) GROUP BY p, e),
b{k + 1} AS (SELECT p, e, coalesce(m{k}.x, b{k}.x) AS x FROM b{k} LEFT JOIN m{k} USING (p, e))"""
    return text + f""",
last AS ({best.format(book=f'b{rounds}')}),
coded AS (SELECT vec_id, label, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM last GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, books
"""


ORACLE = _oracle()
