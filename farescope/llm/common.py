"""Helpers shared by the operators of this package: shared tables, words, grouped streams, joins with hot keys."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from farescope.session import work_dir

#: ASCII white space, as `bytes.split` and `bytes.isspace` see it: 0x20 and 0x09 to 0x0D.
SPACES = r"[\x20\x09-\x0D]+"
#: Distinct words a task remembers before it starts anew.
CACHE_WORDS = 200_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = work_dir(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_crc(doc_id: str | Column) -> Column:
    """crc32 of the decimal text of an id; a missing id counts as the empty text."""
    value = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))


class WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def text_bytes(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of a text column; a null is the empty text."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def word_hashes(text: bytes, cache: WordHashes) -> np.ndarray:
    """Hashes of the lower-cased words of a text, in order."""
    words = text.lower().split()
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of `width` words; a shorter text is one run, no words give none."""
    n = len(hashes)
    if n == 0:
        return hashes
    step = np.uint64(0xA24BAED4963EE407)
    size = min(n, width)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = out * step + hashes[k : n - size + 1 + k]
    return np.unique(mixed(out))


def grouped(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of rows with equal keys, from batches that are sorted by them. A group must fit in memory."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        change = np.zeros(batch.num_rows, bool)
        for key in keys:
            column = batch.column(key)
            if batch.num_rows > 1:
                change[1:] |= ~np.asarray(pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False), bool)
        starts = [0, *np.flatnonzero(change), batch.num_rows]
        for begin, end in zip(starts, starts[1:]):
            now = tuple(batch.column(key)[int(begin)].as_py() for key in keys)
            if held and now != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(begin, end - begin))
            last = now
    if held:
        yield pa.concat_tables(held)


def by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows with equal keys in one partition and next to each other."""
    return df.repartition(parts(df.sparkSession), *keys).sortWithinPartitions(*keys, *order)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that a table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, total: int) -> DataFrame:
    """Left join of rows with one row per group, where a few groups may hold most rows.

    Groups with more than a thousandth of all rows, of which there are fewer than a thousand, are broadcast, so their
    rows stay where they are; only the rest is shuffled. Rows with a missing key belong to no group and are not moved either.
    """
    hot = F.broadcast(groups.where(F.col(size) * 1000 > total).withColumn("__hot", F.lit(True)))
    keyed = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    marked = rows.where(keyed).join(hot.select(*keys, "__hot"), list(keys), "left")
    near = marked.where(F.col("__hot").isNotNull()).drop("__hot").join(hot.drop("__hot"), list(keys), "inner")
    far = marked.where(F.col("__hot").isNull()).drop("__hot").join(groups.where(F.col(size) * 1000 <= total), list(keys), "left")
    bare = rows.where(~keyed).withColumns({f.name: F.lit(None).cast(f.dataType) for f in groups.schema.fields if f.name not in keys})
    return near.unionByName(far).unionByName(bare)


def maybe_in(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], bits: int = 1 << 26) -> DataFrame:
    """Rows whose keys are among those of `wanted`, and a few others: an exact join has to follow, and moves little then.

    The hashes of the wanted keys are marked in a map of `bits` bits, broadcast in pieces of 32,768 bits. Rows are not shuffled.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    marks = wanted.select(F.bitmap_bucket_number(place).alias("__piece"), F.bitmap_bit_position(place).alias("__bit"))
    marks = marks.groupBy("__piece").agg(F.bitmap_construct_agg("__bit").alias("__marks"))
    placed = rows.withColumns({"__piece": F.bitmap_bucket_number(place), "__bit": F.bitmap_bit_position(place)})
    byte = F.conv(F.hex(F.substring("__marks", (F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.getbit(byte, (F.col("__bit") % 8).cast("int")) == 1
    return placed.join(F.broadcast(marks), "__piece").where(set_).drop("__piece", "__bit", "__marks")


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition as stars: every id with the smallest one that the partition's links connect it with."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.get(top, top) != top:
            top = root[top]
        while root.get(x, x) != x:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = find(a), find(b)
            root.setdefault(a, a)
            root.setdefault(b, b)
            if x != y:
                root[max(x, y)] = min(x, y)
    pairs = [(x, find(x)) for x in root]
    pairs = [p for p in pairs if p[0] != p[1]]
    for at in range(0, len(pairs), 50_000):
        a, b = zip(*pairs[at : at + 50_000])
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components by alternating large and small star steps: (id, root), root the smallest id reachable.

    `edges` has long columns a and b. Only ids that occur in an edge with another id are returned. The links of a partition are
    first contracted to stars where they lie. Each round is written to the shared folder, and tells by figures of what it
    writes whether it changed anything; the number of rounds grows with the logarithm of the longest chain.
    """
    def low(pairs: DataFrame, total: int) -> DataFrame:
        # Centers with more than a thousandth of all rows, fewer than a thousand, are broadcast; rows of those go by their other end.
        least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hot = F.broadcast(least.where(F.col("n") * 1000 > total).select(F.col("u").alias("hu"), F.col("m").alias("hm")))
        far = least.where(F.col("n") * 1000 <= total).select(F.col("u").alias("k"), "m", F.lit(0).cast("bigint").alias("s"))
        keyed = pairs.join(hot, F.col("u") == F.col("hu"), "left").withColumns(
            {"k": F.col("u"), "s": F.when(F.col("hm").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("v"), F.lit(4096)))})
        return keyed.join(far, ["k", "s"], "left").select("u", F.least("u", F.coalesce("hm", "m")).alias("m"), "v")

    def store(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        told = df.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a") % 1_000_003).alias("y"))
        kept = saved(told, name)
        return kept, tuple(seen.get[c] for c in ("n", "x", "y"))

    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    now, state = store(edges.where("a <> b").mapInArrow(_contracted, "a long, b long").distinct())
    while state[0]:
        large = low(both(now), 2 * state[0]).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = low(large.select(F.col("a").alias("u"), F.col("b").alias("v")), state[0])
        step = small.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            small.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        now, after = store(step)
        if after == state:
            break
        state = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()


def id_ranges(docs: DataFrame, n: int) -> list[int]:
    """About n - 1 ids that cut a table into ranges of even row counts; n numbers at most reach the driver."""
    shares = [k / n for k in range(1, n)]
    if not shares:
        return []
    cuts = docs.where("doc_id IS NOT NULL").agg(F.percentile_approx(F.col("doc_id").cast("bigint"), shares, 100 * n).alias("cuts")).first()["cuts"]
    return sorted(set(cuts or []))


def bucket_of(doc_id: str, cuts: list[int]) -> Column:
    """Number of the range of an id: how many cuts it reaches. A missing id belongs to the last range."""
    if not cuts:
        return F.lit(0).cast("long")
    step = math.isqrt(len(cuts)) + 1
    reached = lambda found: F.size(F.filter(found, lambda c: c <= F.col(doc_id)))
    far = reached(F.array(*map(F.lit, cuts[step - 1 :: step]))) * step
    near = reached(F.slice(F.array(*map(F.lit, cuts)), far + 1, F.lit(step)))
    return F.when(F.col(doc_id).isNull(), F.lit(len(cuts))).otherwise(far + near).cast("long")
