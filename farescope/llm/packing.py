"""Best-two-fit packing of token sequences.

A bin is filled greedily, always with the longest piece that fits. Then its smallest piece is replaced by two unpacked
pieces if they fit the expanded gap more tightly. Which pieces meet depends on their lengths alone, so the plan is made
from the counts by length (at most as many as a sequence has tokens): a pattern of lengths is used for as many bins as
the counts allow, which gives the same bins as one at a time. Pieces are numbered within their length on Spark, in
salted chunks, and look up their bin and place in the plan.

Rules for odd input: a null text is empty and has only its end id. Rows that repeat are packed each on their own. A null
doc_id is an id like others. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farescope.llm.common import saved, text_bytes
from farescope.llm.tokens import encoder, vocabulary

CAPACITY = 1024
END_ID = 2
#: Rows of one length that one window task numbers.
CHUNK_ROWS = 20_000
#: Bytes of text that are encoded at once.
SLICE_BYTES = 1_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(doc_id, ids: np.ndarray, capacity: int) -> Iterator[tuple]:
    """Pieces of a document: all of it, or parts of `capacity` ids after a first part with what is over."""
    first = len(ids) % capacity or capacity
    begin = 0
    for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
        yield doc_id, piece, begin, end - begin, zlib.crc32(ids[begin:end].tobytes())
        begin = end


def _pieces(path: str, end_id: int, capacity: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, spaced=True).encode
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, texts in sliced(text_bytes(batch.column("text"))):
                flat, counts = encode(texts)
                rows, at = [], 0
                for k, n in enumerate(counts):
                    whole = np.append(flat[at : at + n], end_id).astype("<u4")
                    rows.extend(cut(ids[first + k], whole, capacity))
                    at += n
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (
                    pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return work


def sliced(texts: Iterator[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about SLICE_BYTES, with the position of the first."""
    waiting: list[bytes] = []
    first = size = 0
    for k, text in enumerate(texts):
        waiting.append(text)
        size += len(text)
        if size >= SLICE_BYTES:
            yield first, waiting
            waiting, first, size = [], k + 1, 0
    if waiting:
        yield first, waiting


def pieces(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_pieces(path, end_id, capacity), PIECES)


def best_pair(lengths: list[int], count: dict[int, int], most: int) -> tuple[int, int]:
    """The two unpacked lengths with the largest sum up to `most`; (0, 0) if there are none."""
    best, low = (0, 0), 0
    high = len(lengths) - 1
    while low <= high:
        total = lengths[low] + lengths[high]
        if total > most or (low == high and count[lengths[low]] < 2):
            high -= 1
            if total <= most:
                break
            continue
        if total > sum(best):
            best = (lengths[high], lengths[low])
        low += 1
    return best


def next_pattern(count: dict[int, int], lengths: list[int], capacity: int) -> list[int]:
    """Lengths of the next bin; `lengths` holds those with a count, ascending."""
    left: dict[int, int] = {}
    have = lambda n: left.get(n, count[n])
    pattern: list[int] = []
    gap = capacity
    while gap:
        k = bisect_right(lengths, gap) - 1
        while k >= 0 and not have(lengths[k]):
            k -= 1
        if k < 0:
            break
        pattern.append(lengths[k])
        left[lengths[k]] = have(lengths[k]) - 1
        gap -= lengths[k]
    if gap and pattern:
        small = pattern[-1]
        rest = [n for n in lengths[: bisect_right(lengths, gap + small)] if have(n)]
        pair = best_pair(rest, {n: have(n) for n in rest}, gap + small)
        if sum(pair) > small:
            pattern[-1:] = pair
    return pattern


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Segments (length, first rank, first bin, offset): pieces of a length, by rank, go to consecutive bins at an offset."""
    count = {n: c for n, c in counts.items() if c}
    lengths = sorted(count)
    used = Counter()
    out = []
    bins = 0
    while lengths:
        pattern = next_pattern(count, lengths, capacity)
        times = min(count[n] // k for n, k in Counter(pattern).items())
        offset = 0
        for n in pattern:
            out.append((n, used[n], bins, offset))
            used[n] += times
            count[n] -= times
            offset += n
        bins += times
        lengths = [n for n in lengths if count[n]]
    return out


def _placed(segments: list[tuple[int, int, int, int]]):
    table = np.array(sorted(segments), np.int64).reshape(-1, 4)
    keys = table[:, 0] << 44 | table[:, 1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, names), pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])],
                [*names, "sequence_id", "offset"])

    return work


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place for each row of a stored table of pieces: sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    segments = plan(counts, capacity)
    chunks = max(1, -(-sum(counts.values()) // CHUNK_ROWS))
    rows = found.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    firsts = rows.groupBy("length", "chunk").agg(F.count("*").alias("n")).select("length", "chunk", F.coalesce(before, F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc_id", "piece"))
    ranked = rows.withColumn("place", place).join(firsts, ["length", "chunk"]).withColumn("rank", F.col("first") + F.col("place") - 1)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _placed(segments), PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packed(saved(pieces(docs, path or vocabulary("byte_bpe_50k.json"), end_id, capacity), "pieces"), capacity)
