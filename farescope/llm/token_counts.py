"""Token counts by scanning flat token files for separators.

Texts are encoded and written as flat files of 16 or 32-bit ids, a separator after each document, with no index. The
files are cut into blocks without regard to documents. Every block finds its separators in one vectorised search and
reports their positions and what lies after the last one. A prefix scan over the few numbers of all blocks of a file
(separators before a block, ids since the last separator) stitches documents that cross blocks, however many they cross.
The place of a document in its file is known to whoever wrote it, as in a list of names; its length is not.

Rules for odd input: a null text is empty and has only its separator. Rows that repeat count each. A missing id comes
back as missing. Strings of special tokens in a text are ordinary text, so no text holds a separator. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farescope.llm.common import saved, text_bytes
from farescope.llm.packing import sliced
from farescope.llm.token_frames import place, publish
from farescope.llm.tokens import encoder, vocabulary
from farescope.session import work_dir

#: <|endoftext|> of word_bpe_49k.json.
SEPARATOR = 49_407
#: Ids in a block.
BLOCK = 1 << 20


def _write(folder: str, path: str, separator: int, kind: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, spaced=False, plain=True).encode
        part = TaskContext.get().partitionId()
        system, at = place(folder)
        system.create_dir(at, recursive=True)
        draft, name = f"{at}/draft-{part:06d}-{uuid.uuid4().hex}", f"tokens-{part:06d}.bin"
        ids = size = 0
        with system.open_output_stream(draft) as out:
            for batch in batches:
                if not batch.num_rows:
                    continue
                for _, texts in sliced(text_bytes(batch.column("text"))):
                    flat, counts = encode(texts)
                    # A separator goes in after each document.
                    size += out.write(np.insert(flat, np.cumsum(counts), separator).astype(kind).tobytes())
                yield pa.RecordBatch.from_pydict({"file": pa.array([name] * batch.num_rows), "ordinal": np.arange(ids, ids + batch.num_rows), "doc_id": batch.column("doc_id"),
                                                  "bytes": pa.nulls(batch.num_rows, pa.int64())})
                ids += batch.num_rows
        if size:
            publish(system, draft, f"{at}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "ordinal": pa.nulls(1, pa.int64()), "doc_id": pa.nulls(1, pa.int64()), "bytes": [size]})
        else:
            system.delete_file(draft)

    return work


def write_flat(docs: DataFrame, folder: str, path: str, separator: int = SEPARATOR, kind: str = "<u2") -> DataFrame:
    """Write flat token files. One row per document with its file and ordinal, and one per file with its size in bytes.

    Must be stored before use: each run of it writes the files.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _write(folder, path, separator, kind), "file string, ordinal long, doc_id long, bytes long")


def _scan(folder: str, separator: int, kind: str):
    """Documents that end in a block, with the part of their length inside it, and a last row for what stays open."""
    width = np.dtype(kind).itemsize

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block, first, count in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "first", "count"))):
                system, at = place(f"{folder}/{name}")
                with system.open_input_file(at) as source:
                    source.seek(first * width)
                    ids = np.frombuffer(source.read(count * width), kind)
                ends = np.flatnonzero(ids == separator)
                lengths = np.diff(ends, prepend=-1)
                rest = count - 1 - (int(ends[-1]) if len(ends) else -1)
                n = len(ends) + 1
                yield pa.RecordBatch.from_pydict({
                    "file": pa.array([name] * n), "block": np.full(n, block), "nth": np.append(np.arange(n - 1), -1),
                    "inside": np.append(lengths, rest), "stop": np.append(first + ends + 1, first + count), "seps": np.full(n, n - 1)})

    return work


def scan_flat(files: DataFrame, folder: str, separator: int = SEPARATOR, kind: str = "<u2", block: int = BLOCK) -> DataFrame:
    """Count the tokens of all documents of flat files: file, ordinal, start, n_tokens (with the separator).

    `files` has columns file and bytes. Ids after the last separator of a file are a document that never ended, and are
    left out.
    """
    total = F.expr(f"bytes div {np.dtype(kind).itemsize}")
    blocks = files.select("file", total.alias("total")).select("file", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(total - 1) div {block}"))).alias("block"))
    blocks = blocks.select("file", "block", (F.col("block") * block).alias("first"), F.least(F.lit(block).cast("bigint"), F.col("total") - F.col("block") * block).alias("count"))
    found = saved(blocks.repartition("file", "block").mapInArrow(
        _scan(folder, separator, kind), "file string, block long, nth long, inside long, stop long, seps long"), "separators")
    # The prefix scan: one row per block.
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    edges = found.where("nth = -1").select("file", "block", "seps", F.col("inside").alias("open"))
    edges = edges.withColumn("before", F.coalesce(F.sum("seps").over(order), F.lit(0))).withColumn(
        "since", F.coalesce(F.max(F.when(F.col("seps") > 0, F.col("block"))).over(order), F.lit(-1)))
    runs = edges.withColumn("so_far", F.sum("open").over(Window.partitionBy("file").orderBy("block")))
    # Ids left open by the block of the last separator and all blocks after it.
    base = runs.select("file", F.col("block").alias("since"), (F.col("so_far") - F.col("open")).alias("less"))
    carry = runs.join(base, ["file", "since"], "left").select(
        "file", "block", "before", (F.col("so_far") - F.col("open") - F.coalesce("less", F.lit(0))).alias("carry"))
    placed = found.where("nth >= 0").join(carry, ["file", "block"])
    n = F.col("inside") + F.when(F.col("nth") == 0, F.col("carry")).otherwise(0)
    return placed.select("file", (F.col("before") + F.col("nth")).alias("ordinal"), (F.col("stop") - n).alias("start"), n.alias("n_tokens"))


def token_counts(docs: DataFrame, path: str | None = None, separator: int = SEPARATOR, kind: str = "<u2", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, file, ordinal, start, n_tokens (with the separator)."""
    folder = work_dir(docs.sparkSession, "llm-flat-tokens")
    written = saved(write_flat(docs, folder, path or vocabulary("word_bpe_49k.json"), separator, kind), "flat-files")
    counts = scan_flat(written.where("bytes IS NOT NULL").select("file", "bytes"), folder, separator, kind, block)
    names = written.where("ordinal IS NOT NULL").select("file", "ordinal", "doc_id")
    return names.join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
