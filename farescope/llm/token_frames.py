"""Token ids in files of independent zstandard frames with a trailing seek table.

Documents are dealt to buckets by ranges of their id; a bucket is one file, its documents in ascending order of id.
A file is, as in zstandard's seekable format:

* one frame per document: its ids as little-endian unsigned 32-bit numbers;
* a skippable frame (0x184D2A50) with the documents' ids, as little-endian signed 64-bit numbers;
* a skippable frame (0x184D2A5E), the seek table: for every frame before it, its compressed size, its size, and the low
  half of XXH64 of its content, as 32-bit numbers (the frame of document ids has size 0 and checksum 0); then the number
  of entries, a byte with bit 7 set (checksums present), and 0x8F92EAB1.

A reader takes the end of the file, the seek table, the document ids, and then only the frames it wants. Files get their
final name when they are whole, and a repeated task writes the same bytes, so lost executors do no harm.

Rules for odd input: a null text is empty and has only its end id. Documents without an id are written last, with the
largest 64-bit number as their id, and come back without one. Rows that repeat are written each. Equal ids are in one
file, in the order of their texts. Other columns are ignored. An empty table writes no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farescope.llm.common import bucket_of, grouped, id_ranges, parts, saved, text_bytes
from farescope.llm.packing import sliced
from farescope.llm.tokens import encoder, vocabulary
from farescope.session import work_dir

END_ID = 1
LEVEL = 3
#: Fixed values of the seekable format.
IDS_MAGIC, SEEK_MAGIC, FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Stands for a missing id.
NO_ID = np.iinfo(np.int64).max
#: Buckets for each shuffle partition.
SPREAD = 4


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file; a plain path is a local one."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def publish(system: fs.FileSystem, draft: str, name: str) -> None:
    """Give a whole file its name, in place of the same file from an earlier try."""
    if system.get_file_info(name).type != fs.FileType.NotFound:
        system.delete_file(name)
    system.move(draft, name)


def frame_file(doc_ids: np.ndarray, contents: Iterable[bytes], out) -> int:
    """Write one file of frames; the number of bytes."""
    pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
    table = []
    size = 0
    for content in contents:
        frame = pack.compress(content)
        table.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        size += out.write(frame)
    ids = np.asarray(doc_ids, "<i8").tobytes()
    size += out.write(struct.pack("<II", IDS_MAGIC, len(ids)) + ids)
    table.append((len(ids) + 8, 0, 0))
    body = np.array(table, "<u4").tobytes() + struct.pack("<IBI", len(table), 0x80, FOOT_MAGIC)
    return size + out.write(struct.pack("<II", SEEK_MAGIC, len(body)) + body)


@dataclass
class FrameReader:
    """Random access to the documents of one file of frames."""

    source: pa.NativeFile

    def __post_init__(self):
        size = self.source.size()
        count, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != FOOT_MAGIC or flags != 0x80:
            raise ValueError("not a file of frames with checksums")
        body = self._read(size - 9 - 12 * count - 8, 8 + 12 * count)
        if struct.unpack("<II", body[:8]) != (SEEK_MAGIC, 12 * count + 9):
            raise ValueError("broken seek table")
        self.table = np.frombuffer(body, "<u4", offset=8).reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.table[:, 0])))
        self.doc_ids = np.frombuffer(self._read(self.starts[-2] + 8, self.table[-1, 0] - 8), "<i8")
        self.sizes = self.table[:-1, 1]
        self.unpack = zstandard.ZstdDecompressor()

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(int(at))
        return self.source.read(int(size))

    def __len__(self) -> int:
        return len(self.doc_ids)

    def content(self, k: int) -> bytes:
        """Verified content of the k-th document; reads its frame only."""
        found = self.unpack.decompress(self._read(self.starts[k], self.table[k, 0]), max_output_size=int(self.table[k, 1]) or 1)
        if len(found) != self.table[k, 1] or xxhash.xxh64_intdigest(found) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} does not match its checksum")
        return found

    def ids(self, k: int) -> np.ndarray:
        return np.frombuffer(self.content(k), "<u4")

    def find(self, doc_id: int) -> range:
        """Positions of a document id."""
        return range(*(int(np.searchsorted(self.doc_ids, doc_id, side)) for side in ("left", "right")))


def _write(folder: str, path: str, end_id: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, spaced=False).encode
        for table in grouped(batches, ["bucket"]):
            bucket = table.column("bucket")[0].as_py()
            tokens = 0

            def contents() -> Iterator[bytes]:
                nonlocal tokens
                for _, texts in sliced(text_bytes(table.column("text"))):
                    flat, counts = encode(texts)
                    at = 0
                    for n in counts.tolist():
                        tokens += n + 1
                        yield flat[at : at + n].astype("<u4").tobytes() + struct.pack("<I", end_id)
                        at += n

            system, at = place(folder)
            system.create_dir(at, recursive=True)
            name, draft = f"{at}/tokens-{bucket:06d}.zst", f"{at}/draft-{bucket:06d}-{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as out:
                frame_file(table.column("doc_id").fill_null(NO_ID).to_numpy(), contents(), out)
            publish(system, draft, name)
            yield pa.RecordBatch.from_pydict({"bucket": [bucket], "path": [f"{folder}/tokens-{bucket:06d}.zst"], "docs": [table.num_rows], "tokens": [tokens]})

    return work


def write_frames(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Write a table of documents as files of frames; one row per file: bucket, path, docs, tokens.

    A bucket is held in memory while its file is written; there are SPREAD buckets for each shuffle partition.
    """
    n = parts(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = rows.withColumn("bucket", bucket_of("doc_id", id_ranges(docs, SPREAD * n)))
    dealt = rows.repartition(n, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_last(), "text")
    return dealt.mapInArrow(_write(folder, path, end_id), "bucket long, path string, docs long, tokens long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            system, at = place(path)
            with system.open_input_file(at) as source:
                reader = FrameReader(source)
                counts = reader.sizes // 4
                crcs = [zlib.crc32(reader.content(k)) for k in range(len(reader))]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(reader.doc_ids, mask=reader.doc_ids == NO_ID), "start": start + np.cumsum(counts) - counts,
                    "n_tokens": counts, "ids_crc32": pa.array(crcs, pa.int64())})


def read_frames(files: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32. `files` is what `write_frames` gives, stored."""
    # One row per file, as many as there are buckets.
    before = F.sum("tokens").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.withColumn("start", F.coalesce(before, F.lit(0)))
    return placed.repartition(parts(files.sparkSession), "bucket").select("path", "start").mapInArrow(
        _read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(spark: SparkSession, files: DataFrame, wanted: list[int]) -> DataFrame:
    """Ids of some documents, decompressing their frames only: doc_id, ids."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, at = place(path)
                with system.open_input_file(at) as source:
                    reader = FrameReader(source)
                    for doc_id in wanted:
                        for k in reader.find(doc_id):
                            yield pa.RecordBatch.from_pydict({"doc_id": [doc_id], "ids": pa.array([reader.ids(k).astype(np.int64)], pa.list_(pa.int64()))})

    return files.select("path").mapInArrow(work, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write all documents as files of frames in the shared folder, and read them back."""
    files = write_frames(docs, work_dir(docs.sparkSession, "llm-frames"), path or vocabulary("word_bpe_49k.json"), end_id)
    return read_frames(saved(files, "frame-files"))
