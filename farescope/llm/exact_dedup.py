"""Exact duplicates by a tree merge of sorted digest runs.

Every partition sorts the digests of its rows into runs, one for each range of digests. In binomial rounds up to FAN
runs of a range meet in one task, which merges them and keeps, for equal digests, the smallest id and the number of
rows. After the last round a range has one run. No round sees a digest more than FAN times, however many rows have it.

Rules for odd input: a null text is the empty text; all empty texts are equal. A null doc_id counts as larger than any
other. Rows that repeat an id and its text are one group's rows like any others, and only one of them is kept. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farescope.llm.common import SPACES, free_name, join_groups, parts, saved

#: Runs that one task merges at most.
FAN = 8
#: Distinct digests that a range should have.
RANGE_ROWS = 50_000
#: Entry of a run: digest, second fingerprint of the text, its length in bytes, smallest id, rows.
ENTRY = np.dtype([("digest", "S32"), ("check", "<i8"), ("size", "<i8"), ("least", "<i8"), ("n", "<i8")])
#: Stands for a null id inside a run.
LAST_ID = np.iinfo(np.int64).max


def normal(text: str | Column) -> Column:
    """Text with each run of ASCII white space as one space."""
    value = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(value, F.lit("")), SPACES, " ")


def digests(docs: DataFrame) -> DataFrame:
    """Identity of each row's normalised text: SHA-256, and a second hash with the length to verify equal digests."""
    text = normal("text").cast("binary")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("t")).select(
        "doc_id", F.unhex(F.sha2("t", 256)).alias("digest"), F.xxhash64("t").alias("check"), F.octet_length("t").cast("bigint").alias("size"))


def _padded(values: pa.Array) -> np.ndarray:
    # A fixed-width view: numpy's S type drops trailing zero bytes, which is harmless for values of one width.
    flat = np.frombuffer(b"".join(values.to_pylist()), np.uint8)
    return flat.reshape(-1, 32).copy().view("S32").ravel()


def keys(run: np.ndarray) -> np.ndarray:
    """What runs are sorted by, as one value of fixed width: digest, check and size, the numbers with their highest byte first."""
    out = np.empty((len(run), 48), np.uint8)
    out[:, :32] = np.ascontiguousarray(run["digest"]).view(np.uint8).reshape(-1, 32)
    for at, name in ((32, "check"), (40, "size")):
        # The sign bit turned, so that bytes are in the order of the numbers.
        out[:, at : at + 8] = (np.ascontiguousarray(run[name]).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S48").ravel()


def folded(run: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One entry for each verified text of a sorted run, with its key: smallest id, sum of rows."""
    if not len(run):
        return run, key
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    out = run[at].copy()
    out["least"] = np.minimum.reduceat(run["least"], at)
    out["n"] = np.add.reduceat(run["n"], at)
    return out, key[at]


def sorted_run(rows: np.ndarray) -> np.ndarray:
    """A run of rows in any order."""
    key = keys(rows)
    order = np.argsort(key, kind="stable")
    return folded(rows[order], key[order])[0]


def merged(runs: list[np.ndarray]) -> np.ndarray:
    """Multiway merge of sorted runs, verified and folded: runs meet in pairs, each entry of one is put at its rank in the other."""
    waiting = [(run, keys(run)) for run in runs if len(run)]
    while len(waiting) > 1:
        waiting = [_pair(*waiting[i : i + 2]) for i in range(0, len(waiting), 2)]
    return folded(*waiting[0])[0] if waiting else np.empty(0, ENTRY)


def _pair(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    if two is None:
        return one
    (a, ka), (b, kb) = one, two
    behind = np.searchsorted(ka, kb, side="right") + np.arange(len(kb))
    ahead = np.ones(len(ka) + len(kb), bool)
    ahead[behind] = False
    run, key = np.empty(len(ahead), ENTRY), np.empty(len(ahead), "S48")
    run[ahead], run[behind], key[ahead], key[behind] = a, b, ka, kb
    return folded(run, key)


def _first_runs(ranges: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, waiting = np.empty(0, ENTRY), []
        for batch in batches:
            new = np.empty(batch.num_rows, ENTRY)
            new["digest"] = _padded(batch.column("digest"))
            for name in ("check", "size"):
                new[name] = batch.column(name).to_numpy(zero_copy_only=False)
            new["least"] = batch.column("doc_id").fill_null(LAST_ID).to_numpy(zero_copy_only=False)
            new["n"] = 1
            waiting.append(new)
            if sum(map(len, waiting)) > 500_000:
                run, waiting = merged([run, sorted_run(np.concatenate(waiting))]), []
        run = merged([run, sorted_run(np.concatenate(waiting))]) if waiting else run
        if len(run):
            high = run["digest"].astype("S32").view(np.uint8).reshape(-1, 32)[:, :4].copy().view(">u4").ravel()
            at = (high.astype(np.uint64) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(at, np.arange(ranges + 1))
            number = TaskContext.get().partitionId()
            for k in range(ranges):
                if cuts[k] < cuts[k + 1]:
                    yield pa.RecordBatch.from_pydict({"span": [k], "node": [number], "run": [run[cuts[k] : cuts[k + 1]].tobytes()]})

    return work


def _merge_round(group: pa.Table) -> pa.Table:
    out = merged([np.frombuffer(blob, ENTRY) for blob in group.column("run").to_pylist()])
    return pa.table({"span": group.column("span")[:1], "node": group.column("node")[:1], "run": pa.array([out.tobytes()], pa.binary())})


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("run").to_pylist():
            run = np.frombuffer(blob, ENTRY)
            raw = run["digest"].astype("S32").view(np.uint8).reshape(-1, 32)
            yield pa.RecordBatch.from_pydict({
                "digest": pa.array([bytes(x) for x in raw], pa.binary()), "check": run["check"].copy(), "size": run["size"].copy(),
                "keep_id": pa.array(run["least"].copy(), mask=run["least"] == LAST_ID), "group_size": run["n"].copy()})


def groups(keyed: DataFrame, total: int) -> DataFrame:
    """One row for each distinct text of a table of `digests`: smallest id and number of rows."""
    spark = keyed.sparkSession
    ranges = max(1, -(-total // RANGE_ROWS))
    runs = keyed.mapInArrow(_first_runs(ranges), "span long, node long, run binary")
    nodes = max(1, keyed.rdd.getNumPartitions())
    while nodes > 1:
        nodes = -(-nodes // FAN)
        runs = runs.withColumn("node", F.expr(f"node div {FAN}")).groupBy("span", "node").applyInArrow(
            _merge_round, "span long, node long, run binary")
    return runs.mapInArrow(_entries, "digest binary, check long, size long, keep_id long, group_size long")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    keyed = saved(digests(docs), "digests")
    total = keyed.count()
    found = saved(groups(keyed, total), "digest-groups")
    copy = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("check"))
    joined = join_groups(keyed.withColumn("copy", copy), found, ["digest", "check", "size"], "group_size", total)
    return joined.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of a table that stay, with all their columns."""
    names = [free_name(docs, "copy_id"), free_name(docs, "copy_sha")]
    number = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID))
    kept = exact_duplicates(docs).where("kept").select(number.alias(names[0]), F.col("text_sha256").alias(names[1]))
    rows = docs.withColumn(names[0], number).withColumn(names[1], F.sha2(normal("text").cast("binary"), 256))
    return rows.join(kept, names, "left_semi").dropDuplicates(names).drop(*names)


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""
