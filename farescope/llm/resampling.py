"""Importance resampling towards a target distribution: documents whose words look like those of the target are drawn.

1. An untrained `Split` pre-tokeniser of the tokenizers library, with one pattern over the text with A-Z lowered, gives
   the words with their offsets. A feature is a run of 1 to `runs` words: the window from the first offset of its first
   word to the last offset of its last one, in the words joined by single spaces. Its bucket is its crc32 modulo `buckets`.
2. Bucket counts of all documents and of all target texts give each bucket an integer gain, the scaled log ratio of the
   smoothed shares. A document's weight is the sum of the gains of its features, repeats counted.
3. Gumbel noise from a hash of the id makes the highest scores a draw without replacement in proportion to the weights
   (as exponentials). The scores are numbered by a sort into ranges and the offsets of the ranges, not in one task.

Texts are read and split once: a document goes on as its distinct buckets and their counts, at most `buckets` of each. Texts
longer than PIECE characters are split in pieces between words, so memory is bounded unless one word is longer.

Rules for odd input: a null text is empty; it has no features, weight 0, and is never drawn, as are texts with fewer than
`least` words. A missing id is the empty text in the hash and comes after all others in ties. Rows that repeat are scored
and drawn each on their own. Without target texts all gains are those of an empty target. Only `doc_id` and `text`
are read, other columns are ignored by `draw` and kept by `drawn`. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from farescope.llm.common import CACHE_WORDS, parts, saved

#: A word: anything but ASCII that is neither a digit nor a lower-case letter.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, RUNS = 10_000, 1
#: Words of a document that may be drawn, and the share of them that is.
LEAST_WORDS, PERCENT = 20, 10
SEED = 2024
#: Characters of a text that are split at once.
PIECE = 1 << 20
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Buckets(dict):
    """Bucket of a feature, remembered."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[feature] = zlib.crc32(feature.encode()) % self.n
        return value


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A text cut between words, each piece as soon after `size` characters as no word is cut."""
    at, gap = 0, re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
    while len(text) - at > size:
        found = gap.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def histogram(text: str, split: Split, known: Buckets, runs: int = RUNS, size: int = PIECE) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Number of words, number of features, distinct buckets and how often each occurs."""
    held: list[str] = []
    words = features = 0
    found = []
    for piece in pieces(text.translate(_LOWER), size):
        # Runs may reach back over the cut, but those within the words held back are counted already.
        old = len(held)
        held += [word for word, _ in split.pre_tokenize_str(piece)]
        words += len(held) - old
        line = " ".join(held)
        ends = np.cumsum([len(w) + 1 for w in held], dtype=np.int64) - 1
        starts = np.concatenate(([0], ends[:-1] + 1)) if held else ends
        for run in range(1, runs + 1):
            first = max(old - run + 1, 0)
            windows = zip(starts[first : len(held) - run + 1].tolist(), ends[first + run - 1 :].tolist())
            hits = [known[line[a:b]] for a, b in windows] if run > 1 else [known[w] for w in held[old:]]
            features += len(hits)
            found.append(np.bincount(hits, minlength=known.n) if hits else None)
        held = held[max(0, len(held) - runs + 1) :] if runs > 1 else []
    total = sum((f for f in found if f is not None), np.zeros(known.n, np.int64))
    kept = np.flatnonzero(total)
    return words, features, kept, total[kept]


def _histograms(runs: int, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = Split(Regex(WORD), "removed", invert=True), Buckets(buckets)
        for batch in batches:
            # A row at a time from the batch; an answer for every thousand rows.
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [histogram(t.as_py() or "", split, known, runs) for t in part.column("text")]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_words": pa.array([r[0] for r in rows], pa.int64()),
                    "n_features": pa.array([r[1] for r in rows], pa.int64()),
                    "buckets": pa.array([r[2] for r in rows], pa.list_(pa.int32())),
                    "counts": pa.array([r[3] for r in rows], pa.list_(pa.int64()))})

    return work


def histograms(texts: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_words, n_features, buckets, counts."""
    return texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _histograms(runs, buckets), "doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and counts of all rows of a batch, and where each row begins among them."""
    lists = batch.column("buckets")
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(), batch.column("counts").flatten().to_numpy(), np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)


def totals(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all rows: each task sums first, `buckets` numbers reach the driver."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            names, counts, _ = _flat(batch)
            np.add.at(total, names, counts)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(hit, pa.int32()), "n": pa.array(total[hit], pa.int64())})

    out = np.zeros(buckets, np.int64)
    for r in rows.select("buckets", "counts").mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of the smoothed shares of each bucket."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())],
                    np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of stored histograms."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        for batch in batches:
            names, counts, begin = _flat(batch)
            upto = np.concatenate(([0], np.cumsum(mine[names] * counts)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "n_words", "n_features")],
                                              pa.array(upto[begin[1:]] - upto[begin[:-1]], pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(work, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int = SEED, doc_id: str = "doc_id") -> Column:
    """Whole thousandths of Gumbel noise from a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.left(F.sha2(text, 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with their place from 1 in an order, by a sort into ranges; one number per range reaches the driver."""
    ranges = rows.repartitionByRange(parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    # The id that grows has the number of the partition in its upper bits and the place within it in its lower 33.
    kept = saved(ranges.withColumn("at", F.monotonically_increasing_id()), "ranges")
    number = F.shiftright("at", 33).cast("int")
    sizes = dict(kept.groupBy(number.alias("part")).agg(F.count("*").alias("n")).collect())
    before, offsets = 0, [0] * (max(sizes, default=-1) + 1)
    for part in sorted(sizes):
        offsets[part] = before
        before += sizes[part]
    begin = F.get(F.split(F.lit(",".join(map(str, offsets))), ",").cast("array<bigint>"), number)
    return kept.withColumn("place", begin + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("at")


def draw(docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT,
         seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (from 1 by score; null where it is not drawn).

    `target` has a column `text`. Of the documents with `least` words or more, `percent` of a hundred are drawn.
    """
    rows = saved(histograms(docs, runs, buckets), "histograms")
    wanted = totals(histograms(target.select(F.lit(0).alias("doc_id"), "text"), runs, buckets), buckets)
    scored = weighted(rows, gains(totals(rows, buckets), wanted)).withColumn("score", F.col("weight") + noise(seed))
    fits = F.col("n_words") >= least
    size = rows.agg(F.count_if(fits)).first()[0] * percent // 100
    # Those that cannot be drawn come last.
    order = [(~fits).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    return numbered(scored, order).select("doc_id", "n_features", "weight", "score",
                                          F.when(fits & (F.col("place") <= size), F.col("place")).alias("rank"))


#: The same over `documents` and `benchmark` in SQL. A crc32 goes byte by byte through the table of its polynomial.
ORACLE = r"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
texts AS (
  SELECT doc_id, true AS own, text FROM documents
  UNION ALL SELECT item_id, false, text FROM benchmark),
found AS (
  SELECT doc_id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
spread AS (SELECT doc_id, own, unnest(words) AS word FROM found),
named AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hex(word)) // 2),
      lambda k: ((strpos('0123456789ABCDEF', substr(hex(word), 2 * k + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(word), 2 * k + 2, 1)) - 1)::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM spread), crc),
sums AS (
  SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM spread JOIN named USING (word) GROUP BY bucket),
every AS (SELECT count(*) FILTER (own) AS s_all, count(*) FILTER (NOT own) AS t_all FROM spread),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g FROM sums, every),
weights AS (
  SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS weight FROM spread JOIN named USING (word) JOIN gain USING (bucket) WHERE own GROUP BY doc_id),
hashed AS (
  SELECT doc_id, len(words) AS n_features, list_reduce(list_prepend(0::BIGINT, list_transform(range(8),
      lambda k: (strpos('0123456789abcdef', substr(sha256('2024:' || doc_id), k + 1, 1)) - 1)::BIGINT)), lambda a, d: a * 16 + d) AS h
  FROM found WHERE own),
scored AS (
  SELECT doc_id, n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM hashed LEFT JOIN weights USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= fit * 10 // 100 THEN place END AS rank FROM placed
"""
