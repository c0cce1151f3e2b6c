"""MinHash fingerprints of documents.

A fingerprint holds the minima of COORDINATES universal hash functions (a * x + b modulo 2^64, a odd) over the word
shingles of a text, 16 bits of each, as hexadecimal text. The share of equal coordinates estimates the Jaccard likeness
of two texts' shingle sets.

* `shapes`: the vectorised hashing of a table, with a name for each shingle set and for each band of its signature.
* `near_pairs`: all documents that bands connect, verified by the exact Jaccard likeness of the full shingle sets.
* `fingerprints`: one row per document, with its estimated likeness to an edited text and to the next document, and its peer
  of `near_pairs`.

The next document may be anywhere. Documents are dealt to ranges of ids, as many as the cluster's shuffle partitions need,
and the first document of a range also visits the range before, so that texts move once and no task sees all of them.

Rules for odd input: a null text is the empty text. Texts without words have a fingerprint of their own, with likeness 1
to each other and 0 to all others. A missing id counts as larger than any other; documents with equal ids follow in the
order of their texts. Rows that repeat have a row each. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farescope.llm.common import (
    WordHashes, bucket_of, by_key, components, grouped, id_ranges, join_groups, mixed, parts, saved, shingles, text_bytes, word_hashes,
)
from farescope.llm.near_dedup import block_pairs

WIDTH = 5
COORDINATES = 128
#: Bands of COORDINATES / BANDS coordinates each; at likeness 0.8 a pair shares one with chance 0.95, at 0.9 above 0.999.
BANDS = 16
#: Likeness of peers and near pairs at least.
LIKENESS = 0.8
#: Shingles in one block of a group of candidates.
GROUP_BLOCK = 400_000
#: Rows of a table of wanted documents that are broadcast at once.
BROADCAST = 200_000
#: Ranges of ids for each shuffle partition.
SPREAD = 4

_SEEDS = np.random.default_rng(77_003).integers(1, 2**63, (2, COORDINATES), dtype=np.uint64)
_FACTORS, _SHIFTS = _SEEDS[0] * np.uint64(2) + np.uint64(1), _SEEDS[1]


def runs(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hashes of all runs of `width` words, repeats included; a shorter text is one run."""
    n = len(hashes)
    size = min(n, width)
    if not n:
        return hashes
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xA24BAED4963EE407) + hashes[k : n - size + 1 + k]
    return mixed(out)


def signature(text: bytes, cache: WordHashes) -> np.ndarray:
    """COORDINATES 16-bit values; all ones for a text without words."""
    return least_values(runs(word_hashes(text, cache)))


def least_values(found: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        np.minimum(least, (found[at : at + 512, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    return (least & np.uint64(0xFFFF)).astype("<u2")


def likeness(a: np.ndarray, b: np.ndarray, a_empty: bool, b_empty: bool) -> float:
    if a_empty or b_empty:
        return float(a_empty and b_empty)
    return float((a == b).mean())


def node_of(found: np.ndarray) -> int:
    """A 64-bit name of a set of shingles."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    places = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
    for batch in batches:
        nodes, sizes, names = [], [], []
        for text in text_bytes(batch.column("text")):
            found = shingles(word_hashes(text, cache), WIDTH)
            sizes.append(len(found))
            nodes.append(node_of(found) if len(found) else None)
            name = places
            for part in least_values(found).reshape(BANDS, -1).view("<u8").T:
                name = mixed(name + part)
            names.append(name.view(np.int64) if len(found) else None)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "node": pa.array(nodes, pa.int64()), "n_shingles": pa.array(sizes, pa.int64()),
                                          "bands": pa.array(names, pa.list_(pa.int64()))})


def shapes(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, node (a name of the shingle set, null without words), n_shingles, bands (a 64-bit name of each)."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _shapes, "doc_id long, node long, n_shingles long, bands array<long>")


def _smallest(least: float):
    """Per set of a group that has one: the smallest id whose set it is like, by counts over an index of the shingles."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for table in grouped(batches, ["root", "left", "right"]):
            held = {}
            for doc_id, node, text in zip(table.column("doc_id").to_pylist(), table.column("node").to_pylist(), text_bytes(table.column("text"))):
                found = shingles(word_hashes(text, cache), WIDTH)
                # Other texts under the same id, and rows that repeat, stay out.
                if node not in held and node_of(found) == node:
                    held[node] = (doc_id, found)
            order = sorted(held, key=lambda node: (held[node][0], node))
            if len(order) < 2:
                continue
            ids = np.array([held[node][0] for node in order])
            sizes = np.array([len(held[node][1]) for node in order])
            owner = np.repeat(np.arange(len(order), dtype=np.int32), sizes)
            _, code = np.unique(np.concatenate([held[node][1] for node in order]), return_inverse=True)
            owners = owner[np.argsort(code, kind="stable")]
            starts = np.concatenate(([0], np.cumsum(np.bincount(code))))
            at = np.concatenate(([0], np.cumsum(sizes)))
            out = []
            for i in range(1, len(order)):
                codes = code[at[i] : at[i + 1]]
                begin, length = starts[codes], starts[codes + 1] - starts[codes]
                places = np.repeat(begin - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
                both = np.bincount(owners[places], minlength=len(order))[:i]
                value = both / (sizes[:i] + sizes[i] - both)
                good = np.flatnonzero((value >= least) & (ids[:i] < ids[i]))
                if len(good):
                    out.append((order[i], int(ids[good[0]]), float(value[good[0]])))
            if out:
                nodes, peers_, values = zip(*out)
                yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "peer_id": pa.array(peers_, pa.int64()), "jaccard": pa.array(values, pa.float64())})

    return work


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """A stored table of wanted documents with their texts. It is broadcast in rounds of at most BROADCAST rows or so, so that
    only the texts in it move; more rounds read the documents more often."""
    rounds = max(1, -(-wanted.count() // BROADCAST))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = [texts.join(F.broadcast(wanted.where(F.pmod(F.xxhash64("node"), F.lit(rounds)) == k)), "doc_id") for k in range(rounds)]
    return reduce(DataFrame.unionByName, found)


def near_pairs(docs: DataFrame, least: float = LIKENESS, salt_rows: int = 1000) -> DataFrame:
    """Per document that has one: the smallest id before its own among the documents that bands connect with it, directly or
    through others, at an exact Jaccard likeness of `least` or more: doc_id, peer_id, jaccard.

    Rows with equal shingle sets form a class, represented by its smallest id; only classes go on. The classes of a band are
    linked with its smallest one, and the texts of each component of links meet, all with all, in one task or in pairs of
    blocks of `salt_rows` texts or GROUP_BLOCK shingles or so.
    """
    rows = saved(shapes(docs), "shapes")
    classes = saved(rows.where("doc_id IS NOT NULL AND node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("members"), F.first("bands").alias("bands")), "classes")
    posts = classes.select("node", F.explode("bands").alias("band"))
    lists = posts.groupBy("band").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    links = join_groups(posts, lists, ["band"], "n", BANDS * classes.count()).where("node <> first")
    found = components(links.select(F.col("node").alias("a"), F.col("first").alias("b")), "candidates")
    load = classes.select(F.col("rep").alias("doc_id"), "node", "n_shingles", "members").join(found.withColumnRenamed("id", "node"), "node")
    blocks = load.groupBy("root").agg(F.greatest(F.ceil(F.sum("n_shingles") / GROUP_BLOCK), F.ceil(F.count("*") / salt_rows)).cast("bigint").alias("blocks"))
    texts = texts_of(docs, saved(load.select("doc_id", "node", "root").join(blocks, "root"), "wanted"))
    met = by_key(block_pairs(texts, "blocks", "node"), ["root", "left", "right"])
    best = met.mapInArrow(_smallest(least), "node long, peer_id long, jaccard double").groupBy("node").agg(
        F.min(F.struct("peer_id", "jaccard")).alias("best"))
    known = classes.select("node", "rep", "members").join(best, "node", "left").where("members > 1 OR best IS NOT NULL")
    own = F.when(F.col("rep") < F.col("doc_id"), F.struct(F.col("rep").alias("peer_id"), F.lit(1.0).alias("jaccard")))
    pairs = join_groups(rows.where("doc_id IS NOT NULL AND node IS NOT NULL").select("doc_id", "node"), known, ["node"], "members", rows.count())
    return pairs.select("doc_id", F.coalesce("best", own).alias("best")).where("best IS NOT NULL").groupBy("doc_id").agg(F.min("best").alias("best")).select(
        "doc_id", "best.peer_id", "best.jaccard")


def edited(text: str, following: str) -> str:
    """A text whose last half is replaced by as many code points from the start of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, peer_id long, near_peer double")


def _edit(rows: pa.Table, found: pa.Table) -> pa.Table:
    """One range of documents in descending order of id, the visiting ones last; and the peers of its documents."""
    own = {k for k, guest in enumerate(rows.column("guest").to_pylist()) if not guest}
    out: dict[str, list] = {name.split()[0]: [] for name in RESULT.split(", ")}
    if own:
        ids, raw = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (k not in own, -(1 << 63 if ids[k] is None else ids[k]), raw[k] or ""))
        cache = WordHashes()
        peer = dict(zip(found.column("doc_id").to_pylist(), zip(found.column("peer_id").to_pylist(), found.column("near_peer").to_pylist())))
        texts = [raw[k] or "" for k in order[: len(own) + 1]]
        signs = [signature(text.encode(), cache) for text in texts]
        bare = [not text.encode().strip() for text in texts]
        for k in range(len(own)):
            after = edited(texts[k], texts[k + 1])
            data = after.encode()
            changed, void = signature(data, cache), not data.strip()
            doc_id = ids[order[k]]
            peer_id, near = peer.get(doc_id, (None, None))
            values = (doc_id, len(texts[k]), hashlib.sha256(data).hexdigest(), _hex(signs[k]), _hex(changed),
                      likeness(signs[k], changed, bare[k], void), likeness(signs[k], signs[k + 1], bare[k], bare[k + 1]), peer_id, near)
            for name, value in zip(out, values):
                out[name].append(value)
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.table({name: pa.array(out[name], kinds[kind]) for name, kind in (x.split() for x in RESULT.split(", "))})


def _hex(sign: np.ndarray) -> str:
    return sign.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; and
    its peer of `near_pairs` with the exact likeness of their shingle sets: peer_id, near_peer."""
    n = parts(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    cuts = id_ranges(docs, SPREAD * n)
    rows = rows.withColumn("span", bucket_of("doc_id", cuts))
    top = F.max(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    # One row per range.
    firsts = {r["span"]: r["top"] for r in rows.groupBy("span").agg(top.alias("top")).collect()}
    order = sorted(firsts)
    marks = F.lit(None).cast("long")
    if order:
        # The first document of a range, in descending order, follows the last one of the range above; that of the top range follows the very last.
        above = dict(zip(order, [*order[1:], order[0]]))
        visits = F.create_map(*[F.lit(x) for span in order for x in (span, above[span])])
        known = [span for span in order if firsts[span]["doc_id"] is not None and not firsts[span]["none"]]
        least = F.create_map(*[F.lit(x) for span in known for x in (span, firsts[span]["doc_id"])]) if known else None
        bare = [span for span in order if firsts[span]["none"]]
        leads = F.col("span").isin(bare) & F.col("doc_id").isNull()
        if least is not None:
            leads = leads | F.coalesce(F.col("doc_id") == F.try_element_at(least, F.col("span")), F.lit(False))
        marks = F.when(leads, F.try_element_at(visits, F.col("span")))
    stay = F.struct(F.col("span").alias("at"), F.lit(False).alias("guest"))
    visit = F.struct(marks.alias("at"), F.lit(True).alias("guest"))
    dealt = rows.select("doc_id", "text", F.explode(F.when(marks.isNull(), F.array(stay)).otherwise(F.array(stay, visit))).alias("d")).select(
        "doc_id", "text", "d.at", "d.guest")
    found = near_pairs(docs).withColumnRenamed("jaccard", "near_peer").withColumn("at", bucket_of("doc_id", cuts))
    return dealt.groupBy("at").cogroup(found.groupBy("at")).applyInArrow(_edit, RESULT)
