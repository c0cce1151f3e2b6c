"""Toxicity by weak supervision.

1. Features of a text are its distinct lower-cased words and the first STEMS letters of longer words. Those that mark
   labelled toxic texts become voters: each strong word or stem votes by itself, the others in a few lexicons, next to
   pattern voters (hits close together, several hits, hits repeated, no hit at all).
2. A generative label model is fitted by expectation maximisation over the votes: for every voter the chance of each
   vote (toxic, clean, none) given the unknown class. The label of a training row is a voter that errs in 1 of 100. Correlations of voters within a class are estimated from the
   expected joint votes, and a voter's evidence is divided by the correlated evidence it repeats.
3. A logistic regression over the marked features is trained on the posterior labels and scores every text.

Labels are read only for the training rows, to find the lexicons and to fit the label model. At most `sample` labelled
rows, those with the smallest hashed id, are used; that bounds what reaches the driver. Scoring reads all rows.

Rules for odd input: a null text is the empty text and has the score of a text without any marked feature. Label rows
with a null id or label are ignored; of repeated labels the larger counts. Rows that repeat are scored each on their own.
Without both labels among the training rows the score is their smoothed share everywhere. Other columns are ignored by
`scores` and kept by `clean`. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from farescope.llm.common import CACHE_WORDS, free_name, id_crc, text_bytes

THRESHOLD = 0.3
#: Labelled rows that train at most.
SAMPLE = 20_000
#: Lengths in bytes of the beginnings of words that count as stems.
STEMS = (4, 5, 6, 7)
#: Marked features kept at most, and those that vote by themselves.
FEATURES, SINGLE = 2000, 24
LEXICONS = 6
#: Smallest log ratio of a marked feature's shares among toxic and clean texts.
RATIO = 2.0
#: Smallest share of the toxic texts that have a marked feature.
SUPPORT = 0.02
#: Accuracy of the labels themselves, as one more voter of the training rows.
TRUST = 0.99
HELD_OUT = (4, 2)


def held_out(doc_id: str = "doc_id"):
    return id_crc(doc_id) % HELD_OUT[0] == HELD_OUT[1]


def features(word: bytes) -> list[bytes]:
    """A word and its stems; a stem ends with a star."""
    return [word, *(word[:n] + b"*" for n in STEMS if len(word) > n)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = (Counter(), Counter())
    for batch in batches:
        for toxic, text in zip(batch.column("toxic").to_pylist(), text_bytes(batch.column("text"))):
            found = set()
            for word in set(text.lower().split()):
                found.update(features(word))
            counts[toxic].update(found)
    # A feature must be seen in a toxic text somewhere; those that are not anywhere here go on only as clean counts.
    names = list(counts[1].keys() | {k for k, n in counts[0].items() if n > 0})
    for at in range(0, len(names), 50_000):
        part = names[at : at + 50_000]
        yield pa.RecordBatch.from_pydict({"feature": pa.array(part, pa.binary()), "toxic": pa.array([counts[1][k] for k in part], pa.int64()),
                                          "clean": pa.array([counts[0][k] for k in part], pa.int64())})


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Labelled training rows: doc_id, text, toxic. Evenly thinned by hashed id to about `sample` if there are more."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).where(~held_out())
    total = marks.count()
    if total > sample:
        marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    # At most `sample` narrow rows of fixed width.
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(marks), "doc_id")


@dataclass
class Lexicon:
    names: list[bytes]
    weight: np.ndarray
    number: dict[bytes, int]

    def hits(self, text: bytes, known: dict[bytes, tuple[int, ...]]) -> list[tuple[int, ...]]:
        """Marked features of each word of a text that has some."""
        out = []
        for word in text.lower().split():
            found = known.get(word)
            if found is None:
                if len(known) > CACHE_WORDS:
                    known.clear()
                found = known[word] = tuple(self.number[k] for k in features(word) if k in self.number)
            if found:
                out.append(found)
        return out


def mined(rows: DataFrame, toxic: int, clean: int) -> Lexicon:
    """Features whose share among toxic texts is far above that among clean ones."""
    least = max(3.0, SUPPORT * toxic)
    counts = rows.select("text", "toxic").mapInArrow(_count, "feature binary, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    top = counts.where(F.col("toxic") >= least).select("feature", ratio.alias("ratio"), "toxic").where(F.col("ratio") >= RATIO).orderBy(
        F.desc(F.col("ratio") * F.log1p("toxic")), "feature").limit(FEATURES).collect()
    names = [bytes(r["feature"]) for r in top]
    return Lexicon(names, np.array([r["ratio"] for r in top]), {k: i for i, k in enumerate(names)})


def _hits(lexicon: Lexicon):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            lists = [[x for word in lexicon.hits(text, known) for x in (*word, -1)] for text in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "hits": pa.array(lists, pa.list_(pa.int32()))})

    return work


class Hits:
    """Lists of feature numbers, kept as flat numbers; a list is made when it is looked at."""

    def __init__(self, column: pa.ChunkedArray):
        self.chunks = column.chunks

    def __len__(self) -> int:
        return sum(map(len, self.chunks))

    def __iter__(self) -> Iterator[list[int]]:
        for chunk in self.chunks:
            for item in chunk:
                yield item.values.to_numpy().tolist()


def vote(hits: list[list[int]], lexicon: Lexicon) -> np.ndarray:
    """Votes of all voters, 1 toxic, 0 none, -1 clean; `hits` has the feature numbers word by word, each word ended by -1."""
    n = len(lexicon.names)
    single = min(SINGLE, n)
    votes = np.zeros((len(hits), single + LEXICONS + 4), np.int8)
    for row, found in enumerate(hits):
        words = sum(x < 0 for x in found)
        marks = {x for x in found if x >= 0}
        for x in marks:
            votes[row, x if x < single else single + x % LEXICONS] = 1
        votes[row, single + LEXICONS :] = (1 if words >= 2 else -1, 1 if words >= 4 else 0 if words else -1,
                                           1 if len(marks) >= 4 else 0 if marks else -1, 0 if words else -1)
    return votes


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior chance of the toxic class for each row, from the votes of all voters and a label that may be wrong."""
    shown = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    p = np.clip(start, 1 - TRUST, TRUST)
    label = np.log(p / (1 - p))
    share = np.ones(votes.shape[1])
    for turn in range(rounds):
        balance = (p.sum() + 1) / (len(p) + 2)
        chance = np.stack([(np.einsum("n,nvk->vk", w, shown) + 0.5) / (w.sum() + 1.5) for w in (1 - p, p)])
        if turn % 10 == 0:
            share = 1 / _overlap(votes, p)
        evidence = label + np.einsum("nvk,vk->n", shown, share[:, None] * (np.log(chance[1]) - np.log(chance[0])))
        new = 1 / (1 + np.exp(-np.clip(np.log(balance / (1 - balance)) + evidence, -30, 30)))
        if np.abs(new - p).max() < 1e-5:
            return new
        p = new
    return p


def _overlap(votes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """How often a voter's evidence is told: 1 plus its correlations with all others within the classes."""
    joint = np.zeros((votes.shape[1], votes.shape[1]))
    x = votes.astype(float)
    for w in (1 - p, p):
        total = max(w.sum(), 1e-9)
        y = x - (w @ x) / total
        joint += (y * w[:, None]).T @ y
    scale = np.sqrt(np.diag(joint)) + 1e-9
    return np.clip(np.abs(joint / np.outer(scale, scale)), 0, 1).sum(axis=1) - np.clip(np.abs(np.diag(joint) / scale**2), 0, 1) + 1


def linear(hits: list[list[int]], target: np.ndarray, n: int, rounds: int = 300, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression with soft targets: marked features (the strongest of a word counts for it), then hits, then bias."""
    rows, cols, values = _matrix(hits, n)
    w = np.zeros(n + 3)
    w[-1] = -2.0
    # A diagonal bound on the curvature, so that whole steps are safe.
    scale = np.bincount(cols, values * np.bincount(rows, values, len(hits))[rows], n + 3) / 4 + ridge
    ahead = w
    for turn in range(rounds):
        z = np.bincount(rows, ahead[cols] * values, len(hits))
        slip = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        grad = np.bincount(cols, slip[rows] * values, n + 3) + ridge * np.append(ahead[:-1], 0)
        new = ahead - grad / scale
        ahead = new + turn / (turn + 3) * (new - w)
        w = new
    return w


def _matrix(hits: list[list[int]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, cols, values = [], [], []
    for row, found in enumerate(hits):
        marks = sorted({x for x in found if x >= 0})
        words = sum(x < 0 for x in found)
        rows += [row] * (len(marks) + 3)
        cols += [*marks, n, n + 1, n + 2]
        values += [*[1.0] * len(marks), float(np.log1p(words)), float(words >= 2), 1.0]
    return np.array(rows), np.array(cols), np.array(values)


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, found: list[tuple[int, ...]]) -> float:
        n = len(self.lexicon.names)
        marks = {x for word in found for x in word}
        z = self.weights[list(marks)].sum() + self.weights[n] * np.log1p(len(found)) + self.weights[n + 1] * (len(found) >= 2) + self.weights[n + 2]
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = training_rows(docs, labels, sample).persist()
    try:
        seen = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        toxic, clean = seen.get(1, 0), seen.get(0, 0)
        if not toxic or not clean:
            share = (toxic + 0.5) / (toxic + clean + 1)
            return Model(Lexicon([], np.empty(0), {}), np.array([0.0, 0.0, np.log(share / (1 - share))]))
        lexicon = mined(rows, toxic, clean)
        found = rows.mapInArrow(_hits(lexicon), "toxic int, hits array<int>").toArrow()
    finally:
        rows.unpersist()
    hits = Hits(found.column("hits"))
    start = found.column("toxic").to_numpy().astype(float)
    posterior = label_model(vote(hits, lexicon), start)
    return Model(lexicon, linear(hits, posterior, len(lexicon.names)))


def scored(docs: DataFrame, model: Model, name: str = "score_of_text") -> DataFrame:
    """All columns of a table and the score as a column with a name that the table lacks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, ...]] = {}
        mine = shared.value
        for batch in batches:
            score = [mine.score(mine.lexicon.hits(text, known)) for text in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(work, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = scored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), train(docs, labels, sample))
    return rows.select("doc_id", held_out().alias("held_out"), F.col("score_of_text").alias("score"),
                       (F.col("score_of_text") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of a table that are not predicted toxic, with all their columns."""
    name = free_name(docs, "score_of_text")
    return scored(docs, train(docs, labels, sample), name).where(F.col(name) < THRESHOLD).drop(name)
