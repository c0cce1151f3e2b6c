"""Mixing documents to target weights of domains, with soft membership.

A naive-Bayes classifier, trained on the table of labels, gives every document a posterior over the domains: `toxic`,
`high` and `low` quality. A document then has a nonnegative rate, its expected number of copies. Projected gradient
steps fit the rates so that the expected tokens of each domain, the sum of rate * tokens * posterior, match the targets
in least squares of relative errors. A step is one aggregate over a compact table, whose few sums give the next
gradient; a document's rate follows from the list of gradients by a fold. Relative errors in a metric weighted by tokens
have curvature 1 at most (rows of the Gram matrix over domain shares sum to 1), so whole steps with momentum converge.

Everything is DataFrame or SQL functions. At most `sample` labelled rows train, evenly thinned by hashed id; posteriors,
sums and rates cover all rows.

Rules for odd input: a null text is empty, has no tokens, and its posterior is the prior. Label rows with a null id or
label are ignored; of repeated labels toxic and low quality count. Rows that repeat have equal rates. A domain without
expected tokens cannot be met and is left out, the others keep their proportions. Without labels all posteriors are
even. Texts under one id go with the larger number of their copies. Other columns are ignored by `rates` and kept by `mixed`. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farescope.llm.common import SPACES, free_name, saved

DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.80, "low": 0.15, "toxic": 0.05}
#: Labelled rows that train at most.
SAMPLE = 20_000
#: Hashed features of a word: all of it, its first five characters, its last two.
WORDS, STEMS, ENDS = 8192, 4096, 1024
#: Occurrences that each domain is thought to have besides, dealt out as in all domains together.
PRIOR = 3000.0
#: Log ratios count as none unless the occurrences differ from the usual share by so many standard errors.
ERRORS = 4.0
#: Candidate scales of the evidence, chosen by log loss over the training rows, and the lead it approaches at most.
SCALES = (0.2, 0.4, 0.6, 0.8, 1.0, 1.5)
LEAD = 10.0
#: Largest relative error of a domain's tokens that ends the steps, and steps without a smaller error that end them too.
CLOSE, STEPS = 1e-4, 60
#: Steps after which rates are stored.
STORE = 4


def words(text: str = "text") -> Column:
    """Lower-cased words in order."""
    bare = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def features(w: Column) -> list[Column]:
    """Numbers of the features of a word."""
    number = lambda x, n, first: (F.pmod(F.xxhash64(x), F.lit(n)) + first).cast("int")
    return [number(w, WORDS, 0), number(F.left(w, F.lit(5)), STEMS, WORDS), number(F.right(w, F.lit(2)), ENDS, WORDS + STEMS)]


def _array(values: list[float]) -> Column:
    """A constant array; one text literal that is folded once."""
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Labelled rows: row number, words, domain number."""
    domain = F.when(F.max("toxic") > 0, 2).when(F.min("quality") > 0, 0).otherwise(1)
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL AND quality IS NOT NULL").groupBy(
        F.col("doc_id").cast("bigint").alias("doc_id")).agg(domain.alias("domain"))
    total = marks.count()
    if total > sample:
        marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    # At most `sample` narrow rows of fixed width.
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), words().alias("words")).join(F.broadcast(marks), "doc_id").select(
        F.monotonically_increasing_id().alias("row"), "words", "domain")


class Classifier:
    """Log weights of all features, priors, and the scale of the evidence, from rows of words and domain."""

    def __init__(self, rows: DataFrame):
        k, n = range(len(DOMAINS)), WORDS + STEMS + ENDS
        rows = rows.persist()
        found = rows.select("domain", F.explode("words").alias("w")).select("domain", F.explode(F.array(*features(F.col("w")))).alias("f"))
        counts = {(r["domain"], r["f"]): r["n"] for r in found.groupBy("domain", "f").agg(F.count("*").alias("n")).collect()}
        docs = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
        every = [sum(counts.get((d, f), 0) for d in k) for f in range(n)]
        usual = [(x + 1) / (sum(every) + n) for x in every]
        logs = []
        for d in k:
            own = [counts.get((d, f), 0) for f in range(n)]
            total = sum(own)
            logs.append([math.log((x + PRIOR * q) / (total + PRIOR) / q) if abs(x - total * q) >= ERRORS * math.sqrt(total * q + 1) else 0.0
                         for x, q in zip(own, usual)])
        #: Weights against the first domain.
        self.weights = [[x - y for x, y in zip(logs[d], logs[0])] for d in k[1:]]
        self.prior = [math.log((docs.get(d, 0) + 1) / (sum(docs.values()) + len(k))) for d in k]
        self.scale = 1.0
        if docs:
            known = self.evidence(rows, ["row", "domain"])
            losses = known.agg(*[F.avg(-F.log(F.greatest(F.get(self.posterior(x), F.col("domain")), F.lit(1e-9)))).alias(f"l{i}")
                                 for i, x in enumerate(SCALES)]).first()
            self.scale = min(zip(losses, SCALES))[1]
        rows.unpersist()

    def evidence(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Per row the keys, n_tokens, and the summed weights of its words by domain but the first (e_low, e_toxic).

        Words are spread out and summed again in their own task, in generated code; what is shuffled is one line a row.
        """
        spread = rows.select(*keys, F.explode_outer("words").alias("w"))
        parts = features(F.col("w"))
        sums = [F.coalesce(F.sum(sum((F.get(_array(t), f) for f in parts[1:]), F.get(_array(t), parts[0]))), F.lit(0.0)).alias(f"e_{name}")
                for name, t in zip(DOMAINS[1:], self.weights)]
        return spread.groupBy(*keys).agg(F.count("w").alias("n_tokens"), *sums)

    def posterior(self, scale: float | None = None) -> Column:
        """Chances of the domains. A domain falls behind the best one by LEAD at most, so no text is all too certain."""
        sums = [F.lit(0.0), *[F.col(f"e_{name}") for name in DOMAINS[1:]]]
        best = F.greatest(*sums)
        behind = [(best - x) / (1 + (best - x) / LEAD) for x in sums]
        shares = [F.exp(F.lit(p) - (scale or self.scale) * x) for p, x in zip(self.prior, behind)]
        total = sum(shares[1:], shares[0])
        return F.array(*[x / total for x in shares])


def memberships(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, n_tokens, p (posterior of each domain)."""
    classifier = Classifier(training_rows(docs, labels, sample))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), words().alias("words"))
    return classifier.evidence(rows, ["row", "doc_id"]).select("doc_id", "n_tokens", classifier.posterior().alias("p"))


def stepped(soft: DataFrame, steps: list[list[float]]) -> DataFrame:
    """Rates r and points ahead y after more projected steps, each with its momentum and gradient."""
    if not steps:
        return soft
    numbers = F.array(*[F.array(*map(F.lit, s)) for s in steps])
    p = [F.get("p", F.lit(k)) for k in range(len(DOMAINS))]

    def step(now: Column, s: Column) -> Column:
        slope = sum((p[k] * s[k + 1] for k in range(1, len(DOMAINS))), p[0] * s[1])
        new = F.greatest(now["y"] - slope, F.lit(0.0))
        return F.struct(new.alias("r"), (new + s[0] * (new - now["r"])).alias("y"))

    return soft.withColumn("__s", F.aggregate(numbers, F.struct("r", "y"), step)).withColumns({"r": F.col("__s.r"), "y": F.col("__s.y")}).drop("__s")


def fitted(soft: DataFrame, targets: dict[str, float], tokens: float | None = None) -> tuple[DataFrame, dict[str, float]]:
    """A stored table of memberships with its rates r, and the expected share of each domain.

    `targets` are weights of domains; a domain without one goes along as it falls out. `tokens` is the wanted total (by
    default as many as there are). Rates are stored anew every STORE steps, so that a step has few steps to repeat.
    """
    k = range(len(DOMAINS))
    mass = [F.col("n_tokens") * F.get("p", F.lit(d)) for d in k]
    now = soft.agg(*[F.coalesce(F.sum(m), F.lit(0.0)).alias(DOMAINS[d]) for d, m in zip(k, mass)]).first()
    total = sum(now)
    met = [d for d in k if DOMAINS[d] in targets and now[d] > 1e-9 * total and total > 0]
    weight = sum(targets[DOMAINS[d]] for d in met)
    if not met or weight <= 0:
        return soft.withColumn("r", F.lit(1.0)), dict.fromkeys(DOMAINS, 0.0)
    wanted = {d: (tokens or total) * targets[DOMAINS[d]] / weight for d in met}
    start = F.lit((tokens or total) / total)
    base, steps, done, best, since = soft.withColumns({"r": start, "y": start}), [], 0, math.inf, 0
    while True:
        rated = stepped(base, steps)
        sums = rated.agg(*[F.sum(m * F.col(x)).alias(f"{x}{d}") for x in ("r", "y") for d, m in zip(k, mass)]).first()
        off = max(abs(sums[f"r{d}"] - wanted[d]) / max(wanted[d], 1e-3 * total) for d in met)
        # Targets may be out of reach; then the error stops falling, by a hundredth at least, at what can be reached.
        best, since = (off, 0) if off < 0.99 * best else (best, since + 1)
        if off < CLOSE or since >= STEPS:
            share = sum(sums[f"r{d}"] for d in k)
            return rated.drop("y"), {DOMAINS[d]: sums[f"r{d}"] / share if share else 0.0 for d in k}
        if len(steps) == STORE:
            base, steps = saved(rated, "rates"), []
        steps.append([done / (done + 3.0), *[(sums[f"y{d}"] - wanted[d]) / now[d] if d in met else 0.0 for d in k]])
        done += 1


def copies(value: Column, doc_id: str = "doc_id") -> Column:
    """Whole copies with the rate as mean: the whole part, and one more where a hash of the id falls below the rest."""
    u = F.pmod(F.xxhash64(F.col(doc_id), F.lit(17)), F.lit(1 << 20)) / (1 << 20)
    return (F.floor(value) + F.when(u < value - F.floor(value), 1).otherwise(0)).cast("bigint")


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, n_tokens, p_high, p_low, p_toxic, rate, copies, and the same in all rows: the reached share
    of the expected tokens of each domain and its target, as reached_high, target_high and so on."""
    wanted = targets or TARGETS
    rated, reached = fitted(saved(memberships(docs, labels, sample), "memberships"), wanted)
    total = sum(wanted.values()) or 1.0
    shown = {f"{kind}_{name}": F.lit(float(value)) for name in DOMAINS for kind, value in (("reached", reached[name]), ("target", wanted.get(name, 0.0) / total))}
    return rated.select("doc_id", "n_tokens", *[F.get("p", F.lit(d)).alias(f"p_{name}") for d, name in enumerate(DOMAINS)], F.col("r").alias("rate")).withColumn(
        "copies", copies(F.col("rate"))).withColumns(shown)


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, sample: int = SAMPLE) -> DataFrame:
    """The rows of a table, each as often as its copies say, with all their columns."""
    key, number, one = (free_name(docs, n) for n in ("mix_id", "mix_copies", "mix_copy"))
    found = rates(docs, labels, targets, sample).select(F.col("doc_id").alias(key), "copies").groupBy(key).agg(F.max("copies").alias(number))
    rows = docs.join(found, docs["doc_id"].cast("bigint").eqNullSafe(found[key]), "inner")
    return rows.withColumn(one, F.explode(F.array_repeat(F.lit(1), F.col(number).cast("int")))).drop(key, number, one)
