"""Language identification by fusing evidence in Bayes' way.

* Text: byte trigrams, hashed, with the counts of all documents of a language; the evidence of a long text levels off,
  as its trigrams aren't independent.
* Markup: the language that a page declares, with the chance of each declaration in each language.
* Address: how the languages share the pages of a host, smoothed by its domain, that by its address suffix, that by all
  pages; a suffix that is a language's own code leans to it. A page's own text is left out of its host's counts.

Chances of declarations and shares of hosts come from grouped sums of the texts' posteriors, so pages need no labels.
Records may be pages (url, html) or plain texts, which have text evidence only.

Rules for odd input: null or empty text gives no text evidence; a page without usable url or declaration goes without
that evidence. Every language that a document is labelled with takes part; a language costs FEATURES numbers on each worker.
Rows that repeat count each. Other columns are ignored. An empty table gives an empty result; without labelled documents
the language is null.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farescope.llm.common import join_groups, saved, text_bytes

#: Hashed trigrams.
FEATURES = 1 << 14
#: Trigrams that a very long text is worth.
WORTH = 60.0
#: Pages that the next wider share counts for, at hosts, domains, suffixes.
SMOOTH = 5.0
#: Weight of a language whose code is the suffix, against an even share.
OWN_SUFFIX = 4.0
#: Thought declarations of each kind, and more of the right one.
DECLARED, RIGHT = 0.5, 5.0

_DROP = re.compile(rb"<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
_TAG = re.compile(rb"<[^>]*>")
_HTML = re.compile(rb"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})\b", re.I)
_META = re.compile(rb"<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?\s*([a-zA-Z]{2,3})\b", re.I)


def trigrams(text: bytes) -> np.ndarray:
    """Hashed trigrams of the lower-cased bytes of a text."""
    raw = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.int64)
    code = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
    return (code * np.uint32(2654435761) >> np.uint32(32 - 14)).astype(np.int64)


def page_text(page: bytes) -> bytes:
    """What a page shows, without markup."""
    shown = _TAG.sub(b" ", _DROP.sub(b" ", page))
    return html.unescape(shown.decode("utf-8", "replace")).encode() if b"&" in shown else shown


def declared(page: bytes) -> str | None:
    found = _HTML.search(page) or _META.search(page)
    return found[1].decode().lower() if found else None


def address(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Host, domain (its last two labels) and suffix (its last label) of a url."""
    try:
        host = (urlsplit(url).hostname or "") if url else ""
    except ValueError:
        host = ""
    labels = [x for x in host.removeprefix("www.").split(".") if x]
    return (".".join(labels), ".".join(labels[-2:]), labels[-1]) if labels else (None, None, None)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), text_bytes(batch.column("text"))):
            if lang not in counts:
                counts[lang] = np.zeros(FEATURES, np.int64)
            counts[lang] += np.bincount(trigrams(text), minlength=FEATURES)
    part = TaskContext.get().partitionId() % 64
    for lang, found in counts.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang], "part": [part], "counts": [found.tobytes()]})


def _add(group: pa.Table) -> pa.Table:
    total = np.zeros(FEATURES, np.int64)
    for blob in group.column("counts").to_pylist():
        total += np.frombuffer(blob, np.int64)
    return pa.table({"lang": group.column("lang")[:1], "part": pa.array([0], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and the log chances of the trigrams in each (FEATURES x languages), from all labelled documents."""
    rows = docs.where("lang IS NOT NULL AND lang <> ''").select("lang", "text")
    # One row per language.
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    kind = "lang string, part long, counts binary"
    counted = rows.mapInArrow(_count, kind) if langs else None
    found = counted.groupBy("lang", "part").applyInArrow(_add, kind).groupBy("lang").applyInArrow(_add, kind).collect() if langs else []
    table = {r["lang"]: np.frombuffer(r["counts"], np.int64) + 0.5 for r in found}
    return langs, np.stack([np.log(table[k] / table[k].sum()) for k in langs], axis=1) if langs else np.zeros((FEATURES, 0))


READ = "kind string, id long, host string, domain string, suffix string, declared string, evidence array<double>"


def _read(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            rows = []
            for kind, url, body in zip(batch.column("kind").to_pylist(), batch.column("url").to_pylist(), text_bytes(batch.column("body"))):
                page = kind == "page"
                found = trigrams(page_text(body) if page else body)
                evidence = table[found].sum(axis=0) / max(len(found), 1) * (len(found) / (1 + len(found) / WORTH))
                rows.append((*(address(url) if page else (None,) * 3), declared(body) if page else None, evidence.tolist()))
            host, domain, suffix, said, evidence = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("kind"), batch.column("id"), *(pa.array(x, pa.string()) for x in (host, domain, suffix, said)), pa.array(evidence, pa.list_(pa.float64()))],
                ["kind", "id", "host", "domain", "suffix", "declared", "evidence"])

    return work


def softmax(logs: Column) -> Column:
    shifted = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per page and per document: kind, page_id, doc_id, lang, posterior, text_lang, declared, host, host_share.

    `pages` has page_id, url and html; `docs` has doc_id, text, lang, and is what the texts' languages are learned from.
    """
    spark = pages.sparkSession
    langs, table = train(docs)
    if not langs:
        empty = [F.lit(None).cast(t).alias(n) for n, t in (("lang", "string"), ("posterior", "double"), ("text_lang", "string"), ("declared", "string"), ("host", "string"), ("host_share", "double"))]
        return pages.select(F.lit("page").alias("kind"), F.col("page_id").cast("bigint"), F.lit(None).cast("bigint").alias("doc_id"), *empty).unionByName(
            docs.select(F.lit("document").alias("kind"), F.lit(None).cast("bigint").alias("page_id"), F.col("doc_id").cast("bigint"), *empty))
    k = range(len(langs))
    names = F.array(*map(F.lit, langs))
    records = pages.select(F.lit("page").alias("kind"), F.col("page_id").cast("bigint").alias("id"), "url", F.col("html").alias("body")).unionByName(
        docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("bigint").alias("id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("body")))
    read = records.mapInArrow(_read(spark.sparkContext.broadcast(table)), READ)
    known = F.when(F.col("declared").isNull(), "none").when(F.col("declared").isin(langs), F.col("declared")).otherwise("other")
    rows = saved(read.withColumn("p", softmax(F.col("evidence"))).withColumn("said", F.when(F.col("kind") == "page", known)), "evidence")
    total = rows.count()

    sums = [F.sum(F.get("p", F.lit(i))).alias(f"s{i}") for i in k]
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in k]
    paged = rows.where("kind = 'page'")
    # Declarations: as many rows as there are languages, and two.
    said = {r["said"]: [r[f"s{i}"] for i in k] for r in paged.groupBy("said").agg(*sums).collect()}
    kinds = [*langs, "other", "none"]
    thought = [[DECLARED + RIGHT * (kind == lang) + (said[kind][i] if kind in said else 0.0) for i, lang in enumerate(langs)] for kind in kinds]
    column = [sum(row[i] for row in thought) for i in k]
    chances = F.create_map(*[x for kind, row in zip(kinds, thought) for x in (F.lit(kind), F.array(*[F.lit(float(np.log(row[i] / column[i]))) for i in k]))])

    # Shares: hosts, smoothed by domains, by suffixes, by all pages.
    hosts = saved(paged.where("host IS NOT NULL").groupBy("suffix", "domain", "host").agg(*sums, F.count("*").alias("n")), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(*again, F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(*again, F.sum("n").alias("n"))
    whole = paged.agg(*sums).first()
    every = sum(whole[f"s{i}"] or 0.0 for i in k)
    usual = [((whole[f"s{i}"] or 0.0) + 1) / (every + len(langs)) for i in k]
    lean = [F.when(F.lower("suffix") == lang, OWN_SUFFIX).otherwise(1.0) * usual[i] for i, lang in enumerate(langs)]
    all_lean = sum(lean[1:], lean[0])
    smooth = lambda i, wider, n="n", s=None: ((s if s is not None else F.col(f"s{i}")) + SMOOTH * wider) / (F.col(n) + SMOOTH)
    suffix_share = suffixes.select("suffix", *[smooth(i, lean[i] / all_lean).alias(f"w{i}") for i in k])
    domain_share = domains.join(suffix_share, "suffix").select("domain", *[smooth(i, F.col(f"w{i}")).alias(f"w{i}") for i in k])
    host_share = hosts.join(domain_share, "domain").select("host", "n", F.array(*[F.col(f"s{i}") for i in k]).alias("s"), F.array(*[F.col(f"w{i}") for i in k]).alias("w"))

    joined = join_groups(rows, host_share, ["host"], "n", total)
    # Own evidence is left out of the host's; a domain's few pages still hold it, with little weight.
    shares = F.when(F.col("s").isNull(), F.array(*map(F.lit, usual))).otherwise(F.transform(
        F.sequence(F.lit(0), F.lit(len(langs) - 1)),
        lambda i: (F.greatest(F.get("s", i) - F.get("p", i), F.lit(0.0)) + SMOOTH * F.get("w", i)) / (F.col("n") - 1 + SMOOTH)))
    markup = F.coalesce(F.try_element_at(chances, F.col("said")), F.array(*[F.lit(0.0)] * len(langs)))
    fused = F.transform(F.sequence(F.lit(0), F.lit(len(langs) - 1)), lambda i: F.get("evidence", i) + F.get("markup", i) + F.log(F.get("shares", i)))
    out = joined.withColumn("shares", shares).withColumn("markup", markup).withColumn("post", softmax(fused))
    best = lambda p: F.array_position(F.col(p), F.array_max(p)).cast("int") - 1
    page = F.col("kind") == "page"
    return out.select(
        "kind", F.when(page, F.col("id")).alias("page_id"), F.when(~page, F.col("id")).alias("doc_id"), F.get(names, best("post")).alias("lang"),
        F.array_max("post").alias("posterior"), F.get(names, best("p")).alias("text_lang"), "declared", "host", F.get("shares", best("post")).alias("host_share"))
