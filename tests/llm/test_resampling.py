import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from shared import ODD, words
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from farescope.llm import resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TARGET = [(1, "ab cd ef gh ij ab ab"), (2, None), (3, "ÀB. cd-ef"), (3, words(2, 30))]


def plain_features(text, runs):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(found), [" ".join(found[i : i + k]) for k in range(1, runs + 1) for i in range(len(found) - k + 1)]


def plain_draw(rows, target, runs=1, buckets=10_000, least=20, percent=10):
    name = lambda f: zlib.crc32(f.encode()) % buckets
    features = [(i, *plain_features(t, runs)) for i, t in rows]
    source, wanted = [0] * buckets, [0] * buckets
    for _, _, found in features:
        for f in found:
            source[name(f)] += 1
    for _, t in target:
        for f in plain_features(t, runs)[1]:
            wanted[name(f)] += 1
    big, small = sum(source), sum(wanted)
    gain = [math.floor(1000 * math.log((t + 1) * (big + buckets) / ((s + 1) * (small + buckets)))) for s, t in zip(source, wanted)]
    out = []
    for i, n, found in features:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[name(f)] for f in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fits = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, r in enumerate(fits[: len(fits) * percent // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize(("runs", "buckets", "percent"), [(1, 10_000, 10), (3, 97, 50), (2, 10_000, 100)])
def test_draw_equals_plain_version(make_docs, spark, runs, buckets, percent):
    rows = ODD + [(100 + k, words(k, 15 + k)) for k in range(60)] + [(300, "Ab,CD\tEF" * 30), (300, "Ab,CD\tEF" * 30), (301, words(3, 40).upper())]
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    got = resampling.draw(make_docs(rows), target, runs=runs, buckets=buckets, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_draw(rows, TARGET, runs, buckets, percent=percent)


@pytest.mark.parametrize("runs", [1, 2, 3])
@pytest.mark.parametrize("size", [1, 7, 50, 1 << 20])
def test_pieces_of_long_texts_lose_no_run(runs, size):
    split = Split(Regex(resampling.WORD), "removed", invert=True)
    for text in (words(1, 120), "", "x" * 200, "a  b\n\nc" * 20, "é日本 " * 9):
        n, features, names, counts = resampling.histogram(text, split, resampling.Buckets(50), runs, size)
        want_n, want = plain_features(text, runs)
        plain = np.bincount([zlib.crc32(f.encode()) % 50 for f in want], minlength=50)
        assert (n, features) == (want_n, len(want))
        assert names.tolist() == np.flatnonzero(plain).tolist() and counts.tolist() == plain[plain > 0].tolist()


def test_draw_prefers_target_words(make_docs, spark):
    like = [(k, " ".join(["fare", "tax", "seat", "route"][j % 4] + words(k * 100 + j, 1) * (j % 2) for j in range(40))) for k in range(100)]
    other = [(1000 + k, words(k, 40)) for k in range(900)]
    target = spark.createDataFrame([(1, "fare tax seat route " * 200)], "item_id long, text string")
    got = [r for r in resampling.draw(make_docs(like + other), target).collect() if r["rank"]]
    assert sorted(r["rank"] for r in got) == list(range(1, 101))
    assert sum(r.doc_id < 100 for r in got) >= 95


def test_draw_of_empty_tables(make_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.draw(make_docs([]), none).count() == 0
    got = resampling.draw(make_docs(ODD), none).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_draw(ODD, [])


def test_numbers_of_many_ranges(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select((F.col("id") % 70).alias("a"), "id")
    got = resampling.numbered(rows, [F.col("a").desc(), F.col("id").asc()]).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == sorted(range(5000), key=lambda i: (-(i % 70), i))
    assert sorted(r["place"] for r in got) == list(range(1, 5001))
