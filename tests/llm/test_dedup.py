import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from shared import ODD, words
from farescope.llm import exact_dedup, near_dedup
from farescope.llm.common import components, maybe_in


def plain_exact(rows):
    norm = [re.sub(rb"[\x20\x09-\x0D]+", b" ", (t or "").encode()) for _, t in rows]
    least, size = {}, Counter(norm)
    for (i, _), t in zip(rows, norm):
        least[t] = min(least.get(t, 1 << 70), 1 << 69 if i is None else i)
    return Counter((i, None if least[t] == 1 << 69 else least[t], size[t], hashlib.sha256(t).hexdigest()) for (i, _), t in zip(rows, norm))


@pytest.mark.parametrize("rows", [ODD, [], [(k, f"a {k % 3}") for k in range(300)]], ids=["odd", "empty", "hot"])
def test_exact_groups(make_docs, monkeypatch, rows):
    monkeypatch.setattr(exact_dedup, "RANGE_ROWS", 5)
    got = exact_dedup.exact_duplicates(make_docs(rows).repartition(20)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == plain_exact(rows)
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({r.text_sha256 for r in got})


def test_exact_keeps_rows_and_columns(make_docs):
    docs = make_docs(ODD)
    left = exact_dedup.without_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [1, 3, 4, 5, 7, 9, 10, 11, 12]


def test_merge_verifies_equal_digests():
    run = np.zeros(4, exact_dedup.ENTRY)
    run["digest"], run["check"], run["least"], run["n"] = [b"a" * 32, b"a" * 32, b"b" * 32, b"a" * 32], [1, 2, 1, 1], [5, 4, 3, 2], [1, 1, 1, 2]
    out = exact_dedup.merged([run[:2], run[2:3], run[3:]])
    assert [(x["digest"], x["check"], x["least"], x["n"]) for x in out] == [(b"a" * 32, 1, 2, 3), (b"a" * 32, 2, 4, 1), (b"b" * 32, 1, 3, 1)]


def test_multiway_merge_of_sorted_runs(monkeypatch):
    """Any number of runs; only their order is used, nothing is sorted again."""
    r = np.random.default_rng(2)
    rows = np.zeros(4000, exact_dedup.ENTRY)
    rows["digest"] = [bytes([x]) * 31 + b"\0" for x in r.integers(0, 40, 4000)]
    rows["check"], rows["size"] = r.integers(-3, 3, 4000), r.integers(0, 3, 4000)
    rows["least"], rows["n"] = r.integers(0, 10**6, 4000), r.integers(1, 4, 4000)
    cuts = np.sort(r.integers(0, 4000, 8))
    runs = [exact_dedup.sorted_run(part) for part in np.split(rows, cuts)]
    want = {}
    for digest, check, size, least, n in rows.tolist():
        old = want.get((digest, check, size), (least, 0))
        want[digest, check, size] = (min(old[0], least), old[1] + n)
    for name in ("sort", "argsort", "lexsort"):
        monkeypatch.setattr(np, name, None)
    got = exact_dedup.merged(runs)
    monkeypatch.undo()
    assert {(d, c, s): (least, n) for d, c, s, least, n in got.tolist()} == want and len(got) == len(want)
    assert [x[:3] for x in got.tolist()] == sorted(want, key=lambda k: (k[0].ljust(32, b"\0"), k[1], k[2]))
    assert len(exact_dedup.merged([])) == 0 and (exact_dedup.merged([runs[3]]) == runs[3]).all()


def plain_near(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


def variants(seed, n):
    """Near copies of one text, some further away than others, and texts that share a passage."""
    r = random.Random(seed)
    base = words(seed, 120).split()
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(r.randint(0, 6)):
            own[r.randrange(len(own))] = words(r.random() * 1e9, 1)
        out.append(" ".join(own))
    return out + [words(seed + k, 40) + " " + " ".join(base[:30]) for k in range(1, 15)]


@pytest.mark.parametrize("block", [1024, 8], ids=["whole", "blocks"])
def test_near_components(make_docs, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "LIST_BLOCK", block)
    monkeypatch.setattr(near_dedup, "SHORT", 4)
    monkeypatch.setattr(near_dedup, "GROUP_BLOCK", 400_000 if block > 100 else 1500)
    rows = [(k, t) for k, t in enumerate(t for s in range(4) for t in variants(100 * s, 40))]
    rows += [(5000, None), (5001, " "), (5002, "short one"), (5003, "Short  ONE"), (5004, words(9, 20_000)), (5005, words(9, 20_000) + " z")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(make_docs(rows)).collect()}
    assert got == plain_near(rows)


def test_near_odd_rows(make_docs):
    got = near_dedup.near_duplicates(make_docs(ODD)).collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: r for r in got}
    assert by_id[5].component_id == 5 and by_id[6].component_id == 5 and by_id[8].component_id == 7
    assert not by_id[8].kept and by_id[1].kept and by_id[2].n_shingles == 0
    assert near_dedup.near_duplicates(make_docs([])).count() == 0
    left = near_dedup.without_near_copies(make_docs(ODD))
    assert {r.doc_id for r in left.collect()} >= {1, 2, 3, 4, 5, 7, None}


def test_components_of_a_chain(spark):
    edges = spark.range(1, 200).selectExpr("id AS a", "id - 1 AS b").unionAll(spark.sql("SELECT 500L AS a, 500L AS b")).unionAll(
        spark.sql("SELECT 901L AS a, 900L AS b"))
    got = {(r.id, r.root) for r in components(edges, "test").collect()}
    assert got == {(k, 0) for k in range(200)} | {(900, 900), (901, 900)}


def test_near_threshold_is_a_parameter(make_docs):
    rows = [(k, t) for k, t in enumerate(variants(7, 60))]
    found = {p: {(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(make_docs(rows), p).collect()} for p in (80, 85, 95)}
    assert all(found[p] == plain_near(rows, p) for p in found)
    assert len({c for _, _, c in found[80]}) < len({c for _, _, c in found[95]})
    assert [near_dedup.matches(p) for p in (80, 85, 100)] == [36, 40, 64]


def test_each_text_of_an_id_is_linked_by_itself(make_docs):
    one, two = words(1, 80), words(2, 80)
    rows = [(1, one), (2, two), (5, one + " x"), (5, two + " y"), (5, words(3, 80)), (5, one + " x"), (9, two), (None, one + " x"), (None, None)]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dedup.near_duplicates(make_docs(rows)).collect())
    assert got == sorted([("1", "1", True), ("2", "2", True), ("5", "1", False), ("5", "1", False), ("5", "2", False), ("5", "5", True), ("9", "2", False),
                          ("None", "1", False), ("None", "None", True)])
    left = near_dedup.without_near_copies(make_docs(rows).withColumnRenamed("kept", "gone_id").withColumnRenamed("score", "gone_key"))
    assert {(r.doc_id, r.text) for r in left.collect()} >= {(1, one), (2, two), (5, words(3, 80))}
    assert not {(r.doc_id, r.text) for r in left.collect()} & {(5, one + " x"), (5, two + " y"), (9, two)}


def test_only_wanted_rows_go_on_to_the_join(spark):
    rows = spark.range(20_000).selectExpr("id AS a", "if(id % 3 = 0, NULL, id * 7) AS b", "'t' AS text")
    wanted = rows.where("a % 100 = 0").select("a", "b")
    kept = maybe_in(rows, wanted, ["a", "b"])
    assert kept.columns == rows.columns
    assert {r.a for r in kept.collect()} >= set(range(0, 20_000, 100)) and kept.count() < 220
    assert maybe_in(rows, wanted.where("false"), ["a", "b"]).count() == 0


def test_copies_cost_rows_in_proportion(spark):
    """Blocks get the leader, not each other's rows; what lies open goes to the other blocks."""
    from pyspark.sql import functions as F

    rows = spark.range(1000).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("leader"), F.lit(10).cast("long").alias("blocks"))
    assert near_dedup.in_blocks(rows, "leader").count() == 1009
    left = near_dedup.open_blocks(rows.withColumn("rest", F.col("node") < 3))
    assert left.count() == 1000 + 3 * 9 and left.where("own").count() == 1000


@pytest.mark.parametrize("parts", [1, 8])
def test_components_of_random_links(spark, parts):
    r = random.Random(parts)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000, 1000 + k) for k in range(1, 3000)] + [(3999, 7), (5000, -4)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {(x, find(x)) for a, b in links if a != b for x in (a, b)}
    got = {(x.id, x.root) for x in components(spark.createDataFrame(links, "a long, b long").repartition(parts), "random").collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), "none").count() == 0


@pytest.mark.parametrize("full_sets", [False, True])
def test_second_pass_gives_a_spanning_forest(full_sets):
    """Open members that are all alike are tied to a block with as many links as they are, not with all pairs."""
    n, text = 40, " ".join(f"w{i}" for i in range(30))
    own, rest = [i < n for i in range(2 * n)], [i % 2 == 1 or i >= n for i in range(2 * n)]
    numbers = list(range(0, 2 * n, 2)) + list(range(1, 2 * n, 2))
    table = {"root" if full_sets else "pair": pa.array([7] * 2 * n, pa.int64()), "block": pa.array([0] * 2 * n, pa.int64()),
             "node": pa.array(numbers, pa.int64()), "own": pa.array(own), "rest": pa.array(rest)}
    if full_sets:
        table["text"] = pa.array([text] * 2 * n)
    else:
        table["sign"] = pa.array([bytes(2 * near_dedup.COORDINATES)] * 2 * n)
    work = near_dedup._confirm_rest(85) if full_sets else near_dedup._collide_rest(40)
    links = [(r["a"], r["b"]) for b in work(iter([pa.RecordBatch.from_pydict(table)])) for r in b.to_pylist()]
    assert len(links) <= sum(rest)
    led = [(numbers[0], x) for x, o, r in zip(numbers, own, rest) if o and not r]
    part = {x: x for x in numbers}
    for _ in numbers:
        for a, b in links + led:
            part[a] = part[b] = min(part[a], part[b])
    assert len(set(part.values())) == 1
