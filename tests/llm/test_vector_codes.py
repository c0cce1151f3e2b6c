import hashlib
import math
import random

import numpy as np
import pytest

from farescope.llm import vector_codes


def plain(rows, count=16, entries=64, rounds=2):
    """All parts against all entries in whole numbers."""
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-(1 << 24), min(1 << 24, math.floor(256 * x))) for x in v], label))
    width = count * max(1, -(-max((len(v) for _, v, _ in kept), default=0) // count))
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    step = width // count
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * step : (p + 1) * step] for _, v, _ in first] for p in range(count)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(count):
            groups = {}
            for _, v, _ in kept:
                x = v[p * step : (p + 1) * step]
                groups.setdefault(near(x, books[p])[1], []).append(x)
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    text = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, errors = [], {}
    for i, v, label in kept:
        found = [near(v[p * step : (p + 1) * step], books[p]) for p in range(count)]
        error = sum(d for d, _ in found)
        errors[label] = errors.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    return sorted(((i, code, error, errors[label], text) for i, code, error, label in out), key=repr)


@pytest.fixture
def make_vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, code string")

    return make


def vectors(n, width, seed=0, spread=1.0):
    r = random.Random(seed)
    return [(i, [float(np.float32(r.gauss(0, spread))) for _ in range(width)], r.choice([1, 2, None])) for i in range(n)]


def run(make_vectors, rows, **options):
    return sorted((tuple(r) for r in vector_codes.codes(make_vectors(rows), **options).collect()), key=repr)


def test_codes_equal_plain_version(make_vectors, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 100)
    rows = vectors(300, 32, spread=0.05)
    # A hot vector, rows that repeat, ids that repeat or are missing, rows that are dropped.
    rows += [(1000 + k, rows[3][1], 1) for k in range(200)] + [rows[5], (7, rows[8][1], 2), (None, rows[9][1], None), (None, rows[10][1], 5)]
    rows += [(2000, None, 1), (2001, [0.0] * 31 + [None], 1), (2002, [0.0] * 31 + [math.nan], 1), (2003, [math.inf] + [0.0] * 31, 2), (2004, [1e30, -1e30] * 16, 3)]
    got = run(make_vectors, rows)
    assert got == plain(rows) and len(got) == len(rows) - 4


@pytest.mark.parametrize(("width", "count", "entries", "rounds"), [(10, 4, 8, 3), (8, 2, 300, 1), (3, 16, 64, 2), (64, 16, 64, 0)])
def test_other_shapes(make_vectors, width, count, entries, rounds):
    rows = vectors(320, width, seed=width)
    got = run(make_vectors, rows, count=count, entries=entries, rounds=rounds)
    want = plain(rows, count, entries, rounds)
    if entries > 256:
        assert {(g[0], *g[2:]) for g in got} == {(w[0], *w[2:]) for w in want} and all(len(g[1]) == 4 * count for g in got)
    else:
        assert got == want


def test_few_rows_short_rows_and_no_rows(make_vectors):
    assert run(make_vectors, []) == []
    assert run(make_vectors, [(1, None, 1)]) == []
    rows = [(3, [], 1), (1, [], 1)]
    assert run(make_vectors, rows) == plain(rows)
    rows = vectors(5, 16) + [(9, [1.0, 2.0], 1), (10, [], None)]
    assert run(make_vectors, rows) == plain(rows)


@pytest.mark.parametrize("spread", [2, 40, 4000])
@pytest.mark.parametrize("dims", [1, 4, 9])
def test_cover_tree(spread, dims):
    r = np.random.default_rng(spread + dims)
    rows = np.concatenate((r.normal(0, spread, (600, dims)), r.normal(spread * 30, spread, (300, dims)), np.zeros((50, dims)))).astype(np.int32)
    tree = vector_codes.CoverTree.build(rows)
    assert (tree.points[tree.place] == rows).all() and tree.counts.sum() == len(rows)
    for k in range(len(tree.center)):
        points = tree.points[tree.low[k] : tree.high[k]].astype(np.int64)
        far = ((points - tree.points[tree.center[k]]) ** 2).sum(axis=1)
        assert far.max() == tree.radius2[k]
        children = range(tree.child[k], tree.child_end[k])
        if len(children):
            # Nested, covering and separated, and the children share the stretch.
            assert tree.center[children[0]] == tree.center[k]
            assert [tree.low[c] for c in children] + [tree.high[k]] == [tree.low[k]] + [tree.high[c] for c in children]
            centers = tree.points[tree.center[list(children)]].astype(np.int64)
            apart = ((centers[:, None] - centers[None]) ** 2).sum(axis=2)[~np.eye(len(centers), dtype=bool)]
            assert not len(apart) or apart.min() * 4 > tree.radius2[k]
            assert max(tree.radius2[c] for c in children) * 4 <= tree.radius2[k]
    book = rows[r.choice(len(rows), 20)].astype(np.int64)
    chosen, sums, compared = tree.assign(book)
    gap = ((rows[:, None].astype(np.int64) - book[None]) ** 2).sum(axis=2)
    want = gap.argmin(axis=1)
    assert (chosen[tree.place] == want).all()
    assert all((sums[k, :-1] == rows[want == k].sum(axis=0)).all() and sums[k, -1] == (want == k).sum() for k in range(20))


def test_far_clusters_are_assigned_as_subtrees():
    r = np.random.default_rng(5)
    centers = r.integers(-100_000, 100_000, (8, 4))
    rows = (centers[r.integers(0, 8, 20_000)] + r.integers(-20, 20, (20_000, 4))).astype(np.int32)
    tree = vector_codes.CoverTree.build(rows)
    chosen, _, compared = tree.assign(centers.astype(np.int64))
    assert compared < len(rows) / 50
    assert (chosen[tree.place] == ((rows[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
