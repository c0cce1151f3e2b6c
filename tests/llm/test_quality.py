import random
import zlib

import numpy as np
import pytest
from shared import ODD, words

from farescope.llm import quality


def labelled(n=500):
    """Texts of which every third is junk of one of three kinds, and their labels."""
    rows, marks = [], []
    for k in range(n):
        r = random.Random(k)
        text = words(k, r.randint(20, 80)).split()
        if k % 3 == 0:
            text = [[w + r.choice(["%%%", "***"]) for w in text], [w.upper() + "!!" for w in text], [w for w in text for _ in range(3)]][k // 3 % 3]
        rows.append((k, " ".join(text)))
        marks.append((k, int(k % 3 != 0), k % 2))
    return rows, marks


@pytest.fixture
def make_labels(spark):
    return lambda marks: spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def is_held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def test_quality_on_held_out_rows(make_docs, make_labels):
    rows, marks = labelled()
    got = quality.scores(make_docs(rows + ODD[:4]), make_labels(marks + [(None, 0, 0), (4, None, 0)])).collect()
    assert len(got) == 504 and all(0 < r.score < 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.doc_id for r in got if r.held_out} == {i for i in range(500) if is_held(i)}
    good = {i for i, q, _ in marks if q}
    held = [r for r in got if r.held_out and r.doc_id > 4]
    assert sum(r.predicted != (r.doc_id in good) for r in held) <= 0.03 * len(held)


def test_quality_labels_of_held_out_rows_have_no_effect(make_docs, make_labels):
    rows, marks = labelled(150)
    other = [(i, 1 - q if is_held(i) else q, 1 - t) for i, q, t in marks]
    a, b = ({r.doc_id: r.score for r in quality.scores(make_docs(rows), make_labels(m)).collect()} for m in (marks, other))
    assert a == pytest.approx(b, abs=1e-9)


def test_quality_without_labels_and_rows(make_docs, make_labels):
    got = quality.scores(make_docs(ODD), make_labels([])).collect()
    assert len(got) == len(ODD) and {r.score for r in got} == {0.5}
    assert quality.scores(make_docs([]), make_labels([(1, 1, 1), (3, 0, 0)])).count() == 0
    few = quality.scores(make_docs(ODD), make_labels([(4, 1, 0), (6, 0, 0), (6, 1, 0), (8, 0, 0)])).collect()
    assert len(few) == len(ODD) and all(0 < r.score < 1 for r in few)


def test_normal_equations_equal_direct_ridge(make_docs, make_labels, spark):
    """Sums over partitions and folds, against one least-squares problem over all training rows at once."""
    rows, marks = labelled(200)
    docs = make_docs(rows).repartition(7)
    stored = quality.measured(docs)
    model = quality.train(stored, make_labels(marks), features=40, ridge=1e-3)
    kept = [(i, t) for i, t in rows if not is_held(i)]
    x = np.stack([quality.statistics(t.encode()) for _, t in kept]).astype(np.float32).astype(float)
    y = np.array([marks[i][1] for i, _ in kept], float)
    plain = quality.Model.empty(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3), 40)
    z = plain.features(x)
    penalty = np.sqrt(np.append(np.full(40, 1e-3 * len(y)), 1e-9))
    want = np.linalg.lstsq(np.vstack((z, np.diag(penalty))), np.append(y, np.zeros(41)), rcond=None)[0]
    assert model.ridge == pytest.approx(want, abs=1e-5)


def test_features_approximate_the_gaussian_kernel():
    d = len(quality.STATISTICS)
    x = np.random.default_rng(1).normal(size=(30, d)) / 3
    z = quality.Model.empty(np.zeros(d), np.ones(d), 20_000).features(x)[:, :-1]
    gap = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = np.exp(-gap / (2 * quality.WIDTH**2 * d))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_isotonic_equals_minimax_form():
    r = np.random.default_rng(0)
    for _ in range(50):
        k = r.integers(1, 15)
        n = r.integers(1, 9, k).astype(float)
        ones = np.floor(r.random(k) * (n + 1))
        got = quality.isotonic(n, ones)
        want = [max(min(ones[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, k)) for a in range(i + 1)) for i in range(k)]
        assert got == pytest.approx(want)


def test_statistics_of_a_small_text():
    got = dict(zip(quality.STATISTICS, quality.statistics(b"Ab ab ab!\n\nX| | 1")))
    assert got["upper"] ** 2 == pytest.approx(2 / 17) and got["bar"] ** 2 == pytest.approx(2 / 17)
    assert got["again"] == pytest.approx(0) and got["most"] == pytest.approx(1 / 6) and got["bare"] == pytest.approx(2 / 6)
    assert got["lines"] == pytest.approx(np.log(3)) and got["ends_mark"] == pytest.approx(1 / 6)
    assert not quality.statistics(b"").any()
