import hashlib
import random
import zlib

import numpy as np
import pytest
from shared import ODD, words

from farescope.llm import fingerprints, language_id, mixing, toxicity
from farescope.llm.common import WordHashes, saved, shingles, word_hashes

INSULTS = ["blarg", "snuffle", "grokker"]


def labelled(n=400):
    """Texts of which every tenth has insults or words with a bad stem, and every seventh is junk; and their labels."""
    rows, marks = [], []
    for k in range(n):
        r = random.Random(k)
        text = words(k, 60).split()
        toxic = k % 10 == 0
        if toxic:
            for _ in range(3):
                text.insert(r.randrange(len(text)), r.choice(INSULTS) if k % 20 else "zzqux" + words(r.random(), 1))
        junk = not toxic and k % 7 == 0
        if junk:
            text = [w + "!!" for w in text]
        rows.append((k, " ".join(text)))
        marks.append((k, int(not junk), int(toxic)))
    return rows, marks


@pytest.fixture
def make_labels(spark):
    return lambda marks: spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(make_docs, make_labels):
    rows, marks = labelled()
    got = toxicity.scores(make_docs(rows + [(9000, None), (9001, "")]), make_labels(marks + [(None, 1, 1), (9001, 1, None)])).collect()
    toxic = {i for i, _, t in marks if t}
    held = [r for r in got if r.held_out]
    assert len(got) == 402 and {r.doc_id for r in held} == {i for i in [*range(400), 9000, 9001] if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    wrong = [r.doc_id for r in held if r.predicted != (r.doc_id in toxic)]
    assert len(wrong) <= 0.02 * len(held) + 1
    assert all(r.predicted == 0 for r in got if r.doc_id >= 9000)


def test_toxicity_labels_of_held_out_rows_have_no_effect(make_docs, make_labels):
    rows, marks = labelled(200)
    other = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in marks]
    a, b = ({r.doc_id: r.score for r in toxicity.scores(make_docs(rows), make_labels(m)).collect()} for m in (marks, other))
    assert a == b


def test_toxicity_without_labels_and_rows(make_docs, make_labels):
    got = toxicity.scores(make_docs(ODD), make_labels([])).collect()
    assert len(got) == len(ODD) and len({r.score for r in got}) == 1
    assert toxicity.scores(make_docs([]), make_labels([(1, 1, 1), (3, 0, 0)])).count() == 0
    docs = make_docs(ODD)
    assert toxicity.clean(docs, make_labels([(4, 1, 0)])).columns == docs.columns


def test_label_model_finds_accurate_voters():
    r = np.random.default_rng(0)
    truth = r.random(3000) < 0.2
    good = np.stack([np.where(r.random(3000) < 0.9, np.where(truth, 1, -1), 0) for _ in range(4)], axis=1)
    copies = np.repeat(np.where(r.random(3000) < 0.5, 1, -1)[:, None], 5, axis=1)
    label = np.where(r.random(3000) < 0.03, ~truth, truth).astype(float)
    p = toxicity.label_model(np.concatenate((good, copies), axis=1).astype(np.int8), label)
    assert ((p > 0.5) == truth).mean() > 0.99
    shares = toxicity._overlap(np.concatenate((good, copies), axis=1), truth.astype(float))
    assert shares[4:].min() > 4 and shares[:4].max() < 2


def test_mixing_meets_targets(make_docs, make_labels):
    rows, marks = labelled()
    docs, labels = make_docs(rows), make_labels(marks)
    got = mixing.rates(docs, labels).collect()
    assert sorted(r.doc_id for r in got) == list(range(400))
    assert all(r.n_tokens == len(dict(rows)[r.doc_id].split()) and r.rate >= 0 for r in got)
    tokens = sum(r.n_tokens for r in got)
    for name, share in mixing.TARGETS.items():
        assert sum(r.n_tokens * r.rate * r[f"p_{name}"] for r in got) == pytest.approx(share * tokens, rel=1e-3)
    assert sum(r.copies for r in got) == pytest.approx(sum(r.rate for r in got), rel=0.15)
    top = {r.doc_id: max(("high", "low", "toxic"), key=lambda n: r[f"p_{n}"]) for r in got}
    right = sum(top[i] == ("toxic" if t else "high" if q else "low") for i, q, t in marks)
    assert right > 0.95 * 400


def test_rates_follow_plain_projected_gradient(spark):
    r = np.random.default_rng(3)
    p = r.dirichlet((0.5, 0.3, 0.2), 200)
    n = r.integers(1, 500, 200)
    rows = [(k, int(n[k]), [float(x) for x in p[k]]) for k in range(200)]
    soft = saved(spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>"), "soft")
    rated, shares = mixing.fitted(soft, {"high": 0.2, "low": 0.2, "toxic": 0.6})
    got = np.array([x.r for x in rated.orderBy("doc_id").collect()])
    want = np.array([0.2, 0.2, 0.6]) * n.sum()
    now, x, y = n @ p, np.ones(200), np.ones(200)
    for t in range(mixing.STEPS):
        if np.abs((n * x) @ p / want - 1).max() < mixing.CLOSE:
            break
        new = np.maximum(y - p @ (((n * y) @ p - want) / now), 0)
        x, y = new, new + t / (t + 3) * (new - x)
    assert got == pytest.approx(x, abs=1e-6) and shares["toxic"] == pytest.approx(0.6, rel=1e-3) and got.min() >= 0


def test_mixing_odd_rows(make_docs, make_labels):
    got = mixing.rates(make_docs(ODD), make_labels([])).collect()
    assert len(got) == len(ODD)
    assert mixing.rates(make_docs([]), make_labels([(1, 1, 0)])).count() == 0
    rows, marks = labelled(100)
    docs = make_docs(rows)
    left = mixing.mixed(docs, make_labels(marks), {"high": 1.0, "low": 0.1})
    copies = {r.doc_id: r.copies for r in mixing.rates(docs, make_labels(marks), {"high": 1.0, "low": 0.1}).collect()}
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, n in copies.items() for _ in range(n))


def jaccard(a, b):
    x, y = (set(shingles(word_hashes(t.encode(), WordHashes())).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints(make_docs, spark):
    rows = ODD + [(100 + k, words(k, 300)) for k in range(40)] + [(200, words(5, 300) + " end"), (201, words(6, 300))]
    got = fingerprints.fingerprints(make_docs(rows).repartition(5)).collect()
    order = sorted(rows, key=lambda x: (-(1 << 63 if x[0] is None else x[0]), x[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        want.append((str(i), len(t), hashlib.sha256(changed.encode()).hexdigest(), jaccard(t, changed), jaccard(t, after)))
    found = sorted(((str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got))
    for a, b in zip(found, sorted(want), strict=True):
        assert a[:3] == b[:3]
        assert a[3] == pytest.approx(b[3], abs=0.2) and a[4] == pytest.approx(b[4], abs=0.2)
    prints = {}
    for r in got:
        assert prints.setdefault(dict(rows)[r.doc_id], r.fingerprint) == r.fingerprint
    by_id = {r.doc_id: r for r in got}
    assert by_id[200].peer_id == 105 and by_id[201].peer_id == 106 and by_id[201].near_peer == 1.0 and by_id[8].peer_id == 7
    assert by_id[101].peer_id is None
    assert fingerprints.fingerprints(make_docs([])).count() == 0
    assert fingerprints.fingerprints(make_docs([(4, "only one")])).collect()[0].near_next == 1.0


def test_near_pairs_are_verified(make_docs):
    rows = [(k, words(1, 200) + f" {k}") for k in range(30)] + [(100, words(1, 200) + words(2, 150)), (101, words(7, 50))]
    got = {(r.doc_id, r.peer_id): r.jaccard for r in fingerprints.near_pairs(make_docs(rows), salt_rows=4).collect()}
    assert set(got) == {(k, 0) for k in range(1, 30)}
    assert all(v == pytest.approx(jaccard(dict(rows)[a], dict(rows)[b])) for (a, b), v in got.items())


def shared_passages():
    """Two unlike documents that share much with an old one, each with a copy, and one whose nearest peers fail."""
    base = words(31, 200).split()
    one, two = (" ".join(base[:175] + words(n, 50).split()) for n in (32, 33))
    return [(1, " ".join(base)), (5, one), (6, two), (7, one + " end"), (8, two + " end"), (9, one + " end"), (20, None), (21, words(34, 60)), (None, one)]


def plain_peers(rows):
    sets = [(i, set(shingles(word_hashes((t or "").encode(), WordHashes())).tolist())) for i, t in rows if i is not None]
    out = {}
    for i, x in sets:
        near = [(j, len(x & y) / len(x | y)) for j, y in sets if j < i and x and len(x & y) / len(x | y) >= 0.8]
        if near:
            out[i] = min(near)
    return out


@pytest.mark.parametrize("block", [1000, 2], ids=["whole", "blocks"])
def test_near_pairs_look_past_the_smallest_id(make_docs, monkeypatch, block):
    monkeypatch.setattr(fingerprints, "BROADCAST", 200_000 if block > 2 else 3)
    rows = shared_passages()
    assert 0.6 < jaccard(rows[0][1], rows[1][1]) < 0.8
    got = {r.doc_id: (r.peer_id, r.jaccard) for r in fingerprints.near_pairs(make_docs(rows), salt_rows=block).collect()}
    assert got == plain_peers(rows)
    assert {i: p for i, (p, _) in got.items()} == {7: 5, 8: 6, 9: 5}


def test_peers_of_the_query_are_exact(make_docs):
    """Pairs around the border, where an estimate over 128 coordinates often errs; chains of edits connect them."""
    rows = shared_passages()
    for n in range(30):
        own = words(1000 + n, 150).split()
        rows += [(1000 + 10 * n + k, " ".join(own[: 150 - 5 * k] + words(5000 + 10 * n + k, 5 * k).split())) for k in range(6)]
    got = {r.doc_id: (r.peer_id, r.near_peer) for r in fingerprints.fingerprints(make_docs(rows)).collect() if r.peer_id is not None}
    assert got == plain_peers(rows)


SPEECH = {"aa": "tak ror mun sil dak", "bb": "olu iva eso ami ude"}


def talk(lang, seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(SPEECH[lang].split()) + r.choice(SPEECH[lang].split()) for _ in range(n))


def test_language_fusion(make_docs, spark):
    known = [(k, talk("aa" if k % 2 else "bb", k, 40)) for k in range(200)]
    docs = make_docs(known + [(900, None), (901, "")], lambda t: None if not t else "aa" if any(w in t for w in ("tak", "ror", "mun")) else "bb")
    page = lambda lang, text: f'<html lang="{lang}"><script>{talk("bb", 1, 50)}</script><!-- {talk("bb", 2, 50)} --><p>{text}&amp;</p></html>'
    pages = [(k, f"https://www.one.example.org:80/{k}", page("aa-XX", talk("aa", k, 50))) for k in range(30)]
    pages += [(100, "http://one.example.org/x", "<p>.</p>"), (101, None, page("bb", "")), (102, "not a url", page("aa", talk("bb", 5, 60))), (103, "http://x.bb/", None)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = language_id.identify(table, docs).collect()
    shown = {r.page_id: r for r in got if r.kind == "page"}
    plain = {r.doc_id: r for r in got if r.kind == "document"}
    assert len(shown) == 34 and len(plain) == 202
    assert all(shown[k].lang == "aa" and shown[k].host == "one.example.org" for k in range(30))
    assert shown[100].lang == "aa"  # by its host
    assert shown[101].lang == "bb"  # by its markup
    assert shown[102].lang == "bb"  # by its text, against its markup
    assert shown[103].lang == "bb"  # by its suffix
    assert all(plain[i].lang == ("aa" if i % 2 else "bb") for i, _ in known)
    assert all(0 < r.posterior <= 1 for r in got)
    assert language_id.identify(table.limit(0), docs.limit(0)).count() == 0
    assert {r.lang for r in language_id.identify(table, docs.limit(0)).collect()} == {None}


def test_a_rare_language_is_kept(make_docs, spark):
    rows = [(k, talk("aa", k, 5)) for k in range(1500)] + [(5000, "zorp zorpi zorpo zorpe")]
    got = language_id.identify(spark.createDataFrame([(1, None, '<html lang="cc"><p>zorpi zorpo</p></html>')], "page_id long, url string, html string"),
                               make_docs(rows, lambda t: "cc" if t.startswith("zorp") else "aa")).collect()
    assert {r.lang for r in got if r.doc_id == 5000 or r.page_id == 1} == {"cc"}
    assert {r.lang for r in got if r.doc_id is not None and r.doc_id < 5000} == {"aa"}


def test_mixing_shows_what_it_reached(make_docs, make_labels):
    rows, marks = labelled()
    got = mixing.rates(make_docs(rows), make_labels(marks), {"high": 0.5, "low": 0.5}).first()
    assert (got.target_high, got.target_low, got.target_toxic) == (0.5, 0.5, 0.0)
    assert (got.reached_high + got.reached_low + got.reached_toxic) == pytest.approx(1, abs=1e-6)
    assert got.reached_high / got.reached_low == pytest.approx(1, rel=1e-2)


def test_targets_out_of_reach_end_and_show(make_docs, make_labels):
    """Equal texts have equal posteriors, so no rates can tell the domains apart."""
    docs, labels = make_docs([(k, "same words here") for k in range(40)]), make_labels([(k, k % 2, 0) for k in range(40)])
    got = mixing.rates(docs, labels, {"high": 0.9, "low": 0.1}).first()
    assert got.target_high == 0.9 and abs(got.reached_high - 0.9) > 0.1
